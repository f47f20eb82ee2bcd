"""Small document tables with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, fp string, _text string, _key string, _copies string, _rows string, _all string, row_key string, _id string"


def words(rng, n, sizes=(3, 9)):
    return [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(*sizes))) for _ in range(1)) for _ in range(n)]


def rows(seed=1, n=60):
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    out = []
    for i in range(n):
        body = words(rng, rng.choice([0, 1, 2, 30, 60, 120, 400]))
        text = " ".join(body)
        if i % 5 == 0:
            text = text + "\n" + passage + "\n" + " ".join(words(rng, 10))
        if i % 7 == 0 and out:
            text = out[rng.randrange(len(out))][1]
        if i % 11 == 0 and out and out[-1][1]:
            cut = out[-1][1].split(" ")
            cut[len(cut) // 2] = "edited"
            text = " ".join(cut)
        out.append((i * 7 % n, text, ["en", "de", None][i % 3], ["s1", "s2", None, "s1"][i % 4], i))
    out += [(n + 1, None, None, None, None), (n + 2, "", "en", "s1", 0), (n + 3, " \n\t", "en", "s1", 3), (None, "lonely words here", "en", "s2", 1), (None, None, None, None, None)]
    out += [out[5], out[5]]
    out.append((n + 4, "word " * 6000, "en", "s1", 30000))
    out.append((n + 5, "é" * 5000 + " " + "x" * 3000, "de", "s9", 8001))
    out.append((n + 6, "é" * 5000 + " y", "de", "s9", 5002))
    return out


def table(spark, data=None):
    """The documents with extra columns whose names clash with those that operators use."""
    data = rows() if data is None else data
    return spark.createDataFrame([(*r, "k", "s", "f", "t", "key", "c", "r", "a", "rk", "i") for r in data], SCHEMA).repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
