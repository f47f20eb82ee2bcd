import math
import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.fixtures import empty, rows, table
from verso.llm.common import fold
from verso.llm.language_id import MIX, identify


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in identify(docs).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98


def test_predictions_see_the_text_alone(spark):
    df = table(spark)
    # Of the rows that are not learned from, language and source change; of the others nothing does.
    other = df.withColumns({c: F.when(fold(F.col("doc_id")) == 2, F.lit("xx")).otherwise(F.col(c)) for c in ("lang", "source")})
    a = {(r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in identify(df).collect()}
    b = {(r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in identify(other.repartition(2)).collect()}
    assert a == b


def bucket(gram, bits):
    code = 0
    for c in gram:
        code = (code * int(MIX[0]) + ord(c)) % 2**64
    return (code + len(gram)) * int(MIX[1]) % 2**64 >> (64 - bits)


def buckets(text, bits):
    framed = f"\n{(text or '').lower()}\n"
    return [bucket(framed[i : i + n], bits) for n in (1, 2, 3) for i in range(len(framed) - n + 1)]


def test_against_brute_force(spark):
    """Multinomial naive Bayes in plain Python over the same buckets."""
    bits, rng = 10, random.Random(3)
    letters = {"aa": "aeioubcdf", "bb": "aeiouxyzw", "cc": "klmnpqrst"}
    texts = [(i, "".join(rng.choice(letters[k] + " ") for _ in range(rng.randrange(1, 40))), k) for i, k in enumerate(sorted(letters) * 60)]
    texts += [(300, "½ ² ①", "aa"), (301, "", "bb"), (302, None, "bb"), (303, "123 :;", None), (304, "ß", "cc")]
    counts = {k: Counter() for k in letters}
    docs = Counter()
    for i, t, k in texts:
        if k and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[k].update(buckets(t, bits))
            docs[k] += 1
    total = {k: sum(c.values()) + 2**bits for k, c in counts.items()}
    found = {r["doc_id"]: r for r in identify(table(spark, [(i, t, k, "s", 1) for i, t, k in texts]), bits=bits).collect()}
    for i, t, _ in texts:
        if not any(c.isalpha() for c in t or ""):
            assert found[i]["lang_pred"] == "und" and found[i]["score"] == 0
            continue
        logs = {k: math.log(docs[k] / sum(docs.values())) + sum(math.log((counts[k][b] + 1) / total[k]) for b in buckets(t, bits)) for k in letters}
        best = max(sorted(logs), key=logs.get)
        assert found[i]["lang_pred"] == best
        assert abs(found[i]["score"] - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-3


def test_ties_go_to_the_first_language_by_name(spark):
    learned = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    data = [(i, "same words", k, "s", 1) for k in ("zz", "yy") for i in learned] + [(9000, "same", None, "s", 1)]
    assert {r["lang_pred"] for r in identify(table(spark, data)).collect()} == {"yy"}


def test_edges(spark):
    found = identify(table(spark)).collect()
    assert len(found) == len(rows())
    blank = {61, 62, 63}
    for r in found:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in blank:
            assert r["lang_pred"] == "und" and r["score"] == 0
    nothing = table(spark, [(1, "some words", None, "s", 1), (2, "123", None, "s", 1)])
    assert {r["lang_pred"] for r in identify(nothing).collect()} == {"und"}
    assert identify(empty(spark)).count() == 0
