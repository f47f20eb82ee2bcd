import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.fixtures import empty, rows, table
from verso.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen, covered, lines, repeated = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def test_statistics(spark):
    more = [(900, "a b c a b c a b", "en", "s", 1), (901, "x\nx\n\nx\n y\n y", "en", "s", 1), (902, "a a a a", "en", "s", 1), (903, "#*$ %&|<> a b c", "en", "s", 1)]
    df = table(spark, rows() + more)
    for r in df.select("text", *(v.alias(k) for k, v in Q.text_statistics(F.col("text")).items())).collect():
        assert tuple(r)[1:] == statistics(r["text"]), r


def test_equal_hashes_of_different_windows(spark):
    # In texts of 2^19 words and more 44 bits of hash remain, in which these two windows agree.
    filler = [f"w{i}" for i in range(530000)]
    pair = [*filler[:9], "a29289", "b", "c", *filler[9:], "a6203776", "b", "c", "end"]
    texts = {0: " ".join(pair), 6: " ".join(["p", "q", "r", *pair, "p", "q", "r"])}
    df = spark.createDataFrame(list(texts.items()), "want long, text string")
    for r in df.select("want", Q.text_statistics(F.col("text"))["n_repeat_words"].alias("n")).collect():
        assert r["n"] == r["want"]


def test_outliers_go_and_sound_texts_stay(spark):
    rng = np.random.default_rng(3)
    sound = [(i, " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(int(rng.integers(80, 300)))), "en", "s", 1) for i in range(200)]
    noisy = [(1000 + i, " ".join("".join(rng.choice(list("abcdefgh"), 4)) + "###$$$" for _ in range(120)), "en", "s", 1) for i in range(6)]
    found = {r["doc_id"]: r for r in Q.judged(table(spark, sound + noisy)).collect()}
    assert all(found[i]["kept"] for i in range(200))
    assert not any(found[1000 + i]["kept"] for i in range(6))


def test_edges(spark):
    df = table(spark)
    out = Q.judged(df, carry=("doc_id", "kept")).collect()
    assert len(out) == len(rows())
    assert all(r["base_failed"] for r in out if r["n_words"] < 50)
    assert Q.judged(empty(spark)).count() == 0
    kept = Q.keep_good(df)
    assert kept.columns == df.columns and 0 < kept.count() < len(rows())
    assert {(r["_key"], r["_id"], r["kept"]) for r in kept.collect()} == {("key", "i", "k")}


def estimated_distances(x, group, prior=20):
    """The robust distances with numpy, group by group: nearest halves by bins of distance, drawn toward those of all rows."""
    quantile = lambda v, q: np.quantile(v, q, axis=0, method="inverted_cdf")
    distances = lambda v, m, c: (np.square(np.linalg.solve(np.linalg.cholesky(c + np.diag(np.square(Q.FLOORS))), (v - m).T))).sum(0)
    volume = lambda c: np.linalg.slogdet(c + np.diag(np.square(Q.FLOORS)))[1]

    def start(v):
        low, centre, high = (quantile(v, q) for q in (0.25, 0.5, 0.75))
        return len(v), centre, np.diag(((high - low) / 1.349) ** 2)

    def nearest(v, m, c):
        bins = np.floor(np.log(np.maximum(distances(v, m, c), 1e-6)) / Q.FINE)
        near = v[bins <= np.sort(bins)[(len(v) + 1) // 2 - 1]]
        return len(near), near.mean(0), np.cov(near.T, bias=True).reshape(4, 4) * Q.consistency(0.5)

    def settle(parts, drawn):
        now = [drawn(*start(v)) for v in parts]
        for _ in range(Q.MOST_STEPS):
            after = [drawn(*nearest(v, *e)) for v, e in zip(parts, now, strict=True)]
            moved = max(abs(volume(a[1]) - volume(e[1])) for a, e in zip(after, now, strict=True))
            now = after
            if moved < Q.SETTLED:
                break
        return now

    ((m0, c0),) = settle([x], lambda n, m, c: (m, c))
    names = np.unique(group)
    found = settle([x[group == g] for g in names], lambda n, m, c: ((n * m + prior * m0) / (n + prior), (n * c + prior * c0) / (n + prior)))
    out = np.empty(len(x))
    for g, e in zip(names, found, strict=True):
        out[group == g] = distances(x[group == g], *e)
    return out


def features(found):
    n, chars, symbols, dup, rep = np.array([[r[k] for k in Q.STATS] for r in found], float).T
    return np.stack([np.log1p(n), np.log(chars / n), np.log(symbols / chars + 0.01), np.log((rep + dup) / n + 0.05)], 1)


def test_group_that_is_40_percent_poor(spark):
    rng = np.random.default_rng(4)
    word = lambda letters, n: "".join(rng.choice(list(letters), n))
    sound = [(i, " ".join(word("abcdefghijklmnop", 6) for _ in range(int(rng.integers(80, 300)))), "en", "s", 1) for i in range(180)]
    poor = [(1000 + i, " ".join(word("abcdefgh", 4) + "###$$$" for _ in range(int(rng.integers(80, 300)))), "en", "s", 1) for i in range(120)]
    sources = {
        "one": lambda i: "s",
        "small": lambda i: f"few{i % 1000 % 30}",  # groups of ten rows
        "mixed": lambda i: "big" if i % 1000 % 3 else f"few{i % 1000 % 39}",  # of 200, and of seven or eight
    }
    for source in sources.values():
        data = [(*r[:3], source(r[0]), r[4]) for r in sound + poor]
        found = sorted(Q.judged(table(spark, data)).collect())
        group = np.array([source(r["doc_id"]) for r in found])
        assert np.allclose([r["distance2"] for r in found], estimated_distances(features(found), group), rtol=1e-5, atol=1e-5)
        assert [r["kept"] for r in found] == [r["doc_id"] < 1000 for r in found]


def test_groups_of_any_size_have_an_estimate(spark):
    # One row, two rows and more beside a large group: no size at which the estimate changes its kind.
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 9))))
    data, sizes = [], {"a": 1, "b": 2, "c": 39, "d": 40, "e": 41, "f": 150}
    for name, n in sizes.items():
        data += [(len(data) + i, " ".join(word() for _ in range(int(rng.integers(60, 200)))), "en", name, 1) for i in range(n)]
    found = sorted(Q.judged(table(spark, data)).collect())
    group = np.array([r[3] for r in sorted(data)])
    assert np.allclose([r["distance2"] for r in found], estimated_distances(features(found), group), rtol=1e-5, atol=1e-5)
    assert all(r["kept"] for r in found)


def test_scatter_of_the_half_stands_for_that_of_all():
    x = np.random.default_rng(6).standard_normal((400_000, len(Q.FEATURES)))
    d = (x * x).sum(1)
    for half in (0.5, 0.75):
        near = x[d <= np.quantile(d, half)]
        assert np.allclose(near.var(0) * Q.consistency(half), 1, atol=0.02)


def test_cut_is_the_first_gap_beyond_the_normal_quantile():
    bins = lambda *values: {int(np.log(v) / Q.WIDTH): n for v, n in values}
    at = lambda k: np.exp((k + 0.5) * Q.WIDTH)
    tail = [(at(k), max(1, 400 - 10 * k)) for k in range(45)]
    poor, worse = [[(at(k), 90) for k in range(a, a + 3)] for a in (50, 58)]
    assert at(44) <= Q.first_gap(bins(*tail, *poor, *worse)) <= at(50)
    assert Q.first_gap(bins(*tail)) == np.inf and Q.first_gap({}) == np.inf
    assert Q.NORMAL < Q.first_gap(bins((2, 50), (300, 6))) < 300 and Q.first_gap(bins((2, 50), (300, 1))) == np.inf
