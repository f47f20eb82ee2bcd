import itertools
import random
from functools import lru_cache

from pyspark.sql import functions as F

from verso.functions import distance
from verso.operators import scoring, statistics

SCHEMA = "doc long, field string, has_gt boolean, gt string, pred string, usable boolean"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_outcome_ladder(spark):
    rows = [
        (1, "a", False, None, "x", True), (1, "b", True, None, None, True), (1, "c", True, "  ", "x", True), (1, "d", True, "x", None, True), (1, "e", True, "abc", "abd", True),
    ]
    out = {r["field"]: r for r in scoring.outcomes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [out[f]["outcome"] for f in "abcde"] == ["unscoreable", "null_agree", "hallucination", "omission", "scored"]
    assert out["e"]["edits"] == 1 and out["d"]["gt_len"] == 1 and out["a"]["gt_len"] == 0


def test_assignment_sees_unscoreable_fields(spark):
    rows = [
        (1, "receiver", False, None, "the subject of the letter", True), (1, "subject", True, "the subject of the letter", None, True),
        (2, "a", True, "first value here", "second value here", True), (2, "b", True, "second value here", "first value here", True),
        (3, "a", True, "echo echo echo", "echo echo echo", True), (3, "b", True, "other", "echo echo echo", True),
    ]
    out = {(r["doc"], r["field"]): r for r in scoring.assignments(scoring.outcomes(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert out[1, "receiver"]["misassigned_to"] == "subject" and out[2, "a"]["misassigned_to"] == "b"
    assert out[3, "a"]["misassigned_to"] is None and out[3, "a"]["duplicated_in"] == ["a", "b"]


def test_headline_charges_failures(spark):
    rows = [(1, "a", True, "abcd", "abcd", True), (2, "a", True, "abcd", None, False)]
    r = scoring.headline(scoring.outcomes(spark.createDataFrame(rows, SCHEMA))).first()
    assert (r["usable_rate"], r["cer_given_output"], r["effective_cer"]) == (0.5, 0.0, 0.5)


def test_oracle_assignment(spark):
    rng = random.Random(3)
    rows = []
    for d in range(12):
        for f in "abcd"[: rng.randint(1, 4)]:
            word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
            rows.append((d, f, True, word(), rng.choice([None, word()]), True))
    rows += [(99, "a", True, "left", "right", True), (99, "b", True, "right", "left", True)]
    table = scoring.outcomes(spark.createDataFrame(rows, SCHEMA))
    found = {r["doc"]: r["oracle_edits"] for r in scoring.oracle_edits(table).collect()}
    for d in {r[0] for r in rows}:
        gts = [r[3] for r in rows if r[0] == d]
        preds = [r[4] for r in rows if r[0] == d and r[4]]
        pool = preds + [None] * len(gts)
        best = min(sum(len(g) if p is None else lev(g, p) for g, p in zip(gts, pick)) for pick in itertools.permutations(pool, len(gts)))
        assert found[d] == best
    assert found[99] == 0


def test_oracle_assignment_of_many_fields(spark):
    rng = random.Random(5)
    word = lambda k=9: "".join(rng.choice("abc") for _ in range(rng.randint(1, k)))
    rows = [(d, f"f{i:02}", True, word(), None if d == 3 and i % 5 == 0 else word(14), True) for d in range(4) for i in range(12)]
    values = [f"{i} only value {i}" for i in range(12)]
    rows += [(99, f"f{i:02}", True, values[i], values[-i - 1], True) for i in range(12)]
    table = scoring.outcomes(spark.createDataFrame(rows, SCHEMA))
    found = {r["doc"]: r["oracle_edits"] for r in scoring.oracle_edits(table, fields=8).collect()}

    for d in {r[0] for r in rows}:
        gts, preds = [r[3] for r in rows if r[0] == d], [r[4] for r in rows if r[0] == d and r[4]]

        cost = [[lev(g, p) for p in preds] for g in gts]

        @lru_cache(None)
        def best(i, taken, gts=gts, cost=cost):
            if i == len(gts):
                return 0
            rest = (c + best(i + 1, taken | 1 << j) for j, c in enumerate(cost[i]) if not taken >> j & 1)
            return min([len(gts[i]) + best(i + 1, taken), *rest])

        assert found[d] == best(0, 0)
    assert found[99] == 0


def test_word_edits_and_substrings(spark):
    pairs = [("a b c d", "a x c"), ("", "a"), ("x x y", "y x x"), ("eins zwei drei", "eins drei zwei vier")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(distance.word_edits(F.col("a"), F.col("b"))).collect()] == [lev(a.split(), b.split()) for a, b in pairs]
    rng = random.Random(1)
    for _ in range(40):
        n, h = ("".join(rng.choice("abc") for _ in range(rng.randint(0, k))) for k in (6, 14))
        want = min(lev(n, h[i:j]) for i in range(len(h) + 1) for j in range(i, len(h) + 1))
        assert distance.substring_edits(n, h) == want


def test_run_classes(spark):
    cases = {("123", "x123"): "exact", ("123", "321"): "reversed", ("123", "213"): "permuted", ("12345", "99234"): "partial", ("123", "9"): "misread"}
    df = spark.createDataFrame(list(cases), "u string, p string")
    assert [r[0] for r in df.select(distance.run_class(F.col("u"), F.col("p"))).collect()] == list(cases.values())


def test_reversal_buckets(spark):
    gt = "AB12 INV-77 XY9 Q555 zz8zzzz"
    rows = [(1, "a", True, gt, "21BA 77 9XY Q554", True)]
    out = {r["token"]: r["bucket"] for r in scoring.reversals(scoring.outcomes(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert out["AB12"] in ("exact_reversal", "absent") and out["Q555"] == "genuine_misread" and out["zz8zzzz"] == "absent"


def test_cluster_interval_is_at_least_as_wide(spark):
    units = [("image", f"{c}-{i}", int(c > 0), 1) for c in range(3) for i in range(12)]
    clusters = [("cluster", str(c), 12 * int(c > 0), 12) for c in range(3)]
    out = {r["k"]: r for r in statistics.bootstrap(spark.createDataFrame(units + clusters + [("one", "u", 1, 2)], "k string, unit string, top long, bottom long"), ["k"]).collect()}
    assert out["cluster"]["hi"] - out["cluster"]["lo"] >= out["image"]["hi"] - out["image"]["lo"]
    assert out["one"]["lo"] is None and out["one"]["point"] == 0.5
    assert out["image"]["lo"] <= out["image"]["point"] <= out["image"]["hi"]


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in (5, 1, 4, 2, 3)], "v double")
    r = statistics.rank_values(df, [], "v", {"a": 0.5, "b": 0.9, "c": 1.0}).first()
    assert (r["a"], r["b"], r["c"]) == (3.0, 5.0, 5.0)
