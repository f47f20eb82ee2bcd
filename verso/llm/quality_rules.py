"""Quality rules: text statistics, fixed base rules and robust multivariate outliers.

Statistics are array expressions inside each row. Per language and source a minimum covariance
determinant estimate (deterministic start from medians, then concentration steps on the half of the
rows with the smallest distances, until the determinant settles) gives centre and scatter of the
transformed statistics, made consistent for normal samples and drawn toward those of all rows by the
group's size; documents beyond a Mahalanobis cut are rejected. Sound texts have long tails, so the cut is no normal quantile: it
is the first gap of the distances beyond that quantile, which parts the tail from the outliers. All
passes are grouped aggregates with map-side combine.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verso.llm.common import BLANK, as_given, let, numbered, staged, without, words

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUTPUT = (*STATS, "base_failed", "kept", "distance2")

#: Transformed statistics that span the outlier space.
FEATURES = ("f_length", "f_word", "f_symbols", "f_repeat")
#: Smallest standard deviation of each feature: discrete statistics may have no spread at all.
FLOORS = (0.5, 0.1, 0.2, 0.2)
#: Files that estimates are written to: one row per group, so few; many small files would look too large to broadcast.
FILES = 8


#: The 0.999 quantile of squared distances in a normal sample with as many features; no cut lies below it.
NORMAL = 18.467
#: Width of the bins of the logarithm of squared distances, and bins on either side that a density is taken over.
WIDTH, REACH = 0.1, 2
#: Width of the bins by which concentration steps find the nearest half.
FINE = 0.02
#: Concentration ends when no logarithm of a determinant changes by more, or after so many steps.
SETTLED, MOST_STEPS = 0.01, 12


def first_gap(counts: dict[int, int]) -> float:
    """The cut: the first gap beyond the normal quantile, behind which distances gather again.

    `counts` has the number of rows of each bin of the logarithm. A gap is the place with the fewest rows
    so far when more than twice as many stand around a later one, by five at least and by more than chance
    (two standard deviations); the cut is at its emptiest bin. Without one there are no outliers, and the cut is infinite.
    """
    first, last = int(math.log(NORMAL) / WIDTH) + 1, max(counts, default=0) + REACH
    around = lambda i: sum(counts.get(i + k, 0) for k in range(-REACH, REACH + 1))
    least, where = math.inf, [first]
    for i in range(first, last + 1):
        here = around(i)
        if here - 2 * least >= max(5.0, 2 * math.sqrt(here)):
            middle = where[len(where) // 2]
            emptiest = min(range(max(first, middle - REACH), middle + REACH + 1), key=lambda k: (counts.get(k, 0), abs(k - middle)))
            return math.exp((emptiest + 0.5) * WIDTH)
        if here < least:
            least, where = here, [i]
        elif here == least:
            where.append(i)
    return math.inf


def _flagged_starts(tokens: Column) -> Column:
    """Sorted starts of the 3-word windows that occur twice or more among `tokens`.

    Each window becomes hash * 2^b + start, with b just enough bits for the starts, so that sorting
    plain longs puts equal windows side by side; 64 - b bits of hash remain. Where neighbours of equal
    hash differ in their words, all windows of the text are sorted by their words instead.
    """

    def window(ws: Column, i: Column) -> Column:
        return F.struct(*(F.element_at(ws, (i + k).cast("int")).alias(f"w{k}") for k in range(3)))

    def by_words(ws: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(ws) - 2), lambda i: F.struct(window(ws, i).alias("w"), i.cast("long").alias("i")))

        def equal(s: Column) -> Column:
            last = F.size(s)
            at = lambda i: F.element_at(s, i)["w"]
            hits = F.filter(
                F.sequence(F.lit(1), last),
                lambda i: ((i > 1) & (at(i) == at(F.greatest(i - 1, F.lit(1))))) | ((i < last) & (at(i) == at(F.least(i + 1, last)))),
            )
            return F.sort_array(F.transform(hits, lambda i: F.element_at(s, i)["i"]))

        return let(F.sort_array(each), equal)

    def body(ws: Column) -> Column:
        n = F.size(ws)
        bits = F.greatest(F.length(F.bin(n)), F.lit(1)).cast("int")
        keys = F.transform(
            F.sequence(F.lit(1), n - 2),
            lambda i: F.call_function(
                "shiftleft", F.xxhash64(F.element_at(ws, i), F.element_at(ws, i + 1), F.element_at(ws, i + 2)), bits
            ).bitwiseOR(i.cast("long")),
        )

        def neighbours(s: Column) -> Column:
            last = F.size(s)
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
            top = lambda i: F.call_function("shiftright", F.element_at(s, i), bits)
            start = lambda i: F.element_at(s, i).bitwiseAND(mask)
            before = lambda i: F.greatest(i - 1, F.lit(1))
            hits = F.filter(
                F.sequence(F.lit(1), last),
                lambda i: ((i > 1) & (top(i) == top(before(i)))) | ((i < last) & (top(i) == top(F.least(i + 1, last)))),
            )
            clash = lambda i: (i > 1) & (top(i) == top(before(i))) & (window(ws, start(i)) != window(ws, start(before(i))))
            return let(hits, lambda h: F.when(F.exists(h, clash), by_words(ws)).otherwise(F.sort_array(F.transform(h, start))))

        return F.when(n < 4, F.array().cast("array<bigint>")).otherwise(let(F.sort_array(keys), neighbours))

    return let(tokens, body)


def _covered(starts: Column) -> Column:
    """Words in the union of the 3-word windows at `starts`."""

    def body(s: Column) -> Column:
        n = F.size(s)
        each = F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.when(i == n, F.lit(3).cast("long")).otherwise(
                F.least(F.lit(3).cast("long"), F.element_at(s, F.least(i + 1, n)) - F.element_at(s, i))
            ),
        )
        return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x))

    return let(starts, body)


def text_statistics(text: Column) -> dict[str, Column]:
    """The five statistics of one text; null counts as a text without words."""
    known = F.coalesce(text, F.lit(""))
    tokens = words(text)
    lines = F.filter(F.split(known, "\n"), lambda line: line.rlike(f"[^{BLANK}]"))
    return {
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(F.regexp_replace(known, f"[{BLANK}]+", "")).cast("long"),
        "n_symbols": F.regexp_count(known, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _covered(_flagged_starts(tokens)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _features() -> dict[str, Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    values = (
        F.log1p(F.col("n_words")),
        F.log(chars / n),
        F.log(F.col("n_symbols") / chars + 0.01),
        F.log((F.col("n_repeat_words") + F.col("n_dup_lines")) / n + 0.05),
    )
    return dict(zip(FEATURES, (v.cast("double") for v in values), strict=True))


def consistency(half: float) -> float:
    """Factor from the scatter of the nearest share `half` of a normal sample to that of the whole sample.

    It is half / P(chi2 with p + 2 degrees <= the `half` quantile of chi2 with p degrees); for an even p both
    distributions are finite sums.
    """
    p = len(FEATURES)

    def below(x: float, degrees: int) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))

    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if below(x, p) < half else (low, x)
    return half / below(low, p + 2)


def _factors(estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Centre and inverse Cholesky entries of every group, so that the per-row work is a few products."""
    p = len(FEATURES)
    cov = {(i, j): F.col(f"c_{i}_{j}") + (FLOORS[i] ** 2 if i == j else 0.0) for i in range(p) for j in range(i + 1)}
    at, low = estimates, {}
    for i in range(p):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), cov[i, j])
            at = at.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
            low[i, j] = F.col(f"l_{i}_{j}")
    return at.select(*keys, *(f"m_{i}" for i in range(p)), *(f"c_{i}_{j}" for i, j in low), *(f"l_{i}_{j}" for i, j in low))


def _distance_from_factors() -> Column:
    z: list[Column] = []
    for i, name in enumerate(FEATURES):
        rest = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * z[k], range(i), F.col(name) - F.col(f"m_{i}"))
        z.append(rest / F.col(f"l_{i}_{i}"))
    return reduce(lambda a, b: a + b, (v * v for v in z))


def _start(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Medians and, from the quartiles, variances of every group, by mergeable sketches."""
    p = len(FEATURES)
    sketch = (F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"q_{i}") for i, f in enumerate(FEATURES))
    spread = lambda i: ((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349) ** 2
    return stats.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_half"), *sketch).select(
        *keys,
        "n_half",
        *(F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(p)),
        *((spread(i) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)),
    )


def _nearest(near: DataFrame, keys: list[str], half: float) -> DataFrame:
    """Moments of the nearest share `half` of every group's rows, in one pass; `near` has the present factors.

    Rows are summed by bins of the logarithm of their distance, and the bins up to the one that reaches the
    share are added up. Sums are taken around the present centre, so that few digits cancel.
    """
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    off = [F.col(f) - F.col(f"m_{i}") for i, f in enumerate(FEATURES)]
    bins = F.floor(F.log(F.greatest(_distance_from_factors(), F.lit(1e-6))) / FINE).alias("_bin")
    sums = near.groupBy(*keys, bins).agg(
        F.count(F.lit(1)).alias("_n"),
        *(F.first(f"m_{i}").alias(f"m_{i}") for i in range(p)),
        *(F.sum(off[i]).alias(f"s_{i}") for i in range(p)),
        *(F.sum(off[i] * off[j]).alias(f"s_{i}_{j}") for i, j in pairs),
    )
    group = Window.partitionBy(*keys)
    upto = F.sum("_n").over(group.orderBy("_bin"))
    chosen = sums.withColumn("_all", F.sum("_n").over(group)).withColumn("_before", upto - F.col("_n")).filter(F.col("_before") < F.col("_all") * half)
    total = lambda c: F.sum(c) / F.sum("_n")
    factor = consistency(half)
    return chosen.groupBy(*keys).agg(
        F.sum("_n").alias("n_half"),
        *((F.first(f"m_{i}") + total(f"s_{i}")).alias(f"m_{i}") for i in range(p)),
        *(((total(f"s_{i}_{j}") - total(f"s_{i}") * total(f"s_{j}")) * factor).alias(f"c_{i}_{j}") for i, j in pairs),
    )


def _shrunk(moments: DataFrame, common: dict[str, Column], prior: float) -> DataFrame:
    """Moments of groups drawn toward the common ones, which count as `prior` rows."""
    own = lambda c: (F.col("n_half") * F.col(c) + prior * common[c]) / (F.col("n_half") + prior)
    return moments.withColumns({c: own(c) for c in moments.columns if c in common})


def _volume() -> Column:
    """Logarithm of the determinant of the scatter."""
    return reduce(lambda a, b: a + b, (2 * F.log(f"l_{i}_{i}") for i in range(len(FEATURES))))


def mcd_common(stats: DataFrame, half: float = 0.5) -> dict[str, Column]:
    """Centre m_i, scatter c_i_j and factor l_i_j of the concentrated part of all rows, as literals; nulls for an empty table."""

    def found(frame: DataFrame) -> tuple[dict[str, Column], float]:
        row = _factors(frame, []).withColumn("_volume", _volume()).first().asDict()
        volume = row.pop("_volume")
        return {k: F.lit(v).cast("double") for k, v in row.items()}, volume

    common, volume = found(_start(stats, []))
    for _ in range(MOST_STEPS):
        before = volume
        common, volume = found(_nearest(stats.withColumns(common), [], half))
        if abs(volume - before) < SETTLED:
            break
    return common


def mcd_estimates(stats: DataFrame, keys: list[str], common: dict[str, Column], prior: float, half: float = 0.5) -> DataFrame:
    """One row per group: centre m_i and Cholesky factor l_i_j of its concentrated part, drawn toward `common`.

    The start is the diagonal estimate from medians and quartiles. Each step keeps, per group, the share
    `half` of rows with the smallest distances and estimates again, until no group's determinant changes.
    A group's moments are averaged with those of all rows, which count as `prior` rows, so that a group of
    any size has an estimate and the change from few to many rows is smooth. No group is gathered anywhere.
    Estimates are written tables, whose known size lets Spark broadcast them while they are small and join
    by shuffle beyond that.
    """

    def written(moments: DataFrame, name: str) -> DataFrame:
        return staged(_factors(_shrunk(moments, common, prior), keys).withColumn("_volume", _volume()).repartition(FILES), name)

    factors = written(_start(stats, keys), "mcd-0")
    for step in range(1, MOST_STEPS + 1):
        after = written(_nearest(stats.join(factors.drop("_volume"), keys), keys, half), f"mcd-{step}")
        change = F.max(F.abs(F.col("_volume") - F.col("_was")))
        moved = after.join(factors.select(*keys, F.col("_volume").alias("_was")), keys).agg(change).first()[0]
        factors = after
        if (moved or 0.0) < SETTLED:
            break
    return factors.drop("_volume", *(c for c in factors.columns if c.startswith("c_")))


def judged(
    df: DataFrame,
    text_col: str = "text",
    group_cols: tuple[str, ...] = ("lang", "source"),
    carry: tuple[str, ...] = ("doc_id",),
    cut: float | None = None,
    prior: float = 20.0,
) -> DataFrame:
    """Statistics and verdict of every row: carry columns, the five statistics, base_failed, kept, distance2.

    A row is kept if the base rules pass and its squared distance is at most `cut`, by default the
    first gap of all rows' distances beyond the normal quantile. The estimate is
    fitted on the rows that pass the base rules; a group's is averaged with that of all rows, which
    counts as `prior` rows. Null languages and sources form groups of their own. Null and empty texts have no
    words and fail; repeated rows are judged one by one; an empty table gives an empty result.
    """
    keys = [f"_g{i}" for i in range(len(group_cols))]
    stats = without(df.select(*dict.fromkeys((*carry, *group_cols, text_col))), *(c for c in OUTPUT if c not in carry))
    base = stats.select(
        *(F.col(c) for c in carry),
        *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")).alias(k) for c, k in zip(group_cols, keys, strict=True)),
        *(v.alias(k) for k, v in text_statistics(F.col(text_col)).items()),
    )
    table = staged(base.withColumn("base_failed", base_failed()), "statistics").withColumns(_features())
    fit = table.filter("not base_failed")
    common = mcd_common(fit.select(*FEATURES))
    own = mcd_estimates(fit.select(*keys, *FEATURES), keys, common, prior)
    # Groups of which no row passes the base rules have no estimate; their rows get the common distance.
    scored = table.join(own, keys, "left").withColumns({c: F.coalesce(F.col(c), common[c]) for c in own.columns if c not in keys})
    scored = scored.withColumn("_distance", F.coalesce(_distance_from_factors(), F.lit(0.0)))
    if cut is None:
        far = scored.filter("not base_failed and _distance > 1")
        bins = far.groupBy(F.floor(F.log("_distance") / WIDTH).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        cut = first_gap({r["bin"]: r["n"] for r in bins})
    return scored.select(
        *carry,
        *STATS,
        "base_failed",
        (~F.col("base_failed") & (F.col("_distance") <= F.lit(cut))).alias("kept"),
        F.round("_distance", 6).alias("distance2"),
    )


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), **options) -> DataFrame:
    """The rows of `df` that are kept, with its columns; rows are told apart by identifier and text.

    Null and empty texts have no words and go; repeated rows stay or go together; null identifiers are
    like any other; an empty table gives no rows.
    """
    rows, ident, text, *groups = numbered(df, id_col, text_col, *group_cols)
    keyed = rows.withColumn("_key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    verdicts = judged(keyed, text_col=text, group_cols=tuple(groups), carry=(ident, "_key"), **options)
    good = verdicts.filter("kept").select(F.col(ident).alias("_id"), F.col("_key").alias("_seen"))
    same = keyed[ident].eqNullSafe(good["_id"]) & (keyed["_key"] == good["_seen"])
    return as_given(keyed.join(good, same, "left_semi"), df)
