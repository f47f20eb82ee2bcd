"""Reconciliation and corpus audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that a row breaks, null if none."""
    return reduce(lambda done, rule: done.when(rule[1], rule[0]), rules[1:], F.when(rules[0][1], rules[0][0]))


def slice_counts(rows: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """Rows per overlapping slice, in one pass."""
    names = F.array_compact(F.array(*(F.when(p, F.lit(n)) for n, p in slices.items())))
    return rows.select(F.explode(names).alias("slice")).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


def reconcile(actual: DataFrame, expected: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Problem rows (problem, key): unknown, missing, duplicate, or differing in a compared column."""
    found = actual.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *(F.first(c).alias(f"_{c}") for c in compare))
    say = lambda df, what: df.select(F.lit(what).alias("problem"), F.col(key))
    parts = [
        say(actual.select(key).distinct().join(expected, key, "left_anti"), "unknown"),
        say(expected.select(key).distinct().join(actual, key, "left_anti"), "missing"),
        say(found.filter("_n > 1"), "duplicate"),
    ]
    joined = found.join(expected, key)
    parts += [say(joined.filter(~F.col(f"_{c}").eqNullSafe(F.col(c))), f"{c} differs") for c in compare]
    return reduce(DataFrame.unionByName, parts)


def duplicate_groups(rows: DataFrame, content: Column) -> DataFrame:
    """(digest, n) of contents that occur more than once."""
    return rows.groupBy(F.substring(F.sha2(content, 256), 1, 12).alias("digest")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def review_reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that fire."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())))


def last_row_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the last in `order`, as when a dictionary is filled row by row."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def score_join(preds: DataFrame, gt: DataFrame, manifest: DataFrame, splits: DataFrame, key: str) -> DataFrame:
    """Predictions with ground truth and manifest; rows without a split are unassigned."""
    joined = preds.join(gt, key).join(manifest, key).join(splits, key, "left")
    return joined.withColumn("split", F.coalesce("split", F.lit("unassigned")))


def reconcile_template(template: DataFrame, delivery: DataFrame, key: str) -> DataFrame:
    """Delivery rows against a template by case-insensitive key: status matched, missing, unknown or duplicate."""
    left = template.select(F.lower(key).alias("_k"), F.col(key).alias("wanted"), "pos")
    right = delivery.groupBy(F.lower(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("given"))
    status = F.when(F.col("given").isNull(), "missing").when(F.col("wanted").isNull(), "unknown").when(F.col("_n") > 1, "duplicate").otherwise("matched")
    return left.join(right, "_k", "full").select("_k", "pos", "wanted", "given", status.alias("status"))


def repair(template: DataFrame, annotated: DataFrame, flat: DataFrame, key: str, field: str, on_page) -> DataFrame:
    """Template rows with the annotated field, kept only where it stands in the page's own text, and its provenance."""
    rows = template.join(annotated, key, "left").join(flat, key, "left")
    seen = on_page(F.col(field), F.col("text"))
    return rows.withColumns(
        {
            "kept": F.when(seen, F.col(field)),
            "withheld": F.when(F.col(field).isNotNull() & ~seen, F.col(field)),
            "provenance": F.when(F.col("text").isNull(), "no text").when(F.col(field).isNull(), "none").when(seen, "page").otherwise("withheld"),
        }
    )
