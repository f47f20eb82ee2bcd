"""Field-level scoring of predictions against ground truth.

Tables are flat: (doc, field, has_gt, gt, pred, usable). `has_gt` tells an absent ground truth from a null
one, a difference that nested JSON loses. Texts are compared as given; callers normalise first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verso.functions.distance import edits, similarity, substitutions, word_edits
from verso.functions.text import is_blank, tokens

#: Fixed thresholds of the assignment and duplication passes.
ASSIGNMENT = 0.80
DUPLICATION = 0.80


def usable_kind(error: Column, status: Column, ok: Column, has_object: Column, all_null: Column) -> Column:
    """Why a response cannot be scored, by the first rule that fits; null when it can."""
    return (
        F.when(error.isNotNull() & (error != ""), "transport")
        .when(status.isNotNull() & (status != 200), F.concat(F.lit("http_"), status.cast("string")))
        .when(ok.isNotNull() & ~ok, "not_ok")
        .when(status.isNull() & ok.isNull(), "unknown_shape")
        .when(~has_object, "no_object")
        .when(all_null, "all_null")
    )


def legacy_failure_kind(error: Column) -> Column:
    low = F.lower(F.coalesce(error, F.lit("")))
    return F.when(low.contains("422"), "http_422").when(low.contains("timeout") | low.contains("timed out"), "timeout").otherwise("transport_or_5xx")


def outcomes(pairs: DataFrame) -> DataFrame:
    """Add outcome, edits, gt_len, cer, word_edits, gt_words and exact to every field row."""
    gt, pred = F.coalesce("gt", F.lit("")), F.coalesce("pred", F.lit(""))
    no_gt, no_pred = is_blank(F.col("gt")), is_blank(F.col("pred"))
    outcome = (
        F.when(~F.col("has_gt"), "unscoreable")
        .when(no_gt & no_pred, "null_agree")
        .when(no_pred, "omission")
        .when(no_gt, "hallucination")
        .otherwise("scored")
    )
    scored = F.col("outcome") == "scored"
    return pairs.withColumn("outcome", outcome).withColumns(
        {
            "edits": F.when(scored, edits(F.when(scored, gt), F.when(scored, pred))).cast("long"),
            "gt_len": F.when(F.col("has_gt") & ~no_gt, F.length(gt)).otherwise(0).cast("long"),
            "word_edits": F.when(scored, word_edits(gt, pred)).cast("long"),
            "gt_words": F.when(scored, F.size(tokens(gt))).cast("long"),
            "exact": F.when(scored, gt == pred),
        }
    )


def assignments(rows: DataFrame, order: str = "field") -> DataFrame:
    """Add misassigned_to and duplicated_in: the fields of one document compared with each other.

    A prediction belongs to another field if it is at least 80 % alike to that field's ground truth and
    more than to its own; the first of equal fields counts. The join stays inside a document.
    """
    gts = rows.filter(F.col("has_gt") & ~is_blank(F.col("gt"))).select("doc", F.col(order).alias("_g"), F.col("gt").alias("_gt"))
    preds = rows.filter(~is_blank(F.col("pred"))).select("doc", F.col(order).alias("_p"), F.col("pred").alias("_pred"), F.col("gt").alias("_own"), F.col("has_gt").alias("_has"))
    alike = preds.join(gts, "doc").withColumn("_sim", similarity(F.col("_gt"), F.col("_pred"), edits))
    own = F.when(F.col("_has"), similarity(F.col("_own"), F.col("_pred"), edits)).otherwise(0.0)
    first = Window.partitionBy("doc", "_p").orderBy(F.desc("_sim"), "_g")
    best = alike.filter("_g <> _p").withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    best = best.filter((F.col("_sim") >= ASSIGNMENT) & (F.col("_sim") > own)).select("doc", F.col("_p").alias(order), F.col("_g").alias("misassigned_to"))
    twice = alike.filter(F.col("_sim") >= DUPLICATION).groupBy("doc", "_g").agg(F.array_sort(F.collect_set("_p")).alias("duplicated_in"))
    twice = twice.filter(F.size("duplicated_in") > 1).withColumnRenamed("_g", order)
    return rows.join(best, ["doc", order], "left").join(twice, ["doc", order], "left")


def ratio(top: Column, bottom: Column, digits: int = 4) -> Column:
    return F.bround(top / F.nullif(bottom, F.lit(0)), digits)


def micro_cer() -> Column:
    scored = F.col("outcome") == "scored"
    return ratio(F.sum(F.when(scored, F.col("edits"))), F.sum(F.when(scored, F.col("gt_len"))))


def assigned_cer() -> Column:
    """Edits over all ground truth; a missing prediction costs every character."""
    return ratio(F.sum(F.coalesce("edits", "gt_len")), F.sum("gt_len"))


def effective_cer() -> Column:
    """As assigned, with documents without usable output charged in full."""
    cost = F.when(F.col("usable") & (F.col("outcome") == "scored"), F.col("edits")).otherwise(F.col("gt_len"))
    return ratio(F.sum(F.when(F.col("outcome").isin("scored", "omission"), cost)), F.sum(F.when(F.col("outcome").isin("scored", "omission"), F.col("gt_len"))))


def headline(rows: DataFrame, *keys: str) -> DataFrame:
    """Usable rate, error given output, effective error and exact rate per group."""
    docs = F.count_distinct("doc")
    usable = F.count_distinct(F.when(F.col("usable"), F.col("doc")))
    return rows.groupBy(*keys).agg(
        docs.alias("n_docs"),
        ratio(usable, docs).alias("usable_rate"),
        micro_cer().alias("cer_given_output"),
        effective_cer().alias("effective_cer"),
        assigned_cer().alias("assigned_cer"),
        ratio(F.count_if(F.col("exact")), F.count_if(F.col("outcome") == "scored")).alias("exact_rate"),
    )


def error_classes(rows: DataFrame, *keys: str) -> DataFrame:
    one = {k: F.count_if(F.col("outcome") == k).alias(k) for k in ("scored", "omission", "hallucination", "null_agree", "unscoreable")}
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("slots"),
        *one.values(),
        F.count_if(F.col("misassigned_to").isNotNull()).alias("misassigned"),
        F.count_if(F.col("duplicated_in").isNotNull()).alias("duplicated"),
        F.count_if((F.col("outcome") == "unscoreable") & ~is_blank(F.col("pred"))).alias("unscoreable_content"),
    )


def per_field(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row per field name, also for those that never occur."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(n,) for n in names], "field string")
    table = rows.groupBy("field").agg(
        F.count_if(F.col("outcome") != "unscoreable").alias("n"),
        F.count_if(F.col("outcome") == "unscoreable").alias("unscoreable"),
        micro_cer().alias("cer"),
        ratio(F.sum("word_edits"), F.sum("gt_words")).alias("wer"),
        F.count_if(F.col("exact")).alias("exact"),
        F.count_if(F.col("outcome") == "omission").alias("omissions"),
    )
    counts = ("n", "unscoreable", "exact", "omissions")
    return F.broadcast(wanted).join(table, "field", "left").fillna(0, list(counts))


def reversals(rows: DataFrame) -> DataFrame:
    """Bucket of each ground-truth token with Latin letters or digits that the prediction lacks."""
    gt = rows.filter("outcome = 'scored'").select("doc", "field", F.posexplode(tokens(F.col("gt"))).alias("pos", "token"), tokens(F.col("pred")).alias("_preds"))
    gt = gt.filter(F.col("token").rlike("[A-Za-z0-9]") & ~F.array_contains("_preds", F.col("token")))
    scored = F.transform("_preds", lambda p, i: F.struct(similarity(F.col("token"), p).alias("sim"), (-i).alias("pos"), p.alias("word")))
    best = gt.withColumn("_best", F.array_max(scored))
    sorted_of = lambda c: F.array_sort(F.split(c, ""))
    word, token = F.col("_best.word"), F.col("token")
    stripped = F.lit(False)
    for prefix in ("INV-", "EMP-", "REF-", "DOC-", "NO-"):
        stripped = stripped | (token.startswith(prefix) & (word == F.substring(token, F.lit(len(prefix) + 1), F.length(token))))
    bucket = (
        F.when(F.coalesce(F.col("_best.sim"), F.lit(0.0)) < 0.4, "absent")
        .when(word == F.reverse(token), "exact_reversal")
        .when(sorted_of(word) == sorted_of(token), "any_permutation")
        .when(stripped, "prefix_stripped")
        .otherwise("genuine_misread")
    )
    return best.select("doc", "field", "pos", "token", bucket.alias("bucket"))


def multiset_hits(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per key: items on the left (n) and how many of them the right side has as well (hit), with multiplicity."""
    a = left.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("_b"))
    both = a.join(b, [*keys, item], "left").select(*keys, "_a", F.least("_a", F.coalesce("_b", F.lit(0))).alias("_hit"))
    return both.groupBy(*keys).agg(F.sum("_a").alias("n"), F.sum("_hit").alias("hit"))


def oracle_edits(rows: DataFrame, fields: int = 5) -> DataFrame:
    """Per document: fewest edits over all one-to-one assignments of predictions to ground-truth fields.

    A field without a prediction costs its length. Documents with up to `fields` predictions are solved
    over subsets inside their row, those with more by the Hungarian method.
    """
    kept = rows.filter(~is_blank(F.col("pred")))
    many = kept.groupBy("doc").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > fields).select("doc")
    few = _over_subsets(rows.join(many, "doc", "left_anti"))
    return few.unionByName(_by_matching(rows.join(many, "doc", "left_semi")))


def _least_assignment(cost):
    """Smallest total of one column for each row, no column twice: Hungarian method; no more rows than columns."""
    import numpy as np

    n, m = cost.shape
    u, v = np.zeros(n + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
    row_of, way = np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
    most = np.iinfo(np.int64).max // 4
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least, used = np.full(m + 1, most), np.zeros(m + 1, dtype=bool)
        while True:
            used[at] = True
            here = np.concatenate([[most], cost[row_of[at] - 1] - u[row_of[at]] - v[1:]])
            better = ~used & (here < least)
            least[better], way[better] = here[better], at
            to = int(np.argmin(np.where(used, most, least)))
            step = least[to]
            u[row_of[used]] += step
            v[used] -= step
            least[~used] -= step
            at = to
            if row_of[at] == 0:
                break
        while at:
            row_of[at] = row_of[way[at]]
            at = way[at]
    taken = np.flatnonzero(row_of[1:])
    return int(cost[row_of[1:][taken] - 1, taken].sum())


def _saved(pdf):
    import numpy as np
    import pandas as pd

    g, j = pd.factorize(pdf["g"])[0], pd.factorize(pdf["j"])[0]
    n = g.max() + 1
    # Columns of zeros stand for fields that take no prediction.
    cost = np.zeros((n, max(n, j.max() + 1)), dtype=np.int64)
    cost[g, j] = pdf["change"]
    return pd.DataFrame({"doc": pdf["doc"].iloc[:1], "saved": [_least_assignment(cost)]})


def _by_matching(rows: DataFrame) -> DataFrame:
    """Costs by a join, then one matrix per document; only pairs cheaper than no prediction take part."""
    gts = rows.filter(F.col("gt_len") > 0)
    preds = rows.filter(~is_blank(F.col("pred")))
    numbered_gts = gts.select("doc", "gt", "gt_len", F.row_number().over(Window.partitionBy("doc").orderBy("field", "gt")).alias("g"))
    numbered = preds.select("doc", "pred", F.row_number().over(Window.partitionBy("doc").orderBy("field", "pred")).alias("j"))
    change = F.levenshtein("gt", "pred").cast("long") - F.col("gt_len")
    pairs = numbered_gts.join(numbered, "doc").select("doc", "g", "j", change.alias("change")).filter("change < 0")
    saved = pairs.groupBy("doc").applyInPandas(_saved, f"doc {rows.schema['doc'].dataType.simpleString()}, saved long")
    total = gts.groupBy("doc").agg(F.sum("gt_len").alias("total"))
    return total.join(saved, "doc", "left").select("doc", (F.col("total") + F.coalesce("saved", F.lit(0))).alias("oracle_edits"))


def _over_subsets(rows: DataFrame) -> DataFrame:
    """Costs of one document form a small matrix, folded one ground-truth field at a time over subsets of predictions."""
    gts = rows.filter(F.col("gt_len") > 0).select("doc", F.col("field").alias("g"), "gt", "gt_len")
    preds = rows.filter(~is_blank(F.col("pred"))).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("field", "pred"))).alias("preds"))
    costs = gts.join(preds, "doc", "left").withColumn("row", F.transform(F.coalesce("preds", F.array().cast("array<struct<field:string,pred:string>>")), lambda p: F.levenshtein("gt", p["pred"]).cast("long")))
    matrix = costs.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("g", "gt_len", "row"))).alias("m"), F.max(F.size("row")).alias("k"))
    size = F.pow(F.lit(2), F.col("k")).cast("int")
    big = F.lit(1 << 40).cast("long")

    def fold(best: Column, line: Column) -> Column:
        # best[s]: cheapest so far with the predictions in s taken.
        def of(s: Column) -> Column:
            skip = F.element_at(best, s + 1) + line["gt_len"]
            take = F.transform(
                line["row"],
                lambda c, j: F.when(
                    F.pmod(F.floor(s / F.pow(F.lit(2), j)), F.lit(2)) == 1,
                    F.element_at(best, F.greatest((s - F.pow(F.lit(2), j) + 1).cast("int"), F.lit(1))) + c,
                ).otherwise(big),
            )
            return F.least(skip, F.coalesce(F.array_min(take), big))

        return F.transform(F.sequence(F.lit(0), F.size(best) - 1), of)

    start = F.transform(F.sequence(F.lit(0), size - 1), lambda s: F.when(s == 0, F.lit(0).cast("long")).otherwise(big))
    return matrix.select("doc", F.array_min(F.aggregate("m", start, fold)).alias("oracle_edits"))


def _pairs(batches):
    import pandas as pd

    for pdf in batches:
        found = [p for a, b in zip(pdf["gt"], pdf["pred"], strict=True) for p in substitutions(a, b)]
        yield pd.DataFrame(found, columns=["gt_char", "pred_char"])


def confusion(rows: DataFrame, top: int = 30) -> DataFrame:
    """The most frequent substituted characters of scored, rightly assigned fields, per same or crossed script."""
    from verso.functions.text import script_of

    scored = rows.filter("outcome = 'scored' and misassigned_to is null").select("gt", "pred")
    counts = scored.mapInPandas(_pairs, "gt_char string, pred_char string").groupBy("gt_char", "pred_char").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("same_script", script_of(F.col("gt_char")) == script_of(F.col("pred_char")))
    order = Window.partitionBy("same_script").orderBy(F.desc("n"), "gt_char", "pred_char")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
