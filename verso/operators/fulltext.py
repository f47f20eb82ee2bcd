"""Transcript-level scores: coverage of ground truth, digit groups, unsupported lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verso.functions.distance import edits as edit_count
from verso.functions.distance import semiglobal
from verso.functions.values import atoms, numbers
from verso.operators.scoring import multiset_hits, ratio


def distinct_fields(fields: DataFrame) -> DataFrame:
    """Fields of a document that are not part of a strictly longer one, blanks aside; for counting numbers once."""
    bare = fields.withColumn("_b", F.replace("gt", F.lit(" "), F.lit("")))
    other = bare.select(F.col("doc"), F.col("field").alias("_of"), F.length("gt").alias("_on"), F.col("_b").alias("_ob"))
    inside = (F.col("field") != F.col("_of")) & (F.length("gt") < F.col("_on")) & F.contains("_ob", F.col("_b"))
    held = bare.join(other, "doc").filter(inside).select("doc", "field").distinct()
    return fields.join(held, ["doc", "field"], "left_anti")


def score_documents(fields: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Per document: edits of each field against any part of the transcript, and hits among digit groups and numbers.

    `fields` is (doc, field, gt) with gt not empty, `transcripts` is (doc, text); both normalised.
    """
    edits = fields.join(transcripts, "doc").select("doc", semiglobal(F.col("gt"), F.col("text")).alias("e"), F.length("gt").alias("n"))
    edits = edits.groupBy("doc").agg(F.sum("e").alias("err"), F.sum("n").alias("chars"))
    kept = distinct_fields(fields)
    items = lambda df, col, fn: df.select("doc", F.explode(fn(F.col(col))).alias("item"))
    out = edits
    for name, fn in (("atoms", atoms), ("nums", numbers)):
        hits = multiset_hits(items(kept, "gt", fn), items(transcripts, "text", fn), ["doc"], "item")
        out = out.join(hits.select("doc", F.col("n").alias(f"{name}_gt"), F.col("hit").alias(f"{name}_hit")), "doc", "left")
    sizes = kept.groupBy("doc").agg(F.sum(F.length("gt")).alias("gt_len")).join(transcripts.select("doc", F.length("text").alias("pred_len")), "doc")
    return out.join(sizes, "doc").fillna(0, ["atoms_gt", "atoms_hit", "nums_gt", "nums_hit"])


def coverage(scores: DataFrame, *keys: str) -> DataFrame:
    """Coverage error, recall of digit groups and of whole numbers, and recovered length."""
    one = lambda top, bottom, digits=4: ratio(F.sum(top), F.greatest(F.sum(bottom), F.lit(1)), digits)
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        one("err", "chars").alias("coverage_cer"),
        one("atoms_hit", "atoms_gt").alias("atom_recall"),
        one("nums_hit", "nums_gt").alias("number_exact_recall"),
        one("pred_len", "gt_len", 3).alias("len_ratio"),
    )


def unsupported_lines(lines: DataFrame, pages: DataFrame, share: float = 0.5) -> DataFrame:
    """Lines (page, line, text) that differ from every part of the page's other text by over half their length."""
    joined = lines.join(pages, "page").filter(F.trim("text") != "")
    return joined.withColumn("edits", semiglobal(F.col("text"), F.col("page_text"))).filter(F.col("edits") > F.length("text") * F.lit(share)).drop("page_text")


def recall_by_length(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Recall of digit groups by their length; both are (doc, item)."""
    hits = multiset_hits(truth.withColumn("n_digits", F.length("item")), found.withColumn("n_digits", F.length("item")), ["doc", "n_digits"], "item")
    return hits.groupBy("n_digits").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), ratio(F.sum("hit"), F.sum("n")).alias("recall"))


def field_cer(gt: Column, pred: Column) -> dict[str, Column]:
    """Edits and characters of a field, a missing prediction costing every character, and whether it is spurious."""
    gt, pred = F.coalesce(gt, F.lit("")), F.coalesce(pred, F.lit(""))
    return {
        "edits": F.when(gt != "", edit_count(gt, pred)),
        "chars": F.when(gt != "", F.length(gt)),
        "spurious": (gt == "") & (pred != ""),
    }


def placement(rows: DataFrame, *keys: str) -> DataFrame:
    """Error where a field was put, error anywhere in the output, and what is lost to wrong places.

    `rows` is (doc, field, gt, pred, content): content is the whole output of the document.
    """
    named = edit_count(F.col("gt"), F.coalesce("pred", F.lit("")))
    any_ = semiglobal(F.col("gt"), F.col("content"))
    both = rows.filter(F.length("gt") > 0).withColumns({"_named": named, "_any": any_, "_n": F.length("gt")})
    return both.groupBy(*keys).agg(
        ratio(F.sum("_named"), F.sum("_n")).alias("named_cer"),
        ratio(F.sum("_any"), F.sum("_n")).alias("content_cer"),
        ratio(F.sum(F.col("_named") - F.col("_any")), F.sum("_n")).alias("assignment_loss"),
        ratio(F.count_if(F.col("_named") <= F.col("_n") * F.lit(0.5)), F.count(F.lit(1))).alias("placed"),
    )


def page_score(gt: Column, pred: Column) -> dict[str, Column]:
    """Character and word error, lengths and length ratio of one page."""
    from verso.functions.distance import word_edits
    from verso.functions.text import tokens

    n, m, words = F.length(gt), F.length(pred), F.size(tokens(gt))
    one = F.lit(1)
    return {
        "cer": F.bround(edit_count(gt, pred) / F.greatest(n, one), 4),
        "wer": F.bround(word_edits(gt, pred) / F.greatest(words, one), 4),
        "gt_chars": n,
        "pred_chars": m,
        "gt_words": words,
        "len_ratio": F.bround(m / F.greatest(n, one), 3),
    }


def reliability(rows: DataFrame, *keys: str, run: int = 20, loop: int = 60) -> DataFrame:
    """Usable rate and degenerate output: rows whose longest run of one character or final loop is long.

    `rows` has the keys, `usable`, `run` and `loop`.
    """
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        ratio(F.count_if("usable"), F.count(F.lit(1))).alias("usable_rate"),
        F.count_if(F.col("run") >= run).alias("degenerate_runs"),
        F.count_if((F.col("run") < run) & (F.col("loop") >= loop)).alias("phrase_loops"),
    )


def page_means(pages: DataFrame, *keys: str) -> DataFrame:
    """Mean word and character error over pages, and their unsupported lines in all.

    `pages` has the keys, wer, cer and junk, one row per page; a page counts once, whatever its length.
    """
    return pages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"), F.bround(F.avg("wer"), 6).alias("wer"), F.bround(F.avg("cer"), 6).alias("cer"), F.sum("junk").cast("long").alias("junk")
    )
