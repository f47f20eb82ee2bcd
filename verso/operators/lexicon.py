"""Dictionary tables, corrections and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verso.functions.distance import deletions, doubled_deletions
from verso.functions.text import fold_groups

#: Affixes that are written apart from their word.
SUFFIXES = (
    "ها", "های", "هایی", "هایم", "هایت", "هایش", "هایمان", "هایتان", "هایشان", "تر", "تری", "ترین",
    "ام", "ات", "اش", "مان", "تان", "شان", "ای", "اند", "ایم", "اید", "گر", "گری", "گان",
)
PREFIXES = ("می", "نمی", "بی", "به")
#: A word of the script, and the confidence from which a reading is left alone.
PERSIAN_WORD = "^[ء-غف-يپچژکگی‌]+$"
SURE = 85.0
ZWNJ = "‌"


def first_per_id(rows: DataFrame, *order: str) -> DataFrame:
    """Insert-or-ignore: the first row of each id stays, one without a place in the order never. Columns of `order` after the first break its ties."""
    place = F.when(F.col(order[0]).isNotNull(), F.struct(*order))
    return rows.groupBy("id").agg(F.min_by(F.struct(*[c for c in rows.columns if c != "id"]), place).alias("_r")).select("id", "_r.*")


def vocabulary(words: DataFrame, col: str = "word_norm") -> DataFrame:
    """Distinct single words of a dictionary column."""
    return words.select(F.explode(F.split(F.col(col), " ")).alias("word")).filter("word <> ''").distinct()


def _unique(candidates: DataFrame, lexicon: DataFrame, name: str) -> DataFrame:
    """The only candidate of each word that the lexicon has."""
    found = candidates.join(lexicon.withColumnRenamed("word", "_c"), "_c", "left_semi").distinct()
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("_n"), F.min("_c").alias(name)).filter("_n = 1").drop("_n")


def moved_marks(words: DataFrame, lexicon: DataFrame, groups: tuple[str, ...], edits: int = 1) -> DataFrame:
    """(word, fix): the only lexicon word with the same skeleton and at most `edits` other letters."""
    keyed = words.withColumn("_s", fold_groups(F.col("word"), groups))
    known = lexicon.select(F.col("word").alias("_c"), fold_groups(F.col("word"), groups).alias("_s"))
    differ = F.size(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))), lambda i: F.substring(F.col("word"), i, F.lit(1)) != F.substring(F.col("_c"), i, F.lit(1)))
    )
    near = keyed.join(known, "_s").filter((F.length("word") == F.length("_c")) & (F.col("word") != F.col("_c")) & (differ <= edits))
    return near.groupBy("word").agg(F.count(F.lit(1)).alias("_n"), F.min("_c").alias("fix")).filter("_n = 1").drop("_n")


def repair(words: DataFrame, lexicon: DataFrame, groups: tuple[str, ...], least: int = 3, mark: str = ZWNJ) -> DataFrame:
    """(word, fixed, rule) of distinct words: kept, moved mark, closed gap or a letter too many.

    Each rule needs one candidate; the order is that of the evidence. Words of the lexicon and words
    shorter than `least` stay.
    """
    known = lexicon.select("word").distinct()
    words = words.select("word").distinct()
    open_ = words.filter(F.length("word") >= least).join(known, "word", "left_anti")
    moved = moved_marks(open_, known, groups).withColumnRenamed("fix", "_moved")
    parts = F.split("word", mark)
    apart = open_.filter(F.contains("word", F.lit(mark)) & ~F.element_at(parts, -1).isin(*SUFFIXES) & ~F.element_at(parts, 1).isin(*PREFIXES))
    closed = _unique(apart.select("word", F.replace(F.col("word"), F.lit(mark), F.lit("")).alias("_c")), known, "_closed")
    fewer = open_.filter(F.length("word") >= least + 1).select("word", F.explode(deletions(F.col("word"))).alias("_c"))
    single = _unique(fewer, known, "_single")
    out = words.join(moved, "word", "left").join(closed, "word", "left").join(single, "word", "left")
    rule = F.when(F.col("_moved").isNotNull(), "moved").when(F.col("_closed").isNotNull(), "closed").when(F.col("_single").isNotNull(), "single").otherwise("kept")
    return out.select("word", F.coalesce("_moved", "_closed", "_single", "word").alias("fixed"), rule.alias("rule"))


def fix_words(words: DataFrame, lexicon: DataFrame, groups: tuple[str, ...], script: str = PERSIAN_WORD, sure: float = SURE, least: int = 3) -> DataFrame:
    """Add fixed and rule to rows of (word, conf, ...): `repair` for the words that may be wrong.

    A word stays as it was read if its confidence is `sure` or more, if it is short, or if it has letters of
    another script; otherwise the rules of `repair` apply.
    """
    doubtful = (F.col("conf") < sure) & (F.length("word") >= least) & F.col("word").rlike(script)
    fixes = repair(words.filter(doubtful).select("word"), lexicon, groups, least).filter("rule <> 'kept'")
    # Words that stay have no key; a hash beside it keeps them from being one task's.
    keyed = words.withColumns({"_open": F.when(doubtful, F.col("word")), "_deal": F.when(doubtful, F.lit(0).cast("long")).otherwise(F.xxhash64(*words.columns))})
    joined = keyed.join(fixes.withColumnRenamed("word", "_open").withColumn("_deal", F.lit(0).cast("long")), ["_open", "_deal"], "left")
    return joined.select(*words.columns, F.coalesce("fixed", "word").alias("fixed"), F.coalesce("rule", F.lit("kept")).alias("rule"))


def edit_one(words: DataFrame, lexicon: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """(word, fix): the lexicon word within one edit (a transposition counts as one).

    Two words are one edit apart only if they share a string with one character removed from either, so
    an equi-join on deletion neighbourhoods finds all; the order is length difference, length, word.
    """
    open_ = words.select("word").distinct().filter(F.length("word").between(least, most)).join(lexicon, "word", "left_anti")

    def keys(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("_k", F.explode(F.concat(F.array("word"), deletions(F.col("word"))))).withColumnRenamed("word", name)

    pairs = keys(open_, "word").join(keys(lexicon, "_c"), "_k").select("word", "_c").distinct()
    a, b, n = F.col("word"), F.col("_c"), F.length("word")
    swapped = F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b,
    )
    near = pairs.filter((F.levenshtein(a, b) <= 1) | ((n == F.length(b)) & swapped))
    rank = F.struct(F.abs(F.length("_c") - n), F.length("_c"), F.col("_c"))
    return near.groupBy("word").agg(F.min_by("_c", rank).alias("fix"))


def doubled_letters(words: DataFrame, lexicon: DataFrame, least: int = 3, unambiguous: bool = True) -> DataFrame:
    """(word, fix): the lexicon word left by removing one of two equal neighbours."""
    open_ = words.select("word").distinct().filter(F.length("word") >= least).join(lexicon, "word", "left_anti")
    found = open_.select("word", F.explode(doubled_deletions(F.col("word"))).alias("_c")).join(lexicon.withColumnRenamed("word", "_c"), "_c", "left_semi")
    out = found.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("_n"), F.min("_c").alias("fix"))
    return (out.filter("_n = 1") if unambiguous else out).drop("_n")


def change_effect(old: Column, new: Column, reference: Column) -> Column:
    """Whether a replacement helps, harms or does neither, by the words of the reference."""
    had, has = F.array_contains(reference, old), F.array_contains(reference, new)
    return F.when(has & ~had, "helpful").when(had & ~has, "harmful").otherwise("neutral")


def top_examples(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")
