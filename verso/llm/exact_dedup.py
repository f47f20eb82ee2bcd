"""Exact duplicates by content sort.

Range partitioning uses splitters that Spark samples. The driver holds the sample, so a splitter is
not the whole text but its first characters, its digest and a salt: equal texts still share one key.
Each partition is sorted externally so that equal texts are adjacent, and the window over them
compares neighbours on the full text. The salt, a function of the identifier, splits a group of copies
that holds a large share of all rows over several partitions; the few leaders of each text's runs
then meet by digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verso.llm.common import without

OUTPUT = ("keep_id", "group_size", "kept", "text_sha256")


#: Rows of one text that go to one sorted run at most, once a text has more rows than the least number of salts.
RUN = 250_000


def _salts(df: DataFrame, salts: int | None) -> int:
    """The number of salts: enough that a text in every row is cut into runs of about `RUN` rows."""
    return salts or min(max(64, df.count() // RUN), 1 << 16)


def _order(id_col: str, keep: str) -> Column:
    return F.desc_nulls_last(id_col) if keep == "largest" else F.asc_nulls_last(id_col)


def _runs(rows: DataFrame, id_col: str, text_col: str, keep: str, normalise, salts: int) -> DataFrame:
    """Rows with their place, best identifier and size within the run of their text and salt, and the text's digest."""
    norm = normalise(F.coalesce(F.col(text_col), F.lit("")))
    # The salt comes last in the splitters, so only runs of one text are cut by it. Keys that cannot be
    # null draw no null filters, which would keep the two uses of the exchange apart.
    keyed = rows.withColumns(
        {
            "_head": F.left(norm, F.lit(32)),
            "_digest": F.xxhash64(norm),
            "_salt": F.coalesce(F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int"), F.lit(0)),
        }
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = keyed.repartitionByRange(parts, "_head", "_digest", "_salt").withColumn("_norm", norm)
    run = Window.partitionBy("_head", "_digest", "_salt", "_norm").orderBy(_order(id_col, keep))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sorted_rows.withColumns(
        {
            "_place": F.row_number().over(run),
            "_best": F.first(id_col).over(whole),
            "_size": F.count(F.lit(1)).over(whole),
            "text_sha256": F.coalesce(F.sha2(F.col("_norm"), 256), F.lit("")),
        }
    ).drop("_norm", "_head", "_digest")


def mark_exact_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise=lambda text: text,
    salts: int | None = None,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """Add keep_id, group_size, kept and text_sha256 to every row.

    Null text counts as empty, so null and empty texts are equal. Of equal texts the row with the
    smallest (or largest) identifier stays; null identifiers come last. Repeated rows with one
    identifier are copies too: exactly one of them is kept. An empty table gives an empty result.
    Input columns named like an output column are replaced. `carry` limits the other columns. `salts` is
    how many runs a text's rows are dealt over, by default from the number of rows.
    """
    rows = without(df, *OUTPUT)
    if carry is not None:
        rows = rows.select(*carry, *(c for c in (id_col, text_col) if c not in carry))
    names = {c: f"c{i}" for i, c in enumerate(rows.columns)}  # no column of any name is in the way
    extra = [F.col(n).alias(c) for c, n in names.items() if carry is None or c in carry or c == id_col]
    pick = F.max if keep == "largest" else F.min
    marked = _runs(rows.toDF(*names.values()), names[id_col], names[text_col], keep, normalise, _salts(df, salts))
    # At most `salts` leaders of a text meet; they go back to the rows of their own salt only.
    leaders = marked.filter("_place = 1").select("text_sha256", "_salt", "_best", "_size")
    one_text = Window.partitionBy("text_sha256")
    leaders = leaders.select(
        "text_sha256", "_salt", pick("_best").over(one_text).alias("keep_id"), F.sum("_size").over(one_text).alias("group_size")
    )
    kept = (F.col("_place") == 1) & F.col("_best").eqNullSafe(F.col("keep_id"))
    # Null identifiers all share one salt, so a group without any identifier keeps one row as well.
    return marked.join(leaders, ["text_sha256", "_salt"]).select(*extra, "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=lambda text: text, salts: int | None = None
) -> DataFrame:
    """The rows of `df` that stay, with its columns, as mark_exact_duplicates keeps them.

    Only the leaders of the runs go on, and of a text's leaders the best one stays.
    """
    names = [f"c{i}" for i in range(len(df.columns))]  # no column of any name is in the way
    rows = df.toDF(*names)
    ident, text = names[df.columns.index(id_col)], names[df.columns.index(text_col)]
    leaders = _runs(rows, ident, text, keep, normalise, _salts(df, salts)).filter("_place = 1")
    best = Window.partitionBy("text_sha256").orderBy(_order(ident, keep))
    kept = leaders.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)))
