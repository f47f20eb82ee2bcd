"""Writers: JSON documents, ledgers, change logs, dictionaries, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_changes(df: DataFrame, path: str) -> None:
    """Tab-separated change log."""
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def write_list(df: DataFrame, path: str) -> None:
    """One line per row, ended by line feeds."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_dictionary(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Dictionary rows clustered by their normalised word, so that lookups read few files."""
    df.withColumn("bucket", F.pmod(F.xxhash64("word_norm"), F.lit(buckets))).repartition(buckets, "bucket").sortWithinPartitions("word_norm").write.mode(
        "overwrite"
    ).partitionBy("bucket").parquet(path)


def write_lexicon(df: DataFrame, name: str, path: str, word: str, buckets: int = 64) -> None:
    """A dictionary as a table of its own, in buckets of its words and sorted inside them.

    Joins on the word then read a bucket where the other side's rows for it are, without moving the dictionary, however
    often it is used. `buckets` should give files of some 100 MB; the other side is dealt over as many partitions.
    """
    spread = df.repartition(buckets, word)
    spread.write.mode("overwrite").bucketBy(buckets, word).sortBy(word).option("path", path).saveAsTable(name)


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report table of a small result; larger ones raise an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
