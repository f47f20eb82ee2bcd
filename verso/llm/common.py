"""Shared helpers: staging folders, lambda-bound values, word rules, folds."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.session import shared_folder

#: Characters between words, as a regex class body; fixed by the contracts.
BLANK = r"\x20\x09-\x0D"


#: Paths of the tables staged inside each `scratch` block that is open.
_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Staged tables written inside the block go at its end, but for those taken off the list that it gives."""
    paths: list[str] = []
    _SCRATCH.append(paths)
    try:
        yield paths
    finally:
        _SCRATCH.pop()
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table in whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    return staged_at(df, name)[0]


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`staged`, and the table's path."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/verso/{uuid.uuid4().hex}/{name}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+`; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), "")


def fold(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo 4; fold 2 is held out. A null identifier is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names an operator is about to write, whatever their case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def numbered(df: DataFrame, *wanted: str) -> tuple:
    """`df` with its columns named by number, so that none is in an operator's way, and the new names of `wanted`."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), *(names[df.columns.index(c)] for c in wanted)


def as_given(rows: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of `df` out of rows of `numbered`, by their old names."""
    return rows.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
