"""Readers of the file formats that corpora and their tools leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines with a known schema; strict reading fails on a bad line, tolerant reading keeps it in _bad."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*fields.fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def salvage(raw: Column, *names: str) -> dict[str, Column]:
    """String fields of a truncated JSON object, as far as they were written; null where absent."""
    out = {}
    for name in names:
        found = F.regexp_extract(raw, rf'"{name}":\s*"((?:[^"\\]|\\.)*)"', 1)
        out[name] = F.when(raw.rlike(rf'"{name}":\s*"'), found)
    return out


def read_line_corpus(spark: SparkSession, glob: str, columns: list[str], limit: int | None = None) -> DataFrame:
    """Parquet shards, only the named columns; nested ones by dots."""
    rows = spark.read.parquet(glob).select(*(F.col(c).alias(c.replace(".", "_")) for c in columns))
    return rows.limit(limit) if limit else rows


def read_word_list(spark: SparkSession, path: str, allowed: str) -> DataFrame:
    """Words of a list, one per line: comments and lines with other characters are skipped, repeats are one."""
    word = F.trim("value")
    return spark.read.text(path).select(word.alias("word")).filter(~F.col("word").startswith("#") & F.col("word").rlike(allowed)).distinct()


def read_transcripts(spark: SparkSession, glob: str, least: int = 12, most: int = 90, whole: int = 8) -> DataFrame:
    """Sentences of transcript files of a bounded length, and whole lines of at least `whole` characters."""
    lines = spark.read.text(glob).select(F.trim("value").alias("text"))
    sentences = lines.select(F.explode(F.transform(F.split("text", "[.؛]"), lambda x: F.trim(x))).alias("text")).filter(F.length("text").between(least, most))
    return sentences.unionByName(lines.filter(F.length("text") >= whole))


def read_word_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Word rows of a recogniser's table: level 5, not blank, confidence 0 or more; boxes as corners."""
    table = spark.read.option("sep", "\t").option("quote", "").option("header", "true").csv(path)
    conf = F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0))
    whole = lambda c: F.col(c).cast("int")
    rows = table.filter((whole("level") == 5) & F.col("text").isNotNull() & (F.trim("text") != "") & (conf >= 0))
    return rows.select(
        whole("page_num").alias("page_num"),
        F.col("block_num").alias("block"),
        F.col("par_num").alias("par"),
        F.col("line_num").alias("line"),
        whole("word_num").alias("pos"),
        "text",
        conf.alias("conf"),
        whole("left").alias("x0"),
        whole("top").alias("y0"),
        (whole("left") + whole("width")).alias("x1"),
        (whole("top") + whole("height")).alias("y1"),
    )


def last_iteration(log: DataFrame) -> DataFrame:
    """The largest iteration a trainer's log names."""
    found = F.regexp_extract(F.col("value"), r"At iteration (\d+)/(\d+)/(\d+)", 2)
    return log.select(found.alias("i")).filter("i <> ''").agg(F.max(F.col("i").cast("long")).alias("iteration"))


def best_checkpoint(names: DataFrame) -> DataFrame:
    """The checkpoint with the smallest error in its name, the latest iteration on ties."""
    pattern = r"_(\d+\.\d+)_(\d+)_(\d+)\.checkpoint$"
    rows = names.select("name", F.regexp_extract("name", pattern, 1).alias("e"), F.regexp_extract("name", pattern, 2).alias("i")).filter("e <> ''")
    rank = F.struct(F.col("e").cast("double"), -F.col("i").cast("long"))
    return rows.agg(F.min_by("name", rank).alias("name")).filter("name is not null")


def file_manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(relpath, filename, bytes, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(
        F.col("path").alias("relpath"),
        F.substring_index("path", "/", -1).alias("filename"),
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def with_truth(files: DataFrame, truth: DataFrame, key: str, floor: int = 200) -> DataFrame:
    """A manifest joined with what is known of its files: `truth` is (key, subject, dpi).

    Adds template_id, the group of files with one subject, and below_floor, whether the resolution is too
    low to read; files that nothing is known of keep nulls.
    """
    joined = files.join(truth.select(key, "subject", "dpi"), key, "left")
    template = F.when(F.col("subject").isNotNull(), F.concat(F.lit("t_"), F.substring(F.sha1("subject"), 1, 8)))
    return joined.withColumns({"template_id": template, "below_floor": F.col("dpi") < floor})


def accepted_upload(content: Column, cap: int) -> Column:
    """413 above the size cap, 400 for an unknown format, else 200."""
    head = F.hex(F.substring(content, 1, 4))
    known = head.startswith("FFD8FF") | (head == "89504E47") | head.isin("49492A00", "4D4D002A") | (head == "25504446")
    return F.when(F.length(content) > cap, 413).when(~known, 400).otherwise(200)


def latest_checkpoint(files: DataFrame) -> DataFrame:
    """The checkpoint that was modified last; `files` is (name, modified)."""
    return files.filter(F.col("name").endswith("checkpoint")).agg(F.max_by("name", F.struct("modified", "name")).alias("name")).filter("name is not null")
