"""Best-fit packing from a length histogram.

Documents are tokenised and cut into pieces; best fit decreasing runs over the counts per length, so
its cost depends on the number of lengths and not of documents. The plan says for each length which
ranks stand where; pieces take their slots by joining on rank within length.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verso.llm.common import staged

#: Least and largest number of rows of a block that is ranked in one go.
SMALL_BLOCK, LARGE_BLOCK = 256, 65_536
#: A plan of more rows than this (8 MB) is joined by shuffle instead of being broadcast.
MOST_SLOTS = 200_000
END_OF_TEXT = "<|endoftext|>"


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str, pattern: str):
    """Byte-level BPE from a rank file: the ids of the JSON vocabulary of the same name, several times faster."""
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={END_OF_TEXT: len(ranks)})


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_ids(text: str | None, vocabulary: str, pattern: str) -> np.ndarray:
    """Ids of a whole text; the special token's string has its own id. Null counts as empty."""
    code = encoder(vocabulary, pattern)
    text = text or ""
    found = code.encode(text, allowed_special="all") if END_OF_TEXT in text else code.encode_ordinary(text)
    return np.asarray(found, dtype="<u4")


def _pieces(length: int, end_id: int, vocabulary: str, pattern: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([end_id], dtype="<u4")
        for pdf in batches:
            rows = []
            for row, text in enumerate(pdf["_text"]):
                ids = np.concatenate((token_ids(text, vocabulary, pattern), end))
                first = len(ids) % length or length
                cuts = [0, *range(first, len(ids) + 1, length)]
                rows += [(row, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            out = pd.DataFrame(rows, columns=["row", "piece", "start", "length", "ids_crc32"])
            ids = pdf["_id"].take(out.pop("row")).reset_index(drop=True)
            yield out.assign(_id=ids)[["_id", "piece", "start", "length", "ids_crc32"]]

    return run


def pieces(df: DataFrame, id_col: str, text_col: str, length: int, end_id: int, vocabulary: str, pattern: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(_pieces(length, end_id, vocabulary, pattern), f"_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over counts: [(lengths in a sequence, number of such sequences), ...].

    Equal open sequences are one class with a count. The tightest class that fits takes as many items
    of the length as it can hold; what is left over opens new sequences.
    """
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    done: list[tuple[tuple[int, ...], int]] = []

    def put(room: int, items: tuple[int, ...], n: int) -> None:
        if room == 0:
            done.append((items, n))
        elif n:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append((items, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = size // length
                full, part = divmod(left, each)
                if full:
                    put(size - each * length, (length,) * each, full)
                if part:
                    put(size - part * length, (length,) * part, 1)
                break
            room = rooms[at]
            items, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // length
            full = min(n, left // each)
            if full:
                put(room - each * length, items + (length,) * each, full)
                left -= full * each
            if full < n:
                part = left if left < each else 0
                if part:
                    put(room - part * length, items + (length,) * part, 1)
                    left = 0
                put(room, items, n - full - (1 if part else 0))
    return done + [x for room in rooms for x in open_[room]]


def plan(spark: SparkSession, counts: dict[int, int], size: int) -> DataFrame:
    """(length, low, high, sequence, offset): ranks low <= r < high of a length stand in sequence + r - low at offset."""
    rows, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for items, n in best_fit(counts, size):
        offset = 0
        for length in items:
            rows.append((length, rank[length], rank[length] + n, sequence, offset))
            rank[length] += n
            offset += length
        sequence += n
    found = spark.createDataFrame(rows, "length long, low long, high long, sequence long, offset long")
    return F.broadcast(found) if len(rows) <= MOST_SLOTS else found


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 2048,
    end_id: int = 0,
    vocabulary: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row.

    A row's ids are those of its whole text and `end_id`; null and empty texts are `end_id` alone.
    More than `length` ids are cut into pieces of `length`, the first one shorter if need be.
    Repeated rows are packed as often as they occur, null identifiers like any other; an empty table
    gives no pieces. The driver holds the histogram (at most `length` entries) and the plan made from it.
    """
    spark = df.sparkSession
    if vocabulary is None:
        vocabulary, pattern = default_vocabulary()
    table = staged(pieces(df, id_col, text_col, length, end_id, vocabulary, pattern), "pieces")
    sizes = table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r["length"]: r["n"] for r in sizes}
    slots = plan(spark, counts, length)
    # Ranks within a length, in blocks of like size, so that a common length is dealt over many tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = min(max(sum(counts.values()) // (4 * parts), SMALL_BLOCK), LARGE_BLOCK)
    dealt = spark.createDataFrame([(k, n // each + 1) for k, n in counts.items()], "length long, blocks long")
    block = F.pmod(F.xxhash64("_id", "piece", "start", "ids_crc32"), F.col("blocks"))
    keyed = table.join(F.broadcast(dealt), "length").withColumn("block", block).drop("blocks")
    per_block = staged(keyed.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "histogram")
    before = per_block.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "block").orderBy("_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("place", place).join(before, ["length", "block"]).withColumn("rank", F.col("before") + F.col("place"))
    at = ranked.join(slots, "length").filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return at.select(
        F.col("_id").alias(id_col),
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"),
        "offset",
    )
