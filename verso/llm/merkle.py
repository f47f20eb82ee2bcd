"""Merkle manifest of a table: one tree per group over its ordered rows, and one tree over the groups' roots.

A level is a window over (group, place / arity): the ordered list over the whole frame is the preimage of
the parent and holds the siblings of each node, and the first row of a run stands for the parent in the next
level. Levels shrink by the arity, so all of them together cost half as much again as the leaves. Proofs
come back down the same levels, each node's siblings put before the proof of its parent, so that no leaf
meets more than its own parent and no group is gathered, however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verso.llm.common import staged

ARITY = 3
#: Columns of a leaf, in the order in which they are hashed; fixed by the contract.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of monotonically_increasing_id that number the rows of a partition.
ROW_BITS = 33


def digest(text: Column) -> Column:
    """SHA-256 of a string's UTF-8 bytes as 32 bytes; levels keep digests so, and hash them as hex text."""
    return F.unhex(F.sha2(text, 256))


def hexed(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_hash(columns: tuple[Column, ...]) -> Column:
    """Digest of a row: of each column the UTF-8 byte count, a colon and the value, or `-` for null."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return digest(F.concat(*parts))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows (g, o, node and others) with pos, the place from 0 by (o, node) within g, and n, the rows of g.

    Rows are range partitioned and sorted on the whole key, so that a hot group is dealt over many
    partitions; places inside a partition and counts per partition and group then give the place. The last
    sort column only deals out rows that are equal in all the others, whose order is of no effect.
    """
    keys = ("g", "o", "node", "_tie")
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = staged(ranged.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "ranges")
    table = table.withColumn("_part", F.shiftright("_at", ROW_BITS))
    counts = table.groupBy("g", "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    upto = Window.partitionBy("g").orderBy("_part")
    starts = counts.select("g", "_part", (F.sum("_c").over(upto) - F.col("_c") - F.col("_first")).alias("_shift"), F.sum("_c").over(Window.partitionBy("g")).alias("n"))
    return table.join(starts, ["g", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Add up (the parent's place, -1 for a root), before and after (the siblings' digests) and parent (its digest)."""
    up = F.floor(F.col("pos") / arity)
    run = Window.partitionBy("g", "up").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kin = nodes.withColumn("up", F.when(F.col("n") == 1, F.lit(-1)).otherwise(up)).withColumn("kin", F.collect_list("node").over(run))
    nothing, own = F.lit(b""), F.col("pos") % arity
    at = [F.coalesce(F.get("kin", F.lit(i)), nothing) for i in range(arity)]
    return kin.withColumns(
        {
            "before": F.concat(*(F.when(own > i, a).otherwise(nothing) for i, a in enumerate(at))),
            "after": F.concat(*(F.when(own < i, a).otherwise(nothing) for i, a in enumerate(at))),
            "parent": digest(F.concat(*(hexed(a) for a in at))),
        }
    ).drop("kin")


def _levels(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """Every level as a written table, from the leaves to the level of the tallest group's root."""
    levels = [staged(_with_siblings(leaves, arity), "level")]
    most = levels[0].agg(F.max("n")).first()[0] or 1
    while most > 1:
        most = -(-most // arity)
        runs = levels[-1].filter((F.col("n") > 1) & (F.col("pos") % arity == 0))
        parents = runs.select("g", F.col("up").alias("pos"), F.ceil(F.col("n") / arity).alias("n"), F.col("parent").alias("node"))
        levels.append(staged(_with_siblings(parents, arity), "level"))
    return levels


def _down(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The leaves with path (the siblings level by level) and the columns of `ends`.

    `ends` has, per group, g, level and path from its root on. A node takes the path of its parent; a root that of `ends`.
    """
    given = [c for c in ends.columns if c not in ("g", "level", "path")]
    found = None
    for k in reversed(range(len(levels))):
        roots = ends.filter(F.col("level") == k).select("g", F.lit(-1).cast("long").alias("up"), "path", *given)
        above = roots if found is None else roots.union(found.select("g", F.col("pos").alias("up"), "path", *given))
        step = F.array(F.struct("before", "after"))
        path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(step, "path"))
        found = levels[k].join(above, ["g", "up"]).withColumn("path", path)
    return found.drop("up", "before", "after", "parent", "n")


def _roots(levels: list[DataFrame]) -> DataFrame:
    """(g, level, node) of each group's root."""
    tops = [level.filter(F.col("n") == 1).select("g", F.lit(k).alias("level"), "node") for k, level in enumerate(levels)]
    while len(tops) > 1:
        tops = [a.union(b) for a, b in zip(tops[::2], tops[1::2], strict=False)] + tops[len(tops) & ~1 :]
    return tops[0]


def manifest(
    df: DataFrame,
    columns: tuple[str, ...] = COLUMNS,
    group_col: str = "source",
    order_col: str = "doc_id",
    carry: tuple[str, ...] = ("doc_id",),
    arity: int = ARITY,
) -> DataFrame:
    """The `carry` columns of every row with leaf, subroot, root (lowercase hex) and path.

    A leaf is the digest of `columns`. Each group's leaves, in the order of `order_col` (nulls first) and
    of the digest among equals, form a tree of runs of `arity`; the last run may be shorter, even one. The
    groups' roots, ordered by group (null first, then by UTF-8 bytes), form a tree likewise. A tree of one node is that
    node. path lists, from the leaf to the root, the siblings before and after it as concatenated digests.

    Nulls in any column have their own form in a leaf, so a null text differs from an empty one. Repeated
    rows are leaves of their own. A null group is a group, a null order value comes first. An empty table
    gives an empty manifest. Names of other columns are of no effect.
    """
    group = F.coalesce(F.concat(F.lit("."), df[group_col].cast("string")), F.lit(""))  # null first, and never null in a join
    kept = F.struct(*(df[c].alias(f"c{i}") for i, c in enumerate(carry)))
    rows = df.select(group.alias("g"), df[order_col].alias("o"), leaf_hash(tuple(df[c] for c in columns)).alias("node"), kept.alias("kept"))
    levels = _levels(_placed(rows).drop("o"), arity)
    subroots = staged(_roots(levels), "subroots")
    over = _levels(_placed(subroots.select(F.lit("").alias("g"), F.col("g").alias("o"), "node", "level")).withColumnRenamed("o", "of"), arity)
    top = _roots(over).select("g", "level", F.array().cast("array<struct<before:binary,after:binary>>").alias("path"), F.col("node").alias("root"))
    ends = _down([over[0].withColumnRenamed("level", "height"), *over[1:]], top)
    ends = staged(ends.select(F.col("of").alias("g"), F.col("height").alias("level"), "path", F.col("node").alias("subroot"), "root"), "ends")
    found = _down(levels, ends)
    return found.select(
        *(F.col("kept")[f"c{i}"].alias(c) for i, c in enumerate(carry)),
        hexed(F.col("node")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        "path",
    )


def proof(path: Column) -> Column:
    """The hex digests of a path's siblings, level by level, from left to right."""
    return F.array_join(F.transform(path, lambda p: hexed(F.concat(p["before"], p["after"]))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(hexed(p["before"]), node, hexed(p["after"])), 256))


def verified(proved: DataFrame, leaf: Column) -> DataFrame:
    """`proved`, the result of `manifest`, with folded_root from `leaf` (hex) and verified: whether it is the root."""
    return proved.withColumn("folded_root", folded(leaf, F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def tamper_check(df: DataFrame) -> DataFrame:
    """Every row's proof, checked against a copy of the table whose texts lost their line ends.

    The copy differs in the rows with 2 dividing the unsigned crc32 of the decimal doc_id; a null doc_id is
    not tampered with, and a text that is null or without a line end stays as it was and verifies.
    """
    names = list(COLUMNS)
    altered = F.regexp_replace("text", "\n", "")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = hexed(leaf_hash(tuple(altered if c == "text" else F.col(c) for c in names)))
    rows = df.select(*names, F.when(hit, other).alias("tampered"))
    proved = verified(manifest(rows, carry=("doc_id", "tampered")), F.coalesce("tampered", "leaf"))
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")
