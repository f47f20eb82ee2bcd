"""SimHash near-duplicates through vantage-point trees.

Of two fingerprints within `radius` bits, one of the two halves (32 bits each) differs in at most
radius // 2 bits. Each half has a vantage-point tree over its Hamming distance, grown on a bounded
sample of the fingerprints: a node cuts at the median distance to its vantage point. By the triangle
bound a partner of a point stands at most radius // 2 bits nearer to or farther from the vantage point, so points
just beyond the cut are sent down both sides and no pair is lost; all other branches are pruned. The
leaves are the shards: they hold every point of their region and of its boundary, and find their pairs
on all 64 bits with a deeper tree of the same kind.

Shards return links that span their groups, never all pairs of a dense one. Texts with one fingerprint
are one class. The sample only shapes the tree; whatever it is, the links are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.llm.common import as_given, numbered, staged
from verso.llm.components import connected_components

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
FOLD = bytes.maketrans(UPPER, LOWER)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the lower-cased word shingles; 0 without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not found:
        return 0
    if len(found) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(found), seed)], dtype=np.uint64)
    else:
        joined = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1)
        starts = np.concatenate(([0], ends[: -shingle]))
        digest = xxhash.xxh64_intdigest
        hashes = np.array(
            [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64
        )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):  # whole texts, in blocks of bounded memory
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        values = np.array([fingerprint(t) for t in pdf.pop("_text")], dtype=np.uint64).view(np.int64)
        yield pdf.assign(fp=values)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp as a signed long."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(_fingerprints, f"_id {kind}, fp long")


def half_distance(points: np.ndarray, vantage: int, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int64)


def _halves(radius: int) -> list[tuple[int, int]]:
    """(mask, radius) of the two searches: a pair within `radius` is within radius // 2 in one half."""
    low = (1 << 32) - 1
    return [(low, radius // 2), (low << 32, radius // 2)]


def _cut(points: np.ndarray, mask: int, radius: int, tries: int = 4) -> tuple[int, int] | None:
    """Vantage point and cut of a node, the best of a few points of its own; None if none prunes a tenth of the points."""
    best, least = None, 0.9 * len(points)
    for vantage in points[np.linspace(0, len(points) - 1, tries).astype(int)].tolist():
        distance = half_distance(points, vantage, mask)
        middle = int(np.median(distance))
        for cut in (middle, middle - 1):
            larger = max(int(np.count_nonzero(distance <= cut + radius)), int(np.count_nonzero(distance > cut)))
            if larger < least:
                best, least = (vantage, cut), larger
    return best


@dataclass
class Tree:
    """Inner nodes as (vantage point, cut, near, far); a negative child is leaf -child - 1."""

    mask: int
    radius: int
    nodes: list[tuple[int, int, int, int]]
    leaves: int


def grow(sample: np.ndarray, mask: int, radius: int, leaf: int) -> Tree:
    """Vantage-point tree whose leaves hold about `leaf` points of the sample."""
    nodes: list[tuple[int, int, int, int]] = []
    leaves = 0

    def node(points: np.ndarray) -> int:
        nonlocal leaves
        found = _cut(points, mask, radius) if len(points) > leaf else None
        if found is None:
            leaves += 1
            return -leaves
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        distance = half_distance(points, found[0], mask)
        near = node(points[distance <= found[1] + radius])
        nodes[at] = (*found, near, node(points[distance > found[1]]))
        return at

    root = node(sample)
    return Tree(mask, radius, nodes if root >= 0 else [], leaves)


def route(tree: Tree, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, indexes of the points that reach it): points within the radius beyond a cut reach both sides."""
    if not tree.nodes:
        yield 0, np.arange(len(points))
        return
    stack = [(0, np.arange(len(points)))]
    while stack:
        at, ids = stack.pop()
        if at < 0:
            yield -at - 1, ids
            continue
        vantage, cut, near, far = tree.nodes[at]
        distance = half_distance(points[ids], vantage, tree.mask)
        for child, side in ((near, distance <= cut + tree.radius), (far, distance > cut)):
            if side.any():
                stack.append((child, ids[side]))


def _spanning(points: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all points within `radius`: a breadth-first walk over the points not yet reached."""
    left, links = np.arange(len(points)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(points[left] ^ points[at]) <= radius
            if near.any():
                reached = left[near]
                links.append((np.full(len(reached), at), reached))
                queue += reached.tolist()
                left = left[~near]
    return links


def _links_of_few(points: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a small leaf: its pairs where they are few, a walk over the points that have any otherwise."""
    close = np.bitwise_count(points[:, None] ^ points) <= radius
    close[np.tril_indices(len(points))] = False
    a, b = np.nonzero(close)
    if len(a) <= 4 * len(points):
        return [(a, b)]
    own = np.unique(np.concatenate((a, b)))
    return [(own[i], own[j]) for i, j in _spanning(points[own], radius)]


def _links_of_leaf(points: np.ndarray, radius: int, leaf: int = 512, mask: int = (1 << 64) - 1, reach: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that connect all points that are within `radius`, and within `reach` under `mask`.

    The deeper tree splits on `mask`; where that prunes nothing more, it goes on over all 64 bits.
    """
    whole = (1 << 64) - 1
    links, stack = [], [(np.arange(len(points)), mask, radius if reach is None else reach)]
    while stack:
        ids, bits, width = stack.pop()
        if len(ids) <= leaf:
            links += [(ids[i], ids[j]) for i, j in _links_of_few(points[ids], radius)]
            continue
        found = _cut(points[ids], bits, width)
        if found is not None:
            distance = half_distance(points[ids], found[0], bits)
            stack += [(ids[distance <= found[1] + width], bits, width), (ids[distance > found[1]], bits, width)]
        elif bits != whole:
            stack.append((ids, whole, radius))
        else:
            links += [(ids[i], ids[j]) for i, j in _spanning(points[ids], radius)]
    return links


def _routed(trees, batch: int = 1 << 16):
    """The shards of every fingerprint: a leaf of each tree, or more where it stands at a boundary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(parts: list[np.ndarray]) -> Iterator[pd.DataFrame]:
            fp = np.concatenate(parts)
            for k, tree in enumerate(trees.value):
                for leaf, ids in route(tree, fp.view(np.uint64)):
                    yield pd.DataFrame({"half": np.full(len(ids), k, np.int32), "leaf": np.full(len(ids), leaf, np.int32), "fp": fp[ids]})

        parts, held = [], 0
        for pdf in batches:
            parts.append(pdf["fp"].to_numpy())
            held += len(pdf)
            if held >= batch:
                yield pd.concat(out(parts), ignore_index=True)
                parts, held = [], 0
        if held:
            yield pd.concat(out(parts), ignore_index=True)

    return run


def _shard_links(radius: int):
    halves = _halves(radius)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf["fp"].to_numpy().view(np.uint64)
        mask, reach = halves[int(pdf["half"].iloc[0])]
        found = _links_of_leaf(points, radius, mask=mask, reach=reach)
        a, b = (np.concatenate([points[x[k]] for x in found]) if found else np.empty(0, np.uint64) for k in (0, 1))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)}).drop_duplicates()

    return run


def near_links(distinct: DataFrame, radius: int = 3, crowded: int = 4096, sample: int = 32_768) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all within `radius` bits.

    The trees are grown on the driver from about `sample` fingerprints (a range of their hash), and
    their leaves hold about `crowded` points as long as the sample can tell; larger leaves are divided
    by a deeper tree inside their task.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    share = min(1.0, sample / max(1, total))
    place = F.pmod(F.xxhash64(F.lit(9), "fp"), F.lit(1 << 30))
    taken = distinct.filter(place < F.lit(int(share * (1 << 30)))).select("fp").toPandas()["fp"].to_numpy(dtype=np.int64)
    shape = np.sort(taken.view(np.uint64))
    leaf = max(4, int(crowded * len(shape) / max(1, total)))
    trees = spark.sparkContext.broadcast([grow(shape, mask, reach, leaf) for mask, reach in _halves(radius)])
    routed = distinct.select("fp").mapInPandas(_routed(trees), "half int, leaf int, fp long")
    return routed.groupBy("half", "leaf").applyInPandas(lambda pdf: _shard_links(radius)(pdf), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for every row of `df`.

    Null and empty texts have fingerprint zero and are linked like any other; component_id is the
    smallest identifier reachable. A null identifier is never the smallest; a component of null
    identifiers alone has a null id. Repeated rows stay repeated; an empty table gives no rows.
    """
    rows = staged(fingerprints(df, id_col, text_col), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("_id").alias("first")), "classes")
    members = connected_components(near_links(classes, radius)).withColumnRenamed("node", "fp")
    named = classes.join(members, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = staged(named.join(least, "component").select("fp", "component_id"), "components")
    out = rows.join(ids, "fp")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """One row of each near-duplicate group of `df` stays: that with the smallest identifier; columns as given.

    Null texts count as empty, and all texts without words are one group with whatever is near to it.
    Null identifiers come last. Rows that repeat an identifier are told apart by their text; of fully
    repeated rows one stays. An empty table gives no rows.
    """
    rows, ident, text = numbered(df, id_col, text_col)
    keyed = rows.withColumn("_key", F.xxhash64(F.col(ident), F.coalesce(F.col(text), F.lit(""))))
    found = near_duplicates(keyed.select("_key", text), "_key", text, radius)
    # Keys stand for rows; the smallest identifier of each component names the key that stays.
    ids = keyed.select("_key", F.col(ident).alias("_own")).join(found.select("_key", "component_id").distinct(), "_key")
    first = ids.groupBy("component_id").agg(F.min_by("_key", F.struct(F.col("_own").isNull(), F.col("_own"), F.col("_key"))).alias("_key"))
    kept = keyed.join(first.select("_key"), "_key", "left_semi").dropDuplicates(["_key"])
    return as_given(kept, df)
