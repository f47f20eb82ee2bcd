import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import empty, rows, table
from verso.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(points, radius=3):
    label = list(range(len(points)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, a in enumerate(points):
        for j in range(i):
            if (a ^ points[j]).bit_count() <= radius:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(points))]


def test_fingerprint():
    for r in rows() + [(0, "Ünïcode WORDS Ärger A", None, None, None), (0, "One two", None, None, None)]:
        assert S.fingerprint(r[1]) == slow(r[1])


def test_components_equal_brute_force(spark):
    found = S.near_duplicates(table(spark)).collect()
    assert len(found) == len(rows())
    label = components([int(r["fingerprint"], 16) for r in found])
    least = {}
    for r, k in zip(found, label, strict=True):
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    assert all(r["component_id"] == least.get(k) for r, k in zip(found, label, strict=True))


def test_links_of_dense_and_crowded_neighbourhoods(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    points = {int(c) for c in rng.integers(0, 1 << 63, 400, dtype=np.uint64)}
    for c in centres:
        for _ in range(150):
            p = int(c)
            for b in rng.integers(0, 64, int(rng.integers(0, 7))):
                p ^= 1 << int(b)
            points.add(p)
    points = sorted(points)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in points], "fp long")
    for crowded in (4096, 40):
        links = S.near_links(df, 3, crowded=crowded).collect()
        number = {int(np.uint64(p).view(np.int64)): i for i, p in enumerate(points)}
        label = list(range(len(points)))

        def root(i):
            while label[i] != i:
                i = label[i]
            return i

        for a, b in links:
            x, y = number[a], number[b]
            assert (points[x] ^ points[y]).bit_count() <= 3
            x, y = root(x), root(y)
            label[max(x, y)] = min(x, y)
        assert [root(i) for i in range(len(points))] == components(points)


def test_vantage_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    base = np.uint64(0x0123456789ABCDEF)
    points = np.unique(np.array([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for k in rng.integers(1, 12, 900)], dtype=np.uint64))
    label = list(range(len(points)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in S._links_of_leaf(points, 3, leaf=20):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            x, y = root(i), root(j)
            label[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(points))] == components([int(p) for p in points])


def test_trees_prune_and_keep_every_pair():
    rng = np.random.default_rng(8)
    points = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 6000).astype(np.uint64))
    near = points[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    points = np.unique(np.concatenate((points, near)))
    met = np.zeros((len(points), len(points)), dtype=bool)
    for mask, reach in S._halves(3):
        tree = S.grow(points[::4], mask, reach, leaf=64)
        assert tree.leaves > 10
        for _, ids in S.route(tree, points):
            assert len(ids) < len(points) / 4
            met[np.ix_(ids, ids)] = True
    close = np.bitwise_count(points[:, None] ^ points) <= 3
    assert close.sum() > len(points) + 2000 and met[close].all()


def test_keep_first(spark):
    df = table(spark)
    kept = S.keep_first(df)
    assert kept.columns == df.columns and {r["_key"] for r in kept.collect()} == {"key"}
    groups = S.near_duplicates(df).select(F.coalesce("component_id", F.lit(-1))).distinct().count()
    assert kept.count() == groups
    assert S.near_duplicates(empty(spark)).count() == 0 and S.keep_first(empty(spark)).count() == 0
