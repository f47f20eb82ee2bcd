import zlib
from collections import Counter, defaultdict
from hashlib import sha256

from tests.llm.fixtures import empty, rows, table
from verso.llm import merkle


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree(nodes, arity=3):
    """The root, and of each node the siblings before and after it, level by level."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, o in enumerate(own):
            low = o // arity * arity
            paths[i].append(("".join(nodes[low:o]), "".join(nodes[o + 1 : low + arity])))
            own[i] = o // arity
        nodes = [digest("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def brute(data, arity=3):
    groups = defaultdict(list)
    for r in data:
        groups[r[3]].append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append(tree([leaf(r, r[1]) for r in groups[k]], arity))
    root, tops = tree([t[0] for t in trees], arity)
    for k, (subroot, paths), top in zip(keys, trees, tops, strict=True):
        for r, path in zip(groups[k], paths, strict=True):
            yield r, subroot, root, path + top


def expected(data):
    for r, subroot, root, path in brute(data):
        own = leaf(r, r[1])
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
        node = leaf(r, r[1].replace("\n", "") if hit else r[1])
        for before, after in path:
            node = digest(before + node + after)
        yield r[0], own, subroot, root, digest("".join(b + a for b, a in path)), node, node == root


def test_proofs_equal_brute_force(spark):
    found = Counter(tuple(r) for r in merkle.tamper_check(table(spark)).collect())
    want = Counter(expected(rows()))
    assert found == want
    assert {r[-1] for r in want} == {True, False}


def test_one_source_and_one_row(spark):
    for data in ([r for r in rows() if r[3] == "s1"], [(7, "a\nb", None, None, 3)], [(1, "x", "en", None, 1), (2, "\n", "en", "", 1)]):
        assert Counter(tuple(r) for r in merkle.tamper_check(table(spark, data)).collect()) == Counter(expected(data))
    assert merkle.tamper_check(empty(spark)).count() == 0


def test_other_arity_and_group(spark):
    got = merkle.manifest(table(spark), group_col="lang", carry=("doc_id", "fp"), arity=5).collect()
    data = [(r[0], r[1], r[2], r[2], r[4]) for r in rows()]
    want = Counter((r[0], subroot, len(path)) for r, subroot, _, path in brute([(*r[:2], s[3], r[2], r[4]) for r, s in zip(data, rows(), strict=True)], 5))
    assert len({r["root"] for r in got}) == 1 and {r["fp"] for r in got} == {"f"}
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows())
    assert Counter(len(r["path"]) for r in got) == Counter(k[2] for k in want.elements())


def test_very_long_text(spark):
    data = [(i, ("long line\n" * 200_000) + str(i), "en", "s1", 1) for i in range(4)]
    assert Counter(tuple(r) for r in merkle.tamper_check(table(spark, data)).collect()) == Counter(expected(data))


def test_hot_group_is_dealt_over_tasks(spark):
    placed = merkle._placed(spark.range(5000).selectExpr("'.a' as g", "id as o", "unhex('00') as node"))
    assert sorted((r["o"], r["pos"], r["n"]) for r in placed.collect()) == [(i, i, 5000) for i in range(5000)]
