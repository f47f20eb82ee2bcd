import itertools
import random
import re
from collections import defaultdict

from tests.llm.fixtures import empty, rows, table
from verso.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_fill_up_to_the_caps():
    assert M.targets({"a": 10, "b": 10, "c": 10}) == {"a": 5.0, "b": 10.0, "c": 15.0}
    found = M.targets({"a": 100, "b": 1, None: 1})
    assert found["b"] == 3 and found[None] == 3 and found["a"] == 96
    assert M.targets({}) == {} and M.targets({"a": 0}) == {"a": 0.0}


def test_flow_repeats_little_and_serves_overlaps():
    flow = M.min_cost_flow([10, 10, 10], [[0], [0, 1], [1]], [25, 5])
    assert sum(w for f in flow for s, w in f if s == 0) == 25 and sum(w for f in flow for s, w in f if s == 1) == 5
    used = [sum(w for _, w in f) for f in flow]
    assert max(used[0], used[1]) <= 20 and used[2] == 5 and sum(used) == 30
    assert M.min_cost_flow([2], [[0]], [100]) == [[(0, 6)]]


def test_mix_comes_near_its_targets(spark):
    data = [(i, "w " * (1 + i * i % 40), f"l{i % 2}", ["b", "a", None, "a"][i % 4], i) for i in range(400)] + rows(n=20)
    found = M.mix(table(spark, data)).collect()
    assert len(found) == len(data)
    per = defaultdict(lambda: [0, 0, 0.0])
    largest = defaultdict(int)  # whole documents are taken, so half of a source's longest may be missing
    for r in found:
        largest[(r["source_size"], r["target"])] = max(r["size"], largest[(r["source_size"], r["target"])])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        x = per[(r["source_size"], r["target"])]
        x[0] += r["size"]
        x[1] += r["taken"]
        x[2] = r["target"]
    total = sum(len(WORD.findall(r[1] or "")) for r in data)
    assert sum(x[0] for x in per.values()) == total
    for site, (_, taken, target) in per.items():
        assert abs(taken - target) <= max(2, 0.02 * target, largest[site] / 2)
    again = M.mix(table(spark, data).repartition(3)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_copies_are_those_of_the_mix(spark):
    data = [(i, "w " * (1 + i * i % 40), "en", ["b", "a", None, "a"][i % 4], i) for i in range(60)] + rows(n=20)
    data += [(500, "three equal rows of a source", "en", "b", k % 2) for k in range(3)]
    df = table(spark, data)
    want, got = defaultdict(int), defaultdict(int)
    for r in M.mix(df).collect():
        want[(r["doc_id"], r["size"])] += r["copies"]
    for r in M.mixed(df).collect():
        got[(r["doc_id"], len(WORD.findall(r["text"] or "")))] += 1
        assert (r["_key"], r["_copies"], r["_rows"], r["_all"], r["row_key"]) == ("key", "c", "r", "a", "rk")
    assert got == {k: n for k, n in want.items() if n}


def test_sources_without_overlap_need_no_search():
    capacity, members, quota = [10, 4, 7, 3], [[0], [1], [2], [2, 3]], [25, 100, 5, 20]
    assert M.flows_of(capacity, members, quota) == M.min_cost_flow(capacity, members, quota)


def test_edges(spark):
    assert M.mix(empty(spark)).count() == 0 and M.mixed(empty(spark)).count() == 0
    df = table(spark)
    out = M.mixed(df)
    assert out.columns == df.columns
    taken = sum(r["taken"] for r in M.mix(df).collect())
    given = sum(len(WORD.findall(r["text"] or "")) for r in out.collect())
    assert taken == given


def test_flow_is_the_cheapest_of_all(spark):
    """Small overlapping instances against every possible flow: as much as can be sent, then at the least cost."""
    rng = random.Random(11)
    for _ in range(150):
        n, m, repeats = rng.randint(1, 3), rng.randint(1, 3), rng.randint(1, 3)
        capacity = [rng.randint(0, 3) for _ in range(n)]
        members = [sorted(rng.sample(range(m), rng.randint(1, min(2, m)))) for _ in range(n)]
        quota = [rng.randint(0, 5) for _ in range(m)]
        arcs = [(p, s) for p, ms in enumerate(members) for s in ms]

        def cost(sent, capacity=capacity):
            return sum(sum(k // max(1, capacity[p]) for k in range(words)) for p, words in enumerate(sent))

        best = None
        for amounts in itertools.product(*(range(min(quota[s], repeats * capacity[p]) + 1) for p, s in arcs)):
            sent, got = [0] * n, [0] * m
            for (p, s), x in zip(arcs, amounts, strict=True):
                sent[p], got[s] = sent[p] + x, got[s] + x
            if all(a <= repeats * c for a, c in zip(sent, capacity, strict=True)) and all(a <= q for a, q in zip(got, quota, strict=True)):
                best = max(best or (-1, 0), (sum(sent), -cost(sent)))
        flow = M.flows_of(capacity, members, quota, repeats)
        sent = [sum(w for _, w in f) for f in flow]
        got = [sum(w for f in flow for t, w in f if t == s) for s in range(m)]
        assert all(a <= repeats * c for a, c in zip(sent, capacity, strict=True)) and all(a <= q for a, q in zip(got, quota, strict=True))
        assert (sum(sent), -cost(sent)) == best, (capacity, members, quota, repeats)
