import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from verso.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, family string, depth string"


def brute(data):
    own = defaultdict(list)
    for c, turn, role, text in data:
        role, text = role or "", text or ""
        if c is not None:
            order = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, order, role, text))
    turns = {c: [r[3:] for r in sorted(rows)] for c, rows in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        path = tuple(turns.get(base, [])[:h] + turns[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    for k, cs in members.items():
        under = [x for x in members if x[: len(k)] == k]
        blank = " \t\n\x0b\x0c\r"
        size = lambda text: len([w for w in "".join(" " if ch in blank else ch for ch in text).split(" ") if w])
        saved = sum((len(members[x]) - 1) * size(x[-1][1]) for x in under if x)
        digest = sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest() if k in ends else sha256(b"").hexdigest()
        yield min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), children[k], sum(not children[x] for x in under), saved, digest


def conversations(seed=2, n=120):
    rng = random.Random(seed)
    out = []
    for c in [*rng.sample(range(0, 300), n), *range(-25, -5, 3), 4_000_000_000_000]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9])):
            out.append((c, turn, rng.choice(["user", "assistant"]) if turn > 1 else "user", rng.choice(["a b", "a b", "c", "d e  f\n"])))
    out += [(None, 1, "user", "lost"), (7, None, None, None), (7, None, "user", None), (8, None, "user", "x"), out[3], out[3], (9, 5, "r", "tie"), (9, 5, "r", "tie two"), (9, 5, None, "tie")]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "k", "f", "d") for r in data], SCHEMA).repartition(3)


@pytest.mark.parametrize("held", [200_000, 7, 1])
def test_nodes_equal_brute_force(spark, monkeypatch, held):
    """Also where a family's nodes leave early and its conversations go on as chains of their own."""
    data = conversations()
    turns = prefix_trie.turns(frame(spark, data)).orderBy("family", "other", "conv", "turn", "digest").toPandas()
    whole = sum(len(x) for x in prefix_trie._family_nodes(iter([turns])))
    monkeypatch.setattr(prefix_trie, "HELD", held)
    assert (sum(len(x) for x in prefix_trie._family_nodes(iter([turns]))) > whole) == (held < 100)
    # The workers import the module afresh, so the bound is set inside a function that goes to them.
    run = prefix_trie._family_nodes

    def bounded(batches):
        from verso.llm import prefix_trie as module

        module.HELD = held
        yield from run(batches)

    monkeypatch.setattr(prefix_trie, "_family_nodes", bounded)
    assert Counter(tuple(r) for r in prefix_trie.trie(frame(spark, data)).collect()) == Counter(brute(data))


def test_long_and_nested_conversations(spark):
    """Every start of one long conversation as a conversation of its own, and a very long text."""
    long = [(2000 * 20, t, "user", f"turn {t % 7}") for t in range(1500)]
    starts = [(20 * k, t, "user", f"turn {t % 7}") for k in range(1, 40) for t in range(k)]
    data = long + starts + [(3, 0, "user", "word " * 300_000)]
    found = {r["depth"]: r for r in prefix_trie.trie(frame(spark, data)).collect() if r["conv_id"] != 3 or r["depth"] == 0}
    assert len(found) == 1501 and found[1500]["n_leaves"] == 1 and found[0]["n_convs"] == 41
    small = [r for r in starts if r[0] <= 300]
    assert Counter(tuple(r) for r in prefix_trie.trie(frame(spark, small)).collect()) == Counter(brute(small))


def test_turnless_and_empty(spark):
    turnless = next(c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    data = [(turnless, 0, "user", "x")]
    assert [tuple(r) for r in prefix_trie.trie(frame(spark, data)).collect()] == [(turnless, 0, None, 1, 0, 1, 0, sha256(str(turnless).encode()).hexdigest())]
    assert prefix_trie.trie(frame(spark, [])).count() == 0
    assert prefix_trie.trie(frame(spark, [(None, 1, "a", "b")])).count() == 0
