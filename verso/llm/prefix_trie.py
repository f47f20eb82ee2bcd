"""Prefix trie over conversations, merged family by family before it is merged as a whole.

A family is the conversations of one base identifier. Its turns, cut to digests and word counts in Spark,
are brought together and sorted, the base conversation first, and read as a stream: each
conversation is rebuilt from the base's first turns and its own, and walked down the family's small trie, which
holds what the family shares once. Only the family's nodes go on to the global merging by node key.

A family's trie is a set of chains: a conversation that leaves the known nodes goes on as a chain of
its own down to its end. A node is owned by one chain of one family, so sums over a subtree are made
inside families, from the ends of the chains up, and added up over families by key.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.llm.common import staged, words

#: Identifiers of a family; a conversation takes fewer than `SHARED` turns of its base.
FAMILY, SHARED = 20, 4
#: Nodes of a family that are held at once; beyond, they go out as they are and the global merging adds them up.
HELD = 200_000
#: Rows of an output batch.
BATCH = 20_000
ROOT = hashlib.sha256(b"").digest()
NOTHING = hashlib.sha256(b"").hexdigest()

NODES = "family long, chain int, depth long, key binary, parent binary, onto int, n_words long, conv long, members long, ends boolean"
SUMS = "key binary, parent_conv long, leaves long, saved long"


def turns(df: DataFrame) -> DataFrame:
    """(family, base, conv, turn, digest, n_words) of every row with a conversation; digests keep texts out of the shuffle."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    conv = F.col("conv_id")
    return df.filter(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("family"),
        (conv % FAMILY != 0).alias("other"),
        conv.alias("conv"),
        "turn",
        F.unhex(own).alias("digest"),
        F.size(words(text)).cast("long").alias("n_words"),
    )


def taken(conv: int) -> int:
    """How many turns of its base a conversation begins with."""
    return zlib.crc32(str(conv).encode()) % SHARED


class _Family:
    """The trie of one family while its conversations come in, and the rows that have left it."""

    def __init__(self, family: int, emit) -> None:
        self.family, self.emit = family, emit
        self.base: list[tuple[bytes, int]] = []  # the first turns of the base conversation
        self.found: dict[bytes, list] = {}  # key -> [chain, depth, key, parent, onto, n_words, conv, members]
        self.chain = -1

    def begin(self, conv: int) -> None:
        self.conv, self.h, self.seen = conv, taken(conv), 0
        self.chain += 1
        self.key, self.depth, self.at, self.shared = ROOT, 0, self.chain, True
        self._visit(ROOT, None, 0)
        if conv != self.family:
            for digest, n_words in self.base[: self.h]:
                self._step(digest, n_words)

    def add(self, digest: bytes, n_words: int) -> None:
        """The conversation's next own turn, in order."""
        self.seen += 1
        if self.conv == self.family:
            if self.seen < SHARED:
                self.base.append((digest, n_words))
            self._step(digest, n_words)
        elif self.seen > self.h:
            self._step(digest, n_words)

    def end(self) -> None:
        self.emit((self.family, self.chain, self.depth, self.key, None, None, None, self.conv, 0, True))

    def _step(self, digest: bytes, n_words: int) -> None:
        parent = self.key
        self.key, self.depth = hashlib.sha256(parent + digest).digest(), self.depth + 1
        self._visit(self.key, parent, n_words)

    def _visit(self, key: bytes, parent: bytes | None, n_words: int) -> None:
        node = self.found.get(key) if self.shared else None
        if node:
            node[6], node[7], self.at = min(node[6], self.conv), node[7] + 1, node[0]
            return
        if key in self.found:  # another chain's node that this conversation's own chain has met again
            self._leave(key)
        self.found[key] = [self.chain, self.depth, key, parent, self.at, n_words, self.conv, 1]
        self.at, self.shared = self.chain, False
        if len(self.found) >= HELD:
            self.flush()

    def _leave(self, key: bytes) -> None:
        self.emit((self.family, *self.found.pop(key), False))

    def flush(self) -> None:
        for key in list(self.found):
            self._leave(key)


class _Out:
    """Rows that wait to be a batch."""

    def __init__(self, schema: str) -> None:
        self.names, self.rows = [c.split()[0] for c in schema.split(", ")], []

    def batches(self, least: int) -> Iterator[pd.DataFrame]:
        if self.rows and len(self.rows) >= least:
            whole = {n: pd.Series(v, dtype=object) for n, v in zip(self.names, zip(*self.rows, strict=True), strict=True)}
            self.rows.clear()
            yield pd.DataFrame(whole)


def _family_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """NODES of turns that are sorted by family, base first, conversation and turn."""
    out, family, conv = _Out(NODES), None, None
    for batch in batches:
        for fam, c, digest, n_words in zip(batch["family"], batch["conv"], batch["digest"], batch["n_words"], strict=True):
            if family is None or fam != family.family:
                if family:
                    family.end()
                    family.flush()
                family, conv = _Family(int(fam), out.rows.append), None
            if c != conv:
                if conv is not None:
                    family.end()
                conv = c
                family.begin(int(c))
            family.add(bytes(digest), int(n_words))
            if len(out.rows) >= BATCH:
                yield from out.batches(BATCH)
    if family:
        family.end()
        family.flush()
    yield from out.batches(1)


def _subtree_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SUMS of a family's nodes that are sorted by family, chain and depth, both from the largest down.

    A chain is complete when its least depth has come; its sums then wait for the node of the
    earlier chain that it hangs on, which comes later. What waits is at most one row per conversation of the family.
    """
    out, family, chain = _Out(SUMS), None, None
    waiting: dict[tuple[int, int], list] = {}  # (chain, depth) of the parent -> [first nodes of chains that hang there]
    last = None  # the row before, deeper in the chain: [key, leaves, saved, onto, depth]

    def close() -> None:
        if last is None:
            return
        if last[4] == 0:
            out.rows.append((last[0], None, last[1], last[2]))
        else:
            waiting.setdefault((last[3], last[4] - 1), []).append(last)

    for batch in batches:
        columns = ("family", "chain", "depth", "key", "onto", "conv", "leaf", "saved")
        for fam, ch, depth, key, onto, conv, leaf, saved in zip(*(batch[c] for c in columns), strict=True):
            if fam != family or ch != chain:
                close()
                last = None
                if fam != family:
                    waiting.clear()
                family, chain = fam, ch
            leaves, total = int(leaf), int(saved)
            for below in [*([last] if last else []), *waiting.pop((int(ch), int(depth)), ())]:
                leaves, total = leaves + below[1], total + below[2]
                out.rows.append((below[0], int(conv), below[1], below[2]))
            last = [bytes(key), leaves, total, int(onto), int(depth)]
            if len(out.rows) >= BATCH:
                yield from out.batches(BATCH)
    close()
    yield from out.batches(1)


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, ends_sha256) of rows (key, conv) sorted by both; a node's identifiers are never held together."""
    out, key, state = _Out("key binary, ends_sha256 string"), None, None
    for batch in batches:
        for k, conv in zip(batch["key"], batch["conv"], strict=True):
            k = bytes(k)
            if k != key:
                if key is not None:
                    out.rows.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(str(int(conv)).encode())
            else:
                state.update(f",{int(conv)}".encode())
            if len(out.rows) >= BATCH:
                yield from out.batches(BATCH)
    if key is not None:
        out.rows.append((key, state.hexdigest()))
    yield from out.batches(1)


def family_nodes(df: DataFrame) -> DataFrame:
    """NODES: each family's nodes with what its conversations add to them, and a row `ends` per conversation."""
    own = turns(df).repartition("family").sortWithinPartitions("family", "other", "conv", F.asc_nulls_first("turn"), "digest")
    return own.select("family", "conv", "digest", "n_words").mapInPandas(_family_nodes, NODES)


def trie(df: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations, as the contract of op13 names their columns.

    `df` has conv_id (integers), turn, role and text. Turns are ordered by turn (null first) and among equal
    turns by the digest of role and text; a repeated row is a turn of its own. Null role or text is empty,
    rows with a null conv_id belong to no conversation. Conversation c begins with the first crc32(c) % 4 turns of its
    base, c less the (signed) remainder of c by 20, and goes on with its own turns after as many. A table
    without conversations has no nodes. Other columns are of no effect.
    """
    rows = staged(family_nodes(df.select("conv_id", "turn", "role", "text")), "family_nodes")
    parts = rows.filter("not ends").drop("ends")
    owner = F.min(F.struct("family", "chain"))
    merged = parts.groupBy("key").agg(
        F.min("conv").alias("conv_id"),
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.first("n_words").alias("n_words"),
        F.sum("members").alias("n_convs"),
        owner.alias("owner"),
    )
    merged = staged(merged, "nodes")
    children = merged.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = merged.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = staged(nodes, "nodes")
    about = nodes.select("key", "conv_id", "owner", (F.col("n_children") == 0).alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"))
    # A node counts once, in the chain that owns it; the family's other nodes only hand sums on.
    own = F.struct("family", "chain") == F.col("owner")
    placed = parts.select("family", "chain", "depth", "key", "onto").join(about, "key").select(
        "family",
        "chain",
        "depth",
        "key",
        "onto",
        F.col("conv_id").alias("conv"),
        (own & F.col("leaf")).alias("leaf"),
        F.when(own, F.col("saved")).otherwise(F.lit(0).cast("long")).alias("saved"),
    )
    placed = placed.repartition("family").sortWithinPartitions("family", F.desc("chain"), F.desc("depth"))
    sums = placed.mapInPandas(_subtree_sums, SUMS)
    sums = sums.groupBy("key").agg(F.max("parent_conv").alias("parent_conv_id"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ended = rows.filter("ends").select("key", "conv").repartition("key").sortWithinPartitions("key", "conv")
    ends = ended.mapInPandas(_ends, "key binary, ends_sha256 string")
    found = nodes.join(sums, "key").join(ends, "key", "left")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )
