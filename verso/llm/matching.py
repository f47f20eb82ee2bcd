"""Long matches between documents: anchors, super-windows and the Spark jobs around a shard index.

A window is `window` consecutive symbols (bytes or words) of one document. Its anchor is the leftmost
smallest hash among its k-symbol grams, so equal windows have equal anchors. Consecutive windows with
one anchor form a super-window (piece), and all places of a window meet in the shard of its anchor.

    documents, hashed into blocks -> anchors of each block -> anchors that occur again (hits)
    blocks + hits -> distinct pieces with their places -> shards, each of which builds an index over
    its pieces and streams them through it -> spans -> blocks again, where they are cut out

The blocks' exchange serves all three passes. Everything that travels is packed per block and shard,
so a passage shared by very many documents costs each block one piece; anchors with more than `crowd`
places are dealt out by the hash of each single window instead.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.operators.statistics import numbered

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
LAST_ID = np.iinfo(np.int64).max
#: Ties whose numbers have room beside 40 bits of symbols.
MOST_TIES = 1 << 24
#: Types of identifiers that are compared as they are.
WHOLE = ("tinyint", "smallint", "int", "bigint")


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * A
    return (h ^ (h >> np.uint64(29))) * B


# ---- symbols -----------------------------------------------------------------------------------


def spell_bytes(part: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Symbols, lengths and the hash of the 16 bytes at each place."""
    lens = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
    symbols = b"".join(part)
    buffer = symbols + bytes(16)
    eight = np.ndarray(shape=(len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))
    n = len(symbols)
    return symbols, lens, mix(eight[:n] * A ^ (eight[8 : 8 + n] * B + C))


BLANKS = np.zeros(256, dtype=bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True
SPELL = np.random.default_rng(7).integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(A), -1, 1 << 64))
    one = np.ones(1, dtype=np.uint64)
    up = np.multiply.accumulate(np.concatenate((one, np.full(size, A, dtype=np.uint64))))
    down = np.multiply.accumulate(np.concatenate((one, np.full(size, inverse, dtype=np.uint64))))
    return up, down


def word_hashes(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, from prefix sums over the bytes, and the number of words of each text."""
    buffer = np.frombuffer(b"\n".join([*part, b""]), dtype=np.uint8)
    size = 1 << max(16, int(len(buffer)).bit_length())
    up, down = _powers(size)
    blank = BLANKS[buffer]
    word = ~blank
    starts = np.flatnonzero(word & np.concatenate(([True], blank[:-1])))
    ends = np.flatnonzero(word & np.concatenate((blank[1:], [True]))) + 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(SPELL[buffer] * up[: len(buffer)], dtype=np.uint64)))
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    lens = np.fromiter(map(len, part), dtype=np.int64, count=len(part)) + 1
    return hashes, np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(lens)))))


def spell_words(part: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """48 bits of each word's hash, numbers of words and the hash of the 8 words at each place."""
    words, lens = word_hashes(part)
    n = len(words)
    gram = np.concatenate((words, np.zeros(8, np.uint64)))
    for step in (1, 2, 4):
        gram = mix(gram[:-step] * A + gram[step:] * C)
    symbols = np.ascontiguousarray(words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()
    return symbols, lens, gram[:n]


@dataclass(frozen=True)
class Rule:
    """What a window is, when it goes, and the index that finds out."""

    window: int
    gram: int
    unit: int  # bytes per symbol
    spell: Callable
    earlier: bool  # True: a smaller document must hold it too; False: it must occur anywhere else
    index: Callable  # (symbols of distinct pieces, lengths, weights, window, earlier) -> value of each window


def chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def super_windows(gram: np.ndarray, lens: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(document, place in it, symbols, anchor hash, place of the anchor) of every super-window."""
    n, w = len(gram), window - k + 1
    empty = np.empty(0, np.int64)
    if n < window:
        return empty, empty, empty, empty.astype(np.uint64), empty
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    least, span = key, 1
    while span * 2 <= w:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < w:
        least = np.minimum(least[: n - w + 1], least[w - span : w - span + n - w + 1])
    # Windows end inside their text: the last places of every text start none.
    ends = np.cumsum(lens)
    holds = np.zeros(len(least) + 1, dtype=np.int8)
    long = lens >= window
    np.add.at(holds, (ends - lens)[long], 1)
    np.add.at(holds, (ends - window + 1)[long], -1)
    valid = np.cumsum(holds[:-1], dtype=np.int8).view(bool)
    breaks = ~valid
    breaks[0] = True
    breaks[1:] |= ~valid[:-1] | (least[1:] != least[:-1])
    at = np.flatnonzero(breaks)
    windows = np.diff(np.concatenate((at, [len(least)])))
    kept = valid[at]
    start, windows = at[kept], windows[kept]
    if not len(start):
        return empty, empty, empty, empty.astype(np.uint64), empty
    doc = np.searchsorted(ends, start, side="right")
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return doc, start - (ends - lens)[doc], windows + window - 1, gram[anchor], anchor - start


# ---- packing -----------------------------------------------------------------------------------


def pack(*arrays: np.ndarray | bytes) -> bytes:
    parts = [a if isinstance(a, bytes) else a.tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], dtype="<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpack(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, dtype="<u4", count=1)[0])
    sizes = np.frombuffer(raw, dtype="<u4", count=n, offset=4)
    at, out = 4 * (n + 1), []
    for size in sizes.tolist():
        out.append(raw[at : at + size])
        at += size
    return out


def _split(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """The columns' rows of each key."""
    order = np.argsort(keys, kind="stable")
    keys, columns = keys[order], [c[order] for c in columns]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, int)
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(keys)], strict=True):
        yield (int(keys[a]), *(c[a:b] for c in columns))


def _shard(gram: np.ndarray, shards: int) -> np.ndarray:
    return ((gram * C) >> np.uint64(24)) % np.uint64(shards)


def _texts(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes], np.ndarray]:
    """A block's rows by identifier and text, their texts in UTF-8 and their identifiers; null ones come last."""
    pdf = pdf.assign(_text=pdf["_text"].fillna(""))
    pdf = pdf.sort_values(["_id", "_text"], kind="stable", na_position="last").reset_index(drop=True)
    ids = pd.to_numeric(pdf["_id"]).astype("Int64").fillna(LAST_ID).to_numpy(dtype=np.int64)
    return pdf, [t.encode("utf-8", "surrogatepass") for t in pdf["_text"]], ids


def _pieces(rule: Rule, texts: list[bytes]) -> Iterator[tuple]:
    for a, b in chunks(texts):
        symbols, lens, gram = rule.spell(texts[a:b])
        firsts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        yield symbols, a, firsts, *super_windows(gram, lens, rule.window, rule.gram)


# ---- the passes --------------------------------------------------------------------------------


def _anchors(rule: Rule, shards: int):
    """Of a block: each anchor's hash (47 bits), whether it repeats here, and its number of places."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["_block"].iloc[0])
        _, texts, ids = _texts(pdf)
        found, docs = [], []
        for _, a, _, doc, _, _, anchor, _ in _pieces(rule, texts):
            found.append(anchor), docs.append(ids[a + doc])
        gram, doc = np.concatenate(found), np.concatenate(docs)
        order = np.argsort(gram, kind="stable")
        gram, doc = gram[order], doc[order]
        if not len(gram):
            return pd.DataFrame({"shard": [], "_block": [], "data": []})
        new = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        last = np.concatenate((new[1:], [len(gram)])) - 1
        again = doc[new] != doc[last] if rule.earlier else new != last
        places = np.minimum(last - new + 1, 0xFFFF).astype(np.uint64)
        entry = ((gram[new] >> np.uint64(17)) << np.uint64(17)) | (again.astype(np.uint64) << np.uint64(16)) | places
        rows = [(s, block, e.tobytes()) for s, e in _split(_shard(gram[new], shards), entry)]
        return pd.DataFrame(rows, columns=["shard", "_block", "data"])

    return run


def _hits(crowd: int):
    """Of a shard of anchors: for each block, those that occur elsewhere too (the lowest bit: crowded)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(d, dtype=np.uint64) for d in pdf["data"]]
        entry = np.concatenate(parts)
        block = np.repeat(pdf["_block"].to_numpy(), [len(p) for p in parts])
        name = entry >> np.uint64(17)
        order = np.argsort(name, kind="stable")
        name, entry, block = name[order], entry[order], block[order]
        new = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
        sizes = np.diff(np.concatenate((new, [len(name)])))
        again = (sizes > 1) | (np.maximum.reduceat(entry >> np.uint64(16) & np.uint64(1), new) > 0)
        crowded = np.add.reduceat((entry & np.uint64(0xFFFF)).astype(np.int64), new) > crowd
        keep = np.repeat(again, sizes)
        value = (name << np.uint64(1)) | np.repeat(crowded, sizes).astype(np.uint64)
        rows = [(b, v.tobytes()) for b, v in _split(block[keep], value[keep])]
        return pd.DataFrame(rows, columns=["_block", "data"])

    return run


def _places(rule: Rule, shards: int):
    """Of a block: its distinct pieces with a hit anchor, by shard, with weights and places."""

    def run(pdf: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"shard": [], "_block": [], "data": []})
        if not len(pdf) or not len(hits):
            return none
        block = int(pdf["_block"].iloc[0])
        _, texts, ids = _texts(pdf)
        known = np.sort(np.concatenate([np.frombuffer(d, dtype=np.uint64) for d in hits["data"]]))
        names, crowded = known >> np.uint64(1), (known & np.uint64(1)).astype(bool)
        number: dict[bytes, int] = {}
        of, docs, starts, where, offsets = [], [], [], [], []
        for symbols, a, firsts, doc, start, length, anchor, offset in _pieces(rule, texts):
            name = anchor >> np.uint64(17)
            at = np.minimum(np.searchsorted(names, name), len(names) - 1)
            hit = names[at] == name
            doc, start, length, anchor, offset, many = doc[hit], start[hit], length[hit], anchor[hit], offset[hit], crowded[at[hit]]
            shard = _shard(anchor, shards).astype(np.int64)
            if many.any():  # single windows instead of pieces
                each = np.where(many, length - rule.window + 1, 1)
                step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                many, doc, shard, offset = np.repeat(many, each), np.repeat(doc, each), np.repeat(shard, each), np.repeat(offset, each) - step
                start, length = np.repeat(start, each) + step, np.where(many, rule.window, np.repeat(length, each))
            first = (firsts[doc] + start) * rule.unit
            for x, y, s, o, m in zip(first.tolist(), (first + length * rule.unit).tolist(), shard.tolist(), offset.tolist(), many.tolist(), strict=True):
                piece = symbols[x:y]
                i = number.setdefault(piece, len(number))
                if i == len(where):
                    where.append(xxhash.xxh64_intdigest(piece) % shards if m else s)
                    offsets.append(o)
                of.append(i)
            docs.append(doc + a), starts.append(start)
        if not number:
            return none
        of, doc, start = np.array(of), np.concatenate(docs), np.concatenate(starts)
        order = np.argsort(of, kind="stable")
        of, doc, start = of[order], doc[order], start[order]
        new = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        counts = np.diff(np.concatenate((new, [len(of)])))
        weight = np.minimum.reduceat(ids[doc], new) if rule.earlier else counts.astype(np.int64)
        least = np.repeat(weight, counts) == ids[doc] if rule.earlier else np.ones(len(of), bool)
        pieces, offset = list(number), np.array(offsets, dtype=np.uint8)
        rows = []
        for shard, which in _split(np.array(where), np.arange(len(pieces))):
            own = np.concatenate([np.arange(new[i], new[i] + counts[i]) for i in which.tolist()])
            bodies = [pieces[i] for i in which.tolist()]
            lengths = np.fromiter(map(len, bodies), dtype="<u4", count=len(bodies)) // rule.unit
            data = pack(
                lengths.astype("<u4"), offset[which], weight[which], counts[which].astype("<u4"), doc[own].astype("<u4"), start[own].astype("<u4"), least[own], b"".join(bodies)
            )
            rows.append((shard, block, data))
        return pd.DataFrame(rows, columns=["shard", "_block", "data"])

    return run


def _indexed(rule: Rule, pieces: list[bytes], lengths: np.ndarray, total: np.ndarray, anchor: np.ndarray, size: int = 1 << 18) -> np.ndarray:
    """Value of every window of the pieces, from indexes over groups of anchors of about `size` bytes each.

    Pieces with different anchors share no window, so a group is a whole collection of its own, and
    the index of one stays in the processor's cache.
    """
    windows = lengths - rule.window + 1
    firsts = np.cumsum(windows) - windows
    value = np.empty(windows.sum(), np.int64)
    order = np.argsort(anchor, kind="stable")
    last = np.concatenate((anchor[order][1:] != anchor[order][:-1], [True]))
    filled = np.cumsum((lengths[order] + 1) * rule.unit)
    ends, done = [], 0
    for i in np.flatnonzero(last).tolist():
        if filled[i] - done >= size or i == len(order) - 1:
            ends.append(i + 1)
            done = filled[i]
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        which = order[a:b]
        found = rule.index(b"".join([pieces[i] for i in which.tolist()]), lengths[which], total[which], rule.window, rule.earlier)
        n = windows[which]
        value[np.repeat(firsts[which] - np.cumsum(n) + n, n) + np.arange(n.sum())] = found
    return value


def _spans(rule: Rule):
    """Of a shard: an index over its distinct pieces, and for each block the spans that go."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        names: dict[bytes, int] = {}  # anchors
        anchor_of, rows = [], []
        size = rule.gram * rule.unit
        for block, data in zip(pdf["_block"], pdf["data"], strict=True):
            lengths, offsets, weight, counts, doc, start, least, body = unpack(data)
            lengths = np.frombuffer(lengths, "<u4").astype(np.int64)
            ends = (np.cumsum(lengths) * rule.unit).tolist()
            own = []
            for x, y, o in zip([0, *ends[:-1]], ends, offsets, strict=True):
                i = number.setdefault(body[x:y], len(number))
                if i == len(anchor_of):
                    at = x + o * rule.unit
                    anchor_of.append(names.setdefault(body[at : at + size], len(names)))
                own.append(i)
            rows.append((block, np.array(own), lengths, np.frombuffer(weight, np.int64), *(np.frombuffer(x, t) for x, t in ((counts, "<u4"), (doc, "<u4"), (start, "<u4"), (least, bool)))))
        total = np.full(len(number), LAST_ID) if rule.earlier else np.zeros(len(number), np.int64)
        join = np.minimum if rule.earlier else np.add
        for r in rows:
            join.at(total, r[1], r[3])
        lengths = np.fromiter(map(len, number), dtype=np.int64, count=len(number)) // rule.unit
        value = _indexed(rule, list(number), lengths, total, np.array(anchor_of))
        windows = lengths - rule.window + 1
        firsts = np.cumsum(windows) - windows
        out = []
        for block, own, length, weight, counts, doc, start, least in rows:
            n = length - rule.window + 1
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found = value[np.repeat(firsts[own], n) + step]
            gone = found < np.repeat(weight, n) if rule.earlier else found > 1
            # Runs of windows that go, per piece.
            edge = np.concatenate(([False], gone, [False]))
            border = step == 0
            begin = np.flatnonzero(gone & (~edge[:-2] | border))
            stop = np.flatnonzero(gone & (~edge[2:] | np.concatenate((border[1:], [True]))))
            piece = np.repeat(np.arange(len(n)), n)[begin]
            a, size = step[begin], step[stop] - step[begin] + rule.window
            per = np.bincount(piece, minlength=len(n))
            first = np.cumsum(per) - per
            # Places outside the smallest document lose the whole piece, the others its runs.
            of = np.repeat(np.arange(len(n)), counts)
            whole = ~least
            runs = np.where(least, per[of], 0)
            take = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(first[of], runs)
            docs = np.concatenate((doc[whole], np.repeat(doc, runs)))
            at = np.concatenate((start[whole], np.repeat(start, runs) + a[take]))
            sizes = np.concatenate((length[of][whole], size[take]))
            if len(docs):
                out.append((block, pack(docs.astype("<u4"), at.astype("<u4"), sizes.astype("<u4"))))
        return pd.DataFrame(out, columns=["_block", "data"])

    return run


def _cut(rule: Rule, words: bool):
    """Of a block: what is left of each document."""

    def run(pdf: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"_id": [], "n": [], "n_removed": [], "n_spans": [], "kept_sha256": []})
        pdf, texts, _ = _texts(pdf)
        parts = [t.split() for t in texts] if words else texts
        lens = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        firsts = np.cumsum(lens) - lens
        found = [[np.frombuffer(x, "<u4").astype(np.int64) for x in unpack(data)] for data in spans["data"]]
        doc, start, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        at, total = firsts[doc] + start, int(lens.sum()) + 1
        delta = np.bincount(at, minlength=total) - np.bincount(at + size, minlength=total)
        gone = np.cumsum(delta)[:-1] > 0
        rows = []
        for part, first, n in zip(parts, firsts.tolist(), lens.tolist(), strict=True):
            own = gone[first : first + n]
            removed = int(np.count_nonzero(own))
            spans_of = int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])) if removed else 0
            if words:
                kept = b" ".join(compress(part, (~own).tolist()) if removed else part)
            else:
                kept = np.frombuffer(part, np.uint8)[~own].tobytes() if removed else part
            rows.append((n, removed, spans_of, hashlib.sha256(kept).hexdigest()))
        out = pd.DataFrame(rows, columns=["n", "n_removed", "n_spans", "kept_sha256"])
        return out.assign(_id=pdf["_id"])[["_id", "n", "n_removed", "n_spans", "kept_sha256"]]

    return run


def cut_repeats(df: DataFrame, rule: Rule, id_col: str, text_col: str, words: bool, block_mb: float = 4, crowd: int = 100_000) -> DataFrame:
    """(_id, n, n_removed, n_spans, kept_sha256) of every row after its repeated windows are cut out."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = df.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"))).first()[0] or 0
    blocks = max(parts, int(size / (block_mb * 1e6)) + 1)
    shards = max(parts, int(size / (block_mb * 1e6)) + 1)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if kind not in WHOLE:
        # Identifiers of any other type are numbered in their order, and come back at the end.
        order = numbered(rows.filter("_id is not null").select("_id").distinct(), [], "_id").select(F.col("_id").alias("_name"), "_i")
        rows = rows.join(order, F.col("_id") == F.col("_name"), "left").select(F.col("_i").alias("_id"), "_text")
        cut = _cut_rows(rows, "long", rule, words, blocks, shards, crowd)
        return cut.join(order, F.col("_id") == F.col("_i"), "left").select(F.col("_name").alias("_id"), *cut.columns[1:])
    return _cut_rows(rows, kind, rule, words, blocks, shards, crowd)


def _cut_rows(rows: DataFrame, kind: str, rule: Rule, words: bool, blocks: int, shards: int, crowd: int) -> DataFrame:
    """`cut_repeats` of rows (_id, _text) with whole numbers as identifiers."""
    # Rows without an identifier are dealt by their text.
    dealt = F.xxhash64("_id", F.when(F.col("_id").isNull(), F.col("_text")))
    rows = rows.withColumn("_block", F.pmod(dealt, F.lit(blocks)).cast("int"))
    packed = "shard long, _block int, data binary"
    anchors = rows.groupBy("_block").applyInPandas(_anchors(rule, shards), packed)
    hits = anchors.groupBy("shard").applyInPandas(_hits(crowd), "_block int, data binary")
    places = rows.groupBy("_block").cogroup(hits.groupBy("_block")).applyInPandas(_places(rule, shards), packed)
    spans = places.groupBy("shard").applyInPandas(_spans(rule), "_block int, data binary")
    out = f"_id {kind}, n long, n_removed long, n_spans long, kept_sha256 string"
    return rows.groupBy("_block").cogroup(spans.groupBy("_block")).applyInPandas(_cut(rule, words), out)


def suffix_order(symbols: np.ndarray, bits: int, n: int, context: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes 0..n-1 by their first `context` symbols, ties in text order, and the starts of ties.

    `symbols` has `context` more of them than n, each of `bits` bits. The first sort takes as many
    symbols as 64 bits hold; after that only suffixes that are still tied are sorted, by the number of
    their tie and the next symbols in one key, or in two where the text is long.
    """
    symbols = symbols.astype(np.uint64)

    def keys(places: np.ndarray | slice, count: int) -> np.ndarray:
        key = symbols[places]
        for i in range(1, count):
            at = slice(i, i + n) if isinstance(places, slice) else places + i
            key = key << np.uint64(bits) | symbols[at]
        return key

    first, later = min(context, 64 // bits), 40 // bits
    wide = n >= MOST_TIES
    key = keys(slice(0, n), first)
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    at, done = np.arange(n), first
    while True:
        tied = ~new[at]
        tied[:-1] |= tied[1:] & (at[1:] == at[:-1] + 1)
        at = at[tied]
        if not len(at):
            return order, new
        group = np.cumsum(new[at], dtype=np.uint64)
        last = done == context
        count = min(later, context - done)
        key = order[at].astype(np.uint64) if last else keys(order[at] + done, count)
        if wide:
            again = np.lexsort((key, group))
        else:
            key = group << np.uint64(40) | key
            again = np.argsort(key)
        order[at] = order[at][again]
        if last:
            return order, new
        key = key[again]
        new[at[1:]] |= key[1:] != key[:-1]  # ties stay where they are, so a new one is marked already
        done += count
