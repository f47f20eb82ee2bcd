"""Repeated passages of words through an FM-index with a wavelet matrix per shard.

A shard's pieces, as word numbers, form one text; its Burrows-Wheeler transform is held in a wavelet
matrix of packed bits, whose ranks drive backward search. All pieces of the shard are streamed in
step; the state is the first row of the longest match, cut to one window, and each window that is
matched in a group of rows gets the number of places of that group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.llm.matching import Rule, cut_repeats, spell_words, suffix_order


class WaveletMatrix:
    """Ranks of symbols in a sequence, from one packed bit vector per binary digit."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        now = sequence
        for level in range(self.levels):
            bit = (now >> (self.levels - 1 - level)) & 1
            packed = np.packbits(bit.astype(bool), bitorder="little")
            words = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view("<u8")
            self.words.append(words)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        self.start = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            part = (at & 63).astype(np.uint64)
            mask = (np.uint64(1) << part) - np.uint64(1)
            ones = self.before[level][at >> 6] + np.bitwise_count(self.words[level][at >> 6] & mask)
            high = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            at = np.where(high, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self._walk(symbol, at) - self.start[symbol]


class FMIndex:
    """Backward search over word numbers with contexts of one window, and the groups of rows that share one."""

    def __init__(self, text: np.ndarray, sigma: int, context: int, weights: np.ndarray):
        n = len(text)
        padded = np.concatenate((text, np.full(context, sigma - 1, np.int64)))
        rows, new = suffix_order(padded, max(1, int(sigma - 1).bit_length()), n, context)
        self.matrix = WaveletMatrix(padded[rows - 1], sigma)
        count = np.bincount(text, minlength=sigma)
        self.first = np.cumsum(count) - count
        shared = ~new
        shared[:-1] |= ~new[1:]
        at = np.flatnonzero(shared)
        heads = np.flatnonzero(new[at])
        self.group_start = at[heads]
        self.group_end = np.concatenate((at[heads[1:] - 1], at[-1:])) + 1 if len(at) else at
        self.places = np.add.reduceat(weights[rows[at]], heads) if len(at) else np.empty(0, np.int64)

    def step(self, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.matrix.rank(symbol, row)

    def group_of(self, row: np.ndarray) -> np.ndarray:
        """Group of rows that share the window at `row`, -1 where none does."""
        if not len(self.group_start):
            return np.full(len(row), -1)
        j = np.searchsorted(self.group_start, row, side="right") - 1
        return np.where((j >= 0) & (row < self.group_end[j]), j, -1)


def places_of_windows(symbols: bytes, lengths: np.ndarray, weights: np.ndarray, window: int, earlier: bool = False) -> np.ndarray:
    """For every window of every piece, in the order given: the number of its places (weights added up)."""
    m = len(lengths)
    windows = lengths - window + 1
    firsts = np.cumsum(windows) - windows
    packed = np.frombuffer(symbols, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(packed), 8), np.uint8)
    wide[:, :6] = packed
    names, number = np.unique(wide.view("<u8").ravel(), return_inverse=True)
    sigma = len(names) + 1  # the last number closes each piece
    begin = np.cumsum(lengths + 1) - lengths - 1
    of = np.repeat(np.arange(m), lengths)
    text = np.full(int((lengths + 1).sum()), sigma - 1, np.int64)
    text[np.arange(len(number)) + of] = number
    index = FMIndex(text, sigma, window, np.repeat(weights, lengths + 1))
    value = np.repeat(weights, windows)

    longest = np.argsort(-lengths, kind="stable")
    ends, left, target = (begin + lengths)[longest], lengths[longest], firsts[longest]
    row = np.zeros(m, np.int64)
    for t in range(int(lengths.max())):
        active = int(np.searchsorted(-left, -t))
        row = index.step(row[:active], text[ends[:active] - 1 - t])
        if t + 1 >= window:
            group = index.group_of(row)
            found = np.flatnonzero(group >= 0)
            row[found] = index.group_start[group[found]]
            value[target[found] + left[found] - 1 - t] = index.places[group[found]]
    return value


RULE = Rule(window=35, gram=8, unit=6, spell=spell_words, earlier=False, index=places_of_windows)


def remove_repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, **options) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256, n_spans after repeated passages are cut out.

    A word goes if a passage of `window` words over it also starts anywhere else, in the same row or
    another. Words are compared by 48 bits of their hashes, within passages whose other words agree.
    Null counts as a text without words; shorter texts stay whole; repeated rows cut each other; null
    identifiers are like any other, which are of any type with an order; an empty table gives no rows. Other
    columns are not read.
    """
    rule = Rule(window, RULE.gram, RULE.unit, RULE.spell, RULE.earlier, RULE.index)
    out = cut_repeats(df, rule, id_col, text_col, words=True, **options)
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_words"), "n_removed", "kept_sha256", "n_spans")
