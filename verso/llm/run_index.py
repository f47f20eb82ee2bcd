"""Substring duplicates through a run-length index per shard.

The pieces of a shard, in the order of their smallest documents, form one text. Its Burrows-Wheeler
transform, with contexts of one window and ties in text order, is kept as runs; each run has the text
position of its first row as sample, and runs are also broken where a group of rows shares a whole
window. Pieces are streamed through it backwards, all of a shard in step: the state is the first row
of the longest match, cut to one window, and where a window is matched in a shared group, the sample
at the group's head names the smallest document that holds it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verso.llm.matching import Rule, cut_repeats, spell_bytes, suffix_order

END = 0xFF  # occurs in no UTF-8 text


class RunLengthIndex:
    """Runs of the transform of `pieces`, each closed by END; see the module's docstring."""

    def __init__(self, text: np.ndarray, context: int):
        n = len(text)
        padded = np.concatenate((text, np.full(context, END, np.uint8)))
        rows, new = suffix_order(padded, 8, n, context)
        letters = padded[rows - 1]  # row 0 of the text wraps to END
        shared = ~new
        shared[:-1] |= ~new[1:]
        head = np.concatenate(([True], letters[1:] != letters[:-1]))
        head |= new & shared
        head[1:] |= shared[:-1] & new[1:]
        self.start = np.flatnonzero(head)
        self.letter = letters[self.start].astype(np.int64)
        self.sample = rows[self.start]
        self.size = np.diff(np.concatenate((self.start, [n])))
        first = np.flatnonzero((new & shared)[self.start])
        self.group = np.full(len(self.start), -1)
        if len(first):
            at = np.maximum.accumulate(np.where((new & shared)[self.start], np.arange(len(self.start)), -1))
            self.group = np.where(shared[self.start], at, -1)
        # Runs by letter, each with the row its first symbol leads to; an empty run opens every letter.
        self.rows = n
        count = np.bincount(text, minlength=256)
        base = np.cumsum(count) - count
        order = np.argsort(self.letter, kind="stable")
        sizes, by = self.size[order], self.letter[order]
        before = np.cumsum(sizes) - sizes
        opening = np.searchsorted(by, np.arange(256))
        before = base[by] + before - np.concatenate((before, [0]))[np.minimum(opening, len(before))][by]
        self.key = np.concatenate((np.arange(256) * (n + 2), by * (n + 2) + self.start[order] + 1))
        self.lead = np.concatenate((base, before))
        self.most = np.concatenate((np.zeros(256, np.int64), sizes))
        order = np.argsort(self.key, kind="stable")
        self.key, self.lead, self.most = self.key[order], self.lead[order], self.most[order]

    def step(self, row: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """First row of the match after one more symbol on its left."""
        want = letter * (self.rows + 2) + row + 1
        j = np.searchsorted(self.key, want) - 1
        j += self.key[np.minimum(j + 1, len(self.key) - 1)] == want
        return self.lead[j] + np.minimum(self.most[j], want - self.key[j])

    def run_of(self, row: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, row, side="right") - 1


def smallest_holders(symbols: bytes, lengths: np.ndarray, weights: np.ndarray, window: int, earlier: bool = True) -> np.ndarray:
    """For every window of every piece, in the order given: the smallest document (weight) that holds it."""
    m = len(lengths)
    windows = lengths - window + 1
    firsts = np.cumsum(windows) - windows
    order = np.argsort(weights, kind="stable")
    sizes = lengths[order]
    begin = np.cumsum(sizes + 1) - sizes - 1
    source = (np.cumsum(lengths) - lengths)[order]
    text = np.full(int((sizes + 1).sum()), END, np.uint8)
    of = np.repeat(np.arange(m), sizes)
    step = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[begin[of] + step] = np.frombuffer(symbols, np.uint8)[source[of] + step]
    index = RunLengthIndex(text, window)
    holder = weights[order]
    value = np.repeat(weights, windows)

    longest = np.argsort(-sizes, kind="stable")
    ends, left, target = (begin + sizes)[longest], sizes[longest], firsts[order][longest]
    row = np.zeros(m, np.int64)
    for t in range(int(sizes.max())):
        active = int(np.searchsorted(-left, -t))
        row = index.step(row[:active], text[ends[:active] - 1 - t].astype(np.int64))
        if t + 1 >= window:
            run = index.run_of(row)
            group = index.group[run]
            found = np.flatnonzero(group >= 0)
            heads = group[found]
            row[found] = index.start[heads]
            piece = np.searchsorted(begin, index.sample[heads], side="right") - 1
            value[target[found] + left[found] - 1 - t] = holder[piece]
    return value


RULE = Rule(window=50, gram=16, unit=1, spell=spell_bytes, earlier=True, index=smallest_holders)


def remove_repeated_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, **options) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 after repeated byte strings are cut out.

    A byte goes if a string of `window` bytes over it also starts in a document with a smaller
    identifier. Null counts as empty; texts shorter than the window stay whole; a null identifier is
    larger than any other, and rows with one identifier never cut each other. Repeated rows give
    repeated results; an empty table gives none. Identifiers are of any type with an order. Other columns
    are not read.
    """
    rule = Rule(window, RULE.gram, RULE.unit, RULE.spell, RULE.earlier, RULE.index)
    out = cut_repeats(df, rule, id_col, text_col, words=False, **options)
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
