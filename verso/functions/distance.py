"""Edit distances: whole strings, word lists, substrings."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verso.functions.text import tokens


#: Edit tables of up to so many cells are counted cell by cell; larger ones by bits of whole numbers, a column a step.
CELLS = 8192


def edit_count(a: str, b: str) -> int:
    """Fewest edits between two strings: rows of the edit table are bits of whole numbers, so a column costs a few operations."""
    if len(a) < len(b):
        a, b = b, a
    first, most = 0, len(b)
    while first < most and a[first] == b[first]:
        first += 1
    last = 0
    while last < most - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not b:
        return len(a)
    return _last_row(a, b, 1)


def _marks(text: str) -> dict[str, int]:
    """The places of each character, as bits."""
    at: dict[str, list[int]] = {}
    for i, char in enumerate(text):
        at.setdefault(char, []).append(i)
    marks = {}
    for char, places in at.items():
        bits = bytearray(len(text) // 8 + 1)
        for i in places:
            bits[i >> 3] |= 1 << (i & 7)
        marks[char] = int.from_bytes(bits, "little")
    return marks


def _last_row(rows: str, columns: str, step: int, best: bool = False) -> int:
    """The last (or the least) cost in the last row of the edit table, whose first row grows by `step` a column; see `_columns`."""
    n, marks = len(rows), _marks(rows)
    whole, bit = (1 << n) - 1, n - 1
    up, down, cost = whole, 0, n
    least, find = n, marks.get
    for char in columns:
        equal = find(char, 0)
        same = (((equal & up) + up) ^ up) | equal | down
        right, left = (down | ~(same | up)) & whole, same & up
        cost += (right >> bit) - (left >> bit & 1)
        if cost < least:
            least = cost
        right = (right << 1 | step) & whole
        up, down = ((left << 1) | ~(same | right)) & whole, right & same
    return least if best else cost


@F.pandas_udf(T.IntegerType())
def _long_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_count(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def edits(a: Column, b: Column) -> Column:
    """Fewest edits between two strings; null if one of them is. As `levenshtein`, but not at the cost of every cell where strings are long."""
    small = F.length(a).cast("long") * F.length(b) <= CELLS
    return F.when(small, F.levenshtein(a, b)).otherwise(_long_edits(F.when(~small, a), F.when(~small, b)))


def similarity(a: Column, b: Column, count: Callable[[Column, Column], Column] = F.levenshtein) -> Column:
    """1 - edits / longer length; two empty strings are equal, an empty and another one are not alike.

    `edits` as `count` is for long strings; it can't stand in functions over arrays.
    """
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - count(a, b) / longest)


def cer(ref: Column, hyp: Column) -> Column:
    """Edits per character of the reference; null against an empty one."""
    n = F.length(ref)
    return F.when(n > 0, edits(ref, hyp) / n)


#: Distinct words of a pair that an alphabet can spell: all code points from U+0100 on but the surrogates.
MOST_WORDS = 0x110000 - 0x100 - 0x800


def word_edits(ref: Column, hyp: Column) -> Column:
    """Edit distance of word lists: both are spelled in an alphabet with one character per distinct word.

    The alphabet starts at U+0100; a pair with more than `MOST_WORDS` distinct words, for which Unicode has no room, raises an error.
    """
    left, right = tokens(ref), tokens(hyp)
    vocabulary = F.array_distinct(F.concat(left, right))

    def spell(words: Column, known: Column) -> Column:
        place = lambda w: F.array_position(known, w) + 0xFF
        code = F.transform(words, lambda w: F.lpad(F.hex(F.when(place(w) < 0xD800, place(w)).otherwise(place(w) + 0x800)), 8, "0"))
        return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")

    edits = lambda s: F.when(
        F.size(s["v"]) <= MOST_WORDS, F.levenshtein(spell(s["l"], s["v"]), spell(s["r"], s["v"]))
    ).otherwise(F.raise_error(F.lit("too many distinct words")).cast("int"))
    return F.element_at(F.transform(F.array(F.struct(left.alias("l"), right.alias("r"), vocabulary.alias("v"))), edits), 1)


def _columns(gt: str, pred: str, state: tuple[int, int], marks: dict[str, int]) -> Iterator[tuple[int, int, int]]:
    """Bit vectors of the edit table, one bit per character of `gt` and one column per character of `pred`.

    Each column is (same, up, down): cells that cost as much as the one diagonally before them, one more than the
    one above, and one less than it. `state` is (up, down) of the column before.
    """
    whole = (1 << len(gt)) - 1
    up, down = state
    for char in pred:
        equal = marks.get(char, 0)
        same = (((equal & up) + up) ^ up) | equal | down
        right, left = (down | ~(same | up)) & whole, same & up
        right = (right << 1 | 1) & whole
        up, down = ((left << 1) | ~(same | right)) & whole, right & same & whole
        yield same & whole, up, down


def substitutions(gt: str, pred: str) -> list[tuple[str, str]]:
    """Substituted character pairs of one shortest edit script; from the end, a match or substitution goes before a deletion, and that before an insertion.

    Columns of the edit table are bits of whole numbers. Every so many columns one is kept and the ones behind it are
    made again on the way back, so memory is the length of `gt` in bits times the square root of that of `pred`.
    """
    marks: dict[str, int] = {}
    for i, char in enumerate(gt):
        marks[char] = marks.get(char, 0) | 1 << i
    step = max(1, math.isqrt(len(pred)))
    kept = [((1 << len(gt)) - 1, 0)]
    for j, (_, up, down) in enumerate(_columns(gt, pred, kept[0], marks), 1):
        if j % step == 0:
            kept.append((up, down))
    i, j, out, block, first = len(gt), len(pred), [], [], len(pred) + 1
    while i and j:
        if j <= first:
            first = (j - 1) // step * step
            block = list(_columns(gt, pred[first:j], kept[first // step], marks))
        same, up, _ = block[j - first - 1]
        bit, a, b = 1 << (i - 1), gt[i - 1], pred[j - 1]
        if a == b or not same & bit:
            if a != b:
                out.append((a, b))
            i, j = i - 1, j - 1
        elif up & bit:
            i -= 1
        else:
            j -= 1
    return out


def substring_edits(needle: str, hay: str) -> int:
    """Fewest edits between `needle` and any substring of `hay`."""
    if not needle or not hay:
        return len(needle or "")
    if needle in hay:
        return 0
    return _last_row(needle, hay, 0, best=True)


@F.pandas_udf(T.IntegerType())
def semiglobal(needle: pd.Series, hay: pd.Series) -> pd.Series:
    return pd.Series([substring_edits(n or "", h or "") for n, h in zip(needle, hay, strict=True)], dtype="int32")


#: From this length of the second string on, characters that are more than one in a hundred (and one) begin no block; fixed values.
LONG, COMMON_PART = 200, 100


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def longest_block(a: np.ndarray, b: np.ndarray, rare: np.ndarray) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common block of `rare` places of b, widened by whatever is equal around it.

    Of equally long ones the first in a, then in b, counts.
    """
    size, end_a, end_b = 0, 0, 0
    run = np.zeros(len(b) + 1, dtype=np.int64)  # length of the common block that ends before each place of b
    for i, char in enumerate(a):
        run[1:] = np.where((b == char) & rare, run[:-1] + 1, 0)
        most = int(run.max())
        if most > size:
            size, end_a, end_b = most, i + 1, int(run.argmax())
    start_a, start_b = end_a - size, end_b - size
    while start_a and start_b and a[start_a - 1] == b[start_b - 1]:
        start_a, start_b = start_a - 1, start_b - 1
    while end_a < len(a) and end_b < len(b) and a[end_a] == b[end_b]:
        end_a, end_b = end_a + 1, end_b + 1
    return start_a, start_b, end_a - start_a


#: Characters that the substrings of one length may hold in all; longer common blocks are looked for place by place.
HELD = 1 << 24


def common_block(a: str, b: str) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common block; of equally long ones the first in a, then in b, counts.

    A block of some length is looked for among all substrings of that length; the length is doubled, then halved in.
    """

    def first(size: int) -> int:
        known = {b[j : j + size] for j in range(len(b) - size + 1)}
        return next((i for i in range(len(a) - size + 1) if a[i : i + size] in known), -1)

    most = min(len(a), len(b))
    if most and (a in b or b in a):
        return (0, b.index(a), most) if a in b else (a.index(b), 0, most)
    found, at, over = 0, 0, 1
    while over <= most:
        if over * len(b) > HELD:
            codes = _codes(b)
            return longest_block(_codes(a), codes, np.ones(len(codes), dtype=bool))
        start = first(over)
        if start < 0:
            break
        found, at, over = over, start, over * 2
    over = min(over, most + 1)
    while over - found > 1:
        middle = (found + over) // 2
        start = first(middle)
        found, at, over = (middle, start, over) if start >= 0 else (found, at, middle)
    return at, b.index(a[at : at + found]), found


def matched(a: str, b: str) -> int:
    """Characters in the common blocks of two strings: the longest one, then those to its left and right in turn."""
    left, right = a, b
    if len(b) >= LONG:
        common = {c for c, n in Counter(b).items() if n > len(b) // COMMON_PART + 1}
        # Common characters become signs that no text holds and that differ on both sides, so none begins a block.
        left, right = (t.translate(dict.fromkeys(map(ord, common), sign)) for t, sign in ((a, "\ud800"), (b, "\ud801")))
    total, parts = 0, deque([(0, len(a), 0, len(b))])
    while parts:
        a0, a1, b0, b1 = parts.pop()
        if a0 == a1 or b0 == b1:
            continue
        i, j, size = common_block(left[a0:a1], right[b0:b1])
        i, j = a0 + i, b0 + j
        i1, j1 = i + size, j + size
        while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while i1 < a1 and j1 < b1 and a[i1] == b[j1]:
            i1, j1 = i1 + 1, j1 + 1
        if i1 > i:
            total += i1 - i
            parts += [(a0, i, b0, j), (i1, a1, j1, b1)]
    return total


def block_ratio(a: str, b: str) -> float:
    """Twice the matched characters over all of both strings; two empty ones are equal."""
    return 2 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings; null counts as empty."""
    return pd.Series([block_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def longest_common_substring(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest string that both hold, the first of equals in `a`; null counts as empty."""

    def one(x: str, y: str) -> str:
        at, _, size = common_block(x, y)
        return x[at : at + size]

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b, strict=True)])


def sorted_chars(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, ""), lambda c: c != "")), "")


def run_class(unit: Column, text: Column, least: int = 3) -> Column:
    """How a run of characters came out: exact, reversed, permuted, partial (at least three in a row) or misread."""
    n = F.length(unit)
    windows = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    permuted = F.exists(windows, lambda i: sorted_chars(F.substring(text, i, n)) == sorted_chars(unit))
    parts = F.sequence(F.lit(1), F.greatest(n - least + 1, F.lit(1)))
    partial = F.exists(parts, lambda i: F.contains(text, F.substring(unit, i, F.lit(least))))
    return (
        F.when(F.contains(text, unit), "exact")
        .when(F.contains(text, F.reverse(unit)), "reversed")
        .when((F.length(text) >= n) & permuted, "permuted")
        .when((n >= least) & partial, "partial")
        .otherwise("misread")
    )


def deletions(word: Column) -> Column:
    """The distinct strings left by removing one character."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.when(n > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def doubled_deletions(word: Column) -> Column:
    """The distinct strings left by removing one of two equal neighbours."""
    n = F.length(word)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & (F.substring(word, i, F.lit(1)) == F.substring(word, i + 1, F.lit(1))))
    return F.array_distinct(F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n))))
