"""Visual order of mixed-direction lines by the Unicode bidirectional rules (UAX #9, with isolates and paired brackets)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

ZWNJ = "‌"
#: Deepest embedding and longest list of open brackets; fixed by the rules.
DEEPEST, OPEN_BRACKETS = 125, 63
#: Classes that are left out of a displayed line (rule X9).
REMOVED = {"LRE", "RLE", "LRO", "RLO", "PDF", "BN"}
ISOLATES = {"LRI", "RLI", "FSI"}
NEUTRAL = {"B", "S", "WS", "ON", "PDI", *ISOLATES}
#: Words of character names that are exchanged in the mirror image; fixed values.
SIDES = (("LEFT", "RIGHT"), ("LESS-THAN", "GREATER-THAN"))
#: Brackets whose names don't say the side, opening and closing; fixed values.
NAMELESS = {"༺": "༻", "༼": "༽", "᚛": "᚜"}


@lru_cache(maxsize=None)
def mirror(char: str) -> str:
    """The character's mirror image, by its name; itself if it has none."""
    if not unicodedata.mirrored(char):
        return char
    pairs = NAMELESS | {b: a for a, b in NAMELESS.items()}
    if char in pairs:
        return pairs[char]
    name = unicodedata.name(char, "")
    for a, b in SIDES:
        if len(set(re.findall(rf"\b(?:{a}|{b})\b", name))) == 1:
            try:
                return unicodedata.lookup(re.sub(rf"\b(?:{a}|{b})\b", lambda m, a=a, b=b: b if m[0] == a else a, name))
            except KeyError:
                return char
    return char


@lru_cache(maxsize=None)
def bracket(char: str) -> tuple[str, str] | None:
    """('open' or 'close', the canonical form of the opening bracket) of a paired bracket."""
    kind = {"Ps": "open", "Pe": "close"}.get(unicodedata.category(char))
    if not kind or not unicodedata.mirrored(char) or unicodedata.bidirectional(char) != "ON" or mirror(char) == char:
        return None
    return kind, unicodedata.normalize("NFD", char if kind == "open" else mirror(char))


@lru_cache(maxsize=None)
def bidi_class(char: str) -> str:
    """The class of a character; the non-joiner counts as an Arabic letter, so that it stays where it stands."""
    return "AL" if char == ZWNJ else unicodedata.bidirectional(char) or "L"


def direction(level: int) -> str:
    return "R" if level % 2 else "L"


def _first_strong(classes: list[str], at: int) -> str:
    """Direction of the isolate that begins at `at`, by its first strong character outside inner ones."""
    depth = 0
    for c in classes[at + 1 :]:
        if c in ISOLATES:
            depth += 1
        elif c == "PDI":
            if not depth:
                break
            depth -= 1
        elif not depth and c in ("L", "R", "AL"):
            return "L" if c == "L" else "R"
    return "L"


def explicit_levels(classes: list[str], base: int) -> tuple[list[int], list[str]]:
    """Levels from embeddings, overrides and isolates (X1 to X8), and the classes as overrides leave them."""
    levels, out = [], list(classes)
    stack: list[tuple[int, str, bool]] = [(base, "", False)]  # level, override, isolate
    too_deep_isolates = too_deep = isolates = 0
    for i, c in enumerate(classes):
        level, override, _ = stack[-1]
        if c in ("RLE", "LRE", "RLO", "LRO", *ISOLATES):
            isolate = c in ISOLATES
            right = c[0] == "R" or c == "FSI" and _first_strong(classes, i) == "R"
            levels.append(level)
            if isolate and override:
                out[i] = override
            inner = level + 1 + (level % 2 if right else 1 - level % 2)
            if inner <= DEEPEST and not too_deep_isolates and not too_deep:
                isolates += isolate
                stack.append((inner, {"RLO": "R", "LRO": "L"}.get(c, ""), isolate))
            elif isolate:
                too_deep_isolates += 1
            elif not too_deep_isolates:
                too_deep += 1
            continue
        if c == "PDI":
            if too_deep_isolates:
                too_deep_isolates -= 1
            elif isolates:
                too_deep, isolates = 0, isolates - 1
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
            level, override, _ = stack[-1]
        elif c == "PDF":
            if not too_deep_isolates:
                if too_deep:
                    too_deep -= 1
                elif not stack[-1][2] and len(stack) > 1:
                    stack.pop()
        if override and c not in REMOVED and c != "B":
            out[i] = override
        levels.append(base if c == "B" else level)
    return levels, out


def _sequences(levels: list[int], classes: list[str]) -> list[list[int]]:
    """Isolating run sequences: runs of one level, joined over the isolates inside them (BD13)."""
    kept = [i for i, c in enumerate(classes) if c not in REMOVED]
    closing, openers = {}, []
    for i in kept:
        if classes[i] in ISOLATES:
            openers.append(i)
        elif classes[i] == "PDI" and openers:
            closing[openers.pop()] = i
    runs: list[list[int]] = []
    for i in kept:
        if runs and levels[runs[-1][-1]] == levels[i]:
            runs[-1].append(i)
        else:
            runs.append([i])
    starts = {run[0]: run for run in runs}
    inner = set(closing.values())
    found = []
    for run in runs:
        if run[0] in inner:
            continue
        whole = list(run)
        while whole[-1] in closing and closing[whole[-1]] in starts:
            whole += starts[closing[whole[-1]]]
        found.append(whole)
    return found


def weak(types: list[str], before: str) -> list[str]:
    """Rules W1 to W7 on the classes of one sequence; `before` is the direction at its start."""
    out, last, strong = [], before, before
    for c in types:  # W1 to W3
        if c == "NSM":
            c = "ON" if last in (*ISOLATES, "PDI") else last
        last = c
        if c in ("L", "R", "AL"):
            strong = c
        out.append("AN" if c == "EN" and strong == "AL" else c)
    out = ["R" if c == "AL" else c for c in out]
    for i in range(1, len(out) - 1):  # W4
        if out[i] in ("ES", "CS") and out[i - 1] == out[i + 1] and (out[i - 1] == "EN" or out[i - 1] == "AN" and out[i] == "CS"):
            out[i] = out[i - 1]
    i = 0
    while i < len(out):  # W5
        end = i
        while end < len(out) and out[end] == "ET":
            end += 1
        if end > i and ("EN" in (out[i - 1] if i else "", out[end] if end < len(out) else "")):
            out[i:end] = ["EN"] * (end - i)
        i = end + 1
    strong = before
    for i, c in enumerate(out):  # W6 and W7
        if c in ("ET", "ES", "CS"):
            out[i] = "ON"
        elif c in ("L", "R"):
            strong = c
        elif c == "EN" and strong == "L":
            out[i] = "L"
    return out


def _strong(c: str) -> str:
    return "R" if c in ("R", "EN", "AN") else c if c == "L" else ""


def brackets(chars: list[str], types: list[str], given: list[str], around: str, before: str) -> None:
    """Rule N0: a pair takes the direction of what it holds; `given` are the classes before W1."""
    stack, pairs = [], []
    for i, char in enumerate(chars):
        found = bracket(char) if types[i] == "ON" else None
        if not found:
            continue
        if found[0] == "open":
            if len(stack) == OPEN_BRACKETS:
                break
            stack.append((found[1], i))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == found[1]:
                    pairs.append((stack[k][1], i))
                    del stack[k:]
                    break
    for a, b in sorted(pairs):
        held = {_strong(c) for c in types[a + 1 : b]} - {""}
        if around in held:
            to = around
        elif held:
            context = next((s for s in map(_strong, reversed(types[:a])) if s), before)
            to = context if context != around else around
        else:
            continue
        for i in (a, b):
            types[i] = to
            for j in range(i + 1, len(types)):
                if given[j] != "NSM":
                    break
                types[j] = to


def neutral(types: list[str], around: str, before: str, after: str) -> list[str]:
    """Rules N1 and N2: neutrals between two of one direction take it, others that of the embedding."""
    out, i = list(types), 0
    while i < len(out):
        end = i
        while end < len(out) and out[end] in NEUTRAL:
            end += 1
        if end > i:
            left = _strong(out[i - 1]) if i else before
            right = _strong(out[end]) if end < len(out) else after
            out[i:end] = [left if left == right else around] * (end - i)
        i = end + 1
    return out


def levels_of(line: str, base: int) -> list[int | None]:
    """The resolved level of every character of a line; None for those that are left out."""
    given = [bidi_class(c) for c in line]
    levels, classes = explicit_levels(given, base)
    resolved: list[int | None] = [None if c in REMOVED else v for c, v in zip(given, levels, strict=True)]
    kept = [i for i, c in enumerate(given) if c not in REMOVED]
    place = {i: k for k, i in enumerate(kept)}
    for run in _sequences(levels, given):
        level = levels[run[0]]
        first, last = place[run[0]], place[run[-1]]
        open_end = given[run[-1]] in ISOLATES  # an isolate without its end reaches to the line's
        before = direction(max(level, levels[kept[first - 1]] if first else base))
        after = direction(max(level, base if open_end or last + 1 == len(kept) else levels[kept[last + 1]]))
        types = [classes[i] for i in run]
        out = weak(types, before)
        brackets([line[i] for i in run], out, types, direction(level), before)
        out = neutral(out, direction(level), before, after)
        for i, c in zip(run, out, strict=True):
            resolved[i] = level + (c != "R" if level % 2 else {"L": 0, "R": 1}.get(c, 2))  # I1 and I2
    # L1: separators, and blanks before them and at the end, stand at the line's own level.
    trailing = True
    for i in range(len(line) - 1, -1, -1):
        if given[i] in ("B", "S"):
            resolved[i], trailing = base, True
        elif given[i] in ("WS", "PDI", *ISOLATES):
            resolved[i] = base if trailing else resolved[i]
        elif given[i] not in REMOVED:
            trailing = False
    return resolved


def reordered(line: str, base: int = 1) -> str:
    """One line in the order in which it is read from left to right, mirrored where it runs right to left (L2, L4)."""
    shown = [(v, c) for v, c in zip(levels_of(line, base), line, strict=True) if v is not None]
    if not shown:
        return ""
    odd = [v for v, _ in shown if v % 2]
    for level in range(max(v for v, _ in shown), min(odd, default=1) - 1, -1):
        i = 0
        while i < len(shown):
            end = i
            while end < len(shown) and shown[end][0] >= level:
                end += 1
            shown[i:end] = shown[i:end][::-1]
            i = end + 1
    return "".join(mirror(c) if v % 2 else c for v, c in shown)


@pandas_udf(StringType())
def _visual(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "\n".join(reordered(line) for line in t.split("\n")))


def visual_order(text: Column) -> Column:
    """Every line of a text as it stands on a right-to-left page, from left to right; null stays null.

    Numbers, addresses and other left-to-right runs stay forwards. Direction marks that embed and other
    invisible ones go; the non-joiner stays, as it carries meaning.
    """
    return _visual(text)


def box_lines(text: Column, width: Column, height: Column) -> Column:
    """Entries of a line-box file: one per character in visual order, all with the line's edges, and an end mark."""
    edges = F.concat(F.lit(" 0 0 "), width.cast("string"), F.lit(" "), height.cast("string"), F.lit(" 0"))
    chars = F.filter(F.split(visual_order(text), ""), lambda c: (c != "\n") & (c != ""))
    return F.transform(F.concat(chars, F.array(F.lit("\t"))), lambda c: F.concat(c, edges))
