"""Bidirectional rules: the published examples, planted lines, and what must hold for any line."""

import random

import pytest
from pyspark.sql import functions as F

from verso.functions import bidi

HEBREW = {chr(65 + i): chr(0x5D0 + i) for i in range(26)}
MARKS = {"<": "⁧", ">": "⁦", "=": "⁩"}


def stored(text, marks=True):
    return "".join(HEBREW.get(c, MARKS.get(c, c) if marks else c) for c in text)


def shown(text, base):
    back = {v: k for k, v in HEBREW.items()}
    return "".join(back.get(c, c) for c in bidi.reordered(text, base) if c not in MARKS.values())


@pytest.mark.parametrize(
    ("text", "base", "want"),
    [
        ("car means CAR.", 0, "car means RAC."),
        ("<car MEANS CAR.=", 0, ".RAC SNAEM car"),
        ("he said “<car MEANS CAR=.” “<IT DOES=,” she agreed.", 0, "he said “RAC SNAEM car.” “SEOD TI,” she agreed."),
        ("DID YOU SAY ’>he said “<car MEANS CAR=”=‘?", 1, "?‘he said “RAC SNAEM car”’ YAS UOY DID"),
        ("smith (fabrikam ARABIC) HEBREW", 1, "WERBEH (CIBARA fabrikam) smith"),
        ("ARABIC book(s)", 1, "book(s) CIBARA"),
        ("AB(CD[&ef]!)gh", 1, "gh(![ef&]DC)BA"),
    ],
)
def test_published_examples(text, base, want):
    assert shown(stored(text), base) == want


def test_levels_of_the_published_example():
    line = stored("DID YOU SAY ’>he said “<car MEANS CAR=”=‘?")
    levels = [v for c, v in zip(line, bidi.levels_of(line, 1), strict=True) if c not in MARKS.values()]
    assert "".join(map(str, levels)) == "11111111111112222222224443333333333211111"[: len(levels)]


@pytest.mark.parametrize(
    ("given", "before", "want"),
    [
        ("AL NSM NSM", "R", "R R R"),
        ("NSM", "R", "R"),
        ("LRI NSM", "L", "LRI ON"),
        ("AL EN", "R", "R AN"),
        ("AL ON EN", "R", "R ON AN"),
        ("ON EN", "R", "ON EN"),
        ("L ON EN", "R", "L ON L"),
        ("R ON EN", "R", "R ON EN"),
        ("EN ES EN", "R", "EN EN EN"),
        ("EN CS EN", "R", "EN EN EN"),
        ("AN CS AN", "R", "AN AN AN"),
        ("AN ES AN", "R", "AN ON AN"),
        ("ET ET EN", "R", "EN EN EN"),
        ("EN ET ET", "R", "EN EN EN"),
        ("AN ET EN", "R", "AN EN EN"),
        ("AN ET", "R", "AN ON"),
        ("L ES EN", "R", "L ON L"),
        ("EN CS AN", "R", "EN ON AN"),
    ],
)
def test_weak_rules(given, before, want):
    assert bidi.weak(given.split(), before) == want.split()


def test_mixed_persian_lines():
    assert bidi.reordered("ابج") == "جبا"
    for run in ("info@site.ir", "۱۴۰۲/۱۲/۲۷", "Tel", "12.5", "a-b c"):
        assert run in bidi.reordered(f"ایمیل: {run} پایان")
    joined = "نیازمندی‌های می‌شود"
    assert bidi.reordered(joined) == joined[::-1]
    assert bidi.reordered("(سلام)") == "(مالس)" and bidi.reordered("a‪b‬­ج") == "جab"
    assert bidi.mirror("(") == ")" and bidi.mirror("≤") == "≥" and bidi.mirror("a") == "a" and bidi.mirror("∫") == "∫"
    assert bidi.bracket("[") == ("open", "[") and bidi.bracket("\u232a") == ("close", "\u3008") == bidi.bracket("\u3009") and bidi.bracket("«") is None
    assert bidi.reordered("«سلام»") == "«مالس»"


def test_any_line_keeps_its_characters():
    rng = random.Random(8)
    pool = "abAB12 .,+$%()[]\t" + "אבגא" + "عربی۱۲٣" + "ً́‌‎‏‪‫‬‭‮⁦⁧⁨⁩­"
    for n in [0, 1, 2, 5, 20, 200] * 40:
        line = "".join(rng.choice(pool) for _ in range(n))
        for base in (0, 1):
            kept = [c for c in line if bidi.bidi_class(c) not in bidi.REMOVED]
            out = bidi.reordered(line, base)
            assert sorted(min(c, bidi.mirror(c)) for c in out) == sorted(min(c, bidi.mirror(c)) for c in kept)
    deep = "‫" * 200 + "a" + "‬" * 200 + "ب"
    assert bidi.reordered(deep) == "بa"


def test_columns(spark):
    df = spark.createDataFrame([("سلام 12\nab",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(bidi.visual_order(F.col("t"))).collect()]
    assert got == ["12 مالس\nab", None, ""]
    boxes = df.select(bidi.box_lines(F.col("t"), F.lit(200), F.lit(40))).first()[0]
    assert len(boxes) == 10 and boxes[0] == "1 0 0 200 40 0" and boxes[-1] == "\t 0 0 200 40 0"
