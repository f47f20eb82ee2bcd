import pytest
from pyspark.sql import functions as F

from verso.functions import text as T


def each(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def norm(spark, *values, rules=T.DEFAULT):
    return each(spark, lambda t: T.normalize(t, rules), values)


def test_rules(spark):
    assert norm(spark, "a" + T.BIDI + "b", "أإٱآ", "می‌رود", "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩") == ["ab", "اااآ", "می رود", "0123456789", "0123456789"]
    assert norm(spark, "a,b;c?", "1٫5", "1٬000", "ي ك", "كتـــاب", "مُحَمَّد") == ["a،b؛c؟", "1.5", "1,000", "ی ک", "کتاب", "محمد"]
    assert norm(spark, None, "  a   b  \n\n  c\t", "é") == ["", "a b\nc", "é"]


def test_raw_is_identity_and_default_is_idempotent(spark):
    samples = ["  x,y ", "أ‌؟ \n z", "12٫5", "é ⁧"]
    assert norm(spark, *samples, rules=T.RAW) == samples
    once = norm(spark, *samples)
    assert norm(spark, *once) == once


def test_flags(spark):
    assert norm(spark, "آب", rules=T.Rules(fold_alef_madda=True)) == ["اب"]
    assert norm(spark, "می‌رود", rules=T.Rules(strip_zwnj=False)) == ["می‌رود"]
    assert norm(spark, "ABÉ", rules=T.LATIN) == ["abÉ"]


def test_blank(spark):
    assert each(spark, T.is_blank, [None, "", "  \n", "x"]) == [True, True, True, False]


@pytest.mark.parametrize(
    ("text", "legible"),
    [("", True), ("ff", False), ("ee aa ay", False), ("سلام", True), ("این متن فارسی است که خوانده شد", True), ("This document has several real words", True), ("oe ss at ff oe ss at", False)],
)
def test_legibility(spark, text, legible):
    assert each(spark, lambda t: T.legibility(t)["legible"], [text]) == [legible]


def test_looks_arabic(spark):
    persian = "این یک متن فارسی با پ و چ و ژ و گ است. " * 10
    assert each(spark, T.looks_arabic, ["كَتَبَ الوَلَدُ الدَّرسَ في المَدرَسَةِ اليَومَ وَ ذَهَبَ", persian, "قصير"]) == [True, False, False]


def test_scripts_and_words(spark):
    assert each(spark, T.script_of, [" ", "س", "a", "5", "!", "漢"]) == ["space", "arabic", "latin", "digit", "punct", "other"]
    assert each(spark, T.skeleton, ["پژوهش"]) == ["برؤهس".replace("ؤ", "و")]
    assert each(spark, T.match_key, ["كتـاب‌ي "]) == ["کتابی"]
    assert each(spark, lambda t: T.count_text(t, "aa"), ["aaaa baa"]) == [3]
    assert each(spark, T.clean_label, ["ۀ  a‎"]) == ["ه a"]
    assert each(spark, T.clean_word, ["مُحَمد", "مُحمد"]) == ["محمد", "مُحمد"]


def test_contained(spark):
    df = spark.createDataFrame([("كتاب-ها", "این کتاب، ها است"), ("x", "yz")], "v string, p string")
    assert [r[0] for r in df.select(T.contained(F.col("v"), F.col("p"))).collect()] == [True, False]


def test_shapes_and_script_tokens(spark):
    df = spark.createDataFrame([("سلام",), ("دارا",), ("بی۲ء",), ("x",)], "w string")
    got = [r[0] for r in df.select(T.shape(F.col("w"))).collect()]
    assert got == ["\ufee1\ufe8e\ufee0\ufeb3", "\ufe8d\ufead\ufe8d\ufea9", "\ufe80\ufbff\ufe91", ""]
    t = spark.createDataFrame([("كتاب (کتاب) abc ۱۲ مي‌روم e\u0301",)], "t string").select(F.array_sort(T.token_set(F.col("t")))).first()[0]
    assert t == ["می روم", "کتاب"]


def test_collapse_takes_long_runs_of_blanks(spark):
    import time

    runs = ["a" + " " * 200_000 + "b", "a \t \n\n \n b", " x\u00a0 y \n", "\n\n", "a\r\nb"]
    began = time.time()
    got = [r[0] for r in spark.createDataFrame([(r,) for r in runs], "t string").select(T.collapse(F.col("t"))).collect()]
    assert got == ["a b", "a\nb", "x y", "", "a\nb"] and time.time() - began < 60
