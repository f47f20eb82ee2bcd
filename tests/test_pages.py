from pyspark.sql import functions as F

from verso.functions import distance, generators, values
from verso.operators import fulltext, layout, letters, numerals, scoring


def test_coverage_counts_numbers_once(spark):
    fields = spark.createDataFrame([(1, "a", "12/34 hello"), (1, "b", "12/34"), (2, "a", "none here")], "doc long, field string, gt string")
    pages = spark.createDataFrame([(1, "so 34/12 hello there"), (2, "nothing")], "doc long, text string")
    out = {r["doc"]: r for r in fulltext.score_documents(fields, pages).collect()}
    assert (out[1]["atoms_gt"], out[1]["atoms_hit"], out[1]["nums_gt"], out[1]["nums_hit"]) == (2, 2, 1, 1)
    assert out[2]["atoms_gt"] == 0 and out[2]["err"] > 0


def test_unsupported_lines(spark):
    lines = spark.createDataFrame([(1, 0, "present on page"), (1, 1, "zzzz qqqq xxxx"), (1, 2, " ")], "page long, line int, text string")
    pages = spark.createDataFrame([(1, "it is presnt on page")], "page long, page_text string")
    assert [r["line"] for r in fulltext.unsupported_lines(lines, pages).collect()] == [1]


def test_numbers_merge_match_and_replace(spark):
    schema = "page long, text string, conf double, x0 int, y0 int, x1 int, y1 int"
    words = spark.createDataFrame([(1, "1403", 90.0, 0, 0, 40, 10), (1, "/", 80.0, 45, 0, 50, 10), (1, "524", 70.0, 55, 0, 80, 10), (1, "99", 70.0, 300, 0, 320, 10)], schema)
    merged = {r["text"]: r["conf"] for r in numerals.merge_neighbours(words, "page").collect()}
    assert merged["1403/524"] == 70.0 and "99" in merged and len(merged) == 5
    spans = spark.createDataFrame([(1, 0, "1403/524"), (1, 1, "77777")], "page long, span int, value string")
    best = {r["span"]: r for r in numerals.best_words(spans, numerals.merge_neighbours(words, "page"), "page").collect()}
    assert best[0]["match"] == "1403/524" and best[0]["similarity"] == 1.0 and best[1]["match"] is None
    reads = spark.createDataFrame([(1, "14", 0.9, 10.0, 2, 0, 0, 19, 10), (1, "08", 0.95, 10.0, 2, 20, 0, 40, 10), (1, "5", 0.2, 10.0, 1, 55, 0, 80, 10)], "page long, text string, prob double, line_h double, n_digits int, x0 int, y0 int, x1 int, y1 int")
    out = {r["x0"]: (r["text"], r["digit_prob"]) for r in numerals.replace_numbers(words, reads, "page", 0.5).collect()}
    assert out[0] == ("1408", 0.9) and out[55] == ("524", None) and out[45] == ("/", None)


def test_commas_come_back(spark):
    rows = [(1, 0, 0, "سلام"), (1, 0, 1, "ء"), (1, 0, 2, "دوست"), (1, 1, 0, "«"), (1, 1, 1, "نه"), (1, 2, 0, "آب,نان"), (1, 2, 1, ",نان"), (1, 2, 2, "1,5")]
    out = numerals.restore_commas(spark.createDataFrame(rows, "page long, line int, pos int, text string"), ["page", "line"]).orderBy("line", "pos")
    assert [r["text"] for r in out.collect()] == ["سلام", "،", "دوست", "«", "نه", "آب،نان", "،نان", "1,5"]


def test_letter_fields(spark):
    text = ["شرکت نمونه", "شماره: ۱۲", "جناب آقای دکتر", "معاون محترم فنی", "موضوع: درخواست", "با سلام", "متن نامه", "با احترام", "تلفن: 12345678", "021 4455667"]
    rows = [(1, i, t, i * 100, 1000, 0.9) for i, t in enumerate(text)] + [(2, 0, "plain page", 0, 1000, 0.9)]
    out = {r["page"]: r for r in letters.letter_fields(spark.createDataFrame(rows, "page long, line int, text string, y0 int, page_height int, conf double"), "page").collect()}
    r = out[1]
    assert r["is_letter"] and r["sender"] == "شرکت نمونه" and r["subject"] == "درخواست" and r["receiver"] == "جناب آقای دکتر\nمعاون محترم فنی"
    assert r["body_text"] == "با سلام\nمتن نامه\nبا احترام" and r["contact_info"] == "تلفن: 12345678\n021 4455667"
    assert not out[2]["is_letter"] and out[2]["body_text"] is None


def test_letterhead(spark):
    rows = [(1, 0, 0, "شرکت", 0.9), (1, 0, 1, "خوب", 0.85), (1, 1, 0, "شرکت", 0.9), (1, 1, 1, "بد", 0.3), (1, 2, 0, "ثبت: ۱۲۳۴", 0.9)]
    r = letters.letterhead(spark.createDataFrame(rows, "page long, line int, pos int, text string, conf double"), "page").first()
    assert r["sender"] == "شرکت خوب" and r["registration_number"] == "1234"


def test_unread_runs_and_duplicates(spark):
    rows = [(1, 0, 0, "no:", "no", 95.0), (1, 0, 1, "xx", "xx", 20.0), (1, 1, 0, "word", "word", 95.0), (1, 1, 1, "a", "a", 10.0), (1, 2, 0, "z", "z", 5.0), (1, 2, 1, "q", "q", 5.0)]
    df = spark.createDataFrame(rows, "page long, line int, pos int, text string, key string, conf double")
    out = {(r["line"], r["pos"]): r["kind"] for r in layout.unread_runs(df, ["page", "line"], F.col("conf") < 30, F.col("text").endswith(":")).collect()}
    assert out == {(0, 0): None, (0, 1): "handwritten", (1, 0): None, (1, 1): None, (2, 0): "illegible", (2, 1): "illegible"}
    pieces = spark.createDataFrame([(1, 0, "بسمه تعالی", 5.0), (1, 1, "که بسمه تعالی", 4.0), (1, 2, "other words", 1.0)], "row long, piece int, text string, score double")
    assert sorted(r["piece"] for r in layout.drop_duplicate_pieces(pieces, ["row"]).collect()) == [0, 2]


def test_substitutions():
    assert distance.substitutions("abcd", "abxd") == [("c", "x")] and distance.substitutions("abc", "ab") == [] and sorted(distance.substitutions("kitten", "sitting")) == [("e", "i"), ("k", "s")]


def test_synthetic_values_are_valid_and_repeatable(spark):
    rows = generators.mixture(spark, 300).collect()
    assert rows == generators.mixture(spark, 300).collect() and len(rows) == 300 and {r["kind"] for r in rows} == {"date", "amount", "phone", "email"}
    df = spark.createDataFrame(rows)
    assert df.filter("kind = 'email'").filter(~values.email(F.col("text"))["valid"]).count() == 0
    assert df.filter("kind = 'amount'").filter(values.amount_grouping(F.translate("text", "،", ",")) == "broken").count() == 0
    words = spark.createDataFrame([("سلام",), ("دارا",), ("abc",)], "w string")
    out = [r[0] for r in words.select(generators.stretch(F.col("w"), F.lit(3))).collect()]
    assert out[0].count("ـ") == 3 and out[0].replace("ـ", "") == "سلام" and out[1:] == ["دارا", "abc"]


def test_pools_justification_and_settings(spark):
    df = spark.range(4).select(generators.from_pools(F.col("id"), {"a": ["x", "y"], "b": ["1", "2", "3"]}).alias("p"))
    assert [(r["p"]["a"], r["p"]["b"]) for r in df.collect()] == [("x", "1"), ("y", "2"), ("x", "3"), ("y", "1")]
    line = spark.createDataFrame([("سلام بر شما",)], "t string")
    out = line.select(generators.justify(F.col("t"), 20).alias("j"), generators.justify(F.col("t"), 3).alias("k")).first()
    assert len(out["j"]) >= 20 and out["j"].replace("ـ", "") == "سلام بر شما" and out["k"] == "سلام بر شما"
    keys = line.select(values.config_hash(F.struct(F.lit(1).alias("a"))), values.config_hash(F.struct(F.lit(2).alias("a")))).first()
    assert len(keys[0]) == 16 and keys[0] != keys[1]


def test_latest_checkpoint(spark):
    from verso.sources.readers import latest_checkpoint

    files = spark.createDataFrame([("a.checkpoint", 1), ("b.checkpoint", 3), ("c.txt", 9)], "name string, modified long")
    assert latest_checkpoint(files).first()[0] == "b.checkpoint"
