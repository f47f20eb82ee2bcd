import pytest
from pyspark.sql import functions as F

from tests.test_text import each
from verso.functions import values as V


@pytest.mark.parametrize(
    ("token", "kind"),
    [
        ("۱۲۵,۰۰۰,۰۰۰", "ok"), ("۷/۷۷۵/۰۰۰/۰۰۰", "ok"), ("۳۲۱/۰۰۰/۰۰", "broken"), ("۱۲.۹۷۸۰۲۱۹.۵۷۱", "broken"), ("۱۶۵.۰۰۰۰۰۰", "broken"),
        ("۱۴۰۳/۰۹/۲۰", "none"), ("12345", "none"), ("1,000.00", "none"), ("1,000", "none"),
    ],
)
def test_amounts(spark, token, kind):
    assert each(spark, V.amount_grouping, [token]) == [kind]


def test_dates(spark):
    cases = {"1402/06/31": "", "1402/07/31": "day", "1402/13/01": "month", "1403/12/30": "", "1402/12/30": "day", "1200/01/01": "year", "02/12/27": "", "x": "not a date"}
    assert each(spark, lambda t: V.jalali_date(t)["reason"], list(cases)) == list(cases.values())
    assert each(spark, lambda t: V.jalali_date(t)["normalized"], ["۱۴۰۲/۱۲/۲۷", "02-1-5", "1402/13/1"]) == ["1402/12/27", "1402/01/05", None]


def test_addresses(spark):
    assert each(spark, lambda t: V.email(t)["reason"], ["A.b@c.de", "a.b", "a@b", "a@b.c"]) == ["", "no @", "no dot", "characters"]
    assert each(spark, lambda t: V.phone(t)["reason"], ["09121234567", "38388575", "383885751", "abc", "12"]) == ["", "", "nine digits", "no digits", "digits"]
    assert each(spark, V.split_phones, ["۳۸۳۸۸۵۷۵ - ۳۸۳۸۸۴۸۱", "051-38388575", "123"]) == [["38388575", "38388481"], ["051-38388575"], ["123"]]


def test_numbers(spark):
    assert each(spark, V.atoms, ["a 125,000 b 12/3.4 7"]) == [["125000", "12", "3", "4", "7"]]
    assert each(spark, V.numbers, ["03/12/1402 5 44"]) == [["03|12|1402", "44"]]
    kinds = ["IR" + "1" * 24, "1402/01/02", "09121234567", "9121234567", "0012345678", "1,234,500", "123456", "12"]
    assert each(spark, V.numeric_kind, kinds) == ["iban", "date", "mobile", "mobile", "national_id", "amount", "reference", "other"]


def nid(d):
    s = sum(int(x) * (10 - i) for i, x in enumerate(d[:9])) % 11
    return len(set(d)) > 1 and int(d[9]) == (s if s < 2 else 11 - s)


def test_checksums(spark):
    ids = [f"{i * 123457 % 10**10:010d}" for i in range(300)] + ["1111111111"]
    assert each(spark, V.national_id_ok, ids) == [nid(d) for d in ids]
    ibans = [f"IR{i % 100:02d}{i * 987654321:022d}" for i in range(300)] + ["IR1", None]
    want = [bool(v) and len(v) == 26 and int(v[4:] + "1827" + v[2:4]) % 97 == 1 for v in ibans]
    assert each(spark, V.iban_ok, ibans) == want and any(want)


def test_resolve(spark):
    good = next(f"{i:010d}" for i in range(1234567, 9999999) if nid(f"{i:010d}"))
    bad = good[:-1] + str((int(good[-1]) + 1) % 10)
    df = spark.createDataFrame([(bad, good, "national_id"), (good, bad, "national_id"), ("1", None, "other")], "a string, b string, k string")
    assert [r[0] for r in df.select(V.resolve(F.col("a"), F.col("b"), F.col("k"))).collect()] == [good, good, "1"]


def test_split_is_by_content(spark):
    out = each(spark, lambda t: V.content_split(t.cast("binary")), [str(i) for i in range(500)] + ["7", "7"])
    assert out[500] == out[501] and 0.12 < out.count("eval") / 502 < 0.28


def test_cache_key_follows_settings(spark):
    keys = each(spark, lambda t: V.cache_key(F.lit("img").cast("binary"), t, F.lit("x")), ["300", "400", "300"])
    assert keys[0] == keys[2] != keys[1]


def test_scan_reports_values_as_they_were_read(spark):
    text = "info@a-b.ir و x@y\nتلفن: ۳۸۳۸۸۵۷۵ - ۳۸۳۸۸۴۸۱ - ۳۸۳۸۸۲۶۱۰\nفکس ۰۵۱-۳۸۳۸۸۵۷۵\nتماس ۱۴۰۲/۱۲/۳۰\nمبلغ 12345678\r\n1403/12/30"
    found = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(V.scan(F.col("t")).alias("f")).collect()
    got = [(f["kind"], f["value"], f["line"], f["valid"]) for f in found[0]["f"]]
    assert got == [
        ("email", "info@a-b.ir", None, True), ("email", "x@y", None, False),
        ("phone", "۳۸۳۸۸۵۷۵", 1, True), ("phone", "۳۸۳۸۸۴۸۱", 1, True), ("phone", "۳۸۳۸۸۲۶۱۰", 1, False), ("phone", "۰۵۱-۳۸۳۸۸۵۷۵", 2, True),
        ("date", "۱۴۰۲/۱۲/۳۰", 3, False), ("date", "1403/12/30", 5, True),
    ]
    assert found[0]["f"][5]["normalized"] == "05138388575" and found[0]["f"][4]["reason"] == "nine digits" and found[1]["f"] == [] == found[2]["f"]


def test_amounts_of_any_length(spark):
    rows = ["1" + ",234" * 1500, "1" + ",234" * 1500 + ",23", "1,234"]
    assert each(spark, V.amount_grouping, rows) == ["ok", "broken", "none"]
