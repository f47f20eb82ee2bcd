"""Numbers, dates, addresses and checksums found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verso.functions.text import DIGITS

# --- fixed values -------------------------------------------------------------------------------
NUMBER = r"\d+(?:[.,/:\-]\d+)*"
SPAN = "(?:IR)?[0-9۰-۹٠-٩](?:[0-9۰-۹٠-٩,./\\-،٫٬]*[0-9۰-۹٠-٩])?"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+"
EMAIL_OK = r"^[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}$"
ANY_DIGIT = "[0-9۰-۹٠-٩]"
DATE = r"(\d{2,4})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{1,2})"
PHONE_RUN = r"\d[\d\s\-()]{5,20}\d"
PHONE_RUN_ANY = r"\d(?:\d|[\s\-()]){5,20}\d"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
PHONE_LABEL = "(?:تلفن|تلفکس|فکس|نمابر|موبایل|همراه|تماس)"
LEAP_REMAINDERS = (1, 5, 9, 13, 17, 22, 26, 30)
FIRST_YEAR, LAST_YEAR = 1300, 1499
# ------------------------------------------------------------------------------------------------


def ascii_digits(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), *DIGITS)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(ascii_digits(text), r"\D", "")


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))


def atoms(text: Column) -> Column:
    """Digit groups of all numbers; a number grouped in threes by commas is one atom."""

    def split(token: Column) -> Column:
        return F.when(token.rlike(r"^\d+(?:,\d{3})+$"), F.array(F.replace(token, F.lit(","), F.lit("")))).otherwise(
            F.split(token, r"[.,/:\-]")
        )

    return F.flatten(F.transform(number_tokens(text), split))


def numbers(text: Column) -> Column:
    """Numbers of two or more digits; the groups of one number in sorted order, so that a reversal is a match."""
    long = F.filter(number_tokens(text), lambda t: F.length(F.regexp_replace(t, r"\D", "")) >= 2)
    return F.transform(long, lambda t: F.array_join(F.array_sort(F.split(t, r"[.,/:\-]")), "|"))


def amount_grouping(token: Column) -> Column:
    """ok, broken or none: whether the groups behind one kind of separator have three digits each."""
    t = F.regexp_replace(F.regexp_replace(ascii_digits(token), r"^\D+", ""), r"\D+$", "")
    parts = F.split(t, "[,./]")
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    whole = F.filter(rest, lambda g: F.length(g) == 3)
    grouped = t.rlike(r"^\d{1,3}(?:(?:,\d+)+|(?:\.\d+)+|(?:/\d+)+)$")
    several = F.size(rest) >= 2
    missed = F.exists(rest, lambda g: F.length(g) > 4) & (F.length(F.regexp_replace(t, r"\D", "")) >= 6)
    return (
        F.when(~grouped, "none")
        .when(several & (F.size(whole) == F.size(rest)), "ok")
        .when(several & (F.size(whole) > 0), "broken")
        .when(missed, "broken")
        .otherwise("none")
    )


def numeric_kind(value: Column) -> Column:
    """Kind of a numeric string, by the first rule that fits."""
    a = F.upper(ascii_digits(value))
    d = F.regexp_replace(a, r"\D", "")
    n, plain = F.length(d), ~a.rlike("[,/]")
    return (
        F.when(a.startswith("IR") & (n == 24), "iban")
        .when(a.rlike(r"^1[34]\d{2}[/\-.]\d{1,2}[/\-.]\d{1,2}$"), "date")
        .when((n == 11) & d.startswith("09"), "mobile")
        .when((n == 10) & d.startswith("9") & plain, "mobile")
        .when((n == 10) & plain, "national_id")
        .when(~plain & (n >= 6), F.when(a.endswith("00") | a.contains(","), "amount").otherwise("reference"))
        .when(n >= 6, "reference")
        .otherwise("other")
    )


def numeric_spans(text: Column, least: int = 3) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPAN), F.lit(0))
    return F.filter(found, lambda s: F.length(digits_only(s)) >= least)


def jalali_date(raw: Column) -> dict[str, Column]:
    """valid, reason and normalized of a calendar date in text; two-digit years turn at 50."""
    t = ascii_digits(raw)
    part = [F.regexp_extract(t, DATE, i) for i in (1, 2, 3)]
    found = part[0] != ""
    y, m, d = (F.when(found, p.cast("int")) for p in part)
    y = F.when(y < 50, y + 1400).when(y < 100, y + 1300).otherwise(y)
    leap = F.pmod(y, F.lit(33)).isin(*LEAP_REMAINDERS)
    last = F.when(m <= 6, 31).when(m <= 11, 30).otherwise(F.when(leap, 30).otherwise(29))
    reason = (
        F.when(~found, "not a date")
        .when(~y.between(FIRST_YEAR, LAST_YEAR), "year")
        .when(~m.between(1, 12), "month")
        .when(~d.between(1, last), "day")
        .otherwise("")
    )
    return {"valid": reason == "", "reason": reason, "normalized": F.when(reason == "", F.format_string("%04d/%02d/%02d", y, m, d))}


def email(raw: Column) -> dict[str, Column]:
    v = F.trim(raw)
    ok = v.rlike(EMAIL_OK)
    host = F.substring_index(v, "@", -1)
    host = F.when(F.instr(v, "@") > 0, F.substring(v, F.instr(v, "@") + 1, F.length(v))).otherwise(host)
    reason = F.when(ok, "").when(~v.contains("@"), "no @").when(~host.contains("."), "no dot").otherwise("characters")
    return {"valid": ok, "reason": reason, "normalized": F.when(ok, F.lower(v))}


def phone(raw: Column) -> dict[str, Column]:
    d = digits_only(raw)
    n = F.length(d)
    ok = n.isin(8, 10, 11)
    reason = F.when(ok, "").when(n == 0, "no digits").when(n == 9, "nine digits").otherwise("digits")
    return {"valid": ok, "reason": reason, "normalized": F.when(ok, d)}


def split_phones(run: Column, as_read: bool = False) -> Column:
    """The numbers of one run: two groups are one number if the first is an area code that completes the second.

    Their digits are ASCII, or with `as_read` those of the text.
    """
    groups = F.regexp_extract_all(run, F.lit(f"{ANY_DIGIT}+"), F.lit(0))
    first, second = (ascii_digits(F.try_element_at(groups, F.lit(i))) for i in (1, 2))
    joined = F.concat(first, second)
    area = (F.size(groups) == 2) & first.startswith("0") & (F.length(first) <= 4) & F.length(joined).isin(10, 11)
    return F.when(area | (F.size(groups) < 2), F.array(run)).otherwise(groups if as_read else F.transform(groups, ascii_digits))


def _finding(kind: str, value: Column, verdict: dict[str, Column], line: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), line.cast("int").alias("line"), *(verdict[k].alias(k) for k in ("valid", "reason", "normalized")))


def scan(text: Column, label: str = PHONE_LABEL) -> Column:
    """Findings of a transcript as (kind, value, line, valid, reason, normalized), values exactly as they were read.

    E-mail addresses come first (line is null), then line by line the dates and, behind the first telephone
    label of the line, the numbers of each run that holds no date.
    """
    known = F.coalesce(text, F.lit(""))
    every = lambda t, pattern: F.regexp_extract_all(t, F.lit(pattern.replace(r"\d", ANY_DIGIT)), F.lit(0))
    dated = DATE.replace(r"\d", ANY_DIGIT)
    emails = F.transform(F.regexp_extract_all(known, F.lit(EMAIL), F.lit(0)), lambda v: _finding("email", v, email(v), F.lit(None)))

    def of_line(line: Column, i: Column) -> Column:
        dates = F.transform(every(line, DATE), lambda v: _finding("date", v, jalali_date(v), i))
        runs = F.filter(every(F.regexp_extract(line, f"(?s){label}(.*)$", 1), PHONE_RUN_ANY), lambda r: ~r.rlike(dated))
        numbers = F.flatten(F.transform(runs, lambda r: split_phones(r, as_read=True)))
        return F.concat(dates, F.transform(numbers, lambda v: _finding("phone", v, phone(v), i)))

    return F.concat(emails, F.flatten(F.transform(F.split(known, LINE_END), of_line)))


def national_id_ok(digits: Column) -> Column:
    """Ten digits, not all equal, with a check digit modulo 11."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda a, i: a + F.substring(digits, i, F.lit(1)).cast("int") * (11 - i))
    s, last = total % 11, F.substring(digits, 10, 1).cast("int")
    return F.when(~digits.rlike(r"^\d{10}$") | digits.rlike(r"^(\d)\1{9}$"), False).otherwise(last == F.when(s < 2, s).otherwise(11 - s))


def iban_ok(value: Column) -> Column:
    """IR and 24 digits whose rearranged number leaves 1 modulo 97; digits are folded one at a time."""
    v = F.upper(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\s-]", ""))
    # I and R count as 18 and 27 and move to the end together with the check digits.
    digits = F.concat(F.substring(v, 5, 22), F.lit("1827"), F.substring(v, 3, 2))
    rest = F.aggregate(F.sequence(F.lit(1), F.lit(28)), F.lit(0), lambda a, i: (a * 10 + F.substring(digits, i, F.lit(1)).cast("int")) % 97)
    return F.when(~v.rlike(r"^IR\d{24}$"), False).otherwise(rest == 1)


def resolve(first: Column, second: Column, kind: Column) -> Column:
    """The first reading, unless only the second passes the checksum of its kind."""
    a, b = digits_only(first), digits_only(second)
    better_id = (kind == "national_id") & national_id_ok(b) & ~national_id_ok(a)
    better_iban = (kind == "iban") & iban_ok(ascii_digits(second)) & ~iban_ok(ascii_digits(first))
    return F.when(F.coalesce(second, F.lit("")) == "", first).when(better_id | better_iban, second).otherwise(first)


def content_split(content: Column, share: int = 200) -> Column:
    """eval or train by the first 32 bits of the content's SHA-256, modulo 1000."""
    head = F.conv(F.substring(F.sha2(content, 256), 1, 8), 16, 10).cast("long")
    return F.when(F.pmod(head, F.lit(1000)) < share, "eval").otherwise("train")


def cache_key(content: Column, *settings: Column) -> Column:
    """SHA-256 over the content's own SHA-256 and the settings, joined by unit separators."""
    return F.sha2(F.concat(F.unhex(F.sha2(content, 256)), F.encode(F.concat_ws("\u001f", *settings), "UTF-8")), 256)


def config_hash(settings: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a struct's JSON; callers give its fields in a fixed order."""
    return F.substring(F.sha2(F.to_json(settings), 256), 1, 16)
