"""Seeded synthetic values as expressions over a row number: the same seed and row give the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FA = ("0123456789", "۰۱۲۳۴۵۶۷۸۹")
#: Fixed letters: those that do not join to the left, and the tooth that stretches a word.
NON_CONNECTING = "اآأإدذرزژوؤء"
KASHIDA = "ـ"
LETTER = "[ء-غف-يپچژکگی]"


def uniform(row: Column, seed: int, low: int, high: int) -> Column:
    """Whole number from low to high."""
    return (F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(high - low + 1)) + low).cast("int")


def digits(row: Column, seed: int, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.pmod(F.xxhash64(row, F.lit(seed), i), F.lit(10)).cast("string")), "")


def pick(row: Column, seed: int, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), uniform(row, seed, 1, len(values)))


def jalali_date(row: Column, seed: int = 1) -> Column:
    sep = pick(row, seed, ["/", "/", "/", "-"])
    parts = uniform(row, seed + 1, 1390, 1410).cast("string"), F.lpad(uniform(row, seed + 2, 1, 12).cast("string"), 2, "0"), F.lpad(uniform(row, seed + 3, 1, 30).cast("string"), 2, "0")
    return F.translate(F.concat(parts[0], sep, parts[1], sep, parts[2]), *FA)


def amount(row: Column, seed: int = 11) -> Column:
    sep, groups = pick(row, seed, ["،", ",", ".", "/"]), uniform(row, seed + 1, 1, 4)
    tail = F.array_join(F.transform(F.sequence(F.lit(1), groups), lambda i: F.concat(sep, F.lpad(F.pmod(F.xxhash64(row, F.lit(seed + 2), i), F.lit(1000)).cast("string"), 3, "0"))), "")
    return F.translate(F.concat(digits(row, seed + 3, uniform(row, seed + 4, 1, 3)), tail), *FA)


def phone(row: Column, seed: int = 21) -> Column:
    kind = uniform(row, seed, 0, 9)
    value = F.when(kind < 4, digits(row, seed + 1, 8)).when(kind < 7, F.concat(F.lit("0"), digits(row, seed + 2, 2), F.lit("-"), digits(row, seed + 1, 8))).otherwise(F.concat(F.lit("09"), digits(row, seed + 3, 9)))
    return F.translate(value, *FA)


def email(row: Column, seed: int = 31) -> Column:
    letters = lambda s, low, high: F.array_join(F.transform(F.sequence(F.lit(1), uniform(row, s, low, high)), lambda i: F.char(F.pmod(F.xxhash64(row, F.lit(s + 1), i), F.lit(26)) + 97)), "")
    return F.concat(letters(seed, 4, 10), F.lit("@"), letters(seed + 2, 4, 12), F.lit("."), pick(row, seed + 4, ["ir", "com", "org", "net", "co.ir"]))


#: Draws of a value of a length in bounds; the one value in some 10,000 that none of them gives is a date, which always fits.
DRAWS = 8


def synthetic_value(row: Column, seed: int = 5, weights: tuple[int, ...] = (3, 3, 2, 1), least: int = 6, most: int = 110) -> Column:
    """A struct (kind, text) made from a row's number or other key: of a weighted mixture, with a length in bounds."""
    kinds = [("date", jalali_date), ("amount", amount), ("phone", phone), ("email", email)]
    edges = [sum(weights[: i + 1]) for i in range(len(weights))]

    def drawn(key: Column) -> Column:
        at = uniform(key, seed, 0, edges[-1] - 1)
        values = [F.struct(F.lit(k).alias("kind"), f(key, seed).alias("text")) for k, f in kinds]
        return F.coalesce(*(F.when((at < e) & (at >= e - w), v) for e, w, v in zip(edges, weights, values, strict=True)))

    tries = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda i: drawn(F.xxhash64(row, F.lit(seed), i)))
    fits = F.filter(tries, lambda v: F.length(v["text"]).between(least, most))
    return F.coalesce(F.get(fits, F.lit(0)), F.struct(F.lit("date").alias("kind"), jalali_date(row, seed).alias("text")))


def mixture(spark: SparkSession, n: int, seed: int = 5, weights: tuple[int, ...] = (3, 3, 2, 1), least: int = 6, most: int = 110) -> DataFrame:
    """(row, kind, text): exactly n values, each made from its row alone."""
    rows = spark.range(n).withColumnRenamed("id", "row")
    return rows.withColumn("_v", synthetic_value(F.col("row"), seed, weights, least, most)).select("row", "_v.kind", "_v.text")


def kashida_positions(word: Column) -> Column:
    """Places (from 0) behind which a word may be stretched: a joining letter before another letter."""
    def joins(i: Column) -> Column:
        here, after = F.substring(word, i, F.lit(1)), F.substring(word, i + 1, F.lit(1))
        return here.rlike(LETTER) & ~F.contains(F.lit(NON_CONNECTING), here) & after.rlike(LETTER)

    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), joins)
    return F.when(F.length(word) > 1, F.transform(spots, lambda i: i - 1)).otherwise(F.array().cast("array<int>"))


def stretch(word: Column, total: Column, seed: int = 41) -> Column:
    """A word with `total` stretching marks dealt over the places that take them."""
    spots = kashida_positions(word)
    chosen = F.transform(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), lambda i: F.element_at(spots, (F.pmod(F.xxhash64(word, F.lit(seed), i), F.size(spots)) + 1).cast("int")))
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    out = F.array_join(F.transform(letters, lambda c, i: F.concat(c, F.repeat(F.lit(KASHIDA), F.size(F.filter(chosen, lambda p: p == i))))), "")
    return F.when((F.size(spots) == 0) | (total <= 0), word).otherwise(out)


def from_pools(row: Column, pools: dict[str, list[str]]) -> Column:
    """A struct with one entry of each pool, by the row number modulo the pool's size."""
    return F.struct(*(F.element_at(F.array(*map(F.lit, pool)), (F.pmod(row, F.lit(len(pool))) + 1).cast("int")).alias(name) for name, pool in pools.items()))


def justify(text: Column, target: int, seed: int = 51) -> Column:
    """A line stretched towards `target` characters: its words share the missing ones as stretching marks."""
    parts = F.split(text, " ")
    can = F.filter(F.transform(parts, lambda w, i: F.struct(i.alias("i"), F.size(kashida_positions(w)).alias("n"))), lambda s: s["n"] > 0)
    need = F.lit(target) - F.length(text)
    each = F.ceil(need / F.greatest(F.size(can), F.lit(1))).cast("int")
    done = F.transform(parts, lambda w: stretch(w, each, seed))
    return F.when((need <= 0) | (F.size(parts) < 2) | (F.size(can) == 0), text).otherwise(F.array_join(done, " "))
