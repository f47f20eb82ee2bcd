"""Personal data: base patterns, and terms that give protected entities away.

Base spans come from four patterns. The entities they match are protected; corpus co-occurrence then
estimates how much a term says about an entity: with N rows, pmi(t, e) = log(N n(t, e) / (n(t) n(e)))
against the information of the entity itself, ic(e) = log(N / n(e)). A term in a row with an entity whose
pmi / ic reaches the disclosure threshold would let a reader recover the entity, so it becomes a span of
its own in every row that has it, to be generalised or removed with the base spans. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verso.llm.common import as_given, let, numbered, staged

#: Fixed patterns of the base kinds, in their listed order. Runs are possessive and start at a run's
#: first character or behind the last match, which finds the same leftmost matches in linear time.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that every text with a match passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A term: a run of letters of any length.
TERM = r"\p{L}++"
#: Files that telling terms are written to, so that they are broadcast while small.
FILES = 8
#: Matches whose spans are gathered before they are appended to those of the text.
BLOCK = 256
SPAN = "array<struct<start:int,place:int,end:int,kind:string,found:string>>"


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        n = F.length(_digits(found))
        return n.between(12, 19) & _luhn(_digits(found))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def spans_of(text: Column, pattern: Column | str, kind: str, place: int, valid=None) -> Column:
    """Spans of the matches of a pattern, in code points: the text between matches gives their places."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, between = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, regex, -1)
    pairs = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("found"))

    def add(acc: Column, pair: Column) -> Column:
        first = acc["at"] + F.length(pair["gap"])
        last = first + F.length(pair["found"])
        span = F.struct(first.alias("start"), F.lit(place).alias("place"), last.alias("end"), F.lit(kind).alias("kind"), pair["found"].alias("found"))
        out = F.concat(acc["out"], F.array(span))
        if valid is not None:
            out = F.when(valid(pair["found"]), out).otherwise(acc["out"])
        return F.struct(last.alias("at"), out.alias("out"))

    def start(at: Column) -> Column:
        return F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))

    def in_blocks(every: Column) -> Column:
        """Spans of `BLOCK` matches at a time, so that a text with very many copies no long array at each of them."""
        blocks = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / BLOCK).cast("int"))

        def join(acc: Column, block: Column) -> Column:
            own = F.aggregate(F.slice(every, block * BLOCK + 1, F.lit(BLOCK)), start(acc["at"]), add)
            return let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], o["out"]).alias("out")))

        return F.when(F.size(every) > 0, F.aggregate(blocks, start(F.lit(0)), join, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))

    return let(pairs, in_blocks)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(text: Column) -> dict[str, Column]:
    """A column of spans for each base kind; texts without the hint of a kind are not searched."""
    out = {}
    for place, kind in enumerate(KINDS):
        hint = text.contains("@") if kind == "email" else text.rlike(HINTS[kind])
        spans = spans_of(text, PATTERNS[kind], kind, place, lambda found, kind=kind: _valid(kind, found))
        out[f"_{kind}"] = F.when(hint, spans).otherwise(F.array().cast(SPAN))
    return out


def _entity(span: Column) -> Column:
    """Name of the entity a span stands for: letters folded, and digits alone for numbers."""
    value = F.when(span["kind"].isin("card", "phone"), _digits(span["found"])).otherwise(F.lower(span["found"]))
    return F.concat_ws(":", span["kind"], value)


def _terms(text: Column) -> Column:
    """Distinct folded terms of a text."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))
    return F.array_distinct(F.transform(found, lambda t: F.lower(t)))


def _classes(rows: DataFrame, name: str, count: str) -> DataFrame:
    """(name, _first) of every name: the first of those with the same count and the same rows, as two sums of hashes of
    their keys, their least and their greatest key tell."""
    sums = [F.sum(F.xxhash64("_key", F.lit(i)).cast("decimal(38,0)")).alias(f"_s{i}") for i in (0, 1)]
    same = rows.groupBy(name, count).agg(F.count(F.lit(1)).alias("_c"), F.min("_key").alias("_a"), F.max("_key").alias("_z"), *sums)
    first = same.groupBy(count, "_c", "_a", "_z", "_s0", "_s1").agg(F.min(name).alias("_first"))
    return same.join(first, [count, "_c", "_a", "_z", "_s0", "_s1"]).select(name, "_first")


def find(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.9,
    support: int = 2,
) -> DataFrame:
    """Rows with all spans: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_base (the four kinds), n_term, _all.

    A term is a run of letters of the row's text, folded to lower case. It is disclosing if at least
    `support` different texts have it together with some entity and pmi / ic is at least `threshold`
    for the two; counts are over all rows. It is marked wherever it stands as a whole word in any row,
    unless it overlaps a base span. Null texts count as empty and have no spans; repeated rows count as
    rows and get equal results; null identifiers are like any other; an empty table gives no rows.

    As n(t, e) <= n(e), a disclosing term has n(t) <= N (n(e) / N)^threshold, so only terms that rare
    are paired with an entity.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_key", F.xxhash64("_id", "_text"))
    found = rows.select("*", *(v.alias(k) for k, v in base_spans(F.col("_text")).items()))
    every = F.concat(*(F.col(f"_{k}") for k in KINDS))
    found = found.withColumn("_base", F.array_sort(every))
    # Of these texts only those with spans are needed again.
    table = staged(found.withColumn("_text", F.when(F.size("_base") > 0, F.col("_text"))), "base-spans")

    total = table.count()
    limit = lambda n_e: F.pow(n_e / float(max(total, 1)), F.lit(threshold)) * (total * (1 + 1e-9))

    holding = table.filter(F.size("_base") > 0).withColumn("_seen", F.xxhash64("_text"))
    each = holding.select("_key", "_seen", F.explode(F.array_distinct(F.transform("_base", _entity))).alias("entity"))
    by_text = each.groupBy("entity", "_seen").agg(F.count(F.lit(1)).alias("rows"))
    entities = by_text.groupBy("entity").agg(F.sum("rows").alias("n_e"), F.count(F.lit(1)).alias("texts"))
    entities = staged(entities.filter((F.col("texts") >= support) & (F.col("n_e") < total)).drop("texts"), "entities")
    most = entities.agg(F.max("n_e")).first()[0] or 0
    occurs = rows.select(F.explode(_terms(F.col("_text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    vocabulary = staged(occurs.filter((F.col("n_t") >= support) & (F.col("n_t") <= limit(F.lit(most)))), "vocabulary")

    # Entities that stand in the same rows are one class, terms likewise: one of each class is paired for all, so a list
    # of many names and addresses is not all pairs of them.
    holders = staged(each.select("_key", "entity").distinct().join(entities, "entity"), "holders")
    holders = holders.join(_classes(holders, "entity", "n_e").filter("entity = _first").select("entity"), "entity", "left_semi")
    terms = holding.select("_key", "_seen", F.explode(_terms(F.col("_text"))).alias("term")).join(vocabulary, "term")
    terms = staged(terms, "terms")
    alike = staged(_classes(terms, "term", "n_t"), "classes")
    found_in = terms.join(alike.filter("term = _first").select("term"), "term", "left_semi")
    pairs = found_in.join(holders, "_key").filter(F.col("n_t") <= limit(F.col("n_e")))
    pairs = pairs.groupBy("entity", "term", "n_t", "n_e", "_seen").agg(F.count(F.lit(1)).alias("rows"))
    pairs = pairs.groupBy("entity", "term", "n_t", "n_e").agg(F.sum("rows").alias("n_te"), F.count(F.lit(1)).alias("texts"))
    pmi = F.log(F.lit(float(total)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    ic = F.log(F.lit(float(total)) / F.col("n_e"))
    telling = pairs.filter((F.col("texts") >= support) & (pmi >= threshold * ic)).select(F.col("term").alias("_first")).distinct()
    telling = alike.join(telling, "_first").select("term")
    telling = staged(telling.repartition(FILES), "telling")

    # Telling terms in all rows, as they are written there.
    forms = rows.select("_key", F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(TERM), F.lit(0)))).alias("form"))
    forms = forms.withColumn("term", F.lower("form")).join(telling, "term")
    marks = staged(forms.groupBy("_key").agg(F.array_sort(F.collect_set("form")).alias("_forms")), "marks")
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("_forms", "|"), F.lit(r")(?!\p{L})"))
    # By merge at any size, so that the disk in use grows with the input alone.
    extra = rows.join(marks.hint("merge"), "_key").select("_key", spans_of(F.col("_text"), pattern, "term", len(KINDS)).alias("_extra"))
    extra = extra.groupBy("_key").agg(F.first("_extra").alias("_extra"))  # repeated rows share a key

    joined = table.drop("_text").join(extra, "_key", "left").withColumn("_extra", F.coalesce("_extra", F.array().cast(SPAN)))
    clear = F.filter("_extra", lambda t: ~F.exists("_base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    joined = joined.withColumn("_extra", clear).withColumn("_all", F.array_sort(F.concat("_base", "_extra")))
    return joined.select(
        F.col("_id").alias(id_col),
        "_key",
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.col("_all")).alias("spans"),
        F.size("_base").cast("long").alias("n_base"),
        F.size("_extra").cast("long").alias("n_term"),
        "_all",
    )


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_terms: bool = False, **options) -> DataFrame:
    """`df` with its texts sanitised: base spans become <KIND>, disclosing terms <TERM> or nothing.

    Overlapping spans are generalised to the first of them. Null texts stay null; other columns and
    repeated rows stay as they are; an empty table gives no rows.
    """
    rows, ident, text = numbered(df, id_col, text_col)
    found = find(rows, ident, text, **options).filter(F.size("_all") > 0).groupBy("_key").agg(F.first("_all").alias("_all"))
    keyed = rows.withColumn("_key", F.xxhash64(F.col(ident), F.coalesce(F.col(text), F.lit(""))))
    joined = keyed.join(found, "_key", "left")
    body = F.col(text)

    # Spans that begin behind the end of every one before them, then the text between them.
    def clear(spans: Column) -> Column:
        reach = lambda i: F.array_max(F.transform(F.slice(spans, F.lit(1), i), lambda s: s["end"]))
        return F.filter(spans, lambda s, i: (i == 0) | (s["start"] >= F.coalesce(reach(i), F.lit(0))))

    def pieces(spans: Column) -> Column:
        name = lambda s: F.when((s["kind"] == "term") & F.lit(remove_terms), F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        after = lambda i: F.when(i > 0, F.element_at(spans, F.greatest(i, F.lit(1)))["end"]).otherwise(F.lit(0))
        each = F.transform(spans, lambda s, i: F.concat(F.substring(body, after(i) + 1, s["start"] - after(i)), name(s)))
        return F.concat(F.array_join(each, ""), F.substring(body, F.element_at(spans, -1)["end"] + 1, F.length(body)))

    clean = let(clear(F.col("_all")), pieces)
    return as_given(joined.withColumn(text, F.when(F.col("_all").isNotNull(), clean).otherwise(body)), df)
