"""Registered queries over the driver's tables, each with the SQL it is checked against.

Ground truth and prediction are neighbouring lines of a document, one field per pair of lines; word boxes
are laid out from the words of conversation turns. Everything runs over whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verso.functions import distance, text, values
from verso.operators import audit, layout, ledger, lexicon, resampling, scoring, splits, statistics
from verso.plans import edits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over the cores where a table lies in fewer pieces than there are cores; larger tables stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def plain(t: Column) -> Column:
    """Lower-case ASCII with one blank between words: both engines agree on it to the byte."""
    t = F.regexp_replace(F.coalesce(t, F.lit("")), r"[^\x00-\x7F]", "?")
    return F.trim(F.regexp_replace(F.lower(t), r"[ \t\r\f\x0B]+", " "))


def fields_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, lang, source, usable, field, has_gt, gt, pred): line 2i is ground truth, line 2i + 1 its prediction."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    lines = F.transform(F.split("text", "\n"), plain)
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / 2).cast("int")),
        lambda i: F.struct(
            F.format_string("f%03d", i).alias("field"),
            F.element_at("_lines", i * 2 + 1).alias("gt"),
            F.try_element_at("_lines", i * 2 + 2).alias("pred"),
        ),
    )
    rows = docs.withColumn("_lines", lines).select(
        F.col("doc_id").alias("doc"), "lang", "source", (F.coalesce("quality", F.lit(1)) == 1).alias("usable"), F.explode(pairs).alias("p")
    )
    rows = rows.select("doc", "lang", "source", "usable", "p.field", (F.col("source") != "src7").alias("has_gt"), "p.gt", "p.pred")
    # Edit distances cost far more than the move: pairs are dealt evenly, and by document as later joins need them.
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc")


PLAIN = "trim(regexp_replace(lower(regexp_replace(coalesce({0}, ''), '[^\\x00-\\x7F]', '?', 'g')), '[ \\t\\r\\f\\x0B]+', ' ', 'g'))"
FIELDS = f"""
lines AS (SELECT d.doc_id AS doc, lang, source, coalesce(quality, 1) = 1 AS usable, list_transform(string_split(text, chr(10)), lambda x: {PLAIN.format("x")}) AS ls
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
pairs AS (SELECT doc, lang, source, usable, ls, unnest(range((len(ls) + 1) // 2)) AS i FROM lines),
fields AS (SELECT doc, lang, source, usable, printf('f%03d', i) AS field, source <> 'src7' AS has_gt, ls[i * 2 + 1] AS gt, ls[i * 2 + 2] AS pred FROM pairs),
outcomes AS (SELECT *, CASE WHEN NOT has_gt THEN 'unscoreable' WHEN coalesce(gt, '') = '' AND coalesce(pred, '') = '' THEN 'null_agree'
                     WHEN coalesce(pred, '') = '' THEN 'omission' WHEN coalesce(gt, '') = '' THEN 'hallucination' ELSE 'scored' END AS outcome FROM fields),
scored AS (SELECT *, CASE WHEN outcome = 'scored' THEN levenshtein(gt, pred) END AS edits, CASE WHEN has_gt THEN length(coalesce(gt, '')) ELSE 0 END AS gt_len FROM outcomes)
"""
HEADLINE = """count(DISTINCT doc) AS n_docs,
    round_even(count(DISTINCT CASE WHEN usable THEN doc END) / count(DISTINCT doc), 4) AS usable_rate,
    round_even(sum(CASE WHEN outcome = 'scored' THEN edits END) / nullif(sum(CASE WHEN outcome = 'scored' THEN gt_len END), 0), 4) AS cer_given_output,
    round_even(sum(CASE WHEN outcome IN ('scored', 'omission') THEN CASE WHEN usable AND outcome = 'scored' THEN edits ELSE gt_len END END)
      / nullif(sum(CASE WHEN outcome IN ('scored', 'omission') THEN gt_len END), 0), 4) AS effective_cer,
    round_even(sum(coalesce(edits, gt_len)) / nullif(sum(gt_len), 0), 4) AS assigned_cer,
    round_even(count(*) FILTER (outcome = 'scored' AND gt = pred) / nullif(count(*) FILTER (outcome = 'scored'), 0), 4) AS exact_rate"""


def outcomes_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.outcomes(fields_of(spark, sf_dir))


@query(f"WITH {FIELDS} SELECT lang, {HEADLINE} FROM scored GROUP BY lang")
def headline_by_lang(spark, sf_dir):
    return scoring.headline(outcomes_light(spark, sf_dir), "lang")


@query(f"WITH {FIELDS} SELECT source, {HEADLINE} FROM scored GROUP BY source")
def a7_headline_by_source(spark, sf_dir):
    return scoring.headline(outcomes_light(spark, sf_dir), "source")


@query()
def a7_headline_intervals(spark, sf_dir):
    """Headline figures with intervals by document and by source; drawn weights, which SQL has no equal of."""
    return resampling.headline_intervals(outcomes_light(spark, sf_dir), ["lang"], "source")


@query()
def a15_intervals(spark, sf_dir):
    """Rate of sound documents per language with both kinds of intervals, 2,000 resamples."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    unit = lambda kind, c: rows.groupBy("lang", F.lit(kind).alias("kind"), F.col(c).cast("string").alias("unit")).agg(F.sum("quality").alias("top"), F.count(F.lit(1)).alias("bottom"))
    return resampling.intervals(unit("document", "doc_id").unionByName(unit("cluster", "source")), ["lang", "kind"])


# ---- text --------------------------------------------------------------------------------------

WS = "' \\t\\x{a0}\\x{1680}\\x{2000}-\\x{200b}\\x{202f}\\x{205f}\\x{3000}'"


@query(
    """SELECT doc_id, length(n) AS n_chars, sha256(n) AS digest FROM (SELECT doc_id,
      trim(regexp_replace(regexp_replace(lower_ascii, '[ \\t]*\\n[ \\t\\n]*', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(10)) AS n
      FROM (SELECT doc_id, translate(nfc_normalize(coalesce(text, '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents))"""
)
def f1_normalize(spark, sf_dir):
    n = text.normalize(F.col("text"), text.LATIN)
    return dealt(table(spark, sf_dir, "documents")).select("doc_id", n.alias("n")).select("doc_id", F.length("n").cast("long").alias("n_chars"), F.sha2("n", 256).alias("digest"))


RULE_SQL = {
    "lowercase_latin": "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
    "fold_punctuation": "translate(coalesce(text, ''), ',;?', '\u060c\u061b\u061f')",
    "strip_bidi": "regexp_replace(coalesce(text, ''), '[\u200e\u200f\u202a-\u202e\u2066-\u2069]', '', 'g')",
    "digits_to_ascii": "translate(coalesce(text, ''), '\u06f0\u06f1\u06f2\u06f3\u06f4\u06f5\u06f6\u06f7\u06f8\u06f9', '0123456789')",
}


@query(
    " UNION ALL ".join(
        f"SELECT '{k}' AS rule, count(*) FILTER ({v} <> coalesce(text, '')) AS docs_changed, sum(length(coalesce(text, '')) - length({v}))::BIGINT AS chars_lost FROM documents"
        for k, v in RULE_SQL.items()
    )
)
def f1_rule_ablation(spark, sf_dir):
    known = F.coalesce("text", F.lit(""))
    each = F.array(*(F.struct(F.lit(k).alias("rule"), text.normalize(F.col("text"), text.Rules.only(k)).alias("t")) for k in RULE_SQL))
    rows = dealt(table(spark, sf_dir, "documents")).select(known.alias("known"), F.explode(each).alias("r"))
    return rows.groupBy("r.rule").agg(
        F.count_if(F.col("r.t") != F.col("known")).alias("docs_changed"), F.sum(F.length("known") - F.length("r.t")).alias("chars_lost")
    )


LATIN_CENSUS = {"digits": "[0-9]", "accented": "[À-ÿ]", "upper": "[A-Z]", "blanks": " ", "line_ends": "\\n", "stops": "[.!?]"}


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{c}')) AS {k}" for k, c in LATIN_CENSUS.items()) + " FROM documents")
def a17_char_census(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents")).select("doc_id", *(c.alias(k) for k, c in text.census(F.col("text"), LATIN_CENSUS).items()))


@query(
    """SELECT source, sum(len(regexp_extract_all(text, '[éèê]'))) ::BIGINT AS forms, count(*) FILTER (regexp_matches(text, '[éèê]')) AS docs_with,
       round_even(100.0 * count(*) FILTER (regexp_matches(text, '[éèê]')) / count(*), 2) AS pct FROM documents GROUP BY source"""
)
def a16_letterform(spark, sf_dir):
    hits = text.count_of(F.coalesce("text", F.lit("")), "[éèê]")
    rows = table(spark, sf_dir, "documents").withColumn("_h", hits)
    return rows.groupBy("source").agg(
        F.sum("_h").alias("forms"), F.count_if(F.col("_h") > 0).alias("docs_with"), F.bround(F.lit(100.0) * F.count_if(F.col("_h") > 0) / F.count(F.lit(1)), 2).alias("pct")
    )


@query(
    """SELECT doc_id, chars, latin_words, round_even(share, 6) AS share,
       CASE WHEN chars = 0 THEN true WHEN chars < 8 THEN hits > 0 OR latin_words > 0 ELSE share >= 0.6 OR latin_words >= 4 END AS legible
       FROM (SELECT doc_id, chars, latin_words, hits, CASE WHEN chars = 0 THEN 0.0 ELSE hits / chars END AS share FROM (
         SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) AS chars, len(regexp_extract_all(coalesce(text, ''), '[a-z]')) AS hits,
                len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]{4,}')) AS latin_words FROM documents))"""
)
def pf5_legibility(spark, sf_dir):
    v = text.legibility(F.col("text"), script="[a-z]")
    return dealt(table(spark, sf_dir, "documents")).select("doc_id", v["chars"].alias("chars"), v["latin_words"].alias("latin_words"), F.bround(v["share"], 6).alias("share"), v["legible"].alias("legible"))


@query(
    """SELECT doc_id, CASE WHEN n < 40 THEN false WHEN marks * 100.0 / n >= 0.30 THEN true ELSE n >= 200 AND own * 100.0 / n < 0.80 END AS other_language
       FROM (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) AS n, len(regexp_extract_all(text, '[éèêç]')) AS marks,
             len(regexp_extract_all(text, '[wk]')) AS own FROM documents)"""
)
def pf6_script_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.looks_arabic(F.col("text"), "[éèêç]", "[wk]").alias("other_language"))


DROPS = [("empty", "length(trim(text)) = 0"), ("charset", "regexp_matches(text, '[#$%&]')"), ("short", "length(text) < 80"), ("long", "length(text) > 20000")]


@query(
    "SELECT reason, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {c} THEN '{k}'" for k, c in DROPS) + " ELSE 'kept' END AS reason FROM documents) GROUP BY reason"
)
def pf8_drop_reasons(spark, sf_dir):
    t = F.col("text")
    rules = [("empty", F.length(F.trim(t)) == 0), ("charset", t.rlike("[#$%&]")), ("short", F.length(t) < 80), ("long", F.length(t) > 20000)]
    rows = table(spark, sf_dir, "documents").select(F.coalesce(audit.drop_reason(rules), F.lit("kept")).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH j AS (SELECT d.*, quality FROM documents d LEFT JOIN labels l USING (doc_id))
       SELECT slice, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN true THEN 'all' END, CASE WHEN lang = 'en' THEN 'english' END,
         CASE WHEN quality = 1 THEN 'good' END, CASE WHEN quality IS NULL THEN 'unlabelled' END, CASE WHEN length(text) > 2000 THEN 'long' END],
         lambda x: x IS NOT NULL)) AS slice FROM j) GROUP BY slice"""
)
def pf1_slices(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return audit.slice_counts(
        rows,
        {"all": F.lit(True), "english": F.col("lang") == "en", "good": F.col("quality") == 1, "unlabelled": F.col("quality").isNull(), "long": F.length("text") > 2000},
    )


@query(
    """SELECT coalesce(kind, 'usable') AS kind, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' AND value < 5 THEN 'transport'
         WHEN event_type = 'error' THEN 'http_422' WHEN event_type = 'signup' THEN 'no_object' WHEN value < 1 THEN 'all_null' END AS kind FROM events) GROUP BY 1"""
)
def pf3_failure_ladder(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    kind = scoring.usable_kind(
        F.when(failed & (F.col("value") < 5), "timed out"), F.when(failed, 422).otherwise(200), F.lit(None).cast("boolean"), F.col("event_type") != "signup", F.col("value") < 1
    )
    return e.select(F.coalesce(kind, F.lit("usable")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN contains(lower(props), '422') THEN 'http_422' WHEN contains(lower(props), 'timeout') THEN 'timeout'
       ELSE 'transport_or_5xx' END AS kind FROM (SELECT replace(replace(props, '4', '422'), '7', 'timeout') AS props FROM events WHERE event_type = 'error')) GROUP BY kind"""
)
def pf4_legacy_ladder(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    error = F.replace(F.replace(F.col("props"), F.lit("4"), F.lit("422")), F.lit("7"), F.lit("timeout"))
    return e.select(scoring.legacy_failure_kind(error).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# ---- numbers and values ------------------------------------------------------------------------

GROUPED = """CASE WHEN NOT regexp_matches(t, '^\\d{1,3}((,\\d+)+|(\\.\\d+)+|(/\\d+)+)$') THEN 'none'
  WHEN len(rest) >= 2 AND len(list_filter(rest, lambda g: length(g) = 3)) = len(rest) THEN 'ok'
  WHEN len(rest) >= 2 AND len(list_filter(rest, lambda g: length(g) = 3)) > 0 THEN 'broken'
  WHEN len(list_filter(rest, lambda g: length(g) > 4)) > 0 AND length(regexp_replace(t, '\\D', '', 'g')) >= 6 THEN 'broken' ELSE 'none' END"""


@query(
    f"""WITH tokens AS (SELECT unnest(regexp_extract_all(text, '\\d+(?:[.,/:\\-]\\d+)*')) AS t FROM documents
         UNION ALL SELECT format('{{:,}}', CAST(round_even(l_extendedprice * 100, 0) AS BIGINT)) FROM lineitem)
       SELECT grouping, count(*) AS n FROM (SELECT {GROUPED} AS grouping FROM (SELECT t, regexp_split_to_array(t, '[,./]')[2:] AS rest FROM tokens)) GROUP BY grouping"""
)
def pf12_amount_grouping(spark, sf_dir):
    tokens = dealt(table(spark, sf_dir, "documents")).select(F.explode(values.number_tokens(F.col("text"))).alias("t"))
    prices = table(spark, sf_dir, "lineitem").select(F.format_number(F.bround(F.col("l_extendedprice") * 100, 0), 0).alias("t"))
    rows = tokens.unionByName(prices).select(values.amount_grouping(F.col("t")).alias("grouping"))
    return rows.groupBy("grouping").agg(F.count(F.lit(1)).alias("n"))


KIND = """CASE WHEN a LIKE 'IR%' AND n = 24 THEN 'iban' WHEN regexp_full_match(a, '1[34]\\d{2}[/\\-.]\\d{1,2}[/\\-.]\\d{1,2}') THEN 'date'
  WHEN n = 11 AND d LIKE '09%' THEN 'mobile' WHEN n = 10 AND d LIKE '9%' AND plain THEN 'mobile' WHEN n = 10 AND plain THEN 'national_id'
  WHEN NOT plain AND n >= 6 THEN CASE WHEN a LIKE '%00' OR contains(a, ',') THEN 'amount' ELSE 'reference' END WHEN n >= 6 THEN 'reference' ELSE 'other' END"""


@query(
    f"""SELECT kind, count(*) AS n FROM (SELECT {KIND} AS kind FROM (SELECT upper(v) AS a, regexp_replace(v, '\\D', '', 'g') AS d, length(regexp_replace(v, '\\D', '', 'g')) AS n,
        NOT regexp_matches(v, '[,/]') AS plain FROM (SELECT unnest(regexp_extract_all(text, '(?:IR)?[0-9](?:[0-9,./\\-]*[0-9])?')) AS v FROM documents)) WHERE n >= 3) GROUP BY kind"""
)
def pf13_numeric_kind(spark, sf_dir):
    spans = table(spark, sf_dir, "documents").select(F.explode(values.numeric_spans(F.col("text"))).alias("v"))
    return spans.select(values.numeric_kind(F.col("v")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


ATOMS = "flatten(list_transform(regexp_extract_all(text, '\\d+(?:[.,/:\\-]\\d+)*'), lambda t: CASE WHEN regexp_matches(t, '^\\d+(?:,\\d{3})+$') THEN [replace(t, ',', '')] ELSE regexp_split_to_array(t, '[.,/:\\-]') END))"


@query(f"SELECT atom, count(*) AS n FROM (SELECT unnest({ATOMS}) AS atom FROM documents) GROUP BY atom")
def v1_atoms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(values.atoms(F.col("text"))).alias("atom")).groupBy("atom").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT n, count(*) AS places FROM (SELECT list_aggregate(list_sort(regexp_split_to_array(t, '[.,/:\\-]')), 'string_agg', '|') AS n
       FROM (SELECT unnest(regexp_extract_all(text, '\\d+(?:[.,/:\\-]\\d+)*')) AS t FROM documents) WHERE length(regexp_replace(t, '\\D', '', 'g')) >= 2) GROUP BY n"""
)
def v1_numbers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(values.numbers(F.col("text"))).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("places"))


@query(
    """SELECT o_orderkey, CASE WHEN y NOT BETWEEN 1300 AND 1499 THEN 'year' WHEN m NOT BETWEEN 1 AND 12 THEN 'month' WHEN d NOT BETWEEN 1 AND last THEN 'day' ELSE '' END AS reason,
         CASE WHEN y BETWEEN 1300 AND 1499 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND last THEN printf('%04d/%02d/%02d', y, m, d) END AS normalized
       FROM (SELECT *, CASE WHEN m <= 6 THEN 31 WHEN m <= 11 THEN 30 WHEN y % 33 IN (1, 5, 9, 13, 17, 22, 26, 30) THEN 30 ELSE 29 END AS last
         FROM (SELECT o_orderkey, CASE WHEN y < 50 THEN y + 1400 WHEN y < 100 THEN y + 1300 ELSE y END AS y, m, d
           FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 100 ELSE 1295 + o_custkey % 210 END::INT AS y, (o_orderkey % 14)::INT AS m, (o_orderkey % 33)::INT AS d FROM orders)))"""
)
def v2_dates(spark, sf_dir):
    k = F.col("o_custkey")
    y = F.when(k % 3 == 0, k % 100).otherwise(k % 210 + 1295).cast("int")
    raw = F.format_string("%02d/%02d/%02d", y, (F.col("o_orderkey") % 14).cast("int"), (F.col("o_orderkey") % 33).cast("int"))
    v = values.jalali_date(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", v["reason"].alias("reason"), v["normalized"].alias("normalized"))


@query(
    """SELECT value, count(*) AS n, ok AS valid, CASE WHEN ok THEN '' WHEN NOT contains(substr(value, instr(value, '@') + 1), '.') THEN 'no dot' ELSE 'characters' END AS reason
       FROM (SELECT value, regexp_matches(value, '^[A-Za-z0-9._%+\\-]+@(?:[A-Za-z0-9\\-]+\\.)+[A-Za-z]{2,}$') AS ok
             FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+')) AS value FROM documents)) GROUP BY value, ok"""
)
def v3_emails(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(values.EMAIL), F.lit(0))).alias("value"))
    v = values.email(F.col("value"))
    return rows.select("value", v["valid"].alias("valid"), v["reason"].alias("reason")).groupBy("value", "valid", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT kind, valid, count(*) AS n FROM (
         SELECT 'email' AS kind, regexp_matches(v, '^[A-Za-z0-9._%+\\-]+@(?:[A-Za-z0-9\\-]+\\.)+[A-Za-z]{2,}$') AS valid
           FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+')) AS v FROM documents)
         UNION ALL SELECT 'phone', length(regexp_replace(v, '\\D', '', 'g')) IN (8, 10, 11) FROM (SELECT unnest(regexp_extract_all(text, '\\d[\\d\\s\\-()]{5,20}\\d')) AS v FROM documents)
         UNION ALL SELECT 'number', length(v) >= 3 FROM (SELECT unnest(regexp_extract_all(text, '\\d+')) AS v FROM documents)) GROUP BY kind, valid"""
)
def v4_findings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    parts = (("email", values.EMAIL, lambda v: values.email(v)["valid"]), ("phone", values.PHONE_RUN, lambda v: values.phone(v)["valid"]), ("number", r"\d+", lambda v: F.length(v) >= 3))
    judge = lambda k, ok: lambda v: F.struct(F.lit(k).alias("kind"), ok(v).alias("valid"))
    each = F.concat(*(F.transform(found(p), judge(k, ok)) for k, p, ok in parts))
    return docs.select(F.explode(each).alias("f")).groupBy("f.kind", "f.valid").agg(F.count(F.lit(1)).alias("n"))


NID = "lpad((c_custkey * 7919 % 10000000000)::VARCHAR, 10, '0')"
IBAN = "'IR' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || lpad((c_custkey * 104729)::VARCHAR, 22, '0')"


@query(
    f"""SELECT c_custkey, CASE WHEN len(list_distinct(string_split(d, ''))) = 1 THEN false ELSE (CASE WHEN s < 2 THEN s ELSE 11 - s END) = d[10]::INT END AS nid_ok, m = 1 AS iban_ok
       FROM (SELECT c_custkey, d, list_sum(list_transform(range(1, 10), lambda i: d[i]::INT * (11 - i))) % 11 AS s,
             (substr(v, 5, 22) || '1827' || substr(v, 3, 2))::HUGEINT % 97 AS m FROM (SELECT c_custkey, {NID} AS d, {IBAN} AS v FROM customer))"""
)
def v5_checksums(spark, sf_dir):
    k = F.col("c_custkey")
    nid = F.lpad((k * 7919 % 10000000000).cast("string"), 10, "0")
    iban = F.concat(F.lit("IR"), F.lpad((k % 100).cast("string"), 2, "0"), F.lpad((k * 104729).cast("string"), 22, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", values.national_id_ok(nid).alias("nid_ok"), values.iban_ok(iban).alias("iban_ok"))


@query(
    """SELECT lang, split, count(*) AS n FROM (SELECT lang, CASE WHEN ('0x' || substr(sha256(text), 1, 8))::UBIGINT % 1000 < 200 THEN 'eval' ELSE 'train' END AS split FROM documents) GROUP BY lang, split"""
)
def v12_hash_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", values.content_split(F.col("text").cast("binary")).alias("split"))
    return rows.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT page_id, sha256(unhex(sha256(html)) || encode('fas' || chr(31) || '300')) AS key_a, sha256(unhex(sha256(html)) || encode('fas' || chr(31) || '400')) AS key_b FROM pages"""
)
def v14_cache_key(spark, sf_dir):
    page = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select(
        "page_id", values.cache_key(page, F.lit("fas"), F.lit("300")).alias("key_a"), values.cache_key(page, F.lit("fas"), F.lit("400")).alias("key_b")
    )


# ---- distances and scoring ---------------------------------------------------------------------


@query(
    f"""WITH {FIELDS} SELECT doc, field, edits, round_even(edits / length(gt), 6) AS cer, round_even(1 - edits / greatest(length(gt), length(pred)), 6) AS similarity
        FROM scored WHERE outcome = 'scored'"""
)
def k1_cer_pairs(spark, sf_dir):
    rows = fields_of(spark, sf_dir).filter("has_gt and gt <> '' and pred <> ''")
    gt, pred = F.col("gt"), F.col("pred")
    return rows.select(
        "doc", "field", distance.edits(gt, pred).cast("long").alias("edits"), F.bround(distance.cer(gt, pred), 6).alias("cer"),
        F.bround(distance.similarity(gt, pred, distance.edits), 6).alias("similarity"),
    )


@query(edits.of_documents(FIELDS)["k2_wer_pairs"])
def k2_wer_pairs(spark, sf_dir):
    rows = fields_of(spark, sf_dir).filter("gt <> '' and pred <> ''")
    return rows.select("doc", "field", distance.word_edits(F.col("gt"), F.col("pred")).alias("word_edits"), F.size(text.tokens(F.col("gt"))).alias("gt_words"))


@query(edits.of_turns(ATOMS)["k3_semiglobal"])
def k3_semiglobal(spark, sf_dir):
    """Each turn against the next one of its conversation."""
    turns = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return turns.filter("next is not null").select("conv_id", "turn", distance.semiglobal(F.col("text"), F.col("next")).alias("edits"), F.length("text").alias("n"))


@query(edits.of_turns(ATOMS)["k5_run_class"])
def k5_run_class(spark, sf_dir):
    """How the digit groups of a document come out in the document's own numbers, with the order of groups undone."""
    docs = table(spark, sf_dir, "documents").withColumn("digits", values.digits_only(F.col("text")))
    units = docs.select("doc_id", "digits", F.explode(F.array_distinct(values.atoms(F.col("text")))).alias("unit"))
    return units.select(distance.run_class(F.reverse("unit"), F.col("digits")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {FIELDS} SELECT count(*) AS slots, count(*) FILTER (outcome = 'scored') AS scored, count(*) FILTER (outcome = 'omission') AS omission,
        count(*) FILTER (outcome = 'hallucination') AS hallucination, count(*) FILTER (outcome = 'null_agree') AS null_agree, count(*) FILTER (outcome = 'unscoreable') AS unscoreable,
        source FROM outcomes GROUP BY source"""
)
def a13_outcome_counts(spark, sf_dir):
    rows = scoring.outcomes(fields_of(spark, sf_dir))
    one = [F.count_if(F.col("outcome") == k).alias(k) for k in ("scored", "omission", "hallucination", "null_agree", "unscoreable")]
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("slots"), *one)


CONV = f"""
turns AS (SELECT conv_id AS doc, turn // 2 AS slot, turn % 2 AS side, role, {PLAIN.format("replace(text, chr(10), ' ')")} AS t FROM conversations),
fields AS (SELECT doc, printf('f%03d', slot) AS field, bool_or(side = 0 AND role = 'user') AS has_gt, max(CASE WHEN side = 0 THEN t END) AS gt, max(CASE WHEN side = 1 THEN t END) AS pred
           FROM turns GROUP BY doc, slot),
outcomes AS (SELECT *, CASE WHEN NOT has_gt THEN 'unscoreable' WHEN coalesce(gt, '') = '' AND coalesce(pred, '') = '' THEN 'null_agree'
                     WHEN coalesce(pred, '') = '' THEN 'omission' WHEN coalesce(gt, '') = '' THEN 'hallucination' ELSE 'scored' END AS outcome FROM fields),
alike AS (SELECT p.doc, p.field AS p, g.field AS g, 1 - levenshtein(g.gt, p.pred) / greatest(length(g.gt), length(p.pred)) AS sim
          FROM fields p JOIN fields g ON p.doc = g.doc WHERE g.has_gt AND coalesce(g.gt, '') <> '' AND coalesce(p.pred, '') <> ''),
own AS (SELECT doc, p, sim FROM alike WHERE p = g),
best AS (SELECT doc, p, arg_min(g, (-sim, g)) AS g, max(sim) AS sim FROM alike WHERE p <> g GROUP BY doc, p),
misassigned AS (SELECT b.doc, b.p AS field, b.g AS misassigned_to FROM best b LEFT JOIN own o ON b.doc = o.doc AND b.p = o.p WHERE b.sim >= 0.8 AND b.sim > coalesce(o.sim, 0)),
duplicated AS (SELECT doc, g AS field, count(*) AS n FROM alike WHERE sim >= 0.8 GROUP BY doc, g HAVING count(*) > 1)
"""


def conversation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even turns are ground truth where a user speaks, odd turns are predictions."""
    t = plain(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.floor(F.col("turn") / 2).cast("int").alias("slot"), (F.col("turn") % 2).alias("side"), "role", t.alias("t"))
    rows = turns.groupBy("doc", "slot").agg(
        F.bool_or((F.col("side") == 0) & (F.col("role") == "user")).alias("has_gt"), F.max(F.when(F.col("side") == 0, F.col("t"))).alias("gt"), F.max(F.when(F.col("side") == 1, F.col("t"))).alias("pred")
    )
    return rows.select("doc", F.format_string("f%03d", "slot").alias("field"), "has_gt", "gt", "pred", F.lit(True).alias("usable"))


@query(
    f"""WITH {CONV} SELECT count(*) AS slots, count(*) FILTER (outcome = 'scored') AS scored, count(*) FILTER (outcome = 'omission') AS omission,
        count(*) FILTER (outcome = 'hallucination') AS hallucination, count(*) FILTER (outcome = 'null_agree') AS null_agree, count(*) FILTER (outcome = 'unscoreable') AS unscoreable,
        count(misassigned_to) AS misassigned, count(n) AS duplicated, count(*) FILTER (outcome = 'unscoreable' AND coalesce(pred, '') <> '') AS unscoreable_content
        FROM outcomes LEFT JOIN misassigned USING (doc, field) LEFT JOIN duplicated USING (doc, field)"""
)
def a8_error_classes(spark, sf_dir):
    return scoring.error_classes(scoring.assignments(scoring.outcomes(conversation_fields(spark, sf_dir))))


@query(f"WITH {CONV} SELECT doc, field, misassigned_to FROM misassigned")
def j6_misassigned(spark, sf_dir):
    return scoring.assignments(conversation_fields(spark, sf_dir)).filter("misassigned_to is not null").select("doc", "field", "misassigned_to")


NAMES = ["f000", "f001", "f002", "f003", "f004", "f999"]


@query(edits.of_conversations(CONV)["a9_per_field"])
def a9_per_field(spark, sf_dir):
    return scoring.per_field(scoring.outcomes(conversation_fields(spark, sf_dir)), NAMES)


@query(edits.of_conversations(CONV)["a4_oracle_assign"])
def a4_oracle_assign(spark, sf_dir):
    rows = scoring.outcomes(conversation_fields(spark, sf_dir))
    assigned = rows.groupBy("doc").agg(F.sum(F.coalesce("edits", "gt_len")).alias("assigned_edits"))
    return scoring.oracle_edits(rows, fields=8).join(assigned, "doc")


@query(edits.of_conversations(CONV)["a11_reversal"])
def a11_reversal(spark, sf_dir):
    rows = scoring.reversals(scoring.outcomes(conversation_fields(spark, sf_dir)))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH w AS (SELECT conv_id, turn, unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS word FROM conversations),
       a AS (SELECT conv_id, turn, word, count(*) AS c FROM w GROUP BY ALL)
       SELECT a.conv_id, a.turn, sum(a.c)::BIGINT AS n, sum(least(a.c, coalesce(b.c, 0)))::BIGINT AS hit
       FROM a LEFT JOIN a b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn AND a.word = b.word GROUP BY a.conv_id, a.turn"""
)
def a21_multiset_hit(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.tokens(F.col("text"))).alias("word"))
    return scoring.multiset_hits(words, words.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"], "word")


# ---- statistics --------------------------------------------------------------------------------

RANKS = ", ".join(
    f"list_sort(list(value))[least(count(*), CAST(floor({p} * count(*)) AS BIGINT) + 1)] AS {k}" for k, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
).replace("floor(0.", "floor(0.")


@query(
    f"""SELECT 'included' AS failures, count(*) AS n, round_even(avg(value), 3) AS mean, {RANKS.replace(" * count", "::DOUBLE * count")} FROM events
        UNION ALL SELECT 'excluded', count(*), round_even(avg(value), 3), {RANKS.replace(" * count", "::DOUBLE * count")} FROM events WHERE event_type <> 'error'"""
)
def a12_latency(spark, sf_dir):
    each = F.array_compact(F.array(F.lit("included"), F.when(F.col("event_type") != "error", F.lit("excluded"))))
    rows = table(spark, sf_dir, "events").select("value", F.explode(each).alias("failures"))
    return statistics.rank_values(rows, ["failures"], "value", {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99})


def _boot_sql(units: str) -> str:
    step = "(({x}) * 1103515245 + 12345) % 2147483648"
    x = step.format(x=step.format(x="it * 100003 + slot * 1009 + 17"))
    return f"""WITH units AS ({units}), numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY unit) - 1 AS i FROM units),
      sizes AS (SELECT k, count(*) AS n, sum(top) AS t, sum(bottom) AS b FROM units GROUP BY k),
      slots AS (SELECT k, n, it, unnest(range(n)) AS slot FROM (SELECT k, n, unnest(range(200)) AS it FROM sizes)),
      drawn AS (SELECT s.k, it, sum(top) AS t, sum(bottom) AS b FROM (SELECT *, (({x}) // 65536) % n AS i FROM slots) s JOIN numbered u ON s.k = u.k AND s.i = u.i GROUP BY s.k, it),
      ends AS (SELECT k, list_sort(list(t / b)) AS vs FROM drawn WHERE b <> 0 GROUP BY k)
      SELECT k, n AS n_units, round_even(t / nullif(b, 0), 4) AS point, CASE WHEN n > 1 THEN round_even(vs[(0.025 * len(vs))::INT + 1], 4) END AS lo,
        CASE WHEN n > 1 THEN round_even(vs[least(len(vs), floor(0.975 * len(vs))::INT + 1)], 4) END AS hi FROM sizes LEFT JOIN ends USING (k)"""


@query(_boot_sql("SELECT event_type AS k, event_id AS unit, CASE WHEN value > 5 THEN 1 ELSE 0 END AS top, 1 AS bottom FROM events"))
def a14_bootstrap(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    units = e.select(F.col("event_type").alias("k"), F.col("event_id").alias("unit"), F.when(F.col("value") > 5, 1).otherwise(0).alias("top"), F.lit(1).alias("bottom"))
    return statistics.bootstrap(units, ["k"], iterations=200)


@query(
    _boot_sql(
        """SELECT 'cluster' AS k, source AS unit, sum(quality) AS top, count(*) AS bottom FROM documents JOIN labels USING (doc_id) GROUP BY source
           UNION ALL SELECT 'document', lpad(doc_id::VARCHAR, 19, '0'), quality, 1 FROM documents JOIN labels USING (doc_id)"""
    )
)
def a15_cluster_bootstrap(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    cluster = rows.groupBy(F.col("source").alias("unit")).agg(F.sum("quality").alias("top"), F.count(F.lit(1)).alias("bottom")).withColumn("k", F.lit("cluster"))
    single = rows.select(F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("unit"), F.col("quality").cast("long").alias("top"), F.lit(1).cast("long").alias("bottom"), F.lit("document").alias("k"))
    return statistics.bootstrap(cluster.unionByName(single), ["k"], iterations=200)


@query(
    """SELECT source, min(n_chars) AS least, max(n_chars) AS most, list_sort(list(n_chars))[least(count(*), CAST(floor(0.5::DOUBLE * count(*)) AS BIGINT) + 1)] AS p50,
       count(*) AS n, round_even(avg(n_chars), 3) AS mean FROM documents GROUP BY source"""
)
def a30_distribution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    ranks = statistics.rank_values(docs, ["source"], "n_chars", {"p50": 0.5})
    return docs.groupBy("source").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most")).join(ranks, "source")


@query("SELECT lang, sum(length(text) * (n_chars % 100))::BIGINT AS mass, round_even(sum(length(text) * (n_chars % 100)) / sum(length(text)), 6) AS conf FROM documents GROUP BY lang")
def a31_text_mass(spark, sf_dir):
    conf = F.col("n_chars") % 100
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        statistics.text_mass(F.col("text"), conf).alias("mass"), F.bround(statistics.weighted_confidence(F.col("text"), conf), 6).alias("conf")
    )


@query("SELECT doc_id, (len(regexp_extract_all(text, 'the'))) AS hits FROM documents")
def a27_watch_list(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.count_text(F.col("text"), "the").alias("hits"))


# ---- splits, audits, joins ---------------------------------------------------------------------

UNITS = "SELECT source, substr(sha1(text), 1, 10) AS tid, count(*) AS n FROM documents GROUP BY ALL"


@query(
    f"""SELECT source, tid, n, CASE WHEN sum(n) OVER (PARTITION BY source ORDER BY n DESC, tid ROWS UNBOUNDED PRECEDING) - n < round_even(sum(n) OVER (PARTITION BY source) * 0.6::DOUBLE, 0)
        THEN 'dev' ELSE 'test' END AS split FROM ({UNITS})"""
)
def w1_greedy_split(spark, sf_dir):
    tid = F.substring(F.sha1(F.col("text").cast("binary")), 1, 10)
    units = table(spark, sf_dir, "documents").groupBy("source", tid.alias("tid")).agg(F.count(F.lit(1)).alias("n"))
    return splits.greedy_split(units, "source", "tid", "n")


STRATA = """SELECT stratum, gk, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY sha256('s1' || gk), gk) <=
   CASE WHEN count(*) OVER p = 1 THEN 1 ELSE greatest(1, least(count(*) OVER p - 1, round_even(count(*) OVER p * 0.6::DOUBLE, 0))) END THEN 'dev' ELSE 'test' END AS split
   FROM (SELECT source || '|' || lang AS stratum, 'gt:' || substr(sha1(text), 1, 12) AS gk FROM documents GROUP BY ALL) WINDOW p AS (PARTITION BY stratum)"""


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "documents").select(F.concat_ws("|", "source", "lang").alias("stratum"), splits.group_key(F.col("text"), F.lit("")).alias("gk")).distinct()
    return splits.stratified_split(groups, "stratum", "gk", "s1")


@query(f"SELECT stratum, split, count(*) AS n FROM ({STRATA}) GROUP BY stratum, split")
def w16_stratified_split(spark, sf_dir):
    return strata(spark, sf_dir).groupBy("stratum", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH s AS ({STRATA}) SELECT 'same stratum' AS check, count(*) AS n FROM (SELECT stratum, gk FROM s GROUP BY ALL HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'any stratum', count(*) FROM (SELECT gk FROM s GROUP BY ALL HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'uncovered', count(*) FROM (SELECT 'gt:' || substr(sha1(text), 1, 12) AS gk FROM documents) d ANTI JOIN s ON d.gk = s.gk"""
)
def u_leak_check(spark, sf_dir):
    s = strata(spark, sf_dir)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    keys = table(spark, sf_dir, "documents").select(splits.group_key(F.col("text"), F.lit("")).alias("gk"))
    same = splits.leaks(s.withColumn("u", F.struct("stratum", "gk")), "u")
    return one(same, "same stratum").unionByName(one(splits.leaks(s, "gk"), "any stratum")).unionByName(one(keys.join(s, "gk", "left_anti"), "uncovered"))


@query("SELECT substr(sha256(text), 1, 12) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def a18_duplicate_groups(spark, sf_dir):
    return audit.duplicate_groups(table(spark, sf_dir, "documents"), F.col("text").cast("binary"))


@query(
    """SELECT coalesce(l.toxic, -1) AS toxic, CASE WHEN l.doc_id IS NULL THEN 'unassigned' WHEN l.quality = 1 THEN 'dev' ELSE 'test' END AS split, count(*) AS n
       FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL"""
)
def j1_score_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    split = labels.select("doc_id", F.when(F.col("quality") == 1, "dev").otherwise("test").alias("split"))
    toxic = docs.select("doc_id").join(labels.select("doc_id", "toxic"), "doc_id", "left")
    rows = audit.score_join(docs.select("doc_id", "lang"), docs.select("doc_id", "source"), toxic, split, "doc_id")
    return rows.groupBy(F.coalesce("toxic", F.lit(-1)).alias("toxic"), "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH a AS (SELECT doc_id % 1500 AS id, substr(sha256(text), 1, 12) AS h FROM documents), e AS (SELECT doc_id AS id, substr(sha256(quality::VARCHAR), 1, 12) AS h FROM labels)
       SELECT problem, count(*) AS n FROM (SELECT DISTINCT 'unknown' AS problem, id FROM a ANTI JOIN e USING (id) UNION ALL SELECT DISTINCT 'missing', id FROM e ANTI JOIN a USING (id)
         UNION ALL SELECT 'duplicate', id FROM a GROUP BY id HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'h differs', a.id FROM a JOIN e USING (id)) GROUP BY problem"""
)
def j3_reconcile(spark, sf_dir):
    digest = lambda c: F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 12).alias("h")
    actual = table(spark, sf_dir, "documents").select((F.col("doc_id") % 1500).alias("id"), digest("text"))
    expected = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), digest("quality"))
    return audit.reconcile(actual, expected, "id", ["h"]).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN given IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'unknown' WHEN c > 1 THEN 'duplicate' ELSE 'matched' END AS status
       FROM (SELECT lower(n_name) AS k, n_name AS wanted FROM nation) t FULL JOIN (SELECT lower(c_name) AS k, min(c_name) AS given, count(*) AS c
         FROM (SELECT upper(n_name) AS c_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT r_name FROM region) GROUP BY 1) d ON t.k = d.k) GROUP BY status"""
)
def j4_template_reconcile(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    template = nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("pos"))
    named = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.upper("n_name").alias("name"))
    delivery = named.unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    return audit.reconcile_template(template, delivery, "name").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# ---- layout ------------------------------------------------------------------------------------


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every turn as boxes: a line per text line, ten units a letter, gaps that widen now and then."""
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "t")
    )
    words = turns.select("page", "line", F.posexplode(F.array_remove(F.split("t", " "), "")).alias("pos", "text"))
    seq = Window.partitionBy("page", "line").orderBy("pos")
    n = F.length("text")
    gap = F.when((F.col("pos") * 7 + n * 3) % 9 == 0, 60).otherwise(10)
    x1 = F.sum(n * 10 + gap).over(seq)
    lift = F.floor(F.col("line") / 3) * 40
    return words.select(
        "page", "line", "pos", "text", ((n * 13 + F.col("pos") * 7) % 101).cast("double").alias("conf"), (x1 - n * 10).cast("int").alias("x0"),
        (F.col("line") * 50 + lift).cast("int").alias("y0"), x1.cast("int").alias("x1"), (F.col("line") * 50 + lift + 40).cast("int").alias("y1"),
    )


BOXES = """
raw AS (SELECT conv_id * 1000 + turn AS page, unnest(range(len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM conversations),
split_words AS (SELECT page, line, list_filter(string_split(t, ' '), lambda x: x <> '') AS ws FROM raw),
words AS (SELECT page, line, unnest(range(len(ws))) AS pos, unnest(ws) AS text FROM split_words),
placed AS (SELECT *, sum(length(text) * 10 + CASE WHEN (pos * 7 + length(text) * 3) % 9 = 0 THEN 60 ELSE 10 END) OVER (PARTITION BY page, line ORDER BY pos) AS x1 FROM words),
boxes AS (SELECT page, line, pos, text, (length(text) * 13 + pos * 7) % 101 AS conf, x1 - length(text) * 10 AS x0, x1, line * 50 + line // 3 * 40 AS y0, line * 50 + line // 3 * 40 + 40 AS y1 FROM placed)
"""
NUMBERS = f"""{BOXES}, numbers AS (SELECT * REPLACE (CASE pos % 4 WHEN 0 THEN '(' || (1234 * length(text)) WHEN 1 THEN '/' WHEN 2 THEN (10 + pos) || ')' ELSE text END AS text) FROM boxes)"""


def number_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes whose words are numbers, separators and words in turn."""
    pos = F.col("pos")
    number = F.concat(F.lit("("), (F.length("text") * 1234).cast("string"))
    return boxes(spark, sf_dir).withColumn(
        "text", F.when(pos % 4 == 0, number).when(pos % 4 == 1, "/").when(pos % 4 == 2, F.concat((pos + 10).cast("string"), F.lit(")"))).otherwise(F.col("text"))
    )


SEGMENTS = f"""{BOXES}, gaps AS (SELECT *, lag(x0) OVER s AS px0, lag(x1) OVER s AS px1 FROM boxes WINDOW s AS (PARTITION BY page, line ORDER BY pos)),
cut AS (SELECT *, sum(CASE WHEN px0 IS NOT NULL AND greatest(0, greatest(x0, px0) - least(x1, px1)) > 1.2 * 40 THEN 1 ELSE 0 END) OVER (PARTITION BY page, line ORDER BY pos) AS segment FROM gaps)"""


@query(
    f"""WITH {SEGMENTS}, pieces AS (SELECT page, line, segment, max(x1) AS reach, string_agg(text, ' ' ORDER BY pos) AS t FROM cut GROUP BY ALL)
        SELECT page, line, sha256(string_agg(t, ' ' ORDER BY reach DESC, segment)) AS digest, count(*) AS pieces FROM pieces GROUP BY page, line"""
)
def w4_segments(spark, sf_dir):
    rows = layout.segments(boxes(spark, sf_dir), ["page", "line"], F.lit(True))
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_order", "pos", "text"))), lambda w: w["text"]), " ")
    return rows.groupBy("page", "line").agg(F.sha2(t, 256).alias("digest"), F.max("piece_order").cast("long").alias("pieces"))


CUTS = f"""{SEGMENTS}, wide AS (SELECT page, line, pos, (px0 + x1) / 2.0 AS at FROM gaps WHERE px0 IS NOT NULL AND greatest(px0 - x1, x0 - px1) > 48),
cuts AS (SELECT DISTINCT a.page, a.line, a.pos FROM wide a JOIN wide b ON a.page = b.page AND abs(a.line - b.line) = 1 AND abs(a.at - b.at) <= 24)"""


@query(f"WITH {CUTS} SELECT page, line, pos FROM cuts")
def w5_table_cuts(spark, sf_dir):
    return layout.table_cuts(boxes(spark, sf_dir), "page")


@query(
    f"""WITH {CUTS}, celled AS (SELECT b.*, sum(CASE WHEN c.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.page, b.line ORDER BY b.pos) AS cell
          FROM boxes b LEFT JOIN cuts c USING (page, line, pos) WHERE (b.page, b.line) IN (SELECT (page, line) FROM cuts))
        SELECT page, line, cell::BIGINT AS cell, string_agg(text, ' ' ORDER BY pos) AS text, min(x0)::INT AS x0, max(x1)::INT AS x1 FROM celled GROUP BY page, line, cell"""
)
def w6_cells(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return layout.cells(b, layout.table_cuts(b, "page"), "page").select("page", "line", F.col("cell").cast("long").alias("cell"), "text", "x0", "x1")


LINES = f"""{BOXES}, ls AS (SELECT page, line, string_agg(text, ' ' ORDER BY pos) AS text, min(y0) AS y0, max(y1) AS y1 FROM boxes GROUP BY page, line),
steps AS (SELECT *, (y0 + y1) / 2 - lag((y0 + y1) / 2) OVER (PARTITION BY page ORDER BY line) AS gap FROM ls),
pitch AS (SELECT page, median(gap) AS pitch FROM steps WHERE gap > 0 GROUP BY page),
paras AS (SELECT s.*, sum(CASE WHEN gap > 1.6 * pitch THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line) AS paragraph FROM steps s LEFT JOIN pitch USING (page))"""


@query(
    f"""WITH {LINES}, ps AS (SELECT page, paragraph, string_agg(text, chr(10) ORDER BY line) AS t FROM paras GROUP BY ALL)
        SELECT page, count(*) AS paragraphs, sha256(string_agg(t, chr(10) || chr(10) ORDER BY paragraph)) AS digest FROM ps GROUP BY page"""
)
def w7_paragraphs(spark, sf_dir):
    lines = layout.paragraphs(layout.line_boxes(boxes(spark, sf_dir), "page", "line"), "page")
    counts = lines.groupBy("page").agg(F.count_distinct("paragraph").alias("paragraphs"))
    return layout.page_text(lines, "page").select("page", F.sha2("text", 256).alias("digest")).join(counts, "page")


@query(
    f"""WITH {BOXES}, n AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY pos) AS i, count(*) OVER (PARTITION BY page, line) AS c, lead(x0) OVER s AS nx0, lead(x1) OVER s AS nx1
          FROM boxes WINDOW s AS (PARTITION BY page, line ORDER BY pos)),
        f AS (SELECT * FROM n WHERE NOT (i = 1 AND nx0 IS NOT NULL AND length(text) <= 1 AND greatest(0, greatest(x0, nx0) - least(x1, nx1)) >= 40)),
        m AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY pos DESC) AS j, lag(x0) OVER s AS qx0, lag(x1) OVER s AS qx1 FROM f WINDOW s AS (PARTITION BY page, line ORDER BY pos))
        SELECT page, count(*) AS words FROM m WHERE NOT (j = 1 AND qx0 IS NOT NULL AND length(text) <= 1 AND greatest(0, greatest(x0, qx0) - least(x1, qx1)) >= 40) GROUP BY page"""
)
def w9_trim_edges(spark, sf_dir):
    rows = layout.trim_edges(boxes(spark, sf_dir), ["page", "line"], F.length("text"))
    return rows.groupBy("page").agg(F.count(F.lit(1)).alias("words"))


@query(
    """SELECT conv_id, count(*) FILTER (cells AND NOT coalesce(before, false)) AS tables FROM (SELECT *, lag(cells) OVER (PARTITION BY conv_id ORDER BY turn) AS before
       FROM (SELECT conv_id, turn, len(string_split(text, chr(10))) >= 2 AS cells FROM conversations)) GROUP BY conv_id"""
)
def w13_tables(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("turn", "line")
    return layout.table_runs(turns, "conv_id", F.size(F.split("text", "\n")) >= 2)


@query(
    f"""WITH {BOXES}, l AS (SELECT page, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page, line)
        SELECT a.page, count(*) AS pairs, count(*) FILTER (greatest(0, least(a.y1, b.y1 + 15) - greatest(a.y0, b.y0 - 15)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0 + 30)) > 0.4
          AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(1, least(a.x1 - a.x0, b.x1 - b.x0)) > 0.3) AS conflicts
        FROM l a JOIN l b ON a.page = b.page WHERE least(a.y1, b.y1 + 15) > greatest(a.y0, b.y0 - 15) GROUP BY a.page"""
)
def j7_box_overlap(spark, sf_dir):
    lines = layout.line_boxes(boxes(spark, sf_dir), "page", "line").drop("text", "conf")
    grown = lines.withColumns({"y0": F.col("y0") - 15, "y1": F.col("y1") + 15})
    pairs = layout.box_overlap(lines, grown, "page")
    return pairs.groupBy("page").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(layout.conflict()).alias("conflicts"))


@query(
    """WITH chars AS (SELECT doc_id, unnest(range(length(text))) AS pos, unnest(string_split(text, '')) AS c FROM documents),
       islands AS (SELECT doc_id, c, pos, pos - row_number() OVER (PARTITION BY doc_id, c ORDER BY pos) AS g FROM chars),
       runs AS (SELECT doc_id, c, min(pos) AS pos, count(*) AS run FROM islands GROUP BY doc_id, c, g)
       SELECT doc_id, arg_min(c, (-run, pos)) AS char, max(run)::INT AS run FROM runs GROUP BY doc_id"""
)
def w2_longest_run(spark, sf_dir):
    return layout.longest_run(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(edits.OTHER["w3_phrase_loop"])
def w3_phrase_loop(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", layout.phrase_loop(F.col("text")).alias("loop"))
    return rows.filter("loop >= 60")


@query(
    f"""WITH {BOXES} SELECT page, line, round_even(sum(CASE WHEN conf >= 40 THEN length(text) * (conf / 100) * (conf / 100) ELSE 0 END), 6) AS score FROM boxes GROUP BY page, line"""
)
def c5_line_score(spark, sf_dir):
    rows = layout.line_score(boxes(spark, sf_dir).withColumn("key", F.col("text")), "page", "line")
    return rows.select("page", "line", F.bround("score", 6).alias("score"))


@query()
def c6_select_readings(spark, sf_dir):
    """Two readings of every line: the whole of it and its pieces between wide gaps."""
    b = boxes(spark, sf_dir).withColumn("key", F.col("text"))
    halves = layout.segments(b, ["page", "line"], F.lit(True)).withColumn("cand", F.format_string("%d.%d", "line", "segment"))
    words = b.withColumn("cand", F.format_string("%d", "line")).unionByName(halves.select(*b.columns, "cand"))
    box = words.groupBy("page", "cand").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    chosen = layout.select_readings(layout.line_score(words, "page", "cand").join(box, ["page", "cand"]), "page")
    return chosen.select("page", "cand", "row", F.bround("score", 6).alias("score"))


@query(
    f"""WITH {BOXES} SELECT page, least(70.0::DOUBLE, greatest(35.0::DOUBLE, list_sort(list(conf))[least(count(*), count(*) // 2 + 1)]::DOUBLE - 20)) AS floor FROM boxes GROUP BY page"""
)
def a32_unread_floor(spark, sf_dir):
    return layout.unread_floor(boxes(spark, sf_dir), "page")


@query(
    f"""WITH {BOXES} SELECT page, line, arg_min(text, (-conf, pos)) AS text, max(conf)::DOUBLE AS conf FROM boxes GROUP BY page, line"""
)
def c9_best_reading(spark, sf_dir):
    return layout.best_reading(boxes(spark, sf_dir).select("page", "line", "pos", "text", "conf"), ["page", "line"], "conf", "pos").select("page", "line", "text", "conf")


# ---- lexicon -----------------------------------------------------------------------------------

#: Letters that stand for each other in the Latin profile of the dictionary queries.
LATIN_GROUPS = ("eéèê", "aàä", "oóö", "uúü", "nñ", "cç", "iíl")
WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS word FROM {0}"
SKELETON = "translate(word, 'éèêàäóöúüñçíl', 'eeeaaoouuncii')"


def lower_words(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))).alias("word")).distinct()


@query(
    f"""WITH ws AS ({WORDS.format("conversations")}), lex AS ({WORDS.format("benchmark")}), open AS (SELECT word FROM ws WHERE length(word) >= 3 ANTI JOIN lex USING (word)),
        near AS (SELECT o.word, l.word AS c FROM (SELECT word, {SKELETON} AS s FROM open) o JOIN (SELECT word, {SKELETON} AS s FROM lex) l ON o.s = l.s AND length(o.word) = length(l.word)
          AND len(list_filter(range(1, length(o.word) + 1), lambda i: o.word[i] <> l.word[i])) = 1),
        moved AS (SELECT word, min(c) AS fix FROM near GROUP BY word HAVING count(*) = 1),
        cut AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS c FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM open WHERE length(word) >= 4)),
        single AS (SELECT cut.word, min(c) AS fix FROM cut JOIN lex ON c = lex.word GROUP BY cut.word HAVING count(*) = 1)
        SELECT word, coalesce(m.fix, s.fix, word) AS fixed, CASE WHEN m.fix IS NOT NULL THEN 'moved' WHEN s.fix IS NOT NULL THEN 'single' ELSE 'kept' END AS rule
        FROM ws LEFT JOIN moved m USING (word) LEFT JOIN single s USING (word)""".replace("WHERE length(word) >= 3 ANTI JOIN lex USING (word)", "ANTI JOIN lex USING (word) WHERE length(word) >= 3")
)
def j13_skeleton_fix(spark, sf_dir):
    return lexicon.repair(lower_words(table(spark, sf_dir, "conversations")), lower_words(table(spark, sf_dir, "benchmark")), LATIN_GROUPS)


@query(
    f"""WITH ws AS ({WORDS.format("conversations")}), lex AS ({WORDS.format("benchmark")}), open AS (SELECT word FROM ws ANTI JOIN lex USING (word) WHERE length(word) >= 3),
        cut AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS c FROM (SELECT word, unnest(range(1, length(word))) AS i FROM open) WHERE word[i] = word[i + 1])
        SELECT cut.word, min(c) AS fix FROM cut JOIN lex ON c = lex.word GROUP BY cut.word HAVING count(*) = 1"""
)
def c2_doubled_letters(spark, sf_dir):
    return lexicon.doubled_letters(lower_words(table(spark, sf_dir, "conversations")), lower_words(table(spark, sf_dir, "benchmark")))


@query(edits.OTHER["c1_edit_one"])
def c1_edit_one(spark, sf_dir):
    return lexicon.edit_one(lower_words(table(spark, sf_dir, "conversations")), lower_words(table(spark, sf_dir, "benchmark")))


@query(
    f"""WITH ws AS ({WORDS.format("documents")}), lex AS ({WORDS.format("benchmark")}) SELECT count(*) AS words, count(lex.word) AS known FROM ws LEFT JOIN lex USING (word)"""
)
def j12_membership(spark, sf_dir):
    lex = lower_words(table(spark, sf_dir, "benchmark")).withColumn("known", F.lit(1))
    rows = lower_words(table(spark, sf_dir, "documents")).join(lex, "word", "left")
    return rows.agg(F.count(F.lit(1)).alias("words"), F.count("known").alias("known"))


@query("SELECT l_partkey AS id, arg_min(l_comment, k) AS word FROM (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS k, l_returnflag || l_linestatus || l_linenumber AS l_comment FROM lineitem) GROUP BY l_partkey")
def io6_first_per_id(spark, sf_dir):
    """Rows of equal keys stand in the table's own order: that of its files, then of the rows in a file."""
    word, key = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"), word.alias("word"), F.when(word.isNotNull(), key).alias("k"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")
    )
    return lexicon.first_per_id(rows, "k", "file", "at").select("id", "word")


@query(edits.OTHER["a26_arms"])
def a26_arms(spark, sf_dir):
    """Tokens that each correction arm changes in the turns, and whether the next turn's words bear it out."""
    turns = table(spark, sf_dir, "conversations")
    lex = lower_words(table(spark, sf_dir, "benchmark"))
    ws = lower_words(turns)
    arms = lexicon.edit_one(ws, lex).withColumn("arm", F.lit("edit one")).unionByName(lexicon.doubled_letters(ws, lex).withColumn("arm", F.lit("doubled")))
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))
    rows = turns.select("conv_id", "turn", found.alias("ws")).withColumn("ref", F.lead("ws").over(Window.partitionBy("conv_id").orderBy("turn")))
    # Corrected words are neighbours of lexicon words, so they are few whatever the turns; every word of a turn carries all of the next one.
    changed = rows.filter("ref is not null").select("ref", F.explode("ws").alias("word")).join(F.broadcast(arms), "word")
    effect = lexicon.change_effect(F.col("word"), F.col("fix"), F.col("ref"))
    return changed.groupBy("arm").agg(
        F.count(F.lit(1)).alias("changed"), *(F.count_if(effect == k).alias(k) for k in ("helpful", "harmful", "neutral"))
    )


# ---- ledger, top-k, streaming shapes -----------------------------------------------------------

DAYS = "days AS (SELECT ts::DATE AS day, avg(value) AS mean, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_rate FROM events GROUP BY 1)"


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.avg("value").alias("mean"), F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("error_rate")
    )


@query(
    f"""WITH {DAYS} SELECT day, round_even(mean - lag(mean) OVER (ORDER BY day), 4) AS d_mean, round_even(error_rate - lag(error_rate) OVER (ORDER BY day), 4) AS d_error_rate FROM days"""
)
def j15_run_compare(spark, sf_dir):
    rows = days(spark, sf_dir).withColumn("corpus", F.lit("events"))
    return ledger.compare_runs(rows, "day", ["mean", "error_rate"], ["corpus"]).select("day", "d_mean", "d_error_rate")


@query(
    f"""WITH {DAYS}, b AS (SELECT day, mean, min(mean) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (ORDER BY day) AS n FROM days),
        f AS (SELECT *, before IS NULL OR mean < before AS is_best FROM b)
        SELECT day, round_even(mean, 6) AS mean, is_best, (n - max(CASE WHEN is_best THEN n END) OVER (ORDER BY day))::INT AS worse_runs FROM f"""
)
def w14_best_so_far(spark, sf_dir):
    rows = ledger.best_so_far(days(spark, sf_dir).withColumn("run", F.lit(1)), "mean", "day", "run")
    return rows.select("day", F.bround("mean", 6).alias("mean"), "is_best", "worse_runs")


@query(f"WITH {DAYS} SELECT arg_min(day, (mean, day)) AS day, round_even(min(mean), 6) AS mean FROM days")
def a35_best_run(spark, sf_dir):
    return ledger.best_row(days(spark, sf_dir), "mean", "day").select("day", F.bround("mean", 6).alias("mean"))


@query(
    """SELECT name, round_even(value, 4) AS value, value - base <= 0.5 AS passed FROM (SELECT event_type AS name, avg(value) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
       JOIN (SELECT event_type AS name, avg(value) AS base FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) USING (name)"""
)
def a37_gate(spark, sf_dir):
    """Later events against the earlier ones."""
    e = table(spark, sf_dir, "events")
    means = lambda late, name: e.filter((F.col("ts") >= "2024-01-15") == F.lit(late)).groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias(name))
    return ledger.gate(means(True, "value"), means(False, "base"), F.lit(0.5), F.lit(False)).select("name", F.bround("value", 4).alias("value"), "passed")


@query(
    f"""WITH {FIELDS} SELECT doc, field, round_even(edits / gt_len, 6) AS cer FROM scored WHERE outcome = 'scored' ORDER BY edits / gt_len DESC, doc, field LIMIT 15"""
)
def s1_worst15(spark, sf_dir):
    rows = fields_of(spark, sf_dir).filter("has_gt and gt <> '' and pred <> ''").withColumn("c", distance.cer(F.col("gt"), F.col("pred")))
    return rows.orderBy(F.desc("c"), "doc", "field").limit(15).select("doc", "field", F.bround("c", 6).alias("cer"))


@query(
    """SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS word FROM benchmark) GROUP BY word) ORDER BY n DESC, word LIMIT 30"""
)
def s2_most_common(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(30)


@query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 8")
def s3_examples(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    return lexicon.top_examples(rows, ["lang"], [F.desc("n_chars"), F.asc("doc_id")], 8)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 500")
def w15_newest(spark, sf_dir):
    return ledger.newest(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", 500, "event_id")


ALPHABET = "SELECT DISTINCT unnest(string_split(text, '')) AS c FROM {0}"


@query(f"SELECT c FROM ({ALPHABET.format('documents')}) EXCEPT SELECT c FROM ({ALPHABET.format('benchmark')})")
def u1_added_alphabet(spark, sf_dir):
    chars = lambda n: table(spark, sf_dir, n).select(F.explode(F.array_distinct(F.array_remove(F.split("text", ""), ""))).alias("c"))
    return chars("documents").distinct().join(chars("benchmark"), "c", "left_anti")


@query("SELECT word, a.n - coalesce(b.n, 0) AS missing FROM (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS word FROM benchmark) GROUP BY word) a LEFT JOIN (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS word FROM conversations) GROUP BY word) b USING (word) WHERE a.n > coalesce(b.n, 0)")
def u5_multiset_difference(spark, sf_dir):
    count = lambda n, c: table(spark, sf_dir, n).select(F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias(c))
    rows = count("benchmark", "a").join(count("conversations", "b"), "word", "left").withColumn("missing", F.col("a") - F.coalesce("b", F.lit(0)))
    return rows.filter("missing > 0").select("word", "missing")


@query(
    """SELECT user_id AS job_id, CASE state WHEN 'QUEUED' THEN 'queued' WHEN 'STARTED' THEN 'running' WHEN 'SUCCESS' THEN 'done' WHEN 'PENDING' THEN '404' ELSE 'failed' END AS status FROM (
         SELECT user_id, arg_max(CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'click' THEN 'STARTED' WHEN 'purchase' THEN 'SUCCESS' WHEN 'view' THEN 'PENDING' ELSE 'FAILURE' END, (ts, event_id)) AS state
         FROM events GROUP BY user_id)"""
)
def q3_job_status(spark, sf_dir):
    from verso.streaming import jobs

    names = {"signup": "QUEUED", "click": "STARTED", "purchase": "SUCCESS", "view": "PENDING"}
    state = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("event_type")), F.lit("FAILURE"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), state.alias("state"), "ts", F.col("event_id").alias("seq"))
    return jobs.current_status(events).select("job_id", "status")


@query("SELECT page_id, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def io3_salvage_markup(spark, sf_dir):
    """Pages as JSON objects that are cut off behind the fields that are wanted."""
    from verso.sources import readers

    part = lambda pattern: F.regexp_extract("html", pattern, 1)
    raw = F.concat(F.to_json(F.struct(part('lang="([a-z]+)"').alias("lang"), part("<title>([^<]*)</title>").alias("title"))), F.lit(', "body": "cut o'))
    found = readers.salvage(raw, "lang", "title")
    return table(spark, sf_dir, "pages").select("page_id", *(v.alias(k) for k, v in found.items()))


@query(
    """SELECT sentence, count(*) AS n FROM (SELECT trim(unnest(regexp_split_to_array(l, '[.؛]'))) AS sentence FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents))
       WHERE length(sentence) BETWEEN 12 AND 90 GROUP BY sentence"""
)
def io10_sentences(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("l"))
    rows = lines.select(F.explode(F.transform(F.split("l", "[.؛]"), lambda x: F.trim(x))).alias("sentence")).filter(F.length("sentence").between(12, 90))
    return rows.groupBy("sentence").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT page_id, sha256(html) AS sha256, strlen(html) AS bytes, 't_' || substr(sha1(regexp_extract(html, '<title>([^<]*)</title>', 1)), 1, 8) AS template_id FROM pages"""
)
def io14_manifest(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"), F.concat(F.lit("t_"), F.substring(F.sha1(title), 1, 8)).alias("template_id")
    )


@query(
    """SELECT conv_id, turn, contains(trim(regexp_replace(next, '[^\\p{L}\\p{N}]+', ' ', 'g')), trim(regexp_replace(head, '[^\\p{L}\\p{N}]+', ' ', 'g'))) AS on_page FROM (
         SELECT conv_id, turn, string_split(text, ' ')[1] AS head, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE next IS NOT NULL"""
)
def pf15_on_page(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return turns.filter("next is not null").select("conv_id", "turn", text.contained(F.element_at(F.split("text", " "), 1), F.col("next")).alias("on_page"))


@query(
    """SELECT conv_id, list_sort(list_filter([CASE WHEN short > 0 THEN 'short turn' END, CASE WHEN n < 4 THEN 'few turns' END, CASE WHEN digits > 0 THEN 'digits' END], lambda x: x IS NOT NULL)) AS reasons
       FROM (SELECT conv_id, count(*) FILTER (length(text) < 40) AS short, count(*) AS n, count(*) FILTER (regexp_matches(text, '[0-9]')) AS digits FROM conversations GROUP BY conv_id)"""
)
def pf11_review_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(F.length("text") < 40).alias("short"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").rlike("[0-9]")).alias("digits")
    )
    reasons = audit.review_reasons({"short turn": F.col("short") > 0, "few turns": F.col("n") < 4, "digits": F.col("digits") > 0})
    return rows.select("conv_id", F.array_sort(reasons).alias("reasons"))


# ---- transcripts, numbers, letters -------------------------------------------------------------


def turn_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Fields (doc, field, gt): the lines of a turn; transcripts (doc, text): the next turn of the conversation."""
    t = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    t = t.filter("next is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text", "next")
    fields = t.select("doc", F.posexplode(F.split("text", "\n")).alias("i", "gt")).filter("gt <> ''")
    return fields.select("doc", F.format_string("f%03d", "i").alias("field"), "gt"), t.select("doc", F.col("next").alias("text"))


@query(edits.of_turns(ATOMS)["a20_coverage"])
def a20_coverage(spark, sf_dir):
    from verso.operators import fulltext

    return fulltext.coverage(fulltext.score_documents(*turn_pages(spark, sf_dir)))


@query(edits.of_turns(ATOMS)["k4_unsupported_lines"])
def k4_unsupported_lines(spark, sf_dir):
    from verso.operators import fulltext

    fields, pages = turn_pages(spark, sf_dir)
    lines = fields.select(F.col("doc").alias("page"), F.col("field").alias("line"), F.col("gt").alias("text"))
    return fulltext.unsupported_lines(lines, pages.select(F.col("doc").alias("page"), F.col("text").alias("page_text")))


@query(
    f"""WITH a AS (SELECT doc_id AS doc, unnest({ATOMS}) AS item FROM documents), b AS (SELECT doc_id AS doc, unnest(regexp_extract_all(text, '\\d{{3,}}')) AS item FROM documents),
        ca AS (SELECT doc, item, count(*) AS n FROM a GROUP BY ALL), cb AS (SELECT doc, item, count(*) AS n FROM b GROUP BY ALL)
        SELECT length(item) AS n_digits, sum(ca.n)::BIGINT AS n, sum(least(ca.n, coalesce(cb.n, 0)))::BIGINT AS hit, round_even(sum(least(ca.n, coalesce(cb.n, 0))) / sum(ca.n), 4) AS recall
        FROM ca LEFT JOIN cb USING (doc, item) GROUP BY 1"""
)
def a25_recall_by_length(spark, sf_dir):
    from verso.operators import fulltext

    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "doc")
    truth = docs.select("doc", F.explode(values.atoms(F.col("text"))).alias("item"))
    found = docs.select("doc", F.explode(F.regexp_extract_all("text", F.lit(r"\d{3,}"), F.lit(0))).alias("item"))
    return fulltext.recall_by_length(truth, found)


@query(
    f"""WITH {FIELDS} SELECT source, sum(CASE WHEN has_gt AND coalesce(gt, '') <> '' THEN levenshtein(gt, coalesce(pred, '')) END)::BIGINT AS edits,
        sum(CASE WHEN has_gt AND coalesce(gt, '') <> '' THEN length(gt) END)::BIGINT AS chars, count(*) FILTER (coalesce(gt, '') = '' AND coalesce(pred, '') <> '') AS spurious
        FROM fields GROUP BY source"""
)
def a23_field_cer(spark, sf_dir):
    from verso.operators import fulltext

    rows = fields_of(spark, sf_dir)
    v = fulltext.field_cer(F.col("gt"), F.col("pred"))
    rows = rows.select("source", "has_gt", *(c.alias(k) for k, c in v.items()))
    return rows.groupBy("source").agg(
        F.sum(F.when(F.col("has_gt"), F.col("edits"))).cast("long").alias("edits"),
        F.sum(F.when(F.col("has_gt"), F.col("chars"))).cast("long").alias("chars"),
        F.count_if("spurious").alias("spurious"),
    )


@query(edits.of_conversations(CONV)["a28_placement"])
def a28_placement(spark, sf_dir):
    from verso.operators import fulltext

    rows = conversation_fields(spark, sf_dir).filter("has_gt and gt <> ''")
    content = conversation_fields(spark, sf_dir).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", "pred"))), lambda x: x["pred"]), " ").alias("content"))
    return fulltext.placement(rows.join(content, "doc"), "field")


@query()
def a10_confusion(spark, sf_dir):
    return scoring.confusion(scoring.assignments(scoring.outcomes(conversation_fields(spark, sf_dir))))


@query()
def j11_number_match(spark, sf_dir):
    """Numbers of a document against the digit strings of its lines, with a verdict for each."""
    from verso.operators import numerals

    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "page")
    spans = docs.select("page", F.posexplode(values.numeric_spans(F.col("text"))).alias("span", "value"))
    words = docs.select("page", F.explode(F.regexp_extract_all("text", F.lit(r"\d{4,}"), F.lit(0))).alias("text"))
    found = numerals.best_words(spans, words, "page").withColumn("confidence", numerals.verdict(F.col("value"), F.col("match")))
    return numerals.verdict_summary(found.withColumn("kind", values.numeric_kind(F.col("value"))), "kind")


@query(
    f"""WITH RECURSIVE {NUMBERS}, w AS (SELECT page, text, conf::DOUBLE AS conf, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1, regexp_matches(text, '[0-9]') AS digit,
          row_number() OVER (PARTITION BY page ORDER BY y0 // 20, x0, x1, y0, text, conf) AS n FROM numbers WHERE regexp_full_match(text, '[0-9./,() -]+')),
        run AS (SELECT *, n AS first FROM w WHERE digit
          UNION ALL SELECT r.page, r.text || w.text, least(r.conf, w.conf), least(r.x0, w.x0), least(r.y0, w.y0), greatest(r.x1, w.x1), greatest(r.y1, w.y1), w.digit, w.n, r.first
          FROM run r JOIN w ON w.page = r.page AND w.n = r.n + 1 AND w.n < r.first + 8 AND abs(w.y0 - r.y0) < greatest(r.y1 - r.y0, 12)
            AND (w.x0 - r.x1 BETWEEN 0 AND 40 OR r.x0 - w.x1 BETWEEN 0 AND 40) AND (w.digit OR regexp_full_match(w.text, '[,./\\-،٫٬ ]*')))
        SELECT page, text, conf, x0, y0, x1, y1 FROM w UNION ALL SELECT page, text, conf, x0, y0, x1, y1 FROM run WHERE digit AND n > first"""
)
def v7_merged_words(spark, sf_dir):
    from verso.operators import numerals

    words = number_boxes(spark, sf_dir).filter(F.col("text").rlike(r"^[\d./,() -]+$")).select("page", "text", "conf", "x0", "y0", "x1", "y1")
    return numerals.merge_neighbours(words, "page")


@query(
    f"""WITH {BOXES}, l AS (SELECT page, line, max(y1) - min(y0) AS h, (min(y0) + max(y1)) / 2 AS c FROM boxes GROUP BY page, line),
        p AS (SELECT page, quantile_cont(h, 0.8) AS p FROM l GROUP BY page)
        SELECT page, greatest(median(h), 1.0)::DOUBLE AS ref_h, median(c)::DOUBLE AS centre FROM l JOIN p USING (page) WHERE h BETWEEN p * 0.5 AND p * 2 GROUP BY page"""
)
def a34_line_context(spark, sf_dir):
    return layout.line_context(layout.line_boxes(boxes(spark, sf_dir), "page", "line"), "page")


@query(
    f"""WITH {BOXES}, c AS (SELECT page, 4 + (length(text) * 7 + pos) % 60 AS h, length(text) * 15 AS area FROM boxes),
        base AS (SELECT * FROM c WHERE area >= 20 AND h > 800 * 0.004), wide AS (SELECT * FROM base WHERE h <= 800 * 0.3),
        q AS (SELECT page, quantile_cont(h, 0.75) AS q, count(*) AS n FROM wide GROUP BY page),
        r AS (SELECT page, median(h) AS r, any_value(n) AS n FROM wide JOIN q USING (page) WHERE h >= q * 0.5 GROUP BY page),
        m AS (SELECT page, median(h) AS m, count(*) AS k FROM base WHERE h < 800 * 0.05 GROUP BY page)
        SELECT page, (CASE WHEN n < 3 THEN 0.0 WHEN k >= 5 AND m >= 0.4 * r THEN m ELSE r END)::DOUBLE AS height FROM r LEFT JOIN m USING (page)"""
)
def a33_robust_height(spark, sf_dir):
    n = F.length("text")
    comps = boxes(spark, sf_dir).select("page", ((n * 7 + F.col("pos")) % 60 + 4).alias("h"), (n * 15).alias("area"), F.lit(800).alias("page_h"))
    return layout.robust_height(comps, "page", "page_h")


@query(
    f"""WITH {BOXES}, p AS (SELECT page, line AS y FROM boxes GROUP BY page, line HAVING sum(length(text)) > 40), g AS (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS g FROM p)
        SELECT page, min(y)::INT AS start, (max(y) + 1)::INT AS stop FROM g GROUP BY page, g"""
)
def w11_islands(spark, sf_dir):
    profile = boxes(spark, sf_dir).groupBy("page", F.col("line").alias("y")).agg(F.sum(F.length("text")).alias("ink"))
    return layout.islands(profile, "page", F.col("ink") > 40)


@query(
    f"""WITH {BOXES}, a AS (SELECT *, min(CASE WHEN text LIKE '%:' THEN pos END) OVER l AS label_at, count(*) OVER l AS n FROM boxes WINDOW l AS (PARTITION BY page, line)),
        b AS (SELECT *, conf < 30 OR coalesce(pos > label_at AND conf < 90, false) AS u FROM a), c AS (SELECT *, lag(u, 1, false) OVER (PARTITION BY page, line ORDER BY pos) AS before FROM b),
        d AS (SELECT *, sum(CASE WHEN u <> before THEN 1 ELSE 0 END) OVER (PARTITION BY page, line ORDER BY pos) AS run FROM c),
        e AS (SELECT *, count(*) OVER r AS size, max(length(text)) OVER r AS long, min(pos) OVER r AS first FROM d WINDOW r AS (PARTITION BY page, line, run))
        SELECT page, kind, count(*) AS words FROM (SELECT page, CASE WHEN NOT u THEN NULL WHEN first > label_at THEN 'handwritten' WHEN long <= 3 AND (size >= 2 OR size = n) THEN 'illegible' END AS kind FROM e)
        WHERE kind IS NOT NULL GROUP BY page, kind"""
)
def w12_unread_runs(spark, sf_dir):
    rows = boxes(spark, sf_dir).withColumn("key", F.col("text"))
    runs = layout.unread_runs(rows, ["page", "line"], F.col("conf") < 30, F.col("text").endswith(":"))
    return runs.filter("kind is not null").groupBy("page", "kind").agg(F.count(F.lit(1)).alias("words"))


@query(
    f"""WITH {SEGMENTS}, p AS (SELECT page, line, segment AS piece, string_agg(text, ' ' ORDER BY pos) AS text, max(x1) AS x1, sum(CASE WHEN conf >= 40 THEN length(text) * (conf / 100) * (conf / 100) ELSE 0 END) AS score
          FROM cut GROUP BY page, line, segment),
        pairs AS (SELECT a.page, a.line, a.piece, string_split(a.text, '') AS ta, string_split(b.text, '') AS tb FROM p a JOIN p b ON a.page = b.page AND a.line = b.line AND (a.score < b.score OR (a.score = b.score AND a.piece > b.piece))),
        worse AS (SELECT DISTINCT page, line, piece FROM pairs WHERE {edits.common_part("ta", "tb")}[1] >= least(len(ta), len(tb)) * 0.6)
        SELECT page, line, string_agg(text, ' ' ORDER BY x1 DESC, text) AS text, round_even(sum(score), 6) AS score FROM p ANTI JOIN worse USING (page, line, piece) GROUP BY page, line"""
)
def c7_joined_rows(spark, sf_dir):
    pieces = layout.segments(boxes(spark, sf_dir).withColumn("key", F.col("text")), ["page", "line"], F.lit(True))
    lines = layout.line_boxes(pieces, "page", "line", "segment").withColumnRenamed("segment", "piece")
    score = layout.line_score(pieces, "page", "line", "segment").withColumnRenamed("segment", "piece")
    kept = layout.drop_duplicate_pieces(lines.join(score, ["page", "line", "piece"]), ["page", "line"])
    return layout.join_rows(kept.drop("conf", "piece"), ["page", "line"]).select("page", "line", "text", F.bround("score", 6).alias("score"))


@query()
def v8_letter_fields(spark, sf_dir):
    from verso.operators import letters

    lines = layout.line_boxes(boxes(spark, sf_dir), "page", "line").select("page", "line", "text", "y0", (F.col("conf") / 100).alias("conf"))
    height = F.max("y0").over(Window.partitionBy("page")) + 100
    return letters.letter_fields(lines.withColumn("page_height", height), "page")


@query()
def v10_synthetic_values(spark, sf_dir):
    """A synthetic value for each turn, to stand for what may not be shown."""
    from verso.functions import generators

    row = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(row.alias("row"), generators.synthetic_value(row).alias("_v")).select("row", "_v.kind", "_v.text")


#: Numbers as a second reader has them, by the place of their word: alike, other digits, in two parts far apart, unsure, in two
#: parts close together, an amount with a group too short, a single digit.
READS = "(line * 3 + pos // 2) % 7"


@query(
    f"""WITH {NUMBERS}, kinds AS (SELECT *, {READS} AS kind, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM numbers WHERE regexp_matches(text, '[0-9]'))
        SELECT page, regexp_extract(text, '^[^0-9]*') || CASE kind WHEN 0 THEN digits ELSE translate(digits, '0123456789', '1234567890') END || regexp_extract(text, '[^0-9]*$') AS text, x0::INT AS x0
        FROM kinds WHERE kind IN (0, 1, 4) AND pos % 2 = 0"""
)
def j8_second_reader(spark, sf_dir):
    """A second reader that differs, stands apart, is unsure, breaks amounts or misses digits: only what it is sure of replaces a number."""
    from verso.operators import numerals

    words = number_boxes(spark, sf_dir).withColumn("kind", (F.col("line") * 3 + F.floor(F.col("pos") / 2)) % 7)
    words = words.withColumn("text", F.when((F.col("kind") == 5) & (F.col("pos") % 2 == 0), "1,234,567").otherwise(F.col("text")))
    digits, kind = values.digits_only(F.col("text")), F.col("kind")
    other = F.translate(digits, "0123456789", "1234567890")
    half, middle = F.floor(F.length(digits) / 2).cast("int"), F.floor((F.col("x0") + F.col("x1")) / 2)
    read = lambda t, x0, x1: F.struct(t.alias("text"), x0.cast("int").alias("x0"), x1.cast("int").alias("x1"))
    parts = lambda t, gap: F.array(read(F.left(t, half), F.col("x0"), middle - gap), read(F.substring(t, half + 1, F.length(t)), middle + gap, F.col("x1")))
    whole = lambda t: F.array(read(t, F.col("x0"), F.col("x1")))
    broken, single = whole(F.lit("1,234,56")), whole(F.left(digits, F.lit(1)))
    reads = F.when(kind == 0, whole(digits)).when(kind == 2, parts(digits, 2)).when(kind == 4, parts(other, 1)).when(kind == 5, broken).when(kind == 6, single).otherwise(whole(other))
    seen = words.filter((digits != "") & (F.col("pos") % 2 == 0)).select("page", F.when(kind == 3, 0.3).otherwise(0.9).alias("prob"), "y0", "y1", F.explode(reads).alias("_r"))
    seen = seen.select("page", "_r.text", "prob", F.lit(10.0).alias("line_h"), F.length(values.digits_only(F.col("_r.text"))).alias("n_digits"), "_r.x0", "y0", "_r.x1", "y1")
    words = words.select("page", "text", "conf", "x0", "y0", "x1", "y1")
    return numerals.replace_numbers(words, seen, "page", 0.5).filter("digit_prob is not null").select("page", "text", "x0")


@query()
def c8_competing_readings(spark, sf_dir):
    """Two models' words of the same lines, a layout pass that reads some lines, and a sparse pass over all."""
    words = boxes(spark, sf_dir).withColumn("key", F.col("text"))
    place = F.col("pos") % 3
    other = F.when(place == 0, F.concat("text", F.lit("é"))).when(place == 1, F.concat("text", F.lit("ü"))).otherwise(F.lit("2-"))
    read = lambda of, text=F.col("text"), conf=F.col("conf"): F.struct(F.lit(of).alias("of"), text.alias("text"), conf.alias("conf"))
    models = [read("native", other, F.when(place == 2, 30.0).otherwise(95.0)), read("foreign"), read("sparse")]
    reads = F.when(F.col("line") % 2 == 0, F.array(*models, read("layout"))).otherwise(F.array(*models))
    # The boxes are made once for all four, which leaves the words of a line where they are.
    words = words.select("page", "line", "pos", "key", "x0", "y0", "x1", "y1", F.explode(reads).alias("_r")).select("*", "_r.of", "_r.text", "_r.conf")
    found = layout.competing_words(words, "page", letter="[à-ÿ]")
    return found.groupBy("page", "reading").agg(F.count(F.lit(1)).alias("words"), F.sum(F.length("text")).alias("chars"))


# ---- more projections, sets and samples --------------------------------------------------------

NEXT = "SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations"


def next_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return t.filter("next is not null")


@query(f"WITH {BOXES} SELECT page, line, bool_or(conf >= 60 AND length(text) >= 2) AND avg(conf) >= 50 AS ok FROM boxes GROUP BY page, line")
def pf7_line_ok(spark, sf_dir):
    return layout.lines_ok(boxes(spark, sf_dir).withColumn("key", F.col("text")), 50, "page", "line")


@query(
    """SELECT doc_id, i AS line, l AS label FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
       WHERE len(ls) BETWEEN 3 AND 60 AND len(list_filter(ls, lambda x: regexp_matches(x, '[#$%&]'))) = 0)"""
)
def pf9_page_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("ls", F.split("text", "\n"))
    rows = rows.filter(F.size("ls").between(3, 60) & ~F.exists("ls", lambda x: x.rlike("[#$%&]")))
    return rows.select("doc_id", F.posexplode("ls").alias("line", "label"))


@query(f"WITH {BOXES} SELECT page, line, max(y1) - min(y0) <= 200 AND (max(x1) - min(x0)) / (max(y1) - min(y0)) >= 6 AS crop FROM boxes GROUP BY page, line")
def pf14_line_crops(spark, sf_dir):
    lines = layout.line_boxes(boxes(spark, sf_dir), "page", "line")
    return lines.select("page", "line", layout.is_line_crop(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("crop"))


@query(
    """SELECT conv_id, list_filter([CASE WHEN turns <> 4 THEN 'turns ' || turns || ' (expected 4)' END, CASE WHEN roles <> 2 THEN 'roles ' || roles || ' (expected 2)' END], lambda x: x IS NOT NULL) AS problems
       FROM (SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles FROM conversations GROUP BY conv_id)"""
)
def pf16_structure(spark, sf_dir):
    actual = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("role").alias("roles"))
    expected = actual.select("conv_id", F.lit(4).alias("turns"), F.lit(2).alias("roles"))
    return layout.structure_report(actual, expected, "conv_id", ["turns", "roles"])


@query(
    f"""WITH {BOXES}, l AS (SELECT page, line, min(x0) AS x0, min(y0) - 15 AS y0, max(x1) AS x1, max(y1) + 15 AS y1, bool_or(regexp_matches(text, '[,.]')) AS marked FROM boxes GROUP BY page, line)
        SELECT a.page, a.line FROM l a WHERE NOT marked AND NOT EXISTS (SELECT 1 FROM l b WHERE b.marked AND a.page = b.page
          AND greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0)) > 0.4
          AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(1, least(a.x1 - a.x0, b.x1 - b.x0)) > 0.3)"""
)
def j10_anti_overlap(spark, sf_dir):
    b = boxes(spark, sf_dir)
    marked = b.groupBy("page", "line").agg(F.max(F.col("text").rlike("[,.]")).alias("marked"))
    lines = layout.line_boxes(b, "page", "line").join(marked, ["page", "line"]).select("page", "line", "x0", (F.col("y0") - 15).alias("y0"), "x1", (F.col("y1") + 15).alias("y1"), "marked")
    return layout.without_overlap(lines.filter("not marked").drop("marked"), lines.filter("marked").drop("marked"), "page", ["line"]).select("page", "line")


@query(
    f"""WITH {BOXES}, l AS (SELECT page, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page, line)
        SELECT a.page, b.line, list(a.text ORDER BY a.x0, a.text) AS tokens FROM boxes a JOIN l b ON a.page = b.page WHERE regexp_full_match(a.text, '[A-Za-z]+')
          AND greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0)) >= 0.5
          AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(1, least(a.x1 - a.x0, b.x1 - b.x0)) >= 0.8 GROUP BY a.page, b.line"""
)
def j9_inserted_tokens(spark, sf_dir):
    b = boxes(spark, sf_dir)
    tokens = b.filter(F.col("text").rlike("^[A-Za-z]+$")).select("page", "text", "x0", "y0", "x1", "y1")
    return layout.insert_tokens(tokens, layout.line_boxes(b, "page", "line").drop("text", "conf"), "page")


@query(
    f"""WITH {NUMBERS} SELECT page, regexp_extract(text, '^[^0-9]*') || regexp_replace(text, '[^0-9]', '', 'g') || regexp_extract(text, '[^0-9]*$') AS text, x0::INT AS x0
        FROM numbers WHERE regexp_matches(text, '[0-9]')"""
)
def j8_replaced_numbers(spark, sf_dir):
    """A second reader that sees the digits of every number word, one word after the other."""
    from verso.operators import numerals

    words = number_boxes(spark, sf_dir).select("page", "text", "conf", "x0", "y0", "x1", "y1")
    digits = values.digits_only(F.col("text"))
    reads = words.withColumn("text", digits).filter("text <> ''").select(
        "page", "text", F.lit(0.9).alias("prob"), F.lit(40.0).alias("line_h"), F.length("text").alias("n_digits"), "x0", "y0", "x1", "y1"
    )
    return numerals.replace_numbers(words, reads, "page", 0.5).filter("digit_prob is not null").select("page", "text", "x0")


@query(
    """SELECT provenance, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'none' WHEN contains(text, CASE WHEN toxic = 1 THEN 'the' ELSE 'zzz' END) THEN 'page' ELSE 'withheld' END AS provenance
       FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY provenance"""
)
def j5_repair(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    notes = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "the").otherwise("zzz").alias("note"))
    rows = audit.repair(docs.select("doc_id", "lang"), notes, docs.select("doc_id", "text"), "doc_id", "note", lambda v, page: F.contains(page, v))
    return rows.groupBy("provenance").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT conv_id, turn, len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) AS changed
        FROM (SELECT conv_id, turn, string_split(text, ' ') AS a, string_split(next, ' ') AS b FROM ({NEXT}) WHERE next IS NOT NULL)"""
)
def j14_diff_tokens(spark, sf_dir):
    return next_turns(spark, sf_dir).select("conv_id", "turn", F.size(text.differing_tokens(F.split("text", " "), F.split("next", " "))).cast("long").alias("changed"))


@query()
def k7_matching_ratio(spark, sf_dir):
    return next_turns(spark, sf_dir).select("conv_id", "turn", F.round(distance.matching_ratio(F.col("text"), F.col("next")), 9).alias("ratio"))


@query(edits.of_turns(ATOMS)["k6_common_substring"])
def k6_common_substring(spark, sf_dir):
    return next_turns(spark, sf_dir).select("conv_id", "turn", distance.longest_common_substring(F.col("text"), F.col("next")).alias("common"))


@query(
    f"""SELECT word, len(list_distinct(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)))) AS deletions,
        len(list_distinct(list_transform(list_filter(range(1, length(word)), lambda i: word[i] = word[i + 1]), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)))) AS doubled
        FROM ({WORDS.format("conversations")})"""
)
def k8_candidates(spark, sf_dir):
    return lower_words(table(spark, sf_dir, "conversations")).select(
        "word", F.size(distance.deletions(F.col("word"))).cast("long").alias("deletions"), F.size(distance.doubled_deletions(F.col("word"))).cast("long").alias("doubled")
    )


@query(f"SELECT {SKELETON} AS skeleton, count(*) AS words FROM ({WORDS.format('documents')}) GROUP BY 1")
def f5_skeletons(spark, sf_dir):
    rows = lower_words(table(spark, sf_dir, "documents"))
    return rows.groupBy(text.fold_groups(F.col("word"), LATIN_GROUPS).alias("skeleton")).agg(F.count(F.lit(1)).alias("words"))


@query(
    """SELECT script, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(c, '^\\s') THEN 'space' WHEN regexp_matches(c, '^[A-Za-z]') THEN 'latin' WHEN regexp_matches(c, '^\\p{Nd}') THEN 'digit'
       WHEN regexp_matches(c, '^\\p{P}') THEN 'punct' ELSE 'other' END AS script FROM (SELECT unnest(string_split(text, '')) AS c FROM documents)) GROUP BY script"""
)
def f6_scripts(spark, sf_dir):
    chars = table(spark, sf_dir, "documents").select(F.explode(F.array_remove(F.split("text", ""), "")).alias("c"))
    counts = chars.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy(text.script_of(F.col("c")).alias("script")).agg(F.sum("k").alias("n"))


@query("SELECT doc_id, sha256(array_to_string(regexp_extract_all(text, '[A-Za-z0-9]+'), ' ')) AS latin, sha256(array_to_string(regexp_extract_all(text, '[éèêçñßäöü]+'), ' ')) AS other FROM documents")
def f12_reference_runs(spark, sf_dir):
    run = lambda c: F.sha2(text.runs_of(F.col("text"), c), 256)
    return table(spark, sf_dir, "documents").select("doc_id", run("[A-Za-z0-9]").alias("latin"), run("[éèêçñßäöü]").alias("other"))


@query("SELECT doc_id, len(list_distinct(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS n FROM documents")
def f13_token_sets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(text.tokens(F.col("text")))).cast("long").alias("n"))


@query("SELECT doc_id, sha256(string_split(text, chr(10))[1]) AS head, length(text) - length(string_split(text, chr(10))[1]) - (CASE WHEN contains(text, chr(10)) THEN 1 ELSE 0 END) AS rest FROM documents")
def f15_head_and_rest(spark, sf_dir):
    head, rest = text.head_and_rest(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(head, 256).alias("head"), F.length(rest).cast("long").alias("rest"))


@query("SELECT kind, count(*) AS n, count(*) FILTER (high) AS high FROM (SELECT length(d) > 8 AS high, CASE WHEN length(d) >= 6 THEN 'long' ELSE 'short' END AS kind FROM (SELECT regexp_replace(unnest(regexp_extract_all(text, '(?:IR)?[0-9](?:[0-9,./\\-]*[0-9])?')), '\\D', '', 'g') AS d FROM documents) WHERE length(d) >= 3) GROUP BY kind")
def v6_numeric_spans(spark, sf_dir):
    spans = table(spark, sf_dir, "documents").select(F.explode(values.numeric_spans(F.col("text"))).alias("v")).select(F.length(values.digits_only(F.col("v"))).alias("n"))
    return spans.groupBy(F.when(F.col("n") >= 6, "long").otherwise("short").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n") > 8).alias("high"))


@query("SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM benchmark")
def io7_vocabulary(spark, sf_dir):
    return lexicon.vocabulary(table(spark, sf_dir, "benchmark").select(F.lower("text").alias("word_norm")))


@query("SELECT doc_id, lang FROM documents ORDER BY sha256('s' || doc_id), doc_id LIMIT 40")
def io8_sampled_lookup(spark, sf_dir):
    """A seeded sample of identifiers, looked up by a semi join."""
    docs = table(spark, sf_dir, "documents")
    ids = docs.select("doc_id").orderBy(F.sha2(F.concat(F.lit("s"), F.col("doc_id").cast("string")), 256), "doc_id").limit(40)
    return docs.select("doc_id", "lang").join(ids, "doc_id", "left_semi")


@query(f"WITH {BOXES} SELECT page, line, pos, row_number() OVER (PARTITION BY page ORDER BY (y0 + y1) / 2, x1 DESC, pos) AS place FROM boxes")
def s4_reading_order(spark, sf_dir):
    order = Window.partitionBy("page").orderBy((F.col("y0") + F.col("y1")) / 2, F.desc("x1"), "pos")
    return boxes(spark, sf_dir).select("page", "line", "pos", F.row_number().over(order).alias("place"))


@query("SELECT c FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents UNION SELECT DISTINCT unnest(string_split(text, '')) FROM conversations)")
def u2_alphabet_union(spark, sf_dir):
    chars = lambda n: table(spark, sf_dir, n).select(F.explode(F.array_distinct(F.array_remove(F.split("text", ""), ""))).alias("c"))
    return chars("documents").unionByName(chars("conversations")).distinct()


@query("SELECT text FROM documents INTERSECT SELECT text FROM conversations")
def u3_intersection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("text").intersect(table(spark, sf_dir, "conversations").select("text"))


@query("SELECT pass, count(*) AS n FROM (SELECT 'a' AS pass FROM documents UNION ALL SELECT 'b' FROM conversations) GROUP BY pass")
def u4_candidates(spark, sf_dir):
    each = lambda n, p: table(spark, sf_dir, n).select(F.lit(p).alias("pass"))
    return each("documents", "a").unionByName(each("conversations", "b")).groupBy("pass").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id, CASE WHEN b > a THEN 'second' ELSE 'first' END AS reading FROM (SELECT doc_id, len(regexp_extract_all(text, '[a-m]')) AS a, len(regexp_extract_all(text, '[n-z]')) AS b FROM documents)"""
)
def c10_better_reading(spark, sf_dir):
    reading = lambda name, c: F.struct(F.lit(name).alias("name"), text.count_of(F.col("text"), c).alias("mass"))
    return table(spark, sf_dir, "documents").select("doc_id", layout.better_reading(reading("first", "[a-m]"), reading("second", "[n-z]"))["name"].alias("reading"))


@query(
    """SELECT date_trunc('hour', ts) AS hour, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'view' THEN '404' ELSE 'failed' END AS status, count(*) AS n
       FROM events GROUP BY ALL"""
)
def q2_status_counts(spark, sf_dir):
    from verso.streaming import jobs

    names = {"signup": "QUEUED", "click": "STARTED", "purchase": "SUCCESS", "view": "PENDING"}
    state = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("event_type")), F.lit("FAILURE"))
    counts = jobs.status_counts(table(spark, sf_dir, "events").select("ts", state.alias("state")))
    return counts.select(F.col("window.start").alias("hour"), "status", "n")


@query(
    f"""SELECT conv_id, turn, round_even(levenshtein(a, b) / greatest(length(a), 1), 4) AS cer, length(a) AS gt_chars, length(b) AS pred_chars, round_even(length(b) / greatest(length(a), 1), 3) AS len_ratio
        FROM (SELECT conv_id, turn, {PLAIN.format("text")} AS a, {PLAIN.format("next")} AS b FROM ({NEXT}) WHERE next IS NOT NULL)"""
)
def a24_page_score(spark, sf_dir):
    from verso.operators import fulltext

    rows = next_turns(spark, sf_dir).select("conv_id", "turn", plain(F.col("text")).alias("a"), plain(F.col("next")).alias("b"))
    score = fulltext.page_score(F.col("a"), F.col("b"))
    return rows.select("conv_id", "turn", *(score[k].alias(k) for k in ("cer", "gt_chars", "pred_chars", "len_ratio")))


@query(edits.OTHER["a19_reliability"])
def a19_reliability(spark, sf_dir):
    from verso.operators import fulltext

    docs = table(spark, sf_dir, "documents")
    runs = layout.longest_run(docs, "doc_id", "text").select("doc_id", "run")
    rows = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").join(runs, "doc_id")
    rows = rows.select("source", (F.coalesce("quality", F.lit(1)) == 1).alias("usable"), "run", layout.phrase_loop(F.col("text")).alias("loop"))
    return fulltext.reliability(rows, "source")


@query(
    """WITH n AS (SELECT event_type, avg(value) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1), b AS (SELECT event_type, avg(value) AS mean FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)
       SELECT event_type, round_even(n.mean, 4) AS mean, round_even(n.mean - b.mean, 4) AS d_mean FROM n LEFT JOIN b USING (event_type)"""
)
def j16_against_earlier(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    half = lambda late: e.filter((F.col("ts") >= "2024-01-15") == F.lit(late)).groupBy("event_type").agg(F.avg("value").alias("mean"))
    out = ledger.against_earlier(half(True), half(False), ["event_type"], ["mean"])
    return out.select("event_type", F.bround("mean", 4).alias("mean"), "d_mean")


# The other modules register their queries here as well.
from verso.plans import clusters, files, rules  # noqa: E402, F401
