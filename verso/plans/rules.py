"""Registered queries of scalar rules on planted text: letters of the tables are mapped to those the rules act on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verso.functions import bidi, generators, text, values
from verso.operators import fulltext, letters, lexicon, numerals, scoring
from verso.plans.catalogue import BOXES, CONV, LATIN_GROUPS, NEXT, PLAIN, SKELETON, WORDS, boxes, conversation_fields, dealt, lower_words, next_turns, plain, query, table
from verso.plans.edits import TOKENS, distance, numbers_of

#: Latin letters and the letters that stand for them in planted text.
LATIN, FA = "abcdefghijklmnopqrstuvwxyz", "ابپتیجچهنخدلمورزژسشصکگفقعغ"
LATIN_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM benchmark"


def fa(t: Column) -> Column:
    return F.translate(t, LATIN, FA)


def fa_sql(t: str) -> str:
    return f"translate({t}, '{LATIN}', '{FA}')"


def latin_words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()


# ---- scalar rules ------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(trim(regexp_replace(translate(text, 'aeiou', 'یکیه'), '\\s+', ' ', 'g'))) AS digest FROM documents")
def f2_clean_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.clean_label(F.translate("text", "aeiou", "يكىۀـ")), 256).alias("digest"))


@query("SELECT doc_id, sha256(regexp_replace(text, '\\D', '', 'g')) AS digest FROM documents")
def f3_ascii_digits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(values.digits_only(F.translate("text", "0123456789", "۰۱۲۳۴٥٦٧٨٩")), 256).alias("digest"))


@query(f"WITH {BOXES} SELECT page, line, pos, translate(text, 'aeiou', 'یک') AS key FROM boxes")
def f4_match_keys(spark, sf_dir):
    return boxes(spark, sf_dir).select("page", "line", "pos", text.match_key(F.translate("text", "aeiou", "يكـ‌َ")).alias("key"))


@query(f"WITH {BOXES} SELECT page, line, pos, translate(text, 'aeio', CASE WHEN len(regexp_extract_all(text, 'i')) >= 2 THEN 'یک' ELSE 'یکَ' END) AS word FROM boxes")
def f7_clean_words(spark, sf_dir):
    return boxes(spark, sf_dir).select("page", "line", "pos", text.clean_word(F.translate("text", "aeio", "يكَ‎")).alias("word"))


@query(
    f"""WITH {BOXES}, t AS (SELECT page, line, pos, CASE WHEN pos % 5 = 3 THEN ',' WHEN pos % 7 = 4 THEN text || ',' WHEN pos % 11 = 6 THEN ',' || text ELSE text END AS text FROM boxes),
        n AS (SELECT *, lag(text) OVER s AS a, lead(text) OVER s AS z FROM t WINDOW s AS (PARTITION BY page, line ORDER BY pos))
        SELECT page, line, pos, CASE WHEN text = ',' AND regexp_full_match(a, '[a-z]+') AND regexp_full_match(z, '[a-z]+') THEN '،'
          ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([a-z]),([a-z])', '\\1،\\2', 'g'), '([a-z]),([a-z])', '\\1،\\2', 'g'), '([a-z]),$', '\\1،'), '^,([a-z])', '،\\1') END AS text FROM n"""
)
def f8_restored_commas(spark, sf_dir):
    pos = F.col("pos")
    words = boxes(spark, sf_dir).withColumn("text", F.when(pos % 5 == 3, ",").when(pos % 7 == 4, F.concat("text", F.lit(","))).when(pos % 11 == 6, F.concat(F.lit(","), "text")).otherwise(F.col("text")))
    return numerals.restore_commas(words, ["page", "line"], letter="[a-z]").select("page", "line", "pos", "text")


FORM_ROWS = ", ".join(f"('{c}', '{''.join(map(chr, text.FORMS[c]))}')" for c in FA)


@query(
    f"""WITH forms(c, f) AS (VALUES {FORM_ROWS}), w AS (SELECT word, unnest(range(1, length(word) + 1)) AS i, {fa_sql("word")} AS fa FROM ({LATIN_WORDS})),
        n AS (SELECT word, i, f, coalesce(lag(length(f) = 4) OVER s, false) AS behind, lead(f) OVER s IS NOT NULL AND length(f) = 4 AS before FROM w JOIN forms ON c = fa[i] WINDOW s AS (PARTITION BY word ORDER BY i))
        SELECT word, string_agg(f[CASE WHEN behind AND before THEN 4 WHEN behind THEN 2 WHEN before THEN 3 ELSE 1 END], '' ORDER BY i DESC) AS shape FROM n GROUP BY word"""
)
def f10_shapes(spark, sf_dir):
    return latin_words(spark, sf_dir).select("word", text.shape(fa(F.col("word"))).alias("shape"))


@query(
    f"""SELECT word, array_to_string(list_filter(range(0, length(word) - 1), lambda i: NOT contains('akmonpq', word[i + 1])), ',') AS places, CASE WHEN regexp_matches(word, '[^akmonpq].') THEN 3 ELSE 0 END AS marks
        FROM ({LATIN_WORDS})""".replace("akmonpq", "".join(a for a, b in zip(LATIN, FA, strict=True) if b in generators.NON_CONNECTING))
)
def f11_stretched_words(spark, sf_dir):
    word = fa(F.col("word"))
    longer = generators.stretch(word, F.lit(3))
    same = F.translate(longer, generators.KASHIDA, "") == word
    places = F.array_join(F.transform(generators.kashida_positions(word), lambda i: i.cast("string")), ",")
    return latin_words(spark, sf_dir).select("word", places.alias("places"), F.when(same, F.length(longer) - F.length(word)).cast("int").alias("marks"))


@query(
    """SELECT doc_id, len(list_distinct(list_filter(list_transform(string_split(text, ' '), lambda t: regexp_extract(t, '[a-z]+')), lambda w: w <> '')))::INT AS n FROM documents"""
)
def f13_script_tokens(spark, sf_dir):
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.size(text.token_set(fa(F.col("text")))).alias("n"))


@query("SELECT c_custkey, ['x', 'y'][c_custkey % 2 + 1] AS a, ['1', '2', '3'][c_custkey % 3 + 1] AS b FROM customer")
def f16_pools(spark, sf_dir):
    entry = generators.from_pools(F.col("c_custkey"), {"a": ["x", "y"], "b": ["1", "2", "3"]})
    return table(spark, sf_dir, "customer").select("c_custkey", entry["a"].alias("a"), entry["b"].alias("b"))


@query("SELECT lang, count(*) AS lines, count(*) FILTER (l IS NULL OR regexp_full_match(l, '[\\s\\x{a0}]*')) AS blank FROM (SELECT lang, nullif(unnest(string_split(replace(text, 'q', chr(160)), chr(10))), '') AS l FROM documents) GROUP BY lang")
def pf2_blank_lines(spark, sf_dir):
    line = F.explode(F.split(F.replace(F.col("text"), F.lit("q"), F.lit(" ")), "\n")).alias("l")
    rows = table(spark, sf_dir, "documents").select("lang", line).select("lang", F.nullif("l", F.lit("")).alias("l"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("lines"), F.count_if(text.is_blank(F.col("l"))).alias("blank"))


@query("""SELECT lang, source, substr(sha256('{"lang":"' || lang || '","source":"' || source || '"}'), 1, 16) AS key FROM (SELECT DISTINCT lang, source FROM documents)""")
def v13_config_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct().select("lang", "source", values.config_hash(F.struct("lang", "source")).alias("key"))


@query(
    """SELECT l_returnflag, round_even(sum(l_linenumber) / nullif(sum(l_quantity), 0), 4) AS per_piece, median(l_quantity)::DOUBLE AS typical,
       sum(round_even(l_linenumber * 0.5, 0))::BIGINT AS halves FROM lineitem GROUP BY l_returnflag"""
)
def v15_ratios(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        scoring.ratio(F.sum("l_linenumber"), F.sum("l_quantity")).alias("per_piece"), F.percentile("l_quantity", F.lit(0.5)).alias("typical"),
        F.sum(F.bround(F.col("l_linenumber") * F.lit(0.5), 0)).cast("long").alias("halves"),
    )


# ---- transcripts -------------------------------------------------------------------------------

DIGIT = "[0-9۰-۹٠-٩]"
DAY = f"({DIGIT}{{2,4}})\\s*[/\\-.]\\s*({DIGIT}{{1,2}})\\s*[/\\-.]\\s*({DIGIT}{{1,2}})"
RUN = f"{DIGIT}(?:{DIGIT}|[\\s\\-()]){{5,20}}{DIGIT}"
ASCII = "translate({0}, '۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', '01234567890123456789')"
#: Planted lines: a labelled list of numbers, an area code, a date behind a label, numbers and a date without one.
PLANTED = """chr(10) || 'تلفن: ' || (38380000 + doc_id) || ' - ' || (10000000 + doc_id * 7) || chr(10) || 'فکس 051-' || (30000000 + doc_id) || chr(10) || 'تماس 1402/12/' || (doc_id % 40)
   || chr(10) || 'مبلغ ' || (90000000 + doc_id) || chr(10) || translate((1290 + doc_id % 220) || '/' || (doc_id % 14) || '/' || (doc_id % 33), '0123456789', '۰۱۲۳۴۵۶۷۸۹') || chr(10) || 'موبایل ' || (900000000 + doc_id)"""


@query(
    f"""WITH t AS (SELECT coalesce(text, '') || {PLANTED} AS text FROM documents), l AS (SELECT unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS l FROM t),
        e AS (SELECT v, regexp_matches(v, '^[A-Za-z0-9._%+\\-]+@(?:[A-Za-z0-9\\-]+\\.)+[A-Za-z]{{2,}}$') AS ok FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+')) AS v FROM t)),
        d AS (SELECT {ASCII.format("unnest(regexp_extract_all(l, '" + DAY + "'))")} AS v FROM l),
        p AS (SELECT regexp_extract(v, '{DAY}', 1)::INT AS y, regexp_extract(v, '{DAY}', 2)::INT AS m, regexp_extract(v, '{DAY}', 3)::INT AS d FROM d),
        q AS (SELECT CASE WHEN y < 50 THEN y + 1400 WHEN y < 100 THEN y + 1300 ELSE y END AS y, m, d FROM p),
        r AS (SELECT *, CASE WHEN m <= 6 THEN 31 WHEN m <= 11 THEN 30 WHEN y % 33 IN (1, 5, 9, 13, 17, 22, 26, 30) THEN 30 ELSE 29 END AS last FROM q),
        n AS (SELECT unnest(regexp_extract_all(regexp_extract(l, '(?s){values.PHONE_LABEL}(.*)$', 1), '{RUN}')) AS run FROM l),
        s AS (SELECT run, list_transform(regexp_extract_all(run, '{DIGIT}+'), lambda g: {ASCII.format("g")}) AS gs FROM n WHERE NOT regexp_matches(run, '{DAY}')),
        f AS (SELECT unnest(CASE WHEN len(gs) = 2 AND starts_with(gs[1], '0') AND length(gs[1]) <= 4 AND length(gs[1] || gs[2]) IN (10, 11) THEN [gs[1] || gs[2]] ELSE gs END) AS v FROM s),
        every AS (SELECT 'email' AS kind, CASE WHEN ok THEN '' WHEN NOT contains(substr(v, instr(v, '@') + 1), '.') THEN 'no dot' ELSE 'characters' END AS reason FROM e
          UNION ALL SELECT 'date', CASE WHEN y NOT BETWEEN 1300 AND 1499 THEN 'year' WHEN m NOT BETWEEN 1 AND 12 THEN 'month' WHEN d NOT BETWEEN 1 AND last THEN 'day' ELSE '' END FROM r
          UNION ALL SELECT 'phone', CASE WHEN length(v) IN (8, 10, 11) THEN '' WHEN length(v) = 9 THEN 'nine digits' ELSE 'digits' END FROM f)
        SELECT kind, reason = '' AS valid, reason, count(*) AS n FROM every GROUP BY kind, reason"""
)
def v4_scan(spark, sf_dir):
    """Findings of whole texts and of lines planted behind them."""
    planted = F.expr(PLANTED.replace("chr(10)", "'\\n'"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.coalesce("text", F.lit("")), planted).alias("text"))
    return docs.select(F.explode(values.scan(F.col("text"))).alias("f")).groupBy("f.kind", "f.valid", "f.reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {BOXES}, w AS (SELECT page, line, pos, CASE WHEN pos = 0 THEN ['شرکت', 'ثبت:', 'ش.ث', 'صنایع'][line % 4 + 1] WHEN pos = 1 AND line % 4 IN (1, 2) THEN (page * 7919 + line)::VARCHAR ELSE text END AS text,
          0.7 + (page + line * 3 + pos) % 30 / 100 AS conf FROM boxes),
        l AS (SELECT page, line, string_agg(text, ' ' ORDER BY pos) AS t FROM w GROUP BY page, line HAVING min(conf) >= 0.8),
        r AS (SELECT *, regexp_extract(t, '{letters.REGISTRATION}', 1) AS reg FROM l)
        SELECT page, arg_min(trim(t), line) FILTER (reg = '' AND regexp_matches(t, '{letters.HEAD_ORGANISATION}')) AS sender, arg_min(reg, line) FILTER (reg <> '') AS registration_number FROM r GROUP BY page"""
)
def v9_letterhead(spark, sf_dir):
    pos, line = F.col("pos"), F.col("line")
    head = F.element_at(F.array(*map(F.lit, ("شرکت", "ثبت:", "ش.ث", "صنایع"))), (line % 4 + 1).cast("int"))
    number = (F.col("page") * 7919 + line).cast("string")
    words = boxes(spark, sf_dir).withColumns(
        {"text": F.when(pos == 0, head).when((pos == 1) & (line % 4).isin(1, 2), number).otherwise(F.col("text")), "conf": F.lit(0.7) + (F.col("page") + line * 3 + pos) % 30 / 100}
    )
    return letters.letterhead(words, "page")


SURE = 60


@query(
    f"""WITH {BOXES}, w AS (SELECT page, line, pos, lower(text) AS word, conf FROM boxes), lex AS ({WORDS.format("benchmark")}),
        open AS (SELECT DISTINCT word FROM w ANTI JOIN lex USING (word) WHERE conf < {SURE} AND length(word) >= 3 AND regexp_full_match(word, '[a-zà-ÿ]+')),
        near AS (SELECT o.word, l.word AS c FROM (SELECT word, {SKELETON} AS s FROM open) o JOIN (SELECT word, {SKELETON} AS s FROM lex) l ON o.s = l.s AND length(o.word) = length(l.word)
          AND len(list_filter(range(1, length(o.word) + 1), lambda i: o.word[i] <> l.word[i])) = 1),
        moved AS (SELECT word, min(c) AS fix FROM near GROUP BY word HAVING count(*) = 1),
        cut AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS c FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM open WHERE length(word) >= 4)),
        single AS (SELECT cut.word, min(c) AS fix FROM cut JOIN lex ON c = lex.word GROUP BY cut.word HAVING count(*) = 1)
        SELECT page, line, pos, coalesce(m.fix, s.fix, w.word) AS fixed, CASE WHEN m.fix IS NOT NULL THEN 'moved' WHEN s.fix IS NOT NULL THEN 'single' ELSE 'kept' END AS rule
        FROM w LEFT JOIN moved m ON m.word = w.word AND conf < {SURE} LEFT JOIN single s ON s.word = w.word AND conf < {SURE}"""
)
def c4_guarded_fixes(spark, sf_dir):
    words = boxes(spark, sf_dir).withColumn("word", F.lower("text"))
    lex = lower_words(table(spark, sf_dir, "benchmark"))
    return lexicon.fix_words(words, lex, LATIN_GROUPS, script="^[a-zà-ÿ]+$", sure=SURE).select("page", "line", "pos", "fixed", "rule")


@query(
    f"""WITH t AS (SELECT conv_id, {PLAIN.format("text")} AS a, {PLAIN.format("next")} AS b FROM ({NEXT}) WHERE next IS NOT NULL), w AS (SELECT *, {numbers_of(TOKENS.format("a"))} AS wa, {numbers_of(TOKENS.format("b"))} AS wb FROM t)
        SELECT conv_id, count(*) AS pages, round_even(avg(round_even({distance("wa", "wb")} / greatest(len(wa), 1), 4)), 6) AS wer, round_even(avg(round_even(levenshtein(a, b) / greatest(length(a), 1), 4)), 6) AS cer,
          sum(CASE WHEN length(b) > 2 * length(a) THEN 1 ELSE 0 END)::BIGINT AS junk FROM w GROUP BY conv_id"""
)
def a36_page_means(spark, sf_dir):
    """Means of the turns of a conversation, each scored against the next one; a turn twice as long counts as junk."""
    rows = next_turns(spark, sf_dir).select("conv_id", plain(F.col("text")).alias("a"), plain(F.col("next")).alias("b"))
    score = fulltext.page_score(F.col("a"), F.col("b"))
    junk = F.when(F.length("b") > F.length("a") * 2, 1).otherwise(0)
    return fulltext.page_means(rows.select("conv_id", score["wer"].alias("wer"), score["cer"].alias("cer"), junk.alias("junk")), "conv_id")


SWAPPED = CONV.replace("\nfields AS (", "\ngiven AS (").replace(
    "\noutcomes AS (",
    "\nfields AS (SELECT doc, field, has_gt, gt, CASE WHEN doc % 3 = 0 THEN coalesce(lead(gt) OVER (PARTITION BY doc ORDER BY field), pred) ELSE pred END AS pred FROM given),\noutcomes AS (",
)


@query(f"WITH {SWAPPED} SELECT doc, field, misassigned_to FROM misassigned")
def j6_swapped(spark, sf_dir):
    """Every third conversation has each answer where the one before belongs."""
    from pyspark.sql import Window

    rows = conversation_fields(spark, sf_dir)
    after = F.coalesce(F.lead("gt").over(Window.partitionBy("doc").orderBy("field")), "pred")
    rows = rows.withColumn("pred", F.when(F.col("doc") % 3 == 0, after).otherwise(F.col("pred")))
    return scoring.assignments(rows).filter("misassigned_to is not null").select("doc", "field", "misassigned_to")


@query(
    f"""WITH {BOXES}, l AS (SELECT page, line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, bool_or(regexp_matches(text, '[,.]')) AS marked FROM boxes GROUP BY page, line),
        m AS (SELECT page, y0 + 30 AS y0, y1 + 30 AS y1, x0, x1 FROM l WHERE marked)
        SELECT page, line FROM l a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.page = b.page AND greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / greatest(1, least(a.y1 - a.y0, b.y1 - b.y0)) > 0.4
          AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / greatest(1, least(a.x1 - a.x0, b.x1 - b.x0)) > 0.3)"""
)
def j10_free_lines(spark, sf_dir):
    """Lines that no marked line, moved down by most of a line, conflicts with."""
    from verso.operators import layout

    b = boxes(spark, sf_dir)
    marked = b.groupBy("page", "line").agg(F.max(F.col("text").rlike("[,.]")).alias("marked"))
    lines = layout.line_boxes(b, "page", "line").join(marked, ["page", "line"]).select("page", "line", "x0", "y0", "x1", "y1", "marked")
    moved = lines.filter("marked").withColumns({"y0": F.col("y0") + 30, "y1": F.col("y1") + 30})
    return layout.without_overlap(lines.drop("marked"), moved.drop("marked"), "page", ["line"]).select("page", "line")


@query(f"({WORDS.format('documents')}) INTERSECT ({WORDS.format('benchmark')})")
def u3_shared_words(spark, sf_dir):
    return lower_words(table(spark, sf_dir, "documents")).intersect(lower_words(table(spark, sf_dir, "benchmark")))


RTL = "אבגדהוזחטיכלמנסעפצקרשתװױײ׳"


@query(
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM benchmark), h AS (SELECT word, length(word) * 37 AS n, translate(word, 'abcdefghijklmnopqrstuvwxyz', 'אבגדהוזחטיכלמנסעפצקרשתװױײ׳') AS rtl FROM w)
       SELECT word, word || ' ' || n || '.' || n || ' (' || word || ') ' || reverse(rtl) || '/' || word || '@' || word || '. ' || n || ' ' || reverse(rtl) AS visual, length(rtl) AS n_chars FROM h"""
)
def f9_visual_order(spark, sf_dir):
    """Lines of letters that run to the left with numbers, addresses and words that run to the right, as they stand on the page."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    rtl, n = F.translate("word", LATIN, RTL), (F.length("word") * 37).cast("string")
    lit = F.lit
    line = F.concat(rtl, lit(" "), "word", lit("@"), "word", lit(". "), n, lit("/"), rtl, lit(" ("), "word", lit(") "), "word", lit(" "), n, lit("."), n)
    return words.select("word", bidi.visual_order(line).alias("visual"), F.length(rtl).cast("long").alias("n_chars"))
