"""Registered queries of the numbered operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from verso.llm import exact_dedup, fm_index, language_id, merkle, mixing, oracles, packing, pii, prefix_trie, quality_rules, run_index, simhash, site_quality, url_filter
from verso.llm.common import documents


def op1_pii(spark, sf_dir):
    return pii.find(documents(spark, sf_dir)).drop("_key", "_all")


def op2_run_index(spark, sf_dir):
    return run_index.remove_repeated_substrings(documents(spark, sf_dir))


def op3_language_id(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir))


def op4_exact_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return exact_dedup.mark_exact_duplicates(docs, keep="largest", carry=("doc_id",))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.judged(documents(spark, sf_dir))


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op6_fm_index(spark, sf_dir):
    return fm_index.remove_repeated_passages(documents(spark, sf_dir))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


def op8_site_quality(spark, sf_dir):
    return site_quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).drop("row_key")


def op11_merkle(spark, sf_dir):
    return merkle.tamper_check(documents(spark, sf_dir))


#: Rules of the url query (host, path, verdict); fixed by its contract.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Words in a host, between dots and hyphens, for which it is listed.
HOST_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")


def op12_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    fields = [F.struct(*(F.lit(x).alias(n) for n, x in zip(("host", "path", "verdict"), rule, strict=True))) for rule in RULES]
    rules = spark.range(1).select(F.inline(F.array(*fields)))
    return url_filter.judged(pages, rules, url_filter.suspect_hosts(pages, HOST_WORDS)).drop("url")


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_run_index": op2_run_index,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_fm_index": op6_fm_index,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_site_quality": op8_site_quality,
    "op9_mixing": op9_mixing,
    "op10_simhash": op10_simhash,
    "op11_merkle": op11_merkle,
    "op12_url_filter": op12_url_filter,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL = {
    "op11_merkle": oracles.MERKLE,
    "op12_url_filter": oracles.URL_FILTER,
    "op13_prefix_trie": oracles.PREFIX_TRIE,
    "op2_run_index": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
             g AS (SELECT w.doc_id, w.i FROM w JOIN (SELECT k, min(doc_id) AS first FROM w GROUP BY k) USING (k) WHERE first < w.doc_id),
             b AS (SELECT doc_id, unnest(range(length(h) // 2)) AS p, unnest(regexp_extract_all(h, '..')) AS x FROM d),
             m AS (SELECT b.doc_id, p, x, coalesce(p - max(i) OVER (PARTITION BY b.doc_id ORDER BY p) < 50, false) AS gone FROM b LEFT JOIN g ON b.doc_id = g.doc_id AND p = i),
             r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM m),
             s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(x, '' ORDER BY p) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
        SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN s USING (doc_id)
    """,
    "op6_fm_index": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
             w AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 35], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 34)) AS i FROM d WHERE len(ws) >= 35)),
             g AS (SELECT doc_id, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
             b AS (SELECT doc_id, unnest(range(len(ws))) AS p, unnest(ws) AS x FROM d),
             m AS (SELECT b.doc_id, p, x, coalesce(p - max(i) OVER (PARTITION BY b.doc_id ORDER BY p) < 35, false) AS gone FROM b LEFT JOIN g ON b.doc_id = g.doc_id AND p = i),
             r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS begins FROM m),
             s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(x, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM r GROUP BY doc_id)
        SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN s USING (doc_id)
    """,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
}
