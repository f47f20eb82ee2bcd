"""Registered queries that go through files: each writes tables in a format and reads them back with its reader.

The files stand in the folder that executors share, and are as many as Spark makes of the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verso.plans.catalogue import BOXES, WORDS, boxes, lower_words, query, table
from verso.session import shared_folder
from verso.sources import dumps, readers, sinks
from verso.streaming import jobs


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/verso/{uuid.uuid4().hex}/{name}"


TURN = "conv_id long, turn long, role string, text string"


@query("SELECT conv_id, turn, role, sha256(text) AS digest FROM conversations")
def io1_json_lines(spark, sf_dir):
    """Written as JSON lines (IO15), read strictly."""
    path = place(spark, "turns")
    sinks.write_json(table(spark, sf_dir, "conversations"), path)
    rows = readers.read_jsonl(spark, path, TURN)
    kinds = dict(table(spark, sf_dir, "conversations").dtypes)
    return rows.select(F.col("conv_id").cast(kinds["conv_id"]).alias("conv_id"), F.col("turn").cast(kinds["turn"]).alias("turn"), "role", F.sha2("text", 256).alias("digest"))


@query(
    """SELECT conv_id % 3 = 0 AS bad, count(*) AS n, coalesce(sum(length(text)) FILTER (conv_id % 3 <> 0), 0)::BIGINT AS chars FROM conversations GROUP BY 1"""
)
def io2_tolerant_lines(spark, sf_dir):
    """Every third conversation's lines lose their end; they are kept as bad ones."""
    path = place(spark, "torn")
    whole = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    torn = F.when(F.col("conv_id") % 3 == 0, F.substring(whole, F.lit(1), F.length(whole) - 1)).otherwise(whole)
    sinks.write_list(table(spark, sf_dir, "conversations").select(torn.alias("line")), path)
    rows = readers.read_jsonl(spark, path, TURN, strict=False)
    bad = F.col("_bad").isNotNull()
    # The columns beside _bad are asked for, as a projection on _bad alone parses nothing.
    return rows.select(bad.alias("bad"), F.when(~bad, F.length("text")).otherwise(0).alias("n_chars"), "turn").groupBy("bad").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("long").alias("chars"))


@query("SELECT doc_id, lang FROM documents")
def io4_line_corpus(spark, sf_dir):
    return readers.read_line_corpus(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang"])


@query("SELECT least(count(*), 100) AS n, least(count(*), 100) AS known FROM documents")
def s6_first_rows(spark, sf_dir):
    """A corpus cut to its first so many rows, whichever come first."""
    rows = readers.read_line_corpus(spark, f"{sf_dir}/documents.parquet", ["doc_id"], limit=100)
    known = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("_k"))
    return rows.join(known, "doc_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count("_k").alias("known"))


@query("SELECT conv_id * 1000 + turn AS id, role AS word, sha256(text) AS digest FROM conversations")
def io5_sql_dump(spark, sf_dir):
    path = place(spark, "dump")
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("'"))
    row = F.concat(F.lit("INSERT INTO `words` VALUES ("), (F.col("conv_id") * 1000 + F.col("turn")).cast("string"), F.lit(","), quoted("role"), F.lit(","), quoted("text"), F.lit(")"))
    table(spark, sf_dir, "conversations").select(row.alias("value")).write.option("lineSep", ";\n").text(path)
    return dumps.read_sql_dump(spark, path).select("id", "word", F.sha2("meaning", 256).alias("digest"))


@query(
    """WITH t AS (SELECT conv_id * 1000 + turn AS id, role || ';' || chr(10) || role AS word, 'm' || replace(text, '. ', ';' || chr(10)) || '\\x' AS meaning FROM conversations)
       SELECT id, word, sha256(meaning) AS digest FROM t UNION ALL SELECT id + 500, word || chr(39), sha256(replace(meaning, chr(10), chr(13) || chr(10))) FROM t"""
)
def io5_planted_dump(spark, sf_dir):
    """Gzipped dumps with line ends and semicolons in literals, comments with quotes, and several statements a line."""
    path = place(spark, "dump")
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    number = F.col("conv_id") * 1000 + F.col("turn")
    word = F.concat("role", F.lit(";\n"), "role")
    meaning = F.concat(F.lit("m"), F.replace("text", F.lit(". "), F.lit(";\n")), F.lit("\\x"))
    first = F.concat(F.lit("/* it's; */ INSERT INTO `words` (`id`, `word`, `meaning`) VALUES ("), number, F.lit(", "), quoted(word), F.lit(", "), quoted(meaning), F.lit("),\r\n('id 7', 'two fields');"))
    other = F.concat(F.lit("INSERT INTO other VALUES (1,'a;','(b'); insert into words(id,word,meaning) values("), number + 500, F.lit(","), quoted(F.concat(word, F.lit("'"))), F.lit(","))
    last = F.concat(quoted(F.replace(meaning, F.lit("\n"), F.lit("\r\n"))), F.lit(",'more');\r\n-- don't; (1,'x','y')"))
    lines = table(spark, sf_dir, "conversations").select(F.concat(first, other, last).alias("value"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)
    return dumps.read_sql_dump(spark, path, "words").select("id", "word", F.sha2("meaning", 256).alias("digest"))


WORD_LIST = "SELECT word FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark) WHERE regexp_full_match(word, '{0}')"


def _word_list(spark: SparkSession, sf_dir: str, allowed: str) -> DataFrame:
    """One word a line, with repeats and comments between them."""
    path = place(spark, "words")
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word")).filter(~F.col("word").rlike(r"\s"))
    sinks.write_list(words.unionByName(words.select(F.concat(F.lit("# "), "word").alias("word"))), path)
    return readers.read_word_list(spark, path, allowed)


@query(WORD_LIST.format("[a-z]+"))
def io9_word_list(spark, sf_dir):
    return _word_list(spark, sf_dir, "^[a-z]+$")


@query(WORD_LIST.format("[A-Za-z]{2,}"))
def pf10_allowed_words(spark, sf_dir):
    return _word_list(spark, sf_dir, "^[A-Za-z]{2,}$")


@query(
    """WITH l AS (SELECT trim(unnest(string_split(text, chr(10)))) AS l FROM documents)
       SELECT text, count(*) AS n FROM (SELECT text FROM (SELECT trim(unnest(regexp_split_to_array(l, '[.؛]'))) AS text FROM l) WHERE length(text) BETWEEN 12 AND 90
         UNION ALL SELECT l FROM l WHERE length(l) >= 8) GROUP BY text"""
)
def io10_transcripts(spark, sf_dir):
    """Sentences and whole lines of transcript files."""
    path = place(spark, "transcripts")
    sinks.write_list(table(spark, sf_dir, "documents").select("text"), path)
    return readers.read_transcripts(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BOXES} SELECT page::INT AS page_num, line::VARCHAR AS line, pos::INT AS pos, text, conf::DOUBLE AS conf, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1 FROM boxes")
def io11_word_boxes(spark, sf_dir):
    """Word rows of a recogniser's table, between rows of pages and blank words that are skipped."""
    path = place(spark, "boxes")
    b = boxes(spark, sf_dir)
    row = lambda level, text, conf: b.select(
        F.lit(level).alias("level"), F.col("page").alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), F.col("line").alias("line_num"), F.col("pos").alias("word_num"),
        F.col("x0").alias("left"), F.col("y0").alias("top"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), conf.alias("conf"), text.alias("text"),
    )
    rows = row(5, F.col("text"), F.col("conf")).unionByName(row(4, F.col("text"), F.lit(-1.0))).unionByName(row(5, F.lit(None).cast("string"), F.lit(95.0))).unionByName(row(5, F.col("text"), F.lit(-1.0)))
    rows.write.option("sep", "\t").option("quote", "").option("header", "true").option("ignoreLeadingWhiteSpace", "false").csv(path)
    return readers.read_word_boxes(spark, path).select("page_num", "line", "pos", "text", "conf", "x0", "y0", "x1", "y1")


@query("SELECT max(user_id * 10 + event_id % 10)::BIGINT AS iteration FROM events")
def io12_last_iteration(spark, sf_dir):
    path = place(spark, "log")
    at = F.col("user_id") * 10 + F.col("event_id") % 10
    line = F.when(F.col("event_type") == "view", F.format_string("loss %d", "event_id")).otherwise("")
    named = F.format_string("At iteration %d/%d/%d, mean rms", at, at, at)
    events = table(spark, sf_dir, "events")
    sinks.write_list(events.select(named.alias("l")).unionByName(events.select(line.alias("l"))), path)
    return readers.last_iteration(spark.read.text(path))


@query(
    """SELECT arg_min(name, (e, -i)) AS name FROM (SELECT 'fas_' || e || '_' || o_orderkey || '_' || o_custkey || '.checkpoint' AS name, e::DOUBLE AS e, o_orderkey AS i
       FROM (SELECT *, printf('%d.%02d', o_custkey % 7 + 1, o_custkey % 100) AS e FROM orders))"""
)
def io13_best_checkpoint(spark, sf_dir):
    error = F.format_string("%d.%02d", F.col("o_custkey") % 7 + 1, F.col("o_custkey") % 100)
    orders = table(spark, sf_dir, "orders")
    name = F.concat_ws("_", F.lit("fas"), error, F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    names = orders.select(F.concat(name, F.lit(".checkpoint")).alias("name")).unionByName(orders.select(name.alias("name")))
    return readers.best_checkpoint(names)


@query("SELECT arg_max(name, (ts, name)) AS name FROM (SELECT 'run' || event_id || '.checkpoint' AS name, ts FROM events WHERE event_type <> 'error')")
def io13_latest_checkpoint(spark, sf_dir):
    tail = F.when(F.col("event_type") == "error", ".log").otherwise(".checkpoint")
    return readers.latest_checkpoint(table(spark, sf_dir, "events").select(F.concat(F.lit("run"), F.col("event_id").cast("string"), tail).alias("name"), F.col("ts").alias("modified")))


@query(
    """SELECT (page_id % 16)::INT AS shard, sum(strlen(html) + 1)::BIGINT AS bytes, sha256(string_agg(html || chr(10), '' ORDER BY page_id)) AS sha256, 't_' || substr(sha1((page_id % 16)::VARCHAR), 1, 8) AS template_id,
       page_id % 16 < 4 AS below_floor FROM pages GROUP BY page_id % 16"""
)
def io14_file_manifest(spark, sf_dir):
    """Files of pages, joined with what is known of them: a subject, and a resolution that a quarter falls below."""
    path = place(spark, "pages")
    pages = table(spark, sf_dir, "pages").withColumn("shard", (F.col("page_id") % 16).cast("int"))
    pages.repartition("shard").sortWithinPartitions("shard", "page_id").select("shard", F.col("html").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)
    files = readers.file_manifest(spark, path, "*.txt").withColumn("shard", F.regexp_extract("relpath", r"shard=(\d+)/", 1).cast("int"))
    truth = pages.select("shard").distinct().select("shard", F.col("shard").cast("string").alias("subject"), (F.col("shard") * 20 + 120).alias("dpi"))
    return readers.with_truth(files, truth, "shard").select("shard", "bytes", "sha256", "template_id", "below_floor")


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def io16_ledger(spark, sf_dir):
    """Two batches appended to one ledger."""
    path = place(spark, "ledger")
    first = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    for batch in (first, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("segment"))):
        sinks.append_ledger(batch, path)
    return readers.read_jsonl(spark, path, first.schema)


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus FROM orders")
def io17_change_log(spark, sf_dir):
    path = place(spark, "changes")
    sinks.write_changes(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path)
    return spark.read.option("sep", "\t").option("header", "true").csv(path)


@query(
    """SELECT * FROM (VALUES (0, '| lang | n | d_n |'), (1, '|---|---|---|')) h(i, line) UNION ALL SELECT row_number() OVER (ORDER BY lang) + 1, '| ' || lang || ' | ' || n || ' | ' || (n - m) || ' |'
       FROM (SELECT lang, count(*) AS n, count(*) FILTER (source = 'src7') AS m FROM documents GROUP BY lang)"""
)
def io18_report(spark, sf_dir):
    """A report table with a difference column, one row a line."""
    n, m = F.count(F.lit(1)), F.count_if(F.col("source") == "src7")
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(n.alias("n"), (n - m).alias("d_n")).orderBy("lang")
    return spark.createDataFrame([(i, line) for i, line in enumerate(sinks.markdown(rows).split("\n"))], "i int, line string")


@query(
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN strlen(html) + CASE WHEN page_id % 4 < 3 THEN 4 ELSE 0 END > 3000 THEN 413 WHEN page_id % 4 < 3 THEN 200 ELSE 400 END AS status FROM pages) GROUP BY status"""
)
def io20_uploads(spark, sf_dir):
    """Pages with the first bytes of three known formats, and some with none."""
    heads = F.array(*(F.unhex(F.lit(h)) for h in ("FFD8FFE0", "89504E47", "25504446")))
    head = F.try_element_at(heads, (F.col("page_id") % 4 + 1).cast("int"))
    content = F.concat(F.coalesce(head, F.lit(b"")), F.col("html").cast("binary"))
    return table(spark, sf_dir, "pages").select(readers.accepted_upload(content, 3000).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations) GROUP BY line")
def io22_line_lists(spark, sf_dir):
    path = place(spark, "list")
    sinks.write_list(table(spark, sf_dir, "conversations").select("text"), path)
    return spark.read.option("lineSep", "\n").text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH ws AS ({WORDS.format("documents")}), lex AS ({WORDS.format("benchmark")}) SELECT word, lex.word IS NOT NULL AS known FROM ws LEFT JOIN lex USING (word)""")
def io6_bucketed_lookup(spark, sf_dir):
    """Words looked up in a dictionary that lies in buckets, so that only the words move."""
    name = f"lexicon_{uuid.uuid4().hex}"
    words = lower_words(table(spark, sf_dir, "benchmark")).withColumn("known", F.lit(True))
    sinks.write_lexicon(words, name, place(spark, name), "word", buckets=16)
    rows = lower_words(table(spark, sf_dir, "documents")).join(spark.table(name), "word", "left")
    return rows.select("word", F.coalesce("known", F.lit(False)).alias("known"))


# ---- streams -----------------------------------------------------------------------------------

EVENT = "job_id long, state string, ts timestamp"
NAMES = {"signup": "QUEUED", "click": "STARTED", "purchase": "SUCCESS", "view": "PENDING"}
STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'view' THEN '404' ELSE 'failed' END"


def spooled(spark: SparkSession, sf_dir: str, per_trigger: int) -> DataFrame:
    """Events written to a spool folder and taken in as a stream."""
    path = place(spark, "spool")
    state = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv)), F.col("event_type")), F.lit("FAILURE"))
    table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("job_id"), state.alias("state"), "ts").repartition(8, "job_id").write.json(path)
    return jobs.spool(spark, path, EVENT, per_trigger)


def streamed(out: DataFrame, name: str) -> DataFrame:
    """What a stream writes until its input is used up."""
    spark = out.sparkSession
    path = place(spark, name)
    stream = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-checkpoint")
    stream.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query(f"""SELECT hour, status, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS hour, {STATUS} AS status FROM events)
           WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY hour, status""")
def q1_stream_counts(spark, sf_dir):
    """Jobs per status and hour, as a stream closes its windows behind the watermark."""
    counts = streamed(jobs.status_counts(spooled(spark, sf_dir, 100)).select(F.col("window.start").alias("hour"), "status", "n"), "counts")
    return counts.select("hour", "status", "n")


@query("SELECT DISTINCT user_id::BIGINT AS job_id FROM events")
def q4_fresh_results(spark, sf_dir):
    """One result a job within a lifetime that spans the whole stream."""
    return streamed(jobs.fresh_results(spooled(spark, sf_dir, 100), lifetime="3650 days").select("job_id"), "fresh")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


@query(f"""WITH e AS (SELECT user_id::BIGINT AS job_id, date_trunc('milliseconds', ts) AS ts, {STATUS} AS status FROM events WHERE user_id IS NOT NULL AND date_trunc('milliseconds', ts) < (SELECT max(date_trunc('milliseconds', ts)) FROM events) - INTERVAL 1 HOUR),
    n AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts) AS later FROM e)
    SELECT job_id, ts, status FROM e UNION ALL
    SELECT job_id, ts + INTERVAL 6 HOUR, '404' FROM n WHERE later > ts + INTERVAL 6 HOUR OR later IS NULL AND ts + INTERVAL 6 HOUR < (SELECT max(date_trunc('milliseconds', ts)) FROM events) - INTERVAL 1 HOUR""")
def q3_job_history(spark, sf_dir):
    """What each job's status becomes and when: after six silent hours it is 404, as the watermark passes."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return streamed(jobs.job_history(spooled(spark, sf_dir, 100), lifetime_s=6 * 3600), "history")
    finally:
        spark.conf.set(STORE, before)


@query(f"SELECT job_id, status, count(*) AS n FROM (SELECT user_id::BIGINT AS job_id, {STATUS} AS status FROM events) GROUP BY ALL")
def q2_worker_intake(spark, sf_dir):
    """The spool is worked off two files at a time; a batch is written once, by its number in the ledger."""
    at = place(spark, "intake")
    work = lambda batch: batch.select("job_id", jobs.job_status(F.col("state")).alias("status"))
    jobs.take_in(spark, spooled(spark, sf_dir, 2), f"{at}/ledger", f"{at}/rows", f"{at}/checkpoint", work)
    return spark.read.parquet(f"{at}/rows").groupBy("job_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {STATUS} AS status, count(*) AS n FROM events GROUP BY 1")
def q5_intake(spark, sf_dir):
    """Two files of the spool at a time."""
    rows = streamed(spooled(spark, sf_dir, 2).select(jobs.job_status(F.col("state")).alias("status")), "intake")
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
