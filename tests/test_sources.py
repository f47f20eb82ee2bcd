import pytest
from pyspark.sql import functions as F

from verso.sources import dumps, readers, sinks
from verso.streaming import jobs


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y\n', encoding="utf-8")
    rows = readers.read_jsonl(spark, str(path), "a int, b string", strict=False).cache()
    assert rows.filter("_bad is not null").count() == 1 and rows.filter("a = 1").count() == 1
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.read_jsonl(spark, str(path), "a int, b string").collect()


def test_salvage(spark):
    raw = '{"sender": "A \\"q\\"", "subject": "cut of'
    r = spark.createDataFrame([(raw,)], "t string").select(*(v.alias(k) for k, v in readers.salvage(F.col("t"), "sender", "subject", "body").items())).first()
    assert r["sender"] == 'A \\"q\\"' and r["body"] is None


def test_sql_dump(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "d.sql.gz", "wt", encoding="utf-8") as f:
        f.write("CREATE TABLE x;\nINSERT INTO `words` VALUES (1,'a\\'b','m, (x)'),(2,'c','d\\n'),(3,'x');\nINSERT INTO `words` VALUES ('7z','q','r');\n")
    rows = sorted((r["id"], r["word"], r["meaning"]) for r in dumps.read_sql_dump(spark, str(tmp_path / "*.sql.gz")).collect())
    assert rows == [(1, "a'b", "m, (x)"), (2, "c", "d"), (7, "q", "r")]


DUMP = """-- it's a dump; INSERT INTO words VALUES (0,'no','no');
/*!40101 SET x='\\' */;
CREATE TABLE `words` (`id` int, `word` varchar(9) DEFAULT ';(');\r
INSERT INTO `words` VALUES (1,'a','one;
two'),(2,'b','x');\r
# don't
insert into words (id, word, meaning)\r
 values (3, 'c;\r
', '--'), /* (4,'d','e'); */ (5,'\\\\','\\'')  ; INSERT INTO other VALUES (9,'n','n'); INSERT IGNORE INTO words VALUES (6,"q;'(x)",'it''s'),(NULL,' p ',7);
INSERT INTO words VALUES (8,'torn',"""
DUMP_ROWS = [(1, "a", "one;\ntwo"), (2, "b", "x"), (3, "c;", "--"), (5, "\\", "'"), (6, "\"q;'(x)\"", "its"), (0, "p", "7")]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_dump_scanner_keeps_state_between_pieces(size):
    scanner = dumps.DumpScanner("words")
    found = [f for i in range(0, len(DUMP), size) for f in scanner.feed(DUMP[i : i + size])] + list(scanner.feed("", last=True))
    assert [(int("".join(c for c in f[0] if c.isdigit()) or 0), f[1], f[2]) for f in found] == DUMP_ROWS


def test_sql_dump_over_splits_and_files(spark, tmp_path):
    """A plain file that Spark reads in many splits, a gzipped one, and a line that is longer than a piece."""
    import gzip

    long = "INSERT INTO words VALUES " + ",".join(f"({i},'w{i}','" + "m;\\n" * 40 + "')" for i in range(500)) + ";\n"
    (tmp_path / "a.sql").write_text(DUMP.rsplit("\n", 1)[0] + "\n" + long * 3, encoding="utf-8", newline="")
    with gzip.open(tmp_path / "b.sql.gz", "wt", encoding="utf-8", newline="") as f:
        f.write(DUMP)
    (tmp_path / "c.sql").write_text("", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        rows = dumps.read_sql_dump(spark, str(tmp_path), "words").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    of = lambda end: [(r["id"], r["word"], r["meaning"]) for r in sorted(rows, key=lambda r: r["pos"]) if r["file"].endswith(end)]
    assert of("b.sql.gz") == DUMP_ROWS
    assert of("a.sql") == DUMP_ROWS + [(i, f"w{i}", ("m;\n" * 40).strip()) for i in range(500)] * 3


def test_word_boxes(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    body = ["5\t1\t1\t1\t1\t1\t10\t20\t30\t5\t91.5\tone", "4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t", "5\t1\t1\t1\t1\t2\t50\t20\t30\t5\t-1\ttwo", "5\t2\t1\t1\t1\t1\t1\t2\t3\t4\tbad\tx", '5\t2\t1\t1\t1\t2\t1\t2\t3\t4\t50\t"q']
    (tmp_path / "w.tsv").write_text(head + "\n".join(body), encoding="utf-8")
    rows = readers.read_word_boxes(spark, str(tmp_path / "w.tsv")).orderBy("page_num").collect()
    assert [(r["page_num"], r["text"], r["x0"], r["x1"], r["y1"]) for r in rows] == [(1, "one", 10, 40, 25), (2, '"q', 1, 4, 6)]


def test_word_list_transcripts_and_logs(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# note\nab\nab\nc1\n d \n", encoding="utf-8")
    assert sorted(r[0] for r in readers.read_word_list(spark, str(tmp_path / "w.txt"), "^[a-z]+$").collect()) == ["ab", "d"]
    (tmp_path / "a.gt.txt").write_text("A first sentence. Short. And another sentence here\nline\n", encoding="utf-8")
    out = [r[0] for r in readers.read_transcripts(spark, str(tmp_path / "*.gt.txt")).collect()]
    assert "A first sentence" in out and "Short" not in out and len(out) == 3
    log = spark.createDataFrame([("At iteration 10/100/100, x",), ("At iteration 20/250/250, y",), ("z",)], "value string")
    assert readers.last_iteration(log).first()[0] == 250
    names = spark.createDataFrame([("fas_1.50_10_100.checkpoint",), ("fas_1.20_20_200.checkpoint",), ("fas_1.20_30_300.checkpoint",), ("x",)], "name string")
    assert readers.best_checkpoint(names).first()[0] == "fas_1.20_30_300.checkpoint"


def test_files_and_uploads(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"\x89PNG1234")
    r = readers.file_manifest(spark, str(tmp_path)).first()
    assert r["filename"] == "a.bin" and r["bytes"] == 8
    df = spark.createDataFrame([(b"\x89PNG12",), (b"nope",), (b"\xff\xd8\xff" + b"x" * 50,)], "c binary")
    assert [x[0] for x in df.select(readers.accepted_upload(F.col("c"), 20)).collect()] == [200, 400, 413]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.append_ledger(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    sinks.write_changes(df, str(tmp_path / "c"))
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "c")).count() == 2
    sinks.write_list(df.select("s"), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 2
    sinks.write_dictionary(df.withColumnRenamed("s", "word_norm"), str(tmp_path / "d"), buckets=4)
    assert spark.read.parquet(str(tmp_path / "d")).filter("word_norm = 'a'").count() == 1
    assert sinks.markdown(df).splitlines()[2] == "| 1 | a |"


def test_job_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("j1", "QUEUED", "2024-01-01 00:00:00", 1), ("j1", "SUCCESS", "2024-01-01 00:05:00", 2), ("j2", "FAILURE", "2024-01-01 01:10:00", 3), ("j3", "STARTED", "2024-01-01 05:00:00", 4)]
    schema = "job_id string, state string, ts timestamp, seq long"
    events = spark.createDataFrame(rows, "job_id string, state string, ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.json(str(tmp_path / "in" / "a"))
    assert {r["job_id"]: r["status"] for r in jobs.current_status(events).collect()} == {"j1": "done", "j2": "failed", "j3": "running"}
    stream = jobs.spool(spark, str(tmp_path / "in" / "*"), schema)
    q = jobs.status_counts(stream).writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["status"], r["n"]) for r in spark.table("counts").collect()} == {("queued", 1), ("done", 1), ("failed", 1)}
    fresh = jobs.fresh_results(jobs.spool(spark, str(tmp_path / "in" / "*"), schema)).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp2")).start()
    fresh.processAllAvailable()
    fresh.stop()
    assert spark.table("fresh").count() == 3
