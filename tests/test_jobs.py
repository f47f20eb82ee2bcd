"""Job streams: histories with a lifetime over several runs, and intake that stops between write and commit."""

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from verso.plans.files import ROCKS, STORE
from verso.streaming import jobs

EVENT = "job_id string, state string, ts timestamp, seq long"
START = datetime(2024, 1, 1, tzinfo=UTC)


def write(folder, name, events):
    lines = [json.dumps({"job_id": j, "state": s, "ts": (START + timedelta(minutes=m)).isoformat(), "seq": q}) for j, s, m, q in events]
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


def history(events, lifetime, mark):
    """Statuses and silences of every job among the events before the watermark (minutes)."""
    status = {"QUEUED": "queued", "STARTED": "running", "SUCCESS": "done", "PENDING": "404"}
    out = []
    for job in {e[0] for e in events if e[0]}:
        own = sorted((m, q, status.get(s, "failed")) for j, s, m, q in events if j == job and m < mark)
        for i, (m, _, s) in enumerate(own):
            out.append((job, m, s))
            after = own[i + 1][0] if i + 1 < len(own) else None
            if after is not None and after > m + lifetime or after is None and m + lifetime < mark:
                out.append((job, m + lifetime, "404"))
    return sorted(out)


def test_history_over_several_runs(spark, tmp_path):
    """Out-of-order events within the delay, silences inside and between runs, a restart after each run, and no replay."""
    rng = random.Random(6)
    inbox = tmp_path / "in"
    inbox.mkdir()
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    events = []
    try:
        for run in range(4):
            new = [(f"j{rng.randrange(6)}", rng.choice(["QUEUED", "STARTED", "SUCCESS", "PENDING", "LOST"]), run * 300 + rng.randrange(300), i) for i in range(25)]
            new += [(None, "QUEUED", run * 300 + 1, 0), ("last", "STARTED", run * 300 + 299, 0)]
            events += new
            write(inbox, f"{run}.json", new)
            stream = spark.readStream.schema(EVENT).json(str(inbox))
            out = jobs.job_history(stream, lifetime_s=100 * 60, late="320 minutes")
            out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    got = [(r["job_id"], round((r["ts"].replace(tzinfo=UTC) - START).total_seconds() / 60), r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = history(events, 100, 1199 - 320)
    assert sorted(got) == want and len(want) > 60 and len({r[2] for r in want}) == 5


def test_history_is_made_by_built_in_state(spark, tmp_path):
    """No call into Python for a job; equal events stay two, a lifetime holds to its very end, and a late event is late for lifetimes too."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    runs = [
        [("a", "STARTED", 0, 0), ("a", "STARTED", 0, 0), ("a", "SUCCESS", 100, 0), ("b", "QUEUED", 0, 0), ("b", "QUEUED", 100.001, 0), ("c", "QUEUED", 1000, 0)],
        [("a", "QUEUED", 850, 0), ("b", "QUEUED", 500, 0), ("c", "LOST", 950, 0), ("c", "QUEUED", 2000, 0)],  # the watermark stands at 940
    ]
    try:
        for run, new in enumerate(runs):
            write(inbox, f"{run}.json", new)
            out = jobs.job_history(spark.readStream.schema(EVENT).json(str(inbox)), lifetime_s=100 * 60, late="60 minutes")
            plan = out._jdf.queryExecution().analyzed().toString()
            assert "InPySpark" not in plan and "Pandas" not in plan
            out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    got = [(r["job_id"], round((r["ts"].replace(tzinfo=UTC) - START).total_seconds() / 60, 3), r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == history([*runs[0], *runs[1][2:]], 100, 2000 - 60)
    assert ("b", 100, "404") in got and ("a", 100, "404") not in got and got.count(("a", 0, "running")) == 2


def test_intake_that_stops_before_the_commit(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(3):
        write(inbox, f"{i}.json", [(f"j{i}", "STARTED", i, 0), (f"k{i}", "SUCCESS", i, 0)])
    worked = []

    def run(fail=False):
        source = jobs.spool(spark, str(inbox), EVENT, per_trigger=1, delete=True)
        work = lambda batch: (worked.append(batch.count()), batch.select("job_id", jobs.job_status(F.col("state")).alias("status")))[1]
        jobs.take_in(spark, source, str(tmp_path / "ledger"), str(tmp_path / "rows"), str(tmp_path / "check"), work, stop_before_commit=fail)

    with pytest.raises(Exception, match="stopped before the commit"):
        run(fail=True)
    assert len(list(inbox.glob("*.json"))) == 3  # nothing that isn't committed is deleted
    run()
    assert worked == [2, 2, 2]  # the batch that was written before the stop isn't worked on again
    rows = sorted((r["job_id"], r["status"]) for r in spark.read.parquet(str(tmp_path / "rows")).collect())
    assert rows == sorted([(f"j{i}", "running") for i in range(3)] + [(f"k{i}", "done") for i in range(3)])
    assert len(list((tmp_path / "ledger").glob("batch=*"))) == 3
    write(inbox, "9.json", [("late", "QUEUED", 9, 0)])
    run()
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 7
    assert not (inbox / "0.json").exists()  # deleted once its batch was committed
