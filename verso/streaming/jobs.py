"""Job events as a stream: current state per job, results with a lifetime, spool intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed mapping of worker states to reported ones.
STATES = {"QUEUED": "queued", "RECEIVED": "queued", "RETRY": "queued", "STARTED": "running", "SUCCESS": "done"}


def job_status(state: Column) -> Column:
    """Reported status of a worker state: unknown jobs are 404, anything unlisted has failed."""
    status = F.when(state.isNull() | (state == "PENDING"), "404")
    for name, shown in STATES.items():
        status = status.when(state == name, shown)
    return status.otherwise("failed")


def current_status(events: DataFrame, job: str = "job_id", state: str = "state", ts: str = "ts", tie: str = "seq") -> DataFrame:
    """(job, status, ts): the last event of each job decides."""
    last = events.groupBy(job).agg(F.max_by(F.struct(state, ts), F.struct(ts, tie)).alias("_e"))
    return last.select(job, job_status(F.col(f"_e.{state}")).alias("status"), F.col(f"_e.{ts}").alias("ts"))


def fresh_results(events: DataFrame, ts: str = "ts", job: str = "job_id", lifetime: str = "86400 seconds") -> DataFrame:
    """Each job's result once within its lifetime; state older than that is dropped."""
    return events.withWatermark(ts, lifetime).dropDuplicatesWithinWatermark([job])


def status_counts(events: DataFrame, ts: str = "ts", state: str = "state", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Jobs per reported status and event-time window, closed by the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), job_status(F.col(state)).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def spool(spark: SparkSession, path: str, schema: str, per_trigger: int = 100, delete: bool = False) -> DataFrame:
    """Files of a spool folder as a stream; read files are deleted on request, and the checkpoint acknowledges late."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return (stream.option("cleanSource", "delete") if delete else stream).json(path)


def job_history(events: DataFrame, lifetime_s: int = 86_400, late: str = "1 hour") -> DataFrame:
    """(job_id, ts, status): what the status of each job becomes and when, as the watermark passes.

    `events` is a stream of job_id, state and ts. A job that is silent for its lifetime is forgotten: it turns 404 that
    long after its last event, and its state goes. Events may come in any order within `late`; later ones are dropped.
    Events with a null job or time are left out. State is the events that wait for the watermark (twice, as both the
    rows and the lifetimes are made of them) and one session a job that lives; at size it belongs in RocksDB, which the
    session names as its state store.
    """
    rows = events.filter("job_id is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select("job_id", "ts", job_status(F.col("state")).alias("status"))
    # A window of one microsecond is one time, and it closes when the watermark has passed that time.
    tick = F.window("ts", "1 microsecond").alias("_tick")
    passed = rows.groupBy("job_id", tick, "status").agg(F.count(F.lit(1)).alias("_n"))
    came = passed.select("job_id", F.window_time("_tick").alias("ts"), F.explode(F.array_repeat("status", F.col("_n").cast("int"))).alias("status"))
    # Lifetimes are sessions of what has passed, so that an event that is late for the rows prolongs no session. An event at the
    # very end of a lifetime still prolongs it, hence the microsecond.
    times = rows.groupBy("job_id", tick).agg(F.count(F.lit(1)).alias("_n")).select("job_id", F.window_time("_tick").alias("ts"))
    lives = times.groupBy("job_id", F.session_window("ts", f"{lifetime_s * 1_000_000 + 1} microseconds").alias("_life")).agg(F.count(F.lit(1)).alias("_n"))
    ends = lives.select("job_id", F.window_time("_life").alias("ts"), F.lit("404").alias("status"))
    return came.union(ends)


def take_in(spark: SparkSession, source: DataFrame, ledger: str, sink: str, checkpoint: str, work, stop_before_commit: bool = False) -> None:
    """Run `work` on every batch of a spool and write it once, whatever is run again after a failure.

    A batch's rows go to the sink's folder of its number, which a repeated batch overwrites, and the ledger gets the
    number when they are there. Files are deleted by the source (cleanSource) only after the next commit of the checkpoint, so
    none is lost before its rows are written. `stop_before_commit` fails between write and commit, for tests.
    """

    def write(batch: DataFrame, number: int) -> None:
        if _holds(spark, ledger, number):
            return  # written, but the checkpoint didn't hear of it
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        spark.range(1).select(F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{ledger}/batch={number}")
        if stop_before_commit:
            raise RuntimeError("stopped before the commit")

    query = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _holds(spark: SparkSession, ledger: str, number: int) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/batch={number}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
