"""Streaming operators run to the end of what there is; each has a batch twin as its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.registry import query
from lectern.streaming import jobs


def _work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, parts: int = 3) -> tuple[DataFrame, str]:
    """The events table arriving as ``parts`` files in the order of event ids."""
    work = _work_dir(spark, "events")
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    edges = batch.selectExpr("min(event_id) as a", "max(event_id) as z").first()
    step = ((edges["z"] or 0) - (edges["a"] or 0)) // parts + 1
    for i in range(parts):  # one after the other: a file stream reads files in the order of their times
        low = (edges["a"] or 0) + i * step
        batch.where(F.col("event_id").between(low, low + step - 1)).coalesce(1).write.mode("append").parquet(f"{work}/in")
    return jobs.event_stream(spark, f"{work}/in", batch.schema.simpleString()[7:-1].replace(":", " ")), work


def _finished(spark: SparkSession, updates: DataFrame, work: str, key: str) -> DataFrame:
    jobs.run_once(updates, f"{work}/out", f"{work}/checkpoint")
    return jobs.last_updates(spark, f"{work}/out", key)


@query("stream_job_state", "SELECT user_id::VARCHAR AS job_id, count(*) AS events, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def stream_job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1, STR-13: a state machine in which every move is allowed ends at the last event."""
    stream, work = _stream(spark, sf_dir)
    keyed = stream.select(F.col("user_id").cast("string").alias("job_id"), "event_id", F.col("event_type").alias("status"))
    kinds = [r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().collect()]  # a handful of kinds
    anything = {s: set(kinds) for s in (None, *kinds)}
    found = _finished(spark, jobs.job_states(keyed, anything), work, "job_id")
    return found.select("job_id", "events", "status")


@query(
    "stream_eta",
    """WITH smp AS (SELECT user_id::VARCHAR AS series, epoch_us(ts) / 1e6::DOUBLE - 1704067200.0::DOUBLE AS ts, event_id AS seq, floor(event_id / 300)::DOUBLE AS done FROM events), chg AS (
      SELECT *, lag(done) OVER w AS prev FROM smp WINDOW w AS (PARTITION BY series ORDER BY ts, seq)), fresh AS (
      SELECT series, ts, seq, done, lag(ts) OVER v AS before, done - prev AS units, row_number() OVER v AS r FROM chg WHERE prev IS NULL OR done <> prev WINDOW v AS (PARTITION BY series ORDER BY ts, seq)), speed AS (
      SELECT series, list((ts - before) / units ORDER BY r) FILTER (r > 1) AS inst FROM fresh GROUP BY series)
    SELECT series, round_even(CASE WHEN inst IS NULL THEN NULL ELSE list_reduce(inst, lambda a, x: 0.15::DOUBLE * x + (1 - 0.15::DOUBLE) * a) END, 4) AS sec_per_unit FROM speed""",
)
def stream_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-8: the smoothed rate, kept as state."""
    stream, work = _stream(spark, sf_dir)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0
    samples = stream.select(
        F.col("user_id").cast("string").alias("series"), seconds.alias("ts"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 300).cast("double").alias("done"), F.lit(100.0).alias("total")
    )
    found = _finished(spark, jobs.progress_rates(samples), work, "series")
    return found.select("series", F.bround("sec_per_unit", 4).alias("sec_per_unit"))


@query(
    "stream_stale",
    "WITH h AS (SELECT user_id::VARCHAR AS job_id, max(event_id) AS heartbeat, count(*) AS events FROM events GROUP BY user_id) SELECT * FROM h WHERE heartbeat < (SELECT max(event_id) FROM events) - 150",
)
def stream_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-5, STR-6: signs of life kept by the stream; jobs silent for 150 events are stale."""
    stream, work = _stream(spark, sf_dir)
    signs = jobs.last_signs(stream.select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("ts")))
    found = _finished(spark, signs, work, "job_id")
    now = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id").alias("now"))
    return found.join(F.broadcast(now), F.col("heartbeat") < F.col("now") - 150).drop("now")


@query(
    "stream_accepted",
    """WITH n AS (SELECT event_id AS row_idx, user_id::VARCHAR AS domain, event_type || (event_id % 7)::VARCHAR AS norm FROM events)
    SELECT domain, row_idx, row_idx = min(row_idx) OVER (PARTITION BY domain, norm) AS accepted FROM n""",
)
def stream_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-9: rows are accepted unless their form was before; the state outlives batches."""
    stream, work = _stream(spark, sf_dir)
    rows = stream.select(F.col("user_id").cast("string").alias("domain"), F.col("event_id").alias("row_idx"), F.concat("event_type", (F.col("event_id") % 7).cast("string")).alias("norm"))
    jobs.run_once(jobs.accepted_questions(rows), f"{work}/out", f"{work}/checkpoint", mode="append")
    return spark.read.parquet(f"{work}/out").drop("batch_id")


@query(
    "stream_messages",
    """SELECT conv_id::VARCHAR AS message_id, md5(string_agg(text, '' ORDER BY turn)) AS text_md5, CASE WHEN max(turn) % 2 = 1 THEN 'complete' ELSE 'partial' END AS status FROM conversations GROUP BY conv_id""",
)
def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-7, SRC-18: texts that arrive in parts; one that never ended is partial."""
    from lectern.operators.chat import recovered

    work = _work_dir(spark, "messages")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    parts = c.select(F.col("conv_id").cast("string").alias("message_id"), F.col("turn").alias("seq"), F.col("text").alias("part"), F.lit(None).cast("string").alias("status"))
    ends = c.groupBy("conv_id").agg(F.max("turn").alias("t")).where("t % 2 = 1")
    ends = ends.select(F.col("conv_id").cast("string").alias("message_id"), (F.col("t") + 1).alias("seq"), F.lit("").alias("part"), F.lit("complete").alias("status"))
    parts.unionByName(ends).repartitionByRange(2, "seq").write.parquet(f"{work}/in")
    stream = jobs.event_stream(spark, f"{work}/in", "message_id string, seq long, part string, status string")
    found = _finished(spark, jobs.message_text(stream), work, "message_id")
    return recovered(found).select("message_id", F.md5("text").alias("text_md5"), "status")
