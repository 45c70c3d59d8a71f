"""Streams of job events: states, progress with time left, stale work, feeds and idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lectern.operators.jobs import SMOOTHING, STAGE_NAMES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: status -> what may follow; an event that does not follow is ignored.
JOB_MOVES = {
    None: {"staging", "queued"},
    "staging": {"queued", "cancelled"},
    "queued": {"running", "cancelled"},
    "running": {"queued", "awaiting_review", "succeeded", "failed", "cancelled"},
    "awaiting_review": {"queued", "cancelled"},
    "failed": {"queued"},
    "cancelled": {"queued"},
    "succeeded": set(),
}
ENGINE_MOVES = {
    None: {"noModel", "starting", "downloading"},
    "noModel": {"starting", "downloading"},
    "downloading": {"starting", "failed", "noModel"},
    "starting": {"ready", "failed", "stopped"},
    "ready": {"stopped", "failed", "starting"},
    "failed": {"starting", "stopped", "downloading"},
    "stopped": {"starting", "noModel", "downloading"},
}


def fold_states(statuses: list[str], moves: dict[str | None, set[str]], state: str | None = None) -> tuple[str | None, int]:
    """The state after a list of statuses, and how many of them did not follow."""
    ignored = 0
    for s in statuses:
        if s in moves.get(state, set()):
            state = s
        elif s != state:
            ignored += 1
    return state, ignored


class StateMachine(StatefulProcessor):
    """Per key: the state after all events so far, in the order of their numbers within a batch."""

    def __init__(self, moves: dict[str | None, set[str]]) -> None:
        self.moves = moves

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "status string, events long, ignored long, last_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]
        batch = pd.concat(list(rows)).sort_values("event_id")
        status, events, ignored, last = self.state.get() if self.state.exists() else (None, 0, 0, -1)
        batch = batch[batch["event_id"] > last]  # a batch that is repeated changes nothing
        status, more = fold_states([s for s in batch["status"] if isinstance(s, str)], self.moves, status)
        events, ignored = events + len(batch), ignored + more
        if len(batch):
            last = int(batch["event_id"].iloc[-1])
        self.state.update((status, events, ignored, last))
        yield pd.DataFrame([(key[0], status, events, ignored)], columns=["job_id", "status", "events", "ignored"])


def job_states(events: DataFrame, moves: dict[str | None, set[str]] | None = None) -> DataFrame:
    """(job_id, status, events, ignored) updates from a stream of (job_id, event_id, status)."""
    return events.select("job_id", "event_id", "status").groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=StateMachine(moves or JOB_MOVES), outputStructType="job_id string, status string, events long, ignored long", outputMode="Update", timeMode="None"
    )


class SmoothedRate(StatefulProcessor):
    """Per series: seconds per unit, smoothed as the batch operator does it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("rate", "done double, at double, speed double, base double, started double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]
        done, at, speed, base, started = self.state.get() if self.state.exists() else (None, None, None, None, None)
        total = now = 0.0
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples():
            if base is None:
                base, started = float(r.done), float(r.ts)
            if done is not None and r.done > done:
                inst = (r.ts - at) / (r.done - done)
                speed = inst if speed is None else SMOOTHING * inst + (1 - SMOOTHING) * speed
            if done is None or r.done != done:
                done, at = float(r.done), float(r.ts)
            total, now = float(r.total), float(r.ts)
        self.state.update((done, at, speed, base, started))
        eta = None
        if total and speed is not None:
            eta = max(0.0, (total - done) * speed)
        elif total and done > base:
            eta = (now - started) / (done - base) * (total - done)
        yield pd.DataFrame([(key[0], done, speed, eta)], columns=["series", "done", "sec_per_unit", "eta_s"])


def progress_rates(samples: DataFrame) -> DataFrame:
    """(series, done, sec_per_unit, eta_s) updates from a stream of (series, ts, seq, done, total)."""
    return samples.groupBy("series").transformWithStateInPandas(
        statefulProcessor=SmoothedRate(), outputStructType="series string, done double, sec_per_unit double, eta_s double", outputMode="Update", timeMode="None"
    )


class AcceptedQuestions(StatefulProcessor):
    """Per domain: a question is accepted unless an accepted one before it has the same normal form;
    what was accepted survives restarts in the checkpoint."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "norm string", "first_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]
        out = []
        for r in pd.concat(list(rows)).sort_values("row_idx").itertuples():
            norm = (r.norm,)
            first = self.seen.getValue(norm)[0] if self.seen.containsKey(norm) else None
            if first is None:
                self.seen.updateValue(norm, (int(r.row_idx),))
            out.append((key[0], int(r.row_idx), first is None))
        yield pd.DataFrame(out, columns=["domain", "row_idx", "accepted"])


def accepted_questions(rows: DataFrame) -> DataFrame:
    """(domain, row_idx, accepted) from a stream of (domain, row_idx, norm)."""
    return rows.groupBy("domain").transformWithStateInPandas(
        statefulProcessor=AcceptedQuestions(), outputStructType="domain string, row_idx long, accepted boolean", outputMode="Append", timeMode="None"
    )


def last_signs(events: DataFrame) -> DataFrame:
    """Latest sign of life of each job, for an update-mode stream; compare with now to find stale ones."""
    return events.groupBy("job_id").agg(F.max("ts").alias("heartbeat"), F.count("*").alias("events"))


class SilenceTimer(StatefulProcessor):
    """Per job: a requeue row once no event has come for ``most_ms`` of processing time."""

    def __init__(self, most_ms: int) -> None:
        self.most_ms = most_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("stage", "stage string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]
        last = pd.concat(list(rows)).sort_values("event_id").iloc[-1]
        self.state.update((str(last["stage"]),))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.most_ms)
        yield pd.DataFrame({"job_id": [], "next_stage": []}).astype("string")

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:  # type: ignore[no-untyped-def]
        stage = self.state.get()[0] if self.state.exists() else None
        self.state.clear()
        yield pd.DataFrame([(key[0], stage)], columns=["job_id", "next_stage"])


def requeues(events: DataFrame, most_ms: int = 120_000) -> DataFrame:
    return events.select("job_id", "event_id", "stage").groupBy("job_id").transformWithStateInPandas(
        statefulProcessor=SilenceTimer(most_ms), outputStructType="job_id string, next_stage string", outputMode="Update", timeMode="ProcessingTime"
    )


def message_text(chunks: DataFrame) -> DataFrame:
    """Text so far of each streamed message, parts in order: (message_id, text, status)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda e: F.coalesce(e["part"], F.lit("")))
    ended = F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq")))
    return chunks.groupBy("message_id").agg(F.array_join(parts, "").alias("text"), F.coalesce(ended, F.lit("streaming")).alias("status"))


def event_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Events as Parquet files arrive in a folder; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Read all there is and stop. Every batch overwrites its own folder, so one that is repeated
    after a failure leaves what it left before."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    # several state variables for each key need a store with column families
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = stream.writeStream.foreachBatch(write_batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def last_updates(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last update of each key that ``run_once`` has written."""
    from lectern.operators.chat import latest

    return latest(spark.read.parquet(path), [key], "batch_id").drop("batch_id")


def stage_position(stage: str) -> int:
    return STAGE_NAMES.index(stage)
