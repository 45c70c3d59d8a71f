"""Job queue and progress: states, claims, stale work, smoothed rates, times left, estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text

# Stages in order with the lane that runs them, final states, and the constants of
# the estimates (tokens and seconds for each row or source, retries, batch, demo share).
STAGES = (("ingest", "io"), ("generate", "io"), ("train", "gpu"), ("package", "gpu"), ("publish", "io"), ("deploy", "io"))
TERMINAL = ("succeeded", "failed", "cancelled")
TOKENS_IN, TOKENS_OUT, RETRIES, ROW_SECONDS = 1400, 700, 1.35, 7.0
SOURCE_TOKENS_IN, SOURCE_TOKENS_OUT, BATCH, DEMO_SHARE = 15_000, 3_000, 16, 0.5
QUANT_GB = {"Q4_K_M": 0.62, "Q5_K_M": 0.72}
QUANT_GB_OTHER = 1.07
SMOOTHING, STALE_SECONDS = 0.15, 120.0
# What the steps of packaging weigh.
PACKAGE_STEPS = (("merge", 0.35), ("convert", 0.30), ("quantize", 0.20), ("bundle", 0.15))

STAGE_NAMES = [s for s, _ in STAGES]


def lane(stage: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, where in STAGES:
        out = F.when(stage == name, where).otherwise(out)
    return out


def claimable(jobs: DataFrame, lanes: list[str]) -> DataFrame:
    return jobs.where((F.col("status") == "queued") & ~F.col("cancel_requested") & lane(F.col("next_stage")).isin(lanes))


def claim_next(jobs: DataFrame, lanes: list[str]) -> DataFrame:
    """The oldest claimable job of each lane: one for each worker that asks once."""
    r = F.row_number().over(Window.partitionBy("lane").orderBy("created_at", "job_id"))
    return claimable(jobs, lanes).withColumn("lane", lane(F.col("next_stage"))).withColumn("_r", r).where("_r = 1").drop("_r")


def assigned(jobs: DataFrame, workers: DataFrame) -> DataFrame:
    """(worker_id, job_id): the n-th worker of a lane gets the n-th claimable job of it."""
    j = claimable(jobs, sorted({w for _, w in STAGES})).withColumn("lane", lane(F.col("next_stage")))
    j = j.withColumn("n", F.row_number().over(Window.partitionBy("lane").orderBy("created_at", "job_id")))
    w = workers.withColumn("n", F.row_number().over(Window.partitionBy("lane").orderBy("worker_id")))
    return w.join(j.select("lane", "n", "job_id"), ["lane", "n"]).select("worker_id", "job_id")


def stale(jobs: DataFrame, now: Column, most: float = STALE_SECONDS) -> DataFrame:
    """Running jobs without a sign of life since ``most`` seconds before ``now``; none ever counts as stale."""
    return jobs.where((F.col("status") == "running") & (F.col("heartbeat").isNull() | (F.col("heartbeat") < now - most)))


def requeued(jobs: DataFrame, now: Column, most: float = STALE_SECONDS) -> DataFrame:
    """All jobs, stale ones queued again at the stage they were in, without worker and heartbeat."""
    old = (F.col("status") == "running") & (F.col("heartbeat").isNull() | (F.col("heartbeat") < now - most))
    return (
        jobs.withColumn("next_stage", F.when(old, F.coalesce("current_stage", "next_stage")).otherwise(F.col("next_stage")))
        .withColumn("worker_id", F.when(old, F.lit(None)).otherwise(F.col("worker_id")))
        .withColumn("heartbeat", F.when(old, F.lit(None)).otherwise(F.col("heartbeat")))
        .withColumn("status", F.when(old, "queued").otherwise(F.col("status")))
    )


def stage_after(stage: Column) -> Column:
    names = F.array(*map(F.lit, STAGE_NAMES))
    return F.try_element_at(names, (F.array_position(names, stage) + 1).cast("int"))


def advanced(stage: Column, ok: Column, review: Column, cancel: Column) -> Column:
    """(status, next_stage) after a stage has ended."""
    following = stage_after(stage)
    status = (
        F.when(cancel, "cancelled").when(~ok, "failed").when(following.isNull(), "succeeded")
        .when((stage == "ingest") & review, "awaiting_review").otherwise("queued")
    )
    return F.struct(status.alias("status"), F.when(ok & ~cancel, following).otherwise(stage).alias("next_stage"))


def job_state(events: DataFrame) -> DataFrame:
    """Each job's last status from its events (event_id, job_id, kind, status, ts) and its last sign of life."""
    return events.groupBy("job_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("event_id"))).alias("status"), F.max("ts").alias("heartbeat"), F.count("*").alias("events")
    )


def capacity(jobs: DataFrame, demo_limit: int) -> DataFrame:
    """Active real and demo jobs, and whether one more of each may start."""
    active = ~F.col("status").isin(*TERMINAL)
    n = lambda demo: F.coalesce(F.sum((active & (F.col("demo") == demo)).cast("long")), F.lit(0))
    return jobs.agg(n(False).alias("real"), n(True).alias("demos")).withColumn("real_allowed", F.col("real") < 1).withColumn("demo_allowed", F.col("demos") < demo_limit)


def recent_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.where(F.col("replaced_by").isNull()).orderBy(F.desc("created_at"), "job_id").limit(limit)


def jobs_by_ids(jobs: DataFrame, ids: list[str], most: int = 200) -> DataFrame:
    """Jobs of an id list in its order; repeats, ids beyond the cap and replaced jobs are left out."""
    wanted = list(dict.fromkeys(ids))[:most]
    order = jobs.sparkSession.createDataFrame(list(enumerate(wanted)), "place int, job_id string")
    return jobs.join(F.broadcast(order), "job_id").where(F.col("replaced_by").isNull()).orderBy("place").drop("place")


def valid_job_id(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{12}$")


def events_after(events: DataFrame, after: int, limit: int = 500) -> DataFrame:
    return events.where(F.col("event_id") > after).orderBy("event_id").limit(limit)


def event_tail(events: DataFrame, key: str, n: int) -> DataFrame:
    """The last ``n`` events of each key, oldest first."""
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("event_id")))
    return events.withColumn("_r", r).where(F.col("_r") <= n).drop("_r").orderBy(key, "event_id")


def shown_events(events: DataFrame) -> DataFrame:
    """Events with a message or of kind 'stage', with a severity."""
    message = F.coalesce(F.col("message"), F.lit(""))
    level = F.when(F.col("status") == "failed", "error").when(F.lower(message).rlike("warn|retry"), "warning").otherwise("info")
    return events.where((message != "") | (F.col("kind") == "stage")).withColumn("severity", level)


def _smooth(speed: Column, inst: Column) -> Column:
    return F.when(speed.isNull(), inst).otherwise(SMOOTHING * inst + (1 - SMOOTHING) * speed)


def smoothed_rate(samples: DataFrame) -> DataFrame:
    """Seconds per unit of each series, smoothed over its samples (series, ts seconds, seq, done).

    The rate moves when ``done`` grows; the clock starts anew on any change of it. One ordered
    fold over a sorted array for each series.
    """
    state = lambda done, at, speed: F.struct(done.cast("double").alias("done"), at.cast("double").alias("at"), speed.cast("double").alias("speed"))
    none = F.lit(None)

    def step(s: Column, x: Column) -> Column:
        grown = s["done"].isNotNull() & (x["done"] > s["done"])
        inst = (x["ts"] - s["at"]) / F.nullif(x["done"] - s["done"], F.lit(0.0))
        changed = s["done"].isNull() | (x["done"] != s["done"])
        return state(F.when(changed, x["done"]).otherwise(s["done"]), F.when(changed, x["ts"]).otherwise(s["at"]), F.when(grown, _smooth(s["speed"], inst)).otherwise(s["speed"]))

    ordered = F.array_sort(F.collect_list(F.struct("ts", "seq", F.col("done").cast("double").alias("done"))))
    folded = samples.groupBy("series").agg(ordered.alias("x")).withColumn("s", F.aggregate("x", state(none, none, none), step))
    first, last = F.element_at("x", 1), F.element_at("x", -1)
    return folded.select("series", F.col("s.speed").alias("sec_per_unit"), last["done"].alias("done"), first["done"].alias("base"), first["ts"].alias("started"), last["ts"].alias("now"))


def stage_eta(speed: Column, done: Column, total: Column, base: Column, elapsed: Column) -> Column:
    """Seconds left in a stage: by the smoothed rate, else by the mean since the start."""
    by_rate = F.greatest(F.lit(0.0), (total - done) * speed)
    by_mean = elapsed / F.nullif(done - base, F.lit(0.0)) * (total - done)
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(None)).when(speed.isNotNull(), by_rate).when(done > base, by_mean)


def throttled(samples: DataFrame, every: float = 1.0) -> DataFrame:
    """The samples (series, ts, seq, forced) that are written: forced ones, and those ``every`` seconds
    after the last written one. Sequential by nature: one fold for each series."""

    def step(s: Column, x: Column) -> Column:
        due = x["forced"] | s["last"].isNull() | (x["ts"] - s["last"] >= every)
        return F.struct(F.when(due, x["ts"]).otherwise(s["last"]).alias("last"), F.when(due, F.array_append(s["kept"], x["seq"])).otherwise(s["kept"]).alias("kept"))

    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<long>").alias("kept"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("ts").cast("double").alias("ts"), F.col("seq").cast("long").alias("seq"), F.coalesce("forced", F.lit(False)).alias("forced"))))
    return samples.groupBy("series").agg(ordered.alias("x")).select("series", F.explode(F.aggregate("x", start, step)["kept"]).alias("seq"))


def pipeline_eta(jobs: DataFrame, stages: DataFrame, now: Column) -> DataFrame:
    """(job_id, eta): seconds until a job is done. Finished: 0; failed, cancelled, waiting for review: null.

    ``jobs``: job_id, status. ``stages``: one row per job and stage: job_id, stage, status, eta_s,
    started_at, estimate.
    """
    left = (
        F.when(F.col("stage_status") == "done", 0.0)
        .when((F.col("stage_status") == "running") & F.col("eta_s").isNotNull(), F.col("eta_s"))
        .when(F.col("stage_status") == "running", F.greatest(F.lit(0.0), F.col("estimate") - F.coalesce(now - F.col("started_at"), F.lit(0.0))))
        .otherwise(F.col("estimate"))
    )
    s = stages.withColumnRenamed("status", "stage_status").groupBy("job_id").agg(F.sum(F.coalesce(left, F.lit(0.0))).alias("left"))
    eta = F.when(F.col("status") == "succeeded", 0).when(F.col("status").isin("failed", "cancelled", "awaiting_review"), None).otherwise(F.bround(F.coalesce("left", F.lit(0.0)), 0))
    return jobs.join(s, "job_id", "left").select("job_id", eta.cast("long").alias("eta"))


def overall_fraction(stages: DataFrame) -> DataFrame:
    """(job_id, fraction): done shares weighted by the stages' estimates (at least 1), 4 places."""
    weight = F.greatest(F.lit(1.0), F.coalesce(F.col("estimate").cast("double"), F.lit(1.0)))
    part = F.when(F.col("status") == "done", 1.0).when(F.col("status") == "running", F.coalesce("fraction", F.lit(0.0))).otherwise(0.0)
    return stages.groupBy("job_id").agg(F.bround(F.sum(weight * part) / F.sum(weight), 4).alias("fraction"))


def package_progress(step: Column, fraction: Column) -> Column:
    """Progress of packaging: the weights of the steps before, and the share of this one."""
    out, before = F.lit(None).cast("double"), 0.0
    for name, weight in PACKAGE_STEPS:
        out = F.when(step == name, F.lit(before) + F.lit(weight) * fraction).otherwise(out)
        before += weight
    return out


def estimates(configs: DataFrame, price_in: float = 0.15, price_out: float = 0.60) -> DataFrame:
    """Rows, steps, seconds by stage and in all, cost and size for job configurations.

    ``configs``: base_model, examples_per_course, epochs, generation_concurrency, quant, demo,
    hf_repo, n_courses, n_sources and what else is kept.
    """
    courses = F.greatest(F.lit(1), F.col("n_courses"))
    c = configs.withColumn("rows", (courses * F.col("examples_per_course")).cast("long")).withColumn("_size", text.model_size_b(F.col("base_model")))
    steps = F.ceil(F.col("rows") * F.lit(0.95) / BATCH) * F.col("epochs")
    c = c.withColumn("train_steps", F.when(F.col("demo"), F.greatest(F.lit(1), F.ceil(steps * F.lit(DEMO_SHARE)))).otherwise(steps).cast("long"))
    lanes = F.least(F.col("generation_concurrency"), courses)
    seconds = {
        "ingest": F.when(F.col("demo"), 5.0).otherwise(20.0 + 15.0 * F.greatest(F.lit(1), F.col("n_sources"))),
        "generate": F.when(F.col("demo"), F.col("rows") * 0.02).otherwise(F.col("rows") * ROW_SECONDS * RETRIES / lanes),
        "train": 300.0 + F.col("train_steps") * (1.2 * F.col("_size") + 0.5),
        "package": 120.0 + 160.0 * F.col("_size"),
        "publish": F.when(F.coalesce("hf_repo", F.lit("")) != "", 30.0 + 60.0 * F.col("_size") * 0.62).otherwise(1.0),
        "deploy": F.lit(2.0),
    }
    tokens_in = F.col("rows") * TOKENS_IN * RETRIES + F.col("n_sources") * SOURCE_TOKENS_IN
    tokens_out = F.col("rows") * TOKENS_OUT * RETRIES + F.col("n_sources") * SOURCE_TOKENS_OUT
    cost = F.when(F.col("demo"), 0.0).otherwise(tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out)
    per_b = F.lit(QUANT_GB_OTHER)
    for name, gb in QUANT_GB.items():
        per_b = F.when(F.col("quant") == name, gb).otherwise(per_b)
    total = sum(list(seconds.values())[1:], list(seconds.values())[0])
    return c.select(
        *configs.columns, "rows", "train_steps",
        F.create_map(*[x for k, v in seconds.items() for x in (F.lit(k), F.bround(v, 0).cast("long"))]).alias("stage_seconds"),
        F.bround(total, 0).cast("long").alias("total_seconds"), F.bround(cost, 2).alias("api_cost_usd"), F.bround(F.col("_size") * per_b, 1).alias("gguf_gb"),
    )


def usage(calls: DataFrame, price_in: float, price_out: float, *by: str) -> DataFrame:
    """Calls, tokens and cost (4 places) of each group."""
    u = calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    cost = F.col("prompt_tokens") / 1e6 * price_in + F.col("completion_tokens") / 1e6 * price_out
    return u.withColumn("cost_usd", F.bround(cost, 4))


def sliding_budget(calls: DataFrame, key: str, budget: int, seconds: int = 60) -> DataFrame:
    """Tokens used in the last ``seconds`` at every call, and whether they are over the budget."""
    w = f"sum(tokens) over (partition by {key} order by ts range between interval {seconds} seconds preceding and current row)"
    return calls.withColumn("used", F.expr(w)).withColumn("over", F.col("used") > budget)


def run_eta(done: DataFrame, total: int) -> DataFrame:
    """Time left of a run after each finished item (run, k, elapsed): the mean so far times what is left."""
    return done.withColumn("left_s", F.col("elapsed") / F.col("k") * (total - F.col("k")))


def backoff(attempt: Column, base: float, most: float) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))


def first_unfinished(progress: Column) -> Column:
    """The first stage whose status in a map of stages is not 'done'."""
    left = F.filter(F.array(*map(F.lit, STAGE_NAMES)), lambda s: F.coalesce(F.try_element_at(progress, s), F.lit("pending")) != "done")
    return F.try_element_at(left, F.lit(1))


def job_view(progress: Column) -> Column:
    """Stages as an array of (stage, lane, status), those without progress pending."""
    status = lambda s: F.coalesce(F.try_element_at(progress, F.lit(s)), F.lit("pending"))
    return F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(w).alias("lane"), status(s).alias("status")) for s, w in STAGES])


def complete_checkpoints(files: DataFrame, required: list[str], micro_batch: int | None = None) -> DataFrame:
    """The newest step of each run whose folder holds all required files, none of them broken, written
    with the same micro-batch. ``files``: run, step, name and perhaps whole, micro_batch."""
    good = F.col("name").isin(required)
    if "whole" in files.columns:
        good = good & F.col("whole")
    have = files.where(good)
    if micro_batch is not None:
        have = have.where(F.col("micro_batch") == micro_batch)
    steps = have.groupBy("run", "step").agg(F.countDistinct("name").alias("k")).where(F.col("k") == len(required))
    return steps.groupBy("run").agg(F.max("step").alias("step"))


# Scratch gigabytes for each billion of parameters, by what a model is converted to.
SCRATCH_GB, SCRATCH_Q8_GB, SCRATCH_MORE_GB = 4.8, 3.5, 2.0


def export_type(size_b: Column, free_gb: Column) -> Column:
    """What a model of ``size_b`` billions is converted to on the disk there is: bf16, q8_0 or nothing."""
    return F.when(free_gb >= SCRATCH_GB * size_b + SCRATCH_MORE_GB, "bf16").when(free_gb >= SCRATCH_Q8_GB * size_b + SCRATCH_MORE_GB, "q8_0").otherwise("fail")


DEVICE = r"^\s*(\S*\d): (.+) \((\d+)\s"
# Names that tell graphics that share memory, and cards of their own.
SHARED_GRAPHICS = r"\(tm\) graphics|uhd graphics|iris|vega|radeon graphics"
OWN_CARD = "nvidia|radeon rx|arc"


def devices(texts: DataFrame) -> DataFrame:
    """(host, pos, id, name, total_mib) from the lines of device lists (host, text)."""
    lines = texts.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).where(F.col("line").rlike(DEVICE))
    part = lambda i: F.regexp_extract("line", DEVICE, i)
    return lines.select("host", "pos", part(1).alias("id"), F.trim(part(2)).alias("name"), part(3).cast("long").alias("total_mib"))


def best_device(found: DataFrame) -> DataFrame:
    """The best of several devices of a host: own cards before others before shared ones, then by
    memory, the last of equals; hosts with one device choose none."""
    low = F.lower("name")
    score = F.when(low.rlike(SHARED_GRAPHICS), 0).when(low.rlike(OWN_CARD), 2).otherwise(1)
    return found.groupBy("host").agg(F.count("*").alias("n"), F.max_by("id", F.struct(score, "total_mib", "pos")).alias("id")).where("n > 1").select("host", "id")
