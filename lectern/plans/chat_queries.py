"""Conversations, search, job queues and progress over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chat, jobs, search
from lectern.plans.registry import query
from lectern.plans.tables import MESSAGES_SQL, NOW, messages
from lectern.session import table

_TURNS = f"""{MESSAGES_SQL}, kept AS (SELECT * FROM messages WHERE NOT (role = 'assistant' AND trim(text) = '')), marked AS (
  SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN 1 ELSE 0 END AS new FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), grouped AS (
  SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM marked), merged AS (
  SELECT conv_id, g, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM grouped GROUP BY conv_id, g, role), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY g)::INTEGER AS turn, role, text FROM merged WHERE NOT (g = 1 AND role = 'assistant')
)"""
_TRIMMED = f"""{_TURNS}, rest AS (
  SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM turns), cut AS (
  SELECT *, min(CASE WHEN k % 2 = 0 AND (rest <= 700 OR n - k <= 2) THEN k END) OVER (PARTITION BY conv_id) AS start FROM rest), trimmed AS (
  SELECT conv_id, turn, role, text FROM cut WHERE k >= start
)"""


@query("merge_turns", f"WITH {_TURNS} SELECT conv_id, turn, role, md5(text) AS text_md5 FROM turns")
def merge_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-10, FLT-24."""
    return chat.merged_turns(messages(spark, sf_dir)).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("trim_context", f"WITH {_TRIMMED} SELECT conv_id, turn, role, md5(text) AS text_md5 FROM trimmed")
def trim_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11."""
    return chat.trimmed(chat.merged_turns(messages(spark, sf_dir)), 700).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(
    "trim_context_portable",
    f"""WITH {MESSAGES_SQL}, used AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM messages), fit AS (
      SELECT * FROM used WHERE used <= 700 OR r = 1), f AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS first FROM fit)
    SELECT conv_id, turn, role, md5(text) AS text_md5 FROM f WHERE turn >= first""",
)
def trim_context_portable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-12."""
    return chat.trimmed_portable(messages(spark, sf_dir), 700).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(
    "prompt_preamble",
    f"WITH {_TRIMMED} SELECT conv_id, turn, role, md5(CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 'Teach.' || chr(10) || chr(10) || text ELSE text END) AS text_md5 FROM trimmed",
)
def prompt_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-13: the whole prompt, for a window that leaves 700 characters."""
    planned = chat.prompts(messages(spark, sf_dir), "Teach.", context=454, max_tokens=100)
    return planned.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(
    "date_buckets",
    f"""SELECT event_id, CASE WHEN ts >= d THEN 'Today' WHEN ts >= d - INTERVAL 1 DAY THEN 'Yesterday' WHEN ts >= d - INTERVAL 7 DAY THEN 'Previous 7 days' WHEN ts >= d - INTERVAL 30 DAY THEN 'Previous 30 days' ELSE 'Older' END AS bucket
    FROM events, (SELECT date_trunc('day', TIMESTAMP '{NOW}') AS d)""",
)
def date_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", chat.date_bucket(F.col("ts").cast("timestamp_ntz"), F.expr(f"timestamp_ntz'{NOW}'")).alias("bucket"))


@query(
    "date_groups",
    f"""WITH u AS (SELECT user_id AS id, max(ts) AS t FROM events GROUP BY user_id), b AS (SELECT id, t, CASE WHEN t >= d THEN 'Today' WHEN t >= d - INTERVAL 1 DAY THEN 'Yesterday' WHEN t >= d - INTERVAL 7 DAY THEN 'Previous 7 days' WHEN t >= d - INTERVAL 30 DAY THEN 'Previous 30 days' ELSE 'Older' END AS bucket
      FROM u, (SELECT TIMESTAMP '2024-01-30 00:00:00' AS d)), n AS (SELECT *, lag(bucket) OVER (ORDER BY t DESC, id) IS DISTINCT FROM bucket AS new FROM b), p AS (SELECT *, sum(new::INT) OVER (ORDER BY t DESC, id) AS place FROM n)
    SELECT id, bucket, place::INTEGER AS place FROM p""",
)
def date_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14, SRT-3: runs of equal buckets, newest first."""
    c = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("updated_at"))
    return chat.date_groups(c, F.expr("timestamp_ntz'2024-01-30 18:00:00'"))


_FOLD = f"translate(lower(text), '{search.MARKED}', '{search.PLAIN}')"
_INDEX = f"""tok AS (SELECT conv_id * 1000 + turn AS message_id, list_filter(regexp_split_to_array({_FOLD}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM conversations), idx AS (
  SELECT message_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM tok)"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "conv_id", "text")


@query(
    "phrase_search",
    f"""WITH {_INDEX}, p AS (SELECT message_id, pos - i AS start, count(DISTINCT i) AS k FROM idx JOIN (VALUES ('of', 0), ('the', 1)) q(token, i) USING (token) GROUP BY ALL HAVING count(DISTINCT i) = 2)
    SELECT message_id, count(*) AS hits, min(start)::INTEGER AS first_pos FROM p GROUP BY message_id""",
)
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-15, FLT-23: messages with the phrase "of the"."""
    return search.phrase_matches(search.build_index(_messages(spark, sf_dir)), ["of", "the"])


@query(
    "search_ranked",
    f"""WITH {_INDEX}, p AS (SELECT message_id, pos - i AS start FROM idx JOIN (VALUES ('of', 0), ('the', 1)) q(token, i) USING (token) GROUP BY ALL HAVING count(DISTINCT i) = 2), m AS (
      SELECT message_id, count(*) AS hits FROM p GROUP BY message_id), s AS (SELECT message_id, count(*) AS n FROM idx GROUP BY message_id), f AS (SELECT count(*) AS docs, avg(n) AS mean FROM s), d AS (SELECT count(*) AS df FROM m)
    SELECT message_id, hits, round_even(-greatest(1e-6::DOUBLE, ln((docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * (hits * 2.2::DOUBLE / (hits + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))), 6) AS rank FROM m JOIN s USING (message_id), f, d""",
)
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-15: the matches with their weight."""
    index = search.build_index(_messages(spark, sf_dir))
    return search.ranked(search.phrase_matches(index, ["of", "the"]), index).select("message_id", "hits", F.bround("rank", 6).alias("rank"))


@query("search_snippet")
def search_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-11, WIN-15, SCL-47: the fifty best messages with titles and marked snippets (unit-tested)."""
    c = table(spark, sf_dir, "conversations")
    titles = c.where("turn = 0").select("conv_id", F.left("text", F.lit(30)).alias("title"))
    return search.search(_messages(spark, sf_dir), titles, "of the", 50)


@query(
    "conversation_store",
    """WITH c AS (SELECT conv_id, min(turn) * 1000 AS created_at, max(turn) * 1000 AS updated_at, arg_max(left(text, 20), turn) FILTER (role = 'user') AS title FROM conversations GROUP BY conv_id)
    SELECT * FROM c WHERE conv_id % 9 <> 0""",
)
def conversation_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-6, SNK-7, SNK-14: conversations from a log of changes with deletions."""
    c = table(spark, sf_dir, "conversations")
    log = c.select("conv_id", F.col("turn").alias("seq"), F.lit("insert").alias("op"), F.when(F.col("role") == "user", F.left("text", F.lit(20))).alias("title"), (F.col("turn") * 1000).alias("at"))
    gone = c.where("conv_id % 9 = 0").select("conv_id", F.lit(10**6).cast("long").alias("seq"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("title"), F.lit(0).cast("long").alias("at")).distinct()
    return chat.conversation_state(log.unionByName(gone))


@query("cascade_delete", "SELECT conv_id, turn FROM conversations WHERE conv_id % 5 <> 0")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-7: children of deleted parents go."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return chat.cascade_delete(c, c.where("conv_id % 5 = 0"), "conv_id")


@query("settings_upsert", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def settings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-6, SRC-7: the last value of each key."""
    return chat.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query(
    "event_tail",
    "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 12",
)
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-6, WIN-20: the last twelve events of each job (the limit is the feature)."""
    return jobs.event_tail(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", 12)


@query("events_after", "SELECT event_id, event_type FROM events WHERE event_id > 4321 ORDER BY event_id LIMIT 500")
def events_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-7, STR-2: a page of the feed."""
    return jobs.events_after(table(spark, sf_dir, "events").select("event_id", "event_type"), 4321)


@query("event_payload_flatten", "SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def event_payload_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-5, ARR-9."""
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select("event_id", "event_type", v.alias("k"))


@query(
    "shown_events",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'click' THEN 'warning' ELSE 'info' END AS severity FROM events WHERE event_type IN ('click', 'error') OR user_id % 2 = 0""",
)
def shown_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-25."""
    e = table(spark, sf_dir, "events")
    message = F.when(F.col("event_type") == "click", "will retry").when(F.col("event_type") == "error", "stopped").otherwise("")
    kind = F.when(F.col("user_id") % 2 == 0, "stage").otherwise("progress")
    e = e.select("event_id", message.alias("message"), kind.alias("kind"), F.when(F.col("event_type") == "error", "failed").alias("status"))
    return jobs.shown_events(e).select("event_id", "severity")


@query(
    "sliding_token_budget",
    """WITH s AS (SELECT event_id, ts, user_id, event_id % 97 AS tokens FROM events), u AS (
      SELECT event_id, sum(tokens) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 36000 SECONDS PRECEDING AND CURRENT ROW)::BIGINT AS used FROM s)
    SELECT event_id, used, used > 300 AS over FROM u""",
)
def sliding_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-16."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", (F.col("event_id") % 97).alias("tokens"))
    return jobs.sliding_budget(e, "user_id", 300, 36_000).select("event_id", "used", "over")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress samples: events in order, seconds since the first day, units done."""
    e = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0
    return e.select(F.col("user_id").cast("string").alias("series"), seconds.alias("ts"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 300).cast("double").alias("done"))


_STEPS = """smp AS (SELECT user_id::VARCHAR AS series, epoch_us(ts) / 1e6::DOUBLE - 1704067200.0::DOUBLE AS ts, event_id AS seq, floor(event_id / 300)::DOUBLE AS done FROM events), chg AS (
  SELECT *, lag(done) OVER w AS prev FROM smp WINDOW w AS (PARTITION BY series ORDER BY ts, seq)), fresh AS (
  SELECT series, ts, seq, done, lag(ts) OVER v AS before, done - prev AS units, row_number() OVER v AS r FROM chg WHERE prev IS NULL OR done <> prev WINDOW v AS (PARTITION BY series ORDER BY ts, seq)), speed AS (
  SELECT series, list((ts - before) / units ORDER BY r) FILTER (r > 1) AS inst FROM fresh GROUP BY series)"""


@query(
    "eta_ema",
    f"""WITH {_STEPS} SELECT series, round_even(CASE WHEN inst IS NULL THEN NULL ELSE list_reduce(inst, lambda a, x: 0.15::DOUBLE * x + (1 - 0.15::DOUBLE) * a) END, 4) AS sec_per_unit FROM speed""",
)
def eta_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-8, STR-8: smoothed seconds per unit of each series."""
    return jobs.smoothed_rate(_samples(spark, sf_dir)).select("series", F.bround("sec_per_unit", 4).alias("sec_per_unit"))


@query("write_throttle")
def write_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-9: the samples that are written (held against a plain loop in the tests)."""
    s = _samples(spark, sf_dir).withColumn("forced", F.col("seq") % 50 == 0)
    return jobs.throttled(s, 3600.0)


@query(
    "run_eta",
    "SELECT user_id, k, round_even(e::DOUBLE / k * (200 - k), 3) AS left_s FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS k, sum(event_id % 977) OVER (PARTITION BY user_id ORDER BY event_id) AS e FROM events)",
)
def run_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-19."""
    w = "over (partition by user_id order by event_id rows between unbounded preceding and current row)"
    d = table(spark, sf_dir, "events").selectExpr("user_id", "row_number() over (partition by user_id order by event_id) as k", f"sum(event_id % 977) {w} as elapsed")
    return jobs.run_eta(d, 200).select("user_id", "k", F.bround("left_s", 3).alias("left_s"))


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per job (user) and stage; what a stage has got to follows from numbers."""
    u = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id")).distinct()
    s = u.select("job_id", F.posexplode(F.array(*map(F.lit, jobs.STAGE_NAMES))).alias("i", "stage"))
    at = F.col("job_id") % 7
    status = F.when(F.col("i") < at, "done").when(F.col("i") == at, "running").otherwise("pending")
    running = F.col("i") == at
    return s.select(
        "job_id", "stage", status.alias("status"), F.when(running & (F.col("job_id") % 2 == 0), (F.col("job_id") * 1.5)).alias("eta_s"), F.when(running, F.lit(1000.0) - F.col("job_id")).alias("started_at"),
        (F.col("i") * 100 + F.lit(10)).cast("double").alias("estimate"), F.when(running, (F.col("job_id") % 10) / 10).alias("fraction"),
    )


_STAGES = """st AS (SELECT DISTINCT user_id AS job_id, i, user_id % 7 AS cur FROM events, range(6) t(i)), sg AS (
  SELECT job_id, i, CASE WHEN i < cur THEN 'done' WHEN i = cur THEN 'running' ELSE 'pending' END AS status, CASE WHEN i = cur AND job_id % 2 = 0 THEN job_id * 1.5::DOUBLE END AS eta_s,
         CASE WHEN i = cur THEN 1000.0::DOUBLE - job_id END AS started_at, (i * 100 + 10)::DOUBLE AS estimate, CASE WHEN i = cur THEN (job_id % 10) / 10::DOUBLE END AS fraction FROM st)"""


@query(
    "pipeline_eta",
    f"""WITH {_STAGES}, l AS (SELECT job_id, sum(CASE WHEN status = 'done' THEN 0 WHEN status = 'running' AND eta_s IS NOT NULL THEN eta_s WHEN status = 'running' THEN greatest(0, estimate - (1200 - started_at)) ELSE estimate END) AS left_s FROM sg GROUP BY job_id)
    SELECT job_id, CASE WHEN job_id % 7 = 6 THEN 0 WHEN job_id % 11 = 0 THEN NULL ELSE round_even(left_s, 0) END::BIGINT AS eta FROM l""",
)
def pipeline_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20."""
    s = _stages(spark, sf_dir)
    status = F.when(F.col("job_id") % 7 == 6, "succeeded").when(F.col("job_id") % 11 == 0, "awaiting_review").otherwise("running")
    return jobs.pipeline_eta(s.select("job_id").distinct().withColumn("status", status), s, F.lit(1200.0))


@query("overall_fraction", f"WITH {_STAGES} SELECT job_id, round_even(sum(greatest(1, estimate) * CASE status WHEN 'done' THEN 1 WHEN 'running' THEN coalesce(fraction, 0) ELSE 0 END) / sum(greatest(1, estimate)), 4) AS fraction FROM sg GROUP BY job_id")
def overall_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21."""
    return jobs.overall_fraction(_stages(spark, sf_dir))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job per order: status, next stage, heartbeat and more follow from its numbers."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    names = F.array(*map(F.lit, jobs.STAGE_NAMES))
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "succeeded", "failed", "staging"))), (F.col("k") % 5 + 1).cast("int"))
    return o.select(
        F.lpad(F.hex("k"), 12, "0").alias("job_id"), (F.col("c") * 1000 + F.col("k") % 1000).cast("double").alias("created_at"), status.alias("status"),
        F.element_at(names, (F.col("c") % 6 + 1).cast("int")).alias("next_stage"), F.element_at(names, (F.col("k") % 6 + 1).cast("int")).alias("current_stage"),
        (F.col("k") % 13 == 0).alias("cancel_requested"), F.when(F.col("k") % 7 != 0, (F.col("k") % 400).cast("double")).alias("heartbeat"), F.lit("w").alias("worker_id"),
        (F.col("k") % 3 == 0).alias("demo"), F.when(F.col("k") % 10 == 0, "x").alias("replaced_by"),
    )


_JOBS = """job AS (
  SELECT lpad(upper(to_hex(o_orderkey)), 12, '0') AS job_id, (o_custkey * 1000 + o_orderkey % 1000)::DOUBLE AS created_at, ['queued', 'running', 'succeeded', 'failed', 'staging'][o_orderkey % 5 + 1] AS status,
    ['ingest', 'generate', 'train', 'package', 'publish', 'deploy'][o_custkey % 6 + 1] AS next_stage, ['ingest', 'generate', 'train', 'package', 'publish', 'deploy'][o_orderkey % 6 + 1] AS current_stage,
    o_orderkey % 13 = 0 AS cancel_requested, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 400)::DOUBLE END AS heartbeat, o_orderkey % 3 = 0 AS demo, CASE WHEN o_orderkey % 10 = 0 THEN 'x' END AS replaced_by FROM orders
), claim AS (SELECT *, CASE WHEN next_stage IN ('train', 'package') THEN 'gpu' ELSE 'io' END AS lane FROM job WHERE status = 'queued' AND NOT cancel_requested)"""


@query("claim_next", f"WITH {_JOBS} SELECT lane, arg_min(job_id, (created_at, job_id)) AS job_id FROM claim GROUP BY lane")
def claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17, SRT-2, STR-4: the next job of each lane."""
    return jobs.claim_next(_jobs(spark, sf_dir), ["io", "gpu"]).select("lane", "job_id")


@query(
    "job_assignment",
    f"""WITH {_JOBS}, r AS (SELECT lane, job_id, row_number() OVER (PARTITION BY lane ORDER BY created_at, job_id) AS n FROM claim), w AS (
      SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'gpu' ELSE 'io' END AS lane, row_number() OVER (PARTITION BY CASE WHEN s_suppkey % 4 = 0 THEN 'gpu' ELSE 'io' END ORDER BY s_suppkey) AS n FROM supplier)
    SELECT s_suppkey AS worker_id, job_id FROM w JOIN r USING (lane, n)""",
)
def job_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-4: one job for each free worker, oldest first."""
    w = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("worker_id"), F.when(F.col("s_suppkey") % 4 == 0, "gpu").otherwise("io").alias("lane"))
    return jobs.assigned(_jobs(spark, sf_dir), w)


@query("stale_jobs", f"WITH {_JOBS} SELECT job_id FROM job WHERE status = 'running' AND (heartbeat IS NULL OR heartbeat < 400 - 120)")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18."""
    return jobs.stale(_jobs(spark, sf_dir), F.lit(400.0)).select("job_id")


@query(
    "requeued_jobs",
    f"""WITH {_JOBS}, s AS (SELECT *, status = 'running' AND (heartbeat IS NULL OR heartbeat < 280) AS old FROM job)
    SELECT job_id, CASE WHEN old THEN 'queued' ELSE status END AS status, CASE WHEN old THEN current_stage ELSE next_stage END AS next_stage, NOT old AS has_worker FROM s""",
)
def requeued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-6: stale work is queued again where it was."""
    return jobs.requeued(_jobs(spark, sf_dir), F.lit(400.0)).select("job_id", "status", "next_stage", F.col("worker_id").isNotNull().alias("has_worker"))


@query(
    "job_state",
    "SELECT user_id::VARCHAR AS job_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS status, max(event_id) AS heartbeat, count(*) AS events FROM events GROUP BY user_id",
)
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1, STR-5: the last status of each job; some events carry none."""
    e = table(spark, sf_dir, "events")
    e = e.select(F.col("user_id").cast("string").alias("job_id"), "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("status"), F.col("event_id").alias("ts"))
    return jobs.job_state(e)


@query(
    "advanced_jobs",
    f"""WITH {_JOBS}, a AS (SELECT job_id, current_stage AS s, created_at::BIGINT % 17 <> 0 AS ok, demo AS review, cancel_requested AS cancel, list_position(['ingest', 'generate', 'train', 'package', 'publish', 'deploy'], current_stage) AS i FROM job)
    SELECT job_id, CASE WHEN cancel THEN 'cancelled' WHEN NOT ok THEN 'failed' WHEN i = 6 THEN 'succeeded' WHEN s = 'ingest' AND review THEN 'awaiting_review' ELSE 'queued' END AS status,
      CASE WHEN ok AND NOT cancel THEN ['ingest', 'generate', 'train', 'package', 'publish', 'deploy'][i + 1] ELSE s END AS next_stage FROM a""",
)
def advanced_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-1, STR-11: what follows the end of a stage."""
    ok = F.col("created_at").cast("long") % 17 != 0
    return _jobs(spark, sf_dir).select("job_id", jobs.advanced(F.col("current_stage"), ok, F.col("demo"), F.col("cancel_requested")).alias("a")).select("job_id", "a.*")


@query(
    "job_capacity",
    f"WITH {_JOBS}, c AS (SELECT count(*) FILTER (status IN ('queued', 'running', 'staging') AND NOT demo) AS real, count(*) FILTER (status IN ('queued', 'running', 'staging') AND demo) AS demos FROM job) SELECT real, demos, real < 1 AS real_allowed, demos < 3 AS demo_allowed FROM c",
)
def job_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16, AGG-28."""
    return jobs.capacity(_jobs(spark, sf_dir), 3)


@query("recent_jobs", f"WITH {_JOBS} SELECT job_id, created_at FROM job WHERE replaced_by IS NULL ORDER BY created_at DESC, job_id LIMIT 50")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-1: the fifty newest jobs (the limit is the feature)."""
    return jobs.recent_jobs(_jobs(spark, sf_dir)).select("job_id", "created_at")


@query(
    "first_unfinished",
    f"WITH {_STAGES} SELECT job_id, ['ingest', 'generate', 'train', 'package', 'publish', 'deploy'][min(CASE WHEN status <> 'done' THEN i END) + 1] AS stage FROM sg GROUP BY job_id",
)
def first_unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11, ARR-4, ARR-6: where a retry starts, from the map of stages."""
    m = _stages(spark, sf_dir).groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "status"))).alias("p"))
    return m.select("job_id", jobs.first_unfinished(F.col("p")).alias("stage"))


@query(
    "usage_totals",
    """SELECT event_type, count(*) AS calls, sum(event_id % 1000)::BIGINT AS prompt_tokens, sum(user_id)::BIGINT AS completion_tokens, round_even(sum(event_id % 1000) / 1e6::DOUBLE * 0.15::DOUBLE + sum(user_id) / 1e6::DOUBLE * 0.6::DOUBLE, 4) AS cost_usd FROM events GROUP BY event_type""",
)
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19, SCL-38."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 1000).alias("prompt_tokens"), F.col("user_id").alias("completion_tokens"))
    return jobs.usage(e, 0.15, 0.6, "event_type")


_GRID = """cfg AS (SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'org/model-1.5B-Instruct' WHEN 1 THEN 'org/model2.0' ELSE 'org/m-12b' END AS base_model, CASE n_nationkey % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 7.0 ELSE 12.0 END::DOUBLE AS size,
  100 + n_nationkey * 37 AS e, 1 + n_nationkey % 4 AS epochs, 1 + n_nationkey % 5 AS lanes, CASE n_nationkey % 3 WHEN 0 THEN 'Q4_K_M' WHEN 1 THEN 'Q5_K_M' ELSE 'Q8_0' END AS quant, n_nationkey % 4 = 0 AS demo, n_nationkey % 2 = 0 AS hub, n_nationkey % 6 AS courses, n_nationkey % 3 AS sources FROM nation), a AS (
  SELECT *, greatest(1, courses) * e AS rows FROM cfg), b AS (SELECT *, ceil(rows * 0.95::DOUBLE / 16) * epochs AS full_steps FROM a), c AS (SELECT *, CASE WHEN demo THEN greatest(1, ceil(full_steps * 0.5)) ELSE full_steps END AS steps FROM b), s AS (
  SELECT *, CASE WHEN demo THEN 5 ELSE 20 + 15 * greatest(1, sources) END::DOUBLE AS s1, CASE WHEN demo THEN rows * 0.02::DOUBLE ELSE rows * 7.0::DOUBLE * 1.35::DOUBLE / least(lanes, greatest(1, courses)) END AS s2, 300 + steps * (1.2::DOUBLE * size + 0.5::DOUBLE) AS s3,
    120 + 160 * size AS s4, CASE WHEN hub THEN 30 + 60 * size * 0.62::DOUBLE ELSE 1 END AS s5, 2.0::DOUBLE AS s6 FROM c)"""


@query(
    "estimate_grid",
    f"""WITH {_GRID} SELECT id, rows::BIGINT AS rows, steps::BIGINT AS train_steps, round_even(s1, 0)::BIGINT AS ingest_s, round_even(s2, 0)::BIGINT AS generate_s, round_even(s3, 0)::BIGINT AS train_s, round_even(s1 + s2 + s3 + s4 + s5 + s6, 0)::BIGINT AS total_seconds,
      round_even(CASE WHEN demo THEN 0 ELSE (rows * 1400 * 1.35::DOUBLE + sources * 15000) / 1e6 * 0.15::DOUBLE + (rows * 700 * 1.35::DOUBLE + sources * 3000) / 1e6 * 0.6::DOUBLE END, 2)::DOUBLE AS api_cost_usd, round_even(size * CASE quant WHEN 'Q4_K_M' THEN 0.62::DOUBLE WHEN 'Q5_K_M' THEN 0.72::DOUBLE ELSE 1.07::DOUBLE END, 1) AS gguf_gb FROM s""",
)
def estimate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-25, SCL-26: estimates over a grid of configurations."""
    k = F.col("n_nationkey")
    by3 = lambda *v: F.when(k % 3 == 0, v[0]).when(k % 3 == 1, v[1]).otherwise(v[2])
    cfg = table(spark, sf_dir, "nation").select(
        k.alias("id"), by3("org/model-1.5B-Instruct", "org/model2.0", "org/m-12b").alias("base_model"), (k * 37 + 100).alias("examples_per_course"), (k % 4 + 1).alias("epochs"),
        (k % 5 + 1).alias("generation_concurrency"), by3("Q4_K_M", "Q5_K_M", "Q8_0").alias("quant"), (k % 4 == 0).alias("demo"), F.when(k % 2 == 0, "o/r").otherwise("").alias("hf_repo"),
        (k % 6).alias("n_courses"), (k % 3).alias("n_sources"),
    )
    e = jobs.estimates(cfg)
    part = lambda s: F.element_at("stage_seconds", s).alias(f"{s}_s")
    return e.select("id", "rows", "train_steps", part("ingest"), part("generate"), part("train"), "total_seconds", F.col("api_cost_usd").cast("double").alias("api_cost_usd"), "gguf_gb")


@query(
    "config_errors",
    """SELECT n_nationkey AS id, array_to_string(list_filter([CASE WHEN n_nationkey % 5 = 0 THEN 'program name is missing' END, CASE WHEN n_nationkey % 3 = 0 THEN 'base model is no repository id' END, CASE WHEN n_nationkey % 4 = 0 THEN 'unknown quantization' END,
      CASE WHEN n_nationkey % 6 = 0 THEN 'learning_rate out of range' END, CASE WHEN n_nationkey % 2 = 1 THEN 'examples_per_course out of range' END, CASE WHEN n_nationkey % 7 = 0 THEN 'epochs out of range' END], lambda x: x IS NOT NULL), '; ') AS errors FROM nation""",
)
def config_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15, FLT-28."""
    from lectern.operators.validation import config_errors as errors

    k = F.col("n_nationkey")
    cfg = table(spark, sf_dir, "nation").select(
        k.alias("id"), F.when(k % 5 == 0, " ").otherwise("P").alias("program_name"), F.when(k % 3 == 0, "no-slash").otherwise("o/m-1.b").alias("base_model"), F.when(k % 4 == 0, "Q2").otherwise("Q8_0").alias("quant"),
        F.when(k % 6 == 0, 0.5).otherwise(1e-4).alias("learning_rate"), F.lit("").alias("hf_repo"), F.when(k % 2 == 1, 10).otherwise(400).alias("examples_per_course"), F.when(k % 7 == 0, 6).otherwise(2).alias("epochs"),
        F.lit(16).alias("lora_r"), F.lit(1024).alias("max_seq_len"), F.lit(4).alias("generation_concurrency"),
    )
    return cfg.select("id", F.array_join(errors(), "; ").alias("errors"))


@query(
    "paste_blocks",
    """WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS b FROM documents)
    SELECT doc_id AS paste_id, len(b)::INTEGER AS blocks, md5(array_to_string(b, chr(10) || '---' || chr(10))) AS text_md5 FROM p WHERE len(b) > 0""",
)
def paste_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12, SRC-14: pasted text cut into blocks and joined again."""
    from lectern.sources.readers import pasted_blocks, pasted_text

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paste_id"), F.replace("text", F.lit("\n"), F.lit("\n ---- \n")).alias("text"))
    blocks = pasted_blocks(d)
    n = blocks.groupBy("paste_id").agg(F.count("*").cast("int").alias("blocks"))
    return pasted_text(blocks).join(n, "paste_id").select("paste_id", "blocks", F.md5("text").alias("text_md5"))


@query("uploads_kept", "SELECT page_id FROM pages WHERE page_id % 3 = 0")
def uploads_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-14, JOIN-18: uploads that are wanted again."""
    from lectern.sources.readers import kept_files

    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"))
    return kept_files(p, p.where("file % 3 = 0")).select(F.col("file").alias("page_id"))
