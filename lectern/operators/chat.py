"""Conversations: turns merged and trimmed into prompts, titles, date buckets, the message store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text

CHARS_PER_TOKEN, PORTABLE_CHARS_PER_TOKEN, CONTEXT, MAX_TOKENS = 2, 3, 4096, 1024


def without_empty_answers(messages: DataFrame) -> DataFrame:
    return messages.where(~((F.col("role") == "assistant") & text.is_blank(F.col("text"))))


def merged_turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): consecutive messages of one role are one turn, empty answers and
    answers before the first question are dropped. ``messages``: conv_id, turn, role, text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = without_empty_answers(messages)
    new = F.lag("role").over(w).isNull() | (F.lag("role").over(w) != F.col("role"))
    m = m.withColumn("_g", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    turns = m.groupBy("conv_id", "_g", "role").agg(F.min("turn").alias("turn"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))
    return turns.where(~((F.col("_g") == 1) & (F.col("role") == "assistant"))).select(
        "conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("_g")).alias("turn"), "role", "text"
    )


def trimmed(turns: DataFrame, budget: Column | int) -> DataFrame:
    """The newest turns within ``budget`` characters: the oldest pair goes while more than two turns
    are left and they are too long.

    In closed form: the least even number k of turns to drop such that the rest fits or has at
    most two turns.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    by = Window.partitionBy("conv_id").orderBy("turn")
    rest = F.sum(F.length("text")).over(by.rowsBetween(0, Window.unboundedFollowing))
    n = F.count("*").over(Window.partitionBy("conv_id"))
    t = turns.withColumn("_rest", rest).withColumn("_n", n).withColumn("_k", F.row_number().over(by) - 1)
    may = (F.col("_k") % 2 == 0) & ((F.col("_rest") <= budget) | (F.col("_n") - F.col("_k") <= 2))
    t = t.withColumn("_from", F.min(F.when(may, F.col("_k"))).over(Window.partitionBy("conv_id")))
    return t.where(F.col("_k") >= F.col("_from")).drop("_rest", "_n", "_k", "_from")


def trimmed_portable(messages: DataFrame, budget: Column | int) -> DataFrame:
    """The other rule: from the newest message back until one does not fit (the newest always
    does), then from the first question on."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    m = messages.withColumn("_used", F.sum(F.length("text")).over(back)).withColumn("_r", F.count("*").over(back))
    # running sums only rise, so the first that does not fit ends the run
    m = m.where((F.col("_used") <= budget) | (F.col("_r") == 1))
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return m.withColumn("_first", first).where(F.col("turn") >= F.col("_first")).drop("_used", "_r", "_first")


def budget_chars(context: Column, max_tokens: Column, preamble: Column, separator: Column) -> Column:
    left = F.greatest(F.lit(0), context - max_tokens) * CHARS_PER_TOKEN
    return F.greatest(F.lit(0), left - F.coalesce(F.length(preamble) + F.octet_length(separator), F.lit(0)))


def budget_chars_portable(context: Column, max_tokens: Column, preamble: Column, separator: Column) -> Column:
    return F.greatest(F.lit(512), context - max_tokens) * PORTABLE_CHARS_PER_TOKEN - F.coalesce(F.length(preamble) + F.length(separator), F.lit(0))


def with_preamble(turns: DataFrame, preamble: str | None, separator: str = "\n\n") -> DataFrame:
    """The preamble in front of each conversation's first turn."""
    if not preamble:
        return turns
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    return turns.withColumn("text", F.when(first, F.concat(F.lit(preamble + separator), F.col("text"))).otherwise(F.col("text")))


def prompts(messages: DataFrame, preamble: str | None = None, separator: str = "\n\n", context: int = CONTEXT, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """The whole plan of a prompt: merge, trim, preamble."""
    budget = budget_chars(F.lit(context), F.lit(max_tokens), F.lit(preamble), F.lit(separator))
    return with_preamble(trimmed(merged_turns(messages), budget), preamble, separator)


def training_text(preamble: Column, final: Column) -> Column:
    """(user, assistant) texts of a corpus row."""
    return F.struct(
        F.concat(preamble, F.lit("\n\n"), F.col("instruction")).alias("user"),
        F.concat(F.col("rationale"), F.lit("\n\n"), final, F.lit(" "), F.col("output")).alias("assistant"),
    )


def gold_text(separator: str = "\n", final: str = "תשובה סופית: ") -> Column:
    """A gold answer: rationale and conclusion; the evaluator's variant has an empty line between."""
    return F.concat(text.stripped(F.col("rationale")), F.lit(separator + final), text.stripped(F.col("output")))


# The labels of buckets and how many days before today's midnight they begin.
BUCKETS = (("Today", 0), ("Yesterday", 1), ("Previous 7 days", 7), ("Previous 30 days", 30))


def date_bucket(at: Column, now: Column) -> Column:
    midnight = F.date_trunc("day", now)
    out = F.lit("Older")
    for label, days in reversed(BUCKETS):
        out = F.when(at >= midnight - F.expr(f"interval {days} days"), label).otherwise(out)
    return out


def date_groups(conversations: DataFrame, now: Column) -> DataFrame:
    """(id, bucket, place): each conversation's bucket and the bucket's place among those there are.
    Buckets fall with time, so runs of equal buckets in newest-first order are the buckets.
    ``conversations``: id, updated_at."""
    c = conversations.withColumn("bucket", date_bucket(F.col("updated_at"), now))
    # at most one row for each label
    order = c.groupBy("bucket").agg(F.max("updated_at").alias("_newest"))
    order = order.select("bucket", F.row_number().over(Window.orderBy(F.desc("_newest"))).alias("place"))
    return c.join(order, "bucket").select("id", "bucket", "place")


def conversation_state(changes: DataFrame) -> DataFrame:
    """Conversations from their change log (seq, op, conv_id, title, at): the last title, the least and
    largest times, without those deleted. Message inserts carry no title and move updated_at."""
    live = changes.join(changes.where("op = 'delete'").select("conv_id").distinct(), "conv_id", "left_anti")
    return live.groupBy("conv_id").agg(
        F.max_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("title"), F.min("at").alias("created_at"), F.max("at").alias("updated_at")
    )


def cascade_delete(children: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    return children.join(tombstones.select(key).distinct(), key, "left_anti")


def recovered(messages: DataFrame) -> DataFrame:
    """After a crash: what was still streaming is partial."""
    return messages.withColumn("status", F.when(F.col("status") == "streaming", "partial").otherwise(F.col("status")))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last version of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def sse_payloads(chunks: DataFrame) -> DataFrame:
    """(stream, pos, payload): the data lines of byte streams cut anywhere, also inside a character.
    ``chunks``: stream, seq, bytes. Bytes are joined in order before they are decoded; a last line
    without its end is not complete and waits."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex("bytes").alias("h")))), lambda e: e["h"]), "")
    body = chunks.groupBy("stream").agg(F.decode(F.unhex(whole), "utf-8").alias("body"))
    lines = F.regexp_extract_all("body", F.lit(r"(?m)^data:[ ]?([^\r\n]*)\r?\n"), F.lit(1))
    return body.select("stream", F.posexplode(lines).alias("pos", "payload"))


def stream_text(payloads: DataFrame) -> DataFrame:
    """(stream, text, done): the deltas of chat completions joined in order."""
    delta = F.get_json_object("payload", "$.choices[0].delta.content")
    parts = F.transform(F.array_sort(F.collect_list(F.when(delta.isNotNull(), F.struct("pos", delta.alias("d"))))), lambda e: e["d"])
    return payloads.groupBy("stream").agg(F.array_join(parts, "").alias("text"), F.max(F.col("payload") == "[DONE]").alias("done"))
