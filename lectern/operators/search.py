"""Full-text phrase search over messages: an inverted index with positions, rank and snippets."""

from __future__ import annotations

import math
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK_ON, MARK_OFF, SNIPPET_TOKENS = "\x02", "\x03", 12
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*"


def _marked() -> tuple[str, str]:
    """All lower-case letters of Latin, Greek and Cyrillic that are a letter with marks, and those letters."""
    ranges = (range(0xC0, 0x250), range(0x370, 0x530), range(0x1E00, 0x2000))
    forms = [(c, unicodedata.normalize("NFD", c)) for c in (chr(i) for r in ranges for i in r) if c == c.lower()]
    pairs = [(c, d[0]) for c, d in forms if len(d) > 1 and d[0].isalpha() and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


MARKED, PLAIN = _marked()


def folded(c: Column) -> Column:
    """Lower case without marks, be they part of a letter or behind it."""
    return F.regexp_replace(F.translate(F.lower(c), MARKED, PLAIN), r"\p{Mn}+", "")


def raw_tokens(c: Column) -> Column:
    """Runs of letters and digits as they stand."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def tokens(c: Column) -> Column:
    """Runs of letters and digits, in lower case without marks."""
    return F.transform(raw_tokens(c), folded)


def build_index(messages: DataFrame) -> DataFrame:
    """(token, message_id, pos) postings. ``messages``: message_id, text."""
    return messages.select("message_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))


def phrase_matches(index: DataFrame, phrase: list[str]) -> DataFrame:
    """(message_id, hits, first_pos) of messages that hold the tokens one after the other. Each
    token's postings move back by its place; a phrase stands where all agree. Repeated tokens in a
    phrase are met by their distinct places."""
    if not phrase:
        return index.limit(0).select("message_id", F.lit(0).cast("long").alias("hits"), F.lit(0).alias("first_pos"))
    places = F.create_map(*[x for t in dict.fromkeys(phrase) for x in (F.lit(t), F.array(*[F.lit(i) for i, p in enumerate(phrase) if p == t]))])
    starts = index.where(F.col("token").isin(*set(phrase))).withColumn("i", F.explode(places[F.col("token")]))
    found = starts.groupBy("message_id", (F.col("pos") - F.col("i")).alias("start")).agg(F.countDistinct("i").alias("k")).where(F.col("k") == len(phrase))
    return found.groupBy("message_id").agg(F.count("*").alias("hits"), F.min("start").alias("first_pos"))


def ranked(matches: DataFrame, index: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Matches with ``rank``: the negated BM25 weight of the phrase (lower is better)."""
    sizes = index.groupBy("message_id").agg(F.count("*").alias("n"))
    docs, mean = sizes.agg(F.count("*"), F.avg("n")).first()  # two numbers of the whole index
    df = matches.count()
    idf = max(1e-6, math.log((docs - df + 0.5) / (df + 0.5)))
    tf = F.col("hits") * (k1 + 1) / (F.col("hits") + k1 * (1 - b + b * F.col("n") / F.lit(mean or 1.0)))
    return matches.join(sizes, "message_id").withColumn("rank", F.lit(-idf) * tf).drop("n")


def snippet(c: Column, first: Column, phrase: list[str], width: int = SNIPPET_TOKENS) -> Column:
    """The text itself around the hit at token ``first``, ``width`` tokens of it, every whole hit in it
    between marks. What stands between tokens stays; text left out shows as an ellipsis."""
    raw, size = raw_tokens(c), max(1, len(phrase))
    between = F.split(c, TOKEN, -1)  # one more than tokens: before the first, ..., behind the last
    n = F.size(raw)
    start = F.greatest(F.lit(0), F.least(first - F.lit((width - size) // 2), n - width))
    end = F.least(start + width, n)
    hit = lambda i: F.slice(F.transform(F.slice(raw, start + 1, F.lit(width)), folded), i + 1, F.lit(size)) == F.array(*map(F.lit, phrase))
    shown = F.transform(
        F.slice(raw, start + 1, F.lit(width)),
        lambda w, i: F.concat(
            F.when(hit(i), MARK_ON).otherwise(""), w, F.when((i + 1 >= size) & hit(i - (size - 1)), MARK_OFF).otherwise(""),
            F.when(i + start + 1 < end, F.element_at(between, i + start + 2)).otherwise(""),
        ),
    )
    before = F.when(start > 0, "…").otherwise(F.element_at(between, 1))
    return F.concat(before, F.array_join(shown, ""), F.when(end < n, "…").otherwise(F.element_at(between, -1)))


def search(messages: DataFrame, conversations: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The best messages with the whole query as one phrase: message_id, conv_id, title, snippet, rank.
    A blank query finds nothing. ``messages``: message_id, conv_id, text. ``conversations``: conv_id, title."""
    spark = messages.sparkSession
    phrase = spark.range(1).select(tokens(F.lit(query)).alias("t")).first()["t"]
    index = build_index(messages)
    hits = ranked(phrase_matches(index, phrase), index)
    found = hits.join(messages, "message_id").join(conversations, "conv_id")
    return found.select("message_id", "conv_id", "title", snippet(F.col("text"), F.col("first_pos"), phrase or [""]).alias("snippet"), "rank").orderBy("rank", "message_id").limit(limit)


def updated_index(index: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """An index after edits and deletions: postings of both go, those of the edited texts come."""
    gone = reduce(DataFrame.unionByName, [changed.select("message_id"), deleted.select("message_id")]).distinct()
    return index.join(gone, "message_id", "left_anti").unionByName(build_index(changed).select(*index.columns))


def last_lines(lines: DataFrame, k: int = 40) -> DataFrame:
    """The last ``k`` lines of each log, in order. ``lines``: log, pos, line."""
    back = F.row_number().over(Window.partitionBy("log").orderBy(F.desc("pos")))
    return lines.withColumn("_r", back).where(F.col("_r") <= k).drop("_r").orderBy("log", "pos")
