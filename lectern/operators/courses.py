"""Course descriptions: outlines read line by line, normalisation, merging and unique labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.udfs import nfkd_ascii

# Limits, and the patterns of unit and list lines.
MIN_TOPICS, MAX_SOURCE_CHARS, MIN_SOURCE_CHARS, LABEL_CHARS = 5, 100_000, 200, 60
UNIT_LINE = rf"(?iu)^\s*(?:{text.UNIT_WORDS})\s*#?\s*\d+[a-z]?\s*[:.)\-–—]\s*(.+)$"
LIST_LINE = r"^\s*(?:\d+[.)]|[-*•▪●])\s+(.+)$"
# Words that announce a course's title, in four scripts.
TITLE_LINE = (
    r"(?iu)^\s*(?:course(?:\s+(?:title|name))?|subject|title|שם\s+הקורס|קורס"
    r"|المقرر|اسم المقرر|курс|название курса)\s*[:\-–—]\s*(.+)$"
)
_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def outline_courses(documents: DataFrame, least: int = MIN_TOPICS) -> DataFrame:
    """(doc_id, block, course_name, topics) of the courses that plain outlines describe.

    A title line opens a course. Unit and list lines are topics; short free lines are so only if a
    block has too few of those, and then the first of them before any list is not its name. A
    course needs ``least`` distinct topics. An unnamed course has the name ''.
    """
    lines = documents.select("doc_id", F.posexplode(F.split("text", _BREAKS)).alias("pos", "raw"))
    line = text.stripped(F.regexp_replace(text.stripped(F.col("raw")), "^#+", ""))
    lines = lines.withColumn("line", line).where(F.col("line") != "")
    title, unit, item = (F.regexp_extract("line", p, 1) for p in (TITLE_LINE, UNIT_LINE, LIST_LINE))
    kind = (
        F.when(title != "", "title").when((unit != "") | (item != ""), "marked")
        .when((F.length("line") <= 120) & (F.size(F.split("line", r"\s+")) <= 14), "plain").otherwise("prose")
    )
    topic = text.stripped(F.when(F.col("kind") == "title", title).when(unit != "", unit).when(item != "", item).otherwise(F.col("line")))
    lines = lines.withColumn("kind", kind).withColumn("topic", topic).where("kind <> 'prose'")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("block", F.sum((F.col("kind") == "title").cast("int")).over(w))
    entry = F.struct("pos", "topic")
    of = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, entry))), lambda e: e["topic"])
    blocks = lines.groupBy("doc_id", "block").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "title", F.col("topic"))), F.lit("")).alias("title"),
        of("marked").alias("marked"), of("plain").alias("plain"),
        F.min(F.when(F.col("kind") == "marked", F.col("pos"))).alias("first_marked"),
        F.min(F.when(F.col("kind") == "plain", F.struct("pos", "topic"))).alias("first_plain"),
    )
    listed = F.size("marked") >= least
    heading = F.when(F.col("first_marked").isNull() | (F.col("first_plain.pos") < F.col("first_marked")), F.col("first_plain.topic"))
    name = F.when(listed & (F.col("title") == ""), F.coalesce(heading, F.lit(""))).otherwise(F.col("title"))
    raw = F.when(listed, F.col("marked")).otherwise(F.concat("marked", "plain"))
    bare = F.transform(raw, lambda t: F.regexp_replace(text.without_unit_prefix(t), r"[ .;,]+$", ""))
    topics = text.distinct_ignoring_case(F.filter(bare, lambda t: t != ""))
    return blocks.select("doc_id", "block", name.alias("course_name"), topics.alias("topics")).where(F.size("topics") >= least)


def normalised(raw: DataFrame, fallback: Column | None = None) -> DataFrame:
    """Courses with clean lists and defaults: a course needs MIN_TOPICS topics; an unnamed one takes
    the fallback or its source's name, numbered from its second on; the label is cut.

    ``raw``: source, pos, course_name, domain, language, summary, topics, out_of_scope (arrays or
    text split on newlines and semicolons), style_note.
    """
    kinds = dict(raw.dtypes)
    items = lambda c: text.list_items(F.col(c)) if kinds[c].startswith("array") else text.list_of_text(F.col(c))
    empty = F.array().cast("array<string>")
    r = raw.withColumn("topics", F.coalesce(items("topics"), empty)).withColumn("out_of_scope", F.coalesce(items("out_of_scope"), empty))
    r = r.where(F.size("topics") >= MIN_TOPICS).withColumn("course_name", F.coalesce(text.stripped(F.col("course_name")), F.lit("")))
    unnamed = F.col("course_name") == ""
    n = F.sum(unnamed.cast("int")).over(Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    name = F.coalesce(F.nullif(fallback, F.lit("")) if fallback is not None else F.lit(None), F.nullif(F.col("source"), F.lit("")), F.lit("Course"))
    name = F.when(n > 1, F.concat(name, F.lit(" "), n.cast("string"))).otherwise(name)
    r = r.withColumn("course_name", F.when(unnamed, name).otherwise(F.col("course_name")))
    label = F.substring(text.stripped(F.coalesce(F.nullif(F.col("domain"), F.lit("")), F.col("course_name"))), 1, LABEL_CHARS)
    clean = lambda c: F.coalesce(text.stripped(F.col(c)), F.lit(""))
    return r.select(
        "source", "pos", "course_name", label.alias("domain"), clean("language").alias("language"), clean("summary").alias("summary"),
        "topics", "out_of_scope", F.nullif(text.stripped(F.col("style_note")), F.lit("")).alias("style_note"),
    )


def merged_courses(courses: DataFrame) -> DataFrame:
    """One course per name (but for case, in full folding: sharp s is ss): the first one's fields, topics
    appended if new, terms out of scope as a sorted set. ``courses``: pos, course_name, topics, out_of_scope, others."""
    others = [c for c in courses.columns if c not in ("pos", "topics", "out_of_scope")]
    lists = F.transform(F.array_sort(F.collect_list(F.struct("pos", "topics"))), lambda e: e["topics"])
    return (
        courses.groupBy(F.lower(F.upper("course_name")).alias("_key"))
        .agg(F.min("pos").alias("pos"), *[F.min_by(c, "pos").alias(c) for c in others], F.flatten(lists).alias("topics"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("out_of_scope")))).alias("out_of_scope"))
        .withColumn("topics", text.distinct_ignoring_case(F.col("topics")))
        .drop("_key")
    )


def _suffixed(labels: Column, joiner: str) -> Column:
    """Labels in order, each that is taken (but for case) numbered from 2 on until it is free."""
    taken = lambda used, x: F.exists(used, lambda u: F.lower(u) == F.lower(x))

    def place(used: Column, label: Column) -> Column:
        # among as many numbers as there are labels before it, one is free
        numbered = F.transform(F.sequence(F.lit(2), F.size(used) + 2), lambda k: F.concat(label, F.lit(joiner), k.cast("string")))
        free = F.element_at(F.filter(numbered, lambda x: ~taken(used, x)), 1)
        return F.array_append(used, F.when(taken(used, label), free).otherwise(label))

    return F.aggregate(labels, F.array().cast("array<string>"), place)


def unique_labels(courses: DataFrame) -> DataFrame:
    """Courses with labels and slugs that differ from all before them (a handful per program; one
    array is folded in order). ``courses``: program, pos, domain, others."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "domain")))
    folded = courses.groupBy("program").agg(_suffixed(F.transform(ordered, lambda e: e["domain"]), " ").alias("labels"), F.transform(ordered, lambda e: e["pos"]).alias("places"))
    words = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    ascii_labels = folded.withColumn("plain", F.split(nfkd_ascii(F.array_join("labels", "\n")), "\n"))
    slugs = F.transform("plain", lambda x, i: F.coalesce(F.nullif(F.substring(words(x), 1, LABEL_CHARS), F.lit("")), F.concat(F.lit("course-"), (i + 1).cast("string"))))
    each = ascii_labels.withColumn("slugs", _suffixed(slugs, "-")).select("program", F.explode(F.arrays_zip("places", "labels", "slugs")).alias("e"))
    return courses.drop("domain").join(each.select("program", F.col("e.places").alias("pos"), F.col("e.labels").alias("domain"), F.col("e.slugs").alias("slug")), ["program", "pos"])


def inherited_source(edited: DataFrame, before: DataFrame) -> DataFrame:
    """Edited courses with the source of the course of the same name before, else 'edited'."""
    old = before.groupBy("course_name").agg(F.min("source").alias("_old"))
    return edited.drop("source").join(old, "course_name", "left").withColumn("source", F.coalesce("_old", F.lit("edited"))).drop("_old")


def readable_sources(sources: DataFrame) -> DataFrame:
    """Sources cut to MAX_SOURCE_CHARS, with ``skipped``: too short and no outline in them."""
    body = F.substring(text.cleaned(F.col("text")), 1, MAX_SOURCE_CHARS)
    found = outline_courses(sources.select("doc_id", "text")).select("doc_id").distinct().withColumn("_outline", F.lit(True))
    return sources.withColumn("text", body).join(found, "doc_id", "left").withColumn(
        "skipped", (F.length("text") < MIN_SOURCE_CHARS) & F.col("_outline").isNull()
    ).drop("_outline")


def totals(courses: DataFrame) -> DataFrame:
    return courses.agg(F.count("*").alias("courses"), F.coalesce(F.sum(F.size("topics")), F.lit(0)).alias("topics"))
