"""How the tables at hand play the parts of a corpus, runs, verdicts, jobs and messages; the same
in Spark and, as common table expressions, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import table

NOW = "2024-01-25 12:00:00"
SENTENCE = "^[^.!?]*[.!?]?"
TERMS = ("edoution", "the of")
LANGUAGES = {"en": "English", "fr": "French", "de": "German", "es": "Spanish"}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question rows made from whole documents: the first sentence asks, all lines are the rationale (some
    of them numbered, some with a calculation), the last concludes, or the first point once more."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    k = (F.lit(2) + F.col("doc_id") % 5).cast("int")
    numbered = F.array_join(F.transform(F.slice("lines", F.lit(1), k), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    rest = F.slice("lines", k + 1, F.greatest(F.size("lines") - k, F.lit(0)))
    others = F.when(F.size(rest) > 0, F.concat(F.lit("\n"), F.array_join(rest, "\n"))).otherwise("")
    rationale = F.concat(numbered, others, F.when(F.col("doc_id") % 3 == 0, "\nfor example 3 * 4 = 12").otherwise(""))
    first, last = (F.coalesce(F.try_element_at("lines", F.lit(i)), F.lit("")) for i in (1, -1))
    rows = d.withColumn("lines", lines).withColumn("rationale", rationale)
    language = F.lit("")
    for code, name in LANGUAGES.items():
        language = F.when(F.col("lang") == code, name).otherwise(language)
    return rows.select(
        F.col("doc_id").alias("row_idx"), F.col("source").alias("domain"), F.concat(F.lit("Course "), "source").alias("course_name"), language.alias("language"), "lang",
        F.trim(F.regexp_extract(first, SENTENCE, 0)).alias("instruction"), "rationale", F.when(F.col("doc_id") % 4 == 0, first).otherwise(last).alias("output"),
        "text", "n_chars",
    )


CORPUS_SQL = """
lined AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents
), reasoned AS (
  SELECT *, array_to_string(list_transform(lines[1:(2 + doc_id % 5)], lambda x, i: i::VARCHAR || '. ' || x), chr(10))
            || CASE WHEN len(lines) > 2 + doc_id % 5 THEN chr(10) || array_to_string(lines[(3 + doc_id % 5):], chr(10)) ELSE '' END
            || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'for example 3 * 4 = 12' ELSE '' END AS rationale FROM lined
), corpus AS (
  SELECT doc_id AS row_idx, source AS domain, 'Course ' || source AS course_name, lang,
         CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' ELSE '' END AS language,
         trim(regexp_extract(coalesce(lines[1], ''), '^[^.!?]*[.!?]?')) AS instruction, rationale,
         coalesce(CASE WHEN doc_id % 4 = 0 THEN lines[1] ELSE lines[-1] END, '') AS output, text, n_chars
  FROM reasoned
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of three runs on the orders of each nation's customers: run, domain, item, base and own loss."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    items = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return items.select(
        F.col("o_orderkey").alias("item"), F.col("n_name").alias("domain"), F.col("n_regionkey").alias("region"), F.bround(F.col("o_totalprice") / 100000, 3).alias("base_loss")
    )


RUNS_SQL = """
items AS (
  SELECT o_orderkey AS item, n_name AS domain, n_regionkey AS region, round_even(o_totalprice / 100000, 3) AS base_loss
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two verdicts on each labelled document: quality speaks in one order, harm in the other."""
    lab = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("domain"), "lang", "n_chars")
    return lab.join(d, "doc_id").select(
        F.col("doc_id").alias("idx"), "domain", F.col("lang").alias("opponent"), "n_chars", (2 * F.col("quality") - 1).cast("int").alias("p1"), (1 - 2 * F.col("toxic")).cast("int").alias("p2")
    )


VERDICTS_SQL = """
verdicts AS (
  SELECT l.doc_id AS idx, d.source AS domain, d.lang AS opponent, d.n_chars, (2 * quality - 1)::INTEGER AS p1, (1 - 2 * toxic)::INTEGER AS p2
  FROM labels l JOIN documents d USING (doc_id)
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers; system notes are left out, every seventh answer has failed."""
    c = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    failed = (F.col("role") == "assistant") & ((F.col("conv_id") + F.col("turn")) % 7 == 0)
    return c.select("conv_id", "turn", "role", F.when(failed, "").otherwise(F.col("text")).alias("text"))


MESSAGES_SQL = """
messages AS (
  SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND (conv_id + turn) % 7 = 0 THEN '' ELSE text END AS text
  FROM conversations WHERE role IN ('user', 'assistant')
)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")
