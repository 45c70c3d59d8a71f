"""Corpus operators over whole tables: counts, splits, weights, duplicates, leakage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import corpus as ops
from lectern.operators import dedupe
from lectern.plans.registry import query
from lectern.plans.tables import CORPUS_SQL, corpus
from lectern.session import table


@query("domain_counts_gate", "SELECT source AS domain, count(*) AS n, count(*) >= 40 AS enough FROM documents GROUP BY source")
def domain_counts_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-1, AGG-31, FLT-26: rows of each domain and whether they suffice."""
    return ops.domain_counts(table(spark, sf_dir, "documents").select(F.col("source").alias("domain")), 40)


@query(
    "exact_duplicates",
    "SELECT md5(text) AS text_md5, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id), ',') AS row_ids FROM documents GROUP BY text HAVING count(*) > 1",
)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-3."""
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"), F.col("doc_id").alias("row_idx"))
    return dedupe.exact_duplicates(d, "text_md5").select("text_md5", "n", F.array_join("row_ids", ",").alias("row_ids"))


_SPLIT = """
  SELECT doc_id AS row_idx, source AS domain, lang, row_number() OVER (PARTITION BY {key} ORDER BY md5(doc_id || ':42'), doc_id) AS place, count(*) OVER (PARTITION BY {key}) AS n FROM documents
"""


@query(
    "stratified_split_research",
    f"WITH s AS ({_SPLIT.format(key='lang')}) SELECT row_idx, CASE WHEN place <= least(greatest(20, round_even(n * 0.05, 0)), n // 2) THEN 'val' ELSE 'train' END AS part FROM s",
)
def stratified_split_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-1, SRT-10 by the research rule, over languages (uneven groups)."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.col("lang").alias("domain"))
    return ops.stratified_split(d, platform=False).select("row_idx", "part")


@query(
    "stratified_split_platform",
    f"WITH s AS ({_SPLIT.format(key='source')}) SELECT row_idx, CASE WHEN place <= greatest(1, least(greatest(least(20, n // 5), round_even(n * 0.05, 0)), n // 2)) THEN 'val' ELSE 'train' END AS part FROM s",
)
def stratified_split_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-1 by the platform rule."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.col("source").alias("domain"))
    return ops.stratified_split(d, platform=True).select("row_idx", "part")


@query(
    "domain_weights",
    """WITH c AS (SELECT lang AS domain, count(*) AS n FROM documents GROUP BY lang), w AS (SELECT domain, n, sqrt(max(n) OVER () / n::DOUBLE) AS weight FROM c)
    SELECT domain, n, round_even(weight, 6) AS weight, round_even(sum(weight * n) OVER (), 0)::BIGINT AS draws, min(n) OVER () = max(n) OVER () AS uniform FROM w""",
)
def domain_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: inverse-root weights over languages."""
    return ops.domain_weights(table(spark, sf_dir, "documents").select(F.col("lang").alias("domain"))).withColumn("weight", F.bround("weight", 6))


@query(
    "length_stats_index_percentile",
    """SELECT source AS domain, count(*) AS n, list_sort(list(n_chars))[floor(count(*) * 0.5)::INTEGER + 1] AS p50, list_sort(list(n_chars))[floor(count(*) * 0.95)::INTEGER + 1] AS p95, max(n_chars) AS longest
    FROM documents GROUP BY source""",
)
def length_stats_index_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13."""
    return ops.length_stats(table(spark, sf_dir, "documents").select(F.col("source").alias("domain"), "n_chars"))


@query("too_long_share", "SELECT count(*) AS n, count(*) FILTER (n_chars > 6000) AS too_long, count(*) FILTER (n_chars > 6000) > 0.05 * count(*) AS warn FROM documents")
def too_long_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14."""
    return ops.too_long_share(table(spark, sf_dir, "documents"), 6000)


@query("longest_rows", "SELECT doc_id AS row_idx, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 16")
def longest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-4: a top-k report."""
    return ops.longest(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "n_chars"), 16)


@query(
    "first_per_domain",
    "SELECT source AS domain, min(doc_id) AS first_idx, arg_min(text, doc_id) AS instruction FROM documents GROUP BY source ORDER BY first_idx LIMIT 4",
)
def first_per_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22: the first question of each of the first four domains."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("domain"), F.col("doc_id").alias("row_idx"), F.col("text").alias("instruction"))
    return ops.first_per_domain(d, "instruction", 4)


@query("domains_by_size", "SELECT lang AS domain, count(*) AS n, min(doc_id) AS first_idx, row_number() OVER (ORDER BY count(*) DESC, min(doc_id))::INTEGER AS place FROM documents GROUP BY lang")
def domains_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-5."""
    return ops.domains_by_size(table(spark, sf_dir, "documents").select(F.col("lang").alias("domain"), F.col("doc_id").alias("row_idx")))


@query(
    "generation_stats",
    """WITH s AS (SELECT source AS domain, count(*) FILTER (n_chars >= 800) AS rows, count(*) FILTER (n_chars < 800) AS skipped FROM documents GROUP BY source)
    SELECT domain, rows, skipped, 60 AS target, skipped > 0.15 * greatest(1, rows) AS many_skipped, rows < 0.5 * 60 AS short FROM s""",
)
def generation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-2, FLT-26."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("domain"), (F.col("n_chars") >= 800).alias("accepted"), F.lit(60).alias("target"))
    return ops.generation_stats(d)


@query(
    "merged_corpus",
    """SELECT 0 AS source_idx, doc_id AS row_idx, lang FROM documents WHERE lang = 'de' UNION ALL SELECT 1, doc_id, lang FROM documents WHERE lang = 'fr' UNION ALL SELECT 2, doc_id, lang FROM documents WHERE lang = 'es' UNION ALL SELECT 3, doc_id, lang FROM documents WHERE lang = 'en'""",
)
def merged_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-1: files in the order of a manifest."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "lang")
    return ops.merged([d.where(F.col("lang") == x) for x in ("de", "fr", "es", "en")])


@query(
    "topic_round_robin",
    """WITH t AS (SELECT DISTINCT source AS domain, lang AS topic FROM documents), c AS (SELECT domain, count(*) AS k FROM t GROUP BY domain), i AS (
      SELECT domain, k, unnest(range(12))::INTEGER AS i FROM c), p AS (SELECT domain, i, (i // k)::BIGINT AS pass, i % k AS slot FROM i), r AS (
      SELECT t.domain, t.topic, q.pass, row_number() OVER (PARTITION BY t.domain, q.pass ORDER BY md5(t.topic || ':' || q.pass || ':42'), t.topic) - 1 AS slot FROM t JOIN (SELECT DISTINCT domain, pass FROM p) q USING (domain))
    SELECT p.domain, p.i, p.pass, r.topic FROM p JOIN r ON p.domain = r.domain AND p.pass = r.pass AND p.slot = r.slot""",
)
def topic_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-4."""
    topics = table(spark, sf_dir, "documents").select(F.col("source").alias("domain"), F.col("lang").alias("topic")).distinct()
    return ops.round_robin(topics, 12)


@query(
    "stall_detector",
    """WITH e AS (SELECT user_id::VARCHAR AS domain, event_id AS pos, event_type IN ('error', 'click') AS skip FROM events), i AS (
      SELECT *, sum((NOT skip)::INT) OVER (PARTITION BY domain ORDER BY pos) AS island FROM e), r AS (
      SELECT domain, pos, row_number() OVER (PARTITION BY domain, island ORDER BY pos) AS run FROM i WHERE skip)
    SELECT domain, min(pos) AS stalled_at FROM r WHERE run = 4 GROUP BY domain""",
)
def stall_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-5: where four skips in a row first happen."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("domain"), F.col("event_id").alias("pos"), (~F.col("event_type").isin("error", "click")).alias("accepted"))
    return ops.stall_points(e, 4)


@query(
    "recent_sample",
    """WITH r AS (SELECT doc_id AS row_idx, source AS domain, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents), p AS (
      SELECT row_idx, domain, row_number() OVER (PARTITION BY domain ORDER BY md5(row_idx || ':42'), row_idx) AS p FROM r WHERE r <= 200) SELECT row_idx, domain FROM p WHERE p <= 8""",
)
def recent_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-6, SRT-8: a sample of eight of the last two hundred rows of each domain."""
    return ops.recent_sample(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.col("source").alias("domain")))


@query("style_exemplars", "SELECT doc_id AS row_idx FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 3")
def style_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-21: three rows drawn by seed."""
    from lectern.sources.readers import exemplars

    return exemplars(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx")), 3)


@query(
    "leakage_jaccard",
    r"""WITH g AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM benchmark),
    c AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS t FROM documents),
    gx AS (SELECT item_id, len(t) AS gn, unnest(t) AS token FROM g), cx AS (SELECT doc_id, len(t) AS cn, unnest(t) AS token FROM c),
    k AS (SELECT item_id, doc_id, gn, cn, count(*) AS k FROM gx JOIN cx USING (token) GROUP BY ALL),
    r AS (SELECT *, k::DOUBLE / (gn + cn - k) AS j, row_number() OVER (PARTITION BY item_id ORDER BY k::DOUBLE / (gn + cn - k) DESC, doc_id) AS r FROM k)
    SELECT item_id, doc_id AS row_idx, round_even(j, 6) AS jaccard FROM r WHERE r = 1""",
)
def leakage_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-16: the document nearest to each test item by tokens."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "text")
    return dedupe.leakage(table(spark, sf_dir, "benchmark"), d).withColumn("jaccard", F.bround("jaccard", 6))


@query(
    "leakage_exact",
    "SELECT b.item_id, count(DISTINCT d.doc_id) AS exact FROM benchmark b LEFT JOIN documents d ON d.text = b.text GROUP BY b.item_id",
)
def leakage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-16: how many documents are a test item."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("h"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return b.join(d, "h", "right").where("item_id is not null").groupBy("item_id").agg(F.countDistinct("doc_id").alias("exact")).join(
        b.select(F.col("item_id").alias("i")), F.col("item_id") == F.col("i"), "right"
    ).select(F.col("i").alias("item_id"), F.coalesce("exact", F.lit(0)).alias("exact"))


_BOUNDS = f"""WITH {CORPUS_SQL}, norm AS (
  SELECT row_idx, domain, lower(trim(regexp_replace(regexp_replace(instruction, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS t FROM corpus
), counted AS (SELECT row_idx, c, count(*) AS k FROM (SELECT row_idx, unnest(string_split(t, '')) AS c FROM norm) GROUP BY ALL), pairs AS (
  SELECT a.domain, a.row_idx AS a_idx, b.row_idx AS b_idx, length(a.t) AS an, length(b.t) AS bn FROM norm a JOIN norm b ON a.domain = b.domain AND a.row_idx < b.row_idx
  WHERE 2.0 * least(length(a.t), length(b.t)) >= 0.72 * (length(a.t) + length(b.t))
), common AS (
  SELECT p.domain, p.a_idx, p.b_idx, any_value(p.an) AS an, any_value(p.bn) AS bn, sum(least(x.k, y.k)) AS k
  FROM pairs p JOIN counted x ON x.row_idx = p.a_idx JOIN counted y ON y.row_idx = p.b_idx AND y.c = x.c GROUP BY p.domain, p.a_idx, p.b_idx)
SELECT domain, a_idx, b_idx, round_even(2.0 * least(an, bn) / (an + bn), 6) AS length_bound, round_even(2.0 * k / (an + bn), 6) AS count_bound FROM common WHERE 2.0 * k >= 0.72 * (an + bn)"""


@query("near_dup_bounds", _BOUNDS)
def near_dup_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-9, first half: pairs of questions that the two upper bounds leave."""
    rows = corpus(spark, sf_dir).select("row_idx", "domain", "instruction")
    pairs = dedupe.candidate_pairs(rows)
    return pairs.select("domain", "a_idx", "b_idx", F.bround("length_bound", 6).alias("length_bound"), F.bround("count_bound", 6).alias("count_bound"))


@query("near_dup_edges")
def near_dup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-9: similar pairs, verified (held against a plain loop in the tests)."""
    return dedupe.similar_edges(corpus(spark, sf_dir).select("row_idx", "domain", "instruction"))


@query("near_dup_greedy")
def near_dup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-9, VAL-10: which questions are accepted in order."""
    rows = corpus(spark, sf_dir).select("row_idx", "domain", "instruction")
    return dedupe.greedy_accept(rows, dedupe.similar_edges(rows))


@query("near_dup_greedy_research")
def near_dup_greedy_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-9 with the arguments of the measure the other way round."""
    rows = corpus(spark, sf_dir).select("row_idx", "domain", "instruction")
    return dedupe.greedy_accept(rows, dedupe.similar_edges(rows, candidate_is_second=False))


@query("weighted_draws")
def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-11: a sample with replacement, by inverse-root weights of languages."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.col("lang").alias("domain"))
    w = ops.domain_weights(d).select("domain", "weight")
    return ops.weighted_draws(d.join(w, "domain"), 2000)


@query(
    "training_filter",
    f"""WITH {CORPUS_SQL} SELECT CASE WHEN trim(instruction) = '' OR trim(rationale) = '' OR trim(output) = '' OR n_chars % 11 = 0 THEN 'bad' WHEN n_chars > 5000 THEN 'too_long' ELSE 'kept' END AS class, count(*) AS n FROM corpus GROUP BY 1""",
)
def training_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12: why rows do not reach training; a blank or empty row is bad before it is too long."""
    from lectern.operators.validation import training_class

    return corpus(spark, sf_dir).groupBy(training_class(F.col("n_chars") % 11 != 0, F.col("n_chars"), 5000).alias("class")).agg(F.count("*").alias("n"))


@query(
    "padding",
    "SELECT source AS domain, max(n_chars) AS longest, (ceil(max(n_chars) / 8.0) * 8)::INTEGER AS padded FROM documents GROUP BY source",
)
def padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-7: the length to which a batch is padded."""
    from lectern.functions.arrays import padded_length

    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("domain")).agg(F.max("n_chars").alias("longest")).withColumn("padded", padded_length(F.col("longest")))


@query(
    "keyset_page",
    "SELECT doc_id, source FROM documents WHERE doc_id > 123 ORDER BY doc_id LIMIT 500",
)
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-7: the page after a key (the page's size is the feature)."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").where("doc_id > 123").orderBy("doc_id").limit(500)


@query(
    "course_outlines",
    r"""WITH d AS (SELECT doc_id, source, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), t AS (
      SELECT doc_id, list_transform(l, lambda x: rtrim(left(x, 30), ' .;,')) AS l FROM d), x AS (SELECT doc_id, unnest(l) AS topic, unnest(range(len(l))) AS pos FROM t), u AS (
      SELECT doc_id, topic, min(pos) OVER (PARTITION BY doc_id, lower(topic)) = pos AS first FROM x WHERE topic <> '')
    SELECT doc_id, 'Course ' || (doc_id % 3)::VARCHAR AS course_name, count(*) FILTER (first)::INTEGER AS topics FROM u GROUP BY doc_id HAVING count(*) FILTER (first) >= 5""",
)
def course_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-16, FLT-13: courses from outlines; every line of a document is a numbered topic under a title."""
    from lectern.operators.courses import outline_courses

    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    numbered = F.transform(lines, lambda x, i: F.concat(F.lit("Week "), (i + 1).cast("string"), F.lit(": "), F.left(x, F.lit(30))))
    body = F.concat(F.lit("Course: Course "), (F.col("doc_id") % 3).cast("string"), F.lit("\n"), F.array_join(numbered, "\n"))
    d = table(spark, sf_dir, "documents").select("doc_id", body.alias("text"))
    return outline_courses(d).select("doc_id", "course_name", F.size("topics").alias("topics"))


@query(
    "course_merge",
    """WITH c AS (SELECT n_nationkey AS pos, n_regionkey, n_name FROM nation), m AS (
      SELECT n_regionkey, min(pos) AS pos, list(DISTINCT n_name ORDER BY n_name) AS names, count(*) AS k FROM c GROUP BY n_regionkey)
    SELECT CASE WHEN (pos % 2) = 0 THEN 'REGION ' ELSE 'Region ' END || n_regionkey AS course_name, k::INTEGER AS topics, array_to_string(names, ',') AS out_of_scope FROM m""",
)
def course_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-12: courses of one name but for case become one."""
    from lectern.operators.courses import merged_courses

    n = table(spark, sf_dir, "nation")
    name = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "REGION ").otherwise("Region "), F.col("n_regionkey").cast("string"))
    c = n.select(F.col("n_nationkey").alias("pos"), name.alias("course_name"), F.array("n_name").alias("topics"), F.array("n_name").alias("out_of_scope"))
    return merged_courses(c).select("course_name", F.size("topics").alias("topics"), F.array_join("out_of_scope", ",").alias("out_of_scope"))


@query(
    "unique_suffix",
    """WITH s AS (SELECT n_regionkey AS program, n_nationkey AS pos, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation)
    SELECT program, pos, CASE WHEN r = 1 THEN 'Algo' ELSE 'Algo ' || r END AS domain, CASE WHEN r = 1 THEN 'algo' ELSE 'algo-' || r END AS slug FROM s""",
)
def unique_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-13, SCL-15: labels that clash are numbered, and so are slugs."""
    from lectern.operators.courses import unique_labels

    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("program"), F.col("n_nationkey").alias("pos"), F.lit("Algo").alias("domain"))
    return unique_labels(n).select("program", "pos", "domain", "slug")


@query(
    "course_defaults",
    """WITH s AS (SELECT n_nationkey AS pos, 'r' || n_regionkey AS source, n_name, n_nationkey % 2 = 0 AS unnamed FROM nation), k AS (
      SELECT *, sum(unnamed::INT) OVER (PARTITION BY source ORDER BY pos) AS k FROM s), n AS (
      SELECT source, pos, CASE WHEN NOT unnamed THEN n_name WHEN k > 1 THEN source || ' ' || k ELSE source END AS course_name FROM k)
    SELECT source, pos, course_name, left(course_name, 60) AS domain, 6 AS topics FROM n""",
)
def course_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-14: names of unnamed courses; labels default to names."""
    from lectern.operators.courses import normalised

    n = table(spark, sf_dir, "nation")
    raw = n.select(
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source"), F.col("n_nationkey").alias("pos"), F.when(F.col("n_nationkey") % 2 == 0, "  ").otherwise(F.col("n_name")).alias("course_name"),
        F.lit(None).cast("string").alias("domain"), F.lit("English").alias("language"), F.lit("").alias("summary"), F.lit("1. a\n2. b;c\n- d\nWeek 5: e;f\nA").alias("topics"),
        F.lit("").alias("out_of_scope"), F.lit(" ").alias("style_note"),
    )
    return normalised(raw).select("source", "pos", "course_name", "domain", F.size("topics").alias("topics"))
