"""Text functions and validation rules over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import arrays, languages, text
from lectern.operators import validation
from lectern.plans.registry import query
from lectern.plans.tables import CORPUS_SQL, LANGUAGES, TERMS, corpus
from lectern.session import table

_POINTS = r"(?:^|[\x09-\x0D ])([1-9])[.)][\x09-\x0D ]"
_STRICT = r"(?:^|[\x09-\x0D ])([1-5])\.[\x09-\x0D ]"
_WS = text.WS
_TERM_LIST = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
_MARKERS = "CASE language " + " ".join(
    f"WHEN '{n}' THEN [" + ", ".join(f"'{m}'" for m in languages.PRESETS[n][1]) + "]" for n in LANGUAGES.values()
) + " ELSE []::VARCHAR[] END"
_STRIP = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_FIRST = lambda c: f"left(CASE WHEN instr({c}, '. ') > 0 THEN substr({c}, instr({c}, '. ') + 2) ELSE {c} END, 40)"

ERRORS_SQL = f"""
{CORPUS_SQL}, parts AS (
  SELECT *, {_STRIP('instruction')} AS q, {_STRIP('rationale')} AS w, {_STRIP('output')} AS a, {_MARKERS} AS markers FROM corpus
), judged AS (
  SELECT *, len(regexp_extract_all(w, '{_POINTS}')) AS n, {_FIRST('w')} AS first,
    list_filter([CASE WHEN q = '' THEN 'instruction' END, CASE WHEN w = '' THEN 'rationale' END, CASE WHEN a = '' THEN 'output' END], lambda x: x IS NOT NULL) AS missing,
    lower(q || chr(10) || w || chr(10) || a) AS low
  FROM parts
), failed AS (
  SELECT *, CASE WHEN len(missing) > 0 THEN ['missing: ' || array_to_string(missing, ', ')] ELSE list_concat(list_filter([
      CASE WHEN length(q) < 15 THEN 'instruction too short' END,
      CASE WHEN n NOT BETWEEN 3 AND 5 THEN 'points: ' || n::VARCHAR END,
      CASE WHEN NOT (contains(w, '```') OR regexp_matches(w, '\\d+[\\x09-\\x0D ]*[-+*/×=][\\x09-\\x0D ]*\\d+')
                     OR len(list_filter(markers, lambda m: contains(lower(w), m))) > 0 OR contains(lower(w), 'for example') OR contains(lower(w), 'e.g.'))
           THEN 'no worked example' END,
      CASE WHEN length(a) < 30 THEN 'output too short' END,
      CASE WHEN length(first) >= 20 AND contains(a, first) THEN 'output copies the first point' END], lambda x: x IS NOT NULL),
    list_transform(list_filter({_TERM_LIST}, lambda t: contains(low, lower(t))), lambda t: 'out of scope: ' || t)) END AS errors
  FROM judged
)"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(*map(F.lit, TERMS))
    return corpus(spark, sf_dir).withColumn("errors", validation.platform_errors(F.col("language"), terms))


@query(
    "validation_report",
    f"""WITH {ERRORS_SQL}
    SELECT domain, count(*) AS n, count(*) FILTER (len(errors) = 0) AS accepted,
           count(*) FILTER (len(list_filter(errors, lambda e: starts_with(e, 'points'))) > 0) AS wrong_points,
           count(*) FILTER (list_contains(errors, 'no worked example')) AS no_example,
           count(*) FILTER (list_contains(errors, 'output too short')) AS short_output,
           count(*) FILTER (list_contains(errors, 'output copies the first point')) AS copied,
           count(*) FILTER (len(list_filter(errors, lambda e: starts_with(e, 'out of scope'))) > 0) AS out_of_scope
    FROM failed GROUP BY domain""",
)
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-1, VAL-3 to VAL-8: how many rows of each domain pass, and what the others fail."""
    e = F.col("errors")
    has = lambda message: F.count_if(F.array_contains(e, message))
    starts = lambda prefix: F.count_if(F.exists(e, lambda x: x.startswith(prefix)))
    return _errors(spark, sf_dir).groupBy("domain").agg(
        F.count("*").alias("n"), F.count_if(F.size(e) == 0).alias("accepted"), starts("points").alias("wrong_points"), has("no worked example").alias("no_example"),
        has("output too short").alias("short_output"), has("output copies the first point").alias("copied"), starts("out of scope").alias("out_of_scope"),
    )


@query("validation_errors_long", f"WITH {ERRORS_SQL} SELECT row_idx, unnest(errors) AS error FROM failed")
def validation_errors_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _errors(spark, sf_dir).select("row_idx", F.explode("errors").alias("error"))


@query(
    "validation_research",
    f"""WITH {CORPUS_SQL}, parts AS (
      SELECT *, {_STRIP('instruction')} AS q, {_STRIP('rationale')} AS w, {_STRIP('output')} AS a FROM corpus
    ), judged AS (SELECT *, len(regexp_extract_all(w, '{_STRICT}')) AS n, {_FIRST('w')} AS first, lower(q || chr(10) || w || chr(10) || a) AS low FROM parts)
    SELECT row_idx, unnest(list_concat(list_filter([
      CASE WHEN length(q) < 15 THEN 'instruction too short' END,
      CASE WHEN n NOT BETWEEN 3 AND 5 THEN 'points: ' || n::VARCHAR END,
      CASE WHEN NOT (contains(w, 'לדוגמה') OR contains(w, '```') OR regexp_matches(w, '\\d+[\\x09-\\x0D ]*[-=][\\x09-\\x0D ]*\\d+')) THEN 'no worked example' END,
      CASE WHEN length(a) < 30 THEN 'output too short' END,
      CASE WHEN first <> '' AND contains(a, first) THEN 'output copies the first point' END], lambda x: x IS NOT NULL),
      list_transform(list_filter({_TERM_LIST}, lambda t: contains(low, lower(t))), lambda t: 'out of scope: ' || t))) AS error
    FROM judged""",
)
def validation_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict profile's messages (VAL-2 to VAL-8)."""
    errors = validation.research_errors(F.col("domain"), F.col("course_name"), F.array(*map(F.lit, TERMS)))
    return corpus(spark, sf_dir).select("row_idx", F.explode(errors).alias("error"))


@query(
    "integrity_gate",
    """SELECT doc_id AS row_idx, unnest(list_filter([CASE WHEN regexp_replace(text, '[\\s]+', '', 'g') = '' THEN 'blank instruction' END,
       CASE WHEN source <> 'src' || (doc_id % 20)::VARCHAR THEN 'wrong domain' END, CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'blank course_name' END], lambda x: x IS NOT NULL)) AS reason FROM documents""",
)
def integrity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11, FLT-30: every row that breaks the contract, with its place."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_idx"), F.when(F.col("lang").isin("en", "fr", "de"), "c").alias("course_name"), F.col("source").alias("domain"),
        F.col("text").alias("instruction"), F.lit("r").alias("rationale"), F.lit("o").alias("output"),
    )
    return validation.integrity_violations(rows, F.concat(F.lit("src"), (F.col("row_idx") % 20).cast("string")))


@query(
    "normalized_text",
    r"SELECT doc_id, md5(lower(trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')))) AS norm_md5 FROM documents",
)
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-1."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalized(F.col("text"))).alias("norm_md5"))


@query(
    "numbered_points",
    f"WITH {CORPUS_SQL} SELECT row_idx, len(regexp_extract_all(rationale, '{_POINTS}'))::INTEGER AS lenient, len(regexp_extract_all(rationale, '{_STRICT}'))::INTEGER AS strict_count, "
    f"array_to_string(regexp_extract_all(rationale, '{_POINTS}', 1), '') AS numbers FROM corpus",
)
def numbered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-2, SCL-3."""
    r = F.col("rationale")
    return corpus(spark, sf_dir).select("row_idx", text.points(r).alias("lenient"), text.points_strict(r).alias("strict_count"), F.array_join(text.point_numbers(r), "").alias("numbers"))


@query(
    "script_ratio",
    r"""WITH p AS (SELECT doc_id, regexp_replace(text, '(?s)```.*?```', ' ', 'g') AS t FROM documents), c AS (
      SELECT doc_id, len(regexp_extract_all(t, '[\p{L}\p{Nl}\p{No}]')) AS letters, len(regexp_extract_all(t, '[a-zA-Z]')) AS latin, len(regexp_extract_all(t, '[\x{00C0}-\x{024F}]')) AS marked FROM p)
    SELECT doc_id, round_even(CASE WHEN letters = 0 THEN 1.0 ELSE latin::DOUBLE / letters END, 6) AS latin_ratio, round_even(CASE WHEN letters = 0 THEN 1.0 ELSE marked::DOUBLE / letters END, 6) AS marked_ratio FROM c""",
)
def script_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-7, VAL-9."""
    d, t = table(spark, sf_dir, "documents"), F.col("text")
    return d.select("doc_id", F.bround(text.script_ratio(t, "a-zA-Z"), 6).alias("latin_ratio"), F.bround(text.script_ratio(t, r"\x{00C0}-\x{024F}"), 6).alias("marked_ratio"))


@query(
    "text_direction",
    r"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || ' שלום עולם' ELSE text END AS text FROM conversations), w AS (
      SELECT conv_id, turn, regexp_split_to_array(text, '\s+') AS words FROM t), c AS (
      SELECT conv_id, turn, len(list_filter(words, lambda x: regexp_matches(x, '[\x{0590}-\x{05FF}]'))) AS h,
             len(list_filter(words, lambda x: NOT regexp_matches(x, '[\x{0590}-\x{05FF}]') AND regexp_matches(x, '[A-Za-z]'))) AS l FROM w)
    SELECT conv_id, turn, CASE WHEN h > 0 AND h * 3 >= l THEN 'rtl' ELSE 'ltr' END AS dir FROM c""",
)
def text_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-32, on turns some of which end in right-to-left words."""
    c = table(spark, sf_dir, "conversations")
    t = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" שלום עולם"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", text.text_direction(t).alias("dir"))


@query(
    "clean_text",
    rf"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style).*?</(script|style)>', ' ', 'g'), '<[^>]*>', chr(10), 'g') AS t FROM pages)
    SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')) AS clean_md5 FROM t""",
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-10 on the text of pages."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style).*?</(script|style)>", " "), "<[^>]*>", "\n")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.cleaned(bare)).alias("clean_md5"))


@query(
    "title_line",
    rf"""WITH f AS (SELECT conv_id, turn, regexp_replace(regexp_split_to_array(text, '\r?\n')[1], '^{_WS}+|{_WS}+$', '', 'g') AS line FROM conversations)
    SELECT conv_id, turn, CASE WHEN length(line) <= 60 THEN line ELSE regexp_replace(left(line, 60), '{_WS}+$', '') || '…' END AS title FROM f""",
)
def title_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-31."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.titled(F.col("text")).alias("title"))


@query(
    "script_shares",
    r"""SELECT lang, count(*) AS n, sum(len(regexp_extract_all(text, '[\p{Lu}]')))::BIGINT AS capitals, sum(len(regexp_extract_all(text, '[\p{N}]')))::BIGINT AS digits FROM documents GROUP BY lang""",
)
def script_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = lambda p: F.sum(F.regexp_count("text", F.lit(p)).cast("long"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), n(r"[\p{Lu}]").alias("capitals"), n(r"[\p{N}]").alias("digits"))


@query(
    "list_items",
    r"""WITH l AS (SELECT doc_id, regexp_split_to_array(CASE WHEN doc_id % 2 = 0 THEN 'Week 1: ' || left(text, 300) ELSE '- ' || left(text, 300) END, '[\n;]') AS items FROM documents), b AS (
      SELECT doc_id, unnest(items) AS raw, unnest(range(len(items))) AS pos FROM l), s AS (
      SELECT doc_id, pos, regexp_replace(raw, '^\s*(?:[-*•]|\d+[.)])\s*', '') AS item FROM b), u AS (
      SELECT doc_id, pos, item, regexp_replace(regexp_replace(item, '(?i)^\s*(?:week|wk)\s*#?\s*\d+[a-z]?\s*[:.)\-–—]\s*', ''), '^\s+|\s+$', '', 'g') AS rest FROM s), c AS (
      SELECT doc_id, pos, CASE WHEN rest <> '' THEN rest ELSE regexp_replace(item, '^\s+|\s+$', '', 'g') END AS item FROM u), d AS (
      SELECT *, row_number() OVER (PARTITION BY doc_id, lower(item) ORDER BY pos) AS r FROM c WHERE item <> '')
    SELECT doc_id, count(*)::INTEGER AS n, array_to_string(list(item ORDER BY pos), '|') AS items FROM d WHERE r = 1 GROUP BY doc_id""",
)
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-11, SCL-12, ARR-2, WIN-2: items of a list given as text."""
    lead = F.when(F.col("doc_id") % 2 == 0, "Week 1: ").otherwise("- ")
    items = text.list_of_text(F.concat(lead, F.left("text", F.lit(300))))
    d = table(spark, sf_dir, "documents").select("doc_id", items.alias("i"))
    return d.select("doc_id", F.size("i").alias("n"), F.array_join("i", "|").alias("items")).where("n > 0")


@query(
    "labels_and_sizes",
    """SELECT vec_id, CASE WHEN n > 1073741824 THEN format('{:.2f} GB', n / 1073741824.0) ELSE format('{:.1f} MB', n / 1048576.0) END AS size_label,
       CASE WHEN s < 60 THEN s || 's' WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' WHEN s >= 3600 THEN (s % 86400 // 3600) || 'h ' || (s % 3600 // 60) || 'm'
            WHEN s % 60 = 0 THEN (s // 60) || 'm' ELSE (s // 60) || 'm ' || (s % 60) || 's' END AS duration
       FROM (SELECT vec_id, vec_id * 7654321 AS n, vec_id * 337 AS s FROM embeddings)""",
)
def labels_and_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-34."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select("vec_id", text.size_label(v * 7654321).alias("size_label"), text.duration_label(v * 337).alias("duration"))


@query(
    "html_escape",
    """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM pages""",
)
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-35."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_escaped(F.col("html"))).alias("escaped_md5"))


@query("url_origins", r"SELECT page_id, lower(regexp_extract(url, '(?i)^(https?://[^/\s]+)', 1)) AS origin FROM pages")
def url_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-36: the origin of each page's address."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.origins(F.col("url")), ",").alias("origin"))


@query(
    "metric_keys",
    """SELECT n_nationkey, 'loss_' || replace(replace(lower(n_name || ' C++'), ' ', '_'), '++', 'pp') AS metric, format('Q{:02d}', n_nationkey + 1) AS qid FROM nation""",
)
def metric_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-23, WIN-3."""
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", text.metric_key(F.concat("n_name", F.lit(" C++"))).alias("metric"), F.format_string("Q%02d", F.col("n_nationkey") + 1).alias("qid"))


@query(
    "training_text",
    f"""WITH {CORPUS_SQL} SELECT row_idx, md5('P' || chr(10) || chr(10) || instruction) AS user_md5,
      md5(rationale || chr(10) || chr(10) || CASE language WHEN 'French' THEN 'Réponse finale :' WHEN 'German' THEN 'Endgültige Antwort:' WHEN 'Spanish' THEN 'Respuesta final:' ELSE 'Final answer:' END || ' ' || output) AS answer_md5 FROM corpus""",
)
def training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-18 to SCL-20: what a model is trained on."""
    from lectern.operators.chat import training_text as render

    t = corpus(spark, sf_dir).select("row_idx", render(F.lit("P"), languages.final_answer(F.col("language"))).alias("t"))
    return t.select("row_idx", F.md5("t.user").alias("user_md5"), F.md5("t.assistant").alias("answer_md5"))


@query(
    "label_mask",
    """WITH a AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey)::BIGINT[] AS f FROM lineitem GROUP BY l_orderkey), p AS (
      SELECT k, f, CASE WHEN k % 3 = 0 THEN f[1:2] WHEN k % 3 = 1 THEN list_append(f[1:1], -1) ELSE f END AS p FROM a), n AS (
      SELECT k, f, p, coalesce(list_min(list_filter(range(1, least(len(p), len(f)) + 1), lambda i: p[i] <> f[i])) - 1, least(len(p), len(f))) AS n FROM p)
    SELECT k, n::INTEGER AS masked, (len(f) - n)::INTEGER AS learned, array_to_string(list_concat(list_transform(range(n), lambda i: -100::BIGINT), f[n + 1:]), ',') AS labels FROM n""",
)
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-21, SCL-22, ARR-7: a prompt's part of a sequence is masked."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    f = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda e: e["l_partkey"])
    a = li.groupBy(F.col("l_orderkey").alias("k")).agg(f.alias("f"))
    prompt = F.when(F.col("k") % 3 == 0, F.slice("f", 1, 2)).when(F.col("k") % 3 == 1, F.array_append(F.slice("f", 1, 1), F.lit(-1).cast("long"))).otherwise(F.col("f"))
    a = a.withColumn("p", prompt).withColumn("labels", arrays.masked_labels(F.col("p"), F.col("f")).cast("array<long>"))
    return a.select("k", arrays.common_prefix(F.col("p"), F.col("f")).alias("masked"), arrays.supervised(F.col("labels")).alias("learned"), F.array_join("labels", ",").alias("labels"))


@query(
    "masked_loss",
    """WITH a AS (SELECT l_orderkey AS k, list(l_discount ORDER BY l_linenumber, l_discount) AS d, list(CASE WHEN l_linenumber % 2 = 0 THEN -100 ELSE l_linenumber END ORDER BY l_linenumber, l_discount) AS y FROM lineitem GROUP BY l_orderkey), s AS (
      SELECT k, d, y[2:] AS y FROM a)
    SELECT k, round_even(coalesce(list_sum(list_transform(range(1, len(y) + 1), lambda i: CASE WHEN y[i] <> -100 THEN d[i] ELSE 0 END)), 0) / greatest(1, coalesce(len(list_filter(y, lambda v: v <> -100)), 0)), 6) AS loss FROM s""",
)
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18: mean loss over the labels that are left, one place on."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    label = F.when(F.col("l_linenumber") % 2 == 0, arrays.MASKED).otherwise(F.col("l_linenumber"))
    a = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_discount", label.alias("y")))).alias("x"))
    loss = arrays.shifted_loss(F.transform("x", lambda e: e["l_discount"]), F.transform("x", lambda e: e["y"]))
    return a.select("k", F.bround(loss, 6).alias("loss"))


@query(
    "json_coercion",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' || chr(10) || event_type WHEN 1 THEN event_type WHEN 2 THEN '{"k":1}' ELSE NULL END AS as_text FROM events""",
)
def json_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-8, ARR-1: lists, texts, objects and nulls of JSON as text."""
    e, kind = table(spark, sf_dir, "events"), F.col("event_id") % 4
    quoted = F.concat(F.lit('"'), "event_type", F.lit('"'))
    json = F.when(kind == 0, F.concat(F.lit('["a",'), quoted, F.lit("]"))).when(kind == 1, quoted).when(kind == 2, '{"k":1}').otherwise("null")
    return e.select("event_id", arrays.as_text(json).alias("as_text"))
