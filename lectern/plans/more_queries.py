"""The remaining operators over tables: texts of models, manifests, devices, checkpoints, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import arrays, languages, text
from lectern.operators import chat, courses, jobs, losses, search, validation
from lectern.plans.registry import query
from lectern.session import table
from lectern.sources import readers, writers

_STRIPPED = f"regexp_replace(text, '^{text.WS}+|{text.WS}+$', '', 'g')"


@query(
    "think_strip",
    f"""SELECT doc_id, md5(CASE doc_id % 3 WHEN 1 THEN '' ELSE {_STRIPPED} END) AS answer_md5 FROM documents""",
)
def think_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-27."""
    head, k = F.col("text"), F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.lit("<think>x\ny</think>a</think>\n"), head)).when(k == 1, F.concat(F.lit("<think>"), head)).otherwise(head)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.without_thinking(raw)).alias("answer_md5"))


@query("math_delimiters", r"SELECT doc_id, 'a $' || doc_id || '$ `\(x\)` ' || chr(10) || '$$' || chr(10) || lang || chr(10) || '$$' || chr(10) AS md FROM documents")
def math_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-33."""
    d = table(spark, sf_dir, "documents")
    raw = F.concat(F.lit(r"a \( "), F.col("doc_id").cast("string"), F.lit(r" \) `\(x\)` \["), "lang", F.lit(r"\]"))
    return d.select("doc_id", text.normalized_math(raw).alias("md"))


@query("visible_prose", "SELECT doc_id, md5('a   ' || translate(text, '`$', '  ') || '  b') AS prose_md5 FROM documents")
def visible_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-46: code and mathematics around a text without signs of them."""
    raw = F.concat(F.lit("a `code` "), F.translate("text", "`$", "  "), F.lit(" $x$b"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.visible_prose(raw)).alias("prose_md5"))


@query("snippet_parts", "SELECT conv_id, turn, 3 AS parts, role AS hit FROM conversations")
def snippet_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-47: a marked snippet cut into its parts."""
    s = text.snippet_parts(F.concat(F.lit("before "), F.lit(search.MARK_ON), "role", F.lit(search.MARK_OFF), F.lit(" after")))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", s.alias("s"))
    return c.select("conv_id", "turn", F.size("s").alias("parts"), F.filter("s", lambda p: p["hit"])[0]["text"].alias("hit"))


@query(
    "run_folders",
    "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'eval_results_v' || n_nationkey ELSE 'eval_results' END AS folder, CASE n_nationkey % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 7 ELSE 12 END::DOUBLE AS size_b FROM nation",
)
def run_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-24, SCL-25."""
    k = F.col("n_nationkey")
    path = F.when(k % 2 == 0, F.concat(F.lit("out/qlora-v"), k.cast("string"))).otherwise("out/other")
    model = F.when(k % 3 == 0, "o/m-1.5B-x").when(k % 3 == 1, "o/m2.0").otherwise("o/m-12b")
    return table(spark, sf_dir, "nation").select("n_nationkey", text.run_version(path).alias("folder"), text.model_size_b(model).alias("size_b"))


@query("error_texts", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'm' || user_id ELSE left(event_type || ' failed', 300) END AS message FROM events")
def error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-43."""
    k = F.col("event_id") % 3
    body = F.when(k == 0, F.concat(F.lit('{"error": {"message": "'), "event_type", F.lit('"}}'))).when(k == 1, F.concat(F.lit('{"message": "m'), F.col("user_id").cast("string"), F.lit('"}')))
    return table(spark, sf_dir, "events").select("event_id", text.error_message(body.otherwise(F.concat("event_type", F.lit(" failed")))).alias("message"))


@query("gold_coercion", "SELECT event_id, 'a ' || event_type AS joined FROM events")
def gold_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-9: lists of the gold set are joined by blanks."""
    json = F.concat(F.lit('[" a ", "'), "event_type", F.lit('  "]'))
    return table(spark, sf_dir, "events").select("event_id", arrays.as_text(json, " ", True).alias("joined"))


@query("gold_answers", f"SELECT doc_id, md5({_STRIPPED} || chr(10) || 'F: ' || lang) AS gold_md5, md5({_STRIPPED} || chr(10) || chr(10) || 'F: ' || lang) AS eval_md5 FROM documents")
def gold_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20: the gold answer with both separators."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("rationale"), F.concat(F.lit(" "), "lang").alias("output"))
    return d.select("doc_id", F.md5(chat.gold_text("\n", "F: ")).alias("gold_md5"), F.md5(chat.gold_text("\n\n", "F: ")).alias("eval_md5"))


@query(
    "prompts_for_topics",
    """SELECT n_nationkey, 'Topic: ' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || 'Already asked:' || chr(10) || '- a' || chr(10) || '- ' || n_name ELSE '' END AS prompt FROM nation""",
)
def prompts_for_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-17."""
    recent = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("a"), F.col("n_name"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "nation").select("n_nationkey", languages.user_prompt(F.col("n_name"), recent).alias("prompt"))


@query("preset_join", "SELECT doc_id, CASE lang WHEN 'fr' THEN 'Réponse finale :' WHEN 'de' THEN 'Endgültige Antwort:' ELSE 'Final answer:' END AS final_answer FROM documents")
def preset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-19: the preset of a row's language, else the generic one."""
    p = languages.presets(spark).select(F.lower(F.left("language", F.lit(2))).alias("code"), F.col("final_answer").alias("own")).where("code in ('fr', 'ge')")
    code = F.when(F.col("lang") == "de", "ge").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").withColumn("code", code).join(F.broadcast(p), "code", "left").select("doc_id", F.coalesce("own", F.lit(languages.GENERIC[0])).alias("final_answer"))


@query(
    "manifest_rules",
    """SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_suppkey % 3 = 0 THEN 'bad repo' END, CASE WHEN s_suppkey % 5 = 0 THEN 'bad gguf' END, CASE WHEN s_suppkey % 7 = 0 THEN 'bad profile' END, CASE WHEN s_suppkey % 11 = 0 THEN 'bad revision' END], lambda x: x IS NOT NULL), ',') AS errors,
      CASE WHEN s_suppkey % 3 = 0 THEN 'x' ELSE 'o/r' END || '@' || CASE WHEN s_suppkey % 11 = 0 THEN 'a/b' ELSE 'main' END || '/' || CASE WHEN s_suppkey % 5 = 0 THEN '../m.gguf' ELSE 'm.gguf' END AS key FROM supplier""",
)
def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-20, SNK-9, SCL-37, SRC-17."""
    k = F.col("s_suppkey")
    m = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.when(k % 3 == 0, "x").otherwise("o/r").alias("repo"), F.when(k % 11 == 0, "a/b").otherwise("main").alias("revision"),
        F.when(k % 5 == 0, "../m.gguf").otherwise("m.gguf").alias("gguf"), F.when(k % 7 == 0, "a/p.json").when(k % 2 == 0, "p.json").alias("profile"),
    )
    return writers.manifests(m).select("s_suppkey", F.array_join(validation.manifest_errors(), ",").alias("errors"), "key")


@query("write_permission", "SELECT s_suppkey, s_suppkey % 4 = 0 OR (s_suppkey % 4 = 1 AND s_suppkey % 3 = 0) AS can_write FROM supplier")
def write_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14."""
    k = F.col("s_suppkey")
    role = F.when(k % 4 == 0, "write").when(k % 4 == 1, "fineGrained").otherwise("read")
    grants = F.array(F.struct(F.lit("user").alias("kind"), F.when(k % 3 == 0, "me").otherwise("you").alias("name"), F.array(F.lit("repo.write")).alias("permissions")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", validation.can_write(role, F.lit(None).cast("array<string>"), grants, F.lit("me")).alias("can_write"))


@query("retry_classes", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'retry' WHEN 1 THEN 'retry' WHEN 2 THEN 'fatal' WHEN 3 THEN 'error' ELSE 'retry' END AS class, least(60.0, 2.0 * pow(2.0, event_id % 7))::DOUBLE AS wait FROM events")
def retry_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-27, backoff."""
    k = F.col("event_id") % 5
    code = F.when(k == 0, 429).when(k == 1, 503).when(k == 2, 401).when(k == 3, 400).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", validation.retry_class(code, F.when(k == 4, "timeout").otherwise("")).alias("class"), jobs.backoff((F.col("event_id") % 7).cast("double"), 2.0, 60.0).alias("wait"))


@query("device_choice", "SELECT n_nationkey AS host, 'Vulkan1' AS id FROM nation WHERE n_nationkey % 2 = 0")
def device_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-22, SRT-6: the better of two devices; hosts with one choose none."""
    one = F.lit("  Vulkan0: Intel UHD Graphics (16000 MiB, 1 MiB free)")
    two = F.concat(one, F.lit("\n  Vulkan1: NVIDIA Card (8000 MiB, 1 MiB free)"))
    t = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("host"), F.when(F.col("n_nationkey") % 2 == 0, two).otherwise(one).alias("text"))
    return jobs.best_device(jobs.devices(t))


@query(
    "newest_checkpoint",
    """WITH f AS (SELECT l_orderkey AS run, l_linenumber AS step, 'f' || (l_partkey % 2) AS name, l_quantity > 5 AS whole FROM lineitem), c AS (
      SELECT run, step FROM f WHERE whole GROUP BY run, step HAVING count(DISTINCT name) = 2) SELECT run, max(step) AS step FROM c GROUP BY run""",
)
def newest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-19."""
    f = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), F.concat(F.lit("f"), (F.col("l_partkey") % 2).cast("string")).alias("name"), (F.col("l_quantity") > 5).alias("whole")
    )
    return jobs.complete_checkpoints(f, ["f0", "f1"])


@query("metadata_keys", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'b,c' ELSE 'c' END AS missing FROM events")
def metadata_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-29."""
    have = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(validation.missing_keys(F.array(*map(F.lit, "abc")), have), ",").alias("missing"))


@query("archive_plan", "SELECT page_id, CASE WHEN page_id % 12 < 8 THEN 'stored' ELSE 'deflated' END AS method FROM pages")
def archive_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-8."""
    p = F.col("page_id")
    kinds = F.array(*map(F.lit, "gguf exe dll safetensors bin zip so dylib json png gz pdf".split()))
    kind = F.element_at(kinds, (p % 12 + 1).cast("int"))
    f = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(".", p.cast("string"), F.when(p % 5 == 0, F.upper(kind)).otherwise(kind)).alias("file"))
    return writers.archive_plan(f).select("page_id", "method")


@query("package_progress", "SELECT event_id, round_even(CASE event_id % 4 WHEN 0 THEN 0.0 + 0.35 * f WHEN 1 THEN 0.35 + 0.3 * f WHEN 2 THEN 0.65 + 0.2 * f ELSE 0.85 + 0.15 * f END, 6)::DOUBLE AS progress FROM (SELECT event_id, (event_id % 10) / 10::DOUBLE AS f FROM events)")
def package_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-30."""
    step = F.element_at(F.array(*[F.lit(n) for n, _ in jobs.PACKAGE_STEPS]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.bround(jobs.package_progress(step, (F.col("event_id") % 10) / 10), 6).alias("progress"))


@query("export_types", "SELECT p_partkey, CASE WHEN p_partkey % 50 >= 4.8 * (p_size % 9) + 2 THEN 'bf16' WHEN p_partkey % 50 >= 3.5 * (p_size % 9) + 2 THEN 'q8_0' ELSE 'fail' END AS kind FROM part")
def export_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-45."""
    return table(spark, sf_dir, "part").select("p_partkey", jobs.export_type((F.col("p_size") % 9).cast("double"), (F.col("p_partkey") % 50).cast("double")).alias("kind"))


@query("inherited_source", "SELECT n_name AS course_name, CASE WHEN n_nationkey % 2 = 0 THEN 'r' || n_regionkey ELSE 'edited' END AS source FROM nation")
def inherited_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-13."""
    n = table(spark, sf_dir, "nation")
    before = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("course_name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source"))
    return courses.inherited_source(n.select(F.col("n_name").alias("course_name"), F.lit(None).cast("string").alias("source")), before).select("course_name", "source")


@query("jobs_by_ids", "SELECT o_orderkey::VARCHAR AS job_id FROM orders WHERE o_orderkey IN (3, 1, 2, 7) AND o_orderkey % 7 <> 0")
def jobs_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-15, SET-5: jobs of an id list, each once, without replaced ones."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("job_id"), F.when(F.col("o_orderkey") % 7 == 0, "x").alias("replaced_by"))
    return jobs.jobs_by_ids(o, ["3", "1", "3", "2", "7"]).select("job_id")


@query("preferred_model", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'env' WHEN n_nationkey % 2 = 0 THEN 'kept' ELSE 'newest' END AS model FROM nation")
def preferred_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-17."""
    k = F.col("n_nationkey")
    have = F.when(k % 2 == 0, F.array(F.lit("kept"))).otherwise(F.array(F.lit("newest")))
    return table(spark, sf_dir, "nation").select("n_nationkey", readers.preferred_model(F.lit("kept"), F.when(k % 5 == 0, "env"), F.lit("newest"), have).alias("model"))


@query("pending_downloads", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0")
def pending_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-18."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("key"), F.concat(F.lit("g"), F.col("s_suppkey").cast("string")).alias("gguf"))
    return writers.pending_downloads(s, s.where("s_suppkey % 3 = 0"), s.where("s_suppkey % 4 = 0")).select("s_suppkey")


@query("course_totals", "SELECT count(DISTINCT source) AS courses, count(DISTINCT (source, lang)) AS topics FROM documents")
def course_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23."""
    c = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("topics"))
    return courses.totals(c).withColumn("topics", F.col("topics").cast("long"))


@query("chart_numbers", "SELECT l_orderkey, l_linenumber, round_even((l_extendedprice - l_extendedprice * (1 - l_discount)) / l_extendedprice * 100, 4) AS reduction FROM lineitem")
def chart_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-40: reductions in per cent."""
    li, p = table(spark, sf_dir, "lineitem"), F.col("l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", F.bround(losses.percent_reduction(p, p * (1 - F.col("l_discount"))), 4).alias("reduction"))


@query("ink_colours", "SELECT n_nationkey, CASE WHEN pow(n_nationkey * 10 / 255::DOUBLE, 2.2) > 0.28 THEN '#0b0b0b' ELSE '#ffffff' END AS ink FROM nation")
def ink_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-41, on greys."""
    part = F.lower(F.lpad(F.hex((F.col("n_nationkey") * 10).cast("long")), 2, "0"))
    return table(spark, sf_dir, "nation").select("n_nationkey", losses.ink_on(F.concat(F.lit("#"), part, part, part)).alias("ink"))


@query("progress_patch", "SELECT n_nationkey, n_nationkey::VARCHAR AS eta, '1' AS done, 2 AS fields FROM nation")
def progress_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-4, ARR-8: one field of a stage is laid over, the others stay."""
    before = F.create_map(F.lit("x"), F.create_map(F.lit("done"), F.lit("1"), F.lit("eta"), F.lit("9")))
    after = writers.patched_progress(before, F.lit("x"), F.create_map(F.lit("eta"), F.col("n_nationkey").cast("string")))["x"]
    return table(spark, sf_dir, "nation").select("n_nationkey", after["eta"].alias("eta"), after["done"].alias("done"), F.size(after).alias("fields"))


@query("file_hashes", "SELECT page_id, sha256(html) AS sha256, octet_length(encode(html)) AS n_bytes FROM pages")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12."""
    body = F.col("html").cast("binary")
    f = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), body.alias("content"), F.octet_length(body).cast("long").alias("length"))
    return writers.hashed_files(f).select(F.col("file").alias("page_id"), "sha256", "n_bytes")


@query("stream_payloads", "SELECT conv_id, string_agg(role, '' ORDER BY turn) AS text, true AS done FROM conversations GROUP BY conv_id")
def stream_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18, ARR-9: server-sent events cut into chunks of seven bytes and put together again."""
    line = F.concat(F.lit('data: {"choices":[{"delta":{"content":"'), "role", F.lit('"}}]}\r\n'))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda e: e["l"]), "").alias("b"))
    raw = F.concat("b", F.lit("data: [DONE]\n")).cast("binary")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(raw) - 1) / 7)), lambda i: F.substring(raw, (i * 7 + 1).cast("int"), F.lit(7)))
    chunks = c.select(F.col("conv_id").alias("stream"), F.posexplode(cut).alias("seq", "bytes"))
    return chat.stream_text(chat.sse_payloads(chunks)).select(F.col("stream").alias("conv_id"), "text", "done")


@query("guide_texts", "SELECT n_nationkey, '# ' || n_name || chr(10) || chr(10) || '## S' || chr(10) || chr(10) || 'body' || chr(10) AS markdown FROM nation")
def guide_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-10."""
    none = F.array().cast("array<struct<label:string,code:string>>")
    g = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("guide_id"), F.col("n_name").alias("title"), F.array(F.struct(F.lit("S").alias("title"), F.lit("body").alias("body"), none.alias("commands"))).alias("sections"))
    return writers.guide_markdown(g).select(F.col("guide_id").alias("n_nationkey"), "markdown")


@query("log_tails", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 8")
def log_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-20: the last eight lines of each log (the limit is the feature)."""
    lines = table(spark, sf_dir, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("pos"), F.col("event_type").alias("line"))
    return search.last_lines(lines, 8).select(F.col("log").alias("user_id"), F.col("pos").alias("event_id"))


@query("teacher_rows", "SELECT item_id, 0 AS errors FROM benchmark")
def teacher_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-19: rows of the stand-in teacher pass the rules."""
    p = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_id"), F.concat(F.lit("Topic: item "), F.col("item_id").cast("string")).alias("prompt"))
    rows = readers.fake_teacher(p).select("prompt_id", F.from_json("json", "instruction string, rationale string, output string").alias("r")).select("prompt_id", "r.*")
    return rows.select(F.col("prompt_id").alias("item_id"), F.size(validation.platform_errors(F.lit("English"), F.array().cast("array<string>"))).alias("errors"))
