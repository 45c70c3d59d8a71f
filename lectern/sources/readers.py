"""Scans: corpora, answer logs, reports, uploads, model folders."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import arrays, text
from lectern.functions.udfs import extract_text, suffix_of
from lectern.operators.validation import KEYS

ROW = "course_name string, domain string, instruction string, rationale string, output string"
#: Older corpora: three capitalised keys, renamed on load and never mixed with the five-key form.
ROW_V1 = "Instruction string, Rationale string, Output string"
GGUF_MAGIC = "GGUF"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def corpus_rows(spark: SparkSession, path: str, version: str = "v2") -> DataFrame:
    """Rows of JSON-array files with row_idx, their place in the file's order."""
    schema = ROW if version == "v2" else ROW_V1
    rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_m"))
    rows = rows.withColumn("row_idx", F.row_number().over(Window.partitionBy("file").orderBy("_m")) - 1).drop("_m")
    return rows if version == "v2" else rows.withColumnsRenamed({"Instruction": "instruction", "Rationale": "rationale", "Output": "output"})


def raw_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_idx, json): the elements of JSON-array files as they are, whatever their shape."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    items = F.variant_get(F.try_parse_json("value"), "$", "array<variant>")
    return whole.select("file", F.posexplode(items).alias("row_idx", "v")).select("file", "row_idx", F.to_json("v").alias("json"))


def strict_rows(spark: SparkSession, path: str, expected_domain: str) -> DataFrame:
    """Rows of one domain's file; raises on another key set, a blank value or another domain."""
    raw = raw_objects(spark, path)
    bad_keys = raw.where(~F.coalesce(arrays.is_key_set(F.col("json"), list(KEYS)), F.lit(False)))
    rows = raw.select("file", "row_idx", F.from_json("json", ROW).alias("r")).select("file", "row_idx", "r.*")
    blank = rows.where(F.greatest(*[text.is_blank(F.col(k)) for k in KEYS]) | (F.col("domain") != expected_domain))
    first = bad_keys.select("row_idx").unionByName(blank.select("row_idx")).agg(F.min("row_idx")).first()[0]
    if first is not None:
        raise ValueError(f"row {first} of {path} breaks the row contract")
    return rows


def manifest_rows(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """The files of a manifest [(path, domain)] in its order; a missing file is an error."""
    for path, _ in sources:
        if not exists(spark, path):
            raise FileNotFoundError(path)
    from lectern.operators.corpus import merged

    return merged([strict_rows(spark, p, d) for p, d in sources])


def resumable_rows(spark: SparkSession, path: str, domain: str) -> tuple[DataFrame, int]:
    """What a broken run left for a domain, and how many elements were dropped. A missing or unreadable
    file is an empty one; rows need the five keys as strings, others are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], ROW), 0
    raw = raw_objects(spark, path)
    rows = raw.select("row_idx", F.from_json("json", ROW).alias("r")).select("row_idx", "r.*")
    whole = F.lit(True)
    for k in KEYS:
        whole = whole & F.col(k).isNotNull()
    kept = rows.where(whole & (F.col("domain") == domain))
    return kept, raw.count() - kept.count()


def json_or_default(spark: SparkSession, path: str, schema: str, default: list[tuple]) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame(default, schema)
    return spark.read.option("multiLine", True).schema(schema).json(path)


def json_lines(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """Records of an append-only log with ``line`` (their order); blank, cut and keyless lines go."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parsed = lines.select("line", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r")).select("line", "r.*")
    return parsed.where(F.col("_bad").isNull()).drop("_bad").na.drop(subset=key)


def last_by_key(records: DataFrame, key: list[str]) -> DataFrame:
    """The last record of each key."""
    return records.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("line")))).where("_r = 1").drop("_r")


def csv_report(spark: SparkSession, path: str, schema: str | None = None, required: list[str] | None = None, key: str = "Domain") -> DataFrame:
    """A CSV file with a header (and perhaps a byte-order mark); raises if a required row is missing."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    frame = reader.csv(path) if schema is None else reader.schema(schema).csv(path)
    if required:
        have = {r[0] for r in frame.where(F.col(key).isin(required)).select(key).distinct().collect()}
        if missing := [r for r in required if r not in have]:
            raise KeyError(f"{path} lacks {missing}")
    return frame


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, suffix, n_bytes, text) of uploaded files; unreadable ones have a null text."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), suffix_of(F.col("path")).alias("suffix"), F.col("length").alias("n_bytes"), extract_text("content", suffix_of(F.col("path"))).alias("text"))


PASTE_SEPARATOR = r"(?m)^[ \t]*-{3,}[ \t]*$"


def pasted_blocks(pastes: DataFrame) -> DataFrame:
    """(paste_id, n, name, block): pasted text cut at lines of hyphens; blank blocks are skipped."""
    blocks = F.filter(F.transform(F.split("text", PASTE_SEPARATOR), text.stripped), lambda b: b != "")
    return pastes.select("paste_id", F.posexplode(blocks).alias("i", "block")).select(
        "paste_id", (F.col("i") + 1).alias("n"), F.concat(F.lit("Pasted text "), (F.col("i") + 1).cast("string")).alias("name"), "block"
    )


def pasted_text(blocks: DataFrame) -> DataFrame:
    """The paste again: its blocks in order, joined by a line of hyphens."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda e: e["block"])
    return blocks.groupBy("paste_id").agg(F.array_join(ordered, "\n---\n").alias("text"))


UPLOAD_SUFFIXES = ("pdf", "docx", "txt", "md")


def accepted_uploads(files: DataFrame, most_bytes: int) -> DataFrame:
    """Uploads with a known suffix and size, named by number and slug; kept ones come first.
    ``files``: file, n_bytes, kept."""
    ok = files.withColumn("suffix", suffix_of(F.col("file"))).where(F.col("suffix").isin(*UPLOAD_SUFFIXES) & (F.col("n_bytes") <= most_bytes))
    n = F.row_number().over(Window.orderBy(F.desc("kept"), "file"))
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/\\]+)\.[^.]+$", 1), "[^A-Za-z0-9]+", "-")
    return ok.withColumn("n", n).withColumn("stored", F.concat(F.format_string("%02d-", F.col("n")), F.lower(stem), F.lit("."), F.col("suffix")))


def kept_files(uploaded: DataFrame, wanted: DataFrame) -> DataFrame:
    return uploaded.join(wanted.select("file").distinct(), "file", "left_semi")


def model_files(spark: SparkSession, folder: str) -> DataFrame:
    """Model files that begin with the right magic, newest first, with their profile beside them if
    it is valid JSON: file, stem, size_bytes, modified, profile."""
    read = lambda glob: spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    models = read("*.gguf").where(F.substring("content", 1, 4) == F.lit(GGUF_MAGIC).cast("binary"))
    body = F.decode("content", "utf-8")
    profiles = read("*.json").select(stem.alias("stem"), F.when(F.try_parse_json(body).isNotNull(), body).alias("profile")).where("profile is not null")
    found = models.select(F.col("path").alias("file"), stem.alias("stem"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    return found.join(profiles, "stem", "left").orderBy(F.desc("modified"), "file")


def first_valid_manifest(candidates: DataFrame) -> DataFrame:
    """The valid manifest of highest priority (lowest place). ``candidates``: place and manifest columns."""
    from lectern.operators.validation import manifest_errors

    return candidates.where(F.size(manifest_errors()) == 0).orderBy("place").limit(1)


def preferred_model(saved: Column, env: Column, newest: Column, present: Column) -> Column:
    """The model to start: one set from outside, else the saved one if it is still there, else the newest."""
    return F.coalesce(env, F.when(F.array_contains(present, saved), saved), newest)


def fake_teacher(prompts: DataFrame) -> DataFrame:
    """(prompt_id, json): a deterministic stand-in for a model that answers with a valid row."""
    topic = F.coalesce(F.nullif(text.stripped(F.regexp_extract("prompt", r"(?i)topic:\s*([^\n]+)", 1)), F.lit("")), F.lit("the topic"))
    n = F.pmod(F.xxhash64("prompt"), F.lit(7)) + 2
    points = [
        F.concat(F.lit("1. "), topic, F.lit(" rests on one idea that can be named.")),
        F.concat(F.lit("2. For example, "), n.cast("string"), F.lit(" * 3 = "), (n * 3).cast("string"), F.lit(" shows it in numbers.")),
        F.concat(F.lit("3. The same steps settle every case of "), topic, F.lit(".")),
    ]
    answer = F.struct(
        F.concat(F.lit("How does "), topic, F.lit(" work, and why?")).alias("instruction"),
        F.concat_ws("\n", *points).alias("rationale"),
        F.concat(F.lit("In short: "), topic, F.lit(" follows from one idea applied step by step.")).alias("output"),
    )
    return prompts.select("prompt_id", F.to_json(answer).alias("json"))


def teacher_answers(prompts: DataFrame, complete) -> DataFrame:  # type: ignore[no-untyped-def]
    """(prompt_id, json) from any backend ``complete(prompt) -> dict``, one client for each partition."""

    def ask(batches):  # type: ignore[no-untyped-def]
        for batch in batches:
            batch["json"] = [json.dumps(complete(p), ensure_ascii=False) for p in batch["prompt"]]
            yield batch[["prompt_id", "json"]]

    return prompts.select("prompt_id", "prompt").mapInPandas(ask, "prompt_id long, json string")


def exemplars(rows: DataFrame, n: int = 3, seed: int = 42) -> DataFrame:
    from lectern.operators.corpus import seeded

    return rows.orderBy(seeded("row_idx", seed=seed), "row_idx").limit(n)
