"""Sinks: whole-file JSON and CSV that appear at once, append logs, upserts, manifests, hashes."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def write_whole(path: str, body: str, encoding: str = "utf-8") -> None:
    """A small local file that is either there as a whole or not at all."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".part")
    with os.fdopen(handle, "w", encoding=encoding, newline="") as f:
        f.write(body)
    os.replace(temporary, path)


def write_json_array(rows: DataFrame, path: str, order: str) -> None:
    """Rows in order as one JSON array, streamed through the driver row by row; for exports of a size
    that one file can have. Large corpora are written as Parquet instead."""
    columns = [c for c in rows.columns if c != order]
    lines = rows.orderBy(order).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator()
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".part")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(lines):
            f.write((",\n" if i else "\n") + r["j"])
        f.write("\n]\n")
    os.replace(temporary, path)


def write_parquet(rows: DataFrame, path: str, *partition_by: str) -> None:
    """The corpus itself: a folder that Spark commits as a whole."""
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_report(rows: DataFrame, path: str, order: str, digits: dict[str, int]) -> None:
    """A small report as one CSV file with a byte-order mark, numbers rounded half to even."""
    import csv
    import io

    columns = [c for c in rows.columns if c != order]
    rounded = rows.orderBy(order).select(*[F.bround(c, digits[c]).alias(c) if c in digits else F.col(c) for c in columns])
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\r\n")
    writer.writerow(columns)
    for r in rounded.toLocalIterator():
        writer.writerow(["" if v is None else v for v in r])
    write_whole(path, BOM + out.getvalue())


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``current`` with the last change of each key in place of its row."""
    from lectern.operators.chat import latest

    last = latest(changes, keys, order).drop(order)
    return current.join(last.select(*keys), keys, "left_anti").unionByName(last)


def patched_progress(progress: Column, stage: Column, patch: Column) -> Column:
    """A map of stages with one stage's fields laid over."""
    from lectern.functions.arrays import patched

    empty = F.create_map().cast("map<string,string>")
    return patched(progress, F.create_map(stage, patched(F.coalesce(F.try_element_at(progress, stage), empty), patch)))


# File kinds that are compressed already and go into an archive as they are.
STORED_SUFFIXES = ("gguf", "exe", "dll", "safetensors", "bin", "zip", "so", "dylib")


def archive_plan(files: DataFrame) -> DataFrame:
    """Files of an archive in order with the way each is packed."""
    suffix = F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1))
    return files.withColumn("method", F.when(suffix.isin(*STORED_SUFFIXES), "stored").otherwise("deflated")).orderBy("file")


def hashed_files(files: DataFrame) -> DataFrame:
    """(file, n_bytes, sha256) of a binaryFile scan."""
    return files.select(F.col("path").alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files against a manifest (file, size_bytes, sha256): 'ok', 'size', 'hash' or 'missing'."""
    state = (
        F.when(F.col("n_bytes").isNull(), "missing").when(F.col("size_bytes").isNotNull() & (F.col("n_bytes") != F.col("size_bytes")), "size")
        .when(F.col("expected").isNotNull() & (F.col("sha256") != F.lower("expected")), "hash").otherwise("ok")
    )
    return manifest.withColumnRenamed("sha256", "expected").join(hashed_files(files), "file", "left").withColumn("state", state).select("file", "state")


def manifests(models: DataFrame) -> DataFrame:
    """Model manifests (repo, revision, gguf, profile, display_name, sha256, size_bytes) with their key
    and download address."""
    key = F.concat(F.col("repo"), F.lit("@"), F.col("revision"), F.lit("/"), F.col("gguf"))
    url = F.concat(F.lit("https://huggingface.co/"), F.col("repo"), F.lit("/resolve/"), F.col("revision"), F.lit("/"), F.col("gguf"), F.lit("?download=true"))
    return models.select("*", key.alias("key"), url.alias("url"))


def pending_downloads(manifest: DataFrame, done: DataFrame, installed: DataFrame) -> DataFrame:
    """Manifests neither marked done (key) nor there as a file (gguf)."""
    return manifest.join(done.select("key"), "key", "left_anti").join(installed.select("gguf"), "gguf", "left_anti")


def guide_markdown(guides: DataFrame) -> DataFrame:
    """(guide_id, markdown) of guides: title and sections (title, body, commands (label, code))."""
    command = lambda c: F.concat(F.lit("\n\n"), c["label"], F.lit("\n\n```\n"), c["code"], F.lit("\n```"))
    section = lambda s: F.concat(F.lit("\n\n## "), s["title"], F.lit("\n\n"), s["body"], F.array_join(F.transform(s["commands"], command), ""))
    return guides.select("guide_id", F.concat(F.lit("# "), F.col("title"), F.array_join(F.transform("sections", section), ""), F.lit("\n")).alias("markdown"))


def profile_json(profiles: DataFrame) -> DataFrame:
    """(model, json): a model's profile with its prompt, sampling and example questions."""
    body = F.struct("display_name", "context_length", F.struct("preamble", "separator").alias("prompt"), "sampling", "example_questions", "courses")
    return profiles.select("model", F.to_json(body).alias("json"))


def to_json_text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)
