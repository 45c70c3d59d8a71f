"""Readers, writers and streams."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.sources import readers, writers
from lectern.streaming import jobs as streams

ROW = {"course_name": "c", "domain": "d", "instruction": "i", "rationale": "r", "output": "o"}


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return f"file://{path}"


def test_corpus_files(spark, tmp_path):
    a = put(tmp_path / "a.json", [ROW, ROW | {"instruction": "two"}])
    assert [(r["row_idx"], r["instruction"]) for r in readers.corpus_rows(spark, a).orderBy("row_idx").collect()] == [(0, "i"), (1, "two")]
    old = put(tmp_path / "old.json", [{"Instruction": "x", "Rationale": "y", "Output": "z"}])
    assert readers.corpus_rows(spark, old, "v1").first()["instruction"] == "x"
    assert readers.strict_rows(spark, a, "d").count() == 2
    for i, bad in enumerate([[ROW | {"more": "x"}], [ROW | {"output": " "}], [{k: v for k, v in ROW.items() if k != "output"}], [ROW | {"domain": "e"}]]):
        with pytest.raises(ValueError, match="row 0"):
            readers.strict_rows(spark, put(tmp_path / f"bad{i}.json", bad), "d")
    b = put(tmp_path / "b.json", [ROW | {"domain": "e"}])
    both = readers.manifest_rows(spark, [(a, "d"), (b, "e")])
    assert sorted((r["source_idx"], r["row_idx"]) for r in both.collect()) == [(0, 0), (0, 1), (1, 0)]
    with pytest.raises(FileNotFoundError):
        readers.manifest_rows(spark, [(f"file://{tmp_path}/none.json", "d")])


def test_resuming(spark, tmp_path):
    kept, dropped = readers.resumable_rows(spark, put(tmp_path / "r.json", [ROW, ROW | {"domain": "x"}, {"domain": "d"}, 3]), "d")
    assert (kept.count(), dropped) == (1, 3)
    assert readers.resumable_rows(spark, put(tmp_path / "cut.json", '[{"course_name": "c"'), "d")[0].count() == 0
    assert readers.resumable_rows(spark, f"file://{tmp_path}/none.json", "d")[0].count() == 0
    assert readers.json_or_default(spark, f"file://{tmp_path}/none.json", "a int", [(7,)]).first()["a"] == 7


def test_append_logs(spark, tmp_path):
    log = put(tmp_path / "log.jsonl", '{"idx": 1, "a": "old"}\n\n{"idx": 2, "a": "x"}\n{"idx": 1, "a": "new"}\n{"a": "no key"}\n{"idx": 3, "a": "cu')
    records = readers.json_lines(spark, log, "idx int, a string", ["idx"])
    assert sorted((r["idx"], r["a"]) for r in readers.last_by_key(records, ["idx"]).collect()) == [(1, "new"), (2, "x")]
    out = f"file://{tmp_path}/appended"
    for i in range(2):
        writers.append_json_lines(spark.createDataFrame([(i,)], "idx int"), out)
    assert spark.read.json(out).count() == 2


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", 0.1234565, 'say "x", y'), (0, "a", None, "line\nbreak")], "place int, Domain string, loss double, note string")
    path = f"{tmp_path}/report.csv"
    writers.write_report(df, path, "place", {"loss": 6})
    assert open(path, "rb").read().startswith(b"\xef\xbb\xbfDomain,loss,note\r\n")
    back = readers.csv_report(spark, f"file://{path}", required=["a", "b"])
    assert [tuple(r) for r in back.collect()] == [("a", None, "line\nbreak"), ("b", "0.123456", 'say "x", y')]
    with pytest.raises(KeyError):
        readers.csv_report(spark, f"file://{path}", required=["c"])


def test_json_export(spark, tmp_path):
    df = spark.createDataFrame([(1, "b", None), (0, "ä", "x")], "place int, a string, b string")
    writers.write_json_array(df, f"{tmp_path}/x.json", "place")
    assert json.load(open(f"{tmp_path}/x.json", encoding="utf-8")) == [{"a": "ä", "b": "x"}, {"a": "b", "b": None}]
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".part")]


def test_uploads(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("שלום".encode("cp1255"))
    (tmp_path / "b.md").write_bytes("﻿é".encode())
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr>{cell('x')}{cell('y')}</w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = {os.path.basename(r["file"]): r["text"] for r in readers.documents(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": "שלום", "b.md": "é", "c.docx": "one\nx | y", "d.docx": None}
    files = spark.createDataFrame([("/u/My File.pdf", 5, False), ("x.exe", 1, False), ("big.txt", 99, False), ("old.md", 1, True)], "file string, n_bytes long, kept boolean")
    assert [(r["stored"]) for r in readers.accepted_uploads(files, 50).orderBy("n").collect()] == ["01-old.md", "02-my-file.pdf"]


def test_pastes(spark):
    df = spark.createDataFrame([(1, "a\nb\n---\n \n -----  \nc"), (2, "-- no cut --")], "paste_id long, text string")
    blocks = readers.pasted_blocks(df)
    assert sorted((r["paste_id"], r["name"], r["block"]) for r in blocks.collect()) == [(1, "Pasted text 1", "a\nb"), (1, "Pasted text 2", "c"), (2, "Pasted text 1", "-- no cut --")]
    assert {r["paste_id"]: r["text"] for r in readers.pasted_text(blocks).collect()}[1] == "a\nb\n---\nc"


def test_model_folders(spark, tmp_path):
    for name, body in (("a.gguf", b"GGUFxx"), ("b.gguf", b"nope"), ("a.json", b'{"x": 1}'), ("c.gguf", b"GGUF"), ("c.json", b"{broken")):
        (tmp_path / name).write_bytes(body)
    got = {r["stem"]: r["profile"] for r in readers.model_files(spark, f"file://{tmp_path}").collect()}
    assert got == {"a": '{"x": 1}', "c": None}
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/a.gguf")
    h = writers.hashed_files(files).first()
    manifest = spark.createDataFrame([(h["file"], 6, h["sha256"].upper()), ("gone", None, None)], "file string, size_bytes long, sha256 string")
    assert sorted((r["state"]) for r in writers.verified(files, manifest).collect()) == ["missing", "ok"]


def test_teacher(spark):
    prompts = spark.createDataFrame([(1, "Topic: heaps\nmore"), (2, "nothing")], "prompt_id long, prompt string")
    rows = readers.fake_teacher(prompts).select("prompt_id", F.from_json("json", "instruction string, rationale string, output string").alias("r")).select("prompt_id", "r.*")
    from lectern.operators.validation import platform_errors

    assert [r["e"] for r in rows.select(platform_errors(F.lit("English"), F.array().cast("array<string>")).alias("e")).collect()] == [[], []]
    assert readers.teacher_answers(prompts, lambda p: {"n": len(p)}).count() == 2


def test_upserts_and_progress(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    changes = spark.createDataFrame([("b", 3, 0), ("b", 4, 1), ("c", 5, 0)], "k string, v int, seq int")
    assert sorted(map(tuple, writers.upsert(now, changes, ["k"], "seq").collect())) == [("a", 1), ("b", 4), ("c", 5)]
    p = F.create_map(F.lit("x"), F.create_map(F.lit("done"), F.lit("1"), F.lit("eta"), F.lit("9")))
    got = spark.range(1).select(writers.patched_progress(p, F.lit("x"), F.create_map(F.lit("eta"), F.lit("3"))).alias("m")).first()["m"]
    assert got == {"x": {"done": "1", "eta": "3"}}


def test_texts_and_plans(spark):
    g = spark.createDataFrame([(1, "T", [("A", "body", [("run", "x")])])], "guide_id int, title string, sections array<struct<title:string,body:string,commands:array<struct<label:string,code:string>>>>")
    assert writers.guide_markdown(g).first()["markdown"] == "# T\n\n## A\n\nbody\n\nrun\n\n```\nx\n```\n"
    files = spark.createDataFrame([("b.gguf",), ("a.txt",)], "file string")
    assert [tuple(r) for r in writers.archive_plan(files).collect()] == [("a.txt", "deflated"), ("b.gguf", "stored")]
    m = writers.manifests(spark.createDataFrame([("o/r", "v1", "m.gguf")], "repo string, revision string, gguf string"))
    assert writers.pending_downloads(m, m.limit(0), spark.createDataFrame([("x.gguf",)], "gguf string")).count() == 1
    assert writers.pending_downloads(m, m, m.limit(0)).count() == 0


def test_state_moves():
    assert streams.fold_states(["staging", "queued", "running", "succeeded", "running"], streams.JOB_MOVES) == ("succeeded", 1)
    assert streams.fold_states(["starting", "ready", "noModel", "stopped"], streams.ENGINE_MOVES) == ("stopped", 1)


def test_job_states_over_batches(spark, tmp_path):
    events = [("a", 1, "queued"), ("a", 2, "running"), ("b", 3, "queued"), ("a", 4, "queued"), ("b", 5, "succeeded"), ("a", 6, "running"), ("a", 7, "succeeded")]
    for i, e in enumerate(events):
        spark.createDataFrame([e], "job_id string, event_id long, status string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = streams.event_stream(spark, f"file://{tmp_path}/in", "job_id string, event_id long, status string", files_per_batch=3)
    streams.run_once(streams.job_states(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    got = sorted(map(tuple, streams.last_updates(spark, f"file://{tmp_path}/out", "job_id").select("job_id", "status", "events", "ignored").collect()))
    assert got == [("a", "succeeded", 5, 0), ("b", "queued", 2, 1)]
