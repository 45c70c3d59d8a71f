import random

import pytest

import corpus_pipeline
from lectern.llm import stages
from lectern.llm.common import stored

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def document(i, text, source="s0"):
    return (i, text, "en", source, None if text is None else len(text))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "so") for b in ("ban", "del", "fim", "gop", "han", "jut", "kel")]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(14)) + "."
    rows = [document(i, "\n".join(sentence() for _ in range(rng.randint(3, 8))), f"s{i % 4}") for i in range(160)]
    toxic = [document(200 + i, "\n".join([sentence(), "you idiot " + sentence(), "such trash, you moron " + sentence()])) for i in range(40)]
    notice = "This notice stands in very many of the documents of this collection."
    rows += [document(300 + i, notice + "\n" + "\n".join(sentence() for _ in range(4)), "s1") for i in range(20)]
    rows += [document(400 + i, rows[3][1], "s2") for i in range(5)]  # exact copies
    one_line = [w for _ in range(60) for w in [rng.choice(vocabulary)]]
    for i in range(6):  # near copies of one line: no line repeats
        w = one_line[:]
        w[i * 7] = f"other{i}"
        rows.append(document(500 + i, " ".join(w), "s3"))
    rows += [document(600, None), document(601, ""), (None, "a text without an id but with words", "en", None, None)]
    return rows, toxic


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    clean, toxic = rows
    path = f"file://{tmp_path_factory.mktemp('pipeline')}"
    spark.createDataFrame(clean + toxic, DOC).repartition(4).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 0, 0) for r in clean if r[0] is not None and r[0] < 160] + [(r[0], 0, 1) for r in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "mixing", "packing"]


def test_each_stage_on_its_own_input(spark, rows, folder):
    clean, toxic = rows
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    after = []
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = stored(stage(spark, docs, folder), f"test-{name}")
        after.append(docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = [sorted((r["doc_id"] for r in d.select("doc_id").collect()), key=repr) for d in after]
    # toxic documents go, clean ones stay
    assert ids[0] == sorted((r[0] for r in clean), key=repr)
    # copies go as a whole, other documents stay and lose the notice but once
    assert set(ids[0]) - set(ids[1]) == {400, 401, 402, 403, 404}
    kept = {r["doc_id"]: r for r in after[1].collect()}
    assert sum("This notice" in (r["text"] or "") for r in kept.values()) == 1
    assert all(r["n_chars"] == len(r["text"]) for i, r in kept.items() if i is not None and i < 500)
    # one of the near copies stays
    assert set(ids[1]) - set(ids[2]) == {501, 502, 503, 504, 505}
    # the mix takes whole documents, none more than twice
    taken = {}
    for i in ids[3]:
        taken[i] = taken.get(i, 0) + 1
    assert set(taken) <= set(ids[2]) and max(taken.values()) <= 2
    pieces = after[4].collect()
    tokens = {}
    for p in pieces:
        tokens[p["sequence_id"]] = tokens.get(p["sequence_id"], 0) + p["length"]
    assert all(n <= 4096 and (n & (n - 1)) == 0 for n in tokens.values())
    whole = {}
    for p in pieces:
        if p["doc_id"] is not None:
            whole[p["doc_id"]] = whole.get(p["doc_id"], 0) + p["length"]
    size = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert all(whole[i] == taken[i] * size[i] for i in whole)


def test_run_gives_the_last_stage(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 100


def test_one_of_each_class_with_repeated_rows(spark):
    text = "some words that are the same in all of these rows here"
    rows = [document(5, text), document(5, text), document(3, text), document(None, text), document(9, "other words that stand in this row and in no other one"), document(9, "other words that stand in this row and in no other one"), document(None, "alone without id and not like the others at all")]
    got = stages.one_of_each_class(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(((r["doc_id"], r["text"][:5]) for r in got), key=repr) == [(3, "some "), (9, "other"), (None, "alone")]


def test_one_of_each_class_of_one_id(spark):
    one, two = "some words of the first text that stand under this id", "other words of the second text under the very same id"
    rows = [document(5, one), document(5, two), document(7, two + " here"), document(6, ""), document(6, "third words under an id that has an empty text too")]
    got = stages.one_of_each_class(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r["doc_id"], r["text"][:5]) for r in got) == [(5, "other"), (5, "some "), (6, ""), (6, "third")]


def test_unique_lines_stay_where_most_lines_repeat(spark):
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(9))
    shared, own = [line() for _ in range(40)], [line() for _ in range(10)]
    rows = [document(1, "\n".join(shared)), document(2, "\n".join(shared + own)), document(3, "\n".join(shared)), document(4, shared[0] + "\n\n"), document(5, ""), document(6, None)]
    got = {r["doc_id"]: r for r in stages.without_repeated_lines(spark.createDataFrame(rows, DOC)).collect()}
    assert set(got) == {1, 2, 5, 6}
    assert got[2]["text"] == "\n".join(own) and got[2]["n_chars"] == len(got[2]["text"])


def test_empty_documents(spark, folder, tmp_path):
    path = f"file://{tmp_path}"
    spark.createDataFrame([], DOC).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
