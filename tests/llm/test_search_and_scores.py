import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm.graph import beam_search, build_graph, nearest, robust_prune
from lectern.llm.topk import top_k
from lectern.llm.toxicity import BoostedTrees, _Codes, features, held_out, isotonic, score_toxicity, train

SCHEMA = "vec_id long, embedding array<float>, v int, rank string, dim int, block int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], 1, "r", 2, 3) for i, e in rows], SCHEMA).repartition(3)


def odd_rows():
    return [(9000, None), (9010, []), (9020, [0.0] * 8), (9030, [1.0, None] + [0.0] * 6), (9040, [NAN] + [1.0] * 7), (9050, [INF] + [1.0] * 7), (None, [1.0] * 8), (9100, [1.0, 2.0]), (9120, [0.5, 1.0])]


def vectors(n, d, seed, scale=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    return x * rng.uniform(0.2, 3.0, size=(n, 1)).astype(np.float32) if scale else x / np.linalg.norm(x, axis=1, keepdims=True)


# --- graph search -----------------------------------------------------------------------------


def test_pruning_keeps_diverse_neighbours():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [-3, 0]], dtype=np.float32)
    kept = robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, -1, 0]]), 4, 1.2)[0]
    assert kept.tolist() == [1, 3, 4, -1]


def test_beam_search_finds_most_neighbours():
    x = vectors(3000, 16, 1, scale=False)
    edges, entry = build_graph(x)
    q = vectors(100, 16, 2, scale=False)
    found, score, _ = beam_search(x, edges, entry, q, 96)
    exact = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(f[:10]) & set(e)) for f, e in zip(found, exact, strict=True)]) >= 9.5
    assert (np.diff(score, axis=1) <= 1e-6).all()


@pytest.mark.parametrize("seed,copies", [(3, 1), (4, 40)])
def test_nearest_recall_and_contract(spark, seed, copies):
    x = vectors(1500, 8, seed)
    rows = [(i, e) for i, e in enumerate(x.tolist())] + [(2000 + i, x[7].tolist()) for i in range(copies)] + odd_rows()
    got = nearest(table(spark, rows), "vec_id % 20 = 0", k=20, shard_rows=400).collect()
    full = {i: np.array(e, dtype=np.float32).astype(np.float64) for i, e in rows if i is not None and i < 9000}
    ids = np.array(sorted(full))
    m = np.stack([full[i] for i in ids])
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {i for i in full if i % 20 == 0} | {9100, 9120}
    hit = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
        keys = [(-r["score"], r["vec_id"]) for r in found]
        assert keys == sorted(keys) and len({r["vec_id"] for r in found}) == len(found)
        if q >= 9000:
            assert [r["vec_id"] for r in found] == [9120 if q == 9100 else 9100]
            continue
        assert all(abs(r["score"] - full[q] @ full[r["vec_id"]]) < 1e-9 for r in found) and len(found) == 20
        s = m @ full[q]
        order = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hit += len(set(order) & {r["vec_id"] for r in found}) / 20
    assert hit / len([q for q in by if q < 9000]) >= 0.97


def test_two_vectors_of_one_id_ask_by_themselves(spark):
    x = vectors(300, 8, 9)
    rows = [(i + 1, e) for i, e in enumerate(x.tolist())] + [(20, (-x[40]).tolist())]
    got = nearest(table(spark, rows), "vec_id = 20", k=20).collect()
    assert sorted(r["rank"] for r in got) == sorted([*range(1, 21)] * 2)


def test_nearest_of_little(spark):
    assert nearest(table(spark, []), "vec_id % 20 = 0").count() == 0
    assert nearest(table(spark, [(0, [1.0, 2.0]), (0, [1.0, 2.0])]), "vec_id % 20 = 0").count() == 0
    assert [(r["query_id"], r["vec_id"]) for r in nearest(table(spark, [(0, [1.0, 2.0]), (1, [1.0, 0.0])]), "vec_id % 20 = 0").collect()] == [(0, 1)]


# --- exact top-k ------------------------------------------------------------------------------


@pytest.mark.parametrize("seed,scale,block_rows", [(5, True, 150), (6, False, 10_000)])
def test_top_k_is_exact(spark, seed, scale, block_rows):
    x = vectors(900, 12, seed, scale)
    rows = [(i, e) for i, e in enumerate(x.tolist())] + [(1000 + i, x[3].tolist()) for i in range(120)] + [(i, (x[i - 2000] * 0.01).tolist()) for i in range(2000, 2100)]
    rows += [(i, [0.0] * 12) for i in range(3000, 3003)] + odd_rows() + [(50, rows[50][1])]
    got = sorted(tuple(r) for r in top_k(table(spark, rows), "vec_id % 50 = 0", k=5, block_rows=block_rows).select("query_id", "rank", "vec_id", "score").collect())
    ints = {i: [int(np.floor(256.0 * float(np.float32(c)))) for c in e] for i, e in rows if i is not None and e is not None and all(c is not None and np.isfinite(c) for c in e)}
    want = []
    for q in ints:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))
            want += [(q, k + 1, c, -v) for k, (v, c) in enumerate(s[:5])]
    assert got == sorted(want)


def test_top_k_of_little(spark):
    assert top_k(table(spark, []), "vec_id % 50 = 0").count() == 0
    assert top_k(table(spark, [(0, [1.0])]), "vec_id % 50 = 0").count() == 0


# --- toxicity ---------------------------------------------------------------------------------


def test_features_see_what_they_name():
    plain = _Codes({"zorp": 3.0}, {"blim": 2.0})
    f = lambda t: dict(zip(__import__("lectern.llm.toxicity", fromlist=["FEATURES"]).FEATURES, features(t, plain), strict=True))
    a = f("You are an idiot, zorp! BLIMBLAM id10t m0ron soooo")
    assert a["fixed"] > 0 and a["learned"] > 0 and a["beginnings"] > 0 and a["undone"] > 0
    assert a["near_second_person"] > 0 and a["all_caps"] > 0 and a["exclamations"] > 0 and a["obfuscated"] > 0 and a["stretched"] > 0
    assert set(f("").values()) == {0.0} and set(f(" \n").values()) == {0.0}
    assert f("a quiet sentence about stones")["any"] == 0


def test_trees_learn_and_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0)).astype(float)
    t = BoostedTrees(trees=60).fit(x[:1500], y[:1500])
    assert ((t.raw(x[1500:]) > 0) == (y[1500:] > 0.5)).mean() > 0.93
    at, rate = isotonic(t.raw(x[1500:]), y[1500:])
    assert (np.diff(at) > 0).all() and (np.diff(rate) >= 0).all()


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(1)
    clean = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("al", "en", "or", "ist", "ume", "ath")]
    bad = ["grobnak", "vexilo", "idiot", "trash"]
    docs, labels = [], []
    for i in range(1200):
        w = [rng.choice(clean) for _ in range(rng.randint(10, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_scores_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    docs = docs + [(5000, None, "en", "s"), (5001, "", "fr", None), (5002, "idiot " * 20_000, None, "s"), (None, "idiot trash", "en", "s"), (1, docs[1][1], "en", "s")]
    frame = spark.createDataFrame([(*d, "clash", 0.5) for d in docs], "doc_id long, text string, lang string, source string, predicted string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (7, None), (0, 0)], "doc_id long, toxic int")
    got = score_toxicity(frame, lab)
    assert got.columns == ["doc_id", "text", "lang", "source", "score", "predicted", "held_out"]
    rows = got.collect()
    assert len(rows) == len(docs)
    truth = dict(labels)
    scored = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    pos, neg = [s for s, t in scored if t], [s for s, t in scored if not t]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.99 and 0.15 < len(scored) / len(truth) < 0.35
    assert np.mean([(s >= 0.3) == t for s, t in scored]) > 0.95
    by = {r["doc_id"]: r for r in rows}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert by[5000]["score"] == by[5001]["score"] < 0.3 and by[5002]["score"] > 0.3 and by[None]["held_out"] is False


def test_held_out_labels_do_not_matter(spark, labelled):
    docs, labels = labelled
    frame = spark.createDataFrame(docs[:300], "doc_id long, text string, lang string, source string")
    lab = spark.createDataFrame(labels[:300], "doc_id long, toxic int")
    flipped = lab.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = (sorted((r["doc_id"], r["score"]) for r in score_toxicity(frame, x).collect()) for x in (lab, flipped))
    assert a == b


def test_labels_of_one_kind_or_none(spark, labelled):
    docs, _ = labelled
    frame = spark.createDataFrame(docs[:40], "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in score_toxicity(frame, none).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, toxic int")
    assert {r["score"] for r in score_toxicity(frame, ones).collect()} == {1.0}
    assert score_toxicity(frame.limit(0), ones).count() == 0


def test_the_sample_is_bounded(spark, labelled):
    docs, labels = labelled
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    model = train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), max_labelled=100)
    assert model.trees is not None and 0 < model.rate < 1
