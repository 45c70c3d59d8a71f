"""Approximate nearest neighbours with robust-pruned directed graphs, one for each shard.

Vectors are spread over shards by the hash of their id. A shard's graph grows in blocks: a greedy
beam search from the entry point proposes neighbours for every vector of a block, and a pruning
with relaxed distances keeps diverse ones (a candidate goes if a kept one is ``alpha`` times
nearer to it than the vector is). Kept edges are also added backwards, and a vector with too many
is pruned again. A query is answered by a beam search in every shard; the best of all shards,
scored again in double precision, are the result.

Largest inner products become smallest distances by one more component that gives all vectors
of a shard the same length. Equal vectors are one vertex; their ids are listed with it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored


def beam_search(
    vectors: np.ndarray, edges: np.ndarray, entry: int, targets: np.ndarray, beam: int, visited: bool = False
) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Lock-step search for a block of ``targets``: the ``beam`` vertices of largest inner product
    found (place, score; best first, -1 where there are fewer) and, on demand, all expanded ones
    as (rows of the block, places)."""
    rows, n = len(targets), len(vectors)
    place = np.full((rows, beam), -1, dtype=np.int32)
    score = np.full((rows, beam), -np.inf, dtype=np.float32)
    spent = np.ones((rows, beam), dtype=bool)
    seen = np.zeros((rows, n), dtype=bool)
    place[:, 0], score[:, 0], spent[:, 0], seen[:, entry] = entry, targets @ vectors[entry], False, True
    active, trail = np.arange(rows), []
    while True:
        waiting = ~spent[active]
        more = waiting.any(axis=1)
        active = active[more]
        if not len(active):
            return place, score, trail
        at = waiting[more].argmax(axis=1)
        spent[active, at] = True
        here = place[active, at]
        if visited:
            trail.append((active, here))
        near = edges[here]
        fresh = near >= 0
        near = np.where(fresh, near, 0)
        fresh &= ~seen[active[:, None], near]
        r, c = np.nonzero(fresh)
        found = near[r, c]
        seen[active[r], found] = True
        got = np.full(near.shape, -np.inf, dtype=np.float32)
        got[r, c] = np.einsum("ij,ij->i", vectors[found], targets[active[r]])
        places = np.concatenate([place[active], near], axis=1)
        scores = np.concatenate([score[active], got], axis=1)
        done = np.concatenate([spent[active], ~fresh], axis=1)
        best = np.argpartition(-scores, beam - 1, axis=1)[:, :beam]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(scores, best, 1), axis=1, kind="stable"), 1)
        place[active] = np.take_along_axis(places, best, 1)
        score[active] = s = np.take_along_axis(scores, best, 1)
        spent[active] = np.take_along_axis(done, best, 1) | np.isneginf(s)


def robust_prune(vectors: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours for each of ``own`` out of its row of ``candidates``
    (-1: none; distinct in a row)."""
    valid = (candidates >= 0) & (candidates != own[:, None])
    near = np.where(valid, candidates, 0)
    v = vectors[near]
    distance = ((v - vectors[own][:, None]) ** 2).sum(-1)
    distance[~valid] = np.inf
    order = np.argsort(distance, axis=1, kind="stable")
    near, distance = np.take_along_axis(near, order, 1), np.take_along_axis(distance, order, 1)
    v = np.take_along_axis(v, order[:, :, None], 1)
    square = (v * v).sum(-1)
    apart = square[:, :, None] + square[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    alive, rows = np.isfinite(distance), np.arange(len(own))
    kept = np.full((len(own), degree), -1, dtype=np.int32)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        j = alive.argmax(axis=1)
        kept[some, k] = near[some, j[some]]
        alive[rows, j] = False
        alive &= (alpha * alpha * apart[rows, j] > distance) | ~some[:, None]
    return kept


def build_graph(vectors: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2, block: int = 256, seed: int = 7) -> tuple[np.ndarray, int]:
    """(edges, entry point) of a graph over distinct ``vectors`` of equal length."""
    n = len(vectors)
    entry = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
    slack = 2 * degree
    edges = np.full((n, slack), -1, dtype=np.int32)
    count = np.zeros(n, dtype=np.int64)
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != entry]
    start, size = 0, 1
    while start < len(order):
        own = order[start : start + size]
        _, _, trail = beam_search(vectors, edges, entry, vectors[own], beam, visited=True)
        row = np.concatenate([r for r, _ in trail])
        seen = np.concatenate([p for _, p in trail])
        width = np.bincount(row, minlength=len(own))
        by = np.argsort(row, kind="stable")
        candidates = np.full((len(own), int(width.max())), -1, dtype=np.int32)
        candidates[row[by], np.arange(len(row)) - np.repeat(np.cumsum(width) - width, width)] = seen[by]
        kept = robust_prune(vectors, own, candidates, degree, alpha)
        edges[own, :degree] = kept
        count[own] = (kept >= 0).sum(axis=1)
        # the same edges backwards
        r, c = np.nonzero(kept >= 0)
        to, back = kept[r, c], own[r]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        hosts, first, extra = np.unique(to, return_index=True, return_counts=True)
        fits = count[hosts] + extra <= slack
        rank = np.arange(len(to)) - np.repeat(first, extra)
        ok = np.repeat(fits, extra)
        edges[to[ok], (count[to] + rank)[ok]] = back[ok]
        count[hosts[fits]] += extra[fits]
        for h, a, k in zip(hosts[~fits], first[~fits], extra[~fits], strict=True):
            pool = np.concatenate([edges[h, : count[h]], back[a : a + k]])
            keep = robust_prune(vectors, np.array([h]), pool[None], degree, alpha)[0]
            keep = keep[keep >= 0]
            edges[h] = -1
            edges[h, : len(keep)] = keep
            count[h] = len(keep)
        start, size = start + len(own), min(block, size * 2)
    return edges, entry


def _levelled(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component, so that all have the length of the longest."""
    square = (vectors.astype(np.float64) ** 2).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(0.0, square.max() - square))[:, None]], axis=1).astype(np.float32)


def usable(vectors: DataFrame, row_id: str, vector: str) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part: id not null, components all finite, one not zero."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where(F.col(f"`{row_id}`").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return kept.select(F.col(f"`{row_id}`").cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


_INDEX = "dim int, shard long, place int, entry int, vector binary, edges binary, ids binary"


def build_index(vectors: DataFrame, shard_rows: int = 16_384, degree: int = 32, beam: int = 64, alpha: float = 1.2) -> tuple[DataFrame, int]:
    """A table with a row for each vertex of each shard's graph, and the number of shards."""
    shards = max(1, math.ceil(vectors.count() / shard_rows))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        x = np.stack(group["v"].to_numpy())
        ids = group["vec_id"].to_numpy()
        distinct, vertex = np.unique(x, axis=0, return_inverse=True)
        by = np.argsort(vertex, kind="stable")
        owned = np.split(ids[by], np.cumsum(np.bincount(vertex))[:-1])
        edges, entry = build_graph(_levelled(distinct), degree, beam, alpha)
        return pd.DataFrame(
            {
                "dim": key[0], "shard": key[1], "place": np.arange(len(distinct)), "entry": entry,
                "vector": [d.tobytes() for d in distinct], "edges": [e[e >= 0].tobytes() for e in edges],
                "ids": [np.unique(o).tobytes() for o in owned],
            }
        )

    spread = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return stored(spread.groupBy("dim", "shard").applyInPandas(build, _INDEX), "graph")[0], shards


def nearest(
    vectors: DataFrame,
    query_filter: str,
    k: int = 20,
    row_id: str = "vec_id",
    vector: str = "embedding",
    beam: int = 128,
    block: int = 256,
    **index_options: float,
) -> DataFrame:
    """The ``k`` vectors of largest inner product found for every query: query_id, rank, vec_id, score.

    Queries are the rows that satisfy ``query_filter`` (on vec_id); candidates are all rows of
    other ids. Scores are inner products of the original vectors in double precision, ties go to
    the smaller id. Vectors that are null, zero or hold null or non-finite components, and rows
    of null id, take no part; only vectors of equal dimension are compared. Rows repeated with
    the same id and vector count once; of two vectors under one id each asks by itself. With fewer
    than ``k`` candidates all are returned. Other columns, whatever their names, play no part. Empty
    input: no rows.
    """
    took = usable(vectors, row_id, vector)
    index, shards = build_index(took, **index_options)  # type: ignore[arg-type]
    queries = took.where(query_filter).dropDuplicates(["vec_id", "v"]).withColumnRenamed("vec_id", "query_id").withColumn("qkey", F.xxhash64("v"))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", F.col("shard").cast("long"))

    def search(graph: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(graph) and len(some):
            graph = graph.sort_values("place")
            x = np.stack([np.frombuffer(b, dtype=np.float64) for b in graph["vector"]])
            own = [np.frombuffer(b, dtype=np.int32) for b in graph["edges"]]
            edges = np.full((len(x), max(1, max(map(len, own)))), -1, dtype=np.int32)
            for i, e in enumerate(own):
                edges[i, : len(e)] = e
            ids = [np.frombuffer(b, dtype=np.int64) for b in graph["ids"]]
            copies = np.array(list(map(len, ids)))
            entry = int(graph["entry"].iloc[0])
            small = x.astype(np.float32)
            asked_by, keys, targets = some["query_id"].to_numpy(), some["qkey"].to_numpy(), np.stack(some["v"].to_numpy())
            for a in range(0, len(some), block):
                t = targets[a : a + block]
                place, _, _ = beam_search(small, edges, entry, t.astype(np.float32), max(beam, k + 1))
                q, c = np.nonzero(place >= 0)
                at = place[q, c]
                score = (x[at] * t[q]).sum(axis=1)
                # only copies that can be among the first k of their vector, by id
                take = np.minimum(copies[at], k + 1)
                rows = pd.DataFrame({
                    "query_id": np.repeat(asked_by[a + q], take),
                    "qkey": np.repeat(keys[a + q], take),
                    "vec_id": np.concatenate([ids[p][: k + 1] for p in at]) if len(at) else np.zeros(0, np.int64),
                    "score": np.repeat(score, take),
                    "q": np.repeat(q, take),
                })
                rows = rows[rows["vec_id"] != rows["query_id"]].sort_values(["q", "score", "vec_id"], ascending=[True, False, True])
                out.append(rows.groupby("q").head(k)[["query_id", "qkey", "vec_id", "score"]])
        none = pd.DataFrame({"query_id": [], "qkey": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "qkey": "int64", "vec_id": "int64"})
        return pd.concat(out) if out else none

    found = index.groupBy("dim", "shard").cogroup(asked.groupBy("dim", "shard")).applyInPandas(search, "query_id long, qkey long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
