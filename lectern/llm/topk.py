"""Exact top-k by integer inner product, norm-sorted, with Cauchy-Schwarz pruning.

Vectors are dealt into blocks by descending length (ties by a hash, so that equal vectors spread
over blocks). A rotation from the singular vectors of the whole table concentrates length in the
first coordinates. Queries meet the block of the longest vectors first, which gives each a
threshold; then they meet all other blocks. Inside a block, runs of vectors in descending length
are bounded for a chunk of queries at a time: first by the product of lengths, then by the
partial sum over the first rotated coordinates plus the product of the residual lengths, then by
a longer partial sum. Only pairs whose bound reaches the query's threshold are multiplied out, in
integers. Bounds carry a margin for rounding, so no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored

MARGIN = 1e-9


def quantized(vectors: DataFrame, row_id: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, v, dim): floor(scale * x) of every component; vectors with null or non-finite ones are left out."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col(f"`{row_id}`").isNotNull() & v.isNotNull() & finite).select(
        F.col(f"`{row_id}`").cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"),
        F.size(v).alias("dim"),
    )


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the right singular vectors of all its rows, as columns, strongest first.

    Tasks sum outer products; only dim * dim numbers for each dimension reach the driver.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            v = batch.column(0)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(dims) - dims
            for d in np.unique(dims[dims > 0]):
                x = flat[starts[dims == d][:, None] + np.arange(d)]
                sums[int(d)] = sums.get(int(d), 0) + x.T @ x
        for d, m in sums.items():
            cells = pa.array(np.arange(d * d), type=pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), type=pa.int32()), cells, pa.array(m.ravel())], ["dim", "cell", "s"])

    cells = vectors.select("v", "dim").mapInArrow(moments, "dim int, cell int, s double").groupBy("dim", "cell").agg(F.sum("s").alias("s"))
    out = {}
    for d, group in cells.toPandas().groupby("dim"):
        m = np.zeros(d * d)
        m[group["cell"].to_numpy()] = group["s"].to_numpy()
        m = m.reshape(d, d)
        out[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return out


def scan(
    x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, floor: np.ndarray, rotation: np.ndarray, k: int, run: int = 1024, chunk: int = 256
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` pairs (row of q, id, score) of every query with one block, leaving out those
    below ``floor`` (the query's threshold so far) and the query's own id."""
    d = x.shape[1]
    exact = np.float64 if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * d < 2**52 else np.int64
    length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -length))
    x, ids, length = x[order].astype(exact), ids[order], length[order]
    y = x.astype(np.float64) @ rotation
    cuts = sorted({max(1, d // 4), max(1, d // 2)})
    rest = [np.sqrt((y[:, c:] ** 2).sum(axis=1)) for c in cuts]
    out_q, out_id, out_s = [], [], []
    for a in range(0, len(q), chunk):
        t = q[a : a + chunk].astype(exact)
        z = t.astype(np.float64) @ rotation
        t_length = np.sqrt((z * z).sum(axis=1))
        t_rest = [np.sqrt((z[:, c:] ** 2).sum(axis=1)) for c in cuts]
        least = floor[a : a + chunk].astype(np.float64)
        best_q, best_id, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, exact)
        for b in range(0, len(x), run):
            e = min(b + run, len(x))
            margin = MARGIN * t_length * length[b] + 1e-6
            open_ = np.flatnonzero(t_length * length[b] >= least - margin)
            if not len(open_):
                break  # lengths only fall
            need = (least - margin)[open_]
            bound = z[open_, : cuts[0]] @ y[b:e, : cuts[0]].T + np.outer(t_rest[0][open_], rest[0][b:e])
            r, c = np.nonzero(bound >= need[:, None])
            for n, cut in enumerate(cuts[1:], 1):
                if 4 * len(r) < bound.size:
                    part = np.einsum("ij,ij->i", z[open_[r], :cut], y[b + c, :cut])
                    keep = part + t_rest[n][open_[r]] * rest[n][b + c] >= need[r]
                    r, c = r[keep], c[keep]
            if 4 * len(r) < bound.size:
                s = np.einsum("ij,ij->i", t[open_[r]], x[b + c])
            else:
                s = (t[open_] @ x[b:e].T)[r, c]
            r = open_[r]
            keep = (s >= least[r]) & (ids[b + c] != own[a + r])
            best_q = np.concatenate([best_q, r[keep]])
            best_id = np.concatenate([best_id, ids[b + c[keep]]])
            best_s = np.concatenate([best_s, s[keep]])
            by = np.lexsort((best_id, -best_s, best_q))
            best_q, best_id, best_s = best_q[by], best_id[by], best_s[by]
            new = np.concatenate([[True], (best_q[1:] != best_q[:-1]) | (best_id[1:] != best_id[:-1]) | (best_s[1:] != best_s[:-1])]) if len(best_q) else np.zeros(0, bool)
            best_q, best_id, best_s = best_q[new], best_id[new], best_s[new]
            count = np.bincount(best_q, minlength=len(t))
            rank = np.arange(len(best_q)) - np.repeat(np.cumsum(count) - count, count)
            best_q, best_id, best_s = best_q[rank < k], best_id[rank < k], best_s[rank < k]
            last = rank[rank < k] == k - 1
            least[best_q[last]] = np.maximum(least[best_q[last]], best_s[last].astype(np.float64))
        out_q.append(best_q + a), out_id.append(best_id), out_s.append(best_s.astype(np.int64))
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def top_k(
    vectors: DataFrame,
    query_filter: str,
    k: int = 5,
    scale: float = 256.0,
    row_id: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = 16_384,
) -> DataFrame:
    """The ``k`` largest integer inner products of every query with all rows: query_id, rank, vec_id, score.

    Components are floor(``scale`` * x). Queries are the rows that satisfy ``query_filter`` (on
    vec_id); candidates are the rows of other ids. Ties go to the smaller id. Null vectors, vectors
    with null or non-finite components and rows of null id take no part; zero vectors do. Only
    vectors of equal dimension are compared. Rows repeated with the same id and score count once.
    With fewer than ``k`` candidates all are returned. Empty input: no rows. Scores must fit 64 bits.
    """
    slim, _ = stored(quantized(vectors, row_id, vector, scale), "topk-vectors")
    turned = rotations(slim)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    blocks = max(1, math.ceil(slim.count() / block_rows))
    dealt, _ = stored(
        slim.withColumn("_l", square)
        .repartitionByRange(blocks, F.col("dim"), F.desc("_l"), F.xxhash64("vec_id"))
        .withColumn("block", F.spark_partition_id())
        .drop("_l"),
        "topk-blocks",
    )
    # one row for each block and dimension
    heads, _ = stored(dealt.groupBy("dim").agg(F.min("block").alias("head"), F.max("block").alias("tail")), "topk-heads")
    queries = slim.where(query_filter).dropDuplicates(["vec_id", "v"]).withColumnsRenamed({"vec_id": "query_id"}).withColumn("qkey", F.xxhash64("v"))
    queries = queries.join(heads, "dim")

    def meet(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        q, i, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(held) and len(asked):
            d = int(held["dim"].iloc[0])
            x = np.stack(held["v"].to_numpy()).astype(np.int64).reshape(len(held), d)
            t = np.stack(asked["v"].to_numpy()).astype(np.int64).reshape(len(asked), d)
            rotation = turned.get(d, np.zeros((0, 0)))
            q, i, s = scan(x, held["vec_id"].to_numpy(), t, asked["query_id"].to_numpy(), asked["floor"].to_numpy(), rotation, k)
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy()[q], "qkey": asked["qkey"].to_numpy()[q], "vec_id": i, "score": s})

    schema = "query_id long, qkey long, vec_id long, score long"
    lowest = float("-inf")
    first = queries.withColumns({"block": F.col("head"), "floor": F.lit(lowest)}).drop("head", "tail")
    of_head = dealt.join(heads.select("dim", F.col("head").alias("block")), ["dim", "block"], "left_semi")
    found, _ = stored(of_head.groupBy("dim", "block").cogroup(first.groupBy("dim", "block")).applyInPandas(meet, schema), "topk-first")
    reached = found.groupBy("query_id", "qkey").agg(F.count("*").alias("n"), F.min("score").alias("m"))
    reached = reached.select("query_id", "qkey", F.when(F.col("n") >= k, F.col("m").cast("double")).otherwise(F.lit(lowest)).alias("floor"))
    onward = (
        queries.join(reached, ["query_id", "qkey"], "left")
        .fillna({"floor": lowest})
        .where("tail > head")
        .withColumn("block", F.explode(F.sequence(F.col("head") + 1, F.col("tail"))))
        .drop("head", "tail")
    )
    of_rest = dealt.join(heads.select("dim", F.col("head").alias("block")), ["dim", "block"], "left_anti")
    others = of_rest.groupBy("dim", "block").cogroup(onward.groupBy("dim", "block")).applyInPandas(meet, schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id"))
    both = found.unionByName(others).dropDuplicates()
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
