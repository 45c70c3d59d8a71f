"""N-gram Jaccard join by chosen paths.

Every distinct shingle set is embedded as ``coordinates`` min-hashes. A run starts with all sets in
one node. A node samples coordinates (1 / threshold on average, the same for all its sets) and
sends each set to the child named by its min-hash there, so similar sets tend to go on together
and unrelated ones part. Nodes of one set vanish; small nodes are compared by brute force; large
ones are split again, down to ``depth`` levels, and what is then still large is compared in
blocks, so no task holds more than two blocks. Runs repeat until a pair at the threshold is
found with the target recall.

Comparing has two steps: min-hashes rule out pairs far below the threshold, then shingle sets
made from the whole texts decide exactly. A pair that meets in several nodes counts in the least
one only, so links are counted without listing pairs, and every node gives its clusters as one
edge for each set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored
from lectern.llm.components import components
from lectern.llm.shingles import MinHasher, mix, set_overlaps, set_signature, shingle_set

_SETS = "doc_id long, key long, text_hash long, sig binary, n long, mh binary, nodes array<long>"


def children(nodes: np.ndarray, hashes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``nodes``, child) for sets with ``hashes`` (a row each) in ``nodes`` (64-bit names)."""
    spread = mix(nodes.astype(np.uint64))
    extra = 1 / threshold - 1
    out_at, out_child = [], []
    for j in range(1 + math.ceil(extra)):
        share = 1.0 if j == 0 else min(1.0, extra - (j - 1))
        taken = np.flatnonzero((mix(spread + np.uint64(7 * j + 3)) >> np.uint64(11)).astype(np.float64) < share * 2.0**53)
        at = (mix(spread[taken] + np.uint64(101 * j + 17)) % np.uint64(hashes.shape[1])).astype(np.int64)
        value = hashes[taken, at].astype(np.uint64)
        out_at.append(taken)
        out_child.append(mix(mix(spread[taken] ^ (value << np.uint64(8))) + at.astype(np.uint64) + np.uint64(j << 20)))
    return np.concatenate(out_at), np.concatenate(out_child).view(np.int64)


def runs_for(threshold: float, depth: int, recall: float) -> int:
    """Runs after which a pair at the threshold has met at ``depth`` with probability ``recall``."""
    extra = 1 / threshold - 1
    meet = 1.0
    for _ in range(depth):
        part = 1 - threshold * meet
        lost = part ** (1 + math.floor(extra))
        lost *= 1 - (extra % 1) * (1 - part)
        meet = 1 - lost
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _sets(docs: DataFrame, text: str, row_id: str, words: int, coordinates: int, threshold: float, runs: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(coordinates)
        roots = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                sig, n, mh, nodes = [], [], [], []
                for t in some.column(3).to_pylist():
                    x = shingle_set(t or "", words)
                    h = hasher(x)
                    sig.append(set_signature(x)), n.append(len(x)), mh.append(h.tobytes())
                    nodes.append(children(roots, np.broadcast_to(h, (runs, coordinates)), threshold)[1] if len(x) else [])
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[:3], pa.array(sig, pa.binary()), pa.array(n, pa.int64()), pa.array(mh, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                    ["doc_id", "key", "text_hash", "sig", "n", "mh", "nodes"],
                )

    named = docs.select(F.col(row_id).cast("long").alias("doc_id"), _key(row_id, text).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text))
    return named.mapInArrow(read, _SETS)


def _key(row_id: str, text: str) -> F.Column:
    """What a text is fetched by: the row's id, or its text's hash where that is null."""
    return F.coalesce(F.col(row_id).cast("long"), F.xxhash64(F.col(text)))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first ``keys`` columns, from sorted batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[-1][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _candidates(rows: list[tuple], coordinates: int, least: float) -> np.ndarray:
    """Pairs (i, j) of one cell whose min-hashes agree well enough and that meet in no lesser node.

    A row is (node, c1, c2, block, sig, mh, nodes of the set, ...).
    """
    node, c1, c2 = rows[0][:3]
    n = len(rows)
    if n < 2:
        return np.zeros((0, 2), dtype=np.int64)
    h = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint32).reshape(n, coordinates)
    block = np.array([r[3] for r in rows])
    lesser = [[x for x in r[6] if x < node] for r in rows]
    names = sorted({x for xs in lesser for x in xs})
    place = {x: i for i, x in enumerate(names)}
    inside = np.zeros((n, max(1, len(names))), dtype=np.float32)
    for i, xs in enumerate(lesser):
        inside[i, [place[x] for x in xs]] = 1
    out = []
    for a in range(0, n, 256):
        near = np.zeros((min(256, n - a), n), dtype=np.int32)
        for c in range(coordinates):
            near += h[a : a + 256, c, None] == h[None, :, c]
        i, j = np.nonzero((near >= least * coordinates) & (inside[a : a + 256] @ inside.T == 0))
        i += a
        ok = i < j if c1 == c2 else (block[i] == c1) & (block[j] == c2)
        out.append(np.stack([i[ok], j[ok]], axis=1))
    return np.concatenate(out)


def jaccard_join(
    docs: DataFrame,
    threshold: float = 0.8,
    words: int = 5,
    recall: float = 0.999,
    depth: int = 4,
    coordinates: int = 128,
    leaf_rows: int = 64,
    block_rows: int = 1024,
    broadcast_rows: int = 1_000_000,
    text: str = "text",
    row_id: str = "doc_id",
) -> DataFrame:
    """Near-duplicate classes and links of whole texts.

    One row per row of ``docs``: doc_id; text_hash (xxhash64); class_id (the least doc_id among all rows that links
    connect); copy_of (the least doc_id of the rows with the same shingle set); copies (how many
    rows those are); links (how many different shingle sets have a Jaccard similarity of at least
    ``threshold`` with this one); class_sig (the signature of one set of the class, the same for all
    its rows; null without shingles). Similarities are exact; a pair at the threshold is found with
    probability ``recall``, higher ones with more.

    A text of fewer words than a shingle has one shingle of all its words. Null, empty and blank
    texts have none: they link to nothing and are their own class, even if repeated. Rows of null
    id take part; a class of null ids only has a null class_id. Empty input: no rows.
    """
    spark = docs.sparkSession
    runs = runs_for(threshold, depth, recall)
    sets, _ = stored(_sets(docs, text, row_id, words, coordinates, threshold, runs), "jaccard-sets")
    classes, _ = stored(
        sets.where("n > 0")
        .groupBy("sig")
        .agg(F.min("doc_id").alias("copy_of"), F.min("key").alias("key"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("mh", "nodes")]),
        "jaccard-classes",
    )
    leaves = _leaves(classes, threshold, depth, coordinates, leaf_rows)
    # least agreement of min-hashes for a pair at the threshold, four deviations below
    least = threshold - 4 * math.sqrt(threshold * (1 - threshold) / coordinates)
    blocks = F.ceil(F.col("size") / F.lit(block_rows)).cast("int")
    cells = (
        leaves.withColumn("block", F.pmod(F.xxhash64("sig", "node"), blocks).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("node", F.least("block", "_other").alias("c1"), F.greatest("block", "_other").alias("c2"), "block", "sig")
    )
    met, _ = stored(leaves.groupBy("sig").agg(F.sort_array(F.collect_list("node")).alias("met")), "jaccard-met")
    known = classes.select("sig", "mh").join(met, "sig")
    keys = ["node", "c1", "c2"]

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            used = np.unique(_candidates(rows, coordinates, least))
            if len(used):
                kept = [rows[i] for i in used.tolist()]
                columns = [pa.array([r[c] for r in kept], t) for c, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()), (3, pa.int32()), (4, pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, [*keys, "block", "sig"])

    near, _ = stored(
        cells.join(known, "sig").select(*keys, "block", "sig", "mh", "met").repartition(*keys).sortWithinPartitions(*keys, "sig")
        .mapInArrow(estimate, "node long, c1 int, c2 int, block int, sig binary"),
        "jaccard-near",
    )
    wanted, _ = stored(near.select("sig").distinct().join(classes.select("sig", "key"), "sig"), "jaccard-wanted")
    wanted_keys = wanted.select("key").distinct()
    few = wanted_keys.count() <= broadcast_rows  # 8 bytes a row
    texts = docs.select(_key(row_id, text).alias("key"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    texts = texts.join(F.broadcast(wanted_keys) if few else wanted_keys, "key", "left_semi")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keep the texts that have the set they were fetched for; ids may repeat."""
        for batch in batches:
            right = [set_signature(shingle_set(t, words)) == s for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(right))

    fetched = wanted.join(texts, "key").select("sig", "text").mapInArrow(check, "sig binary, text string")
    bodies, _ = stored(fetched.groupBy("sig").agg(F.first("text").alias("text")), "jaccard-texts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            pairs = _candidates(rows, coordinates, least)
            if not len(pairs):
                continue
            own = {i: shingle_set(rows[i][7], words) for i in np.unique(pairs).tolist()}
            size = np.zeros(len(rows))
            for i, x in own.items():
                size[i] = len(x)
            links = np.zeros(len(rows), dtype=np.int64)
            root = np.arange(len(rows))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = int(root[i])
                return i

            for a in range(0, len(rows), 128):
                left = pairs[(pairs[:, 0] >= a) & (pairs[:, 0] < a + 128)]
                for b in range(a - a % 128, len(rows), 128) if len(left) else []:
                    some = left[(left[:, 1] >= b) & (left[:, 1] < b + 128)]
                    if not len(some):
                        continue
                    rows_i, at_i = np.unique(some[:, 0], return_inverse=True)
                    rows_j, at_j = np.unique(some[:, 1], return_inverse=True)
                    both = set_overlaps([own[i] for i in rows_i.tolist()], [own[j] for j in rows_j.tolist()])[at_i, at_j].astype(np.float64)
                    union = size[some[:, 0]] + size[some[:, 1]] - both
                    linked = some[both >= threshold * union - 1e-9]
                    np.add.at(links, linked.ravel(), 1)
                    for i, j in linked.tolist():
                        x, y = find(i), find(j)
                        root[max(x, y)] = min(x, y)
            used = np.flatnonzero(links)
            if len(used):
                columns = [pa.array([rows[i][4] for i in used], pa.binary()), pa.array(links[used]), pa.array([rows[find(i)][4] for i in used.tolist()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["sig", "links", "root"])

    linked, _ = stored(
        near.join(known, "sig").join(bodies, "sig").select(*keys, "block", "sig", "mh", "met", "text").repartition(*keys).sortWithinPartitions(*keys, "sig")
        .mapInArrow(verify, "sig binary, links long, root binary"),
        "jaccard-links",
    )
    roots = components(linked.where("sig <> root").select(F.col("sig").alias("a"), F.col("root").alias("b")))
    per_set = classes.select("sig", "copy_of", "copies").join(linked.groupBy("sig").agg(F.sum("links").alias("links")), "sig", "left")
    per_set, _ = stored(
        per_set.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select(
            "sig", "copy_of", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "sig").alias("root")
        ),
        "jaccard-per-set",
    )
    least_id = per_set.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    per_set = per_set.join(least_id, "root").withColumnRenamed("root", "class_sig")
    joined = sets.select("doc_id", "text_hash", F.when(F.col("n") > 0, F.col("sig")).alias("sig")).join(per_set, "sig", "left")
    return joined.select(
        "doc_id",
        "text_hash",
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("links", F.lit(0)).alias("links"),
        "class_sig",
    )


def _leaves(classes: DataFrame, threshold: float, depth: int, coordinates: int, leaf_rows: int) -> DataFrame:
    """(node, sig, size): the nodes of at least two sets that are compared by brute force."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy().view(np.uint64)
            h = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint32).reshape(-1, coordinates)
            at, child = children(nodes, h, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(child), batch.column(1).take(pa.array(at))], ["node", "sig"])

    live = classes.select(F.explode("nodes").alias("node"), "sig")
    leaves = None
    for level in range(1, depth + 1):
        live, _ = stored(live, "jaccard-live")
        sizes, _ = stored(live.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "jaccard-sizes")
        sized, _ = stored(live.join(sizes, "node"), "jaccard-sized")
        done = sized if level == depth else sized.where(F.col("size") <= leaf_rows)
        leaves = done if leaves is None else leaves.unionByName(done)
        large = sized.where(F.col("size") > leaf_rows)
        if level == depth or large.isEmpty():
            break
        live = large.join(classes.select("sig", "mh"), "sig").select("node", "sig", "mh").mapInArrow(split, "node long, sig binary")
    return leaves  # type: ignore[return-value]
