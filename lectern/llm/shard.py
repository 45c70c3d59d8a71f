"""Sharding by histogram sort.

Rows are ordered by a 64-bit key: 32 bits of the text's hash, then 32 bits of the row id's hash.
Splitters between shards are found by counting, never by sampling: every round counts the exact
bytes that lie between candidate boundaries in all partitions, and puts the next round's
candidates into the interval that must hold each splitter. When every splitter is within
tolerance (or between two adjacent keys), all rows are exchanged once.

Equal texts are neighbours in that order. A splitter stays off the middle of a group of equal
texts unless the group itself is too large for the tolerance, in which case the low half of the
key splits it.

Only counts reach the driver: (shards - 1) * probes numbers a round, whatever the input's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import drop, stored

TOP = (1 << 64) - 1
_COUNTS = "cell int, bytes long, n long"


def _key(text: str, row_id: str) -> F.Column:
    """The order of the rows, as a signed 64-bit number (hash of text, then hash of id)."""
    high = F.hash(F.xxhash64(F.col(text)), F.lit(17)).cast("long")
    low = F.hash(F.xxhash64(F.col(row_id)), F.lit(29)).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def _unsigned(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint64) ^ np.uint64(1 << 63)


def _counted(slim: DataFrame, bounds: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each of the sorted ``bounds``."""
    edges = np.array(bounds, dtype=np.uint64)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.zeros(len(edges) + 1, dtype=np.int64)
        rows = np.zeros(len(edges) + 1, dtype=np.int64)
        for batch in batches:
            keys = _unsigned(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            cell = np.searchsorted(edges, keys, side="right")
            np.add.at(size, cell, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64))
            rows += np.bincount(cell, minlength=len(rows))
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(size[used]), pa.array(rows[used])], ["cell", "bytes", "n"]
        )

    found = slim.select("key", "bytes").mapInArrow(cells, _COUNTS).groupBy("cell").agg(F.sum("bytes"), F.sum("n")).collect()
    size, rows = [0] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for cell, b, n in found:
        size[cell], rows[cell] = b, n
    below, before = [], []
    b = n = 0
    for i in range(len(bounds)):
        b, n = b + size[i], n + rows[i]
        below.append(b)
        before.append(n)
    return below, before


def find_splitters(slim: DataFrame, total: int, shards: int, tolerance: float, probes: int) -> list[int]:
    """Keys such that the bytes below the i-th are (i + 1) / shards of ``total``, as near as
    ``tolerance`` (a share of one shard's bytes) asks or as whole keys allow.

    A splitter k means: rows with key < k lie to its left.
    """
    want = [total * (i + 1) / shards for i in range(shards - 1)]
    slack = tolerance * total / shards
    low, high = [(0, 0)] * len(want), [(TOP, total)] * len(want)  # (key, bytes below it)
    done: list[int | None] = [None] * len(want)
    while None in done:
        tried: set[int] = set()
        open_intervals = {(low[i][0], high[i][0]) for i, state in enumerate(done) if state is None}
        for a, b in open_intervals:
            step = max(1, (b - a) // (probes // len(open_intervals) + 1))
            # Boundaries between groups of equal texts come first; a group is cut only when
            # nothing but the group is left in the interval.
            if (b - a) >> 32 >= 2:
                step = max(1, step >> 32) << 32
                first = ((a + step) >> 32) << 32
            else:
                first = a + step
            tried.update(k for k in range(first, b, step) if a < k)
        keys = sorted(tried)
        counts = _counted(slim, keys)[0] if keys else []
        for i, state in enumerate(done):
            if state is not None:
                continue
            for k, below in zip(keys, counts, strict=True):
                if low[i][0] < k < high[i][0]:
                    if below <= want[i]:
                        low[i] = (k, below)
                    else:
                        high[i] = (k, below)
                        break
            near = min(low[i], high[i], key=lambda x: (abs(x[1] - want[i]), x[0]))
            adjacent = high[i][0] - low[i][0] <= 1 or low[i][1] == high[i][1]
            if adjacent or (abs(near[1] - want[i]) <= slack):
                done[i] = near[0]
    return [int(k) for k in done]


def shard_documents(
    docs: DataFrame,
    shards: int = 24,
    text: str = "text",
    row_id: str = "doc_id",
    overhead: int = 8,
    tolerance: float = 0.005,
    probes: int = 4096,
    bytes_per_task: int = 64 << 20,
) -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes.

    Returns the columns of ``docs`` (clashing names of our own are replaced) and ``size``
    (UTF-8 bytes of the text, none for null, plus ``overhead``), ``shard`` (0 up) and ``slot``
    (its place in the shard, gapless from 0).

    Nulls: a null text has no bytes, a null id hashes like any one value. Empty input: no rows.
    Rows that agree in text and id are interchangeable; they stay together in one shard. A row
    is never cut, so with few rows shards are only as equal as whole rows allow. Order within a
    shard is the key's order; ties follow the id, then the text.
    """
    own = [c for c in docs.columns if c.lower() not in ("size", "shard", "slot")]
    sized = docs.select(*[F.col(f"`{c}`") for c in own]).withColumn(
        "size", F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(overhead)
    )
    slim, path = stored(sized.select(_key(text, row_id).alias("key"), F.col("size").alias("bytes")), "shard-keys")
    total, n = slim.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    splitters = find_splitters(slim, total, shards, tolerance, probes) if n else []
    # Within a shard, parts of about bytes_per_task are sorted by separate tasks; their row
    # counts give each part's first slot.
    parts = max(1, math.ceil(total / shards / bytes_per_task))
    edges = [0, *splitters, TOP]
    inner = sorted({a + (b - a) * j // parts for a, b in zip(edges, edges[1:], strict=False) for j in range(parts)} - {0} | set(splitters))
    before = _counted(slim, inner)[1] if inner else []
    drop(docs.sparkSession, path)
    bounds, starts = [0, *inner], [0, *before]
    shard_of = [sum(1 for s in splitters if s <= b) for b in bounds]
    first: dict[int, int] = {}
    for s, at in zip(shard_of, starts, strict=True):
        first.setdefault(s, at)
    places = np.array(bounds, dtype=np.uint64)

    @F.pandas_udf("int")
    def part_of(keys):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.Series((np.searchsorted(places, _unsigned(keys.to_numpy(np.int64)), side="right") - 1).astype(np.int32))

    lookup = docs.sparkSession.createDataFrame(
        [(i, s, starts[i] - first[s]) for i, s in enumerate(shard_of)], "_part int, shard int, _from long"
    )
    placed = sized.withColumn("_key", _key(text, row_id)).withColumn("_part", part_of("_key"))
    order = Window.partitionBy("_part").orderBy(F.col("_key"), F.col(row_id), F.col(text))
    ranked = placed.withColumn("_rank", F.row_number().over(order) - 1)
    # One row of 16 bytes for each part; the optimizer chooses the join by the table's size.
    return ranked.join(lookup, "_part").select(
        *[F.col(f"`{c}`") for c in own], "size", "shard", (F.col("_rank") + F.col("_from")).cast("long").alias("slot")
    )
