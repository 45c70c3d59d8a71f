"""Mixing sources to target weights by subset-sum budget fitting.

1. Each source gets a target number of words: a share of the budget by weight, capped at
   ``max_repeat`` times its size, with the excess shared again by weight until no source is
   above its cap (the level at which the capped and the open sources use up the budget).
2. For every source, documents are counted by exact length. The whole part of target / size is
   taken as full passes over the source. The rest of the budget is first spread evenly over the
   length counts; what then remains is filled by a bounded-knapsack dynamic program over the counts
   left. Where that leaves a gap, the spread gives back words, twice as many each time up to
   ``window``, and the program runs again. So the sum is the largest reachable one for a budget of
   at most ``window`` words, and for larger ones the largest with all but the last ``window`` spread.
3. Of the documents of one length, the seeded hash of their id decides which are in the chosen
   number. Groups of many equal lengths are cut into buckets by that hash, so that no task
   ranks more than about ``bucket_rows`` rows, however many documents share a length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take, so that their sum is as near ``budget`` as it gets
    and not above it: ``0 <= take <= counts``. Lengths are positive and distinct. The sum is the
    largest that can be reached if ``budget`` is at most ``window``."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return counts.copy()
    spread = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    rest = budget - int((spread * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= window:
            break
        more = min(int(counts[i] - spread[i]), (rest - window) // int(lengths[i]))
        spread[i] += more
        rest -= more * int(lengths[i])
    best, gap = spread, rest + 1
    back = 0
    while True:
        # the spread gives back at least ``back`` words, or all it has, evenly over the lengths
        held = int((spread * lengths).sum())
        given = np.array([-(-int(t) * min(back, held) // held) if held else 0 for t in spread], dtype=np.int64)
        base = spread - given
        room = budget - int((base * lengths).sum())
        filled, missed = _fill(lengths, counts - base, room)
        if missed < gap:
            best, gap = base + filled, missed
        if not gap or back >= min(window, held):
            return best
        back = min(max(1024, 2 * back), window)


def _fill(lengths: np.ndarray, left: np.ndarray, room: int) -> tuple[np.ndarray, int]:
    """The bounded-knapsack program: (copies of each length whose sum is the largest up to ``room``, what it misses)."""
    take = np.zeros(len(lengths), dtype=np.int64)
    # items (index, copies): the left copies of each length in powers of two
    reach = np.zeros(room + 1, dtype=bool)
    reach[0] = True
    first = np.full(room + 1, -1, dtype=np.int64)
    items: list[tuple[int, int]] = []
    for i in np.argsort(lengths, kind="stable"):
        size = int(lengths[i])
        copies, step = min(int(left[i]), room // size), 1
        while copies > 0 and not reach[room]:
            k = min(step, copies)
            w = k * size
            new = reach[: room + 1 - w] & ~reach[w:]
            first[w:][new] = len(items)
            reach[w:] |= new
            items.append((int(i), k))
            copies, step = copies - k, step * 2
        if reach[room]:
            break
    at = best = int(np.flatnonzero(reach)[-1])
    while at:
        i, k = items[first[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take, room - best


def mix_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source.

    Weights repeat over the sources in the order of their names (by code point, null last).
    """
    k = len(weights)
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(named) - 1, F.lit(k)) + 1).cast("int"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("_w", weight)
        .withColumn("_cap", (F.col("source_size") * max_repeat).cast("double"))
        .withColumn("_budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
        # In the order of cap / weight the capped sources come first. The first open source sets the
        # level; taking an open source for capped lowers it, so it is the largest among the open.
        .withColumn("_open", F.max(F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.col("_level"))).over(whole))
    )
    target = F.when(F.col("_open").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_open") * F.col("_w")))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_repeat: int = 2,
    seed: int = 42,
    text: str = "text",
    source: str = "source",
    row_id: str = "doc_id",
    bucket_rows: int = 256,
    window: int = 1 << 16,
) -> DataFrame:
    """How many words the mix takes of every document.

    One row per row of ``docs``: doc_id, text_hash (xxhash64), source, size (words), source_size, target (of its
    source), copies (0 to ``max_repeat``) and taken = copies * size. The sum taken of a source
    is at most its target and as near it as ``fit_budget`` gets.

    Nulls: a null text has size 0; null is a source of its own, the last; null ids rank like any
    one value. Documents of size 0 are taken as often as the full passes say. Rows that agree
    in id, source and size are interchangeable; which of them are taken does not show. Very long
    texts are counted whole; other columns, whatever their names, play no part. Empty input: no rows. The outcome depends on the rows and the seed only, not on partitions.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    slim, _ = stored(docs.select(F.col(row_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.col(text)).alias("text_hash")), "mix-sizes")
    lengths, _ = stored(slim.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    targets = mix_targets(
        lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, max_repeat
    )

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        """Documents of each length that get a further copy, for one source."""
        target, total = float(group["target"].iloc[0]), int(group["source_size"].iloc[0])
        passes = min(max_repeat, int(target // total)) if total else 1
        take = np.zeros(len(group), dtype=np.int64)
        words = group["size"].to_numpy() > 0
        if total and passes < max_repeat:
            part = group[words].sort_values("size")
            fitted = fit_budget(part["size"].to_numpy(), part["n"].to_numpy(), int(target) - passes * total, window)
            take[np.flatnonzero(words)[np.argsort(group["size"].to_numpy()[words], kind="stable")]] = fitted
        return pd.DataFrame(
            {"source": group["source"], "size": group["size"], "n": group["n"], "source_size": total, "target": target, "passes": passes, "extra": take}
        )

    same = F.col("l.source").eqNullSafe(F.col("t.source"))
    planned, _ = stored(
        lengths.alias("l")
        .join(targets.alias("t"), same)
        .select("l.source", "l.size", "l.n", "t.source_size", "t.target")
        .groupBy("source")
        .applyInPandas(plan, "source string, size long, n long, source_size long, target double, passes int, extra long"),
        "mix-plan",
    )
    # Copies of one length that are all taken, or none, need no order; the others are ranked in buckets.
    seeded = F.xxhash64(F.col("doc_id"), F.lit(seed))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(bucket_rows))).cast("long")
    a, b = slim.alias("a"), planned.alias("b")
    joined = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))).select(
        "a.doc_id", "a.text_hash", "a.source", "a.size", "b.source_size", "b.target", "b.passes", "b.extra", "b.n"
    )
    placed, _ = stored(
        joined.withColumn("_h", seeded).withColumn(
            "_bucket", F.when(F.col("extra").between(F.lit(1), F.col("n") - 1), F.pmod(F.shiftrightunsigned("_h", 8), buckets))
        ),
        "mix-placed",
    )
    keys = ["source", "size", "_bucket"]
    in_order = Window.partitionBy("source", "size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = (
        placed.where(F.col("_bucket").isNotNull())
        .groupBy(*keys)
        .agg(F.count("*").alias("_rows"), F.first("extra").alias("_extra"))
        .withColumn("_quota", F.greatest(F.lit(0), F.least(F.col("_rows"), F.col("_extra") - F.coalesce(F.sum("_rows").over(in_order), F.lit(0)))))
        .withColumnRenamed("source", "_s")
        .withColumnRenamed("size", "_z")
        .withColumnRenamed("_bucket", "_b")
    )
    same_bucket = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_bucket") == F.col("_b"))
    cut = placed.where(F.col("_bucket").isNotNull()).join(quota, same_bucket)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id", "text_hash"))
    out = ["doc_id", "text_hash", "source", "size", "source_size", "target"]
    chosen = cut.withColumn("copies", F.col("passes") + (rank <= F.col("_quota")).cast("int")).select(*out, "copies")
    whole = placed.where(F.col("_bucket").isNull()).withColumn("copies", F.col("passes") + (F.col("extra") > 0).cast("int")).select(*out, "copies")
    return whole.unionByName(chosen).withColumn("taken", F.col("copies") * F.col("size"))
