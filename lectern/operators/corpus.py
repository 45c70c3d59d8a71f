"""Counts, splits, weights and lengths of a merged corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(parts: list[DataFrame]) -> DataFrame:
    """Union in the order given, with that order and the rows' own kept as source_idx and row_idx."""
    tagged = [p.withColumn("source_idx", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged)


def domain_counts(rows: DataFrame, least: int = 0) -> DataFrame:
    """Rows of each domain and whether there are ``least`` at least."""
    return rows.groupBy("domain").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= least)


def seeded(*columns: str, seed: int = 42) -> Column:
    """A deterministic shuffle key that other engines can compute too."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def validation_size(n: Column, platform: bool) -> Column:
    """How many rows of a domain of n go to validation; halves round to even."""
    twentieth = F.bround(n * F.lit(0.05), 0).cast("long")
    half = F.floor(n / F.lit(2))
    if platform:
        return F.greatest(F.lit(1), F.least(F.greatest(F.least(F.lit(20), F.floor(n / F.lit(5))), twentieth), half))
    return F.least(F.greatest(F.lit(20), twentieth), half)


def stratified_split(rows: DataFrame, platform: bool = True, seed: int = 42) -> DataFrame:
    """Every row with ``part`` ('val' or 'train'), shuffled within its domain by a seeded hash."""
    w = Window.partitionBy("domain")
    place = F.row_number().over(w.orderBy(seeded("row_idx", seed=seed), "row_idx"))
    n = F.count("*").over(w)
    return rows.withColumn("part", F.when(place <= validation_size(n, platform), "val").otherwise("train"))


def domain_weights(rows: DataFrame) -> DataFrame:
    """Inverse-root weights: domain, n, weight, draws an epoch, and whether all weights are equal."""
    counts = rows.groupBy("domain").agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    weighted = counts.withColumn("weight", F.sqrt(F.max("n").over(everything) / F.col("n")))
    draws = F.bround(F.sum(F.col("weight") * F.col("n")).over(everything), 0).cast("long")
    return weighted.withColumn("draws", draws).withColumn("uniform", F.min("n").over(everything) == F.max("n").over(everything))


def weighted_draws(rows: DataFrame, draws: int, seed: int = 42, bucket_rows: int = 50_000) -> DataFrame:
    """Sampling with replacement by ``weight``: (draw, row_idx). Draw points are spread by a hash over
    the running sum of weights, and meet their row in an equi-join on whole units of weight. The sum
    runs inside hash buckets of bounded size; only the buckets' totals are summed in one place."""
    buckets = max(1, -(-rows.count() // bucket_rows))
    placed = rows.select("row_idx", "weight").withColumn("bucket", F.pmod(F.xxhash64("row_idx", F.lit(1)), F.lit(buckets)))
    w = Window.partitionBy("bucket").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("bucket").agg(F.sum("weight").alias("t"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("bucket", F.coalesce(F.sum("t").over(before), F.lit(0.0)).alias("base"))
    edges = placed.withColumn("part", F.sum("weight").over(w)).join(offsets, "bucket").withColumn("hi", F.col("base") + F.col("part"))
    edges = edges.withColumn("lo", F.col("hi") - F.col("weight"))
    total = totals.agg(F.sum("t")).first()[0] or 0.0
    points = rows.sparkSession.range(draws).select(
        F.col("id").alias("draw"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52)) * F.lit(total)).alias("x")
    ).withColumn("cell", F.floor("x"))
    cells = edges.withColumn("cell", F.explode(F.sequence(F.floor("lo"), F.floor("hi"))))
    return points.join(cells, "cell").where("x >= lo and x < hi").select("draw", "row_idx")


def length_stats(rows: DataFrame, length: str = "n_chars") -> DataFrame:
    """Per domain the elements at places floor(n * 0.5) and floor(n * 0.95) of the sorted lengths
    (counted from 0), and the largest. Rows are counted by length first, so a domain's task sees its
    different lengths and not its rows."""
    counts = rows.groupBy("domain", length).agg(F.count("*").alias("_c"))
    up = Window.partitionBy("domain").orderBy(length).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_up", F.sum("_c").over(up)).withColumn("_n", F.sum("_c").over(Window.partitionBy("domain")))
    at = lambda q: F.min(F.when(F.col("_up") > F.floor(F.col("_n") * F.lit(q)), F.col(length)))
    return counts.groupBy("domain").agg(F.max("_n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.max(length).alias("longest"))


def longest(rows: DataFrame, k: int, length: str = "n_chars") -> DataFrame:
    return rows.orderBy(F.desc(length), "row_idx").limit(k)


def first_per_domain(rows: DataFrame, column: str, most: int = 4) -> DataFrame:
    """The first value of each domain, and the domains in order of first appearance, at most ``most``."""
    firsts = rows.groupBy("domain").agg(F.min("row_idx").alias("first_idx"), F.min_by(column, "row_idx").alias(column))
    return firsts.orderBy("first_idx").limit(most)


def domains_by_size(rows: DataFrame) -> DataFrame:
    """Domains from the largest to the smallest; equals in order of first appearance."""
    counts = rows.groupBy("domain").agg(F.count("*").alias("n"), F.min("row_idx").alias("first_idx"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first_idx")))


def too_long_share(rows: DataFrame, most: int, length: str = "n_chars") -> DataFrame:
    long = F.sum((F.col(length) > most).cast("long"))
    return rows.agg(F.count("*").alias("n"), F.coalesce(long, F.lit(0)).alias("too_long")).withColumn(
        "warn", F.coalesce(F.col("too_long") / F.nullif(F.col("n"), F.lit(0)) > 0.05, F.lit(False))
    )


def stratified_pick(rows: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows: one of each domain (domains in seeded order), then others in seeded order; in row order."""
    first = F.row_number().over(Window.partitionBy("domain").orderBy(seeded("row_idx", seed=seed), "row_idx"))
    ranked = rows.withColumn("_first", first)
    order = [F.col("_first") > 1, F.when(F.col("_first") == 1, seeded("domain", seed=seed)).otherwise(seeded("row_idx", seed=seed)), "row_idx"]
    return ranked.orderBy(*order).limit(n).drop("_first").orderBy("row_idx")


def recent_sample(rows: DataFrame, tail: int = 200, k: int = 8, seed: int = 42) -> DataFrame:
    """At most ``k`` of the last ``tail`` rows of each domain, by seeded order."""
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("row_idx")))).where(F.col("_r") <= tail)
    place = F.row_number().over(Window.partitionBy("domain").orderBy(seeded("row_idx", seed=seed), "row_idx"))
    return last.withColumn("_p", place).where(F.col("_p") <= k).drop("_r", "_p")


def generation_stats(rows: DataFrame) -> DataFrame:
    """Per domain: accepted rows, skipped rows, whether too many are skipped and whether it is short."""
    s = rows.groupBy("domain").agg(
        F.sum(F.col("accepted").cast("long")).alias("rows"), F.sum((~F.col("accepted")).cast("long")).alias("skipped"), F.max("target").alias("target")
    )
    return s.withColumn("many_skipped", F.col("skipped") > 0.15 * F.greatest(F.lit(1), F.col("rows"))).withColumn("short", F.col("rows") < 0.5 * F.col("target"))


def round_robin(topics: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Topic of each of the first ``n`` items: topics in seeded order, shuffled anew for each pass.
    ``topics``: domain, topic."""
    per = topics.groupBy("domain").agg(F.count("*").alias("_t"))
    items = per.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("pass", F.floor(F.col("i") / F.col("_t"))).withColumn("slot", F.pmod("i", "_t"))
    passes = items.select("domain", "pass").distinct()
    order = F.md5(F.concat_ws(":", "topic", F.col("pass").cast("string"), F.lit(str(seed))))
    ranked = topics.join(passes, "domain").withColumn("slot", F.row_number().over(Window.partitionBy("domain", "pass").orderBy(order, "topic")) - 1)
    return items.join(ranked, ["domain", "pass", "slot"]).select("domain", "i", F.col("pass").cast("long").alias("pass"), "topic")


def stall_points(outcomes: DataFrame, limit: int) -> DataFrame:
    """Per domain the place of the ``limit``-th skip in a row, the first time it happens.
    ``outcomes``: domain, pos, accepted. Runs between accepts are islands."""
    w = Window.partitionBy("domain").orderBy("pos")
    island = F.sum(F.col("accepted").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    skips = outcomes.withColumn("_island", island).where(~F.col("accepted"))
    run = F.row_number().over(Window.partitionBy("domain", "_island").orderBy("pos"))
    return skips.withColumn("_run", run).where(F.col("_run") == limit).groupBy("domain").agg(F.min("pos").alias("stalled_at"))
