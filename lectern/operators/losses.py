"""Loss reports per domain and comparisons of several runs.

Losses may be NaN (an item was too long to score): such items count in N but not in means.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")
OVERALL = "OVERALL"
BASE_TOLERANCE = 1e-3


def mean_without_nan(c: str | Column) -> Column:
    """The mean of the values that are not NaN; NaN if there are none."""
    return F.coalesce(F.avg(F.nanvl(F.col(c) if isinstance(c, str) else c, F.lit(None).cast("double"))), F.lit(NAN))


def _report_row(grouped) -> DataFrame:  # type: ignore[no-untyped-def]
    return grouped.agg(F.count("domain_loss").alias("n"), mean_without_nan("base_loss").alias("base"), mean_without_nan("ft_loss").alias("ft"))


def loss_report(items: DataFrame, domains: DataFrame) -> DataFrame:
    """One row per domain of ``domains`` (domain, place) and OVERALL last: N, mean losses and their
    difference (6 places), perplexities of the means (4 places).

    ``items``: domain, base_loss, ft_loss. Domains without items have N 0 and NaN; items of other
    domains count in OVERALL only.
    """
    items = items.withColumn("domain_loss", F.lit(1))
    per = _report_row(items.groupBy("domain"))
    rows = domains.join(per, "domain", "left").select(
        "domain", "place", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, F.lit(NAN)).alias(c) for c in ("base", "ft")]
    )
    total = _report_row(items.groupBy()).select(F.lit(OVERALL).alias("domain"), F.lit(2**31 - 1).alias("place"), "n", "base", "ft")
    r = lambda c, k: F.when(F.isnan(c), F.lit(NAN)).otherwise(F.bround(c, k))
    return rows.unionByName(total).select(
        "domain", "place", "n", r(F.col("base"), 6).alias("base_loss"), r(F.col("ft"), 6).alias("ft_loss"), r(F.col("base") - F.col("ft"), 6).alias("delta"),
        r(F.exp("base"), 4).alias("base_ppl"), r(F.exp("ft"), 4).alias("ft_ppl"),
    )


def macro_micro(items: DataFrame) -> DataFrame:
    """The mean of domain means and the mean over all items."""
    per = items.groupBy("domain").agg(F.avg("loss").alias("m"), F.sum("loss").alias("s"), F.count("*").alias("n"))
    return per.agg(F.avg("m").alias("macro_loss"), (F.sum("s") / F.sum("n")).alias("micro_loss"), F.sum("n").alias("n"))


def domain_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Domains that only one of two frames has, with the side that has them."""
    x, y = a.select("domain").distinct(), b.select("domain").distinct()
    only = lambda p, q, side: p.join(q, "domain", "left_anti").withColumn("only_in", F.lit(side))
    return only(x, y, "first").unionByName(only(y, x, "second"))


def prior_flag(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """``rows`` with ``grp``: 'prior' if their domain is in ``prior``, else 'new'."""
    known = prior.select("domain").distinct().withColumn("_known", F.lit(True))
    return rows.join(known, "domain", "left").withColumn("grp", F.when(F.col("_known"), "prior").otherwise("new")).drop("_known")


def inconsistencies(runs: DataFrame) -> DataFrame:
    """Domains whose base loss or N differs between runs. ``runs``: run, domain, base_loss, n."""
    spread = runs.groupBy("domain").agg((F.max("base_loss") - F.min("base_loss")).alias("spread"), F.countDistinct("n").alias("sizes"), F.countDistinct("run").alias("runs"))
    return spread.where((F.col("spread") >= BASE_TOLERANCE) | (F.col("sizes") > 1))


def pairs_of(names: list[str]) -> list[tuple[str, str]]:
    """Consecutive runs, and the first with the last if there are more than two."""
    pairs = list(zip(names, names[1:], strict=False))
    return pairs + [(names[0], names[-1])] if len(names) > 2 else pairs


def best_run(names: list[str]) -> Column:
    """The run of least loss; of equal losses the one listed first."""
    return F.array_min(F.array(*[F.struct(F.col(f"{n}_loss").alias("loss"), F.lit(i).alias("place"), F.lit(n).alias("run")) for i, n in enumerate(names)]))["run"]


def compare_runs(runs: DataFrame, names: list[str], prior: DataFrame | None = None, check: bool = True) -> DataFrame:
    """Wide comparison: one row per domain, means over prior, new and all domains, OVERALL last.

    ``runs``: run, domain, place, n, base_loss, ft_loss, ft_ppl; OVERALL is a domain there. Means
    are unweighted over domains (also of perplexities) and have no best run. With ``check`` a
    difference in domains, base losses or sizes between runs raises.
    """
    if check:
        bad = inconsistencies(runs).limit(1).collect()
        if bad:
            raise ValueError(f"runs disagree on {bad[0]['domain']}")
        first = runs.where(F.col("run") == names[0])
        for other in names[1:]:
            gap = domain_difference(first, runs.where(F.col("run") == other)).limit(1).collect()
            if gap:
                raise ValueError(f"{other} and {names[0]} differ in domain {gap[0]['domain']}")
    wide = runs.groupBy("domain").pivot("run", names).agg(F.max("ft_loss").alias("loss"), F.max("ft_ppl").alias("ppl"))
    base = runs.where(F.col("run") == names[0]).select("domain", "place", "n", "base_loss")
    wide = base.join(wide, "domain")
    if prior is None:
        wide = wide.withColumn("grp", F.when(F.col("domain") == OVERALL, "all").otherwise(""))
    else:
        wide = prior_flag(wide, prior).withColumn("grp", F.when(F.col("domain") == OVERALL, "all").otherwise(F.col("grp")))
    for n in names:
        wide = wide.withColumn(f"{n}_delta", F.col("base_loss") - F.col(f"{n}_loss"))
    for old, new in pairs_of(names):
        wide = wide.withColumn(f"gain_{new}_over_{old}", F.col(f"{old}_loss") - F.col(f"{new}_loss"))
    wide = wide.withColumn("best_run", best_run(names))
    numbers = [c for c in wide.columns if c not in ("domain", "grp", "n", "place", "best_run")]
    domains = wide.where(F.col("domain") != OVERALL)

    def mean(label: str, group: str, members: DataFrame, place: int) -> DataFrame:
        m = members.groupBy().agg(F.count("*").alias("_k"), F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in numbers]).where("_k > 0")
        return m.select(F.lit(label).alias("domain"), F.lit(place).alias("place"), "n", F.lit(group).alias("grp"), *numbers, F.lit("").alias("best_run"))

    last = 2**31 - 1
    parts = [wide]
    if prior is not None:
        parts += [mean(f"{g.upper()}_DOMAINS_MEAN", g, domains.where(F.col("grp") == g), last - 4 + i) for i, g in enumerate(("prior", "new"))]
    parts.append(mean("ALL_DOMAINS_MEAN", "all", domains, last - 2))
    return reduce(DataFrame.unionByName, parts).select("domain", "grp", "n", "place", *[F.bround(c, 6).alias(c) for c in numbers], "best_run")


def group_means(rows: DataFrame, numbers: list[str]) -> DataFrame:
    """Unweighted means by group and over all, as two grouping sets: grp ('ALL' for all), n, means."""
    grouped = rows.rollup("grp").agg(F.grouping("grp").alias("_all"), F.sum("n").alias("n"), *[F.avg(c).alias(c) for c in numbers])
    return grouped.withColumn("grp", F.when(F.col("_all") == 1, F.lit("ALL")).otherwise(F.col("grp"))).drop("_all")


def gains(runs: DataFrame) -> DataFrame:
    """Loss and gain over the run before, in each domain. ``runs``: domain, run_pos, loss."""
    before = F.lag("loss").over(Window.partitionBy("domain").orderBy("run_pos"))
    return runs.withColumn("gain", before - F.col("loss"))


def best_checkpoint(steps: DataFrame, patience: int = 5) -> DataFrame:
    """Per series: the step of least loss up to early stopping, and the step that stops (null if none):
    the first with ``patience`` evaluations in a row without a new least. ``steps``: series, step, loss."""
    w = Window.partitionBy("series").orderBy("step")
    least = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = steps.withColumn("_new", (least.isNull() | (F.col("loss") < least)).cast("int")).withColumn("_place", F.row_number().over(w))
    since = F.col("_place") - F.max(F.when(F.col("_new") == 1, F.col("_place"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    stops = marked.withColumn("_since", since).withColumn("_stop", F.min(F.when(F.col("_since") >= patience, F.col("step"))).over(Window.partitionBy("series")))
    ran = stops.where(F.col("_stop").isNull() | (F.col("step") <= F.col("_stop")))
    return ran.groupBy("series").agg(F.min_by("step", F.struct("loss", "step")).alias("best_step"), F.min("loss").alias("best_loss"), F.max("_stop").alias("stopped_at"), F.count("*").alias("evaluations"))


def better_than(items: DataFrame, names: list[str]) -> DataFrame:
    """For consecutive runs, on how many items the newer one has the lower loss. ``items``: <name>_loss."""
    aggs = [F.sum((F.col(f"{b}_loss") < F.col(f"{a}_loss")).cast("long")).alias(f"{b}_better_than_{a}") for a, b in pairs_of(names)]
    return items.agg(F.count("*").alias("n"), *aggs)


def schedule(draws: Column, batch: int, epochs: int, platform: bool, demo: bool = False, warmup: float = 0.03) -> Column:
    """Steps per epoch, in all, of warm-up and between evaluations, by either rule set; a demo runs
    half of the steps."""
    per = F.ceil(draws / F.lit(batch)).cast("long")
    total = per * epochs
    if demo:
        total = F.greatest(F.lit(1), F.ceil(total * F.lit(0.5)).cast("long"))
    share = F.bround(total * F.lit(warmup), 0).cast("long")
    quarter = F.greatest(F.lit(50), F.floor(per / F.lit(4)))
    if platform:
        warm = F.greatest(F.least(F.lit(20), F.floor(total / F.lit(10))), share)
        every = F.greatest(F.lit(1), F.least(quarter, F.floor(total / F.lit(2))))
    else:
        warm, every = F.greatest(F.lit(20), share), quarter
    return F.struct(per.alias("per_epoch"), total.alias("total"), warm.cast("long").alias("warmup"), every.cast("long").alias("eval_every"))


def percent_reduction(base: Column, value: Column) -> Column:
    return (base - value) / F.nullif(base, F.lit(0.0)) * 100


def ink_on(fill: Column) -> Column:
    """Dark or light text for a #rrggbb fill, by its luminance."""
    part = lambda i: F.pow(F.conv(F.substring(fill, i, 2), 16, 10).cast("double") / 255, F.lit(2.2))
    light = 0.2126 * part(2) + 0.7152 * part(4) + 0.0722 * part(6)
    return F.when(light > 0.28, "#0b0b0b").otherwise("#ffffff")
