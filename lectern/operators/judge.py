"""Pairwise verdicts in both orders, item outcomes, summaries, blind sheets and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators.corpus import seeded, stratified_pick

ORDERS = ("subject_first", "opponent_first")


def winner(raw: Column) -> Column:
    """'A', 'B' or 'tie' from a judge's word; null (ask again) for anything else."""
    w = F.upper(F.trim(raw))
    return F.when(w.isin("A", "B"), w).when(w == "TIE", "tie")


def subject_points(winner_pos: Column, order: Column) -> Column:
    """+1 if the subject won, -1 if its opponent did, 0 for a tie; the order says who stood in A."""
    return F.when(winner_pos == "tie", 0).when((winner_pos == "A") == (order == ORDERS[0]), 1).otherwise(-1)


def worklist(subject: DataFrame, opponents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(opponent, idx, order) still to be judged: both answers exist and are not empty, no verdict yet.

    ``subject``: idx, answer. ``opponents``: opponent, idx, answer. ``verdicts``: opponent, idx, order.
    """
    both = opponents.where("answer <> ''").join(subject.where("answer <> ''").select("idx"), "idx", "left_semi").select("opponent", "idx")
    asked = both.withColumn("order", F.explode(F.array(*map(F.lit, ORDERS))))
    return asked.join(verdicts.select("opponent", "idx", "order"), ["opponent", "idx", "order"], "left_anti")


def outcomes(subject: DataFrame, opponents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per judged item: opponent, idx, outcome (of the subject), flip, both lengths.

    Empty answers decide without a judge; a missing answer or verdict leaves the item out. Several
    verdicts on one order: the last by ``line`` holds.
    """
    last = verdicts.groupBy("opponent", "idx", "order").agg(F.max_by("points", "line").alias("points"))
    pair = last.groupBy("opponent", "idx").pivot("order", list(ORDERS)).agg(F.max("points"))
    met = opponents.select("opponent", "idx", F.col("answer").alias("theirs")).join(subject.select("idx", F.col("answer").alias("mine")), "idx").join(pair, ["opponent", "idx"], "left")
    p1, p2 = (F.col(o) for o in ORDERS)
    sign = p1 + p2
    outcome = (
        F.when((F.col("mine") == "") & (F.col("theirs") == ""), "tie").when(F.col("mine") == "", "loss").when(F.col("theirs") == "", "win")
        .when(p1.isNull() | p2.isNull(), F.lit(None)).when(sign > 0, "win").when(sign < 0, "loss").otherwise("tie")
    )
    written = (F.col("mine") != "") & (F.col("theirs") != "")
    return met.select(
        "opponent", "idx", outcome.alias("outcome"), F.when(written & (p1 * p2 < 0), 1).otherwise(0).alias("flip"), F.length("mine").alias("subject_chars"), F.length("theirs").alias("opponent_chars")
    ).where(F.col("outcome").isNotNull())


def summary(items: DataFrame, *by: str) -> DataFrame:
    """Wins, ties, losses, n, rates (3 places) and flips of each group."""
    n = lambda o: F.sum((F.col("outcome") == o).cast("long"))
    s = items.groupBy(*by).agg(n("win").alias("wins"), n("tie").alias("ties"), n("loss").alias("losses"), F.count("*").alias("n"), F.sum("flip").cast("long").alias("flips"))
    return s.withColumn("win_rate", F.bround(F.col("wins") / F.col("n"), 3)).withColumn("win_or_tie_rate", F.bround((F.col("wins") + F.col("ties")) / F.col("n"), 3))


def length_comparison(items: DataFrame) -> DataFrame:
    """Median lengths by opponent and on how many items the subject is the shorter one."""
    return items.groupBy("opponent").agg(
        F.median("subject_chars").alias("subject_median"), F.median("opponent_chars").alias("opponent_median"),
        F.sum((F.col("subject_chars") < F.col("opponent_chars")).cast("long")).alias("subject_shorter"), F.count("*").alias("n"),
    )


def first_place_rate(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("n"), F.avg((F.col("winner_pos") == "A").cast("int")).alias("a_rate"))


def shares(summaries: DataFrame) -> DataFrame:
    total = F.col("wins") + F.col("ties") + F.col("losses")
    return summaries.select("*", *[(F.col(c) / total).alias(f"{c}_share") for c in ("wins", "ties", "losses")])


def blind_sheet(items: DataFrame, n: int = 20, seed: int = 7) -> DataFrame:
    """``n`` items over all domains with sheet ids from 1, and the side ('A' or 'B') of the subject by
    a seeded coin. ``items``: row_idx, domain."""
    from pyspark.sql import Window

    picked = stratified_pick(items, n, seed)
    coin = F.conv(F.substring(seeded("row_idx", seed=seed), 1, 1), 16, 10).cast("int")
    return picked.withColumn("sheet_id", F.row_number().over(Window.orderBy("row_idx"))).withColumn("subject_is", F.when(coin % 2 == 0, "A").otherwise("B"))


def agreement(key: DataFrame, graded: DataFrame, items: DataFrame) -> DataFrame:
    """How often a person's grades agree with the outcomes: n and rate. ``key``: sheet_id, row_idx,
    subject_is. ``graded``: sheet_id, winner. ``items``: row_idx, outcome. Blank grades are left out."""
    mark = winner(F.col("winner"))
    human = F.when(mark == "tie", "tie").when(mark == F.col("subject_is"), "win").when(mark.isNotNull(), "loss")
    met = key.join(graded, "sheet_id", "left").withColumn("human", human).where(F.col("human").isNotNull()).join(items, "row_idx")
    return met.agg(F.count("*").alias("n"), F.avg((F.col("human") == F.col("outcome")).cast("int")).alias("rate"))
