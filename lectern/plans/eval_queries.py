"""Loss reports, run comparisons and pairwise judging over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import judge, losses
from lectern.plans.registry import query
from lectern.plans.tables import RUNS_SQL, VERDICTS_SQL, runs, verdicts
from lectern.session import table

_NAN = "'nan'::DOUBLE"
_R = lambda c, k: f"CASE WHEN isnan({c}) THEN {_NAN} ELSE round_even({c}, {k}) END"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with losses, one in thirteen too long to score; two nations are no known domain."""
    skipped = F.col("item") % 13 == 0
    loss = lambda c: F.when(skipped, F.lit(losses.NAN)).otherwise(c)
    return runs(spark, sf_dir).select("item", "domain", "region", loss(F.col("base_loss")).alias("base_loss"), loss(F.col("base_loss") * 0.75).alias("ft_loss"))


_ITEMS = f"""{RUNS_SQL}, scored AS (
  SELECT item, domain, region, CASE WHEN item % 13 = 0 THEN NULL ELSE base_loss END AS b, CASE WHEN item % 13 = 0 THEN NULL ELSE base_loss * 0.75::DOUBLE END AS f FROM items)"""


@query(
    "loss_report",
    f"""WITH {_ITEMS}, dom AS (SELECT n_name AS domain, n_nationkey AS place FROM nation WHERE n_nationkey >= 2), r AS (
      SELECT d.domain, d.place, count(s.item) AS n, coalesce(avg(b), {_NAN}) AS b, coalesce(avg(f), {_NAN}) AS f FROM dom d LEFT JOIN scored s USING (domain) GROUP BY ALL
      UNION ALL SELECT 'OVERALL', 2147483647, count(*), coalesce(avg(b), {_NAN}), coalesce(avg(f), {_NAN}) FROM scored)
    SELECT domain, place, n, {_R('b', 6)} AS base_loss, {_R('f', 6)} AS ft_loss, {_R('b - f', 6)} AS delta, {_R('exp(b)', 4)} AS base_ppl, {_R('exp(f)', 4)} AS ft_ppl FROM r""",
)
def loss_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-5, AGG-6, SCL-39: the report of one run; unknown domains count in OVERALL only."""
    domains = table(spark, sf_dir, "nation").where("n_nationkey >= 2").select(F.col("n_name").alias("domain"), F.col("n_nationkey").alias("place"))
    return losses.loss_report(_items(spark, sf_dir), domains).withColumn("n", F.col("n").cast("long"))


@query(
    "macro_micro_loss",
    f"WITH {RUNS_SQL}, p AS (SELECT domain, avg(base_loss) AS m, sum(base_loss) AS s, count(*) AS n FROM items GROUP BY domain) SELECT round_even(avg(m), 6) AS macro_loss, round_even(sum(s) / sum(n), 6) AS micro_loss, sum(n)::BIGINT AS n FROM p",
)
def macro_micro_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-4, AGG-5."""
    found = losses.macro_micro(runs(spark, sf_dir).withColumnRenamed("base_loss", "loss"))
    return found.select(F.bround("macro_loss", 6).alias("macro_loss"), F.bround("micro_loss", 6).alias("micro_loss"), "n")


NAMES = ["r6", "r7", "r8"]


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run, domain and OVERALL: n, base loss, own loss and perplexity, as reports have them."""
    long = runs(spark, sf_dir).withColumn("run", F.explode(F.array(*map(F.lit, NAMES))))
    factor = F.when(F.col("run") == "r6", 0.9).when(F.col("run") == "r7", 0.8 + F.col("region") * 0.01).otherwise(0.78 + F.col("region") * 0.02)
    long = long.withColumn("own", F.col("base_loss") * factor)
    rows = long.select("run", F.explode(F.array("domain", F.lit(losses.OVERALL))).alias("domain"), "base_loss", "own")
    means = rows.groupBy("run", "domain").agg(F.count("*").alias("n"), F.bround(F.avg("base_loss"), 6).alias("base_loss"), F.bround(F.avg("own"), 6).alias("ft_loss"), F.bround(F.exp(F.avg("own")), 4).alias("ft_ppl"))
    return means.withColumn("place", F.when(F.col("domain") == losses.OVERALL, 2**31 - 1).otherwise(0))


_REPORTS = f"""{RUNS_SQL}, long AS (
  SELECT run, domain, base_loss, base_loss * CASE run WHEN 'r6' THEN 0.9::DOUBLE WHEN 'r7' THEN 0.8::DOUBLE + region * 0.01::DOUBLE ELSE 0.78::DOUBLE + region * 0.02::DOUBLE END AS own FROM items, (VALUES ('r6'), ('r7'), ('r8')) r(run)
), rows AS (SELECT run, domain, base_loss, own FROM long UNION ALL SELECT run, 'OVERALL', base_loss, own FROM long), reports AS (
  SELECT run, domain, count(*) AS n, round_even(avg(base_loss), 6) AS base_loss, round_even(avg(own), 6) AS ft_loss, round_even(exp(avg(own)), 4) AS ft_ppl FROM rows GROUP BY ALL
), wide AS (
  SELECT domain, any_value(n) AS n, any_value(base_loss) AS base_loss, max(ft_loss) FILTER (run = 'r6') AS r6_loss, max(ft_loss) FILTER (run = 'r7') AS r7_loss, max(ft_loss) FILTER (run = 'r8') AS r8_loss,
    max(ft_ppl) FILTER (run = 'r6') AS r6_ppl, max(ft_ppl) FILTER (run = 'r7') AS r7_ppl, max(ft_ppl) FILTER (run = 'r8') AS r8_ppl FROM reports GROUP BY domain
), grouped AS (
  SELECT *, CASE WHEN domain = 'OVERALL' THEN 'all' WHEN domain IN (SELECT n_name FROM nation WHERE n_nationkey < 12) THEN 'prior' ELSE 'new' END AS grp,
    base_loss - r6_loss AS r6_delta, base_loss - r7_loss AS r7_delta, base_loss - r8_loss AS r8_delta, r6_loss - r7_loss AS gain_r7_over_r6, r7_loss - r8_loss AS gain_r8_over_r7, r6_loss - r8_loss AS gain_r8_over_r6,
    CASE WHEN r6_loss <= r7_loss AND r6_loss <= r8_loss THEN 'r6' WHEN r7_loss <= r8_loss THEN 'r7' ELSE 'r8' END AS best_run FROM wide
)"""
_NUMBERS = ["base_loss", *[f"{n}_{c}" for n in NAMES for c in ("loss", "ppl", "delta")], "gain_r7_over_r6", "gain_r8_over_r7", "gain_r8_over_r6"]
_MEAN = ", ".join(f"round_even(avg({c}), 6) AS {c}" for c in _NUMBERS)
_AS_IS = ", ".join(f"round_even({c}, 6) AS {c}" for c in _NUMBERS)


@query(
    "run_comparison",
    f"""WITH {_REPORTS}
    SELECT domain, grp, n, {_AS_IS}, best_run FROM grouped
    UNION ALL SELECT 'PRIOR_DOMAINS_MEAN', 'prior', sum(n)::BIGINT, {_MEAN}, '' FROM grouped WHERE grp = 'prior'
    UNION ALL SELECT 'NEW_DOMAINS_MEAN', 'new', sum(n)::BIGINT, {_MEAN}, '' FROM grouped WHERE grp = 'new'
    UNION ALL SELECT 'ALL_DOMAINS_MEAN', 'all', sum(n)::BIGINT, {_MEAN}, '' FROM grouped WHERE domain <> 'OVERALL'""",
)
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-1, JOIN-2, FLT-21, AGG-7 to AGG-9, SET-6: three runs side by side."""
    prior = table(spark, sf_dir, "nation").where("n_nationkey < 12").select(F.col("n_name").alias("domain"))
    return losses.compare_runs(_reports(spark, sf_dir), NAMES, prior).drop("place")


@query("run_group_means", f"WITH {_REPORTS} SELECT coalesce(grp, 'ALL') AS grp, sum(n)::BIGINT AS n, round_even(avg(r8_loss), 6) AS r8_loss, round_even(avg(r8_ppl), 6) AS r8_ppl FROM grouped WHERE domain <> 'OVERALL' GROUP BY GROUPING SETS ((grp), ())")
def run_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7 as grouping sets."""
    prior = table(spark, sf_dir, "nation").where("n_nationkey < 12").select(F.col("n_name").alias("domain"))
    r8 = _reports(spark, sf_dir).where((F.col("run") == "r8") & (F.col("domain") != losses.OVERALL)).withColumnsRenamed({"ft_loss": "r8_loss", "ft_ppl": "r8_ppl"})
    means = losses.group_means(losses.prior_flag(r8, prior), ["r8_loss", "r8_ppl"])
    return means.select("grp", "n", F.bround("r8_loss", 6).alias("r8_loss"), F.bround("r8_ppl", 6).alias("r8_ppl"))


@query("best_run", f"WITH {_REPORTS} SELECT best_run, count(*) AS n FROM grouped WHERE domain <> 'OVERALL' GROUP BY best_run")
def best_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8: how often each run is the best of a domain."""
    wide = losses.compare_runs(_reports(spark, sf_dir), NAMES, None)
    return wide.where((F.col("best_run") != "") & (F.col("domain") != losses.OVERALL)).groupBy("best_run").agg(F.count("*").alias("n"))


@query(
    "run_gains_lag",
    """WITH y AS (SELECT n_name AS domain, year(o_orderdate::DATE) AS run_pos, round_even(avg(o_totalprice) / 100000, 6) AS loss FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT domain, run_pos::INTEGER AS run_pos, loss, round_even(lag(loss) OVER (PARTITION BY domain ORDER BY run_pos) - loss, 6) AS gain FROM y""",
)
def run_gains_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-17: the gain of each year's run over the one before."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = table(spark, sf_dir, "nation")
    y = o.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("domain"), F.year(F.to_date("o_orderdate")).alias("run_pos"))
    return losses.gains(y.agg(F.bround(F.avg("o_totalprice") / 100000, 6).alias("loss"))).withColumn("gain", F.bround("gain", 6))


@query(
    "domain_set_difference",
    """WITH a AS (SELECT DISTINCT n_name AS domain FROM nation WHERE n_nationkey < 20), b AS (SELECT DISTINCT n_name AS domain FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey > 2)
    SELECT domain, 'first' AS only_in FROM a WHERE domain NOT IN (SELECT domain FROM b) UNION ALL SELECT domain, 'second' FROM b WHERE domain NOT IN (SELECT domain FROM a)""",
)
def domain_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-2, SET-2."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    b = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).where("n_nationkey > 2")
    return losses.domain_difference(n.where("n_nationkey < 20").select(F.col("n_name").alias("domain")), b.select(F.col("n_name").alias("domain")))


@query("prior_new_flag", "SELECT n_name AS domain, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0) THEN 'prior' ELSE 'new' END AS grp FROM nation")
def prior_new_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-3."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("domain"), "n_name")
    prior = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("domain"))
    return losses.prior_flag(n, prior).select(F.col("n_name").alias("domain"), "grp")


@query(
    "run_consistency",
    f"WITH {RUNS_SQL}, h AS (SELECT item % 2 AS run, domain, round_even(avg(base_loss), 6) AS b, count(*) AS n FROM items GROUP BY ALL) SELECT domain, round_even(max(b) - min(b), 6) AS spread FROM h GROUP BY domain HAVING max(b) - min(b) >= 0.001 OR count(DISTINCT n) > 1",
)
def run_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-21: domains on which two runs disagree."""
    halves = runs(spark, sf_dir).groupBy((F.col("item") % 2).alias("run"), "domain").agg(F.bround(F.avg("base_loss"), 6).alias("base_loss"), F.count("*").alias("n"))
    return losses.inconsistencies(halves).select("domain", F.bround("spread", 6).alias("spread"))


@query(
    "best_checkpoint",
    """WITH s AS (SELECT user_id AS series, event_id AS step, value AS loss FROM events), m AS (
      SELECT *, min(loss) OVER w AS before, row_number() OVER (PARTITION BY series ORDER BY step) AS place FROM s WINDOW w AS (PARTITION BY series ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), f AS (
      SELECT *, place - max(CASE WHEN before IS NULL OR loss < before THEN place END) OVER (PARTITION BY series ORDER BY step) AS since FROM m), t AS (
      SELECT *, min(CASE WHEN since >= 5 THEN step END) OVER (PARTITION BY series) AS stop FROM f)
    SELECT series, arg_min(step, (loss, step)) AS best_step, min(loss) AS best_loss, max(stop) AS stopped_at, count(*) AS evaluations FROM t WHERE stop IS NULL OR step <= stop GROUP BY series""",
)
def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-18, AGG-4: early stopping and the best step of each series."""
    return losses.best_checkpoint(table(spark, sf_dir, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("step"), F.col("value").alias("loss")))


@query("better_than", "SELECT count(*) AS n, count(*) FILTER (l_tax < l_discount) AS b_better_than_a FROM lineitem")
def better_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-27: on how many items one run beats the other."""
    return losses.better_than(table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("a_loss"), F.col("l_tax").alias("b_loss")), ["a", "b"])


@query(
    "schedules",
    """WITH c AS (SELECT source, count(*) * 27 AS draws FROM documents GROUP BY source), s AS (SELECT source, ceil(draws / 16.0)::BIGINT AS per FROM c)
    SELECT source, per AS per_epoch, per * 2 AS total, greatest(least(20, per * 2 // 10), round_even(per * 2 * 0.03::DOUBLE, 0))::BIGINT AS warmup, greatest(1, least(greatest(50, per // 4), per * 2 // 2))::BIGINT AS eval_every FROM s""",
)
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16."""
    c = table(spark, sf_dir, "documents").groupBy("source").agg((F.count("*") * 27).alias("draws"))
    return c.select("source", losses.schedule(F.col("draws"), 16, 2, platform=True).alias("s")).select("source", "s.*")


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Subject answers, opponents' answers and verdicts; some answers are empty, some verdicts missing."""
    v = verdicts(spark, sf_dir)
    answer = lambda n, k: F.when(F.col("idx") % k == 0, "").otherwise(F.repeat(F.lit("x"), (F.col("n_chars") % n + 1).cast("int")))
    subject = v.select("idx", answer(97, 23).alias("answer"))
    theirs = v.select("opponent", "idx", answer(131, 17).alias("answer"))
    points = F.explode(F.array(*[F.struct(F.lit(o).alias("order"), F.col(p).alias("points"), F.lit(i).alias("line")) for i, (o, p) in enumerate(zip(judge.ORDERS, ("p1", "p2"), strict=True))]))
    given = v.select("opponent", "idx", points.alias("v")).select("opponent", "idx", "v.*").where(~((F.col("idx") % 19 == 0) & (F.col("order") == judge.ORDERS[1])))
    return subject, theirs, given


_OUTCOMES = f"""{VERDICTS_SQL}, o AS (
  SELECT *, CASE WHEN idx % 23 = 0 THEN '' ELSE repeat('x', (n_chars % 97 + 1)::INTEGER) END AS mine, CASE WHEN idx % 17 = 0 THEN '' ELSE repeat('x', (n_chars % 131 + 1)::INTEGER) END AS theirs,
         CASE WHEN idx % 19 = 0 THEN NULL ELSE p2 END AS q2 FROM verdicts
), outcomes AS (
  SELECT opponent, idx, domain, CASE WHEN mine = '' AND theirs = '' THEN 'tie' WHEN mine = '' THEN 'loss' WHEN theirs = '' THEN 'win' WHEN q2 IS NULL THEN NULL WHEN p1 + q2 > 0 THEN 'win' WHEN p1 + q2 < 0 THEN 'loss' ELSE 'tie' END AS outcome,
         CASE WHEN mine <> '' AND theirs <> '' AND p1 * q2 < 0 THEN 1 ELSE 0 END::INTEGER AS flip, length(mine)::INTEGER AS subject_chars, length(theirs)::INTEGER AS opponent_chars FROM o
), judged AS (SELECT * FROM outcomes WHERE outcome IS NOT NULL)"""


@query("judge_outcomes", f"WITH {_OUTCOMES} SELECT opponent, idx, outcome, flip, subject_chars, opponent_chars FROM judged")
def judge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11, JOIN-4, JOIN-7, JOIN-8, SRC-7, SRC-8."""
    return judge.outcomes(*_judged(spark, sf_dir))


_SUMMARY = """count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'tie') AS ties, count(*) FILTER (outcome = 'loss') AS losses, count(*) AS n, sum(flip)::BIGINT AS flips,
  round_even(count(*) FILTER (outcome = 'win') / count(*)::DOUBLE, 3) AS win_rate, round_even(count(*) FILTER (outcome <> 'loss') / count(*)::DOUBLE, 3) AS win_or_tie_rate"""


@query("judge_summary", f"WITH {_OUTCOMES} SELECT opponent, {_SUMMARY} FROM judged GROUP BY opponent")
def judge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10."""
    return judge.summary(judge.outcomes(*_judged(spark, sf_dir)), "opponent")


@query("judge_by_group", f"WITH {_OUTCOMES} SELECT opponent, CASE WHEN domain IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5') THEN 'prior' ELSE 'new' END AS grp, {_SUMMARY} FROM judged GROUP BY 1, 2")
def judge_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-26."""
    v = verdicts(spark, sf_dir).select("idx", "domain")
    prior = spark.createDataFrame([(f"src{i}",) for i in range(6)], "domain string")
    items = judge.outcomes(*_judged(spark, sf_dir)).join(losses.prior_flag(v, prior).select("idx", "grp"), "idx")
    return judge.summary(items, "opponent", "grp")


@query("judge_shares", f"WITH {_OUTCOMES}, s AS (SELECT opponent, {_SUMMARY} FROM judged GROUP BY opponent) SELECT opponent, round_even(wins / n::DOUBLE, 6) AS wins_share, round_even(ties / n::DOUBLE, 6) AS ties_share, round_even(losses / n::DOUBLE, 6) AS losses_share FROM s")
def judge_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-17, SCL-40."""
    s = judge.shares(judge.summary(judge.outcomes(*_judged(spark, sf_dir)), "opponent"))
    return s.select("opponent", *[F.bround(f"{c}_share", 6).alias(f"{c}_share") for c in ("wins", "ties", "losses")])


@query("judge_lengths", f"WITH {_OUTCOMES} SELECT opponent, median(subject_chars) AS subject_median, median(opponent_chars) AS opponent_median, count(*) FILTER (subject_chars < opponent_chars) AS subject_shorter, count(*) AS n FROM judged GROUP BY opponent")
def judge_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25."""
    return judge.length_comparison(judge.outcomes(*_judged(spark, sf_dir)))


@query(
    "judge_worklist",
    f"""WITH {VERDICTS_SQL}, w AS (SELECT opponent, idx, o AS "order" FROM verdicts, (VALUES ('subject_first'), ('opponent_first')) t(o) WHERE idx % 23 <> 0 AND idx % 17 <> 0)
    SELECT * FROM w WHERE "order" = 'opponent_first' AND idx % 19 = 0""",
)
def judge_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-5, JOIN-6, SET-4, STR-10: verdicts still to be asked for."""
    return judge.worklist(*_judged(spark, sf_dir))


@query(
    "verdict_points",
    """WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' a ' WHEN 1 THEN 'B' WHEN 2 THEN 'Tie' WHEN 3 THEN 'A' ELSE 'neither' END AS raw, CASE WHEN user_id % 2 = 0 THEN 'subject_first' ELSE 'opponent_first' END AS "order" FROM events), w AS (
      SELECT *, CASE WHEN upper(trim(raw)) IN ('A', 'B') THEN upper(trim(raw)) WHEN upper(trim(raw)) = 'TIE' THEN 'tie' END AS winner FROM r)
    SELECT event_id, winner, CASE WHEN winner IS NULL THEN NULL WHEN winner = 'tie' THEN 0 WHEN (winner = 'A') = ("order" = 'subject_first') THEN 1 ELSE -1 END::INTEGER AS points FROM w""",
)
def verdict_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL-28, SCL-29."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 5
    raw = F.when(k == 0, " a ").when(k == 1, "B").when(k == 2, "Tie").when(k == 3, "A").otherwise("neither")
    order = F.when(F.col("user_id") % 2 == 0, judge.ORDERS[0]).otherwise(judge.ORDERS[1])
    w = e.select("event_id", judge.winner(raw).alias("winner"), order.alias("o"))
    return w.select("event_id", "winner", F.when(F.col("winner").isNotNull(), judge.subject_points(F.col("winner"), F.col("o"))).alias("points"))


@query("first_place_rate", f"WITH {VERDICTS_SQL} SELECT count(*) AS n, round_even(avg(CASE WHEN p1 = 1 THEN 1 ELSE 0 END), 6) AS a_rate FROM verdicts")
def first_place_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-29: how often the first place won."""
    v = verdicts(spark, sf_dir).select(F.when(F.col("p1") == 1, "A").otherwise("B").alias("winner_pos"))
    return judge.first_place_rate(v).withColumn("a_rate", F.bround("a_rate", 6))


_BLIND = """pool AS (SELECT doc_id AS row_idx, source AS domain, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id || ':7'), doc_id) AS first FROM labels JOIN documents USING (doc_id)), picked AS (
  SELECT row_idx, domain FROM pool ORDER BY first > 1, CASE WHEN first = 1 THEN md5(domain || ':7') ELSE md5(row_idx || ':7') END, row_idx LIMIT 30), sheet AS (
  SELECT row_idx, domain, row_number() OVER (ORDER BY row_idx)::INTEGER AS sheet_id, CASE WHEN (position(md5(row_idx || ':7')[1] IN '0123456789abcdef') - 1) % 2 = 0 THEN 'A' ELSE 'B' END AS subject_is FROM picked)"""


@query("blind_sheet", f"WITH {_BLIND} SELECT * FROM sheet")
def blind_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-9, SCL-30, WIN-3: a stratified sheet of thirty items with sides by coin."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("row_idx"), F.col("source").alias("domain"))
    return judge.blind_sheet(rows, 30)


@query(
    "blind_agreement",
    f"""WITH {_BLIND}, g AS (SELECT *, CASE WHEN sheet_id % 4 = 0 THEN '' WHEN sheet_id % 4 = 1 THEN 'a' WHEN sheet_id % 4 = 2 THEN 'B' ELSE 'tie' END AS mark FROM sheet), h AS (
      SELECT row_idx, CASE WHEN mark = 'tie' THEN 'tie' WHEN upper(mark) = subject_is THEN 'win' WHEN mark <> '' THEN 'loss' END AS human FROM g)
    SELECT count(*) AS n, round_even(avg(CASE WHEN human = CASE WHEN quality = 1 THEN 'win' ELSE 'loss' END THEN 1 ELSE 0 END), 6) AS rate FROM h JOIN labels ON doc_id = row_idx WHERE human IS NOT NULL""",
)
def blind_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-12, JOIN-10, FLT-22: a person's grades against the outcomes."""
    key = blind_sheet(spark, sf_dir)
    k = F.col("sheet_id") % 4
    graded = key.select("sheet_id", F.when(k == 0, "").when(k == 1, "a").when(k == 2, "B").otherwise("tie").alias("winner"))
    items = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_idx"), F.when(F.col("quality") == 1, "win").otherwise("loss").alias("outcome"))
    return judge.agreement(key, graded, items).withColumn("rate", F.bround("rate", 6))


@query(
    "answer_counts",
    "SELECT role, count(*) AS n, count(*) FILTER (trim(text) = '') AS empty, count(*) FILTER (length(text) > 400) AS cut FROM conversations GROUP BY role",
)
def answer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24: empty and cut answers."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.trim("text") == "").alias("empty"), F.count_if(F.length("text") > 400).alias("cut"))
