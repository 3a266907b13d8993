"""Exact tests, calibration tables, lagged correlation and pair counts; each is a grouped aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.functions.random import uniform
from alarmlens.operators import alarms, effects
from alarmlens.operators.running import running

# Fixed values of the method.
MAX_LAG, SCORES_AFTER = 15, 40


def log_factorials(rows: DataFrame, n: str) -> DataFrame:
    """(i, lf) for i from 0 to the largest n: a running sum of logarithms."""
    to = rows.agg(F.coalesce(F.max(n), F.lit(0)).cast("long").alias("top"))
    numbers = to.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("i"))
    return numbers.select("i", F.sum(F.ln(F.greatest("i", F.lit(1)).cast("double"))).over(Window.partitionBy().orderBy("i")).alias("lf"))


def fisher_exact(tables: DataFrame, by: list[str]) -> DataFrame:
    """Two-sided Fisher test of the tables (a, b, c, d): every table of the same margins that is no likelier counts.

    Logarithms of factorials come by join, so tables of any size work; equal tables up to 1e-7 count as no likelier.
    """
    tables = tables.withColumn("r", F.col("a") + F.col("b")).withColumn("k", F.col("a") + F.col("c")).withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d"))
    lf = log_factorials(tables, "n")
    low, high = F.greatest(F.lit(0).cast("long"), F.col("r") + F.col("k") - F.col("n")), F.least("r", "k")
    cells = tables.withColumn("x", F.explode(F.sequence(low, high)))
    terms = [F.col("x"), F.col("r") - F.col("x"), F.col("k") - F.col("x"), F.col("n") - F.col("r") - F.col("k") + F.col("x")]
    long = cells.select(*by, "a", "b", "c", "d", "x", F.explode(F.array(*terms)).alias("i")).join(lf, "i")
    weights = long.groupBy(*by, "a", "b", "c", "d", "x").agg((-F.sum("lf")).alias("lw"))
    each = Window.partitionBy(*by)
    weights = weights.withColumn("w", F.exp(F.col("lw") - F.max("lw").over(each))).withColumn("seen", F.max(F.when(F.col("x") == F.col("a"), F.col("w"))).over(each))
    p = F.sum(F.when(F.col("w") <= F.col("seen") * (1 + 1e-7), F.col("w")).otherwise(0.0)) / F.sum("w")
    odds = F.try_divide((F.col("a") * F.col("d")).cast("double"), (F.col("b") * F.col("c")).cast("double"))
    return weights.groupBy(*by, "a", "b", "c", "d").agg(p.alias("p_value")).withColumn("odds_ratio", odds)


def scope(calibration: DataFrame) -> DataFrame:
    """Recall, false-alarm rate, Youden's J and MCC from counts (a, b: hits and misses; c, d: false alarms and rejections), and the channel's place."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    rows = calibration.withColumn("recall", F.try_divide(a, a + b)).withColumn("false_alarm_rate", F.try_divide(c, c + d)).withColumn("mcc", alarms.mcc(a, d, c, b))
    rows = rows.withColumn("youden_j", F.col("recall") - F.col("false_alarm_rate"))
    reason = F.when(F.col("youden_j").isNull(), "one class is missing").when((a + b < 5) | (c + d < 5), "too few segments").when(F.col("mcc") <= 0, "no better than chance").otherwise("included")
    return rows.withColumn("scope", reason)


def scores_after(samples: DataFrame, points: DataFrame) -> DataFrame:
    """|z| of level and diff for the first samples from the pivot on, numbered from 0."""
    rows = effects.standardised(samples, points).withColumn("k", F.col("t") - F.col("pivot_t"))
    return rows.where((F.col("k") >= 0) & (F.col("k") < SCORES_AFTER)).select(*effects.KEY, "k", "level_z", "diff_z")


def best_lag(scores: DataFrame, by: list[str]) -> DataFrame:
    """The lag of -15 to 15 with the strongest |correlation| of level_z at k and diff_z at k + lag; the least lag of equals.

    A sample meets at most 31 others of its own segment, so pairs grow with the samples alone. Three pairs are needed.
    """
    rows = scores.where("level_z IS NOT NULL").select(*by, "k", "level_z")
    shifted = rows.withColumn("lag", F.explode(F.sequence(F.lit(-MAX_LAG), F.lit(MAX_LAG)))).withColumn("k", F.col("k") + F.col("lag"))
    pairs = shifted.join(scores.where("diff_z IS NOT NULL").select(*by, "k", "diff_z"), [*by, "k"])
    a, b = F.stddev_pop("level_z"), F.stddev_pop("diff_z")
    each = pairs.groupBy(*by, "lag").agg(F.count(F.lit(1)).alias("n"), F.corr("level_z", "diff_z").alias("r"), F.least(a, b).alias("spread")).where("n >= 3 AND spread > 1e-12")
    best = each.groupBy(*by).agg(F.min_by(F.struct("lag", "r", "n"), F.struct((-F.round(F.abs("r"), 9)).alias("x"), "lag")).alias("m"))
    return best.select(*by, F.col("m.lag").cast("long").alias("lag"), F.col("m.r").alias("correlation"), F.col("m.n").alias("n_pairs"))


def marginal_thresholds(scores: DataFrame, features: list[str], levels: list[float]) -> DataFrame:
    """For each feature and false-alarm level: the quantile of normal scores, and what it covers of the anomalous ones."""
    long = scores.unpivot("anomaly", features, "feature", "score").where("score IS NOT NULL")
    cuts = long.where("anomaly = 0").groupBy("feature").agg(F.percentile("score", F.array(*[F.lit(1 - q) for q in levels])).alias("cuts"))
    table = cuts.select("feature", F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in levels]).alias("level"), F.col("cuts").alias("threshold"))).alias("x")).select("feature", "x.level", "x.threshold")
    over = F.col("score") > F.col("threshold")
    rates = [F.avg(F.when(F.col("anomaly") == y, over.cast("double"))).alias(name) for name, y in (("false_alarm_rate", 0), ("coverage", 1))]
    return long.join(F.broadcast(table), "feature").groupBy("feature", "level", "threshold").agg(*rates)


def held_out_thresholds(scores: DataFrame, unit: str, feature: str, level: float, folds: int, repeats: int) -> DataFrame:
    """Thresholds from the normal rows of all folds but one, and the rates they have on that one; whole units are dealt to folds.

    A row goes to each repeat's other folds once, so the table grows by repeats times folds.
    """
    rows = scores.where(F.col(feature).isNotNull()).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    rows = rows.withColumn("own", F.floor(uniform("fold", "repeat", unit) * folds).cast("int")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    by, inside = ["repeat", "fold"], F.col("own") == F.col("fold")
    cuts = rows.where(~inside & (F.col("anomaly") == 0)).groupBy(*by).agg(F.percentile(feature, F.lit(1 - level)).alias("threshold"))
    over = (F.col(feature) > F.col("threshold")).cast("double")
    rates = [F.avg(F.when(F.col("anomaly") == y, over)).alias(name) for name, y in (("false_alarm_rate", 0), ("coverage", 1))]
    return rows.where(inside).join(F.broadcast(cuts), by).groupBy(*by, "threshold").agg(*rates)


def auc_pairs(rows: DataFrame, cluster: str, score: str, positive: str) -> DataFrame:
    """Pairs of a positive and a negative, and those the positive wins (ties half), inside clusters and across them.

    Both come from running counts of the distinct scores; no pair is made.
    """
    each = rows.where(F.col(score).isNotNull()).groupBy(cluster, score).agg(F.count_if(F.col(positive)).cast("double").alias("p"), F.count_if(~F.col(positive)).cast("double").alias("q"))

    def sums(counts: DataFrame, by: list[str]) -> DataFrame:
        if by:
            counts = counts.withColumn("upto", F.sum("q").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)))
        else:
            counts = running(counts, [score], {"upto": "q"})
        totals = counts.withColumn("won", F.col("p") * (F.col("upto") - F.col("q") / 2)).groupBy(*by).agg(F.sum("won").alias("won"), (F.sum("p") * F.sum("q")).alias("pairs"))
        return totals.agg(F.sum("won").alias("won"), F.sum("pairs").alias("pairs"))

    whole = sums(each.groupBy(score).agg(F.sum("p").alias("p"), F.sum("q").alias("q")), [])
    within = sums(each, [cluster]).select(F.col("won").alias("won_in"), F.col("pairs").alias("pairs_in"))
    values = {"pooled": ("won", "pairs"), "within": ("won_in", "pairs_in"), "across": ("won - won_in", "pairs - pairs_in")}
    parts = F.array(*[F.struct(F.lit(name).alias("part"), F.expr(won).alias("won"), F.expr(pairs).alias("pairs")) for name, (won, pairs) in values.items()])
    return whole.crossJoin(F.broadcast(within)).select(F.inline(parts)).withColumn("auroc", F.try_divide("won", "pairs"))


def influence(left_out: DataFrame, by: list[str]) -> DataFrame:
    """How far leaving a study out moves the pooled effect; influential where that exceeds the whole's standard error."""
    whole = left_out.where("excluded = '(none)'").select(*by, F.col("mu").alias("whole"), F.col("se").alias("whole_se"))
    rows = left_out.where("excluded <> '(none)'").join(F.broadcast(whole), by)
    return rows.select(*by, "excluded", "mu", "whole", (F.col("mu") - F.col("whole")).alias("shift"), (F.abs(F.col("mu") - F.col("whole")) > F.col("whole_se")).alias("influential"))


def bootstrap_mcc(hits: DataFrame, replicates: int) -> DataFrame:
    """Median and 95 % interval of each channel's MCC; anomalous and normal segments are drawn apart, with replacement.

    hits has (channel, segment, anomaly, hit). The drawn segment's flag is met by its number, so nothing is collected.
    """
    by = ["channel", "anomaly"]
    numbered = hits.withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy("segment")) - 1)
    draws = numbered.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*by))).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    draws = draws.select(*by, "rep", F.floor(uniform("mcc", "channel", "anomaly", "rep", "number") * F.col("size")).cast("int").alias("number"))
    drawn = draws.groupBy(*by, "rep", "number").agg(F.count(F.lit(1)).alias("times")).join(numbered.select(*by, "number", "hit"), [*by, "number"])
    cells = {"tp": (1, True), "fn": (1, False), "fp": (0, True), "tn": (0, False)}
    counts = drawn.groupBy("channel", "rep").agg(*[F.sum(F.when((F.col("anomaly") == x) & (F.col("hit") == y), F.col("times")).otherwise(0)).cast("double").alias(n) for n, (x, y) in cells.items()])
    each = counts.select("channel", alarms.mcc(*[F.col(c) for c in ("tp", "tn", "fp", "fn")]).alias("mcc"))
    cut = F.percentile("mcc", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = each.groupBy("channel").agg(cut.alias("x"))
    return out.select("channel", F.col("x")[0].alias("low"), F.col("x")[1].alias("mid"), F.col("x")[2].alias("high"), ((F.col("x")[0] < 0) & (F.col("x")[2] > 0)).alias("crosses_zero"))
