"""Resampling over nested clusters, influence-based bootstrap, and false-alarm calibration over a grid of levels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.functions.random import uniform
from alarmlens.operators import inference
from alarmlens.operators.running import running

#: Webb's six points, of equal probability.
WEBB = [-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5)]


def two_level_weights(units: DataFrame, outer: str, inner: str, replicates: int, stream: str) -> DataFrame:
    """(rep, outer, inner, weight): outer clusters are drawn with replacement, and inside each its units; the weight is the product of both counts.

    units has one row for each pair. Draws are met by number, so rows grow with units times replicates.
    """
    outers = units.select(outer).distinct()
    numbered = outers.select(outer, (F.row_number().over(Window.partitionBy().orderBy(outer)) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("k"))
    reps = units.sparkSession.range(1, replicates + 1).select(F.col("id").alias("rep"))
    drawn = reps.join(numbered.select("k").distinct()).withColumn("draw", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
    first = drawn.select("rep", F.floor(uniform(f"{stream}-outer", "rep", "draw") * F.col("k")).cast("int").alias("i")).groupBy("rep", "i").agg(F.count(F.lit(1)).cast("double").alias("m"))
    first = first.join(numbered.select(outer, "i"), "i").select("rep", outer, "m")
    inside = units.select(outer, inner, (F.row_number().over(Window.partitionBy(outer).orderBy(inner)) - 1).alias("j"), F.count(F.lit(1)).over(Window.partitionBy(outer)).alias("n"))
    picks = first.join(inside.select(outer, F.col("j").alias("draw"), "n"), outer).select("rep", outer, "m", F.floor(uniform(f"{stream}-inner", "rep", outer, "draw") * F.col("n")).cast("int").alias("j"))
    second = picks.groupBy("rep", outer, "j", "m").agg(F.count(F.lit(1)).cast("double").alias("c"))
    return second.join(inside.select(outer, inner, "j"), [outer, "j"]).select("rep", outer, inner, (F.col("m") * F.col("c")).alias("weight"))


def contrast(rows: DataFrame, weights: DataFrame, on: list[str], a: str, b: str, positive: str) -> DataFrame:
    """(rep, a, b, difference): the AUROCs of two scores under the same weights."""
    weighted = rows.dropna(subset=[a, b]).join(weights, on)
    parts = [inference.auroc(weighted, ["rep"], s, positive, "weight").withColumnRenamed("auroc", s) for s in (a, b)]
    return parts[0].join(parts[1], "rep").withColumn("difference", F.col(a) - F.col(b))


def interval(replicates: DataFrame, by: list[str], value: str) -> DataFrame:
    cut = replicates.groupBy(*by).agg(F.count(value).alias("n_replicates"), F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("x"))
    return cut.select(*by, "n_replicates", F.col("x")[0].alias("low"), F.col("x")[1].alias("mid"), F.col("x")[2].alias("high"))


def influence(rows: DataFrame, cluster: str, score: str, positive: str) -> DataFrame:
    """(cluster, psi, auroc): what each cluster adds to the AUROC's first-order expansion, from running counts of distinct scores."""
    each = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(positive)).cast("double").alias("p"), F.count_if(~F.col(positive)).cast("double").alias("q"))
    counted = running(each, [score], {"p_upto": "p", "q_upto": "q"}).crossJoin(F.broadcast(each.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))))
    wins, losses = (F.col("q_upto") - F.col("q") / 2) / F.col("nq"), (F.col("np") - F.col("p_upto") + F.col("p") / 2) / F.col("np")
    table = counted.select(score, "np", "nq", wins.alias("wins"), losses.alias("losses"), "p")
    table = table.crossJoin(F.broadcast(table.agg((F.sum(F.col("p") * F.col("wins")) / F.max("np")).alias("auroc")))).drop("p")
    met = rows.join(table, score)
    psi = F.when(F.col(positive), (F.col("wins") - F.col("auroc")) / F.col("np")).otherwise((F.col("losses") - F.col("auroc")) / F.col("nq"))
    return met.groupBy(cluster).agg(F.sum(psi).alias("psi"), F.first("auroc").alias("auroc"))


def wild(psi: DataFrame, cluster: str, replicates: int) -> DataFrame:
    """(scheme, rep, auroc): the AUROC plus each cluster's influence times a random weight, by Rademacher's and by Webb's points."""
    drawn = psi.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("u", uniform("wild", "rep", cluster))
    webb = F.element_at(F.array(*map(F.lit, WEBB)), (F.floor(F.col("u") * 6) + 1).cast("int"))
    schemes = F.array(F.struct(F.lit("rademacher").alias("scheme"), F.when(F.col("u") < 0.5, -1.0).otherwise(1.0).alias("w")), F.struct(F.lit("webb").alias("scheme"), webb.alias("w")))
    each = drawn.select("rep", "psi", "auroc", F.inline(schemes))
    return each.groupBy("scheme", "rep").agg((F.first("auroc") + F.sum(F.col("w") * F.col("psi"))).alias("auroc"))


def fused(scores: DataFrame, features: list[str], levels: list[float], by: list[str] | None = None) -> DataFrame:
    """For each level: the largest common marginal rate q whose OR of all features fires on at most that share of normal rows, the false-alarm rate that it has, and its coverage of anomalous rows.

    Ranks from the top count ties together, so a row fires from the least of its features' rank shares on; an anomalous row's
    ranks are those of the normal scores at or above it, and it fires at q if one of them stays below.
    """
    by = by or []
    rows = scores.dropna(subset=features)
    normal = F.count_if(F.col("anomaly") == 0)
    ranked = rows.withColumn("n", normal.over(Window.partitionBy(*by)))
    for f in features:
        ranked = ranked.withColumn(f"{f}_rank", normal.over(Window.partitionBy(*by).orderBy(F.desc(f)).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    fires = ranked.select(*by, "anomaly", "n", F.least(*[F.col(f"{f}_rank") for f in features]).alias("rank"))
    counts = fires.groupBy(*by, "rank").agg(F.max("n").alias("n"), normal.alias("c"))
    total = counts.where("c > 0").withColumn("firing", F.sum("c").over(Window.partitionBy(*by).orderBy("rank")))
    table = total.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).where(F.col("firing") <= F.col("level") * F.col("n"))
    best = table.groupBy(*by, "level").agg(F.max("rank").alias("cut"), F.max("firing").alias("firing"), F.first("n").alias("n"))
    hits = fires.where("anomaly = 1").groupBy(*by, "rank").count()
    met = best.join(hits, by) if by else best.crossJoin(hits)
    covered = met.groupBy(*by, "level", "cut", "firing", "n").agg((F.sum(F.when(F.col("rank") < F.col("cut"), F.col("count")).otherwise(0)) / F.sum("count")).alias("coverage"))
    return covered.select(*by, "level", (F.col("cut") / F.col("n")).alias("q"), (F.col("firing") / F.col("n")).alias("joint_far"), "coverage")


def adoption(coverage_gain: Column, prevalence: Column, miss_cost: Column, channel_cost: Column) -> Column:
    """Whether a channel is worth its cost: the gain in coverage times prevalence and the cost of a miss exceeds it."""
    return coverage_gain * prevalence * miss_cost > channel_cost
