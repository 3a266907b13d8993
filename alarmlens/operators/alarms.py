"""False-alarm calibration of fused rules, and resampling over clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.functions.random import uniform
from alarmlens.operators.running import running


def joint_false_alarm(scores: DataFrame, features: list[str], level: float) -> DataFrame:
    """The largest common marginal rate q at which the OR of all features fires on at most a share level of normal rows.

    Each row fires from the least of its features' rank shares on; q is an order statistic of these. Ranks come from counts
    by distinct score.
    """
    normal = scores.where("anomaly = 0").dropna(subset=features)
    n = normal.agg(F.count(F.lit(1)).alias("n"))
    ranked = normal
    for f in features:
        rank = running(normal.groupBy(f).count(), [F.desc(f)], {f"{f}_rank": "count"}).drop("count")
        ranked = ranked.join(rank, f)
    fires = ranked.select(F.least(*[F.col(f"{f}_rank") for f in features]).alias("rank")).groupBy("rank").count()
    total = running(fires, ["rank"], {"firing": "count"}).drop("count")
    kept = total.crossJoin(F.broadcast(n)).where(F.col("firing") <= level * F.col("n"))
    return kept.agg(F.max(F.col("rank") / F.col("n")).alias("q"), F.max(F.col("firing") / F.col("n")).alias("joint_far"))


def mcc(tp, tn, fp, fn):
    """Matthews correlation from counts, 0 where a margin is empty."""
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(product > 0, (tp * tn - fp * fn) / F.sqrt(F.when(product > 0, product))).otherwise(0.0)


#: Above this number of clusters sign_flips gives no p; each half has at most 2 ** 20 sums.
MOST_FLIPPED = 40


def sign_flips(effects: DataFrame, value: str) -> DataFrame:
    """Exact two-sided sign-flip test of a mean over k clusters: all 2 ** k flips, counted from the sums of two halves of the clusters.

    A flip's sum is a left sum and a right one; those that reach the seen sum are counted by a running count of the left sums
    over both in order. Flipping all signs turns a sum round, so that the other side has as many.
    """
    listed = effects.agg(F.sort_array(F.collect_list(value)).alias("x")).where(F.size("x") <= MOST_FLIPPED)
    halves = listed.select(F.expr("slice(x, 1, size(x) div 2)").alias("a"), F.expr("slice(x, size(x) div 2 + 1, size(x))").alias("b"), (F.abs(F.expr("aggregate(x, 0D, (a, v) -> a + v)")) - 1e-12).alias("least"))

    def sums(side: str):
        flips = halves.select(F.col(side).alias("x"), "least", F.explode(F.expr(f"sequence(0, shiftleft(1, size({side})) - 1)")).alias("m"))
        return flips.select(F.expr("aggregate(transform(x, (v, i) -> if(shiftright(m, i) & 1 = 1, -v, v)), 0D, (a, v) -> a + v)").alias("total"), "least")

    # A left sum goes to itself, a right one b to least - b: it is met by all left sums from there on.
    both = sums("a").select(F.col("total").alias("at"), F.lit(1).alias("left"), "least").union(sums("b").select((F.col("least") - F.col("total")).alias("at"), F.lit(0), "least"))
    above = F.sum("left").over(Window.partitionBy().orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counts = both.select("left", "least", above.alias("above")).agg((F.sum("left") * F.sum(1 - F.col("left"))).alias("n"), F.sum(F.when(F.col("left") == 0, F.col("above"))).alias("reach"), F.max("least").alias("least"))
    p = F.when(F.col("least") <= 0, 1.0).otherwise(2 * F.col("reach") / F.col("n"))
    return counts.select(F.coalesce("n", F.lit(0)).cast("long").alias("n_flips"), F.when(F.col("n") > 0, p).alias("p_value"))


def cluster_weights(clusters: DataFrame, cluster: str, replicates: int, stream: str) -> DataFrame:
    """(rep, cluster, weight): how often each of k clusters is drawn in each replicate of k draws."""
    numbered = clusters.select(cluster).distinct().withColumn("number", F.row_number().over(Window.partitionBy().orderBy(cluster)) - 1)
    k = numbered.agg(F.count(F.lit(1)).alias("k"))
    draws = clusters.sparkSession.range(1, replicates + 1).select(F.col("id").alias("rep")).join(F.broadcast(k), F.col("k") > 0).select("rep", "k", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("draw"))
    drawn = draws.select("rep", F.floor(uniform(stream, "rep", "draw") * F.col("k")).cast("int").alias("number"))
    return drawn.groupBy("rep", "number").agg(F.count(F.lit(1)).cast("double").alias("weight")).join(F.broadcast(numbered), "number").select("rep", cluster, "weight")


def interval(replicates: DataFrame, value: str) -> DataFrame:
    """Number of replicates, and the median and 95 % percentile interval of a value."""
    cut = replicates.agg(F.count(F.lit(1)).alias("n_replicates"), F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("x"))
    return cut.select("n_replicates", F.col("x")[0].alias("low"), F.col("x")[1].alias("mid"), F.col("x")[2].alias("high"))
