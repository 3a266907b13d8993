"""Derived tables of the studies: persistence, placebo comparisons, sensitivity sweeps and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.operators import alarms, effects
from alarmlens.operators.running import running
from alarmlens.sources.telemetry import differences

# Fixed values of the method.
LOOK_AHEAD, DECAY_SHARE = 60, 0.5
HALF_WINDOW, WINDOW_FLOOR = 15, 1e-8
LEAST_PLACEBO = 20
SERIES = ("level", "diff", "diff2")
SEGMENT = ("channel", "segment")


def enriched(samples: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """samples with the columns of labels, which must hold each key once; the labels are one row a segment."""
    if labels.groupBy(key).count().where("count > 1").take(1):
        raise ValueError(f"labels repeat a {key}")
    return samples.join(labels, key, "left")


def ewma(samples: DataFrame, share: float = 0.2) -> DataFrame:
    """Largest and last exponentially weighted mean of a segment's nominal z, folded in the JVM."""
    rows = effects.nominal_z(samples).groupBy(*SEGMENT).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "z"))), lambda x: x["z"]).alias("zs"))
    fold = f"aggregate(zs, named_struct('e', 0D, 'peak', 0D), (a, z) -> named_struct('e', {share}D * z + {1 - share}D * a.e, 'peak', greatest(a.peak, abs({share}D * z + {1 - share}D * a.e))))"
    return rows.withColumn("folded", F.expr(fold)).select(*SEGMENT, F.col("folded.peak").alias("peak"), F.col("folded.e").alias("last"))


def level_shift_by_pre_spread(samples: DataFrame, points: DataFrame) -> DataFrame:
    """The level's shift at the pivot in standard deviations of the samples before it."""
    rows = effects.around(samples, points).groupBy(*effects.KEY).agg(*effects.moments(F.col("value"), "level"))
    good = (F.col("level_n_pre") >= 2) & (F.col("level_var_pre") > 0)
    shift = F.abs(F.col("level_mean_post") - F.col("level_mean_pre")) / F.sqrt(F.when(good, F.col("level_var_pre")))
    return rows.select(*effects.KEY, F.when(good, shift).alias("level_prez"))


def persistence(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Whether the level's |z| falls to half of its first peak within the look-ahead: transient, persistent or undecidable."""
    rows = effects.standardised(samples, points).where(F.col("post") & (F.col("t") < F.col("pivot_t") + LOOK_AHEAD) & F.col("level_z").isNotNull())
    key = Window.partitionBy(*effects.KEY)
    rows = rows.withColumn("peak", F.max("level_z").over(key)).withColumn("n", F.count(F.lit(1)).over(key))
    rows = rows.withColumn("peak_t", F.min(F.when(F.col("level_z") == F.col("peak"), F.col("t"))).over(key))
    fallen = F.min(F.when((F.col("t") > F.col("peak_t")) & (F.col("level_z") <= DECAY_SHARE * F.col("peak")), F.col("t") - F.col("pivot_t")))
    out = rows.groupBy(*effects.KEY, "n", "peak").agg(fallen.alias("decay"))
    kind = F.when(F.col("n") < 3, "undecidable").when(F.col("peak") <= 0, "undecidable").when(F.col("decay").isNotNull(), "transient").otherwise("persistent")
    return out.select(*effects.KEY, "n", "peak", "decay", kind.alias("pattern"))


def windows(samples: DataFrame, points: DataFrame) -> DataFrame:
    """The samples around each pivot, each series standardised by its window; pivots too near an end have none."""
    good = points.where(f"skip_reason = '' AND pivot_t - {HALF_WINDOW} - 2 >= 0 AND pivot_t + {HALF_WINDOW} <= n").select(*SEGMENT, "pivot_t")
    rows = differences(samples).join(good, list(SEGMENT)).where(f"t >= pivot_t - {HALF_WINDOW} AND t < pivot_t + {HALF_WINDOW}")
    key = Window.partitionBy(*effects.KEY)
    scaled = [((F.col(x) - F.avg(x).over(key)) / (F.stddev_pop(x).over(key) + WINDOW_FLOOR)).alias(name) for name, x in zip(SERIES, ("value", "d", "d2"))]
    return rows.select(*effects.KEY, (F.col("t") - F.col("pivot_t") + HALF_WINDOW).alias("k"), *scaled)


def precedence(crossings: DataFrame) -> DataFrame:
    """How often diff crosses before level, with ties left out, counted half, or counted for diff."""
    both = crossings.where("level_cross IS NOT NULL AND diff_cross IS NOT NULL")
    before, tied = F.col("diff_cross") < F.col("level_cross"), F.col("diff_cross") == F.col("level_cross")
    sums = both.groupBy("channel").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(before).alias("n_before"), F.count_if(tied).alias("n_tied"))
    n, b, t = F.col("n_pairs"), F.col("n_before"), F.col("n_tied")
    return sums.select("channel", "n_pairs", "n_before", "n_tied", F.try_divide(b.cast("double"), n - t).alias("excluded"), ((b + t / 2) / n).alias("half"), ((b + t) / n).alias("diff_first"))


#: How a tie of the two crossings counts: not at all, as half a precedence, or as a whole one.
CONVENTIONS = ("excluded", "half", "diff_first")


def precedence_increments(pairs: DataFrame, cluster: str, replicates: int, stream: str) -> DataFrame:
    """Shares of pairs in which diff crosses first, of anomalous rows, of normal ones and their difference, under each convention of ties.

    pairs has a row for each pair (cluster, anomaly, level_cross, diff_cross). Intervals come from clusters drawn with
    replacement: replicates weigh counts by cluster and side, so they don't repeat pairs, and both sides share each draw.
    p_boot is twice the smaller share of increments on either side of 0. A side without pairs has no share.
    """
    before, tied = F.col("diff_cross") < F.col("level_cross"), F.col("diff_cross") == F.col("level_cross")
    counts = pairs.where("level_cross IS NOT NULL AND diff_cross IS NOT NULL").groupBy(cluster).agg(
        *[f.alias(f"{n}{side}") for side in (0, 1) for n, f in (("n", F.count_if(F.col("anomaly") == side)), ("b", F.count_if((F.col("anomaly") == side) & before)), ("t", F.count_if((F.col("anomaly") == side) & tied)))]
    )
    weights = alarms.cluster_weights(counts.select(cluster), cluster, replicates, stream)
    seen = counts.select(F.lit(0).cast("long").alias("rep"), cluster, F.lit(1.0).alias("weight"))
    sums = counts.join(weights.unionByName(seen), cluster).groupBy("rep").agg(*[F.sum(F.col(c) * F.col("weight")).alias(c) for c in ("n0", "b0", "t0", "n1", "b1", "t1")])

    def share(convention: str, side: int):
        n, b, t = (F.col(f"{c}{side}") for c in "nbt")
        top, bottom = {"excluded": (b, n - t), "half": (b + t / 2, n), "diff_first": (b + t, n)}[convention]
        return F.try_divide(top, bottom)

    shares = sums.select("rep", *[share(c, side).alias(f"{c}{side}") for c in CONVENTIONS for side in (0, 1)])
    cells = [F.struct(F.lit(c).alias("ties"), F.lit(q).alias("quantity"), v.alias("v")) for c in CONVENTIONS for q, v in (("anomalous", F.col(f"{c}1")), ("normal", F.col(f"{c}0")), ("increment", F.col(f"{c}1") - F.col(f"{c}0")))]
    long = shares.select("rep", F.inline(F.array(*cells)))
    drawn, v = F.col("rep") > 0, F.col("v")
    of_draws = F.when(drawn, v)
    cut = long.groupBy("ties", "quantity").agg(
        F.max(F.when(~drawn, v)).alias("share"), F.count(of_draws).alias("n_replicates"), F.percentile(of_draws, F.array(F.lit(0.025), F.lit(0.975))).alias("x"),
        F.count_if(drawn & (v <= 0)).alias("low_side"), F.count_if(drawn & (v >= 0)).alias("high_side"),
    )
    p_boot = F.when(F.col("quantity") == "increment", F.least(F.lit(1.0), F.try_divide(2.0 * F.least("low_side", "high_side"), F.col("n_replicates"))))
    return cut.select("ties", "quantity", "share", "n_replicates", F.col("x")[0].alias("low"), F.col("x")[1].alias("high"), p_boot.alias("p_boot"))


def operating_points(scores: DataFrame, limits: tuple = (2.0, 3.0, 4.0)) -> DataFrame:
    """Shares of normal and anomalous rows whose peak |z| exceeds fixed limits, by series."""
    long = scores.select("anomaly", F.expr("stack(3, 'level', level_peak, 'diff', diff_peak, 'diff2', diff2_peak) AS (feature, peak)")).where("peak IS NOT NULL")
    rows = long.withColumn("z_limit", F.explode(F.array(*map(F.lit, limits))))
    rate = lambda side: F.try_divide(F.count_if((F.col("anomaly") == side) & (F.col("peak") > F.col("z_limit"))).cast("double"), F.count_if(F.col("anomaly") == side))
    return rows.groupBy("feature", "z_limit").agg(rate(0).alias("false_alarm_rate"), rate(1).alias("coverage"))


def window_cap_sweep(samples: DataFrame, points: DataFrame, caps: tuple = (10, 20, 40, 80)) -> DataFrame:
    """Segments whose level or diff crosses the limit within each cap of samples after the pivot."""
    rows = effects.crossing_times(samples, points).withColumn("cap", F.explode(F.array(*[F.lit(c).cast("long") for c in caps])))
    return rows.groupBy("channel", "cap").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level_cross") < F.col("cap")).alias("n_level"), F.count_if(F.col("diff_cross") < F.col("cap")).alias("n_diff"))


def steady_state(samples: DataFrame) -> DataFrame:
    """Deviation, population excess kurtosis and share of |z| over 3 of nominal samples by channel."""
    rows = effects.nominal_z(samples).where("anomaly = 0")
    return rows.groupBy("channel").agg(F.stddev_samp("z").alias("sd"), F.kurtosis("z").alias("excess_kurtosis"), F.avg((F.abs("z") > 3).cast("double")).alias("share_over_3"), F.count(F.lit(1)).alias("n"))


def accounting(points: DataFrame, found: DataFrame) -> DataFrame:
    """How many segments of a channel reach each step: all, usable, with an effect, complete."""
    rows = points.join(found.drop("pivot_t", "anomaly"), list(SEGMENT), "left")
    complete = F.col("level_d_abs").isNotNull() & F.col("diff_logvar").isNotNull() & F.col("diff2_logvar").isNotNull()
    return rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(F.col("skip_reason") == "").alias("n_usable"), F.count_if(F.col("level_d_abs").isNotNull()).alias("n_level"), F.count_if(complete).alias("n_complete"))


def at_pivots(samples: DataFrame, drawn: DataFrame) -> DataFrame:
    """pivot_effects for several pivots a segment (channel, segment, pivot_t), each distinct one computed once."""
    distinct = drawn.select(*SEGMENT, "pivot_t").distinct().withColumn("skip_reason", F.lit(""))
    return effects.pivot_effects(samples, distinct)


def empirical_p(observed: DataFrame, placebo: DataFrame, value: str) -> DataFrame:
    """One-sided p of each observed value among its channel's placebo values: (1 + #{placebo >= observed}) / (n + 1); null below 20.

    Distinct placebo values are counted first, and one running count over the union with the observed ones ranks all.
    """
    good = placebo.where(F.col(value).isNotNull()).groupBy("channel", value).agg(F.count(F.lit(1)).alias("c"))
    both = good.select("channel", F.lit(None).cast("long").alias("segment"), value, "c").unionByName(observed.where(F.col(value).isNotNull()).select("channel", "segment", value, F.lit(0).cast("long").alias("c")))
    above = F.sum("c").over(Window.partitionBy("channel").orderBy(F.desc(value)))  # RANGE: equal values count together
    totals = good.groupBy("channel").agg(F.sum("c").alias("placebo_n"))
    ranked = both.withColumn("n_above", above).where("segment IS NOT NULL").join(totals, "channel", "left")
    enough = F.col("placebo_n") >= LEAST_PLACEBO
    return ranked.select("channel", "segment", F.col(value).alias("observed"), F.coalesce("placebo_n", F.lit(0)).alias("placebo_n"), F.when(enough, (F.col("n_above") + 1) / (F.col("placebo_n") + 1)).alias("p_value"))


def youden(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """The score cut with the largest recall less false-alarm share (ties: the highest cut), over distinct scores."""
    each = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    totals = each.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    curve = running(each, [F.desc(score)], {"tp": "p", "fp": "q"}).crossJoin(F.broadcast(totals))
    curve = curve.select(F.col(score).alias("cut"), F.try_divide(F.col("tp").cast("double"), "np").alias("recall"), F.try_divide(F.col("fp").cast("double"), "nq").alias("false_alarm_rate"))
    return curve.withColumn("youden_j", F.col("recall") - F.col("false_alarm_rate")).orderBy(F.round("youden_j", 9).desc(), F.desc("cut")).limit(1)


def replica_gate(a: DataFrame, b: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Rows on either side only, and the largest relative difference of the values that both have."""
    both = a.select(*key, *[F.col(v).alias(f"a_{v}") for v in values]).withColumn("in_a", F.lit(1)).join(b.select(*key, *[F.col(v).alias(f"b_{v}") for v in values]).withColumn("in_b", F.lit(1)), key, "full")
    off = F.greatest(*[F.coalesce(F.try_divide(F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")), F.abs(f"b_{v}")), F.lit(0.0)) for v in values], F.lit(0.0))
    return both.agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("n_unmatched"), F.max(off).alias("max_relative_error"))
