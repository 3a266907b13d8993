"""Pivots, and what changes at them: one conditional aggregation over the samples of each segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.functions import distributions
from alarmlens.sources.telemetry import differences, in_segment

# Fixed values of the method.
BURN_IN, LEAST_POINTS, Z_LIMIT, EARLY, PEAK = 5, 5, 3.0, 10, 20
KEY = ("channel", "segment", "pivot_t")
#: The series whose means Welch's test compares.
SQUARED = {"level": "value", "diff": "d * d", "diff2": "d2 * d2"}


def pivots(samples: DataFrame, ratio: float = 0.55) -> DataFrame:
    """One pivot_t a segment at ratio of its length (half to even), clipped; skip_reason where it leaves too few points."""
    low = F.lit(BURN_IN + LEAST_POINTS)
    rows = samples.groupBy("channel", "segment").agg(F.count(F.lit(1)).alias("n"), F.max("anomaly").alias("anomaly"))
    pivot_t = F.least(F.greatest(F.bround(F.lit(ratio) * F.col("n")).cast("long"), low), F.greatest(F.col("n") - LEAST_POINTS, low))
    reason = F.when(F.col("n") < BURN_IN + 2 * LEAST_POINTS, "too_short").when((pivot_t < low) | (pivot_t > F.col("n") - LEAST_POINTS), "pivot_out_of_range").otherwise("")
    return rows.select("channel", "segment", "n", "anomaly", pivot_t.alias("pivot_t"), reason.alias("skip_reason"))


def around(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Samples from the burn-in on, with d, d2, the segment's pivot_t and post (whether the sample is at or behind it)."""
    good = points.where("skip_reason = ''").select("channel", "segment", "pivot_t")
    return differences(samples).join(good, ["channel", "segment"]).where(F.col("t") >= BURN_IN).withColumn("post", F.col("t") >= F.col("pivot_t"))


def _side(value: Column, post: bool) -> Column:
    return F.when(F.col("post") == post, value)


def moments(value: Column, name: str) -> list[Column]:
    return [f(_side(value, post)).alias(f"{name}_{what}_{side}") for side, post in (("pre", False), ("post", True)) for what, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]


def cohen_d(name: str) -> Column:
    """(mean after - mean before) / sqrt(mean of both variances); null below two points or without spread."""
    spread = F.sqrt((F.col(f"{name}_var_post") + F.col(f"{name}_var_pre")) / 2)
    enough = (F.col(f"{name}_n_pre") >= 2) & (F.col(f"{name}_n_post") >= 2) & (spread > 0)
    return F.when(enough, (F.col(f"{name}_mean_post") - F.col(f"{name}_mean_pre")) / spread)


def log_variance_ratio(name: str) -> Column:
    a, b = F.col(f"{name}_var_post"), F.col(f"{name}_var_pre")
    enough = (F.col(f"{name}_n_pre") >= LEAST_POINTS) & (F.col(f"{name}_n_post") >= LEAST_POINTS) & (a > 0) & (b > 0)
    return F.when(enough, F.ln(F.when(enough, a / b)))


def pivot_effects(samples: DataFrame, points: DataFrame) -> DataFrame:
    """level_d_abs, diff_logvar and diff2_logvar at each pivot_t."""
    sums = around(samples, points).groupBy(*KEY).agg(*moments(F.col("value"), "level"), *moments(F.col("d"), "diff"), *moments(F.col("d2"), "diff2"))
    return sums.select(*KEY, F.abs(cohen_d("level")).alias("level_d_abs"), log_variance_ratio("diff").alias("diff_logvar"), log_variance_ratio("diff2").alias("diff2_logvar"))


def welch(samples: DataFrame, points: DataFrame, early: int | None = None) -> DataFrame:
    """Welch's t, its degrees of freedom, two-sided p, and Cohen's d for level and squared differences; early: of the first points after the pivot_t only."""
    rows = around(samples, points)
    if early is not None:
        rows = rows.where(F.col("t") < F.col("pivot_t") + early)
    return _welch_tests(rows.groupBy(*KEY).agg(*[m for name, value in SQUARED.items() for m in moments(F.expr(value), name)]))


def welch_many(samples: DataFrame, points: DataFrame) -> DataFrame:
    """welch at any number of pivots (channel, segment, pivot_t) a segment, whose samples are read once.

    The pivots cut a segment into pieces. A piece is counted, averaged and squared off once, and a pivot's sides are sums of pieces: a
    join of pivots with pieces, of no more rows than their product.
    """
    by, empty = ["channel", "segment"], F.lit(None).cast("double")
    points = points.select(*KEY).distinct()
    cuts = points.select(*by, F.col("pivot_t").alias("t"), *[empty.alias(c) for c in ("value", "d", "d2")], F.lit(1).alias("cut"))
    rows = differences(samples.join(F.broadcast(points.select(*by).distinct()), by, "left_semi")).where(F.col("t") >= BURN_IN)
    line = rows.select(*by, "t", F.col("value").cast("double").alias("value"), "d", "d2", F.lit(0).alias("cut")).unionByName(cuts)
    line = line.withColumn("piece", F.sum("cut").over(Window.partitionBy(*by).orderBy("t", F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0)))
    sums = [f(F.expr(value)).alias(f"{name}_{what}") for name, value in SQUARED.items() for what, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))]
    pieces = line.groupBy(*by, "piece").agg(*sums)
    numbered = points.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("pivot_t")))
    met = numbered.join(pieces, by).withColumn("post", F.col("piece") >= F.col("place"))
    n, mean = (lambda name: F.col(f"{name}_n")), (lambda name: F.col(f"{name}_n") * F.col(f"{name}_mean"))
    # a window, not a join with itself: the pieces, and the sort of all samples behind them, are made once
    whole = Window.partitionBy(*KEY)
    both = met.select("*", *[F.try_divide(F.sum(_side(mean(name), post)).over(whole), F.sum(_side(n(name), post)).over(whole)).alias(f"{name}_mean_{side}") for name in SQUARED for side, post in (("pre", False), ("post", True))])
    out = []
    for name in SQUARED:
        for side, post in (("pre", False), ("post", True)):
            centre, count = F.col(f"{name}_mean_{side}"), F.coalesce(F.sum(_side(n(name), post)), F.lit(0))
            spread = n(name) * (F.col(f"{name}_var") + (F.col(f"{name}_mean") - centre) * (F.col(f"{name}_mean") - centre))
            out += [count.alias(f"{name}_n_{side}"), F.first(centre).alias(f"{name}_mean_{side}"), F.when(count > 1, F.sum(_side(spread, post)) / (count - 1)).alias(f"{name}_var_{side}")]
    return _welch_tests(both.groupBy(*KEY).agg(*out))


def _welch_tests(sums: DataFrame) -> DataFrame:
    out = []
    for name in SQUARED:
        n0, n1 = F.col(f"{name}_n_pre"), F.col(f"{name}_n_post")
        a, b = F.col(f"{name}_var_pre") / n0, F.col(f"{name}_var_post") / n1
        enough = (n0 >= LEAST_POINTS) & (n1 >= LEAST_POINTS) & (a + b > 0)
        out.append(F.when(enough, (F.col(f"{name}_mean_post") - F.col(f"{name}_mean_pre")) / F.sqrt(a + b)).alias(f"{name}_t"))
        out.append(F.when(enough, (a + b) * (a + b) / (a * a / (n0 - 1) + b * b / (n1 - 1))).alias(f"{name}_df"))
        out.append(F.when(enough, cohen_d(name)).alias(f"{name}_d"))
    return sums.select(*KEY, *out).select("*", *[distributions.t_sf2(f"{name}_t", f"{name}_df").alias(f"{name}_p") for name in SQUARED])


def standardised(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Each sample's |z| against the mean and deviation before the pivot_t, for level, diff and diff2."""
    rows = around(samples, points)
    before = Window.partitionBy(*KEY)
    out = rows
    for name, value in (("level", "value"), ("diff", "d"), ("diff2", "d2")):
        mean, spread = F.avg(_side(F.col(value), False)).over(before), F.stddev_samp(_side(F.col(value), False)).over(before)
        out = out.withColumn(f"{name}_z", F.when(spread > 0, F.abs(F.col(value) - mean) / F.when(spread > 0, spread)))
    return out


def crossing_times(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Samples from the pivot_t to the first |z| over the limit, null if none."""
    rows = standardised(samples, points).where("post")
    first = [F.min(F.when(F.col(f"{s}_z") > Z_LIMIT, F.col("t") - F.col("pivot_t"))).alias(f"{s}_cross") for s in ("level", "diff", "diff2")]
    return rows.groupBy(*KEY).agg(*first)


def peak_scores(samples: DataFrame, points: DataFrame) -> DataFrame:
    """Largest |z| among the first samples from the pivot_t on."""
    rows = standardised(samples, points).where(F.col("post") & (F.col("t") < F.col("pivot_t") + PEAK))
    return rows.groupBy(*KEY).agg(*[F.max(f"{s}_z").alias(f"{s}_peak") for s in ("level", "diff", "diff2")])


def nominal_z(samples: DataFrame) -> DataFrame:
    """z of each sample against its channel's nominal mean and deviation."""
    stats = samples.where("anomaly = 0").groupBy("channel").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread")).where("spread > 0")
    return samples.join(F.broadcast(stats), "channel").withColumn("z", (F.col("value") - F.col("mean")) / F.col("spread"))


def cusum(samples: DataFrame, k: float = 0.5) -> DataFrame:
    """Largest upper and lower CUSUM of a segment: a running sum less its running minimum."""
    rows = nominal_z(samples)
    for name, value in (("up", F.col("z") - k), ("down", -F.col("z") - k)):
        rows = rows.withColumn(f"{name}_sum", F.sum(value).over(in_segment()))
        rows = rows.withColumn(name, F.col(f"{name}_sum") - F.least(F.lit(0.0), F.min(f"{name}_sum").over(in_segment())))
    return rows.groupBy("channel", "segment").agg(F.max("up").alias("cusum_up"), F.max("down").alias("cusum_down"))


def individuals_chart(samples: DataFrame) -> DataFrame:
    """Individuals and moving-range chart: samples outside mean +- 2.66 and above 3.267 mean moving ranges."""
    rows = samples.withColumn("range", F.abs(F.col("value") - F.lag("value").over(in_segment())))
    whole = Window.partitionBy("channel", "segment")
    rows = rows.withColumn("centre", F.avg("value").over(whole)).withColumn("mean_range", F.avg("range").over(whole))
    outside = F.abs(F.col("value") - F.col("centre")) > 2.66 * F.col("mean_range")
    return rows.groupBy("channel", "segment").agg(F.count_if(outside).alias("n_individual"), F.count_if(F.col("range") > 3.267 * F.col("mean_range")).alias("n_range"))
