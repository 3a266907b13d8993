"""Uncertain onsets: draws from the detector's last posterior, what they say of effects, and placebo pivots that are timed like them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.functions.random import uniform
from alarmlens.operators import effects

# Fixed values of the method.
DRAWS, SIGNIFICANT = 200, 0.05
LEAST_HIGH, LEAST_MEDIUM = 100, 30
MOST_NORMAL, PLACEBO_DRAWS = 300, 5
SERIES = ("level", "diff", "diff2")
SEGMENT = ("channel", "segment")


def drawn(found: DataFrame, draws: int = DRAWS) -> DataFrame:
    """(channel, segment, draw, onset): onsets drawn with replacement from each segment's candidates, by inverse cumulative probability.

    Candidates and draws lie on one line by cumulative probability, where a draw takes the next candidate (the last, if
    rounding leaves it beyond). Segments without candidates have no draws.
    """
    rows = found.where(F.size("candidates") > 0)
    order = Window.partitionBy(*SEGMENT).orderBy("onset")
    candidates = rows.select(*SEGMENT, F.inline("candidates")).select(*SEGMENT, F.lit(None).cast("long").alias("draw"), F.sum("p").over(order).alias("at"), "onset")
    picks = rows.select(*SEGMENT, F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))).alias("draw"))
    picks = picks.select(*SEGMENT, "draw", uniform("mc", "channel", "segment", "draw").alias("at"), F.lit(None).cast("long").alias("onset"))
    # from the far end: a frame up to the last row would be summed anew for each row
    ahead = Window.partitionBy(*SEGMENT).orderBy(F.desc("at"), F.desc(F.col("draw").isNull())).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = candidates.unionByName(picks).withColumn("next", F.coalesce(F.min("onset").over(ahead), F.max("onset").over(Window.partitionBy(*SEGMENT))))
    return line.where("draw IS NOT NULL").select(*SEGMENT, "draw", F.col("next").alias("onset"))


def draw_effects(samples: DataFrame, draws: DataFrame) -> DataFrame:
    """Each draw with Welch's d and p of all series at its onset; each distinct onset is tested once."""
    points = draws.select(*SEGMENT, F.col("onset").alias("pivot_t")).distinct()
    tests = effects.welch_many(samples, points).select(*SEGMENT, F.col("pivot_t").alias("onset"), *[f"{s}_{c}" for s in SERIES for c in ("d", "p")])
    return draws.join(tests, [*SEGMENT, "onset"], "left")


def tier(n: Column) -> Column:
    return F.when(n == 0, "excluded").when(n >= LEAST_HIGH, "high").when(n >= LEAST_MEDIUM, "medium").otherwise("low")


def segment_summary(draws: DataFrame, segments: DataFrame) -> DataFrame:
    """For each of segments (channel, segment, n_points): its draws, their spread, and by series the signed and absolute effects, how often they agree in sign, and the share of significant ones."""
    parts = [F.count(F.lit(1)).alias("n_draws"), F.stddev_pop("onset").alias("onset_sd")]
    for s in SERIES:
        d, p = F.col(f"{s}_d"), F.col(f"{s}_p")
        up, down = F.count_if(d > 0), F.count_if(d < 0)
        parts += [
            F.median(d).alias(f"{s}_signed"),
            F.percentile(F.abs(d), F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975))).alias(f"{s}_sizes"),
            F.try_divide(F.greatest(up, down).cast("double"), up + down).alias(f"{s}_consistency"),
            F.avg((p < SIGNIFICANT).cast("double")).alias(f"{s}_significant"),
        ]
    rows = segments.join(draws.groupBy(*SEGMENT).agg(*parts), list(SEGMENT), "left").withColumn("n_draws", F.coalesce("n_draws", F.lit(0)))
    columns = [c for s in SERIES for c in (F.col(f"{s}_signed"), F.col(f"{s}_sizes")[0].alias(f"{s}_size"), F.col(f"{s}_sizes")[1].alias(f"{s}_low"), F.col(f"{s}_sizes")[2].alias(f"{s}_high"), F.col(f"{s}_consistency"), F.col(f"{s}_significant"))]
    return rows.select(*SEGMENT, "n_points", "n_draws", "onset_sd", tier(F.col("n_draws")).alias("tier"), *columns)


def channel_summary(summary: DataFrame) -> DataFrame:
    """Reliable segments' values by channel: plain means of the significant share, means weighted by draws, and the shares of positive and negative segments."""
    good = F.col("tier").isin("high", "medium")
    weight = F.when(good, F.col("n_draws").cast("double"))
    parts = [F.count(F.lit(1)).alias("n_segments"), F.count_if(good).alias("n_reliable"), F.count_if(~good).alias("n_excluded")]
    for s in SERIES:
        signed = F.when(good, F.col(f"{s}_signed"))
        up, down = F.count_if(signed > 0), F.count_if(signed < 0)
        parts.append(F.avg(F.when(good, F.col(f"{s}_significant"))).alias(f"{s}_significant_mean"))
        for c in ("significant", "size", "signed", "consistency"):
            x = F.col(f"{s}_{c}")
            parts.append(F.try_divide(F.sum(weight * x), F.sum(F.when(x.isNotNull(), weight))).alias(f"{s}_{c}_weighted"))
        parts += [F.try_divide(up.cast("double"), up + down).alias(f"{s}_positive"), F.try_divide(down.cast("double"), up + down).alias(f"{s}_negative")]
    return summary.groupBy("channel").agg(*parts)


def tier_table(summary: DataFrame) -> DataFrame:
    return summary.groupBy("channel").pivot("tier", ["high", "medium", "low", "excluded"]).count().fillna(0)


def canonical(draws: DataFrame, summary: DataFrame) -> DataFrame:
    """(channel, segment, pivot_t): the draws' median, half to even, of the reliable segments."""
    reliable = summary.where(F.col("tier").isin("high", "medium")).select(*SEGMENT)
    middle = draws.join(reliable, list(SEGMENT), "left_semi").groupBy(*SEGMENT).agg(F.bround(F.median("onset")).cast("long").alias("pivot_t"))
    return middle


def usable(points: DataFrame, segments: DataFrame) -> DataFrame:
    """points with n_points, ratio and skip_reason, by whether enough samples lie on both sides."""
    low = effects.BURN_IN + effects.LEAST_POINTS
    rows = points.join(segments.select(*SEGMENT, "n_points"), list(SEGMENT))
    good = (F.col("pivot_t") >= low) & (F.col("pivot_t") <= F.col("n_points") - effects.LEAST_POINTS)
    return rows.withColumn("ratio", F.col("pivot_t") / F.col("n_points")).withColumn("skip_reason", F.when(good, "").otherwise("pivot_out_of_range"))


def placebo(points: DataFrame, normal: DataFrame, stream: str, draws: int, most: int = MOST_NORMAL, by_channel: bool = True) -> DataFrame:
    """(channel, segment, draw, pivot_t) for normal segments (channel, segment, n_points): ratios drawn with replacement from the observed onsets' ratios.

    The pool is of the same channel, or of all. Of a channel's normal segments, most are taken, by a hash of their names: that is
    the method's sample. The drawn ratio is met by its number in the pool. Pivots too near an end are left out.
    """
    pool = Window.partitionBy(*(["channel"] if by_channel else [])).orderBy(*SEGMENT)
    whole = Window.partitionBy(*(["channel"] if by_channel else []))
    ratios = points.select(F.col("channel"), F.col("ratio"), (F.row_number().over(pool) - 1).alias("number"), F.count(F.lit(1)).over(whole).alias("size"))
    order = F.row_number().over(Window.partitionBy("channel").orderBy(uniform(f"{stream}-order", *SEGMENT), *SEGMENT))
    kept = normal.withColumn("place", order).where(F.col("place") <= most).drop("place")
    each = kept.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))))
    on = ["channel"] if by_channel else []
    sizes = ratios.select(*on, "size").distinct()
    each = (each.join(sizes, on) if on else each.crossJoin(sizes)).withColumn("number", F.floor(uniform(stream, *SEGMENT, "draw") * F.col("size")).cast("int"))
    met = each.join(ratios.select(*on, "number", "ratio"), [*on, "number"])
    low = effects.BURN_IN + effects.LEAST_POINTS
    high = F.greatest(F.col("n_points") - effects.LEAST_POINTS, F.lit(low))
    pivot_t = F.least(F.greatest(F.bround(F.col("ratio") * F.col("n_points")).cast("long"), F.lit(low)), high)
    rows = met.select(*SEGMENT, "draw", "n_points", pivot_t.alias("pivot_t"))
    return rows.where(F.col("pivot_t") <= F.col("n_points") - effects.LEAST_POINTS).drop("n_points")
