"""Channel profiles, noise estimates and their shrinkage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from alarmlens.sources.telemetry import differences

# Fixed values of the method.
QUANTISED_SHARE, FLOAT_NOISE_STEP = 0.10, 1e-6
NOISE_FLOOR, LOG_FLOOR = 1e-14, 1e-12
MAD_SCALE = 1.4826


def channel_profile(samples: DataFrame) -> DataFrame:
    """Share of zero differences, least and lower-quartile step, points, and the channel's type, over nominal samples."""
    rows = differences(samples.where("anomaly = 0"))
    step = F.when(F.col("d") != 0, F.abs("d"))
    stats = rows.groupBy("channel").agg(
        F.avg((F.col("d") == 0).cast("double")).alias("frac_zero"),
        F.min(step).alias("min_step"),
        F.percentile(step, F.lit(0.25)).alias("quantization_step"),
        F.count(F.lit(1)).alias("n_points"),
    )
    kind = (
        F.when(F.col("frac_zero").isNull(), "unknown")
        .when(F.col("frac_zero") >= QUANTISED_SHARE, "quantized")
        .when(F.col("min_step") < FLOAT_NOISE_STEP, "float_noise")
        .otherwise("continuous")
    )
    return stats.withColumn("channel_type", kind)


def second_differences(rows: DataFrame) -> DataFrame:
    """(channel, dd): differences of all first differences of a channel in order of segment and t.

    Those inside segments come from windows over segments; those across two segments from one row a segment, so that no
    task gets a whole channel.
    """
    inner = rows.where("d2 IS NOT NULL").select("channel", F.col("d2").alias("dd"))
    ends = rows.where("d IS NOT NULL").groupBy("channel", "segment").agg(F.min_by("d", "t").alias("first"), F.max_by("d", "t").alias("last"))
    across = ends.select("channel", (F.col("first") - F.lag("last").over(Window.partitionBy("channel").orderBy("segment"))).alias("dd"))
    return inner.union(across.where("dd IS NOT NULL"))


def noise_simple(samples: DataFrame) -> DataFrame:
    """r = var(d) / 2 and q = var(dd) / 6 (population variances), with a floor."""
    rows = differences(samples.where("anomaly = 0"))
    first = rows.groupBy("channel").agg((F.var_pop("d") / 2).alias("r"), F.count("d").alias("n_diff"))
    second = second_differences(rows).groupBy("channel").agg((F.var_pop("dd") / 6).alias("q"), F.count("dd").alias("n_dd"))
    q = F.when(F.coalesce("n_dd", F.lit(0)) <= 1, F.lit(NOISE_FLOOR)).otherwise(F.greatest("q", F.lit(NOISE_FLOOR)))
    return first.join(second, "channel", "left").select("channel", F.greatest(F.coalesce("r", F.lit(NOISE_FLOOR)), F.lit(NOISE_FLOOR)).alias("r"), q.alias("q"), "n_diff")


def zero_inflated_variance(rows: DataFrame, value: str) -> DataFrame:
    """(channel, variance): the share of non-zero values times their MAD variance; null below two values."""
    stats = rows.where(F.col(value).isNotNull()).groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(value) != 0).cast("double")).alias("p"), F.median(F.when(F.col(value) != 0, F.col(value))).alias("centre"), F.count_if(F.col(value) != 0).alias("n1"))
    off = rows.where(F.col(value) != 0).join(F.broadcast(stats.select("channel", "centre")), "channel").groupBy("channel").agg(F.median(F.abs(F.col(value) - F.col("centre"))).alias("mad"), F.max(F.abs(value)).alias("only"))
    variance = F.when(F.col("n") < 2, None).when(F.col("p") == 0, F.lit(0.0)).when(F.col("n1") == 1, F.col("p") * F.pow("only", F.lit(2.0))).otherwise(F.col("p") * F.pow(F.lit(MAD_SCALE) * F.col("mad"), F.lit(2.0)))
    return stats.join(off, "channel", "left").select("channel", variance.alias("variance"), "n")


def noise_mixture(samples: DataFrame) -> DataFrame:
    """r and q from zero-inflated robust variances."""
    rows = differences(samples.where("anomaly = 0"))
    r = zero_inflated_variance(rows, "d").select("channel", F.greatest(F.col("variance") / 2, F.lit(NOISE_FLOOR)).alias("r"), F.col("n").alias("n_diff"))
    q = zero_inflated_variance(second_differences(rows), "dd").select("channel", F.greatest(F.col("variance") / 6, F.lit(NOISE_FLOOR)).alias("q"))
    return r.join(q, "channel", "left").select("channel", "r", F.coalesce("q", F.lit(NOISE_FLOOR)).alias("q"), "n_diff")


ESTIMATORS = {"simple": noise_simple, "mixture": noise_mixture}


def estimated(samples: DataFrame, estimator: str) -> DataFrame:
    """Noise by the named estimator. A channel without nominal differences has the floors, and n_diff 0."""
    if estimator not in ESTIMATORS:
        raise ValueError(f"no estimator {estimator!r}; there are {sorted(ESTIMATORS)}")
    rows = samples.select("channel").distinct().join(ESTIMATORS[estimator](samples), "channel", "left")
    return rows.select("channel", F.coalesce("r", F.lit(NOISE_FLOOR)).alias("r"), F.coalesce("q", F.lit(NOISE_FLOOR)).alias("q"), F.coalesce("n_diff", F.lit(0)).alias("n_diff"))


def shrink(variances: DataFrame, value: str, n: str) -> DataFrame:
    """Adds shrunk and weight: variances drawn to their common level on the log scale (one row a channel)."""
    every = Window.partitionBy()
    se2 = 2 / (F.greatest(F.col(n), F.lit(2)) - 1)
    rows = variances.withColumn("l", F.ln(F.greatest(F.col(value), F.lit(LOG_FLOOR)))).withColumn("se2", se2).withColumn("w", 1 / F.col("se2"))
    rows = rows.withColumn("g", F.sum(F.col("w") * F.col("l")).over(every) / F.sum("w").over(every)).withColumn("k", F.count(F.lit(1)).over(every))
    spread = F.sum(F.col("w") * (F.col("l") - F.col("g")) * (F.col("l") - F.col("g"))).over(every)
    scale = F.sum("w").over(every) - F.sum(F.col("w") * F.col("w")).over(every) / F.sum("w").over(every)
    rows = rows.withColumn("tau2", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(spread - (F.col("k") - 1), scale), F.lit(0.0))))
    weight = F.when(F.col("k") == 1, F.lit(1.0)).otherwise(F.col("tau2") / (F.col("tau2") + F.col("se2")))
    rows = rows.withColumn("weight", weight).withColumn("shrunk", F.exp(F.col("weight") * F.col("l") + (1 - F.col("weight")) * F.col("g")))
    return rows.drop("l", "se2", "w", "g", "k", "tau2")


def kalman(samples: DataFrame, noise: DataFrame) -> DataFrame:
    """Innovations nu and their variances s of a local-linear-trend filter, per sample, for segments joined with (channel, r, q).

    Segments stream through a task in order; it holds a filter's five numbers. A missing value has no innovation and moves nothing.
    """
    rows = samples.join(noise.select("channel", "r", "q"), "channel").select("channel", "segment", "t", "value", "r", "q")
    schema = T.StructType([*rows.select("channel", "segment").schema.fields, *T.StructType.fromDDL("t long, nu double, s double").fields])
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from alarmlens.operators.bocpd import Filter  # which imports this module

        key = filtered = None
        for batch in batches:
            made = []
            for name, y, r, q in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), *(batch.column(k).to_pylist() for k in (3, 4, 5))):
                if name != key:
                    key, filtered = name, Filter(r, q) if r is not None and q is not None else None
                made.append(filtered.step(y) if filtered and y is not None else (None, None))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(out.field(k).type) for k in range(3)), *(pa.array(x, pa.float64()) for x in zip(*made))], schema=out) if made else pa.RecordBatch.from_pylist([], schema=out)

    return rows.repartition("channel", "segment").sortWithinPartitions("channel", "segment", "t").mapInArrow(run, schema)
