"""Random-effects meta-analysis (DerSimonian and Laird), with every study left out in turn."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.functions import distributions


def effect_variance(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean effect yi and its squared standard error vi; null below two values or without spread."""
    sums = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("yi"), (F.var_samp(value) / F.count(value)).alias("vi"), F.count(value).alias("n"))
    return sums.withColumn("vi", F.when((F.col("n") >= 2) & (F.col("vi") > 0), F.col("vi")))


def pooled(studies: DataFrame, by: list[str]) -> DataFrame:
    """Pooled effect, its interval, z and p, Q and its p, tau2 and I2 with its band of each group of studies (yi, vi); null with a single study."""
    good = studies.where("yi IS NOT NULL AND vi > 0")
    one = good.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("vi")).alias("w"), F.sum(F.col("yi") / F.col("vi")).alias("wy"), F.sum(1 / (F.col("vi") * F.col("vi"))).alias("w2"))
    rows = good.join(one, by).withColumn("off", F.col("yi") - F.col("wy") / F.col("w"))
    two = rows.groupBy(*by).agg(F.sum(F.col("off") * F.col("off") / F.col("vi")).alias("q"), F.first("k").alias("k"), F.first("w").alias("w"), F.first("w2").alias("w2"))
    tau2 = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("q") - (F.col("k") - 1), F.col("w") - F.col("w2") / F.col("w")), F.lit(0.0)))
    rows = good.join(two.select(*by, "k", "q", tau2.alias("tau2")), by)
    out = rows.groupBy(*by).agg(
        F.first("k").alias("k"),
        F.first("q").alias("q"),
        F.first("tau2").alias("tau2"),
        (F.sum(F.col("yi") / (F.col("vi") + F.col("tau2"))) / F.sum(1 / (F.col("vi") + F.col("tau2")))).alias("mu"),
        (1 / F.sqrt(F.sum(1 / (F.col("vi") + F.col("tau2"))))).alias("se"),
    )
    many = F.col("k") >= 2
    out = out.withColumn("z", F.when(many, F.try_divide("mu", "se")))
    i2 = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), F.try_divide(F.col("q") - (F.col("k") - 1), F.col("q"))) * 100).otherwise(0.0)
    return out.select(*by, "k", *[F.when(many, c).alias(n) for n, c in (("q", F.col("q")), ("tau2", F.col("tau2")), ("mu", F.col("mu")), ("se", F.col("se")), ("low", F.col("mu") - 1.96 * F.col("se")), ("high", F.col("mu") + 1.96 * F.col("se")), ("i2", i2))]).join(out.select(*by, "z", (2 * distributions.normal_sf(F.abs("z"))).alias("p_value"), distributions.chi2_sf(F.when(many, F.col("q")), F.col("k") - 1).alias("p_q"), band(F.when(many, i2)).alias("i2_band")), by)


def band(i2):
    """How much of the spread is between studies: bands of I2 at 25, 50 and 75."""
    return F.when(i2.isNull(), "undecidable").when(i2 < 25, "low").when(i2 < 50, "moderate").when(i2 < 75, "high").otherwise("very high")


def study_weights(studies: DataFrame, by: list[str], study: str) -> DataFrame:
    """Each study's interval, and its share in percent of the pooled effect's weight."""
    good = studies.where("yi IS NOT NULL AND vi > 0").join(pooled(studies, by).select(*by, "tau2"), by)
    total = F.sum(1 / (F.col("vi") + F.col("tau2"))).over(Window.partitionBy(*by))
    se = F.sqrt("vi")
    return good.select(*by, study, "yi", "vi", (F.col("yi") - 1.96 * se).alias("low"), (F.col("yi") + 1.96 * se).alias("high"), (100 / (F.col("vi") + F.col("tau2")) / total).alias("weight_percent"))


def arcsine(p):
    return F.asin(F.sqrt(F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))))


def from_arcsine(x):
    return F.pow(F.sin(F.least(F.greatest(x, F.lit(0.0)), F.lit(math.pi / 2))), F.lit(2.0))


def pooled_share(rows: DataFrame, by: list[str], study: str, share: str) -> DataFrame:
    """pooled() of shares on the arcsine scale, and the pooled share with its interval on the shares' own."""
    out = pooled(effect_variance(rows.withColumn("x", arcsine(F.col(share))), [*by, study], "x"), by)
    return out.select(*by, "k", F.col("mu").alias("arcsine_mu"), from_arcsine(F.col("mu")).alias("share"), from_arcsine(F.col("low")).alias("share_low"), from_arcsine(F.col("high")).alias("share_high"), "q", "tau2", "i2", "i2_band", "p_value", "p_q")


def influence_summary(flags: DataFrame, study: str = "excluded") -> DataFrame:
    """How many of a study's tests flag it as influential."""
    return flags.groupBy(study).agg(F.count_if("influential").alias("n_influential"), F.count(F.lit(1)).alias("n_tests"), F.avg(F.col("influential").cast("double")).alias("share_influential"))


def left_out(studies: DataFrame, by: list[str], study: str) -> DataFrame:
    """pooled() for every study left out, and for none (excluded is null), in one job."""
    names = studies.select(*by, F.col(study).alias("excluded")).distinct()
    names = names.union(studies.select(*by, F.lit(None).cast("string").alias("excluded")).distinct())
    rows = studies.join(names, by).where(F.col("excluded").isNull() | (F.col("excluded") != F.col(study))).withColumn("excluded", F.coalesce("excluded", F.lit("(none)")))
    return pooled(rows, [*by, "excluded"])
