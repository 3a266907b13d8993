"""Rank tests, contingency tests and corrections; each is a grouped aggregation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.functions import distributions
from alarmlens.operators.running import running


def mid_rank(by: list[str], value: str) -> Column:
    """Average rank of ties, inside each group of by."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / F.lit(2.0)


def mann_whitney(rows: DataFrame, by: list[str], value: str, positive: str, least: int = 5, two_sided: bool = False) -> DataFrame:
    """U of the positive group, z with tie and continuity corrections, and p for `greater` or both sides; null below least a side.

    p is exact for a side of at most eight without ties, else normal. Equal values are counted first, so a rank is a running
    count over distinct values.
    """
    rows = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(F.col(positive)).alias("p"), F.count(F.lit(1)).alias("c"))
    below = F.sum("c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("c") + 1) / F.lit(2.0))
    sums = rows.groupBy(*by).agg(F.sum(F.col("p") * F.col("rank")).alias("r1"), F.sum("p").alias("n1"), F.sum("c").alias("n"), F.sum((F.col("c") * F.col("c") * F.col("c") - F.col("c")).cast("double")).alias("ties"))
    n1, n0 = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = n1 * n0 / 12 * ((F.col("n") + 1) - F.try_divide(F.col("ties"), (F.col("n") * (F.col("n") - 1)).cast("double")))
    enough = (n1 >= least) & (n0 >= least)
    off = F.abs(u - n1 * n0 / 2) if two_sided else u - n1 * n0 / 2
    z = F.when(enough & (spread > 0), F.try_divide(off - 0.5, F.sqrt(F.when(spread > 0, spread))))
    exact = enough & (F.col("ties") == 0) & (F.least(n1, n0) <= distributions.EXACT_SIDE) & (n1 * n0 <= distributions.EXACT_PRODUCT)
    out = sums.select(*by, "n1", n0.cast("long").alias("n0"), F.when(enough, u).alias("u"), z.alias("z"), F.when(enough, F.when(exact, "exact").otherwise("normal")).alias("method"), F.when(exact, F.greatest(u, n1 * n0 - u) if two_sided else u).alias("ue"))
    p = F.when(F.col("method") == "exact", distributions.exact_rank_sum("ue", "n1", "n0")).otherwise(distributions.normal_sf("z"))
    return out.select(*by, "n1", "n0", "u", "z", "method", (F.when(p.isNotNull(), F.least(2 * p, F.lit(1.0))) if two_sided else p).alias("p_value"))


def wilcoxon(rows: DataFrame, by: list[str], difference: str, least: int = 5) -> DataFrame:
    """Signed-rank statistic min(W+, W-), z and two-sided p of differences, zeros dropped; null below least of them.

    n_pairs, median and share_before (differences below 0) are of all differences. p is exact for at most fifty without ties.
    """
    rows = rows.where(F.col(difference).isNotNull())
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.median(difference).alias("median_difference"), F.avg((F.col(difference) < 0).cast("double")).alias("share_before"))
    rows = rows.where(F.col(difference) != 0).withColumn("size", F.abs(difference))
    rows = rows.groupBy(*by, "size").agg(F.count_if(F.col(difference) > 0).alias("p"), F.count(F.lit(1)).alias("c"))
    below = F.sum("c").over(Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("c") + 1) / F.lit(2.0))
    c = F.col("c")
    sums = rows.groupBy(*by).agg(F.sum(F.col("p") * F.col("rank")).alias("plus"), F.sum((c - F.col("p")) * F.col("rank")).alias("minus"), F.sum("c").alias("n"), F.sum((c * c * c - c).cast("double")).alias("ties"))
    n = F.col("n").cast("double")
    spread = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    enough = n >= least
    w = F.when(enough, F.least("plus", "minus"))
    exact = (F.col("ties") == 0) & (n <= distributions.EXACT_PAIRS)
    out = sums.select(*by, "n", w.alias("w"), F.when(enough, (w - n * (n + 1) / 4) / F.sqrt(spread)).alias("z"), F.when(exact, w).alias("we"))
    p = F.coalesce(distributions.exact_signed_rank("we", "n"), F.when(F.col("z").isNotNull(), F.least(2 * distributions.normal_sf(F.abs("z")), F.lit(1.0))))
    return whole.join(out.select(*by, "n", "w", "z", p.alias("p_value")), by, "left")


def two_proportion_z(table: DataFrame) -> DataFrame:
    """z and two-sided p of two shares a/(a+b) and c/(c+d), pooled; null where a side is empty or the spread is 0."""
    n1, n2 = F.col("a") + F.col("b"), F.col("c") + F.col("d")
    pooled = F.try_divide((F.col("a") + F.col("c")).cast("double"), n1 + n2)
    spread = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))
    difference = F.try_divide(F.col("a").cast("double"), n1) - F.try_divide(F.col("c").cast("double"), n2)
    return table.withColumn("z", F.when(spread > 0, difference / F.sqrt(F.when(spread > 0, spread)))).withColumn("p_value", 2 * distributions.normal_sf(F.abs("z")))


def mantel_haenszel(tables: DataFrame) -> DataFrame:
    """Cochran-Mantel-Haenszel chi-square with continuity correction, its p, and the common odds ratio, over strata (a, b, c, d)."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    good = tables.where((F.col("a") + F.col("b") + F.col("c") + F.col("d")) >= 2)
    sums = good.agg(
        F.sum(a - (a + b) * (a + c) / n).alias("off"),
        F.sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).alias("var"),
        F.sum(a * d / n).alias("ad"),
        F.sum(b * c / n).alias("bc"),
    )
    shift = F.abs("off") - 0.5
    out = sums.select(F.when(F.col("var") > 0, F.try_divide(shift * shift, F.col("var"))).alias("chi2"), F.try_divide(F.col("ad"), F.col("bc")).alias("odds_ratio"))
    return out.withColumn("p_value", 2 * distributions.normal_sf(F.sqrt("chi2")))


def binomial_not_top(rows: DataFrame, feature: str, others: list[str], p0: float = 2 / 3) -> DataFrame:
    """How many rows don't have feature as their (or a tied) largest value, and P(X >= that) of as many trials with chance p0."""
    counts = rows.agg(F.count_if(~(F.col(feature) >= F.greatest(*others))).alias("n_not_top"), F.count(F.lit(1)).alias("n"))
    terms = counts.where("n > 0").withColumn("k", F.explode(F.sequence("n_not_top", "n")))
    # the binomial coefficient as a product of ratios, in logarithms
    choose = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest("k", F.lit(1))), F.lit(0.0), lambda acc, i: acc + F.when(F.col("k") > 0, F.ln((F.col("n") - F.col("k") + i) / i)).otherwise(0.0))
    return terms.groupBy("n_not_top", "n").agg(F.sum(F.exp(choose + F.col("k") * math.log(p0) + (F.col("n") - F.col("k")) * math.log1p(-p0))).alias("p_value"))


def spearman_exact(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's rho of at most eight rows, and the share of all orders of y with an |rho| as large."""
    ranked = rows.select(mid_rank([], x).alias("a"), mid_rank([], y).alias("b"))
    arrays = ranked.agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("x")).where(F.size("x").between(2, 8))
    arrays = arrays.select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.size("x").alias("n"))
    orders = arrays.select("a", "b", "n", F.array(F.array().cast("array<int>")).alias("found"))
    grown = orders.withColumn("orders", F.expr("aggregate(sequence(1, n), found, (acc, k) -> flatten(transform(acc, o -> transform(filter(sequence(0, n - 1), i -> NOT array_contains(o, i)), i -> concat(o, array(i))))))"))
    rho = "aggregate(sequence(0, n - 1), 0D, (s, i) -> s + (a[i] - (n + 1) / 2D) * (b[{}] - (n + 1) / 2D))"
    each = grown.select("a", "b", "n", F.explode("orders").alias("o")).select(F.expr(rho.format("o[i]")).alias("s"), F.expr(rho.format("i")).alias("s0"), F.expr("sqrt(aggregate(a, 0D, (s, v) -> s + (v - (n + 1) / 2D) * (v - (n + 1) / 2D)) * aggregate(b, 0D, (s, v) -> s + (v - (n + 1) / 2D) * (v - (n + 1) / 2D)))").alias("scale"))
    return each.agg(F.try_divide(F.max("s0"), F.max("scale")).alias("rho"), F.count(F.lit(1)).alias("n_orders"), F.avg((F.abs("s") >= F.abs("s0") - 1e-9).cast("double")).alias("p_value"))


def bonferroni(rows: DataFrame, p: str, family: list[str] | None = None) -> DataFrame:
    """Adds p_bonferroni over all non-null p values, or over those of each family."""
    if family:
        return rows.withColumn("p_bonferroni", F.when(F.col(p).isNotNull(), F.least(F.col(p) * F.count(p).over(Window.partitionBy(*family)), F.lit(1.0))))
    return rows.crossJoin(F.broadcast(rows.agg(F.count(p).alias("tests")))).withColumn("p_bonferroni", F.when(F.col(p).isNotNull(), F.least(F.col(p) * F.col("tests"), F.lit(1.0)))).drop("tests")


def benjamini_hochberg(rows: DataFrame, p: str) -> DataFrame:
    """Adds q_value over non-null p values of one family, which is small. Equal p values have equal q values."""
    good = rows.where(F.col(p).isNotNull())
    rank, m = F.row_number().over(Window.partitionBy().orderBy(p)), F.count(F.lit(1)).over(Window.partitionBy())
    raised = good.withColumn("raw", F.col(p) * m / rank)
    return raised.withColumn("q_value", F.least(F.lit(1.0), F.min("raw").over(Window.partitionBy().orderBy(F.desc(p))))).drop("raw")


def kendall_w(rows: DataFrame, rater: str, item: str, value: str) -> DataFrame:
    """Kendall's W (not corrected for ties), chi-square and its p, of raters' mid-ranks of items."""
    ranked = rows.withColumn("rank", mid_rank([rater], value))
    sums = ranked.groupBy(item).agg(F.sum("rank").alias("total"), F.count(F.lit(1)).alias("m"))
    stats = sums.agg((F.var_pop("total") * F.count(F.lit(1))).alias("s"), F.max("m").cast("double").alias("m"), F.count(F.lit(1)).cast("double").alias("k"))
    w = 12 * F.col("s") / (F.col("m") * F.col("m") * (F.pow("k", F.lit(3.0)) - F.col("k")))
    out = stats.select(w.alias("w"), (F.col("m") * (F.col("k") - 1) * w).alias("chi2"), (F.col("k") - 1).alias("df"))
    return out.select("w", "chi2", distributions.chi2_sf("chi2", "df").alias("p_value"))


def wilson(rows: DataFrame, hits: str, n: str, z: float = 1.96) -> DataFrame:
    p, m = F.col(hits) / F.col(n), F.col(n).cast("double")
    centre, half = (p + z * z / (2 * m)) / (1 + z * z / m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return rows.withColumn("low", centre - half).withColumn("high", centre + half)


def auroc(rows: DataFrame, by: list[str], score: str, positive: str, weight: str | None = None) -> DataFrame:
    """(Weighted) area under the ROC curve, from running sums over distinct scores: inside each group, or by ranges where there is one group."""
    w = F.col(weight) if weight else F.lit(1.0)
    each = rows.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(F.when(F.col(positive), w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(positive), 0.0).otherwise(w)).alias("q"))
    if by:
        each = each.withColumn("upto", F.sum("q").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        each = running(each, [score], {"upto": "q"})
    won = each.withColumn("won", F.col("p") * (F.col("upto") - F.col("q") / 2)).groupBy(*by).agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return won.select(*by, F.try_divide(F.col("won"), F.col("p") * F.col("q")).alias("auroc"))
