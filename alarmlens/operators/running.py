"""Row numbers and running sums over a whole table, without a window that holds it in one task.

The table is sorted by ranges. Ranges are numbered and summed inside themselves, and offset by the sums of those before, which are
one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.sources.shared import saved


def _ranges(df: DataFrame, order: list) -> DataFrame:
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return saved(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(2**33 - 1)))


def numbered(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """Adds the row's place in that order, from 0. Rows that are alike in it are in any order."""
    rows = _ranges(df, order)
    before = _offsets(rows, {"_n": F.count(F.lit(1))})
    return rows.join(F.broadcast(before), "_range").select(*df.columns, (F.col("_n") + F.col("_place")).alias(name))


def running(df: DataFrame, order: list, sums: dict[str, str | Column]) -> DataFrame:
    """Adds, by name, the sum of a column over all rows up to this one in that order, which no two rows share."""
    each = {k: F.col(v) if isinstance(v, str) else v for k, v in sums.items()}
    rows = _ranges(df, order)
    before = _offsets(rows, {f"_b_{k}": F.sum(v) for k, v in each.items()})
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", *[F.sum(v).over(inside).alias(f"_o_{k}") for k, v in each.items()])
    return own.join(F.broadcast(before), "_range").select(*df.columns, *[(F.coalesce(f"_b_{k}", F.lit(0)) + F.coalesce(f"_o_{k}", F.lit(0))).alias(k) for k in each])


def _offsets(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(_range, sums of all ranges before): as many rows as the sort had tasks."""
    each = rows.groupBy("_range").agg(*[v.alias(k) for k, v in sums.items()])
    before = Window.partitionBy().orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("_range", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums])
