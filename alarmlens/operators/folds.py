"""Folds of whole groups, balanced by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.operators.running import numbered

FOLDS = 5


def _below(loads: list[int], size: int, level: int) -> int:
    return sum(max(0, -(-(level - load) // size)) for load in loads)


def dealt(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n groups of one size each fold gets, if each goes to the fold that is lightest then (ties: the first)."""
    low, high = min(loads), max(loads) + size * (n + 1)
    while low < high:  # the highest level that no more than n groups start below
        middle = (low + high + 1) // 2
        low, high = (middle, high) if _below(loads, size, middle) <= n else (low, middle - 1)
    out = [max(0, -(-(low - load) // size)) for load in loads]
    left = n - sum(out)
    for k, load in enumerate(loads):
        if left and load + out[k] * size == low:
            out[k] += 1
            left -= 1
    return out


def balanced(rows: DataFrame, group: list[str], folds: int = FOLDS) -> DataFrame:
    """Adds fold: groups, the largest first (ties by name), go to the fold that has the fewest rows then.

    The driver sees how many groups have each size, and deals them out size by size. Inside a size, the order in which folds are
    lightest follows from their loads; groups meet their place in it by number.
    """
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    counts = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()
    loads, plan = [0] * folds, []
    for r in counts:
        got = dealt(loads, r["size"], r["n"])
        plan += [(r["size"], k, load, n) for k, (load, n) in enumerate(zip(loads, got)) if n]
        loads = [load + n * r["size"] for load, n in zip(loads, got)]
    places = rows.sparkSession.createDataFrame(plan, "size long, fold long, load long, n long").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    places = numbered(places.select("size", "fold", (F.col("load") + F.col("k") * F.col("size")).alias("load")), [F.desc("size"), "load", "fold"]).select("number", "fold")
    named = numbered(sizes, [F.desc("size"), *group]).join(places, "number").select(*group, "fold")
    return rows.join(named, group)


def balanced_sql(rows: str, group: list[str], kinds: list[str], folds: int = FOLDS) -> str:
    """The same, one group after the other: (group, fold)."""
    g, o = ", ".join(group), ", ".join(f"o.{c}" for c in group)
    least = "list_position(r.loads, list_min(r.loads))"
    return f"""(WITH RECURSIVE o AS (SELECT {g}, n, row_number() OVER (ORDER BY n DESC, {g}) AS i FROM (SELECT {g}, count(*) AS n FROM {rows} GROUP BY {g})),
r AS (SELECT 0::BIGINT AS i, {', '.join(f'NULL::{k} AS {c}' for c, k in zip(group, kinds))}, -1::BIGINT AS fold, [{', '.join(['0'] * folds)}]::BIGINT[] AS loads
 UNION ALL SELECT o.i, {o}, {least}::BIGINT - 1, [CASE WHEN k = {least} THEN r.loads[k] + o.n ELSE r.loads[k] END FOR k IN range(1, {folds} + 1)] FROM r JOIN o ON o.i = r.i + 1) SELECT {g}, fold FROM r WHERE i > 0)"""
