"""Chart rules on windows around pivots: single statistics and their OR-combinations, each calibrated to one joint false-alarm rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.operators import effects

#: Samples before a pivot that set a window's scale, and from it on that are judged.
PHASE = 20
CUSUM_K, EWMA_SHARE = 0.5, 0.2
#: Statistics by name; the last six are of the differences.
STATISTICS = (
    "level_peak", "mean_shift", "range_ratio", "variance_ratio", "cusum_mean", "ewma_mean", "run_side", "run_beyond_1", "run_beyond_2", "run_trend", "moving_range",
    "diff_peak", "diff2_peak", "diff_variance", "diff2_variance", "cusum_diff", "ewma_diff",
)
#: Rules that fire where any of their statistics does.
COMBINED = {
    "level_or_moving_range": ("level_peak", "moving_range"),
    "level_or_diff_or_diff2": ("level_peak", "diff_peak", "diff2_peak"),
    "level_or_diff_variance": ("level_peak", "diff_variance"),
    "cusum_or_moving_range": ("cusum_mean", "moving_range"),
    "cusum_mean_or_diff": ("cusum_mean", "cusum_diff"),
    "ewma_or_moving_range": ("ewma_mean", "moving_range"),
    "ewma_mean_or_diff": ("ewma_mean", "ewma_diff"),
    "level_or_runs": ("level_peak", "run_side", "run_beyond_1", "run_beyond_2"),
    "runs": ("run_side", "run_beyond_1", "run_beyond_2", "run_trend"),
}
RULES = {s: (s,) for s in STATISTICS} | COMBINED
#: Each rule's statistics, padded by its first: firing twice is firing.
SLOTS = {name: (*parts, *[parts[0]] * (4 - len(parts))) for name, parts in RULES.items()}
KEY = ["channel", "segment", "pivot_t"]


def _longest(states: list[str]) -> list[Column]:
    """The longest run of equal states but 0, from the runs' lengths so far."""
    return [F.max(F.when(F.col(s) != 0, F.col(f"_{s}_length"))).alias(s) for s in states]


def statistics(samples: DataFrame, points: DataFrame) -> DataFrame:
    """(channel, segment, pivot_t, STATISTICS): each window in units of its pivot's own twenty samples before. Runs are lengths in samples; without a run, 0.

    One sort of the windows' samples: running sums and runs inside windows of a fixed length, then one row a pivot.
    """
    near = effects.around(samples, points).where((F.col("t") >= F.col("pivot_t") - PHASE) & (F.col("t") < F.col("pivot_t") + PHASE))
    side = lambda f, x, post: f(F.when(F.col("post") == post, x))
    columns = {"level": F.col("value"), "diff": F.col("d"), "diff2": F.col("d2")}
    scale = [side(f, x, False).alias(f"{n}_{k}") for n, x in columns.items() for k, f in (("m", F.avg), ("s", F.stddev_samp))]
    ratio = lambda a, b: F.try_divide(a, F.when(b > 0, b))
    spans = [ratio(side(F.var_samp, x, True), side(F.var_samp, x, False)).alias(n) for n, x in zip(("variance_ratio", "diff_variance", "diff2_variance"), columns.values())]
    spans.append(ratio(side(F.max, columns["level"], True) - side(F.min, columns["level"], True), side(F.stddev_samp, columns["level"], False)).alias("range_ratio"))
    whole = near.groupBy(*KEY).agg(*scale, *spans, side(F.avg, F.abs("d"), False).alias("mr"))
    z = {n: ratio(x - F.col(f"{n}_m"), F.col(f"{n}_s")).alias(f"z_{n}") for n, x in columns.items()}
    rows = near.where("post").join(whole, KEY).select(*KEY, "t", *z.values(), ratio(F.abs("d"), F.col("mr")).alias("r"), F.signum("d").cast("int").alias("run_trend"))
    beyond = lambda k: F.when(F.col("z_level") > k, 1).when(F.col("z_level") < -k, -1).otherwise(0)
    states = {"run_side": beyond(0), "run_beyond_1": beyond(1), "run_beyond_2": beyond(2)}
    rows = rows.select("*", *[v.alias(k) for k, v in states.items()], (F.col("t") - F.col("pivot_t") + 1).alias("k"), (F.col("z_diff") * F.col("z_diff")).alias("q"))
    order = Window.partitionBy(*KEY).orderBy("t")
    keep = 1 - EWMA_SHARE
    sums = {"up": F.col("z_level") - CUSUM_K, "down": -F.col("z_level") - CUSUM_K, "burst": F.col("q") - 1 - CUSUM_K, "e": F.col("z_level") * F.pow(F.lit(keep), -F.col("k")), "eq": F.col("q") * F.pow(F.lit(keep), -F.col("k"))}
    names = [*states, "run_trend"]
    changed = [F.coalesce((F.col(s) != F.lag(s).over(order)).cast("int"), F.lit(1)).alias(f"_{s}_new") for s in names]
    rows = rows.select("*", *[F.sum(v).over(order).alias(k) for k, v in sums.items()], *changed)
    rows = rows.select("*", *[F.sum(f"_{s}_new").over(order).alias(f"_{s}_run") for s in names])
    rows = rows.select("*", *[F.count(F.lit(1)).over(Window.partitionBy(*KEY, f"_{s}_run").orderBy("t")).alias(f"_{s}_length") for s in names])
    above = {k: F.col(k) - F.least(F.lit(0.0), F.min(k).over(order)) for k in ("up", "down", "burst")}
    decayed = {k: F.abs(F.col(k)) * EWMA_SHARE * F.pow(F.lit(keep), F.col("k")) for k in ("e", "eq")}
    rows = rows.select(*KEY, "z_level", "z_diff", "z_diff2", "r", *[s for s in names], *[f"_{s}_length" for s in names], *[v.alias(f"c_{k}") for k, v in (above | decayed).items()])
    found = rows.groupBy(*KEY).agg(
        F.max(F.abs("z_level")).alias("level_peak"), F.abs(F.avg("z_level")).alias("mean_shift"), F.max("r").alias("moving_range"), F.max(F.abs("z_diff")).alias("diff_peak"), F.max(F.abs("z_diff2")).alias("diff2_peak"),
        F.max(F.greatest("c_up", "c_down")).alias("cusum_mean"), F.max("c_burst").alias("cusum_diff"), F.max("c_e").alias("ewma_mean"), F.max("c_eq").alias("ewma_diff"), *_longest(names),
    )
    out = found.join(whole.select(*KEY, "variance_ratio", "diff_variance", "diff2_variance", "range_ratio"), KEY)
    return out.select(*KEY, *[F.round(F.coalesce(s, F.lit(0)) if s.startswith("run_") else F.col(s), 9).alias(s) for s in STATISTICS])


def by_rule(rows: DataFrame) -> DataFrame:
    """(rule, anomaly, s1 to s4) for each row of statistics with anomaly."""
    parts = [F.struct(F.lit(name).alias("rule"), *[F.col(c).cast("double").alias(f"s{k}") for k, c in enumerate(slots, 1)]) for name, slots in SLOTS.items()]
    return rows.select("anomaly", F.inline(F.array(*parts)))


def _state_sql(k: int) -> str:
    return f"CASE WHEN z > {k} THEN 1 WHEN z < -{k} THEN -1 ELSE 0 END"


#: The statistics in SQL, from near of the pivots: st (channel, segment, pivot_t, anomaly, statistics).
STATISTICS_SQL = f"""ph AS MATERIALIZED (SELECT * FROM near WHERE t >= pivot_t - {PHASE} AND t < pivot_t + {PHASE}),
pi AS MATERIALIZED (SELECT channel, segment, max(seg_anomaly) AS anomaly, {', '.join(f'avg({x}) FILTER (NOT post) AS m_{n}, stddev_samp({x}) FILTER (NOT post) AS s_{n}, var_samp({x}) FILTER (post) / nullif(var_samp({x}) FILTER (NOT post), 0) AS v_{n}' for n, x in (('a', 'value'), ('b', 'd'), ('c', 'd2')))},
 (max(value) FILTER (post) - min(value) FILTER (post)) / nullif(stddev_samp(value) FILTER (NOT post), 0) AS range_ratio, avg(abs(d)) FILTER (NOT post) AS mr FROM ph GROUP BY channel, segment),
zz AS MATERIALIZED (SELECT p.channel, p.segment, p.pivot_t, p.t, p.t - p.pivot_t + 1 AS k, (value - m_a) / nullif(s_a, 0) AS z, (d - m_b) / nullif(s_b, 0) AS zd, (d2 - m_c) / nullif(s_c, 0) AS zd2, abs(d) / nullif(mr, 0) AS r, CAST(sign(d) AS INT) AS trend FROM ph p JOIN pi USING (channel, segment) WHERE post),
ru AS (SELECT channel, segment, kind, max(CASE WHEN state <> 0 THEN length END) AS longest FROM (SELECT channel, segment, kind, state, count(*) AS length FROM (SELECT *, sum(fresh) OVER (PARTITION BY channel, segment, kind ORDER BY t) AS run FROM (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY channel, segment, kind ORDER BY t) THEN 0 ELSE 1 END AS fresh
 FROM (SELECT channel, segment, t, unnest(['run_side', 'run_beyond_1', 'run_beyond_2', 'run_trend']) AS kind, unnest([{_state_sql(0)}, {_state_sql(1)}, {_state_sql(2)}, trend]) AS state FROM zz))) GROUP BY channel, segment, kind, state, run) GROUP BY channel, segment, kind),
cs AS (SELECT *, sum(z - {CUSUM_K}) OVER w AS up, sum(-z - {CUSUM_K}) OVER w AS down, sum(zd * zd - 1 - {CUSUM_K}) OVER w AS burst, sum(z * pow({1 - EWMA_SHARE}::DOUBLE, -k)) OVER w AS e, sum(zd * zd * pow({1 - EWMA_SHARE}::DOUBLE, -k)) OVER w AS eq FROM zz WINDOW w AS (PARTITION BY channel, segment ORDER BY t)),
cm AS (SELECT *, {', '.join(f'{c} - least(0, min({c}) OVER w) AS c_{c}' for c in ('up', 'down', 'burst'))}, {', '.join(f'abs({c}) * {EWMA_SHARE} * pow({1 - EWMA_SHARE}::DOUBLE, k) AS c_{c}' for c in ('e', 'eq'))} FROM cs WINDOW w AS (PARTITION BY channel, segment ORDER BY t)),
pk AS (SELECT channel, segment, pivot_t, max(abs(z)) AS level_peak, abs(avg(z)) AS mean_shift, max(r) AS moving_range, max(abs(zd)) AS diff_peak, max(abs(zd2)) AS diff2_peak, max(greatest(c_up, c_down)) AS cusum_mean, max(c_burst) AS cusum_diff, max(c_e) AS ewma_mean, max(c_eq) AS ewma_diff FROM cm GROUP BY channel, segment, pivot_t),
rw AS (SELECT channel, segment, {', '.join(f"max(longest) FILTER (kind = '{k}') AS {k}" for k in ('run_side', 'run_beyond_1', 'run_beyond_2', 'run_trend'))} FROM ru GROUP BY channel, segment),
sr AS (SELECT pk.*, anomaly, range_ratio, v_a AS variance_ratio, v_b AS diff_variance, v_c AS diff2_variance, {', '.join(f'coalesce({k}, 0) AS {k}' for k in ('run_side', 'run_beyond_1', 'run_beyond_2', 'run_trend'))} FROM pk JOIN pi USING (channel, segment) JOIN rw USING (channel, segment)),
st AS MATERIALIZED (SELECT channel, segment, pivot_t, anomaly, {', '.join(f'round({s}, 9) AS {s}' for s in STATISTICS)} FROM sr)"""
BY_RULE_SQL = "br AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT '{name}' AS rule, anomaly, {', '.join(f'{c}::DOUBLE AS s{k}' for k, c in enumerate(slots, 1))} FROM st" for name, slots in SLOTS.items()) + ")"
