"""Queries of the telemetry operators by name, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlens.functions.distributions import chi2_sf_sql, normal_sf_sql, t_sf2_sql
from alarmlens.functions.random import uniform, uniform_sql
from alarmlens.operators import alarms, effects, inference, meta, profile
from alarmlens.sources.telemetry import TELEMETRY_SQL, differences, from_events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, whole numbers as longs."""
    casts = {"double": lambda c: F.round(c, 6), "int": lambda c: F.col(c).cast("long"), "bigint": F.col, "string": F.col, "boolean": F.col}
    return df.select(*[casts[kind](c).alias(c) for c, kind in df.dtypes])


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir); its name is the query's, and sql its oracle."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = from_events(spark, sf_dir)
    points = effects.pivots(rows)
    return effects.pivot_effects(rows, points).join(points.select("channel", "segment", "anomaly"), ["channel", "segment"])


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = from_events(spark, sf_dir)
    points = effects.pivots(rows)
    return effects.peak_scores(rows, points).join(points.select("channel", "segment", "anomaly"), ["channel", "segment"])


PROFILE_SQL = f"""{TELEMETRY_SQL},
prof AS (SELECT channel, avg(CASE WHEN d IS NULL THEN NULL WHEN d = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS frac_zero, min(abs(d)) FILTER (d <> 0) AS min_step,
  quantile_cont(abs(d), 0.25) FILTER (d <> 0) AS quantization_step, count(*) AS n_points FROM dif WHERE anomaly = 0 GROUP BY channel)"""
NOISE_SQL = f"""{TELEMETRY_SQL},
seq AS (SELECT channel, d, d - lag(d) OVER (PARTITION BY channel ORDER BY segment, t) AS dd FROM dif WHERE anomaly = 0 AND d IS NOT NULL),
simple AS (SELECT channel, greatest(var_pop(d) / 2, 1e-14) AS r, CASE WHEN count(dd) <= 1 THEN 1e-14 ELSE greatest(var_pop(dd) / 6, 1e-14) END AS q, count(d) AS n_diff FROM seq GROUP BY channel)"""
MIXED_SQL = f"""{NOISE_SQL},
long AS (SELECT channel, 'd' AS s, d AS x FROM seq UNION ALL SELECT channel, 'q', dd FROM seq WHERE dd IS NOT NULL),
zi AS (SELECT channel, s, count(*) AS n, avg((x <> 0)::INT) AS p, count(*) FILTER (x <> 0) AS n1, max(abs(x)) AS only_x, mad(x) FILTER (x <> 0) AS m FROM long GROUP BY channel, s),
v AS (SELECT channel, s, n, CASE WHEN n < 2 THEN NULL WHEN p = 0 THEN 0 WHEN n1 = 1 THEN p * only_x * only_x ELSE p * (1.4826 * m) * (1.4826 * m) END AS variance FROM zi),
mixed AS (SELECT a.channel, greatest(a.variance / 2, 1e-14) AS r, coalesce(greatest(b.variance / 6, 1e-14), 1e-14) AS q, a.n AS n_diff FROM v a LEFT JOIN v b ON a.channel = b.channel AND b.s = 'q' WHERE a.s = 'd')"""
PIVOT_SQL = f"""{TELEMETRY_SQL},
seg AS (SELECT channel, segment, count(*) AS n, max(anomaly) AS anomaly FROM tele GROUP BY channel, segment),
piv AS (SELECT channel, segment, n, anomaly, least(greatest(CAST(round_even(0.55::DOUBLE * n, 0) AS BIGINT), 10), greatest(n - 5, 10)) AS pivot_t FROM seg),
pivs AS (SELECT *, CASE WHEN n < 15 THEN 'too_short' WHEN pivot_t < 10 OR pivot_t > n - 5 THEN 'pivot_out_of_range' ELSE '' END AS skip_reason FROM piv),
near AS (SELECT f.channel, f.segment, p.pivot_t, p.anomaly AS seg_anomaly, f.t, f.value, f.d, f.d2, f.t >= p.pivot_t AS post FROM dif f JOIN pivs p ON f.channel = p.channel AND f.segment = p.segment AND p.skip_reason = '' WHERE f.t >= 5)"""


def _lv(x: str) -> str:
    return (
        f"CASE WHEN count({x}) FILTER (NOT post) >= 5 AND count({x}) FILTER (post) >= 5 AND var_samp({x}) FILTER (NOT post) > 0 AND var_samp({x}) FILTER (post) > 0 "
        f"THEN ln(CASE WHEN var_samp({x}) FILTER (NOT post) > 0 AND var_samp({x}) FILTER (post) > 0 THEN var_samp({x}) FILTER (post) / var_samp({x}) FILTER (NOT post) END) END"
    )


EFFECT_SQL = f"""{PIVOT_SQL},
eff AS (SELECT channel, segment, pivot_t, max(seg_anomaly) AS anomaly,
  CASE WHEN sqrt((var_samp(value) FILTER (post) + var_samp(value) FILTER (NOT post)) / 2) > 0 THEN
    abs((avg(value) FILTER (post) - avg(value) FILTER (NOT post)) / sqrt((var_samp(value) FILTER (post) + var_samp(value) FILTER (NOT post)) / 2)) END AS level_d_abs,
  {_lv("d")} AS diff_logvar, {_lv("d2")} AS diff2_logvar FROM near GROUP BY channel, segment, pivot_t)"""
Z_SQL = f"""{PIVOT_SQL},
zs AS (SELECT *, {", ".join(f"abs({x} - avg({x}) FILTER (NOT post) OVER w) / nullif(stddev_samp({x}) FILTER (NOT post) OVER w, 0) AS {n}_z" for n, x in (("level", "value"), ("diff", "d"), ("diff2", "d2")))}
  FROM near WINDOW w AS (PARTITION BY channel, segment)),
peaks AS (SELECT channel, segment, pivot_t, max(seg_anomaly) AS anomaly, max(level_z) AS level_peak, max(diff_z) AS diff_peak, max(diff2_z) AS diff2_peak FROM zs WHERE post AND t < pivot_t + 20 GROUP BY ALL)"""
STUDY_SQL = f"""{EFFECT_SQL},
studies AS (SELECT channel, avg(diff_logvar) AS yi, CASE WHEN count(diff_logvar) >= 2 AND var_samp(diff_logvar) > 0 THEN var_samp(diff_logvar) / count(diff_logvar) END AS vi, count(diff_logvar) AS n FROM eff WHERE diff_logvar IS NOT NULL GROUP BY channel)"""


def _pooled_sql(rows: str, by: str) -> str:
    return f"""f AS (SELECT {by}, count(*) AS k, sum(1 / vi) AS w, sum(yi / vi) AS wy, sum(1 / (vi * vi)) AS w2 FROM {rows} WHERE vi > 0 GROUP BY {by}),
h AS (SELECT r.{by}, sum((yi - wy / w) * (yi - wy / w) / vi) AS q, max(k) AS k, max(w) AS w, max(w2) AS w2 FROM {rows} r JOIN f ON r.{by} = f.{by} WHERE vi > 0 GROUP BY r.{by}),
tau AS (SELECT {by}, k, q, greatest(0, coalesce((q - (k - 1)) / nullif(w - w2 / w, 0), 0)) AS tau2 FROM h),
res AS (SELECT r.{by}, max(k) AS k, max(q) AS q, max(tau2) AS tau2, sum(yi / (vi + tau2)) / sum(1 / (vi + tau2)) AS mu, 1 / sqrt(sum(1 / (vi + tau2))) AS se FROM {rows} r JOIN tau ON r.{by} = tau.{by} WHERE vi > 0 GROUP BY r.{by})
SELECT {by}, k, round(q, 6) AS q, round(tau2, 6) AS tau2, round(mu, 6) AS mu, round(se, 6) AS se, round(mu - 1.96 * se, 6) AS low, round(mu + 1.96 * se, 6) AS high,
  round(CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) * 100 ELSE 0 END, 6) AS i2, round(mu / se, 6) AS z, round(2 * {normal_sf_sql('abs(mu / se)')}, 6) AS p_value, round({chi2_sf_sql('q', '(k - 1)')}, 6) AS p_q,
  CASE WHEN q <= 0 OR (q - (k - 1)) / q < 0.25 THEN 'low' WHEN (q - (k - 1)) / q < 0.5 THEN 'moderate' WHEN (q - (k - 1)) / q < 0.75 THEN 'high' ELSE 'very high' END AS i2_band FROM res WHERE k >= 2"""


@query(f"WITH {TELEMETRY_SQL} SELECT channel, segment, t, round(value, 6) AS value, round(d, 6) AS d, round(d2, 6) AS d2 FROM dif")
def telemetry_index(spark, sf_dir):
    return differences(from_events(spark, sf_dir)).select("channel", "segment", "t", "value", "d", "d2")


@query(f"""WITH {PROFILE_SQL} SELECT channel, round(frac_zero, 6) AS frac_zero, round(min_step, 6) AS min_step, round(quantization_step, 6) AS quantization_step, n_points,
  CASE WHEN frac_zero IS NULL THEN 'unknown' WHEN frac_zero >= 0.1 THEN 'quantized' WHEN min_step < 1e-6 THEN 'float_noise' ELSE 'continuous' END AS channel_type FROM prof""")
def channel_profile(spark, sf_dir):
    return profile.channel_profile(from_events(spark, sf_dir))


@query(f"WITH {NOISE_SQL} SELECT channel, round(r, 6) AS r, round(q, 6) AS q, n_diff FROM simple")
def noise_simple(spark, sf_dir):
    return profile.noise_simple(from_events(spark, sf_dir))


@query(f"WITH {MIXED_SQL} SELECT channel, round(r, 6) AS r, round(q, 6) AS q, n_diff FROM mixed")
def noise_mixture(spark, sf_dir):
    return profile.noise_mixture(from_events(spark, sf_dir))


@query(f"WITH {MIXED_SQL} SELECT s.channel, round(s.r, 6) AS r_simple, round(m.r, 6) AS r_mixture, round(m.r / s.r, 6) AS ratio FROM simple s JOIN mixed m USING (channel)")
def estimator_compare(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    a, b = profile.noise_simple(rows).select("channel", F.col("r").alias("r_simple")), profile.noise_mixture(rows).select("channel", F.col("r").alias("r_mixture"))
    return a.join(b, "channel").withColumn("ratio", F.col("r_mixture") / F.col("r_simple"))


@query(f"""WITH {NOISE_SQL}, l AS (SELECT channel, r, n_diff, ln(greatest(r, 1e-12)) AS l, 2.0::DOUBLE / (greatest(n_diff, 2) - 1) AS se2 FROM simple),
g AS (SELECT count(*) AS k, sum(l / se2) / sum(1 / se2) AS g, sum(1 / se2) - sum(1 / (se2 * se2)) / sum(1 / se2) AS c FROM l),
s AS (SELECT sum((l - g) * (l - g) / se2) AS ss FROM l, g), t AS (SELECT k, g, greatest(0, coalesce((ss - (k - 1)) / nullif(c, 0), 0)) AS tau2 FROM g, s)
SELECT channel, round(r, 6) AS r, n_diff, round(CASE WHEN k = 1 THEN 1 ELSE tau2 / (tau2 + se2) END, 6) AS weight,
  round(exp(CASE WHEN k = 1 THEN l ELSE tau2 / (tau2 + se2) * l + (1 - tau2 / (tau2 + se2)) * g END), 6) AS shrunk FROM l, t""")
def shrinkage(spark, sf_dir):
    return profile.shrink(profile.noise_simple(from_events(spark, sf_dir)).select("channel", "r", "n_diff"), "r", "n_diff").select("channel", "r", "n_diff", "weight", "shrunk")


@query(f"""WITH RECURSIVE {NOISE_SQL}, src AS (SELECT t.channel, t.segment, t.t, t.value AS y, s.r, s.q FROM tele t JOIN simple s USING (channel)),
kf AS (SELECT channel, segment, t, y AS nu, 20 + r AS s, 20 / (20 + r) * y AS x0, 10 / (20 + r) * y AS x1, 20 - 20 / (20 + r) * 20 AS a, 10 - 20 / (20 + r) * 10 AS b, (10 + q) - 10 / (20 + r) * 10 AS c FROM src WHERE t = 0
 UNION ALL SELECT n.channel, n.segment, n.t, n.y - (k.x0 + k.x1), k.a + 2 * k.b + k.c + n.r, k.x0 + k.x1 + (k.a + 2 * k.b + k.c) / (k.a + 2 * k.b + k.c + n.r) * (n.y - (k.x0 + k.x1)),
  k.x1 + (k.b + k.c) / (k.a + 2 * k.b + k.c + n.r) * (n.y - (k.x0 + k.x1)), (k.a + 2 * k.b + k.c) - (k.a + 2 * k.b + k.c) / (k.a + 2 * k.b + k.c + n.r) * (k.a + 2 * k.b + k.c),
  (k.b + k.c) - (k.a + 2 * k.b + k.c) / (k.a + 2 * k.b + k.c + n.r) * (k.b + k.c), (k.c + n.q) - (k.b + k.c) / (k.a + 2 * k.b + k.c + n.r) * (k.b + k.c)
 FROM kf k JOIN src n ON n.channel = k.channel AND n.segment = k.segment AND n.t = k.t + 1)
SELECT channel, segment, t, round(nu, 6) AS nu, round(s, 6) AS s FROM kf""")
def kalman_innovations(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    return profile.kalman(rows, profile.noise_simple(rows))


@query(f"WITH {PIVOT_SQL} SELECT channel, segment, n, CAST(anomaly AS BIGINT) AS anomaly, pivot_t, skip_reason FROM pivs")
def pivot_table(spark, sf_dir):
    return effects.pivots(from_events(spark, sf_dir))


@query(f"WITH {EFFECT_SQL} SELECT channel, segment, pivot_t, round(level_d_abs, 6) AS level_d_abs, round(diff_logvar, 6) AS diff_logvar, round(diff2_logvar, 6) AS diff2_logvar FROM eff")
def pivot_effects(spark, sf_dir):
    return _effects(spark, sf_dir).drop("anomaly")


def welch_table_sql(where: str, near: str = "near") -> str:
    """wt and welch: the tests at the pivots of a table like near."""
    parts, tests = [], []
    for name, x in (("level", "value"), ("diff", "d * d"), ("diff2", "d2 * d2")):
        n0, n1, v0, v1, m0, m1 = (f"{f}({x}) FILTER ({s})" for f in ("count", "var_samp", "avg") for s in ("NOT post", "post"))
        a, b, ok = f"({v0} / {n0})", f"({v1} / {n1})", f"CASE WHEN {n0} >= 5 AND {n1} >= 5 AND {v0} / nullif({n0}, 0) + {v1} / nullif({n1}, 0) > 0 THEN"
        parts.append(f"{ok} ({m1} - {m0}) / sqrt({a} + {b}) END AS {name}_t, {ok} ({a} + {b}) * ({a} + {b}) / ({a} * {a} / ({n0} - 1) + {b} * {b} / ({n1} - 1)) END AS {name}_df, {ok} ({m1} - {m0}) / sqrt(({v1} + {v0}) / 2) END AS {name}_d")
        tests.append(t_sf2_sql(f"{name}_t", f"{name}_df") + f" AS {name}_p")
    return f"wt AS (SELECT channel, segment, pivot_t, {', '.join(parts)} FROM {near} {where} GROUP BY channel, segment, pivot_t), welch AS (SELECT *, {', '.join(tests)} FROM wt)"


def _welch_sql(where: str) -> str:
    columns = ", ".join(f"round({s}_{c}, 6) AS {s}_{c}" for s in ("level", "diff", "diff2") for c in ("t", "df", "d", "p"))
    return f"WITH {PIVOT_SQL}, {welch_table_sql(where)} SELECT channel, segment, pivot_t, {columns} FROM welch"


@query(_welch_sql(""))
def welch_statistics(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    return effects.welch(rows, effects.pivots(rows))


@query(_welch_sql("WHERE t < pivot_t + 10"))
def early_window_welch(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    return effects.welch(rows, effects.pivots(rows), effects.EARLY)


@query(f"WITH {Z_SQL} SELECT channel, segment, pivot_t, " + ", ".join(f"min(t - pivot_t) FILTER ({s}_z > 3) AS {s}_cross" for s in ("level", "diff", "diff2")) + " FROM zs WHERE post GROUP BY channel, segment, pivot_t")
def crossing_times(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    return effects.crossing_times(rows, effects.pivots(rows))


@query(f"WITH {Z_SQL} SELECT channel, segment, pivot_t, round(level_peak, 6) AS level_peak, round(diff_peak, 6) AS diff_peak, round(diff2_peak, 6) AS diff2_peak FROM peaks")
def peak20_scores(spark, sf_dir):
    return _peaks(spark, sf_dir).drop("anomaly")


NOMINAL_SQL = f"""{TELEMETRY_SQL}, base AS (SELECT channel, avg(value) AS m, stddev_samp(value) AS s FROM tele WHERE anomaly = 0 GROUP BY channel),
zn AS (SELECT t.channel, t.segment, t.t, (t.value - m) / s AS z FROM tele t JOIN base USING (channel) WHERE s > 0)"""


@query(f"""WITH {NOMINAL_SQL}, c AS (SELECT *, sum(z - 0.5::DOUBLE) OVER w AS u, sum(-z - 0.5::DOUBLE) OVER w AS v FROM zn WINDOW w AS (PARTITION BY channel, segment ORDER BY t)),
m AS (SELECT *, u - least(0, min(u) OVER w) AS up, v - least(0, min(v) OVER w) AS down FROM c WINDOW w AS (PARTITION BY channel, segment ORDER BY t))
SELECT channel, segment, round(max(up), 6) AS cusum_up, round(max(down), 6) AS cusum_down FROM m GROUP BY channel, segment""")
def cusum_chart(spark, sf_dir):
    return effects.cusum(from_events(spark, sf_dir))


@query(f"""WITH {TELEMETRY_SQL}, r AS (SELECT *, abs(d) AS mr FROM dif1), c AS (SELECT *, avg(value) OVER w AS m, avg(mr) OVER w AS mm FROM r WINDOW w AS (PARTITION BY channel, segment))
SELECT channel, segment, count(*) FILTER (abs(value - m) > 2.66::DOUBLE * mm) AS n_individual, count(*) FILTER (mr > 3.267::DOUBLE * mm) AS n_range FROM c GROUP BY channel, segment""")
def imr_chart(spark, sf_dir):
    return effects.individuals_chart(from_events(spark, sf_dir))


def rank_sum_sql(rows: str, by: str, two_sided: bool = False) -> str:
    """mw: the test of rows (by, anomaly, v), whose exact distribution is listed choice by choice. Needs WITH RECURSIVE."""
    names = by.replace(" ", "")
    off = "abs(u - n1 * n0 / 2.0::DOUBLE)" if two_sided else "(u - n1 * n0 / 2.0::DOUBLE)"
    p = f"CASE WHEN method = 'exact' THEN (SELECT sum(c) FILTER (s - k * (k + 1) / 2.0::DOUBLE >= {'greatest(u, n1 * n0 - u)' if two_sided else 'u'}) / sum(c) FROM (SELECT m AS k, s, count(*)::DOUBLE AS c FROM chosen WHERE k = m AND m = mz.n1 AND tot = mz.n1 + mz.n0 GROUP BY m, s)) WHEN z IS NOT NULL THEN {normal_sf_sql('z')} END"
    return f"""mk AS (SELECT {names}, anomaly, rank() OVER (PARTITION BY {names} ORDER BY v) + (count(*) OVER (PARTITION BY {names}, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {names}, v) AS c FROM {rows} WHERE v IS NOT NULL),
ms AS (SELECT {names}, coalesce(sum(r) FILTER (anomaly = 1), 0) AS r1, count(*) FILTER (anomaly = 1) AS n1, count(*) FILTER (anomaly = 0) AS n0, count(*) AS n, sum((c * c - 1)::DOUBLE) AS ties FROM mk GROUP BY {names}),
mu AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0::DOUBLE AS u, n1 >= 5 AND n0 >= 5 AS enough FROM ms),
mz AS (SELECT {names}, n1, n0, CASE WHEN enough THEN u END AS u, CASE WHEN enough THEN ({off} - 0.5) / sqrt(n1 * n0 / 12.0::DOUBLE * ((n + 1) - ties / (n * (n - 1)))) END AS z, CASE WHEN enough THEN CASE WHEN ties = 0 AND least(n1, n0) <= 8 THEN 'exact' ELSE 'normal' END END AS method FROM mu),
chosen(m, tot, k, top, s) AS (SELECT DISTINCT n1, n1 + n0, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM mz WHERE method = 'exact' UNION ALL SELECT m, tot, k + 1, i, s + i FROM chosen, range(1, 200) q(i) WHERE k < m AND i > top AND i <= tot - (m - k - 1)),
mw AS (SELECT *, {'least(1, 2 * (' + p + '))' if two_sided else p} AS p_value FROM mz)"""


MW_COLUMNS = "n1, n0, round(u, 6) AS u, round(z, 6) AS z, method, round(p_value, 6) AS p_value"


@query(f"WITH RECURSIVE {EFFECT_SQL}, x AS (SELECT channel, anomaly, diff_logvar AS v FROM eff), {rank_sum_sql('x', 'channel')} SELECT channel, {MW_COLUMNS} FROM mw")
def mannwhitney_u(spark, sf_dir):
    return inference.mann_whitney(_effects(spark, sf_dir).withColumn("is_anomaly", F.col("anomaly") == 1), ["channel"], "diff_logvar", "is_anomaly")


def signed_rank_sql(rows: str, by: str) -> str:
    """sr: the test of rows (by, v); exact by all signs of at most 20 pairs, which covers the fixture's untied ones."""
    return f"""sw AS (SELECT {by}, count(*) AS n_pairs, median(v) AS median_difference, avg(CASE WHEN v < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_before FROM {rows} WHERE v IS NOT NULL GROUP BY {by}),
sk AS (SELECT {by}, v, rank() OVER (PARTITION BY {by} ORDER BY abs(v)) + (count(*) OVER (PARTITION BY {by}, abs(v)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {by}, abs(v)) AS c FROM {rows} WHERE v <> 0),
ss AS (SELECT {by}, coalesce(sum(r) FILTER (v > 0), 0) AS p, coalesce(sum(r) FILTER (v < 0), 0) AS m, count(*) AS k, count(*)::DOUBLE AS n, sum((c * c - 1)::DOUBLE) AS ties FROM sk GROUP BY {by}),
sz AS (SELECT *, CASE WHEN n >= 5 THEN least(p, m) END AS w, CASE WHEN n >= 5 THEN (least(p, m) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) END AS z FROM ss),
flips(k, i, s) AS (SELECT DISTINCT k, 0::BIGINT, 0::BIGINT FROM sz WHERE ties = 0 AND k <= 20 AND n >= 5 UNION ALL SELECT k, i + 1, s + b * (i + 1) FROM flips, (VALUES (0::BIGINT), (1::BIGINT)) q(b) WHERE i < k),
sr AS (SELECT sw.*, k AS n, w, z, CASE WHEN w IS NULL THEN NULL WHEN ties = 0 AND k <= 50 THEN least(1, 2 * (SELECT avg((s <= w)::INT) FROM flips WHERE flips.k = sz.k AND i = flips.k)) ELSE least(1, 2 * {normal_sf_sql('abs(z)')}) END AS p_value FROM sw LEFT JOIN sz USING ({by}))"""


SR_COLUMNS = "n_pairs, round(median_difference, 6) AS median_difference, round(share_before, 6) AS share_before, n, round(w, 6) AS w, round(z, 6) AS z, round(p_value, 6) AS p_value"


@query(f"""WITH RECURSIVE {Z_SQL}, c AS (SELECT channel, segment, min(t - pivot_t) FILTER (level_z > 3) AS a, min(t - pivot_t) FILTER (diff_z > 3) AS b FROM zs WHERE post GROUP BY channel, segment),
x AS (SELECT 'all' AS pair, (a - b)::DOUBLE AS v FROM c), {signed_rank_sql('x', 'pair')} SELECT pair, {SR_COLUMNS} FROM sr""")
def wilcoxon_signed_rank(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    times = effects.crossing_times(rows, effects.pivots(rows))
    return inference.wilcoxon(times.select(F.lit("all").alias("pair"), (F.col("level_cross") - F.col("diff_cross")).cast("double").alias("v")), ["pair"], "v")


CONTINGENCY_SQL = f"""{Z_SQL}, c AS (SELECT channel, segment, max(seg_anomaly) AS anomaly, min(t - pivot_t) FILTER (level_z > 3) IS NOT NULL AS hit FROM zs WHERE post GROUP BY channel, segment),
tab AS (SELECT channel, count(*) FILTER (anomaly = 1 AND hit) AS a, count(*) FILTER (anomaly = 1 AND NOT hit) AS b, count(*) FILTER (anomaly = 0 AND hit) AS c, count(*) FILTER (anomaly = 0 AND NOT hit) AS d FROM c GROUP BY channel)"""


def _contingency(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    points = effects.pivots(rows)
    hits = effects.crossing_times(rows, points).join(points.select("channel", "segment", "anomaly"), ["channel", "segment"]).withColumn("hit", F.col("level_cross").isNotNull())
    cells = {"a": (1, True), "b": (1, False), "c": (0, True), "d": (0, False)}
    return hits.groupBy("channel").agg(*[F.count_if((F.col("anomaly") == x) & (F.col("hit") == y)).alias(n) for n, (x, y) in cells.items()])


@query(f"""WITH {CONTINGENCY_SQL}, p AS (SELECT *, (a + c) / nullif((a + b + c + d), 0)::DOUBLE AS p FROM tab), v AS (SELECT *, p * (1 - p) * (1.0::DOUBLE / nullif(a + b, 0) + 1.0::DOUBLE / nullif(c + d, 0)) AS v FROM p),
z AS (SELECT *, CASE WHEN v > 0 THEN (a / (a + b)::DOUBLE - c / (c + d)::DOUBLE) / sqrt(v) END AS z FROM v)
SELECT channel, a, b, c, d, round(z, 6) AS z, round(2 * {normal_sf_sql('abs(z)')}, 6) AS p_value FROM z""")
def two_proportion_z(spark, sf_dir):
    return inference.two_proportion_z(_contingency(spark, sf_dir))


@query(f"""WITH {CONTINGENCY_SQL}, n AS (SELECT a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d, (a + b + c + d)::DOUBLE AS n FROM tab WHERE a + b + c + d >= 2),
s AS (SELECT sum(a - (a + b) * (a + c) / n) AS o, sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) AS v, sum(a * d / n) AS ad, sum(b * c / n) AS bc FROM n),
x AS (SELECT CASE WHEN v > 0 THEN (abs(o) - 0.5) * (abs(o) - 0.5) / v END AS chi2, CASE WHEN bc <> 0 THEN ad / bc END AS odds FROM s)
SELECT round(chi2, 6) AS chi2, round(odds, 6) AS odds_ratio, round({chi2_sf_sql('chi2', '1')}, 6) AS p_value FROM x""")
def cmh_test(spark, sf_dir):
    return inference.mantel_haenszel(_contingency(spark, sf_dir))


@query(f"""WITH {EFFECT_SQL}, a AS (SELECT channel, avg(level_d_abs) AS level, avg(diff_logvar) AS diff, avg(diff2_logvar) AS diff2 FROM eff GROUP BY channel),
u AS (SELECT channel, 'level' AS f, level AS v FROM a UNION ALL SELECT channel, 'diff', diff FROM a UNION ALL SELECT channel, 'diff2', diff2 FROM a),
k AS (SELECT f, rank() OVER (PARTITION BY channel ORDER BY v) + (count(*) OVER (PARTITION BY channel, v) - 1) / 2.0::DOUBLE AS r FROM u WHERE v IS NOT NULL),
s AS (SELECT f, sum(r) AS total, count(*) AS m FROM k GROUP BY f), w AS (SELECT 12 * var_pop(total) * count(*) / (max(m) * max(m) * (count(*) ** 3 - count(*))) AS w, max(m) AS m, count(*) AS k FROM s)
SELECT round(w, 6) AS w, round(m * (k - 1) * w, 6) AS chi2, round({chi2_sf_sql('(m * (k - 1) * w)', '(k - 1)')}, 6) AS p_value FROM w""")
def kendall_w(spark, sf_dir):
    means = _effects(spark, sf_dir).groupBy("channel").agg(F.avg("level_d_abs").alias("level"), F.avg("diff_logvar").alias("diff"), F.avg("diff2_logvar").alias("diff2"))
    return inference.kendall_w(means.unpivot("channel", ["level", "diff", "diff2"], "feature", "v").where("v IS NOT NULL"), "channel", "feature", "v")


@query(f"""WITH {CONTINGENCY_SQL}, p AS (SELECT channel, a + c AS hits, a + b + c + d AS n, (a + c) / (a + b + c + d)::DOUBLE AS p FROM tab)
SELECT channel, hits, n, round((p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 6) AS low,
  round((p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n)) / (1 + 1.96 * 1.96 / n), 6) AS high FROM p""")
def wilson_interval(spark, sf_dir):
    return inference.wilson(_contingency(spark, sf_dir).select("channel", (F.col("a") + F.col("c")).alias("hits"), (F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("n")), "hits", "n")


def _studies(spark, sf_dir):
    return meta.effect_variance(_effects(spark, sf_dir), ["channel"], "diff_logvar")


@query(f"WITH {STUDY_SQL} SELECT channel, round(yi, 6) AS yi, round(vi, 6) AS vi, n FROM studies")
def channel_effect_variance(spark, sf_dir):
    return _studies(spark, sf_dir)


@query(f"WITH {STUDY_SQL}, st AS (SELECT 'diff' AS feature, * FROM studies), {_pooled_sql('st', 'feature')}")
def dl_meta_effect(spark, sf_dir):
    return meta.pooled(_studies(spark, sf_dir).withColumn("feature", F.lit("diff")), ["feature"])


@query(f"""WITH {STUDY_SQL}, ex AS (SELECT channel AS excluded FROM studies UNION ALL SELECT '(none)'), st AS (SELECT e.excluded, s.* FROM studies s JOIN ex e ON s.channel <> e.excluded), {_pooled_sql('st', 'excluded')}""")
def loo_sensitivity(spark, sf_dir):
    return meta.left_out(_studies(spark, sf_dir).withColumn("feature", F.lit("diff")), ["feature"], "channel").drop("feature")


LABELLED_SQL = "lab AS (SELECT d.source, d.n_chars::DOUBLE AS s, l.quality = 1 AS pos FROM labels l JOIN documents d USING (doc_id))"


def _labelled(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.col("n_chars").cast("double").alias("s"))
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("pos")).join(docs, "doc_id").select("source", "s", "pos")


@query(f"""WITH {LABELLED_SQL}, k AS (SELECT pos, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM lab),
a AS (SELECT (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS a FROM k)
SELECT round(a, 6) AS auroc, round(greatest(a, 1 - a), 6) AS direction_agnostic FROM a""")
def auroc_pooled(spark, sf_dir):
    return inference.auroc(_labelled(spark, sf_dir), [], "s", "pos").withColumn("direction_agnostic", F.greatest(F.col("auroc"), 1 - F.col("auroc")))


@query(f"""WITH {LABELLED_SQL}, cl AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM lab)), k AS (SELECT count(*) AS k FROM cl),
dr AS (SELECT rep, CAST(floor({uniform_sql('auroc', 'rep', 'draw')} * k) AS BIGINT) AS i FROM k, range(1, 51) r(rep), range(1, 1000) q(draw) WHERE draw <= k),
w AS (SELECT rep, source, count(*)::DOUBLE AS w FROM dr JOIN cl USING (i) GROUP BY rep, source),
e AS (SELECT rep, s, sum(CASE WHEN pos THEN w ELSE 0 END) AS p, sum(CASE WHEN pos THEN 0 ELSE w END) AS q FROM lab JOIN w USING (source) GROUP BY rep, s),
b AS (SELECT rep, p, q, coalesce(sum(q) OVER (PARTITION BY rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM e)
SELECT rep, round(sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0), 6) AS auroc FROM b GROUP BY rep""")
def cluster_bootstrap_auroc(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    weights = alarms.cluster_weights(rows.select("source"), "source", 50, "auroc")
    return inference.auroc(rows.join(F.broadcast(weights), "source"), ["rep"], "s", "pos", "weight")


@query(f"""WITH {EFFECT_SQL}, a AS (SELECT avg(diff_logvar) AS v FROM eff WHERE diff_logvar IS NOT NULL GROUP BY channel), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS k FROM a),
f AS (SELECT m, abs(sum(CASE WHEN (m >> i) & 1 = 1 THEN -v ELSE v END)) AS s, abs(sum(v)) AS t FROM o, range(0, 1048576) r(m) WHERE m < (1 << k) GROUP BY m)
SELECT count(*) AS n_flips, round(avg((s >= t - 1e-12)::INT), 6) AS p_value FROM f""")
def sign_flip_enumeration(spark, sf_dir):
    return alarms.sign_flips(_effects(spark, sf_dir).where("diff_logvar IS NOT NULL").groupBy("channel").agg(F.avg("diff_logvar").alias("v")), "v")


@query(f"""WITH {Z_SQL}, n AS (SELECT * FROM peaks WHERE anomaly = 0 AND level_peak IS NOT NULL AND diff_peak IS NOT NULL AND diff2_peak IS NOT NULL),
r AS (SELECT {", ".join(f"(SELECT count(*) FROM n b WHERE b.{s}_peak >= n.{s}_peak) AS {s}" for s in ("level", "diff", "diff2"))} FROM n), m AS (SELECT least(level, diff, diff2) AS r FROM r),
c AS (SELECT r, (SELECT count(*) FROM m b WHERE b.r <= m.r) AS f, (SELECT count(*) FROM m) AS n FROM m)
SELECT round(max(r / n), 6) AS q, round(max(f / n), 6) AS joint_far FROM c WHERE f <= 0.1 * n""")
def joint_far_fusion(spark, sf_dir):
    return alarms.joint_false_alarm(_peaks(spark, sf_dir), ["level_peak", "diff_peak", "diff2_peak"], 0.1)


@query(f"""WITH {PIVOT_SQL} SELECT channel, segment, k, least(greatest(CAST(round_even((0.3 + 0.4 * {uniform_sql('placebo', 'channel', 'segment', 'k')}) * n, 0) AS BIGINT), 10), greatest(n - 5, 10)) AS pivot_t
FROM seg, range(1, 6) r(k) WHERE anomaly = 0 AND n >= 15""")
def placebo_pool(spark, sf_dir):
    rows = from_events(spark, sf_dir).groupBy("channel", "segment").agg(F.count(F.lit(1)).alias("n"), F.max("anomaly").alias("anomaly")).where("anomaly = 0 AND n >= 15")
    drawn = rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))))
    pivot_t = F.bround((0.3 + 0.4 * uniform("placebo", "channel", "segment", "k")) * F.col("n")).cast("long")
    return drawn.select("channel", "segment", "k", F.least(F.greatest(pivot_t, F.lit(10)), F.greatest(F.col("n") - 5, F.lit(10))).alias("pivot_t"))
