"""Queries of drawn onsets, their tiers, canonical pivots, and placebo pivots timed like them; with the SQL that says the same."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.functions.random import uniform_sql
from alarmlens.operators import bocpd, effects, inference, meta, onsets, studies
from alarmlens.operators.catalogue import MW_COLUMNS, SR_COLUMNS, _lv, _pooled_sql, query, rank_sum_sql, signed_rank_sql, welch_table_sql
from alarmlens.plans.detection import DETECT_SQL, found
from alarmlens.sources.shared import saved
from alarmlens.sources.telemetry import from_events

SERIES = onsets.SERIES

CANDIDATE_SQL = f"""{DETECT_SQL}, sg AS (SELECT channel, segment, count(*) AS n, max(anomaly) AS anomaly FROM tele GROUP BY channel, segment),
la AS (SELECT b.channel, b.segment, s.n, b.p FROM bo b JOIN sg s ON b.channel = s.channel AND b.segment = s.segment AND b.t = s.n - 1 WHERE s.anomaly = 1 AND s.n >= 15),
ca AS (SELECT channel, segment, n, n - 1 - unnest(range(0, len(p))) AS onset, unnest(p) AS p FROM la), cv AS (SELECT * FROM ca WHERE onset >= 10 AND onset <= n - 5),
cc AS (SELECT channel, segment, onset, sum(p) OVER w / sum(p) OVER (PARTITION BY channel, segment) AS at, max(onset) OVER (PARTITION BY channel, segment) AS final FROM cv WINDOW w AS (PARTITION BY channel, segment ORDER BY onset)),
dr AS (SELECT channel, segment, draw, {uniform_sql('mc', 'channel', 'segment', 'draw')} AS u FROM (SELECT DISTINCT channel, segment FROM cc), range(1, {onsets.DRAWS} + 1) q(draw)),
mc AS (SELECT d.channel, d.segment, d.draw, coalesce(min(c.onset) FILTER (c.at >= d.u), max(c.final)) AS onset FROM dr d JOIN cc c ON d.channel = c.channel AND d.segment = c.segment GROUP BY d.channel, d.segment, d.draw)"""
DRAW_SQL = f"""{CANDIDATE_SQL}, pt AS (SELECT DISTINCT channel, segment, onset AS pivot_t FROM mc),
nc AS (SELECT f.channel, f.segment, p.pivot_t, f.t, f.value, f.d, f.d2, f.t >= p.pivot_t AS post FROM dif f JOIN pt p ON f.channel = p.channel AND f.segment = p.segment WHERE f.t >= 5),
{welch_table_sql('', 'nc')}, de AS (SELECT m.*, {', '.join(f'w.{s}_d, w.{s}_p' for s in SERIES)} FROM mc m LEFT JOIN welch w ON m.channel = w.channel AND m.segment = w.segment AND m.onset = w.pivot_t)"""
_SUMS = ", ".join(
    f"median({s}_d) AS {s}_signed, median(abs({s}_d)) AS {s}_size, quantile_cont(abs({s}_d), 0.025::DOUBLE) AS {s}_low, quantile_cont(abs({s}_d), 0.975::DOUBLE) AS {s}_high, "
    f"greatest(count(*) FILTER ({s}_d > 0), count(*) FILTER ({s}_d < 0))::DOUBLE / nullif(count(*) FILTER ({s}_d <> 0), 0) AS {s}_consistency, avg(CASE WHEN {s}_p < 0.05 THEN 1.0::DOUBLE WHEN {s}_p IS NOT NULL THEN 0.0::DOUBLE END) AS {s}_significant"
    for s in SERIES
)
_NAMES = [f"{s}_{c}" for s in SERIES for c in ("signed", "size", "low", "high", "consistency", "significant")]
SUMMARY_SQL = f"""{DRAW_SQL}, ds AS (SELECT channel, segment, count(*) AS n_draws, stddev_pop(onset) AS onset_sd, {_SUMS} FROM de GROUP BY channel, segment),
su AS (SELECT s.channel, s.segment, s.n AS n_points, coalesce(n_draws, 0) AS n_draws, onset_sd, CASE WHEN coalesce(n_draws, 0) = 0 THEN 'excluded' WHEN n_draws >= 100 THEN 'high' WHEN n_draws >= 30 THEN 'medium' ELSE 'low' END AS tier, {', '.join(_NAMES)} FROM sg s LEFT JOIN ds ON s.channel = ds.channel AND s.segment = ds.segment WHERE s.anomaly = 1)"""
CANONICAL_SQL = f"""{SUMMARY_SQL}, cn AS (SELECT m.channel, m.segment, CAST(round_even(median(m.onset), 0) AS BIGINT) AS pivot_t FROM mc m JOIN su ON m.channel = su.channel AND m.segment = su.segment AND su.tier IN ('high', 'medium') GROUP BY m.channel, m.segment),
cp AS (SELECT c.*, s.n AS n_points, c.pivot_t / s.n::DOUBLE AS ratio, CASE WHEN c.pivot_t >= 10 AND c.pivot_t <= s.n - 5 THEN '' ELSE 'pivot_out_of_range' END AS skip_reason FROM cn c JOIN sg s ON c.channel = s.channel AND c.segment = s.segment)"""


def _segments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("channel", "segment").agg(F.count(F.lit(1)).alias("n_points"), F.max("anomaly").alias("anomaly"))


def _draws(spark, sf_dir) -> DataFrame:
    """Draws for anomalous segments of 15 samples or more, from one run of the detector; a query uses them in several places."""
    rows = from_events(spark, sf_dir)
    return _once(onsets.drawn(_once(bocpd.detect(rows.where("anomaly = 1"), bocpd.fitted(rows, mixture=False), whole=True).where("n_points >= 15").select("channel", "segment", "candidates"))))


def _summary(spark, sf_dir, draws: DataFrame) -> DataFrame:
    """One row an anomalous segment. Kept, as pooling meets it several times, and each time would sort all samples again."""
    rows = from_events(spark, sf_dir)
    return _once(onsets.segment_summary(onsets.draw_effects(rows, draws), _segments(rows).where("anomaly = 1").drop("anomaly")))


def _canonical(spark, sf_dir) -> DataFrame:
    draws = _draws(spark, sf_dir)
    counts = draws.groupBy("channel", "segment").agg(F.count(F.lit(1)).alias("n"))
    tiers = counts.withColumn("tier", onsets.tier(F.col("n")))  # the tier needs the number of draws alone
    return onsets.usable(onsets.canonical(draws, tiers), _segments(from_events(spark, sf_dir)))


@query(f"{DRAW_SQL} SELECT channel, segment, draw, onset, {', '.join(f'round({s}_{c}, 6) AS {s}_{c}' for s in SERIES for c in ('d', 'p'))} FROM de")
def mc_draws(spark, sf_dir):
    return onsets.draw_effects(from_events(spark, sf_dir), _draws(spark, sf_dir))


@query(f"{SUMMARY_SQL} SELECT channel, segment, n_points, n_draws, round(onset_sd, 6) AS onset_sd, tier, {', '.join(f'round({c}, 6) AS {c}' for c in _NAMES)} FROM su")
def mc_correction(spark, sf_dir):
    return _summary(spark, sf_dir, _draws(spark, sf_dir))


def _channel_columns() -> str:
    out = []
    for s in SERIES:
        out.append(f"round(avg({s}_significant) FILTER (good), 6) AS {s}_significant_mean")
        out += [f"round(sum(n_draws * {s}_{c}) FILTER (good) / nullif(sum(n_draws) FILTER (good AND {s}_{c} IS NOT NULL), 0), 6) AS {s}_{c}_weighted" for c in ("significant", "size", "signed", "consistency")]
        out += [f"round((count(*) FILTER (good AND {s}_signed {sign} 0))::DOUBLE / nullif(count(*) FILTER (good AND {s}_signed <> 0), 0), 6) AS {s}_{name}" for name, sign in (("positive", ">"), ("negative", "<"))]
    return ", ".join(out)


@query(f"{SUMMARY_SQL}, gs AS (SELECT *, tier IN ('high', 'medium') AS good FROM su) SELECT channel, count(*) AS n_segments, count(*) FILTER (good) AS n_reliable, count(*) FILTER (NOT good) AS n_excluded, {_channel_columns()} FROM gs GROUP BY channel")
def mc_channel_summary(spark, sf_dir):
    return onsets.channel_summary(_summary(spark, sf_dir, _draws(spark, sf_dir)))


@query(f"{SUMMARY_SQL} SELECT channel, {', '.join(f'''count(*) FILTER (tier = '{t}') AS {t}''' for t in ('high', 'medium', 'low', 'excluded'))} FROM su GROUP BY channel")
def tier_crosstab(spark, sf_dir):
    return onsets.tier_table(_summary(spark, sf_dir, _draws(spark, sf_dir)))


@query(f"{CANONICAL_SQL} SELECT channel, segment, pivot_t, n_points, round(ratio, 6) AS ratio, skip_reason FROM cp")
def canonical_onset(spark, sf_dir):
    return _canonical(spark, sf_dir)


def effect_table_sql(points: str, name: str) -> str:
    """name: pivot effects at points (channel, segment, pivot_t)."""
    return f"""{name}n AS (SELECT f.channel, f.segment, p.pivot_t, f.t, f.value, f.d, f.d2, f.t >= p.pivot_t AS post FROM dif f JOIN (SELECT DISTINCT channel, segment, pivot_t FROM {points}) p ON f.channel = p.channel AND f.segment = p.segment WHERE f.t >= 5),
{name} AS (SELECT channel, segment, pivot_t, CASE WHEN sqrt((var_samp(value) FILTER (post) + var_samp(value) FILTER (NOT post)) / 2) > 0 THEN
    abs((avg(value) FILTER (post) - avg(value) FILTER (NOT post)) / sqrt((var_samp(value) FILTER (post) + var_samp(value) FILTER (NOT post)) / 2)) END AS level_d_abs, {_lv("d")} AS diff_logvar, {_lv("d2")} AS diff2_logvar FROM {name}n GROUP BY channel, segment, pivot_t)"""


def cross_table_sql(points: str, name: str) -> str:
    """name: samples from the pivot to the first |z| over 3, at points (channel, segment, pivot_t)."""
    zs = ", ".join(f"abs({x} - avg({x}) FILTER (NOT post) OVER w) / nullif(stddev_samp({x}) FILTER (NOT post) OVER w, 0) AS {n}_z" for n, x in (("level", "value"), ("diff", "d"), ("diff2", "d2")))
    return f"""{name}n AS (SELECT f.channel, f.segment, p.pivot_t, f.t, f.value, f.d, f.d2, f.t >= p.pivot_t AS post FROM dif f JOIN (SELECT DISTINCT channel, segment, pivot_t FROM {points}) p ON f.channel = p.channel AND f.segment = p.segment WHERE f.t >= 5),
{name}z AS (SELECT *, {zs} FROM {name}n WINDOW w AS (PARTITION BY channel, segment, pivot_t)), {name} AS (SELECT channel, segment, pivot_t, {', '.join(f'min(t - pivot_t) FILTER ({s}_z > 3) AS {s}_cross' for s in SERIES)} FROM {name}z WHERE post GROUP BY channel, segment, pivot_t)"""


OBSERVED_SQL = f"{CANONICAL_SQL}, ok AS (SELECT * FROM cp WHERE skip_reason = ''), {effect_table_sql('ok', 'oe')}"
_EFFECTS = "round(level_d_abs, 6) AS level_d_abs, round(diff_logvar, 6) AS diff_logvar, round(diff2_logvar, 6) AS diff2_logvar"


def _observed(spark, sf_dir) -> DataFrame:
    return effects.pivot_effects(from_events(spark, sf_dir), _canonical(spark, sf_dir))


def _once(points: DataFrame) -> DataFrame:
    """Kept on disk while a query uses it in several places: some rows for each anomalous segment."""
    return points.persist(StorageLevel.DISK_ONLY)


@query(f"{OBSERVED_SQL} SELECT channel, segment, pivot_t, {_EFFECTS} FROM oe")
def canonical_effects(spark, sf_dir):
    return _observed(spark, sf_dir)


def _pool_sql(name: str, stream: str, draws: int, most: int, by_channel: bool) -> str:
    part, size_on = ("PARTITION BY channel", "s.channel = m.channel") if by_channel else ("", "true")
    met = "r.number = e.number AND r.channel = e.channel" if by_channel else "r.number = e.number"
    return f"""{name}r AS (SELECT channel, ratio, row_number() OVER ({part} ORDER BY channel, segment) - 1 AS number, count(*) OVER ({part}) AS size FROM ok),
{name}s AS (SELECT DISTINCT {'channel, ' if by_channel else ''}size FROM {name}r),
{name}m AS (SELECT channel, segment, n FROM (SELECT channel, segment, n, row_number() OVER (PARTITION BY channel ORDER BY {uniform_sql(stream + '-order', 'channel', 'segment')}, channel, segment) AS place FROM sg WHERE anomaly = 0) WHERE place <= {most}),
{name}e AS (SELECT m.channel, m.segment, m.n, draw, CAST(floor({uniform_sql(stream, 'm.channel', 'm.segment', 'draw')} * s.size) AS BIGINT) AS number FROM {name}m m JOIN {name}s s ON {size_on}, range(1, {draws} + 1) q(draw)),
{name} AS (SELECT * FROM (SELECT e.channel, e.segment, e.draw, e.n, least(greatest(CAST(round_even(r.ratio * e.n, 0) AS BIGINT), 10), greatest(e.n - 5, 10)) AS pivot_t FROM {name}e e JOIN {name}r r ON {met}) WHERE pivot_t <= n - 5)"""


POOL_SQL = f"{OBSERVED_SQL}, {_pool_sql('pp', 'pool', onsets.PLACEBO_DRAWS, onsets.MOST_NORMAL, True)}, {effect_table_sql('pp', 'pe')}"


def _pool(rows: DataFrame, points: DataFrame, stream: str = "pool", draws: int = onsets.PLACEBO_DRAWS, most: int = onsets.MOST_NORMAL, by_channel: bool = True) -> DataFrame:
    normal = _segments(rows).where("anomaly = 0").select("channel", "segment", "n_points")
    return onsets.placebo(points.where("skip_reason = ''"), normal, stream, draws, most, by_channel)


def _placebo(rows: DataFrame, points: DataFrame) -> DataFrame:
    pool = _pool(rows, points)
    return pool.join(studies.at_pivots(rows, pool), ["channel", "segment", "pivot_t"], "left")


@query(f"{POOL_SQL} SELECT p.channel, p.segment, p.draw, p.pivot_t, {_EFFECTS} FROM pp p LEFT JOIN pe e ON p.channel = e.channel AND p.segment = e.segment AND p.pivot_t = e.pivot_t")
def onset_placebo_pool(spark, sf_dir):
    """Placebo pivots at ratios drawn from the same channel's canonical onsets, with their effects."""
    return _placebo(from_events(spark, sf_dir), _canonical(spark, sf_dir))


def _both(spark, sf_dir) -> DataFrame:
    """Observed (label 1) and placebo (label 0) effects, as one table."""
    columns = ["channel", "segment", "label", "pivot_t", "level_d_abs", "diff_logvar", "diff2_logvar"]
    rows, points = from_events(spark, sf_dir), _once(_canonical(spark, sf_dir))
    return effects.pivot_effects(rows, points).withColumn("label", F.lit(1).cast("long")).select(*columns).unionByName(_placebo(rows, points).withColumn("label", F.lit(0).cast("long")).select(*columns))


BOTH_SQL = f"""{POOL_SQL}, bt AS (SELECT channel, segment, 1::BIGINT AS label, pivot_t, level_d_abs, diff_logvar, diff2_logvar FROM oe UNION ALL
 SELECT p.channel, p.segment, 0::BIGINT, p.pivot_t, level_d_abs, diff_logvar, diff2_logvar FROM pp p LEFT JOIN pe e ON p.channel = e.channel AND p.segment = e.segment AND p.pivot_t = e.pivot_t)"""
_COMPLETE = "level_d_abs IS NOT NULL AND diff_logvar IS NOT NULL AND diff2_logvar IS NOT NULL"


@query(f"{BOTH_SQL} SELECT channel, segment, channel || '_' || segment AS \"group\", label, pivot_t, {_EFFECTS} FROM bt WHERE {_COMPLETE}")
def onset_tabular_dataset(spark, sf_dir):
    rows = _both(spark, sf_dir).dropna(subset=["level_d_abs", "diff_logvar", "diff2_logvar"])
    return rows.withColumn("group", F.concat_ws("_", "channel", "segment"))


@query(f"""{BOTH_SQL}, pw AS (SELECT DISTINCT b.channel, b.segment, b.label, b.pivot_t, s.n FROM bt b JOIN sg s ON b.channel = s.channel AND b.segment = s.segment WHERE b.pivot_t - 17 >= 0 AND b.pivot_t + 15 <= s.n),
w AS (SELECT p.channel, p.segment, p.label, p.pivot_t, f.t - p.pivot_t + 15 AS k, f.value, f.d, f.d2 FROM dif f JOIN pw p ON f.channel = p.channel AND f.segment = p.segment WHERE f.t >= p.pivot_t - 15 AND f.t < p.pivot_t + 15)
SELECT channel, segment, label, pivot_t, k, {", ".join(f"round(({x} - avg({x}) OVER v) / (stddev_pop({x}) OVER v + 1e-8::DOUBLE), 6) AS {n}" for n, x in (("level", "value"), ("diff", "d"), ("diff2", "d2")))} FROM w WINDOW v AS (PARTITION BY channel, segment, label, pivot_t)""")
def onset_sequence_dataset(spark, sf_dir):
    """Windows around the same pivots, observed and placebo; each distinct pivot once."""
    points = _both(spark, sf_dir).select("channel", "segment", "label", "pivot_t").distinct()
    rows = from_events(spark, sf_dir)
    made = points.join(_segments(rows).select("channel", "segment", F.col("n_points").alias("n")), ["channel", "segment"]).withColumn("skip_reason", F.lit(""))
    return studies.windows(rows, made).join(points, ["channel", "segment", "pivot_t"])


def _long(rows: DataFrame) -> DataFrame:
    pairs = ", ".join(f"'{s}', {c}" for s, c in zip(SERIES, ("level_d_abs", "diff_logvar", "diff2_logvar")))
    return rows.select("channel", "segment", "label", F.expr(f"stack(3, {pairs}) AS (feature, v)"))


LONG_SQL = " UNION ALL ".join(f"SELECT channel, segment, label, '{s}' AS feature, {c} AS v FROM bt" for s, c in zip(SERIES, ("level_d_abs", "diff_logvar", "diff2_logvar")))


@query(f"""{BOTH_SQL}, lg AS ({LONG_SQL}), pn AS (SELECT channel, feature, count(v) AS n, median(v) AS middle, quantile_cont(v, 0.95::DOUBLE) AS p95 FROM lg WHERE label = 0 GROUP BY channel, feature),
ob AS (SELECT * FROM lg WHERE label = 1 AND v IS NOT NULL), ab AS (SELECT o.channel, o.segment, o.feature, o.v, count(x.v) FILTER (x.v >= o.v) AS above FROM ob o LEFT JOIN lg x ON x.label = 0 AND x.channel = o.channel AND x.feature = o.feature GROUP BY ALL)
SELECT a.channel, a.segment, a.feature, round(a.v, 6) AS observed, coalesce(p.n, 0) AS placebo_n, round(p.middle, 6) AS placebo_median, round(p.p95, 6) AS placebo_p95, round(CASE WHEN p.n >= 20 THEN (1 + a.above) / (p.n + 1)::DOUBLE END, 6) AS p_value FROM ab a LEFT JOIN pn p ON a.channel = p.channel AND a.feature = p.feature""")
def onset_empirical_pvalues(spark, sf_dir):
    """One-sided p of each observed effect among its channel's placebo, with the placebo's median and 95 % point, by feature."""
    rows = _long(_both(spark, sf_dir)).withColumn("channel_feature", F.concat_ws("|", "channel", "feature"))
    keyed = rows.select(F.col("channel_feature").alias("channel"), "segment", "label", "v")
    p = studies.empirical_p(keyed.where("label = 1"), keyed.where("label = 0"), "v")
    spread = keyed.where("label = 0").groupBy("channel").agg(F.median("v").alias("placebo_median"), F.percentile("v", F.lit(0.95)).alias("placebo_p95"))
    out = p.join(spread, "channel", "left").withColumn("both", F.split("channel", r"\|"))
    return out.select(F.col("both")[0].alias("channel"), "segment", F.col("both")[1].alias("feature"), "observed", "placebo_n", "placebo_median", "placebo_p95", "p_value")


def _compared(rows: DataFrame, by: list[str], family: list[str] | None = None) -> DataFrame:
    """Mann-Whitney of observed over placebo, medians, and Bonferroni over all tests that could be made."""
    tests = inference.mann_whitney(rows.withColumn("one", F.col("label") == 1), by, "v", "one")
    middle = rows.groupBy(*by).agg(F.median(F.when(F.col("label") == 1, F.col("v"))).alias("median_anomaly"), F.median(F.when(F.col("label") == 0, F.col("v"))).alias("median_placebo"))
    return inference.bonferroni(tests.join(middle, by), "p_value", family)


def _compared_sql(rows: str) -> str:
    return f"""cx AS (SELECT channel || '|' || feature AS k, label AS anomaly, v FROM {rows}), {rank_sum_sql('cx', 'k')},
cm AS (SELECT channel, feature, median(v) FILTER (label = 1) AS median_anomaly, median(v) FILTER (label = 0) AS median_placebo FROM {rows} GROUP BY channel, feature),
cr AS (SELECT m.channel, m.feature, n1, n0, u, z, method, p_value, median_anomaly, median_placebo, CASE WHEN p_value IS NOT NULL THEN least(1, p_value * count(p_value) OVER ()) END AS p_bonferroni FROM cm m LEFT JOIN mw ON mw.k = m.channel || '|' || m.feature)"""


@query(f"{BOTH_SQL}, lg AS ({LONG_SQL}), lv AS (SELECT * FROM lg WHERE v IS NOT NULL), {_compared_sql('lv')} SELECT channel, feature, {MW_COLUMNS}, round(median_anomaly, 6) AS median_anomaly, round(median_placebo, 6) AS median_placebo, round(p_bonferroni, 6) AS p_bonferroni FROM cr")
def placebo_mannwhitney(spark, sf_dir):
    return _compared(_long(_both(spark, sf_dir)).where("v IS NOT NULL"), ["channel", "feature"])


# Slices: the same comparison on all, held-in and held-out segments, side by side.


SLICES = {"full": "true", "train": "segment % 4 <> 0", "test": "segment % 4 = 0"}


def _slice_part(name: str) -> str:
    return f"{name}s AS (WITH RECURSIVE lv AS (SELECT * FROM lg WHERE v IS NOT NULL AND {SLICES[name]}), {_compared_sql('lv')} SELECT * FROM cr)"


def _agree(columns: list[str]) -> str:
    return f"CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in columns)} THEN {columns[0]} = {columns[1]} AND {columns[1]} = {columns[2]} END"


_SIDES = ", ".join(f"{s}s.p_bonferroni AS p_{s}, {s}s.p_bonferroni < 0.05 AS sig_{s}, {s}s.median_anomaly AS anomaly_{s}, {s}s.median_placebo AS placebo_{s}" for s in SLICES)


@query(f"""{BOTH_SQL}, lg AS ({LONG_SQL}), {', '.join(map(_slice_part, SLICES))}, j AS (SELECT channel, feature, {_SIDES} FROM fulls JOIN trains USING (channel, feature) JOIN tests USING (channel, feature))
SELECT channel, feature, {', '.join(f'round(p_{s}, 6) AS p_{s}, sig_{s}, round(anomaly_{s}, 6) AS anomaly_{s}, round(placebo_{s}, 6) AS placebo_{s}' for s in ('full', 'train', 'test'))}, {_agree(['sig_full', 'sig_train', 'sig_test'])} AS all_agree FROM j""")
def triple_verification(spark, sf_dir):
    """Whether all, held-in and held-out segments lead to the same verdict; null where one of them can't decide."""
    which = F.array_compact(F.array(*[F.when(F.expr(where), F.lit(name)) for name, where in SLICES.items()]))
    rows = _long(_both(spark, sf_dir)).where("v IS NOT NULL").withColumn("slice", F.explode(which))
    tests = _compared(rows, ["slice", "channel", "feature"], ["slice"])
    columns = {"p": F.col("p_bonferroni"), "sig": F.col("p_bonferroni") < 0.05, "anomaly": F.col("median_anomaly"), "placebo": F.col("median_placebo")}
    out = tests.groupBy("channel", "feature").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("slice") == s, c)).alias(f"{name}_{s}") for s in SLICES for name, c in columns.items()]).where("n = 3").drop("n")
    same = (F.col("sig_full") == F.col("sig_train")) & (F.col("sig_train") == F.col("sig_test"))
    decided = F.col("sig_full").isNotNull() & F.col("sig_train").isNotNull() & F.col("sig_test").isNotNull()
    return out.withColumn("all_agree", F.when(decided, same))


# Precedence at canonical onsets, in seconds, against normal segments.

PAIRS = (("level", "diff"), ("level", "diff2"), ("diff", "diff2"))
CROSS_SQL = f"{OBSERVED_SQL}, {cross_table_sql('ok', 'oc')}, {_pool_sql('np', 'control', 1, 200, False)}, {cross_table_sql('np', 'xc')}"


def _crossings(spark, sf_dir, sampling: float = 1.0) -> DataFrame:
    """Seconds to the first crossing, at canonical onsets (anomalous) and at control pivots of normal segments."""
    rows = from_events(spark, sf_dir)
    points = _once(_canonical(spark, sf_dir))
    control = _pool(rows, points, "control", 1, 200, by_channel=False).withColumn("skip_reason", F.lit(""))
    parts = [effects.crossing_times(rows, p).withColumn("side", F.lit(side)) for p, side in ((points, "anomalous"), (control, "normal"))]
    both = parts[0].unionByName(parts[1])
    return both.select("side", "channel", "segment", "pivot_t", *[(F.col(f"{s}_cross") * F.lit(sampling)).alias(f"{s}_seconds") for s in SERIES])


BOTH_CROSS_SQL = "bc AS (SELECT 'anomalous' AS side, * FROM oc UNION ALL SELECT 'normal', * FROM xc)"


@query(f"{CROSS_SQL}, {BOTH_CROSS_SQL} SELECT side, channel, segment, pivot_t, {', '.join(f'round({s}_cross::DOUBLE, 6) AS {s}_seconds' for s in SERIES)} FROM bc")
def crossing_seconds(spark, sf_dir):
    return _crossings(spark, sf_dir)


@query(f"{OBSERVED_SQL}, {_pool_sql('np', 'control', 1, 200, False)} SELECT channel, segment, pivot_t FROM np")
def normal_control_pivots(spark, sf_dir):
    """One pivot for each normal segment (at most 200 a channel), at a ratio from all channels' canonical onsets."""
    return _pool(from_events(spark, sf_dir), _canonical(spark, sf_dir), "control", 1, 200, by_channel=False).drop("draw")


def _pairs(rows: DataFrame) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.col(f"{a}_seconds") - F.col(f"{b}_seconds")).alias("v")) for a, b in PAIRS])
    return rows.select("side", "channel", "segment", F.inline(pairs))


PAIR_SQL = " UNION ALL ".join(f"SELECT side, channel, segment, '{a}-{b}' AS pair, ({a}_cross - {b}_cross)::DOUBLE AS v FROM bc" for a, b in PAIRS)


@query(f"""{CROSS_SQL}, {BOTH_CROSS_SQL}, pr AS ({PAIR_SQL}), kx AS (SELECT side || '|' || c || '|' || pair AS test, v FROM pr, (VALUES ('all'), (channel)) q(c) WHERE side = 'anomalous' OR c = 'all'),
{signed_rank_sql('kx', 'test')} SELECT test, {SR_COLUMNS}, round(CASE WHEN p_value IS NOT NULL THEN least(1, p_value * count(p_value) OVER ()) END, 6) AS p_bonferroni FROM sr""")
def precedence_wilcoxon(spark, sf_dir):
    """Signed-rank tests of the crossing times' differences by pair: pooled and by channel for anomalous segments, pooled for normal ones; Bonferroni over all."""
    rows = _pairs(_crossings(spark, sf_dir)).withColumn("c", F.explode(F.array(F.lit("all"), F.col("channel")))).where("side = 'anomalous' OR c = 'all'")
    return inference.bonferroni(inference.wilcoxon(rows.select(F.concat_ws("|", "side", "c", "pair").alias("test"), "v"), ["test"], "v"), "p_value")


# Pooled shares.


SHARE_SQL = f"{SUMMARY_SQL}, sh AS ({' UNION ALL '.join(f'''SELECT channel, '{s}' AS feature, asin(sqrt(least(greatest({s}_significant, 1e-6), 1 - 1e-6))) AS x FROM su WHERE tier IN ('high', 'medium') AND {s}_significant IS NOT NULL''' for s in SERIES)})"
STUDY_TABLE_SQL = "st AS (SELECT feature, channel, avg(x) AS yi, CASE WHEN count(x) >= 2 AND var_samp(x) > 0 THEN var_samp(x) / count(x) END AS vi FROM sh GROUP BY feature, channel)"
_BACK = "pow(sin(least(greatest({}, 0), pi() / 2)), 2)"


def _shares(spark, sf_dir) -> DataFrame:
    summary = _summary(spark, sf_dir, _draws(spark, sf_dir)).where("tier IN ('high', 'medium')")
    return summary.select("channel", F.expr(f"stack(3, {', '.join(f'''{chr(39)}{s}{chr(39)}, {s}_significant''' for s in SERIES)}) AS (feature, share)")).where("share IS NOT NULL")


def _share_sql(rows: str, by: str) -> str:
    pooled = _pooled_sql(rows, by).replace("round(mu, 6) AS mu", "mu").replace("round(mu - 1.96 * se, 6) AS low", "mu - 1.96 * se AS low").replace("round(mu + 1.96 * se, 6) AS high", "mu + 1.96 * se AS high")
    return f"po AS (WITH {pooled}) SELECT {by}, k, round(mu, 6) AS arcsine_mu, round({_BACK.format('mu')}, 6) AS share, round({_BACK.format('low')}, 6) AS share_low, round({_BACK.format('high')}, 6) AS share_high, q, tau2, i2, i2_band, p_value, p_q FROM po"


@query(f"{SHARE_SQL}, {STUDY_TABLE_SQL}, {_share_sql('st', 'feature')}")
def dl_meta_fraction(spark, sf_dir):
    """Shares of significant draws, pooled over channels on the arcsine scale."""
    return meta.pooled_share(_shares(spark, sf_dir), ["feature"], "channel", "share").where("k >= 2")


@query(f"""{SUMMARY_SQL}, sh AS ({' UNION ALL '.join(f'''SELECT channel, '{s}' AS feature, {s}_size AS x FROM su WHERE tier IN ('high', 'medium') AND {s}_size IS NOT NULL''' for s in SERIES)}), {STUDY_TABLE_SQL}, {_pooled_sql('st', 'feature')}""")
def dl_meta_by_feature(spark, sf_dir):
    """Absolute effects at drawn onsets, pooled over channels, by feature."""
    summary = _summary(spark, sf_dir, _draws(spark, sf_dir)).where("tier IN ('high', 'medium')")
    rows = summary.select("channel", F.expr(f"stack(3, {', '.join(f'''{chr(39)}{s}{chr(39)}, {s}_size''' for s in SERIES)}) AS (feature, x)"))
    return meta.pooled(meta.effect_variance(rows, ["feature", "channel"], "x"), ["feature"]).where("k >= 2")


def _left_out_sql(back: str) -> str:
    """Pooling of st by feature, with each channel left out and with none, and what that changes; back takes the pooled scale to the reported one."""
    pooled = _pooled_sql("lo", "fe").replace("round(mu, 6) AS mu", "mu").replace("round(mu - 1.96 * se, 6) AS low", "mu - 1.96 * se AS low").replace("round(mu + 1.96 * se, 6) AS high", "mu + 1.96 * se AS high")
    values = ", ".join(f"round({back.format(f'p.{c}')}, 6) AS {n}" for c, n in (("mu", "pooled"), ("low", "low"), ("high", "high")))
    return f"""ex AS (SELECT DISTINCT feature, channel AS excluded FROM st UNION SELECT DISTINCT feature, '(none)' FROM st), lo AS (SELECT s.feature || '/' || e.excluded AS fe, s.channel, yi, vi FROM st s JOIN ex e ON s.feature = e.feature AND s.channel <> e.excluded),
po AS (WITH {pooled}), pf AS (SELECT split_part(fe, '/', 1) AS feature, split_part(fe, '/', 2) AS excluded, * EXCLUDE (fe) FROM po)
SELECT p.feature, p.excluded, p.k, {values}, p.tau2, p.p_value, p.i2, round({back.format('p.mu')} - {back.format('w.mu')}, 6) AS shift, round(w.i2 - p.i2, 6) AS i2_drop FROM pf p JOIN pf w ON p.feature = w.feature AND w.excluded = '(none)'"""


def _left_out(studies_: DataFrame, back) -> DataFrame:
    rows = saved(meta.left_out(saved(studies_), ["feature"], "channel").where("k >= 2").withColumn("i2", F.round("i2", 6)))
    whole = rows.where("excluded = '(none)'").select("feature", F.col("mu").alias("mu_w"), F.col("i2").alias("i2_w"))
    values = [back(F.col(c)).alias(n) for c, n in (("mu", "pooled"), ("low", "low"), ("high", "high"))]
    return rows.join(whole, "feature").select("feature", "excluded", "k", *values, "tau2", "p_value", "i2", (back(F.col("mu")) - back(F.col("mu_w"))).alias("shift"), (F.col("i2_w") - F.col("i2")).alias("i2_drop"))


@query(f"""{SUMMARY_SQL}, sh AS ({' UNION ALL '.join(f'''SELECT channel, '{s}' AS feature, {s}_size AS x FROM su WHERE tier IN ('high', 'medium') AND {s}_size IS NOT NULL''' for s in SERIES)}), {STUDY_TABLE_SQL}, {_left_out_sql('{}')}""")
def loo_by_feature(spark, sf_dir):
    """Absolute effects at drawn onsets pooled without each channel, by feature, and what its absence changes."""
    summary = _summary(spark, sf_dir, _draws(spark, sf_dir)).where("tier IN ('high', 'medium')")
    rows = summary.select("channel", F.expr(f"stack(3, {', '.join(f'''{chr(39)}{s}{chr(39)}, {s}_size''' for s in SERIES)}) AS (feature, x)"))
    return _left_out(meta.effect_variance(rows, ["feature", "channel"], "x"), lambda x: x)


@query(f"{SHARE_SQL}, {STUDY_TABLE_SQL}, {_left_out_sql(_BACK)}")
def loo_fraction(spark, sf_dir):
    """Shares of significant draws pooled without each channel, by feature, on the shares' own scale."""
    rows = _shares(spark, sf_dir).withColumn("x", meta.arcsine(F.col("share")))
    return _left_out(meta.effect_variance(rows, ["feature", "channel"], "x"), meta.from_arcsine)
