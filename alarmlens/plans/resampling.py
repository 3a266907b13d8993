"""Queries of nested and wild bootstraps, fused calibration, detector-matched placebos and audits, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from alarmlens.functions.random import uniform_sql
from alarmlens.operators import alarms, bocpd, effects, inference, meta, profile, resampling, rules, studies
from alarmlens.operators.catalogue import EFFECT_SQL, MW_COLUMNS, NOISE_SQL, NOMINAL_SQL, PIVOT_SQL, SR_COLUMNS, TELEMETRY_SQL, Z_SQL, _effects, _labelled, _peaks, query, rank_sum_sql, signed_rank_sql
from alarmlens.plans.detection import DETECT_SQL, found
from alarmlens.plans.evidence import ORACLES, best_lag_xcorr, influence_flags
from alarmlens.plans.onsets import effect_table_sql
from alarmlens.sources.telemetry import from_events

REPS = 1000
FEATURES = ["level_peak", "diff_peak", "diff2_peak"]
LEVELS = [0.005, 0.01, 0.02, 0.05, 0.1, 0.2]


def _auc_of(rows: str, score: str) -> str:
    return f"SELECT rep, sum(won) / nullif(sum(p) * sum(q), 0) AS a FROM (SELECT rep, p, q, p * (coalesce(sum(q) OVER (PARTITION BY rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS won FROM (SELECT rep, {score} AS s, sum(CASE WHEN anomaly = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN anomaly = 0 THEN w ELSE 0 END) AS q FROM {rows} GROUP BY rep, {score})) GROUP BY rep"


@query(f"""WITH {Z_SQL}, un AS (SELECT channel, segment, anomaly, level_peak, diff_peak FROM peaks WHERE level_peak IS NOT NULL AND diff_peak IS NOT NULL),
nu AS (SELECT channel, row_number() OVER (ORDER BY channel) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT channel FROM un)),
o AS (SELECT rep, CAST(floor({uniform_sql('tl-outer', 'rep', 'draw')} * k) AS BIGINT) AS i FROM (SELECT DISTINCT k FROM nu), range(1, {REPS} + 1) r(rep), range(1, 1000) d(draw) WHERE draw <= k),
f AS (SELECT rep, channel, count(*)::DOUBLE AS m FROM o JOIN nu USING (i) GROUP BY rep, channel),
ins AS (SELECT channel, segment, row_number() OVER (PARTITION BY channel ORDER BY segment) - 1 AS j, count(*) OVER (PARTITION BY channel) AS n FROM un),
pk AS (SELECT rep, f.channel, m, CAST(floor({uniform_sql('tl-inner', 'rep', 'f.channel', 'ins.j')} * n) AS BIGINT) AS j FROM f JOIN ins ON f.channel = ins.channel),
we AS (SELECT p.rep, i.channel, i.segment, p.m * p.c AS w FROM (SELECT rep, channel, j, m, count(*) AS c FROM pk GROUP BY ALL) p JOIN ins i ON p.channel = i.channel AND p.j = i.j),
wr AS (SELECT rep, anomaly, level_peak, diff_peak, w FROM un JOIN we USING (channel, segment)), x AS ({_auc_of('wr', 'level_peak')}), y AS ({_auc_of('wr', 'diff_peak')}),
z AS (SELECT y.a AS diff, x.a AS level, y.a - x.a AS difference FROM x JOIN y USING (rep)), l AS ({' UNION ALL '.join(f"SELECT '{c}' AS quantity, {c} AS v FROM z" for c in ('level', 'diff', 'difference'))})
SELECT quantity, count(v) AS n_replicates, round(quantile_cont(v, 0.025::DOUBLE), 6) AS low, round(quantile_cont(v, 0.5::DOUBLE), 6) AS mid, round(quantile_cont(v, 0.975::DOUBLE), 6) AS high FROM l GROUP BY quantity""")
def two_level_bootstrap(spark, sf_dir):
    """AUROC of level and diff peaks, and their difference, over channels and segments inside them; both share each resample."""
    rows = _peaks(spark, sf_dir).dropna(subset=["level_peak", "diff_peak"]).withColumn("pos", F.col("anomaly") == 1)
    weights = resampling.two_level_weights(rows.select("channel", "segment"), "channel", "segment", REPS, "tl")
    reps = resampling.contrast(rows, weights, ["channel", "segment"], "diff_peak", "level_peak", "pos")
    long = reps.select(F.expr("stack(3, 'level', level_peak, 'diff', diff_peak, 'difference', difference) AS (quantity, v)"))
    return resampling.interval(long, ["quantity"], "v")


@query(f"""WITH {Z_SQL}, un AS (SELECT channel, anomaly, level_peak, diff_peak FROM peaks WHERE level_peak IS NOT NULL AND diff_peak IS NOT NULL),
cl AS (SELECT channel, row_number() OVER (ORDER BY channel) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT channel FROM un)),
dr AS (SELECT rep, CAST(floor({uniform_sql('contrast', 'rep', 'draw')} * k) AS BIGINT) AS i FROM (SELECT DISTINCT k FROM cl), range(1, {REPS} + 1) r(rep), range(1, 1000) q(draw) WHERE draw <= k),
we AS (SELECT rep, channel, count(*)::DOUBLE AS w FROM dr JOIN cl USING (i) GROUP BY rep, channel), wr AS (SELECT rep, anomaly, level_peak, diff_peak, w FROM un JOIN we USING (channel)),
x AS ({_auc_of('wr', 'level_peak')}), y AS ({_auc_of('wr', 'diff_peak')}), z AS (SELECT y.a - x.a AS v FROM x JOIN y USING (rep))
SELECT count(v) AS n_replicates, round(quantile_cont(v, 0.025::DOUBLE), 6) AS low, round(quantile_cont(v, 0.5::DOUBLE), 6) AS mid, round(quantile_cont(v, 0.975::DOUBLE), 6) AS high FROM z""")
def cluster_bootstrap_contrast(spark, sf_dir):
    """The difference of diff's and level's AUROC, over channels drawn with replacement."""
    rows = _peaks(spark, sf_dir).withColumn("pos", F.col("anomaly") == 1)
    weights = alarms.cluster_weights(rows.dropna(subset=["level_peak", "diff_peak"]).select("channel"), "channel", REPS, "contrast")
    return resampling.interval(resampling.contrast(rows, weights, ["channel"], "diff_peak", "level_peak", "pos"), [], "difference")


@query(f"""WITH lab AS (SELECT d.source, d.n_chars::DOUBLE AS s, l.quality = 1 AS pos FROM labels l JOIN documents d USING (doc_id)), e AS (SELECT s, (count(*) FILTER (pos))::DOUBLE AS p, (count(*) FILTER (NOT pos))::DOUBLE AS q FROM lab GROUP BY s),
t AS (SELECT s, p, sum(p) OVER () AS np, sum(q) OVER () AS nq, (coalesce(sum(q) OVER o, 0) + q / 2) / sum(q) OVER () AS wins, (sum(p) OVER () - coalesce(sum(p) OVER o, 0) - p / 2) / sum(p) OVER () AS losses FROM e WINDOW o AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, sum(p * wins) OVER () / np AS auroc FROM t), ps AS (SELECT l.source, max(auroc) AS auroc, sum(CASE WHEN pos THEN (wins - auroc) / np ELSE (losses - auroc) / nq END) AS psi FROM lab l JOIN a USING (s) GROUP BY l.source),
d AS (SELECT rep, source, auroc, psi, {uniform_sql('wild', 'rep', 'source')} AS u FROM ps, range(1, 2001) r(rep)),
w AS (SELECT 'rademacher' AS scheme, rep, auroc, psi * CASE WHEN u < 0.5 THEN -1 ELSE 1 END AS x FROM d UNION ALL SELECT 'webb', rep, auroc, psi * ([{', '.join(f'{x!r}::DOUBLE' for x in resampling.WEBB)}])[CAST(floor(u * 6) AS BIGINT) + 1] FROM d),
g AS (SELECT scheme, rep, max(auroc) + sum(x) AS v FROM w GROUP BY scheme, rep)
SELECT scheme, count(v) AS n_replicates, round(quantile_cont(v, 0.025::DOUBLE), 6) AS low, round(quantile_cont(v, 0.5::DOUBLE), 6) AS mid, round(quantile_cont(v, 0.975::DOUBLE), 6) AS high FROM g GROUP BY scheme""")
def wild_cluster_bootstrap(spark, sf_dir):
    """AUROC's interval from random weights on its clusters' influence, 2,000 replicates."""
    psi = resampling.influence(_labelled(spark, sf_dir), "source", "s", "pos")
    return resampling.interval(resampling.wild(psi, "source", 2000), ["scheme"], "auroc")


def _fused_sql(rows: str, by: str, features: list[str] = FEATURES, levels: list[float] = LEVELS) -> str:
    part, names = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    ranks = ", ".join(f"count(*) FILTER (anomaly = 0) OVER ({part}ORDER BY {f} DESC RANGE UNBOUNDED PRECEDING) AS {f}_rank" for f in features)
    return f"""fr AS (SELECT {names}anomaly, count(*) FILTER (anomaly = 0) OVER ({part.strip()}) AS n, {ranks} FROM {rows} WHERE {' AND '.join(f'{f} IS NOT NULL' for f in features)}),
ff AS (SELECT {names}anomaly, n, least({', '.join(f'{f}_rank' for f in features)}) AS rank FROM fr), fc AS (SELECT {names}rank, max(n) AS n, count(*) FILTER (anomaly = 0) AS c FROM ff GROUP BY {names}rank),
ft AS (SELECT *, sum(c) OVER ({part}ORDER BY rank) AS firing FROM fc WHERE c > 0), fb AS (SELECT {names}level, max(rank) AS cut, max(firing) AS firing, max(n) AS n FROM ft, (VALUES {', '.join(f'({x}::DOUBLE)' for x in levels)}) v(level) WHERE firing <= level * n GROUP BY {names}level),
fh AS (SELECT {names}rank, count(*) AS c FROM ff WHERE anomaly = 1 GROUP BY {names}rank)
SELECT {f'b.{by}, ' if by else ''}level, round(cut / b.n::DOUBLE, 6) AS q, round(firing / b.n::DOUBLE, 6) AS joint_far, round(sum(CASE WHEN rank < cut THEN c ELSE 0 END) / sum(c)::DOUBLE, 6) AS coverage FROM fb b JOIN fh h ON {f'b.{by} = h.{by}' if by else 'true'} GROUP BY {f'b.{by}, ' if by else ''}level, cut, firing, b.n"""


@query(f"WITH {Z_SQL}, {_fused_sql('peaks', '')}")
def joint_far_grid(spark, sf_dir):
    """Fused calibration over levels from 0.5 to 20 %, with coverage."""
    return resampling.fused(_peaks(spark, sf_dir), FEATURES, LEVELS)


_STATISTICS = ", ".join(f"round({c}, 6) AS {c}" for c in rules.STATISTICS)
SLOTS, RULE_LEVELS = ["s1", "s2", "s3", "s4"], [0.01, 0.05]


@query(f"WITH {PIVOT_SQL}, {rules.STATISTICS_SQL} SELECT channel, segment, pivot_t, {_STATISTICS} FROM st")
def rule_statistics(spark, sf_dir):
    """Seventeen chart statistics of each pivot's window: peaks, shifts, variances, sums, weighted means, and longest runs on one side."""
    rows = from_events(spark, sf_dir)
    return rules.statistics(rows, effects.pivots(rows))


@query(f"WITH {PIVOT_SQL}, {rules.STATISTICS_SQL}, {rules.BY_RULE_SQL}, {_fused_sql('br', 'rule', SLOTS, RULE_LEVELS)}")
def chart_rules(spark, sf_dir):
    """Twenty-six rules (seventeen statistics, nine combinations), each at a joint false-alarm rate of 1 and of 5 %, with its coverage."""
    rows = from_events(spark, sf_dir)
    points = effects.pivots(rows)
    found = rules.statistics(rows, points).join(points.select("channel", "segment", "anomaly"), ["channel", "segment"])
    return resampling.fused(rules.by_rule(found), SLOTS, RULE_LEVELS, ["rule"])


@query(f"WITH {Z_SQL}, lo AS (SELECT e.channel AS excluded, p.anomaly, {', '.join(FEATURES)} FROM peaks p, (SELECT DISTINCT channel FROM peaks) e WHERE p.channel <> e.channel), {_fused_sql('lo', 'excluded')}")
def joint_far_leave_one_out(spark, sf_dir):
    """The same with each channel left out; channels are few, and a segment is repeated once for each."""
    rows = _peaks(spark, sf_dir)
    names = rows.select(F.col("channel").alias("excluded")).distinct()
    return resampling.fused(rows.join(names, F.col("channel") != F.col("excluded")), FEATURES, LEVELS, ["excluded"])


@query(f"""WITH {Z_SQL}, c AS (SELECT e.channel AS excluded, quantile_cont(p.diff_peak, 0.95::DOUBLE) AS cut FROM peaks p, (SELECT DISTINCT channel FROM peaks) e WHERE p.channel <> e.channel AND p.anomaly = 0 AND p.diff_peak IS NOT NULL GROUP BY e.channel)
SELECT excluded, round(cut, 6) AS threshold, round(avg((diff_peak > cut)::INT) FILTER (anomaly = 0), 6) AS false_alarm_rate, round(avg((diff_peak > cut)::INT) FILTER (anomaly = 1), 6) AS coverage FROM peaks JOIN c ON channel = excluded WHERE diff_peak IS NOT NULL GROUP BY excluded, cut""")
def leave_one_out_calibration(spark, sf_dir):
    """Thresholds from all other channels, and the rates that they have on the one left out."""
    rows = _peaks(spark, sf_dir).where("diff_peak IS NOT NULL")
    names = rows.select(F.col("channel").alias("excluded")).distinct()
    cuts = rows.where("anomaly = 0").join(names, F.col("channel") != F.col("excluded")).groupBy("excluded").agg(F.percentile("diff_peak", F.lit(0.95)).alias("threshold"))
    over = (F.col("diff_peak") > F.col("threshold")).cast("double")
    rates = [F.avg(F.when(F.col("anomaly") == y, over)).alias(name) for name, y in (("false_alarm_rate", 0), ("coverage", 1))]
    return rows.join(cuts, F.col("channel") == F.col("excluded")).groupBy("excluded", "threshold").agg(*rates)


@query(f"""WITH {TELEMETRY_SQL}, lg AS (SELECT channel, segment, anomaly, 'level' AS feature, value AS v FROM dif UNION ALL SELECT channel, segment, anomaly, 'diff', d FROM dif UNION ALL SELECT channel, segment, anomaly, 'diff2', d2 FROM dif),
b AS (SELECT channel, feature, avg(v) AS m, stddev_samp(v) AS s FROM lg WHERE anomaly = 0 AND v IS NOT NULL GROUP BY channel, feature)
SELECT l.channel, l.segment, l.feature, count(*) FILTER (abs(v - m) > 3 * s) AS n_outside, round(max(abs(v - m) / s), 6) AS peak FROM lg l JOIN b ON l.channel = b.channel AND l.feature = b.feature WHERE v IS NOT NULL AND s > 0 GROUP BY l.channel, l.segment, l.feature""")
def shewhart_chart(spark, sf_dir):
    """Samples outside three nominal deviations, and the largest deviation, by series."""
    from alarmlens.sources.telemetry import differences

    long = differences(from_events(spark, sf_dir)).select("channel", "segment", "anomaly", F.expr("stack(3, 'level', value, 'diff', d, 'diff2', d2) AS (feature, v)")).where("v IS NOT NULL")
    base = long.where("anomaly = 0").groupBy("channel", "feature").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).where("s > 0")
    z = F.abs(F.col("v") - F.col("m")) / F.col("s")
    return long.join(base, ["channel", "feature"]).groupBy("channel", "segment", "feature").agg(F.count_if(F.abs(F.col("v") - F.col("m")) > 3 * F.col("s")).alias("n_outside"), F.max(z).alias("peak"))


@query(f"""WITH {NOMINAL_SQL}, p AS (SELECT z.channel, z.segment, max(t.anomaly) AS anomaly, max(abs(z)) AS peak FROM zn z JOIN tele t ON z.channel = t.channel AND z.segment = t.segment AND z.t = t.t GROUP BY z.channel, z.segment)
SELECT channel, count(*) AS n_anomalous, count(*) FILTER (peak > 20) AS n_trivial, count(*) FILTER (peak <= 20) AS n_left FROM p WHERE anomaly = 1 GROUP BY channel""")
def triviality_filter(spark, sf_dir):
    """Anomalous segments that leave twenty nominal deviations are trivial: how many of a channel are, and are left."""
    peaks = effects.nominal_z(from_events(spark, sf_dir)).groupBy("channel", "segment").agg(F.max("anomaly").alias("anomaly"), F.max(F.abs("z")).alias("peak"))
    return peaks.where("anomaly = 1").groupBy("channel").agg(F.count(F.lit(1)).alias("n_anomalous"), F.count_if(F.col("peak") > 20).alias("n_trivial"), F.count_if(F.col("peak") <= 20).alias("n_left"))


@query(f"""WITH {NOISE_SQL}, e AS (SELECT channel, avg(value) AS level, var_samp(d) AS spread FROM dif GROUP BY channel), x AS (SELECT s.channel, s.r AS a, e.level AS b FROM simple s JOIN e USING (channel)),
k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS b FROM x),
i AS (SELECT a, b, row_number() OVER (ORDER BY a, b) AS i FROM k), o AS (SELECT p1.i AS i1, p2.i AS i2, p3.i AS i3, p4.i AS i4, p5.i AS i5 FROM i p1, i p2, i p3, i p4, i p5 WHERE len(list_distinct([p1.i, p2.i, p3.i, p4.i, p5.i])) = 5),
s AS (SELECT {' + '.join(f'((SELECT a FROM i WHERE i.i = {k}) - 3) * ((SELECT b FROM i WHERE i.i = o.i{k}) - 3)' for k in range(1, 6))} AS s FROM o), t AS (SELECT sum((a - 3) * (b - 3)) AS s0, sqrt(sum((a - 3) * (a - 3)) * sum((b - 3) * (b - 3))) AS scale FROM i)
SELECT round(max(s0) / max(scale), 6) AS rho, count(*) AS n_orders, round(avg((abs(s) >= abs(s0) - 1e-9)::INT), 6) AS p_value FROM s, t""")
def spearman_exact(spark, sf_dir):
    """Rank correlation of the channels' noise and level, against all 120 orders."""
    rows = from_events(spark, sf_dir)
    x = profile.noise_simple(rows).select("channel", F.col("r").alias("a")).join(rows.groupBy("channel").agg(F.avg("value").alias("b")), "channel")
    return inference.spearman_exact(x, "a", "b")


@query(f"""{DETECT_SQL}, sg AS (SELECT channel, segment, count(*) AS n, max(anomaly) AS anomaly FROM tele GROUP BY channel, segment), dm AS (SELECT o.channel, o.segment, o.onset AS pivot_t FROM onsets o JOIN sg s ON o.channel = s.channel AND o.segment = s.segment WHERE s.anomaly = 0 AND o.onset >= 10 AND o.onset <= s.n - 5),
{effect_table_sql('dm', 'de')} SELECT channel, segment, pivot_t, round(level_d_abs, 6) AS level_d_abs, round(diff_logvar, 6) AS diff_logvar, round(diff2_logvar, 6) AS diff2_logvar FROM de""")
def detector_matched_pivots(spark, sf_dir):
    """Placebo pivots where the detector fires on normal segments, with their effects."""
    rows = from_events(spark, sf_dir)
    sizes = rows.groupBy("channel", "segment").agg(F.count(F.lit(1)).alias("n"), F.max("anomaly").alias("anomaly")).where("anomaly = 0")
    points = found(spark, sf_dir).join(sizes, ["channel", "segment"]).where("onset >= 10 AND onset <= n - 5").select("channel", "segment", F.col("onset").alias("pivot_t"))
    return studies.at_pivots(rows, points)


@query(f"""{DETECT_SQL}, sg AS (SELECT channel, segment, count(*) AS n, max(anomaly) AS anomaly FROM tele GROUP BY channel, segment)
SELECT o.channel, CAST(s.anomaly AS BIGINT) AS anomaly, count(*) AS n_segments, round(avg((onset IS NOT NULL)::INT), 6) AS detection_rate, round(count(*) FILTER (onset >= 10 AND onset <= s.n - 5)::DOUBLE / nullif(count(onset), 0), 6) AS retention FROM onsets o JOIN sg s ON o.channel = s.channel AND o.segment = s.segment GROUP BY o.channel, s.anomaly""")
def detector_matched_rates(spark, sf_dir):
    """How often the detector fires by class, and how many of these onsets leave enough samples on both sides."""
    rows = from_events(spark, sf_dir)
    sizes = rows.groupBy("channel", "segment").agg(F.count(F.lit(1)).alias("n"), F.max("anomaly").alias("anomaly"))
    both = found(spark, sf_dir).join(sizes, ["channel", "segment"])
    kept = F.count_if((F.col("onset") >= 10) & (F.col("onset") <= F.col("n") - 5))
    return both.groupBy("channel", "anomaly").agg(F.count(F.lit(1)).alias("n_segments"), F.avg(F.col("onset").isNotNull().cast("double")).alias("detection_rate"), F.try_divide(kept.cast("double"), F.count("onset")).alias("retention"))


@query(f"WITH f AS ({ORACLES['influence_flags']}) SELECT excluded, count(*) FILTER (influential) AS n_influential, count(*) AS n_tests, round(avg(influential::INT), 6) AS share_influential FROM f GROUP BY excluded")
def influence_summary(spark, sf_dir):
    return meta.influence_summary(influence_flags(spark, sf_dir))


@query(f"WITH p AS ({ORACLES['persistence_class']}) SELECT channel, pattern, count(*) AS n FROM p GROUP BY channel, pattern")
def pattern_counts(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    return studies.persistence(rows, effects.pivots(rows)).groupBy("channel", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH g AS (WITH {Z_SQL}, {_fused_sql('peaks', '')}) SELECT level, coverage, joint_far, coverage * 0.01::DOUBLE * 1000 > 5 AS worth_it FROM g""")
def adoption_inequality(spark, sf_dir):
    """Whether fused alarms pay at each level, for a prevalence of 1 %, a miss of 1,000 and a channel of 5."""
    rows = joint_far_grid(spark, sf_dir)
    return rows.select("level", "coverage", "joint_far", resampling.adoption(F.col("coverage"), F.lit(0.01), F.lit(1000), F.lit(5)).alias("worth_it"))


@query(f"""{DETECT_SQL}, r AS (SELECT config, channel, segment, count(*) FILTER (likeliest <= 2 AND before > 5) AS resets FROM mb GROUP BY config, channel, segment) SELECT channel, count(*) AS n_segments, round(avg(resets), 6) AS resets_per_segment FROM r GROUP BY channel""")
def resets_per_segment(spark, sf_dir):
    """How often the likeliest run falls from over five samples to two or fewer."""
    rows = from_events(spark, sf_dir)
    counts = bocpd.detect(rows, bocpd.fitted(rows, mixture=False), whole=True)
    return counts.groupBy("channel").agg(F.count(F.lit(1)).alias("n_segments"), F.avg("resets").alias("resets_per_segment"))


@query(f"""WITH {EFFECT_SQL}, s AS (SELECT channel, avg(diff_logvar) AS yi, CASE WHEN count(diff_logvar) >= 2 AND var_samp(diff_logvar) > 0 THEN var_samp(diff_logvar) / count(diff_logvar) END AS vi FROM eff WHERE diff_logvar IS NOT NULL GROUP BY channel),
f AS (SELECT count(*) AS k, sum(1 / vi) AS w, sum(yi / vi) AS wy, sum(1 / (vi * vi)) AS w2 FROM s WHERE vi > 0), h AS (SELECT sum((yi - wy / w) * (yi - wy / w) / vi) AS q FROM s, f WHERE vi > 0), t AS (SELECT greatest(0, coalesce((q - (k - 1)) / nullif(w - w2 / w, 0), 0)) AS tau2 FROM f, h)
SELECT 'diff' AS feature, channel, round(yi, 6) AS yi, round(vi, 6) AS vi, round(yi - 1.96 * sqrt(vi), 6) AS low, round(yi + 1.96 * sqrt(vi), 6) AS high, round(100 / (vi + tau2) / sum(1 / (vi + tau2)) OVER (), 6) AS weight_percent FROM s, t WHERE vi > 0""")
def study_weights(spark, sf_dir):
    rows = meta.effect_variance(_effects(spark, sf_dir), ["channel"], "diff_logvar").withColumn("feature", F.lit("diff"))
    return meta.study_weights(rows, ["feature"], "channel")


@query(f"""WITH {NOISE_SQL}, e AS (SELECT DISTINCT channel FROM tele) SELECT e.channel, round(coalesce(r, 1e-14), 6) AS r, round(coalesce(q, 1e-14), 6) AS q, coalesce(n_diff, 0) AS n_diff FROM e LEFT JOIN simple USING (channel)""")
def estimator_dispatch(spark, sf_dir):
    return profile.estimated(from_events(spark, sf_dir), "simple")


#: Lags of weaker correlation aren't reliable.
LEAST_CORRELATION = 0.3
LAG_SQL = f"lx AS ({ORACLES['best_lag_xcorr']}), lr AS (SELECT 'all' AS test, CASE WHEN segment % 5 = 0 THEN 'anomalous' ELSE 'normal' END AS side, CASE WHEN segment % 5 = 0 THEN 1 ELSE 0 END AS anomaly, lag::DOUBLE AS v FROM lx WHERE abs(correlation) >= {LEAST_CORRELATION})"


def _lags(spark, sf_dir):
    anomaly = F.when(F.col("segment") % 5 == 0, 1).otherwise(0)
    rows = best_lag_xcorr(spark, sf_dir).where(F.abs("correlation") >= LEAST_CORRELATION)
    return rows.select(F.lit("all").alias("test"), F.when(anomaly == 1, "anomalous").otherwise("normal").alias("side"), anomaly.alias("anomaly"), F.col("lag").cast("double").alias("v"))


@query(f"WITH RECURSIVE {LAG_SQL}, {signed_rank_sql('lr', 'side')} SELECT side, {SR_COLUMNS} FROM sr")
def lag_signed_rank(spark, sf_dir):
    """Whether reliable lags of anomalous and of normal segments differ from 0."""
    return inference.wilcoxon(_lags(spark, sf_dir), ["side"], "v")


@query(f"WITH RECURSIVE {LAG_SQL}, {rank_sum_sql('lr', 'test', two_sided=True)} SELECT test, {MW_COLUMNS} FROM mw")
def lag_group_test(spark, sf_dir):
    """Whether reliable lags of anomalous and of normal segments differ from each other, on both sides."""
    return inference.mann_whitney(_lags(spark, sf_dir).withColumn("one", F.col("anomaly") == 1), ["test"], "v", "one", two_sided=True)
