"""Queries of exact tests, scopes, calibration and influence, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from alarmlens.functions.random import uniform_sql
from alarmlens.operators import alarms, effects, evidence, inference, meta
from alarmlens.operators.catalogue import CONTINGENCY_SQL, LABELLED_SQL, ORACLES, STUDY_SQL, Z_SQL, _contingency, _labelled, _peaks, _pooled_sql, _studies, query
from alarmlens.plans.studies import CROSS_SQL
from alarmlens.sources.telemetry import from_events

MCC_SQL = "CASE WHEN (a + c) * (a + b) * (d + c) * (d + b) > 0 THEN (a * d - c * b) / sqrt((a + c) * (a + b) * (d + c) * (d + b)) ELSE 0 END"
LEVELS = [0.01, 0.05, 0.1]
#: Replicates of the survey's H3 and K2.
REPLICATES = 2000
COUNTS_SQL = "SELECT channel, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c, d::DOUBLE AS d FROM tab"


@query(f"""WITH {CONTINGENCY_SQL}, m AS (SELECT *, a + b AS r, a + c AS k, a + b + c + d AS n FROM tab),
x AS (SELECT m.*, x FROM m, range(0, 100000) q(x) WHERE x >= greatest(0, r + k - n) AND x <= least(r, k)),
l AS (SELECT *, -(lgamma(x + 1) + lgamma(r - x + 1) + lgamma(k - x + 1) + lgamma(n - r - k + x + 1)) AS lw FROM x),
w AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY channel)) AS w FROM l), s AS (SELECT *, max(w) FILTER (x = a) OVER (PARTITION BY channel) AS seen FROM w)
SELECT channel, a, b, c, d, round(coalesce(sum(w) FILTER (w <= seen * (1 + 1e-7::DOUBLE)), 0) / sum(w), 6) AS p_value, round((a * d)::DOUBLE / nullif(b * c, 0), 6) AS odds_ratio FROM s GROUP BY channel, a, b, c, d""")
def fisher_exact(spark, sf_dir):
    return evidence.fisher_exact(_contingency(spark, sf_dir), ["channel"])


@query(f"""WITH {CONTINGENCY_SQL}, e AS ({COUNTS_SQL}), f AS (SELECT channel, a, b, c, d, a / nullif(a + b, 0) AS recall, c / nullif(c + d, 0) AS far, {MCC_SQL} AS mcc FROM e)
SELECT channel, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c, d::BIGINT AS d, round(recall, 6) AS recall, round(far, 6) AS false_alarm_rate, round(mcc, 6) AS mcc, round(recall - far, 6) AS youden_j,
 CASE WHEN recall - far IS NULL THEN 'one class is missing' WHEN a + b < 5 OR c + d < 5 THEN 'too few segments' WHEN mcc <= 0 THEN 'no better than chance' ELSE 'included' END AS scope FROM f""")
def channel_scope(spark, sf_dir):
    return evidence.scope(_contingency(spark, sf_dir))


AFTER_SQL = f"{Z_SQL}, az AS (SELECT channel, segment, pivot_t, t - pivot_t AS k, level_z, diff_z FROM zs WHERE t >= pivot_t AND t < pivot_t + 40)"


@query(f"WITH {AFTER_SQL} SELECT channel, segment, pivot_t, k, round(level_z, 6) AS level_z, round(diff_z, 6) AS diff_z FROM az")
def post_z_arrays(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    return evidence.scores_after(rows, effects.pivots(rows))


@query(f"""WITH {AFTER_SQL}, g AS (SELECT a.channel, a.segment, a.pivot_t, lag, count(*) AS n, corr(a.level_z, b.diff_z) AS r FROM az a JOIN range(-15, 16) l(lag) ON true
 JOIN az b ON a.channel = b.channel AND a.segment = b.segment AND a.pivot_t = b.pivot_t AND b.k = a.k + lag WHERE a.level_z IS NOT NULL AND b.diff_z IS NOT NULL
 GROUP BY ALL HAVING count(*) >= 3 AND least(stddev_pop(a.level_z), stddev_pop(b.diff_z)) > 1e-12),
o AS (SELECT *, row_number() OVER (PARTITION BY channel, segment, pivot_t ORDER BY round(abs(r), 9) DESC, lag) AS i FROM g)
SELECT channel, segment, pivot_t, lag, round(r, 6) AS correlation, n AS n_pairs FROM o WHERE i = 1""")
def best_lag_xcorr(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    return evidence.best_lag(evidence.scores_after(rows, effects.pivots(rows)), list(effects.KEY))


@query(f"""WITH {Z_SQL}, l AS (SELECT 'level_peak' AS feature, anomaly, level_peak AS s FROM peaks UNION ALL SELECT 'diff_peak', anomaly, diff_peak FROM peaks UNION ALL SELECT 'diff2_peak', anomaly, diff2_peak FROM peaks),
c AS ({" UNION ALL ".join(f"SELECT feature, {q}::DOUBLE AS level, quantile_cont(s, 1 - {q}::DOUBLE) AS cut FROM l WHERE anomaly = 0 AND s IS NOT NULL GROUP BY feature" for q in LEVELS)})
SELECT feature, round(level, 6) AS level, round(cut, 6) AS threshold, round(avg((s > cut)::INT) FILTER (anomaly = 0), 6) AS false_alarm_rate, round(avg((s > cut)::INT) FILTER (anomaly = 1), 6) AS coverage
FROM l JOIN c USING (feature) WHERE s IS NOT NULL GROUP BY feature, level, cut""")
def far_marginal_thresholds(spark, sf_dir):
    return evidence.marginal_thresholds(_peaks(spark, sf_dir), ["level_peak", "diff_peak", "diff2_peak"], LEVELS)


@query(f"""WITH {Z_SQL}, r AS (SELECT p.*, repeat, CAST(floor({uniform_sql('fold', 'repeat', 'segment')} * 5) AS BIGINT) AS own FROM peaks p, range(1, 11) q(repeat) WHERE diff_peak IS NOT NULL),
c AS (SELECT repeat, fold, quantile_cont(diff_peak, 0.95::DOUBLE) AS cut FROM r, range(0, 5) f(fold) WHERE own <> fold AND anomaly = 0 GROUP BY repeat, fold)
SELECT c.repeat, c.fold, round(cut, 6) AS threshold, round(avg((diff_peak > cut)::INT) FILTER (anomaly = 0), 6) AS false_alarm_rate, round(avg((diff_peak > cut)::INT) FILTER (anomaly = 1), 6) AS coverage
FROM r JOIN c ON r.repeat = c.repeat AND r.own = c.fold GROUP BY c.repeat, c.fold, cut""")
def heldout_calibration(spark, sf_dir):
    return evidence.held_out_thresholds(_peaks(spark, sf_dir), "segment", "diff_peak", 0.05, folds=5, repeats=10)


@query(f"""WITH {LABELLED_SQL}, j AS (SELECT p.source = q.source AS own, CASE WHEN p.s > q.s THEN 1.0::DOUBLE WHEN p.s = q.s THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS won FROM lab p, lab q WHERE p.pos AND NOT q.pos),
u AS (SELECT 'pooled' AS part, won FROM j UNION ALL SELECT CASE WHEN own THEN 'within' ELSE 'across' END, won FROM j)
SELECT part, round(sum(won), 6) AS won, round(count(*)::DOUBLE, 6) AS pairs, round(sum(won) / count(*), 6) AS auroc FROM u GROUP BY part""")
def auc_pair_decomposition(spark, sf_dir):
    return evidence.auc_pairs(_labelled(spark, sf_dir), "source", "s", "pos")


@query(f"""WITH {STUDY_SQL}, ex AS (SELECT channel AS excluded FROM studies UNION ALL SELECT '(none)'), st AS (SELECT e.excluded, s.* FROM studies s JOIN ex e ON s.channel <> e.excluded),
lo AS (WITH {_pooled_sql('st', 'excluded').replace('round(mu, 6) AS mu', 'mu').replace('round(se, 6) AS se', 'se')})
SELECT 'diff' AS feature, l.excluded, round(l.mu, 6) AS mu, round(w.mu, 6) AS whole, round(l.mu - w.mu, 6) AS shift, abs(l.mu - w.mu) > w.se AS influential FROM lo l, lo w WHERE w.excluded = '(none)' AND l.excluded <> '(none)'""")
def influence_flags(spark, sf_dir):
    return evidence.influence(meta.left_out(_studies(spark, sf_dir).withColumn("feature", F.lit("diff")), ["feature"], "channel"), ["feature"])


def _hits(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    points = effects.pivots(rows)
    hits = effects.crossing_times(rows, points).join(points.select("channel", "segment", "anomaly"), ["channel", "segment"])
    return hits.select("channel", "segment", "anomaly", F.col("level_cross").isNotNull().alias("hit"))


@query(f"""WITH {CROSS_SQL}, h AS (SELECT channel, segment, anomaly, level_cross IS NOT NULL AS hit, row_number() OVER (PARTITION BY channel, anomaly ORDER BY segment) - 1 AS number, count(*) OVER (PARTITION BY channel, anomaly) AS size FROM cr),
dr AS (SELECT channel, anomaly, rep, CAST(floor({uniform_sql('mcc', 'channel', 'anomaly', 'rep', 'number')} * size) AS BIGINT) AS number FROM h, range(1, 201) q(rep)),
t AS (SELECT channel, rep, (count(*) FILTER (anomaly = 1 AND hit))::DOUBLE AS a, (count(*) FILTER (anomaly = 1 AND NOT hit))::DOUBLE AS b, (count(*) FILTER (anomaly = 0 AND hit))::DOUBLE AS c, (count(*) FILTER (anomaly = 0 AND NOT hit))::DOUBLE AS d
 FROM dr JOIN h USING (channel, anomaly, number) GROUP BY channel, rep), m AS (SELECT channel, ({MCC_SQL})::DOUBLE AS mcc FROM t)
SELECT channel, round(quantile_cont(mcc, 0.025::DOUBLE), 6) AS low, round(quantile_cont(mcc, 0.5::DOUBLE), 6) AS mid, round(quantile_cont(mcc, 0.975::DOUBLE), 6) AS high,
 quantile_cont(mcc, 0.025::DOUBLE) < 0 AND quantile_cont(mcc, 0.975::DOUBLE) > 0 AS crosses_zero FROM m GROUP BY channel""")
def mcc_bootstrap(spark, sf_dir):
    return evidence.bootstrap_mcc(_hits(spark, sf_dir), 200)


@query(ORACLES["mcc_bootstrap"].replace("range(1, 201)", f"range(1, {REPLICATES} + 1)"))
def mcc_bootstrap_interval(spark, sf_dir):
    return evidence.bootstrap_mcc(_hits(spark, sf_dir), REPLICATES)


@query(f"""{ORACLES["cluster_bootstrap_auroc"].replace("range(1, 51)", f"range(1, {REPLICATES} + 1)").rpartition("SELECT rep, ")[0].rstrip()},
u AS (SELECT rep, sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) AS auroc FROM b GROUP BY rep)
SELECT count(*) AS n_replicates, round(quantile_cont(auroc, 0.025::DOUBLE), 6) AS low, round(quantile_cont(auroc, 0.5::DOUBLE), 6) AS mid, round(quantile_cont(auroc, 0.975::DOUBLE), 6) AS high FROM u""")
def cluster_bootstrap_interval(spark, sf_dir):
    counts = _labelled(spark, sf_dir).groupBy("source", "s", "pos").agg(F.count(F.lit(1)).alias("n"))
    weights = alarms.cluster_weights(counts.select("source"), "source", REPLICATES, "auroc")
    drawn = counts.join(F.broadcast(weights), "source").withColumn("weight", F.col("weight") * F.col("n"))
    return alarms.interval(inference.auroc(drawn, ["rep"], "s", "pos", "weight"), "auroc")


@query(f"""WITH {CROSS_SQL} SELECT channel, segment, CAST(anomaly AS BIGINT) AS anomaly, level_cross, diff_cross,
 CASE WHEN level_cross IS NULL AND diff_cross IS NULL THEN 'none' WHEN level_cross IS NULL THEN 'diff only' WHEN diff_cross IS NULL THEN 'level only' WHEN diff_cross < level_cross THEN 'diff first' WHEN diff_cross = level_cross THEN 'tied' ELSE 'level first' END AS precedence FROM cr""")
def precedence_indicator(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    points = effects.pivots(rows)
    times = effects.crossing_times(rows, points).join(points.select("channel", "segment", "anomaly"), ["channel", "segment"])
    a, b = F.col("level_cross"), F.col("diff_cross")
    order = F.when(a.isNull() & b.isNull(), "none").when(a.isNull(), "diff only").when(b.isNull(), "level only").when(b < a, "diff first").when(b == a, "tied").otherwise("level first")
    return times.select("channel", "segment", "anomaly", "level_cross", "diff_cross", order.alias("precedence"))
