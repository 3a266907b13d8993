"""Queries of the study tables, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from alarmlens.functions.random import uniform_sql
from alarmlens.operators import effects, inference, studies
from alarmlens.operators.catalogue import EFFECT_SQL, LABELLED_SQL, MW_COLUMNS, NOMINAL_SQL, ORACLES, PIVOT_SQL, QUERIES, TELEMETRY_SQL, Z_SQL, _effects, _labelled, _lv, _peaks, query, rank_sum_sql
from alarmlens.sources.telemetry import from_events

#: Replicates of the tie audit's intervals.
TIE_REPLICATES = 2000

CROSS_SQL = f"""{Z_SQL}, cr AS (SELECT channel, segment, pivot_t, max(seg_anomaly) AS anomaly, min(t - pivot_t) FILTER (level_z > 3) AS level_cross, min(t - pivot_t) FILTER (diff_z > 3) AS diff_cross FROM zs WHERE post GROUP BY channel, segment, pivot_t)"""


@query(f"WITH {TELEMETRY_SQL}, lab AS (SELECT segment, max(anomaly) AS anomaly, max(train) AS train FROM tele GROUP BY segment) SELECT channel, segment, t, CAST(l.anomaly AS BIGINT) AS anomaly, CAST(l.train AS BIGINT) AS train FROM tele LEFT JOIN lab l USING (segment)")
def label_enrichment(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    labels = rows.groupBy("segment").agg(F.max("anomaly").alias("anomaly"), F.max("train").alias("train"))
    return studies.enriched(rows.select("channel", "segment", "t"), labels, "segment").select("channel", "segment", "t", "anomaly", "train")


@query(f"""WITH RECURSIVE {NOMINAL_SQL}, ew AS (SELECT channel, segment, t, 0.2::DOUBLE * z + 0.8::DOUBLE * 0 AS e FROM zn WHERE t = 0
 UNION ALL SELECT n.channel, n.segment, n.t, 0.2::DOUBLE * n.z + 0.8::DOUBLE * w.e FROM ew w JOIN zn n ON n.channel = w.channel AND n.segment = w.segment AND n.t = w.t + 1)
SELECT channel, segment, round(max(abs(e)), 6) AS peak, round(max_by(e, t), 6) AS last FROM ew GROUP BY channel, segment""")
def ewma_chart(spark, sf_dir):
    return studies.ewma(from_events(spark, sf_dir))


@query(f"""WITH {PIVOT_SQL} SELECT channel, segment, pivot_t, round(CASE WHEN count(*) FILTER (NOT post) >= 2 AND var_samp(value) FILTER (NOT post) > 0
 THEN abs(avg(value) FILTER (post) - avg(value) FILTER (NOT post)) / sqrt(var_samp(value) FILTER (NOT post)) END, 6) AS level_prez FROM near GROUP BY channel, segment, pivot_t""")
def level_prez(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    return studies.level_shift_by_pre_spread(rows, effects.pivots(rows))


@query(f"""WITH {Z_SQL}, a AS (SELECT *, max(level_z) OVER w AS peak, count(*) OVER w AS n FROM zs WHERE post AND t < pivot_t + 60 AND level_z IS NOT NULL WINDOW w AS (PARTITION BY channel, segment, pivot_t)),
b AS (SELECT *, min(t) FILTER (level_z = peak) OVER (PARTITION BY channel, segment, pivot_t) AS peak_t FROM a),
c AS (SELECT channel, segment, pivot_t, n, peak, min(t - pivot_t) FILTER (t > peak_t AND level_z <= 0.5 * peak) AS decay FROM b GROUP BY channel, segment, pivot_t, n, peak)
SELECT channel, segment, pivot_t, n, round(peak, 6) AS peak, decay, CASE WHEN n < 3 OR peak <= 0 THEN 'undecidable' WHEN decay IS NOT NULL THEN 'transient' ELSE 'persistent' END AS pattern FROM c""")
def persistence_class(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    return studies.persistence(rows, effects.pivots(rows))


@query(f"""WITH {PIVOT_SQL}, w AS (SELECT f.channel, f.segment, p.pivot_t, f.t - p.pivot_t + 15 AS k, f.value, f.d, f.d2 FROM dif f JOIN pivs p ON f.channel = p.channel AND f.segment = p.segment
 WHERE p.skip_reason = '' AND p.pivot_t - 17 >= 0 AND p.pivot_t + 15 <= p.n AND f.t >= p.pivot_t - 15 AND f.t < p.pivot_t + 15)
SELECT channel, segment, pivot_t, k, {", ".join(f"round(({x} - avg({x}) OVER v) / (stddev_pop({x}) OVER v + 1e-8::DOUBLE), 6) AS {n}" for n, x in (("level", "value"), ("diff", "d"), ("diff2", "d2")))}
FROM w WINDOW v AS (PARTITION BY channel, segment, pivot_t)""")
def seq_windows(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    return studies.windows(rows, effects.pivots(rows))


@query(f"""WITH {CROSS_SQL}, s AS (SELECT channel, count(*) AS n, count(*) FILTER (diff_cross < level_cross) AS b, count(*) FILTER (diff_cross = level_cross) AS t FROM cr WHERE level_cross IS NOT NULL AND diff_cross IS NOT NULL GROUP BY channel)
SELECT channel, n AS n_pairs, b AS n_before, t AS n_tied, round(b::DOUBLE / nullif(n - t, 0), 6) AS excluded, round((b + t / 2.0::DOUBLE) / n, 6) AS half, round((b + t)::DOUBLE / n, 6) AS diff_first FROM s""")
def tie_audit(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    return studies.precedence(effects.crossing_times(rows, effects.pivots(rows)))


def _shares_sql(side: int) -> str:
    n, b, t = (f"{c}{side}" for c in "nbt")
    return f"{b} / nullif({n} - {t}, 0) AS excluded{side}, ({b} + {t} / 2) / nullif({n}, 0) AS half{side}, ({b} + {t}) / nullif({n}, 0) AS diff_first{side}"


def _increments_sql(pairs: str, cluster: str, replicates: int, stream: str) -> str:
    counted = ", ".join(f"count(*) FILTER (anomaly = {a}{x}) AS {c}{a}" for a in (0, 1) for c, x in (("n", ""), ("b", " AND diff_cross < level_cross"), ("t", " AND diff_cross = level_cross")))
    cells = " UNION ALL ".join(f"SELECT rep, '{c}' AS ties, '{q}' AS quantity, {v} AS v FROM sh" for c in studies.CONVENTIONS for q, v in (("anomalous", f"{c}1"), ("normal", f"{c}0"), ("increment", f"{c}1 - {c}0")))
    return f"""ct AS (SELECT {cluster}, {counted} FROM {pairs} WHERE level_cross IS NOT NULL AND diff_cross IS NOT NULL GROUP BY {cluster}),
cl AS (SELECT {cluster}, row_number() OVER (ORDER BY {cluster}) - 1 AS i, count(*) OVER () AS k FROM ct),
dr AS (SELECT rep, CAST(floor({uniform_sql(stream, 'rep', 'draw')} * k) AS BIGINT) AS i FROM (SELECT DISTINCT k FROM cl), range(1, {replicates} + 1) r(rep), range(1, 1000) q(draw) WHERE draw <= k),
we AS (SELECT rep, {cluster}, count(*)::DOUBLE AS w FROM dr JOIN cl USING (i) GROUP BY rep, {cluster} UNION ALL SELECT 0, {cluster}, 1 FROM cl),
su AS (SELECT rep, {", ".join(f"sum({c} * w) AS {c}" for c in ("n0", "b0", "t0", "n1", "b1", "t1"))} FROM ct JOIN we USING ({cluster}) GROUP BY rep),
sh AS (SELECT rep, {_shares_sql(0)}, {_shares_sql(1)} FROM su), lo AS ({cells})
SELECT ties, quantity, round(max(v) FILTER (rep = 0), 6) AS share, count(v) FILTER (rep > 0) AS n_replicates, round(quantile_cont(v, 0.025::DOUBLE) FILTER (rep > 0), 6) AS low, round(quantile_cont(v, 0.975::DOUBLE) FILTER (rep > 0), 6) AS high,
 round(CASE WHEN quantity = 'increment' THEN least(1.0::DOUBLE, 2.0::DOUBLE * least(count(*) FILTER (rep > 0 AND v <= 0), count(*) FILTER (rep > 0 AND v >= 0)) / nullif(count(v) FILTER (rep > 0), 0)) END, 6) AS p_boot FROM lo GROUP BY ties, quantity"""


@query(f"WITH {CROSS_SQL}, {_increments_sql('cr', 'channel', TIE_REPLICATES, 'ties')}")
def tie_audit_intervals(spark, sf_dir):
    """Increments of diff's precedence, anomalous over normal, with channels drawn with replacement."""
    rows = from_events(spark, sf_dir)
    points = effects.pivots(rows)
    pairs = effects.crossing_times(rows, points).join(points.select("channel", "segment", "anomaly"), ["channel", "segment"])
    return studies.precedence_increments(pairs, "channel", TIE_REPLICATES, "ties")


@query(f"""WITH {Z_SQL}, l AS (SELECT 'level' AS feature, anomaly, level_peak AS peak FROM peaks UNION ALL SELECT 'diff', anomaly, diff_peak FROM peaks UNION ALL SELECT 'diff2', anomaly, diff2_peak FROM peaks),
x AS (SELECT feature, anomaly, peak, z_limit FROM l, (VALUES (2.0::DOUBLE), (3.0::DOUBLE), (4.0::DOUBLE)) v(z_limit) WHERE peak IS NOT NULL)
SELECT feature, round(z_limit, 6) AS z_limit, round(count(*) FILTER (anomaly = 0 AND peak > z_limit)::DOUBLE / nullif(count(*) FILTER (anomaly = 0), 0), 6) AS false_alarm_rate,
 round(count(*) FILTER (anomaly = 1 AND peak > z_limit)::DOUBLE / nullif(count(*) FILTER (anomaly = 1), 0), 6) AS coverage FROM x GROUP BY feature, z_limit""")
def fixed_threshold_points(spark, sf_dir):
    return studies.operating_points(_peaks(spark, sf_dir))


@query(f"""WITH {CROSS_SQL} SELECT channel, cap, count(*) AS n, count(*) FILTER (level_cross < cap) AS n_level, count(*) FILTER (diff_cross < cap) AS n_diff
FROM cr, (VALUES (10::BIGINT), (20::BIGINT), (40::BIGINT), (80::BIGINT)) v(cap) GROUP BY channel, cap""")
def window_cap_sweep(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    return studies.window_cap_sweep(rows, effects.pivots(rows))


@query(f"""WITH {NOMINAL_SQL}, z AS (SELECT n.channel, n.z FROM zn n JOIN tele t ON t.channel = n.channel AND t.segment = n.segment AND t.t = n.t WHERE t.anomaly = 0)
SELECT channel, round(stddev_samp(z), 6) AS sd, round(kurtosis_pop(z), 6) AS excess_kurtosis, round(avg(CASE WHEN abs(z) > 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_over_3, count(*) AS n FROM z GROUP BY channel""")
def steady_state_diagnostics(spark, sf_dir):
    return studies.steady_state(from_events(spark, sf_dir))


@query(f"""WITH {EFFECT_SQL} SELECT p.channel, count(*) AS n_segments, count(*) FILTER (skip_reason = '') AS n_usable, count(level_d_abs) AS n_level,
 count(*) FILTER (level_d_abs IS NOT NULL AND diff_logvar IS NOT NULL AND diff2_logvar IS NOT NULL) AS n_complete FROM pivs p LEFT JOIN eff e ON p.channel = e.channel AND p.segment = e.segment GROUP BY p.channel""")
def sample_accounting(spark, sf_dir):
    rows = from_events(spark, sf_dir)
    points = effects.pivots(rows)
    return studies.accounting(points, effects.pivot_effects(rows, points))


def _placebo_sql() -> str:
    """The distinct placebo pivots, and the effects at them."""
    return f"""WITH pool AS ({ORACLES["placebo_pool"]}), uniq AS (SELECT DISTINCT channel, segment, pivot_t FROM pool), {TELEMETRY_SQL},
nearp AS (SELECT f.channel, f.segment, u.pivot_t, f.t, f.value, f.d, f.d2, f.t >= u.pivot_t AS post FROM dif f JOIN uniq u ON f.channel = u.channel AND f.segment = u.segment WHERE f.t >= 5),
plc AS (SELECT channel, segment, pivot_t, {_lv("d")} AS diff_logvar,
  CASE WHEN sqrt((var_samp(value) FILTER (post) + var_samp(value) FILTER (NOT post)) / 2) > 0 THEN
    abs((avg(value) FILTER (post) - avg(value) FILTER (NOT post)) / sqrt((var_samp(value) FILTER (post) + var_samp(value) FILTER (NOT post)) / 2)) END AS level_d_abs, {_lv("d2")} AS diff2_logvar FROM nearp GROUP BY channel, segment, pivot_t)"""


@query(f"WITH pool AS ({ORACLES['placebo_pool']}) SELECT DISTINCT channel, segment, pivot_t FROM pool")
def dedup_placebo(spark, sf_dir):
    return QUERIES["placebo_pool"](spark, sf_dir).select("channel", "segment", "pivot_t").distinct()


def _placebo_effects(spark, sf_dir):
    return studies.at_pivots(from_events(spark, sf_dir), QUERIES["placebo_pool"](spark, sf_dir))


@query(f"{_placebo_sql()} SELECT channel, segment, pivot_t, round(level_d_abs, 6) AS level_d_abs, round(diff_logvar, 6) AS diff_logvar, round(diff2_logvar, 6) AS diff2_logvar FROM plc")
def placebo_effects(spark, sf_dir):
    return _placebo_effects(spark, sf_dir)


OBSERVED_SQL = f"{_placebo_sql()}, {EFFECT_SQL.split(TELEMETRY_SQL + ',', 1)[1].strip()}"


@query(f"""{OBSERVED_SQL} SELECT channel, segment, CAST(1 AS BIGINT) AS label, round(level_d_abs, 6) AS level_d_abs, round(diff_logvar, 6) AS diff_logvar, round(diff2_logvar, 6) AS diff2_logvar
FROM eff WHERE anomaly = 1 AND level_d_abs IS NOT NULL AND diff_logvar IS NOT NULL AND diff2_logvar IS NOT NULL
UNION ALL SELECT channel, segment, 0, round(level_d_abs, 6), round(diff_logvar, 6), round(diff2_logvar, 6) FROM plc WHERE level_d_abs IS NOT NULL AND diff_logvar IS NOT NULL AND diff2_logvar IS NOT NULL""")
def tabular_dataset(spark, sf_dir):
    columns = ["channel", "segment", "label", "level_d_abs", "diff_logvar", "diff2_logvar"]
    ones = _effects(spark, sf_dir).where("anomaly = 1").withColumn("label", F.lit(1).cast("long"))
    return ones.select(*columns).unionByName(_placebo_effects(spark, sf_dir).withColumn("label", F.lit(0).cast("long")).select(*columns)).dropna(subset=columns[3:])


EMPIRICAL_SQL = f"""{OBSERVED_SQL}, ob AS (SELECT channel, segment, diff_logvar AS v FROM eff WHERE anomaly = 1 AND diff_logvar IS NOT NULL), pn AS (SELECT channel, count(diff_logvar) AS n FROM plc GROUP BY channel),
ep AS (SELECT o.channel, o.segment, o.v, coalesce(p.n, 0) AS n, CASE WHEN p.n >= 20 THEN (1 + (SELECT count(*) FROM plc x WHERE x.channel = o.channel AND x.diff_logvar >= o.v)) / (p.n + 1)::DOUBLE END AS p FROM ob o LEFT JOIN pn p ON o.channel = p.channel)"""


def _empirical(spark, sf_dir):
    return studies.empirical_p(_effects(spark, sf_dir).where("anomaly = 1"), _placebo_effects(spark, sf_dir), "diff_logvar")


@query(f"{EMPIRICAL_SQL} SELECT channel, segment, round(v, 6) AS observed, n AS placebo_n, round(p, 6) AS p_value FROM ep")
def empirical_pvalues(spark, sf_dir):
    return _empirical(spark, sf_dir)


@query(f"""{EMPIRICAL_SQL} SELECT channel, count(p) AS n_tested, round(avg(CASE WHEN p < 0.05 THEN 1.0::DOUBLE WHEN p IS NOT NULL THEN 0.0::DOUBLE END), 6) AS share_significant FROM ep GROUP BY channel""")
def channel_significance(spark, sf_dir):
    return _empirical(spark, sf_dir).groupBy("channel").agg(F.count("p_value").alias("n_tested"), F.avg((F.col("p_value") < 0.05).cast("double")).alias("share_significant"))


@query(f"""{EMPIRICAL_SQL}, m AS (SELECT channel, min(p) AS p FROM ep GROUP BY channel HAVING min(p) IS NOT NULL) SELECT channel, round(p, 6) AS p, round(least(p * count(*) OVER (), 1), 6) AS p_bonferroni FROM m""")
def bonferroni(spark, sf_dir):
    return inference.bonferroni(_empirical(spark, sf_dir).groupBy("channel").agg(F.min("p_value").alias("p")).where("p IS NOT NULL"), "p")


@query(f"""{EMPIRICAL_SQL}, m AS (SELECT channel, min(p) AS p FROM ep GROUP BY channel HAVING min(p) IS NOT NULL),
b AS (SELECT channel, p, count(*) OVER () * p / row_number() OVER (ORDER BY p) AS raw FROM m)
SELECT channel, round(p, 6) AS p, round(least(1, min(raw) OVER (ORDER BY p DESC)), 6) AS q_value FROM b""")
def bh_fdr(spark, sf_dir):
    return inference.benjamini_hochberg(_empirical(spark, sf_dir).groupBy("channel").agg(F.min("p_value").alias("p")), "p")


@query(f"""WITH {LABELLED_SQL}, e AS (SELECT s, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM lab GROUP BY s),
c AS (SELECT s, sum(p) OVER w / (SELECT sum(p) FROM e) AS recall, sum(q) OVER w / (SELECT sum(q) FROM e) AS far FROM e WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT round(s, 6) AS cut, round(recall, 6) AS recall, round(far, 6) AS false_alarm_rate, round(recall - far, 6) AS youden_j FROM c ORDER BY round(recall - far, 9) DESC, s DESC LIMIT 1""")
def roc_auc_youden(spark, sf_dir):
    return studies.youden(_labelled(spark, sf_dir), "s", "pos")


AUROC_SQL = """SELECT {by}, round(sum(won) / nullif(sum(p) * sum(q), 0), 6) AS auroc FROM (
  SELECT {by}, p, q, p * (coalesce(sum(q) OVER (PARTITION BY {by} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS won
  FROM (SELECT {by}, s, sum(CASE WHEN pos THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p, sum(CASE WHEN pos THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS q FROM {rows} GROUP BY {by}, s)) GROUP BY {by}"""


@query(f"WITH {LABELLED_SQL} {AUROC_SQL.format(by='source', rows='lab')}")
def auroc_stratified(spark, sf_dir):
    return inference.auroc(_labelled(spark, sf_dir), ["source"], "s", "pos")


@query(f"WITH {LABELLED_SQL}, lo AS (SELECT e.source AS excluded, l.s, l.pos FROM lab l, (SELECT DISTINCT source FROM lab) e WHERE l.source <> e.source) {AUROC_SQL.format(by='excluded', rows='lo')}")
def auroc_loco(spark, sf_dir):
    """Left out one by one; sources are few, and a row is repeated once for each."""
    rows = _labelled(spark, sf_dir).groupBy("source", "s", "pos").agg(F.count(F.lit(1)).cast("double").alias("w"))
    names = rows.select(F.col("source").alias("excluded")).distinct()
    return inference.auroc(rows.join(names, F.col("source") != F.col("excluded")), ["excluded"], "s", "pos", "w")


def _slice_sql() -> str:
    return f"""WITH RECURSIVE {EFFECT_SQL}, x AS (SELECT s.slice, e.anomaly, e.diff_logvar AS v FROM eff e, (VALUES ('full'), ('train'), ('test')) s(slice) WHERE e.diff_logvar IS NOT NULL AND (s.slice = 'full' OR (s.slice = 'train') = (e.segment % 4 <> 0))),
{rank_sum_sql('x', 'slice')} SELECT slice, {MW_COLUMNS} FROM mw"""


@query(_slice_sql())
def slice_mannwhitney(spark, sf_dir):
    train = F.when(F.col("segment") % 4 != 0, "train").otherwise("test")
    rows = _effects(spark, sf_dir).withColumn("slice", F.explode(F.array(F.lit("full"), train))).withColumn("is_anomaly", F.col("anomaly") == 1)
    return inference.mann_whitney(rows, ["slice"], "diff_logvar", "is_anomaly")


@query(f"""WITH {EFFECT_SQL}, a AS (SELECT channel, segment, level_d_abs FROM eff), b AS (SELECT channel, segment, level_d_abs * (1 + 1e-3::DOUBLE) AS level_d_abs FROM eff)
SELECT count(a.channel) AS n_a, count(b.channel) AS n_b, count(*) FILTER (a.channel IS NULL OR b.channel IS NULL) AS n_unmatched, round(max(abs(a.level_d_abs - b.level_d_abs) / nullif(abs(b.level_d_abs), 0)), 6) AS max_relative_error
FROM a FULL JOIN b ON a.channel = b.channel AND a.segment = b.segment""")
def replica_gate(spark, sf_dir):
    rows = _effects(spark, sf_dir).select("channel", "segment", "level_d_abs")
    return studies.replica_gate(rows, rows.withColumn("level_d_abs", F.col("level_d_abs") * (1 + 1e-3)), ["channel", "segment"], ["level_d_abs"])
