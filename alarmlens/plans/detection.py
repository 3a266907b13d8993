"""Queries of the detector: onsets, calibration, ablation and scope, and the SQL that says the same by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.functions.random import uniform_sql
from alarmlens.operators import bocpd, evidence
from alarmlens.operators.catalogue import MIXED_SQL, TELEMETRY_SQL, query
from alarmlens.plans.evidence import MCC_SQL, REPLICATES
from alarmlens.sources.telemetry import from_events

#: The configuration that the survey's final detector is locked to.
LOCKED = "simple+forgetting"
CONFIGS = [(f"{'mixture' if m else 'simple'}+{'forgetting' if f else 'memory'}", m, f) for m in (True, False) for f in (True, False)]
LEAST_SEGMENTS = 5


def _shrunk_sql(name: str, rows: str, value: str) -> str:
    return f"""{name}l AS (SELECT channel, ln(greatest({value}, 1e-12)) AS l, 2.0::DOUBLE / (greatest(n_diff, 2) - 1) AS se2 FROM {rows}),
{name}g AS (SELECT count(*) AS k, sum(l / se2) / sum(1 / se2) AS g, sum(1 / se2) - sum(1 / (se2 * se2)) / sum(1 / se2) AS c FROM {name}l),
{name}s AS (SELECT sum((l - g) * (l - g) / se2) AS ss FROM {name}l, {name}g), {name}t AS (SELECT k, g, greatest(0, coalesce((ss - (k - 1)) / nullif(c, 0), 0)) AS tau2 FROM {name}g, {name}s),
{name} AS (SELECT channel, exp(CASE WHEN k = 1 THEN l ELSE tau2 / (tau2 + se2) * l + (1 - tau2 / (tau2 + se2)) * g END) AS v FROM {name}l, {name}t)"""


def fit_sql(train: bool = False) -> str:
    """par(mixture, channel, r, q), after the noise tables; train: of held-in segments only."""
    noise = MIXED_SQL.replace("WHERE anomaly = 0", "WHERE anomaly = 0 AND train = 1") if train else MIXED_SQL
    where = "anomaly = 0 AND train = 1" if train else "anomaly = 0"
    parts = [_shrunk_sql(f"{kind}{value}", kind, value) for kind in ("simple", "mixed") for value in "rq"]
    both = " UNION ALL ".join(f"SELECT {flag} AS mixture, a.channel, a.v + coalesce(s.step * s.step / 12, 0) AS r, b.v AS q FROM {kind}r a JOIN {kind}q b ON a.channel = b.channel JOIN steps s ON a.channel = s.channel" for kind, flag in (("simple", "false"), ("mixed", "true")))
    return f"{noise}, steps AS (SELECT channel, quantile_cont(abs(d), 0.25) FILTER (d <> 0) AS step FROM dif WHERE {where} GROUP BY channel), {', '.join(parts)}, par AS ({both})"


def detect_sql(configs: str, rows: str = "tele") -> str:
    """onsets(config, channel, segment, n, onset, confirm, confidence) and bo (the posteriors), for configs (config, mixture, forgetting). Needs WITH RECURSIVE."""
    return f"""cf AS (SELECT * FROM (VALUES {configs}) v(config, mixture, forgetting)),
src AS (SELECT c.config, c.forgetting, t.channel, t.segment, t.t, t.value AS y, p.r, p.q FROM {rows} t JOIN par p ON t.channel = p.channel JOIN cf c ON c.mixture = p.mixture),
kf AS (SELECT config, channel, segment, t, y / sqrt(20 + r) AS z, 20 / (20 + r) * y AS x0, 10 / (20 + r) * y AS x1, 20 - 20 / (20 + r) * 20 AS a, 10 - 20 / (20 + r) * 10 AS b, (10 + q) - 10 / (20 + r) * 10 AS c FROM src WHERE t = 0
 UNION ALL SELECT n.config, n.channel, n.segment, n.t, (n.y - (k.x0 + k.x1)) / sqrt(greatest(k.a + 2 * k.b + k.c + n.r, 1e-8)), k.x0 + k.x1 + (k.a + 2 * k.b + k.c) / (k.a + 2 * k.b + k.c + n.r) * (n.y - (k.x0 + k.x1)),
  k.x1 + (k.b + k.c) / (k.a + 2 * k.b + k.c + n.r) * (n.y - (k.x0 + k.x1)), (k.a + 2 * k.b + k.c) - (k.a + 2 * k.b + k.c) / (k.a + 2 * k.b + k.c + n.r) * (k.a + 2 * k.b + k.c),
  (k.b + k.c) - (k.a + 2 * k.b + k.c) / (k.a + 2 * k.b + k.c + n.r) * (k.b + k.c), (k.c + n.q) - (k.b + k.c) / (k.a + 2 * k.b + k.c + n.r) * (k.b + k.c)
 FROM kf k JOIN src n ON n.config = k.config AND n.channel = k.channel AND n.segment = k.segment AND n.t = k.t + 1),
tb AS (SELECT f, 0 AS i, 1.0::DOUBLE AS kappa, 1.0::DOUBLE AS alpha, 1.0::DOUBLE AS share FROM (VALUES (true), (false)) v(f)
 UNION ALL SELECT f, i + 1, (kappa + 1) * s, greatest((alpha + 0.5) * s, 1e-3), s FROM (SELECT *, CASE WHEN f THEN least(1.0::DOUBLE, 40.0::DOUBLE / (kappa + 1)) ELSE 1.0::DOUBLE END AS s FROM tb) WHERE i < 1000),
tl AS (SELECT f, list(kappa ORDER BY i) AS ks, list(alpha ORDER BY i) AS al, list(share ORDER BY i) AS sh FROM tb GROUP BY f),
bo(config, channel, segment, f, t, p, mu, beta) AS (SELECT DISTINCT config, channel, segment, forgetting, (-1)::BIGINT, [1.0::DOUBLE], [0.0::DOUBLE], [1.0::DOUBLE] FROM src
 UNION ALL SELECT config, channel, segment, f, t + 1, list_prepend(list_sum(w) * (1 / 250.0::DOUBLE) / list_sum(w), list_transform(w, lambda x: x * (1 - 1 / 250.0::DOUBLE) / list_sum(w))),
  list_prepend(0.0::DOUBLE, list_transform(range(1, len(w) + 1), lambda i: (ks[i] * mu[i] + z) / (ks[i] + 1))),
  list_prepend(1.0::DOUBLE, list_transform(range(1, len(w) + 1), lambda i: (beta[i] + ks[i] * (z - mu[i]) * (z - mu[i]) / (2 * (ks[i] + 1))) * sh[i + 1]))
 FROM (SELECT b.*, k.z, l.ks, l.sh, list_transform(range(1, len(b.p) + 1), lambda i: b.p[i] * exp(lgamma(l.al[i] + 0.5) - lgamma(l.al[i]) - (l.al[i] + 0.5) * ln(1 + (k.z - b.mu[i]) * (k.z - b.mu[i]) / (2 * b.beta[i] * (l.ks[i] + 1) / l.ks[i]))) / sqrt(pi() * (2 * b.beta[i] * (l.ks[i] + 1) / l.ks[i]))) AS w
  FROM bo b JOIN kf k ON k.config = b.config AND k.channel = b.channel AND k.segment = b.segment AND k.t = b.t + 1 JOIN tl l ON l.f = b.f)),
ml AS (SELECT *, list_position(p, list_max(p)) - 1 AS likeliest FROM bo WHERE t >= 0),
mb AS (SELECT *, lag(likeliest) OVER (PARTITION BY config, channel, segment ORDER BY t) AS before FROM ml),
fi AS (SELECT config, channel, segment, count(*) AS n, min(t) FILTER (likeliest <= 2 AND before > 5) AS confirm FROM mb GROUP BY config, channel, segment),
onsets AS (SELECT f.config, f.channel, f.segment, f.n, CASE WHEN f.n >= 5 THEN m.t - m.likeliest END AS onset, CASE WHEN f.n >= 5 THEN f.confirm END AS confirm, CASE WHEN f.n >= 5 THEN m.p[1] + m.p[2] + m.p[3] END AS confidence, m.p AS runs
 FROM fi f LEFT JOIN mb m ON f.config = m.config AND f.channel = m.channel AND f.segment = m.segment AND f.confirm = m.t)"""


FINAL = "('final', false, true)"
DETECT_SQL = f"WITH RECURSIVE {fit_sql()}, {detect_sql(FINAL)}"
COUNT_SQL = """cal AS (SELECT o.config, o.channel, (count(*) FILTER (s.anomaly = 1 AND onset IS NOT NULL))::DOUBLE AS a, (count(*) FILTER (s.anomaly = 1 AND onset IS NULL))::DOUBLE AS b, (count(*) FILTER (s.anomaly = 0 AND onset IS NOT NULL))::DOUBLE AS c, (count(*) FILTER (s.anomaly = 0 AND onset IS NULL))::DOUBLE AS d
 FROM onsets o JOIN (SELECT channel, segment, max(anomaly) AS anomaly FROM tele GROUP BY channel, segment) s ON o.channel = s.channel AND o.segment = s.segment GROUP BY o.config, o.channel)"""
RATES_SQL = f"a / nullif(a + b, 0) AS recall, c / nullif(c + d, 0) AS false_alarm_rate, ({MCC_SQL})::DOUBLE AS mcc"


def labels(rows: DataFrame) -> DataFrame:
    return rows.groupBy("channel", "segment").agg(F.max("anomaly").alias("anomaly"))


def found(spark, sf_dir, **how) -> DataFrame:
    rows = from_events(spark, sf_dir)
    return bocpd.detect(rows, bocpd.fitted(rows, mixture=False), **how)


@query(f"{DETECT_SQL} SELECT channel, segment, n AS n_points, onset, confirm, round(confidence, 6) AS confidence FROM onsets")
def bocpd_onsets(spark, sf_dir):
    return found(spark, sf_dir).drop("runs", "candidates", "resets")


@query(f"""{DETECT_SQL}, x AS (SELECT channel, segment, confirm, unnest(range(0, least(len(runs), 30))) AS run_length, unnest(runs[1:30]) AS p FROM onsets WHERE onset IS NOT NULL)
SELECT channel, segment, confirm, run_length, confirm - run_length AS candidate_onset, round(p, 6) AS p FROM x WHERE p > 1e-6""")
def onset_posteriors(spark, sf_dir):
    return bocpd.posteriors(found(spark, sf_dir))


@query(f"""{DETECT_SQL}, {COUNT_SQL}, r AS (SELECT *, {RATES_SQL} FROM cal)
SELECT channel, round(a, 6) AS tp, round(b, 6) AS fn, round(c, 6) AS fp, round(d, 6) AS tn, round(recall, 6) AS recall, round(false_alarm_rate, 6) AS false_alarm_rate, round(mcc, 6) AS mcc FROM r""")
def detector_calibration(spark, sf_dir):
    """Recall, false-alarm rate and MCC of the detector by channel."""
    return bocpd.calibration(found(spark, sf_dir), labels(from_events(spark, sf_dir)))


SCOPE_SQL = f"""{COUNT_SQL}, r AS (SELECT *, {RATES_SQL} FROM cal), sc AS (SELECT channel, recall, false_alarm_rate, mcc, recall - false_alarm_rate AS youden_j,
 CASE WHEN recall - false_alarm_rate IS NULL THEN 'one class is missing' WHEN a + b < 5 OR c + d < 5 THEN 'too few segments' WHEN mcc <= 0 THEN 'no better than chance' ELSE 'included' END AS scope FROM r)"""


def _scope(spark, sf_dir) -> DataFrame:
    counts = detector_calibration(spark, sf_dir).select("channel", F.col("tp").alias("a"), F.col("fn").alias("b"), F.col("fp").alias("c"), F.col("tn").alias("d"))
    return evidence.scope(counts).select("channel", "recall", "false_alarm_rate", "mcc", "youden_j", "scope")


@query(f"{DETECT_SQL}, {SCOPE_SQL} SELECT channel, round(recall, 6) AS recall, round(false_alarm_rate, 6) AS false_alarm_rate, round(mcc, 6) AS mcc, round(youden_j, 6) AS youden_j, scope FROM sc")
def detector_scope(spark, sf_dir):
    return _scope(spark, sf_dir)


@query(f"""{DETECT_SQL}, {SCOPE_SQL}, te AS (SELECT channel, count(*) FILTER (anomaly = 0) AS n0 FROM (SELECT channel, segment, max(anomaly) AS anomaly FROM tele WHERE train = 0 GROUP BY channel, segment) GROUP BY channel)
SELECT s.channel, s.scope = 'included' AS include, CASE WHEN s.scope <> 'included' AND coalesce(t.n0, 0) = 0 THEN s.scope || '; confirmed: no normal segment held out' ELSE s.scope END AS reason FROM sc s LEFT JOIN te t USING (channel)""")
def scope_lock(spark, sf_dir):
    """The final scope; an exclusion is confirmed where nothing normal is held out."""
    held_out = labels(from_events(spark, sf_dir).where("train = 0")).groupBy("channel").agg(F.count_if(F.col("anomaly") == 0).alias("n0"))
    rows = _scope(spark, sf_dir).join(held_out, "channel", "left")
    confirmed = (F.col("scope") != "included") & (F.coalesce("n0", F.lit(0)) == 0)
    return rows.select("channel", (F.col("scope") == "included").alias("include"), F.when(confirmed, F.concat("scope", F.lit("; confirmed: no normal segment held out"))).otherwise(F.col("scope")).alias("reason"))


@query(f"{DETECT_SQL}, {SCOPE_SQL} SELECT t.channel, count(*) AS n_samples, count(DISTINCT t.segment) AS n_segments FROM tele t JOIN sc ON t.channel = sc.channel AND sc.scope = 'included' GROUP BY t.channel")
def scoped_samples(spark, sf_dir):
    """What is left of the table when only channels in scope stay."""
    kept = _scope(spark, sf_dir).where("scope = 'included'").select("channel")
    rows = from_events(spark, sf_dir).join(kept, "channel", "left_semi")
    return rows.groupBy("channel", "segment").count().groupBy("channel").agg(F.sum("count").alias("n_samples"), F.count(F.lit(1)).alias("n_segments"))


# Ablation: all four configurations are a column of one job.


def configured(samples: DataFrame, configs: list) -> DataFrame:
    """(config, channel, r, q, forgetting), fitted on samples."""
    fits = {m: bocpd.fitted(samples, mixture=m) for m in {m for _, m, _ in configs}}
    out = None
    for name, mixture, forgetting in configs:
        part = fits[mixture].select(F.lit(name).alias("config"), "channel", "r", "q", F.lit(forgetting).alias("forgetting"))
        out = part if out is None else out.unionByName(part)
    return out


def _ablation(spark, sf_dir, train: bool) -> DataFrame:
    """Calibration of every configuration fitted on held-in segments, evaluated there or on the held-out ones."""
    rows = from_events(spark, sf_dir)
    fits = configured(rows.where("train = 1"), CONFIGS)
    part = rows.where(f"train = {int(train)}")
    return bocpd.calibration(bocpd.detect(part, fits, by=("config", "channel", "segment")), labels(part), ("config", "channel"))


def selected(calibration: DataFrame) -> DataFrame:
    """Mean MCC over channels with five segments of each class, by configuration; the best (the first of equals) is chosen."""
    enough = (F.col("tp") + F.col("fn") >= LEAST_SEGMENTS) & (F.col("fp") + F.col("tn") >= LEAST_SEGMENTS)
    rows = calibration.groupBy("config").agg(F.avg(F.when(enough, F.col("mcc"))).alias("macro_mcc"), F.count_if(enough).alias("n_channels"))
    best = F.row_number().over(Window.partitionBy().orderBy(F.round("macro_mcc", 9).desc_nulls_last(), "config"))
    return rows.withColumn("chosen", best == 1)


_VALUES = ", ".join(f"('{n}', {str(m).lower()}, {str(f).lower()})" for n, m, f in CONFIGS)
ABLATION_SQL = f"WITH RECURSIVE {fit_sql(train=True)}, tr AS (SELECT * FROM tele WHERE train = 1), {detect_sql(_VALUES, 'tr')}, {COUNT_SQL}, ra AS (SELECT *, {RATES_SQL} FROM cal), ab AS (SELECT config, avg(mcc) FILTER (a + b >= 5 AND c + d >= 5) AS macro_mcc, count(*) FILTER (a + b >= 5 AND c + d >= 5) AS n_channels FROM ra GROUP BY config)"


@query(f"{ABLATION_SQL} SELECT config, round(macro_mcc, 6) AS macro_mcc, n_channels, row_number() OVER (ORDER BY round(macro_mcc, 9) DESC NULLS LAST, config) = 1 AS chosen FROM ab")
def ablation_grid(spark, sf_dir):
    return selected(_ablation(spark, sf_dir, train=True))


@query(f"""WITH RECURSIVE {fit_sql(train=True)}, held AS (SELECT * FROM tele WHERE train = 0), {detect_sql(_VALUES, 'held')}, {COUNT_SQL}, ra AS (SELECT *, {RATES_SQL} FROM cal)
SELECT config, channel, config = '{LOCKED}' AS locked, round(recall, 6) AS recall, round(false_alarm_rate, 6) AS false_alarm_rate, round(mcc, 6) AS mcc FROM ra""")
def ablation_evaluation(spark, sf_dir):
    """Every configuration, fitted on held-in segments, on the held-out ones; the chosen and the locked one are among them."""
    rows = _ablation(spark, sf_dir, train=False)
    return rows.select("config", "channel", (F.col("config") == LOCKED).alias("locked"), "recall", "false_alarm_rate", "mcc")


TRAIN_TEST_SQL = f"""WITH RECURSIVE fu AS ({DETECT_SQL}, {COUNT_SQL}, r AS (SELECT *, {RATES_SQL} FROM cal) SELECT channel, recall, false_alarm_rate, a + b AS n1, c + d AS n0 FROM r),
te AS (WITH RECURSIVE {fit_sql(train=True)}, held AS (SELECT * FROM tele WHERE train = 0), {detect_sql(FINAL, 'held')}, {COUNT_SQL}, r AS (SELECT *, {RATES_SQL} FROM cal) SELECT channel, recall, false_alarm_rate, a + b AS n1, c + d AS n0 FROM r)"""


@query(f"""{TRAIN_TEST_SQL} SELECT f.channel, round(f.recall, 6) AS recall_full, round(t.recall, 6) AS recall_test, round(f.recall - t.recall, 6) AS recall_drop,
 round(f.false_alarm_rate, 6) AS false_alarm_rate_full, round(t.false_alarm_rate, 6) AS false_alarm_rate_test, round(f.false_alarm_rate - t.false_alarm_rate, 6) AS false_alarm_rate_drop, t.n1::BIGINT AS n_anomalous_test, t.n0::BIGINT AS n_normal_test FROM fu f JOIN te t USING (channel)""")
def train_fit_test_eval(spark, sf_dir):
    """The detector on all segments against one fitted on held-in segments and run on the others."""
    rows = from_events(spark, sf_dir)
    held = rows.where("train = 0")
    test = bocpd.calibration(bocpd.detect(held, bocpd.fitted(rows.where("train = 1"), mixture=False)), labels(held))
    sides = [c.select("channel", F.col("recall").alias(f"recall_{s}"), F.col("false_alarm_rate").alias(f"false_alarm_rate_{s}"), (F.col("tp") + F.col("fn")).cast("long").alias(f"n_anomalous_{s}"), (F.col("fp") + F.col("tn")).cast("long").alias(f"n_normal_{s}")) for c, s in ((detector_calibration(spark, sf_dir), "full"), (test, "test"))]
    both = sides[0].join(sides[1], "channel")
    drops = [(F.col(f"{c}_full") - F.col(f"{c}_test")).alias(f"{c}_drop") for c in ("recall", "false_alarm_rate")]
    return both.select("channel", "recall_full", "recall_test", "false_alarm_rate_full", "false_alarm_rate_test", *drops, "n_anomalous_test", "n_normal_test")


def _boot_sql(where: str) -> str:
    return f"""{DETECT_SQL}, h AS (SELECT o.channel, o.segment, s.anomaly, onset IS NOT NULL AS hit, row_number() OVER (PARTITION BY o.channel, s.anomaly ORDER BY o.segment) - 1 AS number, count(*) OVER (PARTITION BY o.channel, s.anomaly) AS size
 FROM onsets o JOIN (SELECT channel, segment, max(anomaly) AS anomaly, max(train) AS train FROM tele GROUP BY channel, segment) s ON o.channel = s.channel AND o.segment = s.segment WHERE {where}),
dr AS (SELECT channel, anomaly, rep, CAST(floor({uniform_sql('mcc', 'channel', 'anomaly', 'rep', 'number')} * size) AS BIGINT) AS number FROM h, range(1, {REPLICATES} + 1) q(rep)),
t AS (SELECT channel, rep, (count(*) FILTER (anomaly = 1 AND hit))::DOUBLE AS a, (count(*) FILTER (anomaly = 1 AND NOT hit))::DOUBLE AS b, (count(*) FILTER (anomaly = 0 AND hit))::DOUBLE AS c, (count(*) FILTER (anomaly = 0 AND NOT hit))::DOUBLE AS d
 FROM dr JOIN h USING (channel, anomaly, number) GROUP BY channel, rep), m AS (SELECT channel, ({MCC_SQL})::DOUBLE AS mcc FROM t)
SELECT channel, quantile_cont(mcc, 0.025::DOUBLE) AS low, quantile_cont(mcc, 0.5::DOUBLE) AS mid, quantile_cont(mcc, 0.975::DOUBLE) AS high FROM m GROUP BY channel"""


@query(f"SELECT channel, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high, low < 0 AND high > 0 AS crosses_zero FROM ({_boot_sql('true')})")
def detector_mcc_bootstrap(spark, sf_dir):
    """2,000 stratified replicates of the detector's MCC by channel."""
    return evidence.bootstrap_mcc(_hits(spark, sf_dir), REPLICATES)


def _hits(spark, sf_dir) -> DataFrame:
    rows = from_events(spark, sf_dir)
    return found(spark, sf_dir).join(labels(rows), ["channel", "segment"]).select("channel", "segment", "anomaly", F.col("onset").isNotNull().alias("hit"))


@query(f"""SELECT f.channel, round(f.mid, 6) AS mid_full, round(t.low, 6) AS low_test, round(t.high, 6) AS high_test, coalesce(f.mid >= t.low AND f.mid <= t.high, false) AS full_in_test FROM ({_boot_sql('true')}) f JOIN ({_boot_sql('s.train = 0')}) t USING (channel)""")
def full_in_test_interval(spark, sf_dir):
    """Whether the MCC's median over all segments lies in the interval of the held-out ones."""
    hits = _hits(spark, sf_dir)
    full = evidence.bootstrap_mcc(hits, REPLICATES).select("channel", F.col("mid").alias("mid_full"))
    test = evidence.bootstrap_mcc(hits.where("segment % 4 = 0"), REPLICATES).select("channel", F.col("low").alias("low_test"), F.col("high").alias("high_test"))
    inside = (F.col("mid_full") >= F.col("low_test")) & (F.col("mid_full") <= F.col("high_test"))
    return full.join(test, "channel").withColumn("full_in_test", F.coalesce(inside, F.lit(False)))
