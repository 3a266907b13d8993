"""Queries of the classifiers and of their attributions, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.functions.distributions import chi2_sf_sql
from alarmlens.functions.random import uniform_sql
from alarmlens.operators import alarms, folds, inference, logistic, models, resampling
from alarmlens.operators.catalogue import QUERIES, query
from alarmlens.operators.running import numbered
from alarmlens.plans.evidence import ORACLES
from alarmlens.plans.onsets import onset_tabular_dataset  # noqa: F401  registers the study's table
from alarmlens.plans.resampling import REPS, _auc_of
from alarmlens.plans.studies import AUROC_SQL
from alarmlens.sources.shared import saved

FEATURES = ["level", "diff", "diff2"]
SHUFFLES, REFITS = 20, 200
#: The study's table (effects at canonical onsets, and at placebo pivots timed like them), numbered: id, label, group and fold.
TABLE_SQL = f"""tb AS MATERIALIZED ({ORACLES['onset_tabular_dataset']}), fo AS MATERIALIZED {folds.balanced_sql('tb', ['channel', 'segment'], ['VARCHAR', 'BIGINT'])},
ml AS MATERIALIZED (SELECT row_number() OVER (ORDER BY channel, segment, label, level_d_abs, diff_logvar, diff2_logvar) AS id, channel, segment, label, level_d_abs AS level, diff_logvar AS diff, diff2_logvar AS diff2, fold FROM tb JOIN fo USING (channel, segment))"""
PART_SQL = f"{TABLE_SQL}, ev AS (SELECT m.*, part, fold = part AS held FROM ml m, range(0, 5) q(part))"


def _table(spark, sf_dir) -> DataFrame:
    """The study's table, saved: one row a pivot. Ids break ties of distance and of order."""
    rows = saved(QUERIES["onset_tabular_dataset"](spark, sf_dir).select("channel", "segment", "label", F.col("level_d_abs").alias("level"), F.col("diff_logvar").alias("diff"), F.col("diff2_logvar").alias("diff2")))
    rows = folds.balanced(numbered(rows, ["channel", "segment", "label", *FEATURES], "id").withColumn("id", F.col("id") + 1), ["channel", "segment"])
    return saved(rows)


@query(f"WITH {TABLE_SQL} SELECT channel, segment, fold, count(*) AS n FROM ml GROUP BY channel, segment, fold")
def group_folds(spark, sf_dir):
    return _table(spark, sf_dir).groupBy("channel", "segment", "fold").agg(F.count(F.lit(1)).alias("n"))


def _bayes_sql(features: list[str]) -> str:
    moments = ", ".join(f"avg({x}) FILTER (label = {y}) AS {x}_m{y}, var_pop({x}) FILTER (label = {y}) AS {x}_v{y}" for x in features for y in (0, 1))
    terms = "".join(f" {'-' if y else '+'} 0.5 * (ln({x}_v{y} + 1e-9) + ({x} - {x}_m{y}) * ({x} - {x}_m{y}) / ({x}_v{y} + 1e-9))" for x in features for y in (1, 0))
    return f"SELECT m.id, m.label, 1 / (1 + exp(-(ln(share) - ln(1 - share){terms}))) AS probability FROM ml m JOIN (SELECT part, avg(label::DOUBLE) AS share, {moments} FROM ev WHERE NOT held GROUP BY part) s ON m.fold = s.part"


@query(f"WITH {PART_SQL} SELECT id, CAST(label AS BIGINT) AS label, round(probability, 6) AS probability FROM ({_bayes_sql(FEATURES)})")
def gaussian_nb(spark, sf_dir):
    """Out-of-fold probabilities of Gaussian naive Bayes."""
    return models.naive_bayes(_table(spark, sf_dir), FEATURES).select("id", "label", "probability")


#: Features standardised by the other folds' rows, and classes that weigh alike.
SCALED_SQL = f"""{PART_SQL}, st AS (SELECT part, {', '.join(f'avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}' for x in FEATURES)} FROM ev WHERE NOT held GROUP BY part),
z AS MATERIALIZED (SELECT e.id, e.label, e.part, held, {', '.join(f'CASE WHEN s_{x} > 0 THEN ({x} - m_{x}) / s_{x} ELSE 0 END AS {x}' for x in FEATURES)} FROM ev e JOIN st USING (part))"""
LOGISTIC_ROWS_SQL = f"{SCALED_SQL}, lr AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY part) / (2.0::DOUBLE * count(*) OVER (PARTITION BY part, label)) AS w FROM z WHERE NOT held)"


def _logistic_sql(features: list[str], name: str) -> str:
    """CTEs, the last of which, <name>p, is (id, label, probability) out of fold."""
    linear = " + ".join(["b_0", *[f"b_{x} * {x}" for x in features]])
    return f"{name}b AS MATERIALIZED {logistic.fitted_sql('lr', 'part', features)}, {name}p AS (SELECT id, label, 1 / (1 + exp(-({linear}))) AS probability FROM z JOIN {name}b USING (part) WHERE held)"


def _logistic(rows: DataFrame, features: list[str], sparse: bool = False) -> DataFrame:
    """(id, label, probability) out of fold."""
    train, test = models.scaled(rows, FEATURES)
    weighted = saved(logistic.balanced(train, ["part"]))
    return logistic.scored(test, logistic.fitted(weighted, ["part"], features, sparse=sparse), ["part"], features).select("id", "label", "probability")


@query(f"WITH {LOGISTIC_ROWS_SQL}, {_logistic_sql(FEATURES, 'f')} SELECT id, CAST(label AS BIGINT) AS label, round(probability, 6) AS probability FROM fp")
def logistic_scores(spark, sf_dir):
    """Out-of-fold probabilities of logistic regression with squared penalty, by reweighted least squares."""
    return _logistic(_table(spark, sf_dir), FEATURES)


@query(f"""WITH {LOGISTIC_ROWS_SQL}, {_logistic_sql(FEATURES, 'f')}, {_logistic_sql(FEATURES[1:], 'd')}, ab AS (SELECT 'with level' AS features, label = 1 AS pos, round(probability, 12) AS s FROM fp UNION ALL SELECT 'without level', label = 1, round(probability, 12) FROM dp),
au AS ({AUROC_SQL.format(by='features', rows='ab').replace('round(sum(won) / nullif(sum(p) * sum(q), 0), 6)', 'sum(won) / nullif(sum(p) * sum(q), 0)')})
SELECT round(max(auroc) FILTER (features = 'with level'), 6) AS with_level, round(max(auroc) FILTER (features = 'without level'), 6) AS without_level, round(max(auroc) FILTER (features = 'with level') - max(auroc) FILTER (features = 'without level'), 6) AS gain FROM au""")
def incremental_level(spark, sf_dir):
    """What the level adds to the differences, out of fold, by logistic regression."""
    rows = _table(spark, sf_dir)
    both = [_logistic(rows, f).select((F.col("label") == 1).alias("pos"), F.round("probability", 12).alias("s"), F.lit(name).alias("features")) for name, f in (("with level", FEATURES), ("without level", FEATURES[1:]))]
    areas = inference.auroc(both[0].unionByName(both[1]), ["features"], "s", "pos")
    a, b = (F.max(F.when(F.col("features") == name, F.col("auroc"))) for name in ("with level", "without level"))
    return areas.agg(a.alias("with_level"), b.alias("without_level"), (a - b).alias("gain"))


@query(f"""WITH {LOGISTIC_ROWS_SQL}, {_logistic_sql(FEATURES, 'f')}, {_logistic_sql(FEATURES[1:], 'd')},
un AS MATERIALIZED (SELECT channel || '_' || segment AS g, m.label AS anomaly, round(fp.probability, 12) AS with_level, round(dp.probability, 12) AS without_level FROM ml m JOIN fp USING (id) JOIN dp USING (id)),
cl AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT g FROM un)),
dr AS (SELECT rep, CAST(floor({uniform_sql('level-gain', 'rep', 'draw')} * k) AS BIGINT) AS i FROM (SELECT DISTINCT k FROM cl), range(1, {REPS} + 1) r(rep), range(1, 10000) q(draw) WHERE draw <= k),
we AS (SELECT rep, g, count(*)::DOUBLE AS w FROM dr JOIN cl USING (i) GROUP BY rep, g), wr AS MATERIALIZED (SELECT rep, anomaly, with_level, without_level, w FROM un JOIN we USING (g)),
x AS ({_auc_of('wr', 'with_level')}), y AS ({_auc_of('wr', 'without_level')}), v AS (SELECT x.a - y.a AS v FROM x JOIN y USING (rep))
SELECT count(v) AS n_replicates, round(quantile_cont(v, 0.025::DOUBLE), 6) AS low, round(quantile_cont(v, 0.5::DOUBLE), 6) AS mid, round(quantile_cont(v, 0.975::DOUBLE), 6) AS high, round(least(1, 2 * least(avg((v <= 0)::INT), avg((v >= 0)::INT))), 6) AS p_value FROM v""")
def incremental_level_interval(spark, sf_dir):
    """The level's gain over whole segments drawn with replacement: interval, and two-sided p."""
    rows = _table(spark, sf_dir)
    both = [_logistic(rows, f).select("id", F.round("probability", 12).alias(name)) for name, f in (("with_level", FEATURES), ("without_level", FEATURES[1:]))]
    met = saved(rows.select("id", F.concat_ws("_", "channel", "segment").alias("g"), (F.col("label") == 1).alias("pos")).join(both[0], "id").join(both[1], "id"))
    reps = saved(resampling.contrast(met, alarms.cluster_weights(met.select("g"), "g", REPS, "level-gain"), ["g"], "with_level", "without_level", "pos"))
    d = F.col("difference")
    p = reps.agg(F.least(F.lit(1.0), 2 * F.least(F.avg((d <= 0).cast("double")), F.avg((d >= 0).cast("double")))).alias("p_value"))
    return resampling.interval(reps, [], "difference").crossJoin(F.broadcast(p))


@query(f"""WITH {SCALED_SQL},
d AS (SELECT a.id, a.label AS own, b.label, row_number() OVER (PARTITION BY a.id ORDER BY (b.level - a.level) * (b.level - a.level) + (b.diff - a.diff) * (b.diff - a.diff) + (b.diff2 - a.diff2) * (b.diff2 - a.diff2), b.id) AS place FROM z a JOIN z b ON a.part = b.part AND a.held AND NOT b.held)
SELECT id, round(avg(label::DOUBLE), 6) AS probability FROM d WHERE place <= 15 GROUP BY id""")
def knn_scores(spark, sf_dir):
    """Out-of-fold share of anomalous rows among the 15 nearest, features standardised by fold."""
    train, test = models.scaled(_table(spark, sf_dir), FEATURES)
    return models.neighbours(train, test, FEATURES).select("id", "probability")


def _discriminant_sql(rows: str, by: str, weight: str = "1.0::DOUBLE") -> str:
    parts = []
    for x in FEATURES:
        n, s, q = ([f"sum({weight} * {v}) FILTER (label = {y})" for y in (0, 1)] for v in ("1", x, f"{x} * {x}"))
        m0, m1 = f"({s[0]} / {n[0]})", f"({s[1]} / {n[1]})"
        v0, v1 = f"({q[0]} / {n[0]} - {m0} * {m0})", f"({q[1]} / {n[1]} - {m1} * {m1})"
        parts.append(f"CASE WHEN {v0} + {v1} > 0 THEN ({m1} - {m0}) / (({v0} + {v1}) / 2) END AS b_{x}")
    return f"SELECT {by}, {', '.join(parts)} FROM {rows} GROUP BY {by}"


ATTRIBUTION_SQL = f"""{TABLE_SQL}, co AS ({_discriminant_sql('ml', 'channel')}), me AS (SELECT channel, {', '.join(f'avg({x}) AS m_{x}' for x in FEATURES)} FROM ml GROUP BY channel),
aw AS (SELECT channel, {', '.join(f'avg(abs(b_{x} * ({x} - m_{x}))) AS shap_{x}, avg(abs(b_{x} * {x})) AS gradients_{x}' for x in FEATURES)} FROM ml JOIN co USING (channel) JOIN me USING (channel) GROUP BY channel),
im AS ({' UNION ALL '.join(f"SELECT channel || '/{m}' AS model, '{m}' AS family, '{x}' AS feature, {m}_{x} / ({' + '.join(f'{m}_{y}' for y in FEATURES)}) AS share FROM aw" for m in ('shap', 'gradients') for x in FEATURES)})"""


def _importance(spark, sf_dir) -> DataFrame:
    rows = models.attributions(_table(spark, sf_dir), FEATURES, ["channel"])
    return rows.select(F.concat_ws("/", "channel", "method").alias("model"), F.col("method").alias("family"), "feature", "share")


@query(f"WITH {ATTRIBUTION_SQL} SELECT model, family, feature, round(share, 6) AS share FROM im")
def linear_attributions(spark, sf_dir):
    """Shares of linear SHAP and integrated gradients by channel's discriminant."""
    return _importance(spark, sf_dir)


PIVOT_SQL = f"{ATTRIBUTION_SQL}, pv AS (SELECT model, family, {', '.join(f'''avg(share) FILTER (feature = '{x}') AS {x}''' for x in FEATURES)} FROM im GROUP BY model, family)"


@query(f"WITH {PIVOT_SQL} SELECT model, family, {', '.join(f'round({x}, 6) AS {x}' for x in FEATURES)} FROM pv")
def importance_pivot(spark, sf_dir):
    return models.importance_pivot(_importance(spark, sf_dir), FEATURES)


@query(f"""WITH {PIVOT_SQL} SELECT family, count(*) AS n_models, {', '.join(f'round(avg({x}), 6) AS mean_{x}' for x in FEATURES)}, avg(diff) + avg(diff2) > avg(level) AS differences_beat_level FROM pv GROUP BY family""")
def family_summary(spark, sf_dir):
    return models.family_summary(importance_pivot(spark, sf_dir))


BINOMIAL_SQL = "SELECT count(*) FILTER (NOT level >= greatest(diff, diff2)) AS k0, count(*) AS n FROM pv"
_PMF = "exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(2 / 3.0::DOUBLE) + (n - k) * ln(1 / 3.0::DOUBLE))"


@query(f"WITH {PIVOT_SQL}, b AS ({BINOMIAL_SQL}) SELECT k0 AS n_not_top, n, round(sum({_PMF}), 6) AS p_value FROM b, range(0, 1000) q(k) WHERE k >= k0 AND k <= n GROUP BY k0, n")
def binomial_not_top(spark, sf_dir):
    return inference.binomial_not_top(importance_pivot(spark, sf_dir), "level", ["diff", "diff2"])


@query(f"""WITH {PIVOT_SQL}, k AS (SELECT feature, rank() OVER (PARTITION BY model ORDER BY share) + (count(*) OVER (PARTITION BY model, share) - 1) / 2.0::DOUBLE AS r FROM im), s AS (SELECT feature, sum(r) AS total, count(*) AS m FROM k GROUP BY feature),
w AS (SELECT 12 * var_pop(total) * count(*) / (max(m) * max(m) * (count(*) ** 3 - count(*))) AS w, max(m) AS m, count(*) AS k FROM s), b AS ({BINOMIAL_SQL}), pb AS (SELECT k0, sum({_PMF}) AS p FROM b, range(0, 1000) q(k) WHERE k >= k0 AND k <= n GROUP BY k0)
SELECT (SELECT count(DISTINCT model) FROM im) AS n_models, round(w, 6) AS w, round(m * (k - 1) * w, 6) AS chi2, round({chi2_sf_sql('(m * (k - 1) * w)', '(k - 1)')}, 6) AS p_value, k0 AS n_not_top, round(p, 6) AS p_not_top FROM w, pb""")
def agreement_summary(spark, sf_dir):
    rows = _importance(spark, sf_dir)
    whole = rows.agg(F.countDistinct("model").alias("n_models"))
    top = inference.binomial_not_top(models.importance_pivot(rows, FEATURES), "level", ["diff", "diff2"]).select("n_not_top", F.col("p_value").alias("p_not_top"))
    return whole.crossJoin(inference.kendall_w(rows, "model", "feature", "share")).crossJoin(top)


def _permuted_sql() -> str:
    parts = []
    for x in FEATURES:
        key = "channel, segment, label, level, diff, diff2"
        dealt = f"SELECT rep, {x} AS new, row_number() OVER (PARTITION BY rep ORDER BY {uniform_sql(f'shuffle-{x}', 'rep', 'id')}, id) AS id FROM ml, range(1, {SHUFFLES} + 1) q(rep)"
        parts.append(f"SELECT '{x}' AS feature, rep, {' + '.join(f'b_{y} * new' if y == x else f'b_{y} * {y}' for y in FEATURES)} AS s, label = 1 AS pos FROM ml JOIN ({dealt}) d USING (id), co")
    whole = f"SELECT 'whole' AS feature, 0 AS rep, {' + '.join(f'b_{y} * {y}' for y in FEATURES)} AS s, label = 1 AS pos FROM ml, co"
    return " UNION ALL ".join([whole, *parts])


@query(f"""WITH {TABLE_SQL}, co AS (SELECT {', '.join(f'b_{x}' for x in FEATURES)} FROM ({_discriminant_sql('ml', '1')})), pm AS ({_permuted_sql()}),
e AS (SELECT feature, rep, s, (count(*) FILTER (pos))::DOUBLE AS p, (count(*) FILTER (NOT pos))::DOUBLE AS q FROM pm GROUP BY feature, rep, s), b AS (SELECT *, p * (coalesce(sum(q) OVER (PARTITION BY feature, rep ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS won FROM e),
a AS (SELECT feature, rep, sum(won) / (sum(p) * sum(q)) AS a FROM b GROUP BY feature, rep), d AS (SELECT feature, greatest(avg((SELECT a FROM a WHERE feature = 'whole') - a), 0) AS drop_ FROM a WHERE feature <> 'whole' GROUP BY feature)
SELECT feature, round(drop_, 6) AS drop, round(CASE WHEN sum(drop_) OVER () > 0 THEN drop_ / sum(drop_) OVER () ELSE 1 / 3.0::DOUBLE END, 6) AS share FROM d""")
def permutation_importance(spark, sf_dir):
    return models.permutation_importance(_table(spark, sf_dir), FEATURES, ["id"], SHUFFLES)


@query(f"""WITH {TABLE_SQL}, g AS (SELECT DISTINCT channel, segment FROM ml), nu AS (SELECT channel, segment, row_number() OVER (PARTITION BY channel ORDER BY segment) - 1 AS j, count(*) OVER (PARTITION BY channel) AS n FROM g),
dr AS (SELECT rep, channel, CAST(floor({uniform_sql('refit', 'rep', 'channel', 'j')} * n) AS BIGINT) AS j FROM nu, range(1, {REFITS} + 1) q(rep)), we AS (SELECT rep, channel, segment, count(*)::DOUBLE AS w FROM dr JOIN nu USING (channel, j) GROUP BY rep, channel, segment),
r AS (SELECT rep, label, level, diff, diff2, w FROM ml JOIN we USING (channel, segment)), c AS ({_discriminant_sql('r', 'rep', 'w')}), sd AS (SELECT {', '.join(f'stddev_pop({x}) AS s_{x}' for x in FEATURES)} FROM ml),
h AS (SELECT rep, {', '.join(f'abs(b_{x} * s_{x}) AS i_{x}' for x in FEATURES)} FROM c, sd WHERE b_level IS NOT NULL)
SELECT count(*) AS n_replicates, round(avg((i_diff + i_diff2 > i_level)::INT), 6) AS share_differences_first, round(avg(i_level / (i_level + i_diff + i_diff2)), 6) AS mean_level_share FROM h""")
def stability_bootstrap(spark, sf_dir):
    """200 refits of the discriminant on segments drawn inside channels: how often both differences outweigh the level."""
    from alarmlens.functions.random import uniform
    from pyspark.sql import Window

    rows = _table(spark, sf_dir)
    numbered = rows.select("channel", "segment").distinct().select("channel", "segment", (F.row_number().over(Window.partitionBy("channel").orderBy("segment")) - 1).alias("j"), F.count(F.lit(1)).over(Window.partitionBy("channel")).alias("n"))
    drawn = numbered.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(REFITS)))).select("rep", "channel", F.floor(uniform("refit", "rep", "channel", "j") * F.col("n")).cast("int").alias("j"))
    weights = drawn.groupBy("rep", "channel", "j").agg(F.count(F.lit(1)).cast("double").alias("w")).join(numbered.select("channel", "segment", "j"), ["channel", "j"]).select("rep", "channel", "segment", "w")
    fits = models.discriminant(rows.join(weights, ["channel", "segment"]), FEATURES, ["rep"], "w").where("b_level IS NOT NULL")
    spread = rows.agg(*[F.stddev_pop(x).alias(f"s_{x}") for x in FEATURES])
    size = {x: F.abs(F.col(f"b_{x}") * F.col(f"s_{x}")) for x in FEATURES}
    each = fits.crossJoin(F.broadcast(spread)).select(*[size[x].alias(f"i_{x}") for x in FEATURES])
    return each.agg(F.count(F.lit(1)).alias("n_replicates"), F.avg((F.col("i_diff") + F.col("i_diff2") > F.col("i_level")).cast("double")).alias("share_differences_first"), F.avg(F.col("i_level") / (F.col("i_level") + F.col("i_diff") + F.col("i_diff2"))).alias("mean_level_share"))
