"""Queries of tree ensembles, kernel machines and attributions by coalitions, and of all models side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.functions.random import uniform_sql
from alarmlens.operators import coalitions, inference, kernel, logistic, models, refits, trees
from alarmlens.operators.catalogue import QUERIES, query
from alarmlens.plans import sequences
from alarmlens.plans.models import FEATURES, LOGISTIC_ROWS_SQL, PART_SQL, _logistic, _table
from alarmlens.sources.shared import saved

BIN_NAMES = [f"b_{x}" for x in FEATURES]
_AT = ", ".join(str(k / trees.BINS) for k in range(1, trees.BINS))
BINS_SQL = f"""{PART_SQL}, ed AS MATERIALIZED (SELECT {', '.join(f'list_distinct([round(c, 9) FOR c IN quantile_cont({x}, [{_AT}])]) AS e_{x}' for x in FEATURES)} FROM ml),
bn AS MATERIALIZED (SELECT part, id, label, {', '.join(f'len(list_filter(e_{x}, lambda c: c < {x})) AS b_{x}' for x in FEATURES)} FROM ev, ed WHERE NOT held),
up AS MATERIALIZED (SELECT part, id, label, unnest([0, 1, 2]) AS f, unnest([{', '.join(BIN_NAMES)}]) AS b FROM bn)"""
_NAME_SQL = "CASE f " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(FEATURES)) + " END"
FEW = trees.ENSEMBLES["extra_trees"] | {"trees": 5, "depth": 2}
STUMPS = trees.ENSEMBLES["newton_boosting"] | {"trees": 2, "depth": 1}


def _binned(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells that each fold learns from, and the rows (part: their own fold) that it is tested on."""
    table = saved(trees.binned(rows, trees.edges(rows, FEATURES)))
    every = models._each_fold(table, models.FOLDS)
    return saved(trees.cells(every.where("NOT held"), FEATURES)), every.where("held")


def _nodes(model: DataFrame) -> DataFrame:
    """One row a cut: (part, tree, node, feature, cut)."""
    each = model.select("part", "tree", F.posexplode(F.arrays_zip("feature", "cut")).alias("node", "x")).where("x.feature >= 0")
    return each.select("part", "tree", "node", F.get(F.array(*map(F.lit, FEATURES)), F.col("x.feature")).alias("feature"), F.col("x.cut").alias("cut"))


def _cut_sql(name: str, rows: str) -> str:
    """name: (part, tree, node, f, cut), a random cut on the first varying feature in random order, of rows (part, tree, node, f, b)."""
    u = uniform_sql("tree-feature", "part", "tree", "node", "f")
    return f"""{name} AS MATERIALIZED (SELECT part, tree, node, f, lo + CAST(floor({uniform_sql('tree-cut', 'part', 'tree', 'node')} * (hi - lo)) AS BIGINT) AS cut FROM (SELECT part, tree, node, arg_min(f, u) AS f, arg_min(lo, u) AS lo, arg_min(hi, u) AS hi
 FROM (SELECT *, {u} AS u FROM (SELECT part, tree, node, f, min(b) AS lo, max(b) AS hi FROM {rows} GROUP BY part, tree, node, f) WHERE lo < hi) GROUP BY part, tree, node))"""


@query(f"""WITH {BINS_SQL}, t0 AS MATERIALIZED (SELECT part, tree, 0 AS node, id, f, b FROM up, range(0, {FEW['trees']}) q(tree)), {_cut_sql('c0', 't0')},
g1 AS MATERIALIZED (SELECT t.part, t.tree, t.id, CASE WHEN b > cut THEN 2 ELSE 1 END AS node FROM t0 t JOIN c0 c ON t.part = c.part AND t.tree = c.tree AND t.f = c.f), t1 AS MATERIALIZED (SELECT g.part, g.tree, g.node, g.id, u.f, u.b FROM g1 g JOIN up u ON g.part = u.part AND g.id = u.id), {_cut_sql('c1', 't1')}
SELECT part, tree, node, {_NAME_SQL} AS feature, cut FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1)""")
def extra_tree_cuts(spark, sf_dir):
    """The cuts of five extremely random trees of depth two in each fold."""
    return _nodes(trees.trained(_binned(_table(spark, sf_dir))[0], FEATURES, FEW))


def _stump_sql(k: int) -> str:
    """s<k>: the best cut by part for rows r<k> (part, id, label, f, b, m: the margin so far); r<k+1>: margins with it."""
    given = STUMPS
    score = lambda g, h: f"{g} * {g} / ({h} + {given['penalty']})"
    return f"""d{k} AS MATERIALIZED (SELECT part, f, b, sum(label - 1 / (1 + exp(-m))) AS g, sum(1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m)))) AS h, count(*) AS n FROM r{k} GROUP BY part, f, b),
e{k} AS MATERIALIZED (SELECT part, f, b, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl, sum(g) OVER v AS gw, sum(h) OVER v AS hw, sum(n) OVER v AS nw FROM d{k} WINDOW w AS (PARTITION BY part, f ORDER BY b), v AS (PARTITION BY part, f)),
p{k} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY part ORDER BY round({score('gl', 'hl')} + {score('(gw - gl)', '(hw - hl)')} - {score('gw', 'hw')}, 9) DESC, f, b) AS place FROM e{k} WHERE nl < nw AND hl >= {given['least']} AND hw - hl >= {given['least']}),
s{k} AS MATERIALIZED (SELECT part, {k + 1} AS tree, f, b AS cut, {given['rate']} * gl / (hl + {given['penalty']}) AS low, {given['rate']} * (gw - gl) / (hw - hl + {given['penalty']}) AS high FROM p{k} WHERE place = 1),
m{k} AS MATERIALIZED (SELECT r.part, r.id, m + CASE WHEN r.b > cut THEN high ELSE low END AS m FROM r{k} r JOIN s{k} s ON r.part = s.part AND r.f = s.f),
r{k + 1} AS MATERIALIZED (SELECT u.part, u.id, u.label, u.f, u.b, m.m FROM up u JOIN m{k} m ON u.part = m.part AND u.id = m.id)"""


@query(f"""WITH {BINS_SQL}, r0 AS MATERIALIZED (SELECT part, id, label, f, b, 0.0::DOUBLE AS m FROM up), {_stump_sql(0)}, {_stump_sql(1)}
SELECT part, tree, {_NAME_SQL} AS feature, cut, round(low, 6) AS low, round(high, 6) AS high FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1)""")
def boosting_stumps(spark, sf_dir):
    """The first two trees of second-order boosting with one cut each, in each fold: cut and leaves."""
    model = trees.trained(_binned(_table(spark, sf_dir))[0], FEATURES, STUMPS)
    rows = _nodes(model).join(model.select("part", "tree", F.get("value", F.lit(1)).alias("low"), F.get("value", F.lit(2)).alias("high")), ["part", "tree"])
    return rows.select("part", "tree", "feature", "cut", "low", "high")


def _ensembles(counted: DataFrame, names) -> dict[str, dict]:
    return {name: trees.collected(trees.trained(counted, FEATURES, trees.ENSEMBLES[name])) for name in names}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _tree_scores(held: DataFrame, fitted: dict) -> DataFrame:
    return _union([trees.scores(held, FEATURES, m, trees.ENSEMBLES[name]).select("id", "label", F.lit(name).alias("model"), "probability") for name, m in fitted.items()])


def _tree_shap(held: DataFrame, fitted: dict) -> DataFrame:
    return _union([trees.attributions(held, FEATURES, m, trees.ENSEMBLES[name]).withColumn("model", F.lit(name)) for name, m in fitted.items()])


@query()
def ensemble_scores(spark, sf_dir):
    """Out-of-fold probabilities of the five tree ensembles."""
    counted, held = _binned(_table(spark, sf_dir))
    return _tree_scores(held, _ensembles(counted, trees.ENSEMBLES))


@query()
def tree_shap(spark, sf_dir):
    """Shapley values of each row's margin under the five tree ensembles of its fold. With base they sum to the margin."""
    counted, held = _binned(_table(spark, sf_dir))
    return _tree_shap(held, _ensembles(counted, trees.ENSEMBLES)).select("id", "label", "part", "model", *FEATURES, "margin", "base")


def _moments(train: DataFrame) -> DataFrame:
    return train.groupBy("part").agg(F.avg(F.col("label").cast("double")).alias("share"), *[f(F.when(F.col("label") == y, F.col(x))).alias(f"{x}_{n}{y}") for x in FEATURES for y in (0, 1) for n, f in (("m", F.avg), ("v", F.var_pop))])


def _bayes_score(x: str) -> str:
    return "".join(f" {'-' if y else '+'} CAST(0.5 AS DOUBLE) * (ln({x}_v{y} + CAST(1e-9 AS DOUBLE)) + ({x} - {x}_m{y}) * ({x} - {x}_m{y}) / ({x}_v{y} + CAST(1e-9 AS DOUBLE)))" for y in (1, 0))


BAYES = f"1 / (1 + exp(-(ln(share) - ln(1 - share){''.join(map(_bayes_score, FEATURES))})))"
_ROW, _SUMS, _SOLVED = coalitions.regression_sql(len(FEATURES))


@query(f"""WITH {LOGISTIC_ROWS_SQL}, mo AS (SELECT part, avg(label::DOUBLE) AS share, {', '.join(f'{f}({x}) FILTER (label = {y}) AS {x}_{n}{y}' for x in FEATURES for y in (0, 1) for n, f in (('m', 'avg'), ('v', 'var_pop')))} FROM z WHERE NOT held GROUP BY part),
bg AS MATERIALIZED (SELECT part, {', '.join(f'{x} AS o_{x}' for x in FEATURES)} FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY {uniform_sql('background', 'part', 'id')}, id) AS place FROM z WHERE NOT held) WHERE place <= {coalitions.BACKGROUND}),
mx AS (SELECT z.id, z.part, bits, {', '.join(f'CASE WHEN (bits >> {k}) & 1 = 1 THEN {x} ELSE o_{x} END AS {x}' for k, x in enumerate(FEATURES))} FROM z JOIN bg USING (part), range(0, {2 ** len(FEATURES)}) q(bits) WHERE held),
va AS MATERIALIZED (SELECT id, part, bits, avg({BAYES}) AS v FROM mx JOIN mo USING (part) GROUP BY id, part, bits),
en AS (SELECT id, part, max(v) FILTER (bits = 0) AS v_none, max(v) FILTER (bits = {2 ** len(FEATURES) - 1}) AS v_all FROM va GROUP BY id, part),
rw AS (SELECT id, part, v_none, v_all, {', '.join(_ROW)} FROM va JOIN en USING (id, part) WHERE bits BETWEEN 1 AND {2 ** len(FEATURES) - 2}), su AS (SELECT id, part, max(v_none) AS v_none, max(v_all) AS v_all, {', '.join(_SUMS)} FROM rw GROUP BY id, part)
SELECT id, part, {', '.join(f'round(x_{k}, 6) AS phi_{x}' for k, x in enumerate(FEATURES))}, round(v_none, 6) AS v_none, round(v_all, 6) AS v_all FROM (SELECT *, {', '.join(_SOLVED)} FROM su)""")
def kernel_shap_bayes(spark, sf_dir):
    """Kernel SHAP of naive Bayes on standardised features: every coalition of every row, against a bounded background of its fold."""
    train, test = models.scaled(_table(spark, sf_dir), FEATURES)
    train = saved(train)
    return coalitions.kernel_shap(test, train, FEATURES, lambda rows: rows.join(F.broadcast(_moments(train)), "part").withColumn("probability", F.expr(BAYES)))


def _machine(train: DataFrame):
    machines = kernel.fitted(train, FEATURES)
    return kernel.answer(machines, kernel.calibrated(train, machines, FEATURES), FEATURES)


@query()
def svm_scores(spark, sf_dir):
    """Out-of-fold probabilities of the support vector machine with a Gaussian kernel."""
    train, test = models.scaled(_table(spark, sf_dir), FEATURES)
    return _machine(saved(train))(test).select("id", "label", "probability")


@query()
def shallow_network(spark, sf_dir):
    """Out-of-fold probabilities of the small network that is kept out of the leaderboard."""
    return models.out_of_fold(_table(spark, sf_dir), FEATURES, "mlp_shallow")


def _side_by_side(spark, sf_dir, networks: list[str]) -> tuple[DataFrame, DataFrame]:
    """(model, family, label, probability) out of fold, and (model, family, feature, share), of every model."""
    rows = _table(spark, sf_dir)
    train, test = (saved(x) for x in models.scaled(rows, FEATURES))
    counted, held = _binned(rows)
    fitted = _ensembles(counted, trees.ENSEMBLES)
    families = {n: g["family"] for n, g in trees.ENSEMBLES.items()} | {"logreg_l2": "linear", "logreg_l1": "linear, sparse", "gaussian_nb": "probabilistic", "knn": "instances", "svm_rbf": "kernel"} | {n: sequences.sequences.NETWORKS[n][0] for n in networks}
    machine = _machine(train)
    bayes = lambda x: x.join(F.broadcast(_moments(train)), "part").withColumn("probability", F.expr(BAYES))
    scored, shared = [_tree_scores(held, fitted)], [coalitions.shares(_tree_shap(held, fitted), ["model", "part"], {x: x for x in FEATURES})]
    weighted = saved(logistic.balanced(train, ["part"]))
    means = train.groupBy("part").agg(*[F.avg(x).alias(f"a_{x}") for x in FEATURES])
    for name, sparse in (("logreg_l2", False), ("logreg_l1", True)):
        found = logistic.fitted(weighted, ["part"], FEATURES, sparse=sparse)
        scored.append(logistic.scored(test, found, ["part"], FEATURES).withColumn("model", F.lit(name)))
        each = test.join(F.broadcast(found), "part").join(F.broadcast(means), "part").select("part", *[(F.col(f"b_{x}") * (F.col(x) - F.col(f"a_{x}"))).alias(x) for x in FEATURES])
        shared.append(coalitions.shares(each, ["part"], {x: x for x in FEATURES}).withColumn("model", F.lit(name)))
    for name, answer in (("gaussian_nb", bayes), ("svm_rbf", machine)):
        scored.append(answer(test).withColumn("model", F.lit(name)))
        shared.append(coalitions.shares(coalitions.kernel_shap(test, train, FEATURES, answer), ["part"], {x: f"phi_{x}" for x in FEATURES}).withColumn("model", F.lit(name)))
    scored.append(models.neighbours(train, test, FEATURES).join(rows.select("id", "label"), "id").withColumn("model", F.lit("knn")))
    if networks:
        table, lanes = sequences.trained(spark, sf_dir, networks)
        seen = saved(sequences.scored(table, lanes).join(table.select("id", F.col("fold").cast("long").alias("part")), "id"))
        scored.append(seen)
        shared.append(coalitions.shares(seen, ["model", "part"], {x: x for x in FEATURES}))
    named = F.create_map(*[F.lit(v) for pair in families.items() for v in pair])
    all_scores = _union([s.select("model", F.col("label").cast("long").alias("label"), "probability") for s in scored])
    # the mean of the folds' shares
    importance = _union([s.select("model", "feature", "share") for s in shared]).groupBy("model", "feature").agg(F.avg("share").alias("share"))
    return all_scores.withColumn("family", named[F.col("model")]), importance.withColumn("family", named[F.col("model")])


def leaderboard(scores: DataFrame) -> DataFrame:
    """(model, family, auroc, recall, false_alarm_rate): the last two at the highest cut of the largest difference between them."""
    each = scores.withColumn("pos", F.col("label") == 1).withColumn("s", F.round("probability", 9))
    areas = inference.auroc(each, ["model", "family"], "s", "pos")
    by = each.groupBy("model", "s").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("q"))
    down, whole = Window.partitionBy("model").orderBy(F.desc("s")), Window.partitionBy("model")
    curve = by.select("model", "s", F.try_divide(F.sum("p").over(down).cast("double"), F.sum("p").over(whole)).alias("recall"), F.try_divide(F.sum("q").over(down).cast("double"), F.sum("q").over(whole)).alias("false_alarm_rate"))
    best = curve.groupBy("model").agg(F.max_by(F.struct("recall", "false_alarm_rate"), F.struct(F.round(F.col("recall") - F.col("false_alarm_rate"), 9), "s")).alias("best"))
    return areas.join(best, "model").select("model", "family", "auroc", "best.recall", "best.false_alarm_rate")


@query()
def model_leaderboard(spark, sf_dir):
    """Every model's out-of-fold AUROC, and recall and false-alarm share at Youden's cut; and the detector's mean recall and false-alarm share over channels, without an AUROC, last."""
    scores, _ = _side_by_side(spark, sf_dir, ["cnn1d", "tcn"])
    detector = QUERIES["detector_scope"](spark, sf_dir).where("scope = 'included'").agg(F.avg("recall").alias("recall"), F.avg("false_alarm_rate").alias("false_alarm_rate"))
    row = detector.select(F.lit("detector").alias("model"), F.lit("reference").alias("family"), F.lit(None).cast("double").alias("auroc"), "recall", "false_alarm_rate")
    return leaderboard(scores).unionByName(row).orderBy(F.col("auroc").desc_nulls_last(), "model")


@query()
def model_importance(spark, sf_dir):
    """Each model's importance shares: Shapley values of trees and linear scores, kernel SHAP, integrated gradients; by the mean over folds."""
    return _side_by_side(spark, sf_dir, ["cnn1d", "tcn"])[1].select("model", "family", "feature", "share")


@query()
def model_agreement(spark, sf_dir):
    """Concordance of the models' ranks of the features, and how many don't have the level first."""
    rows = saved(_side_by_side(spark, sf_dir, ["cnn1d", "tcn"])[1])
    whole = rows.agg(F.countDistinct("model").alias("n_models"))
    top = inference.binomial_not_top(models.importance_pivot(rows, FEATURES), "level", ["diff", "diff2"]).select("n_not_top", F.col("p_value").alias("p_not_top"))
    return whole.crossJoin(inference.kendall_w(rows, "model", "feature", "share")).crossJoin(top)


@query()
def stability_refits(spark, sf_dir):
    """200 refits of a forest and of logistic regression on rows drawn inside classes, by permutation importance."""
    return refits.summary(refits.stability(_table(spark, sf_dir), FEATURES))
