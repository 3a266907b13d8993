"""Classifiers and their attributions against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmlens.operators import coalitions, folds, kernel, logistic, models, refits, trees
from alarmlens.plans import ensembles

FEATURES = ["level", "diff", "diff2"]


def points(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.1)).astype(int)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = points()
    rows = [(i, int(y[i]), i % 5, *map(float, x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, "id long, label long, fold long, level double, diff double, diff2 double").repartition(3)


@pytest.mark.parametrize("loads, size, n", [([0] * 5, 3, 7), ([10, 2, 5, 5, 0], 2, 9), ([4, 4, 4, 9, 4], 1, 1), ([100, 0, 0, 0, 0], 7, 50)])
def test_groups_of_one_size_go_to_the_lightest_fold(loads, size, n):
    want, at = [0] * 5, list(loads)
    for _ in range(n):
        k = at.index(min(at))
        want[k] += 1
        at[k] += size
    assert folds.dealt(loads, size, n) == want


def test_folds_are_whole_and_balanced(spark):
    rng = np.random.default_rng(0)
    sizes = [40, 25, 25, *rng.integers(1, 9, 60).tolist()]
    rows = spark.createDataFrame([(f"c{i % 3}", i) for i, n in enumerate(sizes) for _ in range(n)], "channel string, segment long").repartition(4)
    got = {(r.channel, r.segment): r.fold for r in folds.balanced(rows, ["channel", "segment"]).distinct().collect()}
    loads, want = [0] * 5, {}
    for n, g in sorted((-n, (f"c{i % 3}", i)) for i, n in enumerate(sizes)):
        k = loads.index(min(loads))
        want[g], loads[k] = k, loads[k] - n
    assert got == want and max(loads) - min(loads) < 25


def test_logistic_regression_is_at_its_minimum(table):
    rows = logistic.balanced(table.withColumn("part", F.col("fold") % 2), ["part"]).cache()
    for sparse in (False, True):
        for r in logistic.fitted(rows, ["part"], FEATURES, penalty=4.0, sparse=sparse).collect():
            own = rows.where(F.col("part") == r.part).toPandas()
            x = np.column_stack([np.ones(len(own)), own[FEATURES]])
            b = np.array([r["b_0"], *[r[f"b_{f}"] for f in FEATURES]])
            pull = x.T @ (own["w"] * (own["label"] - 1 / (1 + np.exp(-x @ b)))).to_numpy()
            assert abs(pull[0]) < 1e-6
            for j in (1, 2, 3):
                if not sparse:
                    assert abs(pull[j] - 4.0 * b[j]) < 1e-6
                elif b[j]:
                    assert abs(pull[j] - 4.0 * np.sign(b[j])) < 1e-6
                else:
                    assert abs(pull[j]) <= 4.0 + 1e-9


@pytest.mark.parametrize("name", sorted(trees.ENSEMBLES))
def test_ensembles_learn_and_shapley_values_equal_all_coalitions(table, name):
    given = trees.ENSEMBLES[name] | {"trees": 12, "rate": 0.3}
    binned = trees.binned(table.withColumn("part", F.lit(0).cast("long")), trees.edges(table, FEATURES, 16))
    counted = trees.cells(binned, FEATURES)
    model = trees.collected(trees.trained(counted, FEATURES, given))
    again = trees.collected(trees.trained(counted.repartition(7), FEATURES, given))
    assert all((a[c] == b[c]).all() for a, b in zip(model[0], again[0]) for c in a)  # on any partitioning
    rows = trees.scores(binned, FEATURES, model, given).collect()
    assert len(rows) == 240 and np.mean([(r.probability > 0.5) == r.label for r in rows]) > 0.8
    mean = given["kind"] in ("bagged", "random")
    shown = {r.id: r for r in trees.attributions(binned, FEATURES, model, given).collect()}
    some = binned.where("id < 6").orderBy("id").collect()
    bins = np.array([[r[f"b_{f}"] for f in FEATURES] for r in some])
    want = trees.plain_shapley(model[0], bins, mean)
    assert np.allclose([[shown[i][f] for f in FEATURES] for i in range(6)], want)
    assert all(abs(sum(r[f] for f in FEATURES) + r.base - r.margin) < 1e-9 for r in shown.values())


def test_a_tree_takes_the_best_cut_of_all():
    rng = np.random.default_rng(1)
    bins, g, h = rng.integers(0, 9, (80, 3)), rng.normal(size=80), rng.uniform(0.1, 1, 80)
    tree = trees.grow(bins, g, h, 1, penalty=1.0)
    score = lambda on: g[on].sum() ** 2 / (h[on].sum() + 1.0)
    gain = {(f, c): score(bins[:, f] <= c) + score(bins[:, f] > c) for f in range(3) for c in range(8)}
    best = max(gain, key=gain.get)
    assert (tree["feature"][0], tree["cut"][0]) == best
    on = bins[:, best[0]] <= best[1]
    assert np.isclose(tree["value"][1], g[on].sum() / (h[on].sum() + 1)) and np.isclose(tree["cover"][2], h[~on].sum())


def test_bins_and_cells_keep_every_row(table):
    cuts = trees.edges(table, FEATURES, 8)
    rows = trees.binned(table.withColumn("part", F.col("fold")), cuts)
    assert all(r[f"b_{f}"] == sum(c < r[f] for c in cuts[f]) for r in rows.collect() for f in FEATURES)
    assert trees.cells(rows, FEATURES).agg(F.sum("n")).first()[0] == 240


def test_kernel_shap_equals_shapley_values(spark, table):
    train, test = table.where("fold > 0").withColumn("part", F.lit(0).cast("long")), table.where("fold = 0").withColumn("part", F.lit(0).cast("long"))
    model = lambda a, b, c: 1 / (1 + np.exp(-(a * b + 0.5 * c)))
    answer = lambda rows: rows.withColumn("probability", 1 / (1 + F.exp(-(F.col("level") * F.col("diff") + 0.5 * F.col("diff2")))))
    got = coalitions.kernel_shap(test, train, FEATURES, answer, most=7).collect()
    back = [tuple(r[f"o_{f}"] for f in FEATURES) for r in coalitions.background(train, FEATURES, 7).collect()]
    assert len(got) == 48 and len(back) == 7
    given = {r.id: tuple(r[f] for f in FEATURES) for r in test.collect()}
    for r in got[:10]:
        value = lambda known: np.mean([model(*[given[r.id][k] if k in known else o[k] for k in range(3)]) for o in back])
        for i, f in enumerate(FEATURES):
            rest = [k for k in range(3) if k != i]
            want = sum(math.factorial(s) * math.factorial(2 - s) / 6 * (value({*known, i}) - value(set(known))) for s in range(3) for known in itertools.combinations(rest, s))
            assert abs(r[f"phi_{f}"] - want) < 1e-9


def test_waves_approach_the_kernel_and_the_machine_agrees_with_it(spark):
    x, y = points(160, 8)
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    rows = spark.createDataFrame([(0, i, int(y[i]), *map(float, x[i])) for i in range(160)], "part long, id long, label long, level double, diff double, diff2 double")
    waves = kernel.Waves(3, 1 / 3)
    mapped = waves(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 3)
    assert np.abs(mapped @ mapped.T - exact).mean() < 0.06
    machines = kernel.fitted(rows, FEATURES)
    margin = np.array([r.margin for r in rows.withColumn("margin", machines.margin(FEATURES)).orderBy("id").collect()])
    # the same hinge loss with the exact kernel, by coordinate ascent of the dual
    sign, w = 2 * y - 1, np.where(y == 1, 80 / max(y.sum(), 1), 80 / max(160 - y.sum(), 1))
    alpha = np.zeros(160)
    q = (exact + 1) * np.outer(sign, sign)
    for _ in range(300):
        for i in range(160):
            alpha[i] = min(max(alpha[i] + (1 - q[i] @ alpha) / q[i, i], 0.0), w[i])
    dual = (exact + 1) @ (alpha * sign)
    assert np.mean((margin > 0) == (dual > 0)) > 0.93 and np.corrcoef(margin, dual)[0, 1] > 0.93
    answer = kernel.answer(machines, kernel.calibrated(rows, machines, FEATURES), FEATURES)
    chance = np.array([r.probability for r in answer(rows).orderBy("id").collect()])
    assert np.mean((chance > 0.5) == y) > 0.9 and (np.argsort(chance, kind="stable") == np.argsort(margin, kind="stable")).mean() > 0.95


def test_leaderboard_of_known_scores(spark):
    rows = [("a", "f", int(i >= 5), i / 10) for i in range(10)] + [("b", "f", i % 2, 0.5) for i in range(10)]
    got = {r.model: r for r in ensembles.leaderboard(spark.createDataFrame(rows, "model string, family string, label long, probability double")).collect()}
    assert (got["a"].auroc, got["a"].recall, got["a"].false_alarm_rate) == (1.0, 1.0, 0.0)
    assert (got["b"].auroc, got["b"].recall, got["b"].false_alarm_rate) == (0.5, 1.0, 1.0)


def test_scaled_parts_are_standardised_by_their_training_rows(table):
    train, test = models.scaled(table, FEATURES)
    stats = train.groupBy("part").agg(*[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES]).collect()
    assert len(stats) == 5 and test.count() == 240 and all(abs(r[f"m_{f}"]) < 1e-9 and abs(r[f"s_{f}"] - 1) < 1e-9 for r in stats for f in FEATURES)


def test_shuffles_keep_counts():
    rng = np.random.default_rng(2)
    values, n = rng.integers(0, 5, 40), rng.integers(0, 6, 40)
    cell, value, count = refits.shuffled(rng, values, n)
    assert (np.bincount(cell, count, 40) == n).all()
    assert (np.bincount(value, count, 5) == np.bincount(values, n, 5)).all()
    assert refits.auroc(np.array([1, 2, 2, 3.0]), np.array([0, 0, 1, 1]), np.array([2, 1, 1, 3])) == (3 * 3 + 2 + 0.5) / 12


def test_refits_find_what_matters(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    label = (x[:, 1] + 0.3 * rng.normal(size=300) > 0).astype(int)
    rows = spark.createDataFrame([(int(y), *map(float, v)) for y, v in zip(label, x)], "label long, level double, diff double, diff2 double")
    few = refits.stability(rows, FEATURES, 4, refits.FOREST | {"trees": 10})
    each = few.collect()
    assert len(each) == 8 and all(r["diff"] > 0.2 > r.level and r["diff"] > r.diff2 for r in each)
    again = refits.stability(rows.repartition(5), FEATURES, 4, refits.FOREST | {"trees": 10})
    assert sorted(again.collect()) == sorted(each)
    assert {(r.model, r.n_replicates, r.share_differences_first) for r in refits.summary(few).collect()} == {("forest", 4, 1.0), ("logistic", 4, 1.0)}
