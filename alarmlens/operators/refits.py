"""How stable importances are: models trained again on rows drawn anew inside each class, all replicates in one job.

A replicate is one task. It holds the cells of the training table (see trees.py), of which there is a bounded number, and draws how often
each occurs; shuffles deal a feature's bins to cells by counts as well. So no task holds rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.operators import trees

REPLICATES, SHUFFLES = 200, 10
FOREST = trees.ENSEMBLES["random_forest"] | {"trees": 200}
STEPS, PENALTY = 10, 1.0


def auroc(score: np.ndarray, label: np.ndarray, n: np.ndarray) -> float:
    """Of counted rows; ties count half."""
    at = np.unique(np.round(score, 9), return_inverse=True)[1]
    p, q = (np.bincount(at, n * on, at.max() + 1) for on in (label == 1, label != 1))
    return float((p * (np.cumsum(q) - q / 2)).sum() / (p.sum() * q.sum()))


def shuffled(rng: np.random.Generator, values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, value, count) after the counted rows' values were dealt anew: each cell draws its count from what is left."""
    kinds, at = np.unique(values, return_inverse=True)
    left = np.bincount(at, n, len(kinds)).astype(np.int64)
    cells, dealt, counts = [], [], []
    for k, size in enumerate(n.astype(np.int64).tolist()):
        if size:
            got = rng.multivariate_hypergeometric(left, size)
            left -= got
            on = np.flatnonzero(got)
            cells.append(np.full(len(on), k))
            dealt.append(kinds[on])
            counts.append(got[on])
    return np.concatenate(cells), np.concatenate(dealt), np.concatenate(counts)


def importance(rng: np.random.Generator, score, x: np.ndarray, label: np.ndarray, n: np.ndarray, repeats: int = SHUFFLES) -> np.ndarray:
    """Mean loss of AUROC for each feature, 0 at least."""
    whole = auroc(score(x), label, n)
    out = []
    for f in range(x.shape[1]):
        drops = []
        for _ in range(repeats):
            cell, value, count = shuffled(rng, x[:, f], n)
            other = x[cell].copy()
            other[:, f] = value
            drops.append(whole - auroc(score(other), label[cell], count))
        out.append(max(float(np.mean(drops)), 0.0))
    return np.array(out)


def logistic(x: np.ndarray, label: np.ndarray, n: np.ndarray):
    """A score by logistic regression on counted rows, standardised, classes weighing alike."""
    mean = (n[:, None] * x).sum(axis=0) / n.sum()
    spread = np.sqrt((n[:, None] * (x - mean) ** 2).sum(axis=0) / n.sum())
    scale = lambda v: np.column_stack([np.ones(len(v)), np.divide(v - mean, spread, out=np.zeros_like(v), where=spread > 0)])
    z, b = scale(x), np.zeros(x.shape[1] + 1)
    w = n * np.where(label == 1, n.sum() / (2 * n[label == 1].sum()), n.sum() / (2 * n[label != 1].sum()))
    ridge = PENALTY * (np.arange(len(b)) > 0)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-12), z.T @ (w * (label == 1) - w * p) - ridge * b)
    return lambda v: scale(v) @ b


def stability(rows: DataFrame, features: list[str], replicates: int = REPLICATES, forest: dict = FOREST) -> DataFrame:
    """(model, rep, features): each replicate's importances by a forest and by logistic regression (on the cells' means), of rows (label, features)."""
    table = trees.binned(rows, trees.edges(rows, features))
    names = [f"b_{x}" for x in features]
    counted = table.groupBy("label", *names).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in features])
    schema = pa.schema([("model", pa.string()), ("rep", pa.int32()), *[(x, pa.float64()) for x in features]])

    def run(key: tuple, cells: pa.Table) -> pa.Table:
        rep = key[0].as_py()
        cells = cells.sort_by([(c, "ascending") for c in [*names, "label"]])
        bins, means = (np.stack([cells[c].to_numpy() for c in columns], axis=1) for columns in (names, features))
        bins, label, given, rng = bins.astype(int), cells["label"].to_numpy(), cells["n"].to_numpy(), np.random.default_rng([42, rep])
        n = np.zeros(len(given), np.int64)
        for y in (0, 1):
            on = label == y
            if on.any():
                n[on] = rng.multinomial(given[on].sum(), given[on] / given[on].sum())
        on = n > 0
        bins, means, label, n = bins[on], means[on], label[on], n[on]
        if len(np.unique(label)) < 2:
            return schema.empty_table()
        grown = [trees._forest_tree(bins, label, n, rep, t, forest) for t in range(forest["trees"])]
        found = [("forest", importance(rng, lambda v: trees.margins(grown, v, True), bins, label, n)), ("logistic", importance(rng, logistic(means, label, n), means, label, n))]
        return pa.table([[name for name, _ in found], [rep] * 2, *[[float(v[k]) for _, v in found] for k in range(len(features))]], schema=schema)

    # few bytes a replicate, but much work: a fixed number of tasks, which isn't made smaller by their size
    tasks = min(replicates, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    dealt = counted.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).repartition(tasks, "rep")
    return dealt.groupBy("rep").applyInArrow(run, "model string, rep int, " + ", ".join(f"{x} double" for x in features))


def summary(replicates: DataFrame) -> DataFrame:
    """(model, n_replicates, share_differences_first, mean_level_share): how often both differences together outweigh the level."""
    total = F.col("level") + F.col("diff") + F.col("diff2")
    first = F.avg((F.col("diff") + F.col("diff2") > F.col("level")).cast("double"))
    return replicates.groupBy("model").agg(F.count(F.lit(1)).alias("n_replicates"), first.alias("share_differences_first"), F.avg(F.coalesce(F.try_divide(F.col("level"), total), F.lit(1 / 3))).alias("mean_level_share"))
