"""Classifiers on a table of features, evaluated out of fold by group, and what their decisions rest on.

Closed-form models (Gaussian naive Bayes, a diagonal linear discriminant) are aggregations and expressions; nearest neighbours
come block by block; a small network is MLlib's. Logistic regression, trees, kernel machines and sequence networks have their own modules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.functions.random import uniform
from alarmlens.operators import inference

FOLDS, NEIGHBOURS, BLOCK = 5, 15, 4096
SMOOTHING = 1e-9
#: Fixed values of the method: layers and passes of a network that is registered, but kept out of leaderboards.
EXCLUDED = {"mlp_shallow": ("network", lambda: MultilayerPerceptronClassifier(layers=[3, 16, 8, 2], maxIter=60, seed=42))}


def _each_fold(rows: DataFrame, folds: int) -> DataFrame:
    """Every row once for each fold that it is trained on (held = false), and once for its own."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long")))).withColumn("held", F.col("fold") == F.col("part"))


def naive_bayes(rows: DataFrame, features: list[str], folds: int = FOLDS) -> DataFrame:
    """rows (label, fold, features) with probability: Gaussian naive Bayes fitted on the other folds. Moments are few rows a fold."""
    trained = _each_fold(rows, folds).where("NOT held")
    stats = trained.groupBy("part").agg(
        F.avg(F.col("label").cast("double")).alias("share"),
        *[f(F.when(F.col("label") == y, F.col(x))).alias(f"{x}_{n}{y}") for x in features for y in (0, 1) for n, f in (("m", F.avg), ("v", F.var_pop))],
    )
    score = F.ln(F.col("share")) - F.ln(1 - F.col("share"))
    for x in features:
        for y, sign in ((1, 1.0), (0, -1.0)):
            v = F.col(f"{x}_v{y}") + SMOOTHING
            score = score - sign * 0.5 * (F.ln(v) + (F.col(x) - F.col(f"{x}_m{y}")) * (F.col(x) - F.col(f"{x}_m{y}")) / v)
    return rows.join(stats, rows["fold"] == stats["part"]).withColumn("probability", 1 / (1 + F.exp(-score))).select(*rows.columns, "probability")


def discriminant(rows: DataFrame, features: list[str], by: list[str], weight: str | None = None) -> DataFrame:
    """(by, coefficients): the difference of class means over the mean of class variances, by feature; a diagonal linear discriminant."""
    w = F.col(weight) if weight else F.lit(1.0)
    out = []
    for x in features:
        side = {}
        for y in (0, 1):
            on = F.when(F.col("label") == y, w)
            n, s, q = F.sum(on), F.sum(on * F.col(x)), F.sum(on * F.col(x) * F.col(x))
            side[y] = s / n, q / n - s * s / (n * n)
        out.append(F.when((side[0][1] + side[1][1]) > 0, (side[1][0] - side[0][0]) / ((side[0][1] + side[1][1]) / 2)).alias(f"b_{x}"))
    return rows.groupBy(*by).agg(*out)


def attributions(rows: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """(by, method, feature, share) of the discriminant: linear SHAP, |coefficient| times the mean distance from the mean, and integrated gradients from a zero baseline, which for a linear score is |coefficient times value|."""
    model = discriminant(rows, features, by)
    means = rows.groupBy(*by).agg(*[F.avg(x).alias(f"m_{x}") for x in features])
    each = rows.join(model, by).join(means, by)
    shap = [F.avg(F.abs(F.col(f"b_{x}") * (F.col(x) - F.col(f"m_{x}")))).alias(f"shap_{x}") for x in features]
    gradients = [F.avg(F.abs(F.col(f"b_{x}") * F.col(x))).alias(f"gradients_{x}") for x in features]
    wide = each.groupBy(*by).agg(*shap, *gradients)
    return shares(wide, features, by, ["shap", "gradients"])


def shares(wide: DataFrame, features: list[str], by: list[str], methods: list[str]) -> DataFrame:
    """Non-negative importances to shares of their sum; equal ones where all are zero."""
    parts = []
    for m in methods:
        total = sum((F.greatest(F.col(f"{m}_{x}"), F.lit(0.0)) for x in features[1:]), F.greatest(F.col(f"{m}_{features[0]}"), F.lit(0.0)))
        parts += [F.struct(F.lit(m).alias("method"), F.lit(x).alias("feature"), F.coalesce(F.try_divide(F.greatest(F.col(f"{m}_{x}"), F.lit(0.0)), total), F.lit(1.0 / len(features))).alias("share")) for x in features]
    return wide.select(*by, F.inline(F.array(*parts)))


def permutation_importance(rows: DataFrame, features: list[str], key: list[str], repeats: int) -> DataFrame:
    """(feature, drop, share): the mean loss of AUROC where one feature's values are dealt anew over all rows.

    Rows meet the shuffled values by number: place in order of their key, and place in order of a random number.
    """
    model = discriminant(rows.withColumn("all", F.lit(1)), features, ["all"]).drop("all")
    order = Window.partitionBy()
    numbered = rows.withColumn("number", F.row_number().over(order.orderBy(*key))).join(F.broadcast(model))
    score = lambda swapped: sum((F.col(f"b_{x}") * F.col("new" if x == swapped else x) for x in features[1:]), F.col(f"b_{features[0]}") * F.col("new" if features[0] == swapped else features[0]))
    positive = F.col("label") == 1
    whole = inference.auroc(numbered.select(score(None).alias("s"), positive.alias("pos")), [], "s", "pos").select(F.col("auroc").alias("whole"))
    reps = F.explode(F.sequence(F.lit(1), F.lit(repeats)))
    scored = None
    for x in features:
        dealt = numbered.select(F.col(x).alias("new"), *key, reps.alias("rep"))
        dealt = dealt.select("rep", "new", F.row_number().over(Window.partitionBy("rep").orderBy(uniform(f"shuffle-{x}", "rep", *key), *key)).alias("number"))
        part = numbered.join(dealt, "number").select(F.lit(x).alias("feature"), "rep", score(x).alias("s"), positive.alias("pos"))
        scored = part if scored is None else scored.unionByName(part)
    drops = inference.auroc(scored, ["feature", "rep"], "s", "pos").join(F.broadcast(whole)).groupBy("feature").agg(F.greatest(F.avg(F.col("whole") - F.col("auroc")), F.lit(0.0)).alias("drop"))
    total = F.sum("drop").over(Window.partitionBy())
    return drops.withColumn("share", F.when(total > 0, F.col("drop") / total).otherwise(1.0 / len(features)))


def neighbours(points: DataFrame, queries: DataFrame, features: list[str], k: int = NEIGHBOURS, by: str = "part") -> DataFrame:
    """queries (id, by, features) with probability: the share of label 1 among the k nearest points of their part, ties by the points' id.

    Points are gathered into blocks of bounded size, and every query meets each block of its part; a block sends its k best, and
    these are merged. A task holds one block and a batch of queries.
    """
    blocks = points.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(by).orderBy("id")) - 1) / BLOCK)).groupBy(by, "block").agg(F.sort_array(F.collect_list(F.struct("id", *features, "label"))).alias("members"))
    met = queries.select("id", by, *features).join(blocks, by).select("id", by, *features, "members")
    n = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, best = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            at = np.array([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(n)]).T
            for i, members in enumerate(batch.column(2 + n)):
                inner = members.values
                x = np.array([inner.field(f).to_numpy(zero_copy_only=False) for f in features]).T
                d = ((x - at[i]) ** 2).sum(axis=1)
                names, y = inner.field("id").to_numpy(zero_copy_only=False), inner.field("label").to_numpy(zero_copy_only=False)
                near = np.lexsort((names, d))[:k]
                best.append([{"d": float(d[j]), "id": int(names[j]), "label": int(y[j])} for j in near])
            yield pa.RecordBatch.from_pydict({"id": ids, by: parts, "best": best}, schema=pa.schema([("id", pa.int64()), (by, pa.int64()), ("best", pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64()), ("label", pa.int64())])))]))

    found = met.mapInArrow(run, f"id long, {by} long, best array<struct<d:double,id:long,label:long>>")
    merged = found.groupBy("id", by).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return merged.select("id", by, F.expr("aggregate(best, 0D, (s, x) -> s + x.label) / size(best)").alias("probability"))


def scaled(rows: DataFrame, features: list[str], folds: int = FOLDS) -> tuple[DataFrame, DataFrame]:
    """Training rows and held-out rows of each part, standardised by the training rows' mean and population deviation."""
    every = _each_fold(rows, folds)
    stats = every.where("NOT held").groupBy("part").agg(*[f(x).alias(f"{n}_{x}") for x in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = every.join(stats, "part").select("id", "label", "part", "held", *[F.when(F.col(f"s_{x}") > 0, (F.col(x) - F.col(f"m_{x}")) / F.col(f"s_{x}")).otherwise(0.0).alias(x) for x in features])
    return z.where("NOT held"), z.where("held")


def out_of_fold(rows: DataFrame, features: list[str], name: str, folds: int = FOLDS) -> DataFrame:
    """(id, label, probability) by one of EXCLUDED, each fold scored by a model of the others."""
    make = EXCLUDED[name][1]
    vectors = VectorAssembler(inputCols=features, outputCol="raw").transform(rows)
    out = None
    for fold in range(folds):
        train, test = vectors.where(F.col("fold") != fold), vectors.where(F.col("fold") == fold)
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
        model = make().fit(scaler.transform(train))
        part = model.transform(scaler.transform(test)).select("id", "label", vector_to_array("probability")[1].alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out


def importance_pivot(importance: DataFrame, features: list[str]) -> DataFrame:
    return importance.groupBy("model", "family").pivot("feature", features).agg(F.avg("share"))


def family_summary(wide: DataFrame) -> DataFrame:
    """Mean shares by family, and whether both differences together beat the level."""
    rows = wide.groupBy("family").agg(F.count(F.lit(1)).alias("n_models"), *[F.avg(x).alias(f"mean_{x}") for x in ("level", "diff", "diff2")])
    return rows.withColumn("differences_beat_level", F.col("mean_diff") + F.col("mean_diff2") > F.col("mean_level"))
