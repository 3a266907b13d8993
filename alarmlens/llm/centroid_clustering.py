"""Centroid clustering (operator 11).

Each task builds metric trees over the vectors that it reads. A node is a ball: its centre, radius, count and integer sum of
vectors. In a round, a ball whose nearest centroid is nearer than any other by more than its diameter is assigned whole, from its
sum; any other ball is opened, down to leaves whose vectors are compared one by one. Trees are built once, and saved; a round sends
centroids out and brings sums of one row a centroid and component back, so nothing is shuffled but these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common

COMPONENTS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024.0, 8, 10, 3
#: Vectors of one tree, and of a leaf.
TREE_VECTORS, LEAF_VECTORS = 8192, 32
#: Up to so large an integer, sums of a tree and distances are exact in doubles; other vectors take Python's integers, without balls.
NARROW = 2**22
#: Integers up to this are representable as long; a vector with a larger one has no integers, as if it were not finite.
WIDEST = 2.0**63
LONG = 2**63
TREE_SCHEMA = "ids array<long>, vectors array<double>, narrow boolean, first array<int>, last array<int>, child array<int>, radius array<double>, centre array<double>, total array<double>"


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, components: int = COMPONENTS) -> DataFrame:
    """(id, v): vectors that have all components, none null or non-finite, as doubles of whole numbers, floor(1024 * x)."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double") * SCALE)
    rows = df.where(F.size(vec_col) == components).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.where(F.forall("v", lambda x: F.coalesce(F.abs(x) < WIDEST, F.lit(False))))  # NaN is larger than any


def _floors(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(values).reshape(len(column), -1)


def ball_tree(x: np.ndarray) -> tuple[np.ndarray, dict]:
    """The order of x's rows in which each node holds neighbouring rows, and the nodes, parents first.

    A node's two children hold the halves of its rows along the line between two rows far apart. centre is the floored mean, radius
    the distance of the farthest row from it, child the first child (the second follows it) or -1 for a leaf.
    """
    order = np.arange(len(x))
    first, last, child, radius, centre, total = [0], [len(x)], [], [], [], []
    at = 0
    while at < len(first):
        a, b = first[at], last[at]
        rows = x[order[a:b]]
        sums = rows.sum(axis=0)
        middle = np.floor(sums / (b - a))
        away = ((rows - middle) ** 2).sum(axis=1)
        total.append(sums)
        centre.append(middle)
        radius.append(float(np.sqrt(away.max())))
        if b - a <= LEAF_VECTORS or (rows == rows[0]).all():
            child.append(-1)
        else:
            one = rows[away.argmax()]
            other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows @ (other - one), half)]
            child.append(len(first))
            first += [a, a + half]
            last += [a + half, b]
        at += 1
    return order, {"first": first, "last": last, "child": child, "radius": radius, "centre": np.concatenate(centre), "total": np.concatenate(total)}


def trees(vectors: DataFrame) -> DataFrame:
    """Metric trees over (id, v), of at most TREE_VECTORS rows of one task each. Nothing is shuffled."""
    schema = to_arrow_schema(T.StructType.fromDDL(TREE_SCHEMA))

    def tree(ids: list, x: np.ndarray, narrow: bool) -> dict:
        if narrow:
            order, nodes = ball_tree(x)
            ids, x = [ids[i] for i in order.tolist()], x[order]
        else:  # a single leaf, whose ball decides nothing
            nodes = {"first": [0], "last": [len(x)], "child": [-1], "radius": [float("inf")], "centre": np.zeros(x.shape[1]), "total": np.zeros(x.shape[1])}
        return {"ids": ids, "vectors": x.ravel(), "narrow": narrow, **nodes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple[list, list]] = {True: ([], []), False: ([], [])}

        def made(narrow: bool) -> pa.RecordBatch:
            ids, parts = held[narrow]
            x = np.concatenate(parts)
            got = tree(ids[:TREE_VECTORS], x[:TREE_VECTORS], narrow)
            held[narrow] = ids[TREE_VECTORS:], [x[TREE_VECTORS:]]
            return pa.RecordBatch.from_arrays([pa.array([got[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _floors(batch.column(1)), np.array(batch.column(0).to_pylist(), dtype=object)
            small = (np.abs(x) <= NARROW).all(axis=1)
            for narrow, on in ((True, small), (False, ~small)):
                if on.any():
                    held[narrow][0].extend(ids[on].tolist())
                    held[narrow][1].append(x[on])
                    while len(held[narrow][0]) >= TREE_VECTORS:
                        yield made(narrow)
        for narrow in held:
            if held[narrow][0]:
                yield made(narrow)

    return vectors.select("id", "v").mapInArrow(run, TREE_SCHEMA)


class Tree:
    def __init__(self, batch: pa.RecordBatch, at: int):
        get = lambda name: common.column(batch, name)[at].values
        self.ids = get("ids")
        self.narrow = common.column(batch, "narrow")[at].as_py()
        self.first, self.last, self.child, self.radius = (get(n).to_numpy() for n in ("first", "last", "child", "radius"))
        self.x = get("vectors").to_numpy().reshape(len(self.ids), -1)
        self.centre, self.total = (get(n).to_numpy().reshape(len(self.first), -1) for n in ("centre", "total"))

    def assigned(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A centroid for each node that is assigned whole (else -1), one for each row that isn't in such a node (else -1), and rows of these."""
        node_of, row_of = np.full(len(self.first), -1), np.full(len(self.x), -1)
        front = np.zeros(1, dtype=int)
        leaves = []
        if self.narrow and _narrow(centroids):
            c = np.array(centroids, dtype=float)
            while len(front):
                d = np.sqrt(_squares(self.centre[front], c))
                near = d.argmin(axis=1)
                least = d[np.arange(len(front)), near]
                d[np.arange(len(front)), near] = np.inf
                # for a row of the ball, no centroid can be as near as this one: d(row, other) >= d(centre, other) - r > d(centre, near) + r
                whole = d.min(axis=1) > (least + 2 * self.radius[front]) * (1 + 1e-9) + 1e-6
                node_of[front[whole]] = near[whole]
                opened = front[~whole]
                below = self.child[opened]
                leaves.append(opened[below < 0])
                below = below[below >= 0]
                front = np.concatenate([below, below + 1])
            leaves = np.concatenate(leaves)
        else:
            leaves = np.flatnonzero(self.child < 0)
        rows = np.concatenate([np.arange(self.first[i], self.last[i]) for i in leaves.tolist()] or [np.zeros(0, dtype=int)])
        if len(rows):
            row_of[rows] = distances(self.x[rows], centroids).argmin(axis=1)
        return node_of, row_of, rows


def _narrow(centroids: list[list[int]]) -> bool:
    return all(-NARROW <= x <= NARROW for c in centroids for x in c)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole numbers up to NARROW, exact: every intermediate value is below 2^53."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def _integers(x: np.ndarray) -> np.ndarray:
    """Rows of whole doubles as Python's integers."""
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances; the first smallest of a row is its centroid."""
    if _narrow(centroids) and (np.abs(x) <= NARROW).all():
        return _squares(x, np.array(centroids, dtype=float))
    rows = _integers(x)
    return np.stack([((rows - np.array(c, dtype=object)) ** 2).sum(axis=1) for c in centroids], axis=1)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield Tree(batch, at)


def sums(forest: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(cluster, place, n, total): count and sum of each component of the vectors nearest to each centroid. A task sends one row for each of these."""
    schema = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * len(centroids)
        total = [[0] * len(centroids[0]) for _ in centroids]
        for tree in _each(batches):
            nodes, rows, open_rows = tree.assigned(centroids)
            for k in range(len(centroids)):
                balls, single = nodes == k, open_rows[rows[open_rows] == k]
                n[k] += int((tree.last - tree.first)[balls].sum()) + len(single)
                parts = [tree.total[balls].sum(axis=0)] if balls.any() else []
                if len(single):
                    parts.append(tree.x[single].sum(axis=0) if tree.narrow else _integers(tree.x[single]).sum(axis=0))
                for part in parts:
                    total[k] = [a + int(b) for a, b in zip(total[k], part.tolist())]
        rows_out = [(k, j, n[k], Decimal(v)) for k in range(len(centroids)) for j, v in enumerate(total[k]) if n[k]]
        if rows_out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows_out), schema)], schema=schema)

    each = forest.mapInArrow(run, "cluster int, place int, n long, total decimal(38,0)")
    return each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def labels(forest: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance): every vector's centroid, and its squared distance, null where it isn't representable as long."""
    schema = pa.schema([("id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _each(batches):
            nodes, of, _ = tree.assigned(centroids)
            for i in np.flatnonzero(nodes >= 0).tolist():
                of[tree.first[i] : tree.last[i]] = nodes[i]
            far = np.empty(len(of), dtype=object)
            for k in np.unique(of).tolist():
                far[of == k] = [int(v) for v in distances(tree.x[of == k], [centroids[k]])[:, 0].tolist()]
            yield pa.RecordBatch.from_arrays([tree.ids.cast(pa.int64()), pa.array(of, pa.int32()), pa.array([v if v < LONG else None for v in far.tolist()], pa.int64())], schema=schema)

    return forest.mapInArrow(run, "id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the k smallest sha256 of `seed:id`. Repeated ids are taken in order of their vectors; rows without an id come last."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(name.alias("name"), F.transform("v", lambda x: F.floor(x)).alias("v")).orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()
    return [[int(x) for x in r["v"]] for r in rows]


def cluster(df: DataFrame, id_col: str, vec_col: str, components: int = COMPONENTS, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every whole vector after the given rounds, and the centroids' integers.

    Vectors of another length, null ones, and those with null or non-finite components, or components of 2^53 or more, are left out.
    Repeated rows count as often as they occur; equal distances go to the smaller number. A table without whole vectors gives no
    rows; one of fewer than k gives as many centroids as it has. Ids may be null or repeated. Other columns are not read.
    """
    vectors = whole_vectors(df, id_col, vec_col, components)
    forest = common.saved(trees(vectors))
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        moved = [list(c) for c in centroids]
        for r in sums(forest, centroids).collect():  # k rows of each component
            moved[r["cluster"]][r["place"]] = int(r["total"]) // r["n"]
        if moved == centroids:  # later rounds would give the same
            break
        centroids = moved
    out = common.saved(labels(forest, centroids) if centroids else df.sparkSession.createDataFrame([], "id long, cluster int, distance long"))
    common.dropped(forest)
    return out, centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector of embeddings with its cluster, distance, the sums of these over its cluster and over all, and its centroid's hash.

    A sum is null where it, or a distance in it, isn't representable as long. For rows that are left out, see cluster().
    """
    rows, centroids = cluster(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    stats = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count(F.when(F.col("distance").isNull(), 1)).alias("open")).collect()  # one row a centroid
    known = lambda d: None if any(r["open"] for r in d) or sum(int(r["d"]) for r in d) >= LONG else sum(int(r["d"]) for r in d)
    by = {r["cluster"]: known([r]) for r in stats}
    lines = [(i, by.get(i), known(stats), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    about = spark.createDataFrame(lines, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.withColumnRenamed("id", "vec_id").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Rounds as one step after the other: distances by component, the nearest, and floored means."""
    steps = [f"""e AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}),
x AS MATERIALIZED (SELECT row, unnest(range(0, {COMPONENTS})) AS j, unnest(v) AS x FROM e),
c0 AS MATERIALIZED (SELECT cluster, unnest(range(0, {COMPONENTS})) AS j, unnest(v) AS c FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS cluster, v FROM e) WHERE cluster < {CLUSTERS})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT row, arg_min(cluster, d * {CLUSTERS} + cluster) AS cluster, min(d) AS distance FROM (SELECT row, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM x JOIN c{i} USING (j) GROUP BY row, cluster) GROUP BY row)""")
        if i < ROUNDS:
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.cluster, o.j, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT cluster, j, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM x JOIN a{i} USING (row) GROUP BY cluster, j) m ON o.cluster = m.cluster AND o.j = m.j)")
    return f"""WITH {', '.join(steps)}, h AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{ROUNDS} a JOIN e USING (row) JOIN h ON h.cluster = a.cluster"""


ORACLE = _oracle()
