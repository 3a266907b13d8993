"""Near-duplicate documents by a chosen-path set-similarity join (operator 2).

A document is its set of word shingles. In each of several independent trees, documents branch by their minwise shingle
under the tree's hash function of that depth, so that documents of similarity J stay together with probability J at each
branching. A node that is small enough for one task is compared exhaustively; a larger one branches again, and one that is
still large at the last depth is compared block by block. Exact copies are one vertex from the start, and documents that
earlier trees have connected aren't compared again, so that later trees meet only what is still apart. Sketches (the same
minwise values) leave out pairs far below the threshold; each link is confirmed on the full sets.

A vertex is a set of shingles, whatever the ids of its rows: it is named by the number of one of them. Its text is found again by a
hash of id and text, and known by its digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

SHINGLE = 5
#: Trees by round. With 12 trees, two documents of similarity 0.8 meet but for 0.2 ** 12.
ROUNDS = (1, 3, 8)
DEPTH = 4
#: A node of at most so many documents and shingles goes to one task.
MOST_DOCS = 2048
MOST_SHINGLES = 2_000_000
#: Pairs whose sketches agree in a smaller share than this are left out: over five deviations below 0.8.
SKETCH_LEAST = 0.5
#: A list of documents to fetch that is at most so long (24 bytes a row) is sent to all tasks.
BROADCAST_ROWS = 100_000

MULTIPLIERS = np.random.default_rng(20).integers(1 << 60, 1 << 63, 64, np.uint64) | np.uint64(1)
SALTS = np.random.default_rng(21).integers(0, 1 << 63, sum(ROUNDS) * DEPTH, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; of a shorter text its whole sequence, of one without words none."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = mixed(total * MULTIPLIERS[i] + codes[i : n - width + 1 + i])
    return np.unique(total)


def minwise(found: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each function (upper 32 bits)."""
    out = np.empty(len(SALTS), np.uint64)
    for at in range(0, len(SALTS), 8):
        mix = (found[None, :] ^ SALTS[at : at + 8, None]) * MULTIPLIERS[at : at + 8, None]
        out[at : at + 8] = (mix ^ (mix >> np.uint64(32))).min(axis=1)
    return (out >> np.uint64(16)).astype(np.uint32).view(np.int32)


def digest(found: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _text_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def sketched(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row (tells rows apart), a hash of id and text, n_shingles, two longs that stand for the set, and its minwise values."""

    def make():
        def fn(keys, rows, text_keys, texts):
            out = [[] for _ in range(4)]
            for text in common.as_bytes(texts):
                found = shingles(text, size)
                row = len(found), *digest(found), minwise(found).tobytes() if len(found) else None
                for values, x in zip(out, row):
                    values.append(x)
            return keys, rows, text_keys, *out

        return fn

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), _text_key().alias("text_key"), "text"]
    return common.map_columns(docs, columns, make, "doc_id long, row long, text_key long, n_shingles long, d1 long, d2 long, sketch binary")


def _alike(members: pa.Table, percent: int) -> dict | None:
    """A node's members in groups that their sketches and sizes may link across components; a group is named by its members.

    The same group mostly comes from several trees; it is compared once.
    """
    component = np.asarray(members["component"])
    m = len(component)
    if m < 2 or (component == component[0]).all():
        return None
    sketch = np.frombuffer(b"".join(members["sketch"].to_pylist()), np.int32).reshape(m, -1)
    sizes, ids = np.asarray(members["n_shingles"]), np.asarray(members["rep"])
    group = np.arange(m)
    for i in range(m - 1):
        near = component[i + 1 :] != component[i]
        near &= 100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])
        if not near.any():
            continue
        near &= (sketch[i + 1 :] == sketch[i]).mean(axis=1) >= SKETCH_LEAST
        if near.any():
            group[np.isin(group, np.unique(group[np.concatenate([[i], i + 1 + np.flatnonzero(near)])]))] = group[i]
    out = [[], []]
    for g in np.flatnonzero(np.bincount(group) > 1):
        at = np.flatnonzero(group == g)
        out[0].append(at)
        out[1].append(np.full(len(at), xxhash.xxh3_64_intdigest(np.unique(ids[at]).tobytes()), np.uint64).view(np.int64))
    if not out[0]:
        return None
    at = np.concatenate(out[0])
    return {"node": np.concatenate(out[1])} | {c: members[c].take(at).combine_chunks() for c in ("rep", "component", "d1", "text_key")}


def joined_sets(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect a node's members as far as their full sets allow, as stars around each smallest id.

    A member is compared with all others at once, through the shingles' postings. Members of what has become the largest
    component need not be compared with each other: a link to anything outside is found from there.
    """
    m = len(ids)
    root = np.unique(component, return_inverse=True)[1]
    lengths = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), lengths)
    order = np.argsort(flat, kind="stable")
    where = np.empty(len(flat), np.int64)
    first = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
    size = np.diff(np.concatenate([first, [len(flat)]]))
    where[order] = np.repeat(np.arange(len(first)), size)
    posted = owner[order]
    ends = np.cumsum(lengths)
    central = np.add.reduceat(size[where], ends - lengths) / lengths
    waiting = np.argsort(-central, kind="stable").tolist()
    before = root.copy()
    while waiting:
        counts = np.bincount(root)
        if counts.max() == m:
            break
        largest = counts.argmax() if counts.max() > 1 else -1
        i = next((x for x in waiting if root[x] != largest), None)
        if i is None:
            break
        waiting.remove(i)
        mine = where[ends[i] - lengths[i] : ends[i]]
        n = size[mine]
        n_all = int(n.sum())
        at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n_all)
        shared = np.bincount(posted[at], minlength=m)
        linked = 100 * shared >= percent * (lengths + lengths[i] - shared)
        linked[i] = True
        root[np.isin(root, np.unique(root[linked]))] = root[i]
    out = []
    for r in np.unique(root):
        group = np.flatnonzero(root == r)
        if len(np.unique(before[group])) > 1:
            least = int(ids[group].min())
            out += [(int(x), least) for x in ids[group] if x != least]
    return out


def _nodes(reps: DataFrame, trees: range) -> tuple[DataFrame, list[DataFrame]]:
    """(node, rep, component) of the nodes that one task can compare, for these trees, and the saved tables that this reads."""
    spread = reps.select("rep", "component", "n_shingles", "d1", "text_key", "sketch", F.explode(F.array(*map(F.lit, trees))).alias("tree"))
    paths = [F.xxhash64("tree", F.substring("sketch", 4 * DEPTH * F.col("tree") + 1, F.lit(4 * (d + 1)))).alias(f"k{d}") for d in range(DEPTH)]
    open_ = spread.select("rep", "component", "n_shingles", "d1", "text_key", *paths)
    done, tables = [], []
    # the tables of large nodes are kept until the links are found: every part of the union reads one
    for d in range(DEPTH):
        sizes = (
            open_.groupBy(f"k{d}")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"), F.min("component").alias("c0"), F.max("component").alias("c1"))
            .where("n > 1 AND c0 <> c1")
            .select(f"k{d}", "n", "weight")
        )
        open_ = common.saved(open_.join(sizes, f"k{d}").select("rep", "component", "n_shingles", "d1", "text_key", *[f"k{x}" for x in range(d, DEPTH)], "n", "weight"))
        tables.append(open_)
        small = f"n <= {MOST_DOCS} AND weight <= {MOST_SHINGLES}"
        done.append(open_.where(small).select(F.col(f"k{d}").alias("node"), "rep", "component", "d1", "text_key"))
        open_ = open_.where(f"NOT ({small})")
        if d + 1 < DEPTH:
            open_ = open_.drop("n", "weight", f"k{d}")
            if not open_.take(1):
                return _union(done), tables
    # still large at the last depth: every pair of blocks is a node
    blocks = F.ceil(F.greatest(F.col("n") / (MOST_DOCS // 2), F.col("weight") / (MOST_SHINGLES // 2))).cast("int")
    cut = open_.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    done.append(cut.select(F.xxhash64(f"k{DEPTH - 1}", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rep", "component", "d1", "text_key"))
    return _union(done), tables


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _links(docs: DataFrame, reps: DataFrame, trees: range, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between vertices that these trees bring together."""
    nodes, tables = _nodes(reps, trees)
    placed = nodes.join(reps.select("rep", "n_shingles", "sketch"), "rep")
    near = common.map_groups(placed, "node", lambda members: _alike(members, percent), "node long, rep long, component long, d1 long, text_key long")
    near = common.saved(near.dropDuplicates(["node", "rep"]))
    common.dropped(*tables)
    wanted = near.groupBy("rep", "d1", "text_key").agg(F.collect_list(F.struct("node", "component")).alias("places"))
    if near.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select(_text_key().alias("text_key"), "text").join(wanted, "text_key")

    def make():
        def fn(keys, texts, d1, places):
            out = [[] for _ in range(4)]
            for key, text, want, at in zip(keys.to_pylist(), common.as_bytes(texts), d1.to_pylist(), places.to_pylist()):
                found = shingles(text, size)
                if digest(found)[0] == want:  # else another text of the same hash
                    for place in at:
                        for values, x in zip(out, (place["node"], key, place["component"], found.tobytes())):
                            values.append(x)
            return out

        return fn

    sets = common.map_columns(texts, ["rep", "text", "d1", "places"], make, "node long, rep long, component long, found binary", rows=128)

    def compare(members: pa.Table) -> dict | None:
        ids, at = np.unique(np.asarray(members["rep"]), return_index=True)
        if len(ids) < 2:
            return None
        found = members["found"].take(at).to_pylist()
        pairs = joined_sets(ids, np.asarray(members["component"])[at], [np.frombuffer(x, np.uint64) for x in found], percent)
        return {"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]} if pairs else None

    links = common.saved(common.map_groups(sets, "node", compare, "a long, b long"))
    common.dropped(near)
    return links


def _grouped(docs: DataFrame, size: int, percent: int, rounds: tuple) -> tuple[DataFrame, DataFrame]:
    """The saved sketches of docs, and (d1, d2, copies, component_id, head) for each set of shingles: head is the row that stands for its group."""
    sketches = common.saved(sketched(docs, size))
    key = ["d1", "d2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "text_key"))
    classes = sketches.where("n_shingles > 0").groupBy(*key).agg(first.alias("head"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = common.saved(classes.withColumn("rep", F.col("head.row")))
    reps = classes.select("rep", "d1", "n_shingles", "sketch", F.col("head.text_key").alias("text_key"))
    labels, links, done = reps.withColumn("component", F.col("rep")), [], 0
    found = None
    for trees in rounds:
        links.append(_links(docs, labels, range(done, done + trees), size, percent))
        done += trees
        if found is not None:
            common.dropped(found)
        found = common.saved(components(_union(links)).withColumnRenamed("id", "rep"))
        labels = reps.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # the smallest vertex of a component isn't among those that have one found
    members = found.unionByName(found.select(F.col("component").alias("rep"), "component").distinct())
    # a group may have a large share of all sets
    linked = common.saved(classes.select(*key, "copies", "head", "rep").join(members, "rep"))
    heads = common.saved(linked.groupBy("component").agg(F.min("head").alias("group_head"), F.count(F.lit(1)).alias("size")))
    together = common.joined(linked, heads, ["component"], "size").select(*key, "copies", F.col("group_head").alias("head"))
    alone = classes.join(members, "rep", "left_anti").select(*key, "copies", "head")
    named = common.saved(together.unionByName(alone).select(*key, "copies", F.col("head.doc_id").alias("component_id"), F.col("head.row").alias("head")))
    common.dropped(classes, found, linked, heads, *links)
    return sketches, named


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = 80, rounds: tuple = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) and kept, for each row of docs.

    Documents are linked if their shingle sets' similarity is percent / 100 or more. A null or empty text, or one without
    words, has no shingles, is linked with nothing and is its own component. Repeated rows share their component; rows with
    one doc_id and different texts have each their own. A row with a null doc_id is linked as any other; it belongs to the smallest
    doc_id of its group, or to none (null) where no row of it has one, and is kept. Texts of any length are read whole.
    Only doc_id and text are read.
    """
    sketches, named = _grouped(docs, size, percent, rounds)
    key = ["d1", "d2"]
    rows = sketches.select("doc_id", "n_shingles", *key)
    # the copies of one text may be a large share of all rows
    with_words = common.joined(rows.where("n_shingles > 0"), named, key, "copies").select("doc_id", "n_shingles", "component_id")
    whole = with_words.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return whole.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), size=4)


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each group of near duplicates: of its smallest doc_id, where it has one.

    Unlike texts of one doc_id are different documents, and both stay; rows without an id are near copies as any other. Rows that
    repeat both id and text count once; of their other columns those with the smallest hash stay. Texts without words are in no group.
    """
    sketches, named = _grouped(docs, SHINGLE, 80, ROUNDS)
    heads = named.select(F.col("head").alias("row"), F.lit(True).alias("stays")).distinct()
    stays = F.coalesce(F.max(F.col("stays") | (F.col("n_shingles") == 0)), F.max(F.col("n_shingles") == 0))
    keys = common.saved(sketches.select("row", "text_key", "n_shingles").join(heads, "row", "left").groupBy("text_key").agg(stays.alias("stays"), F.count(F.lit(1)).alias("times")).where("stays").drop("stays"))
    common.dropped(sketches, named)
    rows = docs.withColumn("text_key", _text_key()).join(keys, "text_key")
    once = rows.where("times = 1").select(*docs.columns)
    whole = F.struct(*docs.columns)
    repeated = rows.where("times > 1").groupBy("text_key", "doc_id", F.sha2("text", 256)).agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("whole")).select("whole.*")
    return once.unionByName(repeated)
