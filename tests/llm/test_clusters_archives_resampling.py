"""Operators 11 to 13 against their SQL and plain versions, and on awkward rows."""

import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from alarmlens.llm import centroid_clustering as cc
from alarmlens.llm import importance_resampling as ir
from alarmlens.llm import warc
from alarmlens.llm.queries import ORACLES, QUERIES

MEDIUM = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_warc", "op13_importance_resampling"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{MEDIUM}/{table}.parquet'")
    got = QUERIES[name](spark, MEDIUM)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == sorted((tuple(r) for r in cursor.fetchall()), key=repr)


def plain_clusters(rows, k, rounds, components, seed=cc.SEED):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) and abs(1024 * x) < 2**63 for x in v)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=name)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    out = []
    for i, v in kept:
        j = nearest(v)
        d = far(v, centroids[j])
        out.append((i, j, d if d < 2**63 else None))
    return sorted(out, key=repr), centroids


def vectors(n, components, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, components)) * 3
    return [(i, [float(x) for x in centres[i % 5] + rng.normal(size=components) * (0.01 if i % 5 else 1)]) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 5])
def test_clusters_equal_plain(spark, parts, monkeypatch):
    monkeypatch.setattr(cc, "TREE_VECTORS", 150)
    monkeypatch.setattr(cc, "LEAF_VECTORS", 4)
    rows = vectors(400, 4)
    rows += [(7, rows[3][1])] * 90  # copies, of one id
    rows += [(None, rows[5][1]), (900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [1.0] * 5)]
    rows += [(906, [1e9, -1e9, 0.5, 0.0]), (907, [1e12, 1e12, 1e12, 1e12]), (908, [1e300, 0.0, 0.0, 0.0]), (909, [-8e15, 8e15, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cluster string").repartition(parts)
    got, centroids = cc.cluster(df, "vec_id", "embedding", components=4, k=6)
    want, middle = plain_clusters(rows, 6, cc.ROUNDS, 4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert centroids == middle


def test_ball_tree_bounds_its_rows_and_assigns_whole_balls():
    x = np.floor(np.random.default_rng(1).normal(size=(500, 3)) * 10 + np.repeat([[0, 0, 0], [5000, 0, 0]], 250, axis=0))
    order, nodes = cc.ball_tree(x)
    rows = x[order]
    for i, (a, b) in enumerate(zip(nodes["first"], nodes["last"])):
        middle = nodes["centre"].reshape(-1, 3)[i]
        assert np.sqrt(((rows[a:b] - middle) ** 2).sum(axis=1)).max() <= nodes["radius"][i] + 1e-9
        assert (nodes["total"].reshape(-1, 3)[i] == rows[a:b].sum(axis=0)).all()
    assert sorted(order.tolist()) == list(range(500))
    tree = cc.Tree.__new__(cc.Tree)
    tree.ids, tree.narrow, tree.x = list(range(500)), True, rows
    tree.first, tree.last, tree.child, tree.radius = (np.array(nodes[n]) for n in ("first", "last", "child", "radius"))
    tree.centre, tree.total = nodes["centre"].reshape(-1, 3), nodes["total"].reshape(-1, 3)
    node_of, row_of, opened = tree.assigned([[0, 0, 0], [5000, 0, 0]])
    assert not len(opened) and (node_of >= 0).sum() == 2  # the two halves, from their sums


def test_clusters_of_few_and_no_vectors(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    few = spark.createDataFrame([(1, [0.5] * 64, 0), (2, [0.5] * 64, 0), (3, [float("nan")] * 64, 0)], schema)
    few.write.parquet(f"{tmp_path}/few/embeddings.parquet")
    few.where("false").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    rows = cc.query(spark, f"{tmp_path}/few").collect()
    assert [(r.vec_id, r.cluster, r.distance, r.inertia) for r in sorted(rows)] == [(1, 0, 0, 0), (2, 0, 0, 0)]
    assert cc.query(spark, f"{tmp_path}/none").count() == 0


PAGES = [
    (3, "http://a.example/x?q=1#f", "<p>same</p>"),
    (1, "https://b.example", "<p>same</p>"),
    (2, None, "<p>same</p>"),
    (None, "http://a.example/ü", "<p>same</p>"),
    (4, "http://a.example/", None),
    (5, "http://a.example/ a\r\nX: y", ""),
    (6, "not a url", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"),
    (6, "not a url", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"),
    (7, "http://a.example/long", "é\r\n\r\n" * 200_000),
    (None, None, None),
]


def pages(spark):
    return spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, payload string, record_id int").repartition(3)


def plain_pages():
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        of = first.get(html or "")
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == of else "revisit", None if i == of else of))
    return sorted(out, key=repr)


def test_archives_give_every_page_back(spark, tmp_path):
    pages(spark).write.parquet(f"{tmp_path}/some/pages.parquet")
    pages(spark).where("false").write.parquet(f"{tmp_path}/none/pages.parquet")
    got = warc.query(spark, f"{tmp_path}/some").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_pages()
    assert warc.query(spark, f"{tmp_path}/none").count() == 0


def test_hot_payloads_meet_by_broadcast(spark, tmp_path, monkeypatch):
    from alarmlens.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 2)
    pages(spark).write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.query(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_pages()


def test_captures_are_nested_with_whole_payloads(spark, tmp_path):
    warc.write(pages(spark), f"{tmp_path}/archive")
    rows = warc.assemble(warc.read(spark, f"{tmp_path}/archive", payloads=True)).collect()
    assert len(rows) == len(PAGES) - 1 and sorted(r.copies for r in rows) == [1] * 8 + [2]
    assert all(len(r.requests) == 1 and len(r.metadata) == 1 and r.capture == r.response.record_id for r in rows)
    kept = {bytes(r.response.payload).decode() for r in rows if r.response.type == "response"}
    assert kept == {p[2] or "" for p in PAGES}
    assert all(r.response.payload_digest == r.response.declared_digest for r in rows if r.response.type == "response")
    assert {r.response.target_uri for r in rows if r.response.target_uri and "X:" in r.response.target_uri} == {"http://a.example/%20a%0D%0AX:%20y"}
    ids = {r.response.record_id: r for r in rows}
    assert all(ids[r.response.refers_to].response.type == "response" for r in rows if r.response.type == "revisit")


def record(kind, name, concurrent=(), block=b"x", more=()):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *[f"WARC-Concurrent-To: {c}" for c in concurrent], *more, f"Content-Length: {len(block)}"]
    return b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_other_archives_are_assembled(spark, tmp_path):
    http = ["Content-Type: application/http;msgtype=response"]
    parts = [
        record("warcinfo", "<i>"),
        record("response", "<r1>", ["<q1>"], b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\nmore", http),  # names its request
        record("request", "<q1>"),
        record("metadata", "<m1>", ["<q1>"]),  # over two steps
        record("response", "<r2>", [], b"HTTP/1.1 200 OK\r\n\r\n", http),
        record("metadata", "<m2>", ["<r2>"]),
        record("request", "<q3>", ["<lost>"]),
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts[:4]))
    (tmp_path / "a" / "two.warc").write_bytes(b"".join(parts[4:]))
    rows = {r.capture: r for r in warc.assemble(warc.read(spark, f"{tmp_path}/a", payloads=True)).collect()}
    assert set(rows) == {"<r1>", "<r2>", "<q3>", "<i>"}
    assert [x.record_id for x in rows["<r1>"].requests] == ["<q1>"] and [x.record_id for x in rows["<r1>"].metadata] == ["<m1>"]
    assert bytes(rows["<r1>"].response.payload) == b"body\r\n\r\nmore" and rows["<r2>"].response.payload_bytes == 0
    assert rows["<q3>"].response is None and rows["<q3>"].requests[0].record_id == "<q3>"
    with pytest.raises(ValueError):
        list(warc.parsed(parts[4][:-9]))


TEXTS = [
    (1, "The cat sat on THE mat, the Cat 42 été ÉTÉ x\x00y don't"),
    (2, "alpha beta gamma " * 40),
    (2, "alpha beta gamma " * 40),
    (3, "alpha beta gamma " * 40),
    (4, ""),
    (5, None),
    (None, "one two three four five six seven eight nine ten eleven twelve " * 3),
    (6, " \t,."),
    (7, " ".join(f"w{i % 700}" for i in range(400_000))),
    (8, "unbroken" * 300_000),
    *[(i, " ".join(f"w{(i * k) % 97}" for k in range(30))) for i in range(10, 60)],
]
TARGET = [("a", "alpha gamma w1 w2 w3"), ("b", None), ("c", "the CAT")]


def plain_resample(texts, target, max_n=1, buckets=ir.BUCKETS):
    def features(t):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
        return words, [b" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f) % buckets
    found = [(i, *features(t)) for i, t in texts]
    s, t = Counter(bucket(f) for _, _, fs in found for f in fs), Counter(bucket(f) for _, x in target for f in features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    rows = []
    for i, words, fs in found:
        gain = sum(math.floor(1000 * math.log((t[bucket(f)] + 1) * (n + buckets) / ((s[bucket(f)] + 1) * (m + buckets)))) for f in fs)
        weight = gain // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    long = sorted([r for r in rows if r[1] >= 20], key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(long) * ir.PERCENT // 100
    ranks = {}
    for k, r in enumerate(long[:drawn], 1):
        ranks.setdefault((r[0], *r[2:]), []).append(k)
    return sorted([(r[0], *r[2:], ranks[r[0], *r[2:]].pop() if r[1] >= 20 and ranks.get((r[0], *r[2:])) else None) for r in rows], key=repr)


@pytest.mark.parametrize("max_n", [1, 3])
def test_resampling_equals_plain(spark, max_n, monkeypatch):
    monkeypatch.setattr(ir, "PIECE_BYTES", 10_000)
    docs = spark.createDataFrame([(*t, 1, "x") for t in TEXTS], "doc_id long, text string, weight int, row string").repartition(3)
    target = spark.createDataFrame(TARGET, "item_id string, text string")
    rows = ir.resample(docs, target, max_n=max_n)
    got = sorted((tuple(r) for r in rows.select("id", "n_features", "weight", "score", "rank").collect()), key=repr)
    assert got == plain_resample(TEXTS, TARGET, max_n)
    assert sum(r[4] is not None for r in got) == 5


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame(TEXTS[:4], "doc_id long, text string")
    target = spark.createDataFrame(TARGET, "item_id string, text string")
    assert ir.resample(docs.where("false"), target).count() == 0
    got = ir.resample(docs, target.where("false")).select("id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(TEXTS[:4], [])


@pytest.mark.parametrize("max_n", [1, 2, 4])
def test_pieces_hold_every_run_once(max_n):
    text = b"a bb  ccc, d e ff-g hh iiiiiiiiiiiiiiiiiiii j k"
    whole = ir.UNCUT.findall(text)
    for size in range(1, 30):
        runs = []
        for skip, piece in ir.pieces(text, max_n, size):
            words = ir.UNCUT.findall(piece)
            runs += [tuple(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1) if i + n > skip]
        assert Counter(runs) == Counter(tuple(whole[i : i + n]) for n in range(1, max_n + 1) for i in range(len(whole) - n + 1))
