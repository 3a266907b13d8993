"""Target-distribution importance resampling (operator 13).

In each task DuckDB takes a slice of texts, unnests their words, makes n-grams with a window over a text's words, and counts them by
bucket, with zlib's CRC as a registered function. The counts of each document are spilled to Parquet in the shared folder; Spark
sums them by bucket over the corpus and over the target, and scores each document from its own counts, so texts are read once.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAX_N, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Bytes of text that a query in a task takes, and of a piece of a long text. A word is never cut.
SLICE_BYTES, PIECE_BYTES = 4_000_000, 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
UNCUT = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
COUNTS = "buckets array<int>, counts array<int>"
WORDS_SQL = f"""WITH found AS (SELECT row, skip, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD_CLASS}') AS words FROM pieces),
word AS (SELECT piece, row, skip, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM (SELECT row_number() OVER () AS piece, * FROM found))"""


def pieces(text: bytes, max_n: int = MAX_N, size: int | None = None) -> Iterator[tuple[int, bytes]]:
    """A text in pieces that end where a word does, each with the number of words before it that it repeats for its n-grams."""
    at, skip, end, size = 0, 0, 0, size or PIECE_BYTES
    while True:
        cut = SEPARATOR.search(text, max(at + size, end + 1)) if len(text) - at > size else None
        end = cut.start() if cut else len(text)
        yield skip, text[at:end]
        if not cut:
            return
        starts = [m.start() for m in UNCUT.finditer(text, at, end)][1 - max_n :] if max_n > 1 else []
        at, skip = (starts[0], len(starts)) if starts else (end, 0)


def counting_sql(max_n: int, buckets: int) -> str:
    """(row, bucket, n) of all runs of 1 to max_n words of the table pieces; runs that end in a repeated word are its predecessor's."""
    runs = ["SELECT row, word AS feature FROM word WHERE place > skip"]
    for n in range(2, max_n + 1):
        later = ", ".join(f"lead(word, {i}) OVER w" for i in range(1, n))
        runs.append(f"SELECT row, feature FROM (SELECT row, skip, place + {n - 1} AS end_, concat_ws(' ', word, {later}) AS feature, lead(word, {n - 1}) OVER w AS last FROM word WINDOW w AS (PARTITION BY piece ORDER BY place)) WHERE last IS NOT NULL AND end_ > skip")
    return f"""{WORDS_SQL}, runs AS ({' UNION ALL '.join(runs)}), counted AS (SELECT row, feature, count(*) AS n FROM runs GROUP BY row, feature),
hashed AS (SELECT feature, zlib_crc32(feature) % {buckets} AS bucket FROM (SELECT DISTINCT feature FROM counted)),
words AS (SELECT row, count(*) AS n FROM word WHERE place > skip GROUP BY row)
SELECT row, bucket, CAST(sum(n) AS BIGINT) AS n FROM counted JOIN hashed USING (feature) GROUP BY row, bucket UNION ALL SELECT row, -1, n FROM words ORDER BY row, bucket"""


class Counter:
    """A DuckDB connection of one task."""

    def __init__(self, max_n: int, buckets: int):
        import duckdb

        # batches are bounded, so nothing has to be spilled to a folder of the machine
        self.con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        self.con.create_function("zlib_crc32", lambda words: pa.array([zlib.crc32(w) for w in words.cast(pa.binary()).to_pylist()], pa.int64()), ["VARCHAR"], "BIGINT", type="arrow")
        self.max_n, self.sql = max_n, counting_sql(max_n, buckets)

    def _counted(self, rows: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, skip, text = zip(*rows)
        self.con.register("pieces", pa.table({"row": pa.array(row, pa.int64()), "skip": pa.array(skip, pa.int64()), "text": pa.array(text, pa.binary()).cast(pa.string())}))
        got = self.con.sql(self.sql).to_arrow_table()
        self.con.unregister("pieces")
        return tuple(got.column(c).to_numpy() for c in ("row", "bucket", "n"))

    def count(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, n), ordered; bucket -1 counts a text's words. Queries take a bounded number of bytes, and what they count is added up."""
        parts, held, size = [], [], 0
        for row, text in enumerate(texts):
            for skip, piece in pieces(text or b"", self.max_n):
                held.append((row, skip, piece))
                size += len(piece)
                if size >= SLICE_BYTES:
                    parts.append(self._counted(held))
                    held, size = [], 0
        if held:
            parts.append(self._counted(held))
        row, bucket, n = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((bucket, row))
        row, bucket, n = row[order], bucket[order], n[order]
        starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]) if len(row) else np.zeros(0, dtype=int)
        return row[starts], bucket[starts], np.add.reduceat(n, starts) if len(row) else n


def _counts(max_n: int, buckets: int) -> Callable:
    def make() -> Callable:
        counter = Counter(max_n, buckets)

        def fn(ids: pa.Array, rows: pa.Array, texts: pa.Array) -> tuple:
            row, bucket, n = counter.count(common.as_bytes(texts))
            words = np.zeros(len(texts), dtype=np.int64)
            is_words = bucket < 0
            words[row[is_words]] = n[is_words]
            row, bucket, n = row[~is_words], bucket[~is_words], n[~is_words]
            ends = np.searchsorted(row, np.arange(len(texts) + 1))
            total = np.concatenate([[0], np.cumsum(n)])
            offsets = pa.array(ends, pa.int32())
            arrays = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (bucket, n)]
            return ids, rows, pa.array(words), pa.array(total[ends[1:]] - total[ends[:-1]]), *arrays

        return fn

    return make


def counts(df: DataFrame, id_: Column, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(id, row, n_words, n_features, buckets, counts) of each row's text: the saved spill. row tells rows apart."""
    columns = [id_.cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col("text")]
    return common.saved(common.map_columns(df, columns, _counts(max_n, buckets), f"id long, row long, n_words long, n_features long, {COUNTS}"))


def totals(spilled: DataFrame) -> DataFrame:
    """(bucket, n) over all rows. Tasks add up their own first, so that no more than a row a bucket and task is shuffled."""
    return spilled.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum(F.col("x.counts").cast("long")).alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """For each bucket, the logarithm, in thousandths, of its share of the target over that of the source, each count raised by one."""
    s, t = float(sum(source.values())), float(sum(target.values()))
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (s + buckets) / ((source.get(b, 0) + 1.0) * (t + buckets)))) for b in range(buckets)]


def scored(spilled: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """(id, row, n_words, n_features, weight, score): the floored mean gain, and that with Gumbel noise from the id's hash."""

    def make() -> Callable:
        table = np.array(gain, dtype=np.int64)

        def noise(doc_id: int | None) -> int:
            h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
            return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

        def fn(ids, rows, n_words, n_features, found, n) -> tuple:
            value = table[found.flatten().to_numpy(zero_copy_only=False)] * n.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))])
            total = np.concatenate([[0], np.cumsum(value)])
            features = n_features.to_numpy(zero_copy_only=False)
            weight = (total[ends[1:]] - total[ends[:-1]]) // np.maximum(features, 1)
            score = weight + np.array([noise(i) for i in ids.to_pylist()], dtype=np.int64)
            return ids, rows, n_words, n_features, pa.array(weight), pa.array(score)

        return fn

    return common.map_columns(spilled, ["id", "row", "n_words", "n_features", "buckets", "counts"], make, "id long, row long, n_words long, n_features long, weight long, score long", rows=4096)


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds rank: 1, 2, 3... of the percent of long enough rows that score highest, ties to the smaller id; else null. rows is a saved table.

    The lowest score drawn comes from the number of rows by score; scores are whole numbers of a range that doesn't depend on the
    number of rows. Only rows from there on are sorted, by range, and numbered inside their range; ranges are offset by their sizes.
    """
    spark = rows.sparkSession
    enough = F.col("n_words") >= least_words
    by_score = sorted(((r["score"], r["n"]) for r in rows.where(enough).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    draw, cut, above = percent * sum(n for _, n in by_score) // 100, None, 0
    for score, n in by_score:
        if above >= draw:
            break
        cut, above = score, above + n
    none = F.lit(None).cast("long")
    if cut is None:
        return rows.withColumn("rank", none)
    high = F.coalesce(enough & (F.col("score") >= cut), F.lit(False))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    dealt = rows.where(high).repartitionByRange(*order).sortWithinPartitions(*order)
    top = common.saved(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(2**33 - 1)))
    sizes = sorted((r["part"], r["n"]) for r in top.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a task
    offsets, before = [], 0
    for part, n in sizes:
        offsets.append((part, before))
        before += n
    place = F.col("before") + F.col("place") + 1
    numbered = top.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part").select(*rows.columns, F.when(place <= draw, place).alias("rank"))
    return numbered.unionByName(rows.where(~high).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", max_n: int = MAX_N, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Every row of docs (id_col, text): id, n_words, n_features, weight, score and rank (null unless drawn).

    A null or text without words has no features, and weight 0. Texts are taken whole, long ones in pieces. Rows of one id have the
    same noise; those without id share theirs, and come last among equal scores. Repeated rows count as often as they occur. An
    empty corpus gives no rows; with an empty target all of its counts are 0. Other columns are not read.
    """
    corpus, aimed = counts(docs, F.col(id_col), max_n, buckets), counts(target, F.lit(None), max_n, buckets)
    sums = [{r["bucket"]: r["n"] for r in totals(x).collect()} for x in (corpus, aimed)]  # a row a bucket
    rows = common.saved(scored(corpus, gains(*sums, buckets), seed))
    common.dropped(corpus, aimed)
    return ranked(rows, percent, least_words)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, weighed by their likeness to benchmark. For awkward rows, see resample()."""
    rows = resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return rows.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: zlib's CRC, bit by bit: for each byte, its exclusive or, then eight shifts that take the polynomial where a one leaves.
CRC_SQL = """(SELECT word, list_reduce(flatten([[CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(0, octet_length(encode(word)))]),
 lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295) AS c FROM (SELECT DISTINCT word FROM all_words))"""


def _oracle() -> str:
    words = lambda table, key: f"SELECT {key} AS row, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD_CLASS}')) AS word FROM {table}"
    return f"""WITH dw AS MATERIALIZED ({words('documents', 'doc_id')}), bw AS MATERIALIZED ({words('benchmark', 'item_id')}), all_words AS (SELECT word FROM dw UNION ALL SELECT word FROM bw),
h AS MATERIALIZED (SELECT word, xor(c, 4294967295) % {BUCKETS} AS bucket FROM {CRC_SQL}), df AS MATERIALIZED (SELECT row, bucket FROM dw JOIN h USING (word)), bf AS MATERIALIZED (SELECT bucket FROM bw JOIN h USING (word)),
g AS MATERIALIZED (SELECT b AS bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1::DOUBLE) * ((SELECT count(*) FROM df) + {BUCKETS}::DOUBLE) / ((coalesce(s.n, 0) + 1::DOUBLE) * ((SELECT count(*) FROM bf) + {BUCKETS}::DOUBLE)))) AS BIGINT) AS gain
 FROM range(0, {BUCKETS}) q(b) LEFT JOIN (SELECT bucket, count(*) AS n FROM bf GROUP BY bucket) t ON t.bucket = b LEFT JOIN (SELECT bucket, count(*) AS n FROM df GROUP BY bucket) s ON s.bucket = b),
m AS (SELECT row, count(*) AS n, CAST(floor(sum(gain) / count(*)::DOUBLE) AS BIGINT) AS weight FROM df JOIN g USING (bucket) GROUP BY row),
w AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM documents LEFT JOIN m ON row = doc_id),
r AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place FROM w)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT {PERCENT} * count(*) // 100 FROM w WHERE n_features >= {LEAST_WORDS}) THEN place END AS rank FROM r"""


ORACLE = _oracle()
