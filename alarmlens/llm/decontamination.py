"""Benchmark decontamination (operator 10).

An Aho-Corasick automaton holds every window of ten normalised words of the benchmark's questions and answers, over symbols that
stand for words. A document's normalised words are scanned once; a hit's words map back to places in the original text. The
automaton goes to every task, so its size is checked: it grows with the windows, and a benchmark of more than MOST_WINDOWS is
dealt into blocks, with a scan for each, whose hits meet by row.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Windows in an automaton, about 1 KB of a task's memory each.
MOST_WINDOWS = 200_000
#: Windows of one piece of an item; longer items are cut into pieces that overlap.
PIECE_WINDOWS = 512
#: Lower-cases A-Z, and makes a space of each ASCII character that is neither letter nor digit.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOUND = "hits array<long>, items array<string>"
SCHEMA = f"n_words long, {FOUND}"


def normalised(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def pieces(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, int]]:
    """An item's words in pieces that hold each of its windows once, with the number of these."""
    if not words:
        return []
    n = max(1, len(words) - size + 1)
    return [(b" ".join(words[i : i + PIECE_WINDOWS + size - 1]), min(PIECE_WINDOWS, n - i)) for i in range(0, n, PIECE_WINDOWS)]


class Scanner:
    """Words become two characters each, of different ranges, so that no node has many branches and hits begin at words."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        import ahocorasick

        owners: dict[tuple[bytes, ...], list[str]] = {}
        for item, text in items:
            words = text.split()
            for i in range(max(1, len(words) - size + 1)):
                owners.setdefault(tuple(words[i : i + size]), []).append(item)
        self.symbols: dict[bytes, str] = {}
        for window in owners:
            for word in window:
                if word not in self.symbols:
                    n = len(self.symbols)
                    self.symbols[word] = chr(512 + (n >> 8)) + chr(256 + (n & 255))
        self.automaton = ahocorasick.Automaton()
        for window, who in owners.items():
            self.automaton.add_word("".join(self.symbols[w] for w in window), (len(window), sorted(set(who))))
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[int], list[str]]:
        """The numbers of words that are hit, and the items whose windows occur."""
        if not words or not self.symbols:
            return [], []
        symbol = self.symbols.get
        found = list(self.automaton.iter("".join([symbol(w, "--") for w in words])))
        if not found:
            return [], []
        hit: set[int] = set()
        items: set[str] = set()
        for end, (n, who) in found:
            hit.update(range(end // 2 - n + 1, end // 2 + 1))
            items.update(who)
        return sorted(hit), sorted(items)


_scanners: dict[str, Scanner] = {}


def _scanner(block) -> Scanner:
    """One for each worker process, of the block that it scans for."""
    if block.key not in _scanners:
        _scanners.clear()
        _scanners[block.key] = Scanner(block.value.value)
    return _scanners[block.key]


class _Block:
    """A broadcast list of items, with a name that its copies in worker processes share."""

    numbers = itertools.count()

    def __init__(self, spark: SparkSession, rows: list):
        self.value = spark.sparkContext.broadcast(rows)
        self.key = f"{spark.sparkContext.applicationId}-{next(self.numbers)}"


def blocks(benchmark: DataFrame, most_windows: int = MOST_WINDOWS) -> list[_Block]:
    """The benchmark's items, in pieces, dealt into lists of at most most_windows windows. The driver holds one at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("binary").alias("text")).where("text is not null")

    def make():
        def fn(ids, texts):
            out = [(i, *piece) for i, text in zip(ids.to_pylist(), texts.to_pylist()) for piece in pieces(normalised(text))]
            return [list(x) for x in zip(*out)] if out else [[], [], []]

        return fn

    cut = common.saved(common.map_columns(rows, ["item_id", "text"], make, "item_id string, text binary, n long", rows=64).distinct())
    total = cut.agg(F.sum("n")).first()[0] or 0
    n = 1 if total <= most_windows else -(-total * 5 // (most_windows * 4))
    while True:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        largest = cut.groupBy(part.alias("part")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("pieces")).agg(F.max(F.when(F.col("pieces") > 1, F.col("n")))).first()[0] or 0
        if largest <= most_windows:
            break
        n *= 2
    out = [_Block(spark, [(r.item_id, bytes(r.text)) for r in cut.where(part == i).collect()]) for i in range(n)]
    common.dropped(cut)
    return out


def scan(docs: DataFrame, benchmark: DataFrame, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """One row for each row of docs: doc_id, text, words, numbers of hit words, items with occurring windows.

    A null or empty text, and a text or an item without words, hits nothing. A null item_id is named "null"; repeated items
    count once, and of several items with one window each is named. An empty benchmark hits nothing. Repeated rows and null
    doc_ids stay. A text of any length is scanned whole, in time in proportion to it and its hits. Other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = blocks(benchmark, most_windows)

    def make(block=parts[0]):
        scanner = _scanner(block)

        def fn(keys, texts):
            words = [normalised(x) for x in common.as_bytes(texts)]
            got = [scanner.scan(x) for x in words]
            return keys, texts, [len(x) for x in words], [x for x, _ in got], [x for _, x in got]

        return fn

    first = common.map_columns(rows, rows.columns, make, f"doc_id long, text string, {SCHEMA}")
    if len(parts) == 1:
        return first
    # the other blocks' hits, few rows, meet their documents by row
    row = F.xxhash64("doc_id", "text")
    found = _hits(rows.select(row.alias("row"), "text"), parts[1:]).groupBy("row").agg(F.flatten(F.collect_set("hits")).alias("more"), F.flatten(F.collect_set("items")).alias("who"))
    merged = lambda a, b: F.array_sort(F.array_distinct(F.concat(a, F.coalesce(b, F.array()))))
    both = first.withColumn("row", row).join(found, "row", "left")
    return both.select("doc_id", "text", "n_words", merged("hits", F.col("more")).alias("hits"), merged("items", F.col("who")).alias("items"))


def _hits(rows: DataFrame, parts: list[_Block]) -> DataFrame:
    """(row, hits, items) of the rows (row, text) that a block's windows hit, block by block."""
    out = None
    for block in parts:

        def make(block=block):
            scanner = _scanner(block)

            def fn(keys, texts):
                got = [(k, *x) for k, text in zip(keys.to_pylist(), common.as_bytes(texts)) for x in [scanner.scan(normalised(text))] if x[0]]
                return [list(x) for x in zip(*got)] if got else [[], [], []]

            return fn

        hit = common.map_columns(rows, ["row", "text"], make, f"row long, {FOUND}")
        out = hit if out is None else out.unionByName(hit)
    return out


def hit_spans(text: str, hits: list[int]) -> list[tuple[int, int]]:
    """Where runs of hit words lie in the original text."""
    places = [m.span() for m in WORD.finditer(text)]
    runs: list[tuple[int, int]] = []
    for _, run in itertools.groupby(enumerate(hits), lambda x: x[1] - x[0]):
        run = [i for _, i in run]
        runs.append((places[run[0]][0], places[run[-1]][1]))
    return runs


def spans(scanned: DataFrame) -> DataFrame:
    """Adds hit_spans: start and end (exclusive) of each run of hit words, in characters of the original text."""

    def make():
        def fn(keys, texts, n, hits, items):
            found = [hit_spans(t, h) if h else [] for t, h in zip(texts.to_pylist(), hits.to_pylist())]
            return keys, texts, n, hits, items, [[{"start": a, "end": b} for a, b in x] for x in found]

        return fn

    return common.map_columns(scanned, scanned.columns, make, f"doc_id long, text string, {SCHEMA}, hit_spans array<struct<start:long,end:long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The rows of docs, all columns, whose text holds no window of the benchmark."""
    parts = blocks(benchmark, most_windows)

    def make(block=parts[0]):
        scanner = _scanner(block)
        return lambda batch: batch.filter(pa.array([not scanner.scan(normalised(x))[0] for x in common.as_bytes(common.column(batch, "text"))], pa.bool_()))

    kept = common.map_batches(docs, make)
    if len(parts) > 1:
        row = F.xxhash64("doc_id", "text")
        kept = kept.withColumn("hit_row", row).join(_hits(docs.select(row.alias("row"), "text"), parts[1:]).select(F.col("row").alias("hit_row")).distinct(), "hit_row", "left_anti").drop("hit_row")
    return kept
