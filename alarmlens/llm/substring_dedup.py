"""Substrings of words that an earlier document has (operator 7).

Rabin-Karp hashes of every window of fifty words, counted in Spark: each window that can repeat is a row, and a shuffle by hash
finds the smallest doc_id that has it. A window whose anchor (see repeats) is nowhere else can't repeat: of these, a hash of
the anchor's gram is counted instead, one for all windows that it serves. Repeated windows merge into maximal removal intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, repeats

WINDOW = 50
GRAM = 15


def word_codes(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(h, id, doc, lo) of each window that can repeat, in documents (id, doc, text) whose doc tells rows apart."""
    rows = common.saved(repeats.anchor_rows(docs, word_codes, gram, window))
    found = common.saved(repeats.candidates(rows))
    common.dropped(rows, shuffles=True)

    def make():
        def fn(ids, docs, texts, places):
            out = [[] for _ in range(4)]
            for id_, doc, text, at in zip(ids.to_pylist(), docs.to_pylist(), common.as_bytes(texts), places.to_pylist()):
                starts = np.concatenate([np.arange(p["anchor"] - p["before"], p["anchor"] - p["before"] + p["n"]) for p in at])
                for values, x in zip(out, (repeats.window_hashes(word_codes(text), starts, window).view(np.int64), np.full(len(starts), id_, np.int64), np.full(len(starts), doc, np.int64), starts.astype(np.int32))):
                    values.append(x)
            return [pa.array(np.concatenate(x)) if x else pa.nulls(0) for x in out]

        return fn

    return common.map_columns(repeats.placed(docs, found), ["id", "doc", "text", "at"], make, "h long, id long, doc long, lo int", rows=64)


def removal_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, spans): words lo to hi (exclusive) to remove, of the documents (id, doc, text) that have any."""
    each = common.saved(windows(docs, window, gram))
    counted = each.groupBy("h").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = common.saved(counted)
    spans = common.joined(each, counted, ["h"], "n").where("id > least").select("doc", "lo", (F.col("lo") + window).cast("int").alias("hi"))
    found = common.saved(spans)
    common.dropped(each, counted, shuffles=True)
    return repeats.by_document(found)


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, and spans of words to remove (null: none).

    A null or empty text has no words. A null doc_id is neither smaller nor larger than another: its row keeps all words, and
    takes none from others. Rows that repeat a doc_id take nothing from each other, and each is judged by its own text against
    the smaller ids. A text too short for a window goes by a number of its own, so that such rows don't meet in one task; one of any
    length is one row, held by one task with its spans. Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc", repeats.row_name(F.octet_length("text") >= 2 * window - 1))
    known = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "doc", "text")
    return rows.join(removal_spans(known, window).hint("merge"), "doc", "left").drop("doc")


def kept_words(text: bytes | None, spans: list | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = (text or b"").split()
    if not spans:
        return words, len(words)
    out, done = [], 0
    for a, b in repeats.merged([(s["lo"], s["hi"]) for s in spans]):
        out += words[done:a]
        done = b
    return out + words[done:], len(words)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        def fn(ids, texts, spans):
            out = [[] for _ in range(3)]
            for text, at in zip(common.as_bytes(texts), spans.to_pylist()):
                kept, n = kept_words(text, at)
                for values, x in zip(out, (n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())):
                    values.append(x)
            return ids, *out

        return fn

    return common.map_columns(removed(common.table(spark, sf_dir, "documents")), ["doc_id", "text", "spans"], make, "doc_id long, n_words long, n_removed long, kept_sha256 string", rows=256)
