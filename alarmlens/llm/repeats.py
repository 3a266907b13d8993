"""Where sequences of symbols repeat across documents, without shuffling a row for each position.

Every window of a fixed length holds short grams; the smallest hash among them is the window's anchor, the same wherever
the window stands. So a window can repeat only where its anchor's gram (key) repeats. A document sends one row for each
anchor, with the number of windows that it serves, which lie side by side; anchors whose key nothing else has are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .near_duplicates import mixed

#: Windows that are hashed at a time, in a long document.
CHUNK = 1 << 18
POSITION = np.uint64((1 << 19) - 1)

_BASES = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2 ** 64."""
    held = _powers.get(which)
    if held is None or len(held[0]) < n:
        base = int(_BASES[which])
        n = max(n, 1 << 14)
        held = _powers[which] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)])) for x in (base, pow(base, -1, 1 << 64)))
    return held


def prefix(codes: np.ndarray, which: int) -> np.ndarray:
    """Rabin-Karp sums: the hash of codes[a:b] is (out[b] - out[a]) times the base's inverse power a."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _power(which, len(codes) + 1)[0][: len(codes)], out=out[1:])
    return out


def hashed(sums: np.ndarray, a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    return mixed((sums[b] - sums[a]) * _power(which, len(sums))[1][a])


def window_hashes(codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    return hashed(prefix(codes, 1), starts, starts + length, 1)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every width neighbours, in linear time."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(codes: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, ...]:
    """key, anchor, lo, hi of each anchor: it serves the windows that begin at lo to hi."""
    parts = []
    for at in range(0, max(0, len(codes) - length + 1), CHUNK):
        part = codes[at : at + CHUNK + length - 1]
        sums = prefix(part, 0)
        starts = np.arange(len(part) - gram + 1)
        grams = mixed((sums[gram:] - sums[:-gram]) * _power(0, len(sums))[1][: len(starts)])
        least = sliding_least((grams & ~POSITION) | starts.astype(np.uint64), length - gram + 1)
        lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        hi = np.concatenate([lo[1:], [len(least)]]) - 1
        anchor = (least[lo] & POSITION).astype(np.int64)
        parts.append((grams[anchor], anchor + at, lo + at, hi + at))
    if not parts:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts))


ROW = "key long, doc long, anchor int, before short, n short"


def anchor_rows(docs: DataFrame, codes: Callable[[bytes], np.ndarray], gram: int, length: int) -> DataFrame:
    """A row for each anchor of each document (columns doc, text): it serves n windows, the first of which begins `before` symbols before it."""

    def make():
        def fn(ids, texts):
            columns = [[] for _ in range(5)]
            for doc, text in zip(ids.to_pylist(), common.as_bytes(texts)):
                key, anchor, lo, hi = anchors(codes(text or b""), gram, length)
                if len(key):
                    for values, x in zip(columns, (key.view(np.int64), np.full(len(key), doc, np.int64), anchor, anchor - lo, hi - lo + 1)):
                        values.append(x)
            return [pa.array(np.concatenate(x)) if x else pa.nulls(0) for x in columns]

        return fn

    return common.map_columns(docs.where("doc IS NOT NULL AND text IS NOT NULL"), ["doc", "text"], make, ROW, rows=128)


def candidates(rows: DataFrame) -> DataFrame:
    """The anchors whose key another anchor has too. rows is a saved table, since it is read for a sample of its keys first.

    Rows are dealt by ranges of (key, doc, anchor), so that a key with a large share of them spreads over tasks; the first and
    the last of a task's rows may have fellows in the next task, and stay. Batches stream through; one row is held.
    """
    by_range = rows.repartitionByRange("key", "doc", "anchor").sortWithinPartitions("key", "doc", "anchor")

    def run(batches):
        held, key, several = None, None, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.asarray(common.column(batch, "key"))
            same = keys[1:] == keys[:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[held is None or key == keys[0]], same])
            if held is not None and (several or key == keys[0]):
                yield held
            yield batch.slice(0, n - 1).filter(pa.array(keep[:-1]))
            held, key, several = batch.slice(n - 1), keys[-1], bool(keep[-1])
        if held is not None:
            yield held

    return by_range.mapInArrow(run, rows.schema)


def row_name(long_enough: Column) -> Column:
    """What a row (doc_id, text) goes by: a hash of both, or any number where the text is missing or too short to have spans."""
    return F.when(long_enough, F.xxhash64("doc_id", "text")).otherwise(F.monotonically_increasing_id())


def placed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (doc, text) that have candidates, with these (at: key, anchor, before, n); their number is bounded by the text's length."""
    at = found.groupBy("doc").agg(F.collect_set(F.struct("key", "anchor", "before", "n")).alias("at"))
    return docs.join(at.hint("merge"), "doc")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted or unsorted spans (end exclusive); spans that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def by_document(spans: DataFrame) -> DataFrame:
    """(doc, spans): a document's spans (lo, hi) together; their number is bounded by its length."""
    return spans.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
