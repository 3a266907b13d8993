"""Language identification by hyperdimensional profiles (operator 8).

Each letter has a random vector of +1 and -1. A trigram's vector binds its letters' vectors, shifted by their places; a
text's vector bundles those of its trigrams, and a language's prototype bundles its training texts. A text is compared with
the prototypes by cosine. Prototypes are centred on the languages' common part, so that what all share decides nothing.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIMENSIONS = 512
#: Trigrams whose vectors a worker keeps.
MOST_VECTORS = 40_000
UNKNOWN = "und"
#: Prototypes go to every task: languages times DIMENSIONS numbers. More languages than this raise an error.
MOST_LANGUAGES = 4096


def _letters() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


class Profiles:
    """Vectors of letters, trigrams and texts; all depend on code points alone, so that every worker has the same."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.is_letter = _letters()
        self.letter: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.rows = np.empty((MOST_VECTORS, dimensions), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letter:
            if len(self.letter) > 20_000:
                self.letter.clear()
            self.letter[code] = np.where(np.random.default_rng(code).integers(0, 2, self.dimensions), 1, -1).astype(np.int8)
        return self.letter[code]

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        if len(self.row) + len(grams) > MOST_VECTORS:
            self.row.clear()
        if len(grams) > MOST_VECTORS // 2:
            return np.concatenate([self._vectors(part).copy() for part in np.array_split(grams, 4 * len(grams) // MOST_VECTORS + 1)])
        at = []
        for gram in grams.tolist():
            i = self.row.get(gram)
            if i is None:
                i = self.row[gram] = len(self.row)
                a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
                self.rows[i] = np.roll(self._letter(a), 2) * np.roll(self._letter(b), 1) * self._letter(c)
            at.append(i)
        return self.rows[at]

    def text(self, text: str | None) -> np.ndarray | None:
        """The bundle of a whole text's trigrams over letters, other characters standing as one space; None without letters."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        codes[~self.is_letter[codes]] = 32
        codes = np.concatenate([[32], codes, [32]])
        codes = codes[(codes != 32) | np.concatenate([[True], codes[1:] != codes[:-1]])]
        if len(codes) < 3:
            return None
        grams, n = np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)
        return np.sqrt(n).astype(np.float32) @ self._vectors(grams).astype(np.float32)


_profiles: dict[int, Profiles] = {}


def profiles(dimensions: int) -> Profiles:
    if dimensions not in _profiles:
        _profiles[dimensions] = Profiles(dimensions)
    return _profiles[dimensions]


def held_out(key: str | Column = "doc_id") -> Column:
    """Documents that nothing is learned from: CRC-32 of the id as text, modulo 3, is 1. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False)) if isinstance(key, str) else key


def fit(labelled: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from all rows of (text, lang) with a non-null lang.

    Tasks add up texts' unit vectors by language, so that only languages times tasks rows are shuffled.
    """

    def run(batches):
        made, sums = profiles(dimensions), {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at in range(0, batch.num_rows, common.SLICE_ROWS):
                for text, lang in zip(batch.column(0).slice(at, common.SLICE_ROWS).to_pylist(), langs[at : at + common.SLICE_ROWS]):
                    if (v := made.text(text)) is not None and (size := np.linalg.norm(v)) > 0:
                        sums[lang] = sums.get(lang, 0) + v.astype(np.float64) / size
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "total"])

    parts = labelled.where("lang is not null").select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, total array<double>")
    total = [F.sum(F.col("total")[i]).alias(f"d{i}") for i in range(dimensions)]
    rows = parts.groupBy("lang").agg(F.array(*total).alias("total")).orderBy("lang").take(MOST_LANGUAGES + 1)
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not rows:
        return [], np.zeros((0, dimensions))
    found = np.array([r.total for r in rows])
    found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    if len(rows) > 1:
        found -= found.mean(axis=0)
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return [r.lang for r in rows], found


def classify(text: str | None, made: Profiles, langs: list[str], prototypes: np.ndarray) -> tuple[str, float]:
    """The language with the largest cosine (ties: the first by name), and (1 + cosine) / 2."""
    v = made.text(text) if langs else None
    if v is None or not (size := np.linalg.norm(v)):
        return UNKNOWN, 0.0
    cosines = prototypes @ (v / size)
    best = int(np.argmax(cosines))
    return langs[best], float(min(1.0, max(0.0, (1 + cosines[best]) / 2)))


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs.

    A null text, one without letters, and any text where nothing was learned is `und` with score 0. Null doc_ids and repeated
    rows stay. Only doc_id and text are read.
    """
    model = docs.sparkSession.sparkContext.broadcast((langs, prototypes.astype(np.float32)))

    def make():
        names, vectors = model.value
        made = profiles(vectors.shape[1])

        def fn(keys, held, texts):
            got = [classify(t, made, names, vectors) for t in texts.to_pylist()]
            return keys, held, [x[0] for x in got], [x[1] for x in got]

        return fn

    return common.map_columns(docs, [F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"], make, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predict(docs, *fit(docs.where(~held_out())))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, for which a language is found; those without letters go."""
    langs, prototypes = fit(docs.where(~held_out()))
    model = docs.sparkSession.sparkContext.broadcast((langs, prototypes.astype(np.float32)))

    def make():
        names, vectors = model.value
        made = profiles(vectors.shape[1])
        return lambda batch: batch.filter(pa.array([not names or classify(t, made, names, vectors)[0] != UNKNOWN for t in common.column(batch, "text").to_pylist()], pa.bool_()))

    return common.map_batches(docs, make)
