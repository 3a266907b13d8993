"""Packing of tokenised documents into sequences (operator 3).

Documents are cut into pieces of at most a sequence's length. The pieces are dealt at random into groups, and each group
is packed on its own by first-fit decreasing: a tournament tree over the bins' free space finds the first bin that a piece
fits into. A group's padding is at most that of its last few bins, so the groups' size bounds both memory and padding.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common
from .bpe_transducer import Memo, encoder

LENGTH = 4096
END_ID = 2
GROUP_DOCS = 8192
#: Bytes of text in a group, about; its ids are held in memory.
GROUP_BYTES = 32 << 20
PACKED = "doc_id long, start long, length long, {payload}, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Free space of bins, as a complete binary tree whose inner nodes hold the larger of two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.free = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> tuple[int, int]:
        """Takes size from the first bin that has it; the bin and its free space before."""
        free, leaves, at = self.free, self.leaves, 1
        while at < leaves:
            at *= 2
            if free[at] < size:
                at += 1
        before = free[at]
        free[at] = left = before - size
        out = at - leaves
        while at > 1:
            other = free[at ^ 1]
            at >>= 1
            best = left if left > other else other
            if free[at] == best:
                break
            free[at] = left = best
        return out, before


def first_fit_decreasing(sizes: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces of equal size keep their order."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)
    if rest := len(sizes) - full:
        tree = Tournament(rest, capacity)
        for i, size in zip(order[full:].tolist(), sizes[order[full:]].tolist()):
            found, before = tree.first(size)
            bins[i], offsets[i] = full + found, capacity - before
    return bins, offsets


_memos: dict[str, Memo] = {}


def _ids(path: str):
    if path not in _memos:
        ids = encoder(path).ids
        _memos[path] = Memo(lambda word: array("I", ids(word)).tobytes(), 400_000)
    return _memos[path].__getitem__


def pieces(docs: DataFrame, tokenizer: str, groups: int, length: int = LENGTH) -> DataFrame:
    """A row for each piece: its group, doc_id, start, length, its ids as bytes of four each, and doc_tokens.

    A row's group follows from a hash of its id and text, and for rows that repeat each other from how many the task has seen:
    such rows are alike, so a task that is run again deals the same rows to the same groups.
    """

    def make():
        encode = _ids(tokenizer)
        seen: Counter = Counter()
        end = np.array([END_ID], "<u4").tobytes()

        def fn(hashes, keys, texts):
            out = [[] for _ in range(6)]
            for h, key, text in zip(hashes.to_pylist(), keys.to_pylist(), common.as_bytes(texts)):
                g = (h + 0x9E3779B97F4A7C15 * seen[h]) % (1 << 64) % groups
                seen[h] += 1
                ids = b"".join(map(encode, (text or b"").split())) + end
                n = len(ids) // 4
                for at in range(0, n, length):
                    part = ids[4 * at : 4 * (at + length)]
                    for values, x in zip(out, (g, key, at, len(part) // 4, part, n)):
                        values.append(x)
            return out

        return fn

    return common.map_columns(docs, [F.xxhash64("doc_id", "text").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "text"], make, "pack_group long, doc_id long, start long, length long, ids binary, doc_tokens long", rows=128)


def _as_lists(ids: pa.Array, kind: pa.DataType) -> pa.Array:
    """Arrays of ids from their bytes, which stay where they are."""
    ids = ids.cast(pa.binary())
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    values = np.frombuffer(ids.buffers()[2] or b"", "<i4", count=int(ends[-1] - ends[0]) // 4, offset=int(ends[0]))
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]) // 4, pa.int32()), pa.array(values, pa.int32()), type=kind)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, group_docs: int = GROUP_DOCS, digest: bool = False) -> DataFrame:
    """Each row of docs, cut into pieces with their ids and place: sequence_id, and offset in it. digest adds the ids' CRC-32.

    A null or empty text is one piece: the end id alone. A row with a null doc_id is packed like any other, and repeated rows
    are packed once each. Other columns aren't read. Groups don't depend on
    the partitioning, but for which of several equal rows is in which.
    """
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-n // group_docs), -(-size // GROUP_BYTES))
    schema = PACKED.format(payload="ids array<int>, ids_crc32 long" if digest else "ids array<int>")
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        _memos.clear()  # this worker's, of the stage before
        order = pc.sort_indices(rows.select(["doc_id", "start"]), [("doc_id", "ascending"), ("start", "ascending")]).to_numpy()
        bins, offsets = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        bins[order], offsets[order] = first_fit_decreasing(rows["length"].to_numpy()[order], length)
        rows = rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))
        made = []
        for batch in rows.to_batches():
            ids = common.column(batch, "ids")
            columns = {f.name: common.column(batch, f.name) for f in out if f.name not in ("ids", "ids_crc32")}
            columns["ids"] = _as_lists(ids, out.field("ids").type)
            if digest:
                columns["ids_crc32"] = pa.array([zlib.crc32(x.as_buffer()) for x in ids], pa.int64())
            made.append(pa.RecordBatch.from_arrays([columns[f.name] for f in out], schema=out))
        return pa.Table.from_batches(made, schema=out)

    return pieces(docs, tokenizer, groups, length).groupBy("pack_group").applyInArrow(place, schema)


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, tokens, and ids padded to length unless their number is a power of two."""
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    rows = packed.groupBy("sequence_id").agg(whole.alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))
    missing = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(F.lit(length) - F.col("n_tokens")).cast("int")
    return rows.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), missing)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces, with the CRC-32 of the ids that pack() returns in the place of these."""
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True).drop("ids")
