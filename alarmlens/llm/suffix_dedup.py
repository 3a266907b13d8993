"""Byte strings that occur elsewhere, by deep-shallow suffix sorting (operator 6).

The suffixes that are sorted are those at anchors (see repeats): every string of 200 bytes holds one, at the same place
wherever it occurs. Suffixes are dealt by their first bytes. Within such a group a multikey quicksort orders them to a shallow
depth, and blind tries order what still shares a long prefix; the reversed texts before the anchors are sorted likewise. All
removed bytes follow from the common prefixes of neighbours in these two orders: groups of suffixes grow as the prefix that
they share shrinks, and the neighbours by left side inside a growing group give the longest string that each one shares.
A context (what the anchor's windows span) that several places of a task have stands in the order twice, since two stand for any
number of equals: each is the other's neighbour, and what they share is found as between any two.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common, repeats

LENGTH = 200
GRAM = 48
#: Bytes after the shared gram that the quicksort looks at.
SHALLOW = 8
#: Contexts that one task sorts together; a group with more is dealt on by further bytes.
MOST_GROUP = 1 << 16
#: Bytes of different contexts that a task holds to send each of them once.
MOST_HELD = 32 << 20
#: Keys of large groups that are sent to all tasks; more of them are joined by a shuffle.
MOST_SENT = 1 << 20
CONTEXT = "key long, h long, context binary, before int, places long, doc long, anchor int"
FOUND = "key long, h long, left int, right int, places long"


def byte_codes(text: bytes) -> np.ndarray:
    return _BYTE_CODES[np.frombuffer(text, np.uint8)]


_BYTE_CODES = repeats.mixed(np.arange(1, 257, dtype=np.uint64))


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = known, n
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class BlindTrie:
    """A trie that keeps only where its strings part: an insertion descends blindly to some leaf, compares once, and splits a branch."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.root = None

    def add(self, i: int) -> None:
        text = self.texts[i]
        if self.root is None:
            self.root = [i]
            return
        node, path = self.root, []
        while isinstance(node, tuple):
            path.append(node)
            depth, branches = node
            byte = text[depth] if depth < len(text) else -1
            node = branches.get(byte) or next(iter(branches.values()))
        other = self.texts[node[0]]
        n = common_prefix(text, other)
        if n == len(text) == len(other):
            node.append(i)
            return
        mine, theirs = (x[n] if n < len(x) else -1 for x in (text, other))
        parent = None
        for at in path:
            if at[0] == n:
                at[1][mine] = [i]
                return
            if at[0] > n:
                break
            parent = at
        below = self.root if parent is None else parent[1][text[parent[0]] if parent[0] < len(text) else -1]
        split = (n, {theirs: below, mine: [i]})
        if parent is None:
            self.root = split
        else:
            parent[1][text[parent[0]] if parent[0] < len(text) else -1] = split

    def ordered(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def deep_shallow(texts: list[bytes], start: int = 0, shallow: int = SHALLOW) -> list[int]:
    """The order of texts, all equal before start: multikey quicksort to depth start + shallow, blind tries below."""
    out: list[int] = []
    stack = [(list(range(len(texts))), start)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
        elif depth >= start + shallow:
            trie = BlindTrie(texts)
            for i in group:
                trie.add(i)
            out += trie.ordered()
        else:
            byte = {i: texts[i][depth] if depth < len(texts[i]) else -1 for i in group}
            pivot = byte[group[len(group) // 2]]
            less, equal, more = [], [], []
            for i in group:
                (less if byte[i] < pivot else equal if byte[i] == pivot else more).append(i)
            if more:
                stack.append((more, depth))
            if pivot < 0:
                stack.append((equal, start + shallow))
            else:
                stack.append((equal, depth + 1))
            if less:
                stack.append((less, depth))
    return out


def shared_lengths(contexts: list[bytes], before: list[int], length: int, gram: int) -> list[tuple[int, int]]:
    """For each context, how many bytes before and after its anchor belong to strings of length bytes that another one shares at the anchor; (0, 0): none.

    All strings in question hold the anchor's gram, so what they cover is one piece, from the farthest left to the farthest
    right. Contexts that share d bytes after the anchor and l before it share such strings if l + d >= length.
    """
    rights, lefts = [c[b:] for c, b in zip(contexts, before)], [c[:b][::-1] for c, b in zip(contexts, before)]
    order = deep_shallow(rights, gram)
    shared = [common_prefix(rights[a], rights[b], gram) for a, b in itertools.pairwise(order)]
    place = {i: k for k, i in enumerate(deep_shallow(lefts))}
    by_left = sorted(place, key=place.__getitem__)
    left, right = [0] * len(contexts), [0] * len(contexts)
    members = [[place[i]] for i in order]  # of the group that begins at this place of the order, by left side
    head = list(range(len(order)))

    def group_of(k: int) -> int:
        while head[k] != k:
            head[k] = head[head[k]]
            k = head[k]
        return k

    for k in sorted(range(len(shared)), key=shared.__getitem__, reverse=True):
        depth = shared[k]
        a, b = group_of(k), group_of(k + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        head[b] = a
        into = members[a]
        for x in members[b]:
            at = bisect.bisect(into, x)
            into.insert(at, x)
            i = by_left[x]
            for y in into[max(0, at - 1) : at] + into[at + 1 : at + 2]:
                j = by_left[y]
                n = common_prefix(lefts[i], lefts[j])
                if n + depth >= length:
                    for m in (i, j):
                        left[m], right[m] = max(left[m], n), max(right[m], depth)
        members[b] = []
    return list(zip(left, right))


def contexts(docs: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """Rows of two kinds: a context (context, before, places: how many the task saw), and a place of one (doc, anchor). h names a context of its key."""
    out = to_arrow_schema(T.StructType.fromDDL(CONTEXT))

    def run(batches):
        held: dict[tuple[int, bytes], list[int]] = {}
        size = 0

        def rows(columns: dict[str, list]) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in out], schema=out)

        def flush():
            at = list(held.items())
            return rows({"key": [k for (k, _), _ in at], "h": [v[0] for _, v in at], "context": [c for (_, c), _ in at], "before": [v[1] for _, v in at], "places": [v[2] for _, v in at]})

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                keys, hashes, owners, anchors = [], [], [], []
                for doc, text, at in zip(part.column(0).to_pylist(), common.as_bytes(part.column(1)), part.column(2).to_pylist()):
                    for p in at:
                        key, anchor, before = p["key"], p["anchor"], p["before"]
                        lo = anchor - before
                        context = text[lo : lo + p["n"] - 1 + length]
                        name = held.get((key, context))
                        if name is None:
                            h = xxhash.xxh3_64_intdigest(context, before)
                            name = held[key, context] = [h - (1 << 64) if h >> 63 else h, before, 0]
                            size += len(context) + 200
                        name[2] += 1
                        keys.append(key)
                        hashes.append(name[0])
                        owners.append(doc)
                        anchors.append(anchor)
                if keys:
                    yield rows({"key": keys, "h": hashes, "doc": owners, "anchor": anchors})
                if size > MOST_HELD:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return repeats.placed(docs, found).select("doc", "text", "at").mapInArrow(run, CONTEXT)


def sorted_groups(different: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, h, left, right, places) of the contexts with strings that other places have too. A task holds one group at a time."""
    out = to_arrow_schema(T.StructType.fromDDL(FOUND))

    def run(batches):
        key, members, made = None, [], []

        def finish():
            if len(members) > 1 or members and members[0][3] > 1:
                twice = members + [m for m in members if m[3] > 1]
                reach = shared_lengths([m[1] for m in twice], [m[2] for m in twice], length, gram)
                best: dict[int, list[int]] = {}
                for (h, _, _, places), (left, right) in zip(members, reach):
                    seen = best.setdefault(h, [0, 0, 0])
                    seen[:] = max(seen[0], left), max(seen[1], right), seen[2] + places
                made.extend((key, h, *x) for h, x in best.items() if x[1])
            members.clear()

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if row[0] != key:
                    finish()
                    key = row[0]
                members.append(row[1:])
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made), out)], schema=out)
                made = []
        finish()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made), out)], schema=out)

    return different.select("key", "h", "context", "before", "places").repartition("key").sortWithinPartitions("key").mapInArrow(run, FOUND)


def dealt_on(different: DataFrame, length: int, width: int) -> DataFrame:
    """Each context cut into the parts that width neighbouring windows span, dealt by the bytes that all of these have in common.

    of_key, of_h and shift (from the old anchor to the new one) say where a part comes from. With width 1 the parts of one key
    are equal.
    """

    def make():
        def fn(keys, hashes, texts, befores, places):
            rows = []
            for key, h, text, before, n in zip(keys.to_pylist(), hashes.to_pylist(), texts.to_pylist(), befores.to_pylist(), places.to_pylist()):
                for block in range(-(-(before + 1) // width)):
                    first, last = max(0, before - (block + 1) * width + 1), min(len(text) - length, before - block * width)
                    if first > last:
                        continue
                    part, at = text[first : last + length], before - block * width - first
                    core = text[first + at : before - (block + 1) * width + 1 + length]
                    new, name = xxhash.xxh3_64_intdigest(core, block) ^ key & (1 << 64) - 1, xxhash.xxh3_64_intdigest(part, at)
                    rows.append((*(x - (1 << 64) if x >> 63 else x for x in (new, name)), part, at, n, key, h, -block * width))
            return [list(x) for x in zip(*rows)] if rows else [[]] * 8

        return fn

    return common.map_columns(different, ["key", "h", "context", "before", "places"], make, "key long, h long, context binary, before int, places long, of_key long, of_h long, shift int", rows=64)


def reaches(different: DataFrame, length: int, gram: int, most_group: int, widths: tuple = (16, 1)) -> DataFrame:
    """sorted_groups(), where groups of more than most_group contexts are dealt on by further bytes, until no group is as large or its contexts are equal."""
    large = common.saved(different.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_group).select("key"))
    if not widths or not large.take(1):
        common.dropped(large)
        return sorted_groups(different, length, gram)
    keys = F.broadcast(large) if large.count() <= MOST_SENT else large.hint("merge")
    small = different.join(keys, "key", "left_anti")
    parts = common.saved(dealt_on(different.join(keys, "key", "left_semi"), length, widths[0]))
    once = parts.groupBy("key", "h").agg(F.first("context").alias("context"), F.first("before").alias("before"), F.sum("places").alias("places"))
    found = reaches(common.saved(once), length, length + 1 - widths[0], most_group, widths[1:])
    origin = parts.select("key", "h", "of_key", "of_h", "shift", F.col("places").alias("own")).join(found.drop("places"), ["key", "h"])
    # tasks met a context's places each for itself: their sum, which is the same for each of its parts
    part = origin.groupBy(F.col("of_key").alias("key"), F.col("of_h").alias("h"), "shift").agg(F.max("left").alias("left"), F.max("right").alias("right"), F.sum("own").alias("places"))
    whole = part.groupBy("key", "h").agg(F.max(F.col("left") - F.col("shift")).cast("int").alias("left"), F.max(F.col("right") + F.col("shift")).cast("int").alias("right"), F.max("places").alias("places"))
    return sorted_groups(small, length, gram).unionByName(whole)


def removal_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_group: int = MOST_GROUP) -> DataFrame:
    """(doc, spans): bytes lo to hi (exclusive) that lie in a string of length bytes which also starts elsewhere, for documents (doc, text)."""
    rows = common.saved(repeats.anchor_rows(docs, byte_codes, gram, length))
    found = common.saved(repeats.candidates(rows))
    common.dropped(rows, shuffles=True)
    both = common.saved(contexts(docs, found, length))
    common.dropped(found, shuffles=True)
    reach = common.saved(reaches(both.where("context IS NOT NULL"), length, gram, most_group))
    places = both.where("doc IS NOT NULL").select("key", "h", "doc", "anchor")
    spans = common.joined(places, reach, ["key", "h"], "places").select("doc", (F.col("anchor") - F.col("left")).alias("lo"), (F.col("anchor") + F.col("right")).alias("hi"))
    spans = common.saved(spans.distinct())
    common.dropped(both, reach, shuffles=True)
    return repeats.by_document(spans)


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text, and spans of bytes to remove (null: none).

    A null or empty text has no bytes. Rows repeat each other like any documents: of two rows with equal texts of length bytes
    or more, all bytes go. Null and repeated doc_ids are ids like any other: inside, a row goes by the hash of its id and text,
    and one too short to lose anything by a number of its own, so that such rows don't meet in one task. A text of any length is
    one row, held by one task with its spans. Only doc_id and text are read.
    """
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = numbered.withColumn("doc", repeats.row_name(F.octet_length("text") >= length))
    return rows.join(removal_spans(rows.select("doc", "text"), length).hint("merge"), "doc", "left").drop("doc")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make():
        def fn(ids, texts, spans):
            out = [[] for _ in range(4)]
            for text, at in zip(common.as_bytes(texts), spans.to_pylist()):
                text = text or b""
                runs = repeats.merged([(s["lo"], s["hi"]) for s in at or ()])
                kept, done = [], 0
                for a, b in runs:
                    kept.append(text[done:a])
                    done = b
                kept = b"".join(kept) + text[done:]
                for values, x in zip(out, (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())):
                    values.append(x)
            return ids, *out

        return fn

    return common.map_columns(removed(common.table(spark, sf_dir, "documents")), ["doc_id", "text", "spans"], make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", rows=256)
