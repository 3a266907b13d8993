"""Token counts by a compiled tokenizer (operator 9).

The vocabulary and the split pattern are compiled, on demand, into one deterministic transducer over bytes, whose transitions
carry the number of tokens that they emit (byte_transducer); what a whole word emits is remembered. A text is cut into chunks. A chunk is a map from the state at its
start to the state at its end and the tokens between: white space leads every state to the same one, so the map is held as the
bytes before the first white space, which are read from whatever state comes in, and what follows, which is known. A chunk
without white space is read from the state that the bytes before it suggest, and again only if another state comes in. Maps
compose associatively: in a tree inside a task, and in chunk order over the chunks of a text that was dealt over tasks. Words
beyond printable ASCII, or with special tokens' marks, pass the library's normaliser and splitter first and are counted whole.
"""

from __future__ import annotations

import ast
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import common
from .bpe_transducer import Memo, encoder
from .byte_transducer import SPACE, Machine, Node

CHUNK_BYTES = 1 << 16
#: A longer text is dealt over tasks, in chunks of as many bytes.
DEALT_BYTES = 1 << 20
#: Bytes before a chunk from which its start state is guessed.
WARM_BYTES = 256
LIMIT = 2048
#: Longer words aren't remembered, which bounds a memo's bytes.
MEMO_BYTES = 256
#: The transducer reads these alone.
PLAIN = bytes(range(33, 127)) + SPACE
MARK = b"<|"


class Chunk(NamedTuple):
    """The map of some text. Without white space (end is None) all of it is head."""

    head: bytes  # the unfinished word at the start
    guess: object  # a state in which head was read, the state behind it, and the tokens; or None
    behind: object
    within: int
    count: int  # tokens of the whole words
    tail: bytes  # the unfinished word at the end
    end: object  # the state after tail, or None if it has other than plain bytes; False without white space
    pending: int  # tokens of tail so far


class Counter:
    """Counts by one vocabulary file; one for each worker process."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        self.machine = Machine(self.encoder.transducer)
        self.memo = Memo(self.encoder.count)
        #: What stands before a text: a white space, so to say.
        self.nothing = Chunk(b"", None, None, 0, 0, b"", self.machine.start, 0)

    def word(self, word: bytes) -> int:
        """A whole word: from white space to white space, so the composed transition needs no state to be remembered by."""
        if len(word) <= MEMO_BYTES:
            return self.memo[word]
        if not self.plain(word):
            return self.encoder.count(word)
        state, n = self.machine.read(self.machine.start, word)
        return n + state.close

    @staticmethod
    def plain(text: bytes) -> bool:
        return not text.translate(None, PLAIN) and MARK not in text

    def words(self, text: bytes) -> int:
        return sum(map(self.word, text.split()))

    def chunk(self, text: bytes, warm: bytes = b"") -> Chunk:
        """The map of a chunk; warm is what stands before it."""
        first = min((i for i in map(text.find, _SPACES) if i >= 0), default=None)
        if first is None:
            if not text or not self.plain(warm + text):
                return Chunk(text, None, None, 0, 0, b"", False, 0)
            guess, _ = self.machine.read(self.machine.start, warm)
            behind, n = self.machine.read(guess, text)
            return Chunk(text, guess, behind, n, 0, b"", False, 0)
        last = max(map(text.rfind, _SPACES)) + 1
        return Chunk(text[:first], None, None, 0, self.words(text[first:last]), *self.opened(text[last:]))

    def opened(self, word: bytes) -> tuple:
        """(word, state after it, tokens so far) of an unfinished word."""
        if not self.plain(word):
            return word, None, 0
        return word, *self.machine.read(self.machine.start, word)

    def through(self, word: bytes, state, pending: int, c: Chunk) -> tuple:
        """An unfinished word (bytes, state, tokens so far), and the head of the chunk that follows."""
        whole = word + c.head
        # a mark can stand across the border
        if state is None or not self.plain(word[-1:] + c.head):
            return whole, None, 0
        if c.guess is not None and c.guess.key == state.key:
            return whole, c.behind, pending + c.within
        state, n = self.machine.read(state, c.head)
        return whole, state, pending + n

    def finished(self, word: bytes, state, pending: int) -> int:
        if not word:
            return 0
        return self.word(word) if state is None else pending + state.close

    def compose(self, a: Chunk, b: Chunk) -> Chunk:
        """The map of two neighbouring chunks."""
        if a.end is False and b.end is False:
            if a.guess is None or b.guess is None or MARK in a.head[-1:] + b.head[:1]:
                return Chunk(a.head + b.head, None, None, 0, 0, b"", False, 0)
            _, behind, n = self.through(a.head, a.behind, a.within, b)
            return Chunk(a.head + b.head, a.guess, behind, n, 0, b"", False, 0)
        if a.end is False:
            return b._replace(head=a.head + b.head, guess=None)
        word, state, pending = self.through(a.tail, a.end, a.pending, b)
        if b.end is False:
            return a._replace(tail=word, end=state, pending=pending)
        return b._replace(head=a.head, guess=None, count=a.count + self.finished(word, state, pending) + b.count)

    def total(self, c: Chunk) -> int:
        """Tokens of a whole text, from its map."""
        whole = self.compose(self.nothing, c)
        return whole.count + self.finished(whole.tail, whole.end, whole.pending)

    def scan(self, text: bytes, size: int = CHUNK_BYTES) -> int:
        """Tokens of a text, from its chunks' maps, composed pairwise."""
        if len(text) <= size:
            return self.words(text)
        return self.total(self.tree([self.chunk(text[at : at + size], text[max(0, at - WARM_BYTES) : at]) for at in range(0, len(text), size)]))

    def tree(self, maps: list[Chunk]) -> Chunk:
        while len(maps) > 1:
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def to_row(self, c: Chunk) -> tuple:
        """A map without objects: states by their names."""
        name = lambda s: repr(s.key) if isinstance(s, Node) else None
        return c.head, name(c.guess), name(c.behind), c.within, c.count, c.tail, c.end is not False, name(c.end), c.pending

    def from_row(self, head, guess, behind, within, count, tail, spaced, end, pending) -> Chunk:
        state = lambda name: self.machine.node(ast.literal_eval(name)) if name else None
        return Chunk(head, state(guess), state(behind), within, count, tail, state(end) if spaced else False, pending)


_SPACES = [bytes([b]) for b in SPACE]
_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


PIECE = "row long, chunk int, bytes long, warm binary, part binary"
MAP = "head binary, guess string, behind string, within long, count long, tail binary, spaced boolean, at string, pending long"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def counted(docs: DataFrame, tokenizer: str, text: str, key: str, dealt: int) -> DataFrame:
    """(key, bytes, tokens) of each text, and instead of a count the chunks of each text of more than dealt bytes, under a number of the row."""
    ddl = f"k {docs.schema[key].dataType.simpleString()}, n long, {PIECE}"
    out = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches):
        count, number = counter(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, common.SLICE_ROWS):
                part = batch.slice(at, common.SLICE_ROWS)
                rows, held = [], 0
                for k, x in zip(part.column(0).to_pylist(), common.as_bytes(part.column(1))):
                    x = x or b""
                    if len(x) <= dealt:
                        rows.append((k, count.scan(x), None, None, len(x), None, None))
                        continue
                    number += 1
                    for i, lo in enumerate(range(0, len(x), dealt)):
                        rows.append((k, None, number, i, len(x), x[max(0, lo - WARM_BYTES) : lo], x[lo : lo + dealt]))
                        held += dealt
                        if held > 32 << 20:
                            yield _batch(rows, out)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, out)

    return docs.select(key, text).mapInArrow(run, ddl)


def composed(pieces: DataFrame, tokenizer: str) -> DataFrame:
    """(k, bytes, n) of each row's chunks: tasks make the chunks' maps, and one goes through a row's maps in order, holding one of them."""
    kind = pieces.schema["k"].dataType.simpleString()
    ddl = f"k {kind}, row long, chunk int, bytes long, {MAP}"
    out, final = to_arrow_schema(T.StructType.fromDDL(ddl)), to_arrow_schema(T.StructType.fromDDL(f"k {kind}, bytes long, n long"))

    def maps(batches):
        count = counter(tokenizer)
        for batch in batches:
            for at in range(batch.num_rows):
                k, row, chunk, n, warm, part = (batch.column(i)[at].as_py() for i in range(6))
                cut = [count.chunk(part[lo : lo + CHUNK_BYTES], (warm + part[: lo])[-WARM_BYTES:] if lo < WARM_BYTES else part[lo - WARM_BYTES : lo]) for lo in range(0, len(part), CHUNK_BYTES)]
                yield _batch([(k, row, chunk, n, *count.to_row(count.tree(cut)))], out)

    def merge(batches):
        count, of, so_far = counter(tokenizer), None, None
        for batch in batches:
            for at in range(batch.num_rows):
                k, row, _, n, *rest = (batch.column(i)[at].as_py() for i in range(batch.num_columns))
                c = count.from_row(*rest)
                if of is None or of[0] != row:
                    if of is not None:
                        yield _batch([(*of[1:], count.total(so_far))], final)
                    so_far = count.nothing
                so_far, of = count.compose(so_far, c), (row, k, n)
        if of is not None:
            yield _batch([(*of[1:], count.total(so_far))], final)

    each = pieces.select("k", "row", "chunk", "bytes", "warm", "part").repartition("row", "chunk").mapInArrow(maps, ddl)
    return each.repartition("row").sortWithinPartitions("row", "chunk").mapInArrow(merge, f"k {kind}, bytes long, n long")


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", limit: int = LIMIT, dealt: int = DEALT_BYTES) -> DataFrame:
    """One row for each row of docs: its key, bytes, tokens, and whether these exceed limit.

    A null text counts as empty: 0 bytes, 0 tokens. Null keys and repeated rows stay as they are. Texts of more than dealt bytes
    are counted in chunks, by many tasks, with the same result; a word that isn't plain is held whole, however long. Other
    columns aren't read.
    """
    each = common.saved(counted(docs, tokenizer, text, key, dealt))
    whole = each.where("row IS NULL").select("k", "bytes", "n").unionByName(composed(each.where("row IS NOT NULL"), tokenizer))
    return whole.select(F.col("k").alias(key), F.col("bytes").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
