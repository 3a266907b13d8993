"""A byte-pair-encoding vocabulary compiled, on demand, into a deterministic transducer.

A word's encoding is the only sequence of tokens in which every two neighbours could not have merged across their border
at an earlier merge. So the last token of each prefix is determined by the last tokens of the prefixes before it, and a
state has to hold no more than these for the longest suffix that may still begin a token. Transitions carry the change of
the emitted-token count; a final transition reads the last symbol of a word, which has the word-end mark.
"""

from __future__ import annotations

import json
import re
from functools import cached_property

END = "</w>"
#: The contractions and classes of the vocabulary file's own split pattern, for words of ASCII and Latin-1 letters.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
SPECIALS = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
MOST_STATES = 200_000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in kept}
    out.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)})
    return [out[b] for b in range(256)]


class Transducer:
    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        ids = model["vocab"]
        far = self.far = len(ids)
        self.plain = {t: i for t, i in ids.items() if not t.endswith(END)}
        self.ending = {t[: -len(END)]: i for t, i in ids.items() if t.endswith(END)}
        self.rank: dict[tuple[int, int], int] = {}
        right: dict[int, list] = {}
        left: dict[int, list] = {}
        for t, i in ids.items():
            right[i] = left[i] = [(i, far)]
        for at, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            whole = ids[a + b]
            a, b = ids[a], ids[b]
            self.rank[a, b] = at
            # what can lie at the right (left) border of a token, and the merge that takes it inside
            right[whole] = [(whole, far), (b, at), *right[b][1:]]
            left[whole] = [(whole, far), (a, at), *left[a][1:]]
        self.right, self.left = right, left
        self.prefixes = {t[:n] for t in self.plain for n in range(1, len(t))} | {t[:n] for t in self.ending for n in range(1, len(t))}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state(("", (-1,), (0,)))

    def _state(self, key: tuple) -> State:
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = State(self, key)
        return state

    def _split(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, stay two tokens."""
        found = self._pairs.get((a, b))
        if found is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            rank, lefts = self.rank, self.left[b]
            found = True
            for x, gone in self.right[a]:
                for y, taken in lefts:
                    at = rank.get((x, y))
                    if at is not None and at < gone and at <= taken:
                        found = False
            self._pairs[a, b] = found
        return found

    def _last(self, text: str, key: tuple, tokens: dict[str, int]) -> tuple[int, int]:
        """The last token of the prefix that ends with text, and the count's change."""
        _, lasts, counts = key
        for n in range(len(text), 0, -1):
            token = tokens.get(text[-n:])
            if token is not None and ((before := lasts[n - 1]) < 0 or self._split(before, token)) and self._reachable(token):
                return token, counts[n - 1] + 1
        raise ValueError(f"{text!r} can't be encoded")

    def _reachable(self, token: int) -> bool:
        """Whether the token's own text is encoded as this one token."""
        found = self._whole.get(token)
        if found is None:
            found = True
            if len(self.left[token]) > 1:
                (a, at), (b, _) = self.left[token][1], self.right[token][1]
                for x, gone in self.right[a]:
                    for y, taken in self.left[b]:
                        m = self.rank.get((x, y))
                        if m is not None and m < at and m < gone and m <= taken:
                            found = False
                found = found and self._reachable(a) and self._reachable(b)
            self._whole[token] = found
        return found

    def step(self, key: tuple, symbol: str) -> tuple[State, int, int]:
        """The state after one more symbol, the count's change and the last token."""
        suffix, lasts, counts = key
        text = suffix + symbol
        token, change = self._last(text, key, self.plain)
        n = len(text)
        while n and text[-n:] not in self.prefixes:
            n -= 1
        return self._state((text[-n:] if n else "", (token, *lasts[:n]), (0, *(c - change for c in counts[:n])))), change, token

    def end(self, key: tuple, symbol: str) -> tuple[int, int]:
        return self._last(key[0] + symbol, key, self.ending)

    def _begin(self) -> State:
        if len(self.states) > MOST_STATES:
            self._reset()
        return self.start

    def count(self, piece: str) -> int:
        """Tokens of one piece (a word's symbols): the transitions' counts, summed."""
        state, n = self._begin(), 0
        for symbol in piece[:-1]:
            state, change, _ = state[symbol]
            n += change
        return n + state.final[piece[-1]][1]


class State(dict):
    """Transitions by symbol, compiled when they are first taken; final has those of a word's last symbol."""

    __slots__ = ("final", "key", "owner")

    def __init__(self, owner: Transducer, key: tuple):
        self.owner, self.key, self.final = owner, key, Final(owner, key)

    def __missing__(self, symbol: str):
        out = self[symbol] = self.owner.step(self.key, symbol)
        return out


class Final(dict):
    __slots__ = ("key", "owner")

    def __init__(self, owner: Transducer, key: tuple):
        self.owner, self.key = owner, key

    def __missing__(self, symbol: str):
        out = self[symbol] = self.owner.end(self.key, symbol)
        return out


class WordEncoder:
    """Words (bytes without ASCII white space) to pieces of symbols, as the vocabulary file's normaliser and splitter make them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        library = Tokenizer.from_file(path)
        self.model = library.model
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.symbols = {b: c for b, c in enumerate(byte_symbols())}
        self.piece_ids = Memo(lambda piece: [t.id for t in self.model.tokenize(piece)], 100_000)

    @cached_property
    def transducer(self) -> Transducer:
        return Transducer(self.path)

    def parts(self, word: bytes) -> list[str | int]:
        """The word's pieces of symbols, and the ids of special tokens."""
        text = word.decode("utf-8", "replace")
        if text.isascii() and text.isalpha():
            return [text.lower()]
        if "<|" in text:
            return [p for t in SPECIALS.split(text) if t for p in ([self.special[t]] if t in self.special else self.pieces(t))]
        return self.pieces(text)

    def pieces(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text):
            found = PIECES.findall(text.lower())
            return found if text.isascii() else [p.encode().decode("latin-1").translate(self.symbols) for p in found]
        return [p for p, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text)) if p]

    def count(self, word: bytes) -> int:
        n, count = 0, self.transducer.count
        for p in self.parts(word):
            n += 1 if isinstance(p, int) else count(p)
        return n

    def ids(self, word: bytes) -> list[int]:
        """The word's ids, each piece's by the library's own model."""
        out: list[int] = []
        for p in self.parts(word):
            out += [p] if isinstance(p, int) else self.piece_ids[p]
        return out


class Memo(dict):
    """Results by word. When they are many, the older half goes; words that are met again stay."""

    def __init__(self, make, most: int = 250_000):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: bytes):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
        self[word] = out
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process, which runs many tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
