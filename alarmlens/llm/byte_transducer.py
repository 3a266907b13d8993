"""The split pattern and the vocabulary's transducer as one machine over the bytes of printable ASCII.

A state is what the machine has to remember: the kind of piece that it is in, the vocabulary's state before the piece's last
byte, and that byte, which is read when it is known whether the piece ends there. A transition has the next state and the
tokens emitted on the way. Both are compiled when a byte is first met in a state.
"""

from __future__ import annotations

from .bpe_transducer import Transducer

SPACE = b" \t\n\r\x0b\x0c"
MOST_NODES = 100_000
#: What may follow an apostrophe that begins a piece, by the vocabulary file's own split pattern, and how it ends.
SHORT = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}


class Node(dict):
    """A state's transitions by byte; close has the tokens that the text's end emits."""

    __slots__ = ("close", "key", "owner")

    def __init__(self, owner: Machine, key: tuple):
        self.owner, self.key = owner, key
        self.close = owner.emitted(key)

    def __missing__(self, byte: int):
        found = self[byte] = self.owner.step(self.key, chr(byte).lower())
        return found


class Machine:
    """Keys: () between pieces; (letters, vocabulary's state, last byte) in a piece of letters or of other bytes; ("'",) and ("'", c) in what may be a contraction."""

    def __init__(self, transducer: Transducer):
        self.vocabulary = transducer
        self.nodes: dict[tuple, Node] = {}
        self._begun = transducer.start.key
        self.start = self.nodes[()] = Node(self, ())

    def node(self, key: tuple) -> Node:
        found = self.nodes.get(key)
        if found is None:
            if len(self.nodes) >= MOST_NODES:
                self.nodes = {(): self.start}
                self.start.clear()
            found = self.nodes[key] = Node(self, key)
        return found

    def emitted(self, key: tuple) -> int:
        """Tokens of the unfinished piece that no transition has counted yet."""
        if not key:
            return 0
        if key[0] == "'":
            return self.vocabulary.count("'") + (self.vocabulary.count(key[1]) if len(key) > 1 else 0)
        _, state, last = key
        return self.vocabulary.end(state, last)[1]

    def step(self, key: tuple, c: str) -> tuple[Node, int]:
        if c.encode() in SPACE_SET:
            return self.start, self.emitted(key)
        letter, digit = "a" <= c <= "z", "0" <= c <= "9"
        if not key:
            if digit:
                return self.start, self.vocabulary.count(c)
            return self.node(("'",) if c == "'" else (letter, self._begun, c)), 0
        if key == ("'",):
            if c in SHORT:
                return (self.node(("'", c)), 0) if SHORT[c] else (self.start, self.vocabulary.count("'" + c))
            key = (False, self._begun, "'")
        elif key[0] == "'":
            if c == SHORT[key[1]]:
                return self.start, self.vocabulary.count("'" + key[1] + c)
            node, n = self.step((True, self._begun, key[1]), c)
            return node, n + self.vocabulary.count("'")
        kind, state, last = key
        if digit or letter != kind or kind and c == "'":
            node, n = self.step((), c)
            return node, n + self.emitted(key)
        after, change, _ = self.vocabulary.step(state, last)
        return self.node((kind, after.key, c)), change

    @staticmethod
    def read(state: Node, text: bytes) -> tuple[Node, int]:
        n = 0
        for byte in text:
            state, emitted = state[byte]
            n += emitted
        return state, n


SPACE_SET = frozenset(bytes([b]) for b in SPACE)
