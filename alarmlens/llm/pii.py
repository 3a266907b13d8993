"""Personal data: patterns, and a skip-chain conditional random field over tokens (operator 5).

The patterns find email addresses, IP addresses, card and phone numbers. The field labels every token that looks like personal
data at all. Its unary, chain and skip potentials are fitted by gradient on a bounded sample of documents, where the patterns'
spans are the labels (pseudo-likelihood; each document counts a second time with its tokens' own features masked, so that
links must carry labels). Chain links join neighbours, skip links join distant tokens that repeat or resemble each other, and
loopy message passing makes their labels agree: a value that the patterns catch once is found in the other ways it is written.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Digits are taken possessively, from where a run of them begins: the same matches, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A numeric token of the field; its other tokens are words that hold an @ or a written-out one.
NUMERIC = re.compile(r"[+(]?[0-9](?:[0-9 ()./_-]*[0-9])?")
#: A written-out @, and what follows it; the words before it are found from there, so that each character is looked at once.
WRITTEN_AT = re.compile(r" ?[\[(][Aa][Tt][\])]")
WRITTEN_DOMAIN = re.compile(r" ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(][Dd][Oo][Tt][\])] ?)[A-Za-z0-9-]+)*")
ANY = re.compile(r"[0-9]{3}|@|[\[(][aA][tT][\])]")
SPACE = re.compile(r"\s")
#: Labelled documents that the field is fitted on at most: of the SCANNED_DOCS (about) with the smallest hashes, the first that hold a token of the field.
SAMPLE_DOCS, SCANNED_DOCS = 2000, 40_000
#: Features are hashed into so many weights a label.
FEATURES = 1 << 15
CHAIN, REPEAT, SIMILAR = range(3)
#: Mean of the links' Gaussian prior: no preference for neighbours, agreement of repeated and of similar tokens.
LINK_PRIOR = np.stack([weight * np.eye(len(LABELS)) for weight in (0.0, 3.0, 3.0)])
STEPS, RATE, DECAY = 150, 0.3, 0.3
ROUNDS = 8
#: What is added to a span must be this probable.
LEAST = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """An @ whose right side is a domain, with all of the address's characters before it: linear in the text."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_SET:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
        done = out[-1][1] if out and out[-1][1] > at else at + 1
        at = text.find("@", done)
    return out


def written_addresses(text: str) -> list[tuple[int, int]]:
    """Addresses with a bracketed at: linear in the text, as emails() is."""
    out, done = [], 0
    at = WRITTEN_AT.search(text)
    while at:
        start, end = at.start(), at.end()
        while start > done and text[start - 1] in LOCAL_SET:
            start -= 1
        if start < at.start() and (m := WRITTEN_DOMAIN.match(text, end)):
            out.append((start, m.end()))
            end = m.end()
        done = end
        at = WRITTEN_AT.search(text, done)
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind: leftmost, non-overlapping; matches that fail their check are dropped."""
    out: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out[1].append(m.span())
    for m in CARD.finditer(text):
        if len(m[0]) >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out[2].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out[3].append(m.span())
    return out


def features(text: str, start: int, end: int) -> list[int]:
    """What a token of the field looks like, and the words around it, as places in the table of weights."""
    token = text[start:end]
    digits = _digits(token)
    before, after = text[max(0, start - 32) : start].split(), text[end : end + 24].split()
    plain = lambda words, i: re.sub(r"[^a-z]", "", words[i].lower()) if -len(words) <= i < len(words) else ""
    names = (
        "shape:" + re.sub(r"(.)\1+", r"\1", re.sub(r"[A-Za-z\u0080-\uffff]", "a", re.sub(r"[0-9]", "9", token)))[:24],
        f"digits:{min(len(digits), 20)}",
        f"dots:{min(token.count('.'), 5)}",
        f"at:{'@' in token}",
        f"domain:{bool(DOMAIN.fullmatch(token.rpartition('@')[2]))}",
        f"plus:{token[0] == '+'}",
        f"luhn:{13 <= len(digits) <= 19 and luhn(digits)}",
        f"bytes:{token.count('.') == 3 and all(p.isdigit() and int(p[-4:]) <= 255 for p in token.split('.'))}",
        "before:" + plain(before, -1),
        "before2:" + plain(before, -2),
        "after:" + plain(after, 0),
    )
    return [xxhash.xxh32_intdigest(name) % FEATURES for name in names]


def _parts(run: str, at: int) -> list[tuple[int, int]]:
    """A numeric run with seven digits or more; one too long for any number is cut around its groups of 12 digits or more."""
    if len(_digits(run)) <= 19:
        return [(at, at + len(run))] if len(_digits(run)) >= 7 else []
    out: list[list[int]] = []
    for m in re.finditer(r"[^ ]+", run):
        long = len(_digits(m[0])) >= 12
        if out and not long and not out[-1][2]:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end(), long])
    return [(at + a, at + b) for a, b, _ in out if len(_digits(run[a:b])) >= 7]


def candidates(text: str) -> list[tuple[int, int]]:
    """Words that hold an @ or a written-out one, and numeric runs of seven digits or more outside them."""
    if not ANY.search(text):
        return []
    words, at = [], text.find("@")
    while at >= 0:
        a = at
        while a and not text[a - 1].isspace():
            a -= 1
        m = SPACE.search(text, at)
        b = m.start() if m else len(text)
        words.append((a, b))
        at = text.find("@", b)
    if "(" in text or "[" in text:
        taken = [a for a, _ in words]
        for a, b in written_addresses(text):
            i = bisect.bisect_right(taken, b - 1) - 1
            if i < 0 or words[i][1] <= a:
                words.append((a, b))
        words.sort()
    numbers = [s for m in NUMERIC.finditer(text) if len(m[0]) >= 7 for s in _parts(m[0], m.start())]
    if not words:
        return numbers
    starts = [a for a, _ in words]
    outside = []
    for a, b in numbers:
        i = bisect.bisect_right(starts, b - 1) - 1
        if i < 0 or words[i][1] <= a:
            outside.append((a, b))
    return sorted(words + outside)


def label_of(span: tuple[int, int], base: list[list[tuple[int, int]]]) -> int:
    """The kind of the pattern span that covers most of a candidate's characters, 0 without one."""
    best, kind = 0, 0
    for k, spans in enumerate(base, 1):
        for a, b in spans:
            shared = min(b, span[1]) - max(a, span[0])
            if shared > best:
                best, kind = shared, k
    return kind


class Field:
    """Log potentials: a bias and one weight for each feature and label, and a matrix for each kind of link."""

    def __init__(self, bias: np.ndarray, weights: np.ndarray, links: np.ndarray):
        self.bias, self.weights, self.links = bias, weights, links

    def unary(self, found: list[list[int]]) -> np.ndarray:
        return self.bias + np.array([self.weights[x].sum(axis=0) for x in found])

    def marginals(self, unary: np.ndarray, edges: list[tuple[int, int, int]], rounds: int = ROUNDS) -> np.ndarray:
        """Beliefs after loopy message passing over the links (from, to, kind), damped, for a fixed number of rounds."""
        if edges:
            a, b, kind = np.array(edges).T
            back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
            potential = np.concatenate([self.links[kind], self.links[kind].transpose(0, 2, 1)])
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
            messages = np.zeros((len(a), len(LABELS)))
            for _ in range(rounds):
                into = np.zeros_like(unary)
                np.add.at(into, b, messages)
                sent = (unary + into)[a] - messages[back]
                new = np.logaddexp.reduce(sent[:, :, None] + potential, axis=1)
                new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
                messages = 0.5 * messages + 0.5 * new
            unary = unary.copy()
            np.add.at(unary, b, messages)
        out = np.exp(unary - unary.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def _names(token: str) -> tuple[str, list[str]]:
    """What repeats of a token have in common (its letters, digits and @), and keys that similar tokens share: the last or first digits, or parts of an address."""
    token = re.sub(r" ?[\[(]dot[\])] ?", ".", re.sub(r" ?[\[(]at[\])] ?", "@", token.lower()))
    whole = re.sub(r"[^0-9a-z@]", "", token)
    if "@" in token:
        local, _, domain = token.rpartition("@")
        parts = (re.sub(r"[^0-9a-z]", "", local), re.sub(r"[^0-9a-z-].*", "", domain))
        return whole, [f"{side}:{p}" for side, p in zip("ld", parts) if len(p) >= 3]
    return whole, [f"e:{whole[-7:]}", f"b:{whole[:7]}"] if len(whole) >= 10 else [f"e:{whole[-7:]}"]


def links(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Chain links between neighbours on one line, and skip links between tokens that repeat (but for punctuation or case) or resemble each other.

    Tokens of one key are linked in a row of consecutive ones, so that the number of links grows with the tokens alone.
    """
    found: dict[tuple[int, int], int] = {}
    last: dict[str, int] = {}
    wholes: list[str] = []
    for i, (a, b) in enumerate(spans):
        whole, keys = _names(text[a:b])
        wholes.append(whole)
        if whole in last:
            found[last[whole], i] = REPEAT
        for key in keys:
            if key in last and wholes[last[key]] != whole:
                found.setdefault((last[key], i), SIMILAR)
            last[key] = i
        last[whole] = i
        if i and a - spans[i - 1][1] <= 40 and "\n" not in text[spans[i - 1][1] : a]:
            found.setdefault((i - 1, i), CHAIN)
    return [(*pair, kind) for pair, kind in found.items()]


def trained(documents: list[tuple[list, list, list]], steps: int = STEPS) -> Field:
    """The field of greatest penalised pseudo-likelihood, for documents of (features by token, labels, links), by adaptive gradient steps.

    Each document counts twice, with its tokens' features and without. Tokens that are merely similar are rare, so each token
    also counts with a similar twin of its label as all that is known of it.
    """
    labels, tokens, places, edges = [], [], [], []
    for found, seen, joined in documents:
        edges += [(a + len(labels), b + len(labels), kind) for a, b, kind in joined]
        tokens += [len(labels) + i for i, x in enumerate(found) for _ in x]
        places += [p for x in found for p in x]
        labels += seen
    k = len(LABELS)
    params = [np.zeros(k), np.zeros((FEATURES, k)), LINK_PRIOR.copy()]
    means = [np.zeros(k), np.zeros((FEATURES, k)), LINK_PRIOR]
    if not labels:
        return Field(*params)
    y, tokens, places = np.array(labels), np.array(tokens), np.array(places)
    a, b, kind = np.array(edges, int).reshape(-1, 3).T
    truth, past = np.eye(k)[y], [np.full_like(x, 1e-6) for x in params]
    for _ in range(steps):
        bias, weights, between = params
        fixed = np.tile(bias, (len(y), 1))
        np.add.at(fixed, b, between[kind, y[a]])
        np.add.at(fixed, a, between[kind, :, y[b]])
        own = fixed.copy()
        np.add.at(own, tokens, weights[places])
        gradient = [np.zeros_like(x) for x in params]
        for scores, which in ((own, "whole"), (fixed, "masked"), (bias + between[SIMILAR, y], "twin")):
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            off = truth - p / p.sum(axis=1, keepdims=True)
            gradient[0] += off.sum(axis=0)
            if which == "twin":
                np.add.at(gradient[2][SIMILAR], y, off)
                continue
            np.add.at(gradient[2], (kind, y[a]), off[b])
            np.add.at(gradient[2].transpose(0, 2, 1), (kind, y[b]), off[a])
            if which == "whole":
                np.add.at(gradient[1], places, off[tokens])
        for x, g, mean, seen in zip(params, gradient, means, past):
            g -= DECAY * (x - mean)
            seen += g * g
            x += RATE * g / np.sqrt(seen)
    return Field(*params)


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, scanned_docs: int = SCANNED_DOCS) -> list[tuple[list, list, list]]:
    """Features, labels and links of at most sample_docs documents with tokens of the field.

    A document is scanned for them if its hash is among the smallest, scanned_docs of all or about as many. Tasks send no texts.
    """
    total = docs.count()
    h = F.xxhash64("doc_id", "text")
    some = docs.where(F.col("text").rlike("[0-9]{3}|@|[(\\[][aA][tT][)\\]]")).select(h.alias("h"), "text")
    if total > scanned_docs:
        some = some.where(F.col("h") < int((scanned_docs / total - 0.5) * 2.0**64))
    schema = "h long, features array<array<int>>, labels array<int>, links array<array<int>>"

    def make():
        def fn(hashes, texts):
            out = [[] for _ in range(4)]
            for key, text in zip(hashes.to_pylist(), texts.to_pylist()):
                spans = candidates(text)
                if spans:
                    base = base_spans(text)
                    for values, x in zip(out, (key, [features(text, *s) for s in spans], [label_of(s, base) for s in spans], links(text, spans))):
                        values.append(x)
            return out

        return fn

    rows = common.map_columns(some, ["h", "text"], make, schema).dropDuplicates(["h"]).orderBy("h").limit(sample_docs)
    return [(r.features, r.labels, r.links) for r in rows.collect()]


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, scanned_docs: int = SCANNED_DOCS) -> Field:
    """The field of a bounded sample of docs, whose labels are the patterns' spans."""
    return trained(sample(docs, sample_docs, scanned_docs))


def field_spans(text: str, base: list[list[tuple[int, int]]], field: Field) -> list[list[tuple[int, int]]]:
    """What the field adds: candidates, clear of all pattern spans, that it gives a kind with at least LEAST."""
    added: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    spans = candidates(text)
    if not spans:
        return added
    seen = [label_of(s, base) for s in spans]
    if all(seen):
        return added
    unary = field.unary([features(text, *s) for s in spans])
    for i, k in enumerate(seen):
        if k:  # a pattern's label is evidence
            unary[i] = np.where(np.arange(len(LABELS)) == k, 0.0, -50.0)
    beliefs = field.marginals(unary, links(text, spans))
    for span, k, p in zip(spans, seen, beliefs):
        best = int(p.argmax())
        if not k and best and p[best] >= LEAST:
            added[best - 1].append(span)
    return added


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, found in zip(KINDS, spans) for a, b in sorted(found))


def detect(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts by kind and base_sha256 of the patterns' spans, and all spans with the field's.

    A null or empty text has no spans. Null doc_ids and repeated rows stay. Long texts are read whole; patterns, tokens and
    links take time in proportion to the text. Of spans that begin together in a kind, the shorter comes first. Only doc_id and
    text are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        def fn(keys, texts):
            out = [[] for _ in range(6)]
            for text in texts.to_pylist():
                base = base_spans(text or "")
                both = [a + b for a, b in zip(base, field_spans(text or "", base, model.value))]
                for values, x in zip(out, (*map(len, base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(both))):
                    values.append(x)
            return keys, *out

        return fn

    return common.map_columns(docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"], make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str | None, field: Field) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans count as one, of the first's kind."""
    if not text:
        return text
    base = base_spans(text)
    found = sorted((a, b, kind) for kind, x, y in zip(KINDS, base, field_spans(text, base, field)) for a, b in x + y)
    out, done, reach = [], 0, 0
    for a, b, kind in found:
        if a >= reach:
            out += [text[done:a], f"[{kind}]"]
        done = reach = max(reach, b)
    return "".join(out) + text[done:]


def redact(docs: DataFrame) -> DataFrame:
    """docs, all columns, with personal data in text replaced; n_chars follows where there is such a column."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def make():
        def fn(batch):
            texts = [redacted(t, model.value) for t in common.column(batch, "text").to_pylist()]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            at = batch.schema.get_field_index("n_chars")
            if at >= 0:
                batch = batch.set_column(at, batch.schema.field(at), pa.array([None if t is None else len(t) for t in texts], batch.schema.field(at).type))
            return batch

        return fn

    return common.map_batches(docs, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return detect(docs, fit(docs))
