"""The training-data operators against plain versions, and on awkward rows."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alarmlens.llm import (
    common,
    components,
    decontamination,
    language_id,
    media_avi,
    near_duplicates,
    packing,
    pii,
    repeats,
    substring_dedup,
    suffix_dedup,
    token_counts,
    url_filters,
)

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SMALL, MEDIUM, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, component_id long"
PASSAGE = " ".join(f"shared{i}" for i in range(70))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "s"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "s"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it", "en", "s"),
    (3, "", "en", "s"),
    (4, None, None, None),
    (None, "no id but text, mail a@b.co", None, "s"),
    (None, None, None, None),
    (5, LONG, "en", "hot"),
    (6, f"first {PASSAGE} end", "en", "hot"),
    (7, f"second one {PASSAGE} tail {PASSAGE}", "en", "hot"),
    (8, "\t \n", "en", "hot"),
    (9, "ΣΊΣΥΦΟΣ İstanbul it's <|endoftext|> don't 123 \x1c 日本語 éé", "en", "s"),
    (10, "ip 10.0.0.255 and 300.1.1.1, card 4111 1111 1111 1111, +1 (212) 555-0199, x.y@z.example.com 4111111111111111", "en", "s"),
    (11, "card 4111-1111-1111-1112 call +12 12", "fr", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 5, "x", 7) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(rows, *names):
    return sorted([tuple(r[n] for n in names) for r in rows.collect()], key=repr)


def plain_words(text):
    return (text or "").encode().split()


def test_token_counts(docs, empty):
    library = Tokenizer.from_file(VOCABULARY)
    want = sorted([(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in ROWS], key=repr)
    assert by_id(token_counts.token_counts(docs, VOCABULARY), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(empty, VOCABULARY).count() == 0


def library_count(text):
    return len(Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids)


def test_byte_transducer_splits_as_the_library(docs):
    count, library = token_counts.counter(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list(letters), rng.integers(0, 40))) for letters in ("'srvelmdt", "'sRe1 \"", "ab' .1\n", "the'll-09 ", "<|>startofex ") for _ in range(300)]
    texts += ["<|startoftext|>", "a<|endoftext|>b c", "it''s 'rex 'vest 'lad ''ll 'l 'r", "don't WE'LL i'm 'Re", "x\x00y \x7f", "", " ", "'"]
    assert [count.scan(t.encode()) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_chunks_compose(docs):
    count = token_counts.counter(VOCABULARY)
    for text in (ROWS[11][1] + " " + ROWS[0][1] + "\n\n" + "unbroken" * 20, "can't'll" * 30 + "é ü" + "x" * 99, "a<|endoftext|>b c<|" * 3, "ab" * 150, "ünbroken" * 30):
        raw, whole = text.encode(), library_count(text)
        assert all(count.scan(raw, size) == whole for size in range(1, 40))
        for size in (1, 7, 30):
            maps = [count.from_row(*count.to_row(count.chunk(raw[at : at + size], raw[max(0, at - 5) : at]))) for at in range(0, len(raw), size)]
            left = right = maps[0]
            for c in maps[1:]:
                left = count.compose(left, c)
            right = maps[-1]
            for c in maps[-2::-1]:
                right = count.compose(c, right)
            assert count.total(left) == count.total(right) == whole


def test_long_texts_are_dealt_over_tasks(spark, docs):
    rng = np.random.default_rng(8)
    unbroken = "".join(r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()).encode().translate(None, b" \t\n\r\x0b\x0c" + bytes(range(128, 256))).decode()
    long = [(unbroken * (1 + (5 << 20) // len(unbroken)))[: 5 << 20], "ab" * 70_000, "".join(rng.choice(list("abc de'st\n"), 200_000)), "naïve words " * 9_000 + "é" * 1_000, "z" * 100_000]
    rows = [(i, t) for i, t, *_ in ROWS] + [(None, long[1]), (1, long[1])] + list(enumerate(long))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    library = Tokenizer.from_file(VOCABULARY)
    want = sorted([(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows], key=repr)
    names = ("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert by_id(token_counts.token_counts(df, VOCABULARY), *names) == want
    shorter = df.where(F.coalesce(F.length("text"), F.lit(0)) < 1 << 20)
    assert by_id(token_counts.token_counts(shorter, VOCABULARY, dealt=1 << 16), *names) == [x for x in want if x[1] < 1 << 20]
    assert len(long[0]) == 5 << 20 and len(long[0].split()) == 1


def test_packing(docs, empty):
    library = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack(docs, VOCABULARY).collect()
    ids = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length <= 4096
        ids[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    for i, t, *_ in ROWS:
        want = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        got = sorted(ids[i, len(want)])
        assert sum((x for _, x in got), [])[: len(want)] == want or i in (2, None)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 4096
    digests = packing.pack(docs, VOCABULARY, digest=True)
    crc = sorted((r.doc_id or 0, r.start, zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))) for r in rows)
    assert sorted((r.doc_id or 0, r.start, r.ids_crc32) for r in digests.collect()) == crc
    assert packing.pack(empty, VOCABULARY).count() == 0
    whole = packing.sequences(packing.pack(docs, VOCABULARY)).collect()
    assert all(len(r.ids) == 4096 or len(r.ids) == r.n_tokens and not r.n_tokens & (r.n_tokens - 1) for r in whole)


def test_packing_with_digests_keeps_ids(docs):
    rows = packing.pack(docs, VOCABULARY, digest=True).collect()
    assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) for r in rows)
    key = lambda r: (repr(r.doc_id), r.start, r.ids)
    assert sorted(map(key, rows)) == sorted(map(key, packing.pack(docs, VOCABULARY).collect()))
    assert sum(len(r.ids) for r in packing.sequences(packing.pack(docs, VOCABULARY, digest=True)).collect()) >= sum(r.length for r in rows)


def test_packing_groups_are_bounded_in_bytes(docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 64)
    assert len({r.sequence_id >> 32 for r in packing.pack(docs, VOCABULARY).collect()}) > 1


def test_first_fit_decreasing_is_first_fit():
    sizes = np.random.default_rng(3).integers(1, 4097, 500)
    bins, offsets = packing.first_fit_decreasing(sizes)
    free = []
    for i in np.argsort(-sizes, kind="stable"):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(free))
        if k == len(free):
            free.append(4096)
        assert (bins[i], offsets[i]) == (k, 4096 - free[k])
        free[k] -= sizes[i]


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "FOX jumps, over the LAZY dog and runs away from it all"), (2, "no id but"), (2, "no id but"), (3, None), (None, "istanbul"), (4, "!!")], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    windows = {(w[k : k + 10] and tuple(w[k : k + 10])): str(i) if i is not None else "null" for i, t in [(r.item_id, r.text) for r in items.collect()] for w in [word.findall(lower(t))] for k in range(max(1, len(w) - 9)) if w}
    want = []
    for i, t, *_ in ROWS:
        w, hit, who = word.findall(lower(t)), set(), set()
        for k in range(len(w)):
            for x, item in windows.items():
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    who.add(item)
        want.append((i, len(w), sorted(hit), sorted(who)))
    for bound in (1 << 20, 1):  # one automaton, and several
        assert by_id(decontamination.scan(docs, items, bound), "doc_id", "n_words", "hits", "items") == sorted(want, key=repr)
    assert decontamination.scan(empty, items).count() == 0 and decontamination.scan(docs, items.where("false")).where(F.size("hits") > 0).count() == 0
    for bound in (1 << 20, 1):
        kept = decontamination.keep_clean(docs, items, bound)
        assert kept.columns == docs.columns and kept.count() == sum(not x[2] for x in want)
    for r in decontamination.spans(decontamination.scan(docs, items)).collect():
        assert sum(len(word.findall(lower(r.text[s.start : s.end]))) for s in r.hit_spans) == len(r.hits)


def test_blocks_bound_the_automaton(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{(i * 37 + k) % 501}" for k in range(60))) for i in range(30)], "item_id long, text string")
    parts = decontamination.blocks(items, 300)
    scanners = [decontamination.Scanner(b.value.value) for b in parts]
    assert len(parts) > 4 and all(len(s.automaton) <= 300 for s in scanners)
    assert decontamination.pieces([b"w"] * 2000)[-1] == (b" ".join([b"w"] * 464), 455) and sum(n for _, n in decontamination.pieces([b"w"] * 2000)) == 1991
    words = [f"w{k % 501}".encode() for k in range(700)]
    got = [s.scan(words) for s in scanners]
    whole = decontamination.Scanner([(str(r.item_id), r.text.encode()) for r in items.collect()]).scan(words)
    assert (sorted({x for h, _ in got for x in h}), sorted({x for _, w in got for x in w})) == whole


def test_decontamination_query_equals_brute_force(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    folded = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    owners = defaultdict(set)
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = folded(r.text)
        for k in range(max(1, len(w) - 9) if w else 0):
            owners[tuple(w[k : k + 10])].add(str(r.item_id))
    want = []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        w, hit, who = folded(r.text), set(), set()
        for n in {len(x) for x in owners}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in owners:
                    hit.update(range(k, k + n))
                    who |= owners[tuple(w[k : k + n])]
        want.append((r.doc_id, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    assert by_id(decontamination.query(spark, SMALL), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)


def test_personal_data(docs, empty):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        n = re.sub("[^0-9]", "", m)
        luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(n)))) % 10 == 0 if n else False
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 13 <= len(n) <= 19 and luhn, "phone": 9 <= len(n) <= 15}[kind]

    field = pii.fit(docs)
    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.detect(docs, field).collect()}
    for i, t, *_ in ROWS:
        spans = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t or "") if good(k, m[0])]
        assert (i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), *(sum(s[0] == k for s in spans) for k in patterns)) in got
    assert pii.detect(empty, pii.fit(empty)).count() == 0
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS) and not out.where("text LIKE '%4111 1111%' OR text LIKE '%@b.co%'").count()


@pytest.fixture(scope="module")
def fitted(spark):
    """A field fitted on the documents with even ids."""
    return pii.fit(spark.read.parquet(f"{LARGE}/documents.parquet").where("doc_id % 2 = 0"))


def field_kinds(text, field):
    return [(kind, text[a:b]) for kind, spans in zip(pii.KINDS, pii.field_spans(text, pii.base_spans(text), field)) for a, b in spans]


def test_message_passing_is_exact_on_one_link():
    rng = np.random.default_rng(5)
    field = pii.Field(np.zeros(5), np.zeros((pii.FEATURES, 5)), rng.normal(size=(3, 5, 5)))
    unary = rng.normal(size=(2, 5))
    joint = unary[0][:, None] + unary[1][None] + field.links[pii.REPEAT]
    exact = np.exp(joint - joint.max())
    got = field.marginals(unary, [(0, 1, pii.REPEAT)], 60)
    assert got[0] == pytest.approx(exact.sum(axis=1) / exact.sum(), abs=1e-6) and got[1] == pytest.approx(exact.sum(axis=0) / exact.sum(), abs=1e-6)


def test_variants_are_found_by_skip_links_alone(fitted, monkeypatch):
    cases = [
        ("call +1 (212) 555-0199 today. Later we met, or dial 212 555 0199 again", [("phone", "212 555 0199")]),
        ("mail john.doe@example.com, that is john.doe (at) example (dot) com", [("email", "john.doe (at) example (dot) com")]),
    ]
    for text, want in cases:
        assert field_kinds(text, fitted) == want and field_kinds(text[len(text) // 2 - 3 :], fitted) == []
    monkeypatch.setattr(pii, "links", lambda text, spans: [])
    assert all(field_kinds(text, fitted) == [] for text, _ in cases)


def test_masked_labels_of_held_out_documents(spark, fitted):
    texts = [r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").where("doc_id % 2 = 1 AND text IS NOT NULL").collect()]
    right = n = 0
    for text in texts:
        spans, base = pii.candidates(text), pii.base_spans(text)
        if spans:  # beliefs without any label as evidence
            beliefs = fitted.marginals(fitted.unary([pii.features(text, *s) for s in spans]), pii.links(text, spans))
            right += sum(int(p.argmax()) == pii.label_of(s, base) for s, p in zip(spans, beliefs))
            n += len(spans)
    assert n > 20 and right / n >= 0.95


def test_sample_of_the_field_is_bounded(spark, docs):
    documents = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    assert len(pii.sample(documents, 7)) == 7 and len(pii.sample(documents, 2000, 100)) < 40
    assert pii.trained(pii.sample(docs.where("false"))).bias.tolist() == [0.0] * 5


def test_personal_data_query_equals_patterns_and_field(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet")
    field, want = pii.fit(rows), {}
    for r in rows.collect():
        base = pii.base_spans(r.text or "")
        want[r.doc_id] = ",".join(f"{k}:{a}:{b}" for k, x, y in zip(pii.KINDS, base, pii.field_spans(r.text or "", base, field)) for a, b in sorted(x + y))
    assert {r.doc_id: r.spans for r in pii.query(spark, SMALL).collect()} == want


def test_media_round_trip(spark, docs, empty):
    texts = [(t or "").encode() for _, t, *_ in ROWS] + [bytes(range(256)) * 3, b"\xff" * 100]
    files = [media_avi.encode(media_avi.payload_of(t)) for t in texts]
    grey, fps = media_avi.samples(files)
    assert all(g.tobytes() == media_avi.payload_of(t) for t, g in zip(texts, grey)) and set(fps) == {25.0}
    assert (media_avi.pixels(media_avi.frames_of(files[-2])[0]) == grey[-2][:, :, None]).all()
    rows = media_avi.clips(media_avi.to_media(docs)).collect()
    assert all(r.end_frame > r.first_frame and r.end_s == r.end_frame / 25 for r in rows)
    assert {r.doc_id for r in rows} == {i for i, *_ in ROWS}
    assert media_avi.clips(media_avi.to_media(empty)).count() == 0
    cut = np.zeros((30, 64), np.uint8)
    cut[17:] = 200
    assert media_avi.shots(cut)[0] == [(0, 17), (17, 30)]


def test_near_duplicates_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None and r[0] != 2]
    for base in range(6):
        words = [f"b{base}w{i}" for i in rng.integers(0, 400, 120)]
        for copy in range(12):
            mine = list(words)
            for i in rng.integers(0, 120, rng.integers(0, 8)):
                mine[i] = f"edit{rng.integers(1000)}"
            rows.append((100 + base * 20 + copy, " ".join(mine)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = {}
    for i, t in rows:
        w = plain_words((t or "").lower())
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    want = sorted((i, len(sets[i]), label[i], label[i] == i) for i in sets)
    names = ("doc_id", "n_shingles", "component_id", "kept")
    assert by_id(near_duplicates.near_duplicates(docs, 4), *names) == sorted(want, key=repr)


def test_large_nodes_branch_and_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "MOST_DOCS", 4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:i], f"edit{i}", *base[i + 1 :]])) for i in range(40, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates.near_duplicates(docs, 4)
    assert {r.component_id for r in got.collect()} == {40}


def test_near_duplicates_of_awkward_rows(docs, empty):
    got = near_duplicates.near_duplicates(docs, 4).collect()
    assert len(got) == len(ROWS)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert found[2] == (11, 1) and found[3] == (0, 3) and found[4] == (0, 4) and found[8] == (0, 8)
    assert near_duplicates.near_duplicates(empty, 4).count() == 0
    one = near_duplicates.one_of_each(docs)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 8, 9, 10, 11]  # 7 holds little but 6


def test_unlike_texts_of_one_id_are_different_documents(spark):
    one, other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    near = one.replace(" a39", " edited")
    rows = [(1, one, "x"), (1, other, "x"), (1, other, "x"), (1, other, "y"), (2, near, "x"), (2, third, "x"), (None, near, "x"), (None, third, "x"), (None, "d1 d2 d3 d4 d5 d6", "x"), (None, "d1 d2 d3 d4 d5 d6", "x"), (3, "", "x"), (4, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs).collect()}
    assert found == {(1, 36, 1, True), (2, 36, 1, False), (2, 36, 2, True), (None, 36, 1, True), (None, 36, 2, True), (None, 2, None, True), (3, 0, 3, True), (4, 0, 4, True)}
    kept = near_duplicates.one_of_each(docs).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, one), (1, other), (2, third), (None, "d1 d2 d3 d4 d5 d6"), (3, ""), (4, None)], key=repr)


def test_long_words_beside_brackets_take_linear_time():
    import time

    began = time.time()
    text = "call 123 (x) " + "a" * 5_000_000
    assert pii.candidates(text) == [] and pii.candidates("(at) " * 300_000 + "b" * 2_000_000) == []
    assert pii.candidates("+1 (212) 555-0199 " + text + " (at) b [dot] example") == [(0, 17), (31, len(text) + 18 + 21)]
    assert time.time() - began < 5


def test_links_of_a_larger_table_equal_an_exact_join(spark):
    """Recall over all pairs of sf0.1 of similarity 0.8 or more, found through the shingles that a prefix of each set must share."""
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{LARGE}/documents.parquet'").fetchall()
    sets = {i: frozenset(near_duplicates.shingles((t or "").encode(), 4).tolist()) for i, t in rows}
    counts = defaultdict(int)
    for x in sets.values():
        for s in x:
            counts[s] += 1
    classes = defaultdict(list)
    for i, x in sets.items():
        if x:
            classes[x].append(i)
    label = {i: min(ids) for ids in classes.values() for i in ids}
    holders, links = defaultdict(list), []
    for x in sorted(classes, key=len):
        order = sorted(x, key=lambda s: (counts[s], s))
        seen = set()
        for s in order[: len(x) - -(-80 * len(x) // 100) + 1]:
            for y in holders[s]:
                if y not in seen and 100 * len(y) >= 80 * len(x):
                    seen.add(y)
                    both = len(x & y)
                    if 100 * both >= 80 * (len(x) + len(y) - both):
                        links.append((classes[x][0], classes[y][0]))
            holders[s].append(x)
    parent = dict(label)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        ra, rb = root(label[a]), root(label[b])
        parent[max(ra, rb)] = min(ra, rb)
    want = {i: (len(sets[i]), root(label[i]) if sets[i] else i) for i in sets}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(spark.read.parquet(f"{LARGE}/documents.parquet"), 4).collect()}
    assert len(links) > 100 and got == want


def test_components_of_a_path(spark):
    links = spark.range(1, 40).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(100, 90), (95, 90), (7, 7)], "a long, b long"))
    got = {r.id: r.component for r in components.components(links).collect()}
    assert {got[i] for i in range(2, 41)} == {1} and (got[100], got[95]) == (90, 90) and 50 not in got
    assert components.components(links.where("false")).count() == 0


def test_anchors_are_in_every_window():
    codes = repeats.mixed(np.random.default_rng(1).integers(0, 5, 3000).astype(np.uint64))
    _, anchor, lo, hi = repeats.anchors(codes, 15, 50)
    assert lo[0] == 0 and hi[-1] == 3000 - 50 and (lo[1:] == hi[:-1] + 1).all()
    assert (anchor >= hi).all() and (anchor <= lo + 35).all()


def plain_removed(rows, words):
    first = {}
    for i in sorted(x for x in rows if x is not None):
        w = rows[i]
        for k in range(len(w) - words + 1):
            first.setdefault(tuple(w[k : k + words]), i)
    out = {}
    for i, w in rows.items():
        gone = set()
        for k in range(len(w) - words + 1):
            if i is not None and first[tuple(w[k : k + words])] < i:
                gone.update(range(k, k + words))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_substrings_of_earlier_documents(docs, empty):
    rows = {i: plain_words(t) for i, t, *_ in ROWS if t is not None and i is not None}
    want = plain_removed(rows, 50)
    got = substring_dedup.removed(docs)
    seen = [(r.doc_id, substring_dedup.kept_words((r.text or "").encode(), r.spans)[0]) for r in got.collect()]
    assert len(seen) == len(ROWS) and all(kept == want.get(i, kept) for i, kept in seen) and len(want[7]) == 3
    assert substring_dedup.removed(empty).count() == 0


def test_substrings_of_rows_that_repeat_an_id(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abc"}
    rows = [(1, text["a"]), (2, text["a"]), (2, text["b"]), (2, text["b"]), (3, text["b"] + " " + text["c"]), (None, text["b"]), (4, "")]
    got = sorted([(r.doc_id or 0, len(substring_dedup.kept_words((r.text or "").encode(), r.spans)[0])) for r in substring_dedup.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()])
    assert got == sorted([(1, 60), (2, 0), (2, 60), (2, 60), (3, 60), (0, 60), (4, 0)])


def test_substring_dedup_query_equals_brute_force(spark):
    rows = {r.doc_id: plain_words(r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    want = [(i, len(rows[i]), len(rows[i]) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for i, kept in plain_removed(rows, 50).items()]
    assert by_id(substring_dedup.query(spark, SMALL), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_frequent_keys_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = common.saved(spark.createDataFrame([(k % 3 if k < 9 else k, k) for k in range(20)], "k long, v long"))
    table = common.saved(rows.groupBy("k").count())
    assert sorted(common.joined(rows, table, ["k"], "count").collect()) == sorted(rows.join(table, "k").select("k", "v", "count").collect())


def test_deep_shallow_sorts():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab"), rng.integers(0, 30))).encode() for _ in range(300)] + [b"a" * 20] * 3
    order = suffix_dedup.deep_shallow(texts, 0, 4)
    assert [texts[i] for i in order] == sorted(texts) and sorted(order) == list(range(len(texts)))


def plain_bytes_elsewhere(texts):
    """For each text, the places of bytes in strings of 200 bytes that start at another place too."""
    counts = defaultdict(int)
    for raw in texts:
        for k in range(len(raw) - 199):
            counts[hash(raw[k : k + 200])] += 1
    out = []
    for raw in texts:
        gone, reach = set(), 0
        for k in range(len(raw) - 199):
            if counts[hash(raw[k : k + 200])] > 1:
                gone.update(range(max(k, reach), k + 200))
                reach = k + 200
        out.append(gone)
    return out


@pytest.mark.parametrize("most_group", [1 << 16, 1])
def test_bytes_that_occur_elsewhere(spark, docs, most_group):
    rng = np.random.default_rng(9)
    block = "".join(rng.choice(list("abcdefgh é"), 400))
    more = [(20 + i, "".join(rng.choice(list("xyz "), 150)) + block[i * 7 : i * 7 + 190 + 5 * i] + "".join(rng.choice(list("uvw "), 90))) for i in range(12)]
    rows = [(i, t) for i, t, *_ in ROWS] + more + [(50, LONG + block), (51, "ab" * 300), (52, "ab" * 99), (53, block[:250] + "ab" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("doc", F.xxhash64("doc_id", "text"))
    want = {t: gone for (_, t), gone in zip(rows, plain_bytes_elsewhere([(t or "").encode() for _, t in rows]))}
    spans = suffix_dedup.removal_spans(df.select("doc", "text"), most_group=most_group)
    for r in df.join(spans, "doc", "left").collect():
        assert {j for s in r.spans or () for j in range(s.lo, s.hi)} == want[r.text]
    assert suffix_dedup.removed(docs.where("false")).count() == 0 and suffix_dedup.removed(docs).count() == len(ROWS)


def test_all_removed_bytes_come_from_sorted_neighbours():
    rng = np.random.default_rng(4)
    base = bytes(rng.choice(list(b"abc "), 400).tolist())
    contexts, before = [], []
    for i in range(40):
        text = bytearray(base)
        for at in rng.integers(0, 400, rng.integers(0, 4)):
            if not 120 <= at < 168:
                text[at] = 120 + int(rng.integers(0, 3))
        contexts.append(bytes(text[: rng.integers(330, 401)]))
        before.append(120)
    got = suffix_dedup.shared_lengths(contexts, before, 200, 48)
    for i, (left, right) in enumerate(got):
        want = [0, 0]
        for j in range(40):
            n = suffix_dedup.common_prefix(contexts[i][:120][::-1], contexts[j][:120][::-1])
            m = suffix_dedup.common_prefix(contexts[i][120:], contexts[j][120:])
            if i != j and n + m >= 200:
                want = [max(want[0], n), max(want[1], m)]
        assert [left, right] == want


def test_repeated_contexts_are_sorted_too(spark):
    """What a context with several places loses is what the sort finds between its two entries."""
    rng = np.random.default_rng(6)
    letters = lambda n: bytes(rng.choice(list(b"abcd "), n).tolist())
    base, other = letters(300), letters(300)
    members = [(1, base, 60, 3), (2, base[:60] + base[60:240] + letters(60), 60, 1), (3, other, 60, 1)]
    reach = suffix_dedup.shared_lengths([m[1] for m in members + members[:1]], [60] * 4, 200, 48)
    assert reach[0] == reach[3] == (60, 240) and reach[1][0] == 60 and reach[1][1] >= 180 and reach[2] == (0, 0)
    schema = "key long, h long, context binary, before int, places long"
    rows = spark.createDataFrame([(7, *m) for m in members], schema)
    assert sorted((r.h, r.left, r.right, r.places) for r in suffix_dedup.sorted_groups(rows, 200, 48).collect()) == [(1, 60, 240, 3), (2, *reach[1], 1)]
    alone = spark.createDataFrame([(7, *members[0]), (8, *members[2])], schema)
    assert [(r.h, r.left, r.right, r.places) for r in suffix_dedup.sorted_groups(alone, 200, 48).collect()] == [(1, 60, 240, 3)]


def test_suffix_dedup_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    texts = [(r.text or "").encode() for r in rows]
    want = []
    for r, raw, gone in zip(rows, texts, plain_bytes_elsewhere(texts)):
        kept = bytes(b for k, b in enumerate(raw) if k not in gone)
        runs = sum(k - 1 not in gone for k in gone)
        want.append((r.doc_id, len(raw), len(gone), runs, hashlib.sha256(kept).hexdigest()))
    assert by_id(suffix_dedup.query(spark, SMALL), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_languages_of_held_out_documents(spark, docs, empty):
    rows = language_id.query(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in rows) / len(rows)
    assert right >= 0.95 and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in language_id.predict(docs, *language_id.fit(docs.where(~language_id.held_out()))).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[8].lang_pred == "und" and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got if i is not None)
    assert language_id.predict(empty, *language_id.fit(empty)).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, *language_id.fit(empty)).collect()} == {"und"}
    kept = language_id.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t, *_ in ROWS)


def test_url_filters_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{MEDIUM}/pages.parquet'")
    names = ("page_id", "fetched_on", "host", "verdict", "n_active", "lists")
    want = con.sql(url_filters.ORACLE).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[n] for n in names)) for r in url_filters.query(spark, MEDIUM).collect())


def test_url_filters_on_awkward_rows(spark):
    rows = [(1, "http://a.b.com/x/", "2024-03-01"), (1, "http://a.b.com/x/", "2024-03-01"), (2, None, "2024-03-01"), (3, "nonsense", "2024-03-01"), (4, "http://a.b.com", None), (None, "HTTP://u@A.B.com:80/x?q", "2024-03-10"), (5, "https://b.com/y", "2024-04-01")]
    captures = spark.createDataFrame(rows, "page_id long, url string, d string").withColumn("fetched_on", F.to_date("d")).withColumn("verdict", F.lit("mine"))
    listed = spark.createDataFrame([("l", "block", "domain", "B.com", "2024-01-01", "add"), ("l", "block", "domain", "b.com", "2024-04-01", "remove"), ("w", "allow", "url", "a.b.com/x", "2024-03-05", "add"), (None, "block", "domain", "b.com", "2024-01-01", "add")], "list string, verdict string, kind string, pattern string, day string, action string").withColumn("effective_on", F.to_date("day"))
    got = sorted([(r.page_id, r.verdict, r.n_active) for r in url_filters.filtered(captures, listed).collect()], key=repr)
    assert got == sorted([(1, "block", 1), (1, "block", 1), (2, "none", 0), (3, "none", 0), (4, "none", 0), (None, "allow", 2), (5, "none", 0)], key=repr)
    assert url_filters.filtered(captures.where("false"), listed).count() == 0
    assert url_filters.filtered(captures, listed.where("false")).where("verdict <> 'none'").count() == 0


def test_url_patterns_are_normalised_as_pages_are(spark):
    listed = url_filters.entries(spark, [("x", "block", "url", p, "2024-01-01", "add") for p in ("Host.Example.com/A/b", "https://u@Host.example.com:80/C/d/?q=1", "host.example.com/E/")] + [("x", "block", "domain", "Host.Example.org", "2024-01-01", "add")])
    assert {r.pattern for r in url_filters.intervals(listed).collect()} == {"host.example.com/A/b", "host.example.com/C/d", "host.example.com/E", "host.example.org"}
    pages = spark.createDataFrame([("http://HOST.example.com/A/b/?x",), ("http://host.example.com/C/d",)], "url string")
    assert [r.page for r in url_filters.addressed(pages).collect()] == ["host.example.com/A/b", "host.example.com/C/d"]
