"""The pipeline against plain versions of its stages."""

import re
import struct
import zlib

import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from alarmlens.llm import pii

SMALL = "/root/testdata/sf0.001"


def test_run_equals_plain_stages(spark):
    import public_tokenizers

    rows = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    kept = {r["doc_id"]: r["text"] for r in rows if any(c.isalpha() for c in r["text"] or "")}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in kept.items() for w in [t.lower().split()]}
    label = {i: i for i in kept}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if label[a] != label[b] and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    kept = {i: t for i, t in kept.items() if label[i] == i}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    folded = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist() for w in [folded(r["text"])] for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    kept = {i: t for i, t in kept.items() for w in [folded(t)] if not any(tuple(w[k : k + n]) in windows for k in range(len(w)) for n in sizes)}
    docs = spark.createDataFrame([(i, t) for i, t in kept.items()], "doc_id long, text string")
    field = pii.fit(docs)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: len(library.encode(pii.redacted(t, field), add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    got = {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        got[r.doc_id] = r.doc_tokens
    assert got == want and len(want) < len(rows)


def test_run_returns_the_ids_of_the_last_texts(spark):
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, SMALL).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
        ids.setdefault(r.doc_id, []).extend(r.ids)
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SMALL}/documents.parquet").to_pylist()}
    same = [i for i in ids if ids[i] == [*library.encode(texts[i], add_special_tokens=False).ids, 2]]
    assert len(same) > len(ids) / 2  # all whose text has nothing to redact


def test_run_on_awkward_and_empty_tables(spark, tmp_path):
    rows = [(1, "one two three four five six seven", "en", "s", 33), (1, "one two three four five six seven", "en", "s", 33), (1, "an unlike text under the same id stays", "en", "s", 38), (2, "", "en", "s", 0), (3, None, None, None, None), (None, "no id but mail a@b.co", "en", "s", 21), (4, "123 456", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([("x", "nothing of these words is anywhere else at all today")], "item_id string, text string")
    for name, part in (("some", docs), ("none", docs.where("false"))):
        part.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()) == [0, 1, 1]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
