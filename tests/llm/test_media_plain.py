"""Operator 4's query against a plain reader of its files: RIFF by its index, baseline JPEG bit by bit."""

import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from alarmlens.llm import media_avi

SMALL = "/root/testdata/sf0.001"


def jpeg_blocks(frame):
    """(width, height, samples of each block's constant value) of a grey baseline frame, decoded one bit at a time."""
    assert frame[:2] == b"\xff\xd8" and frame[-2:] == b"\xff\xd9"
    at, quant, codes = 2, None, {}
    while True:
        marker, size = frame[at + 1], struct.unpack(">H", frame[at + 2 : at + 4])[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quant = body[1:65]
        elif marker == 0xC0:
            bits, height, width, parts = struct.unpack(">BHHB", body[:6])
            assert (bits, parts) == (8, 1)
        elif marker == 0xC4:
            code, table, k = 0, {}, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            codes[body[0]] = table
        elif marker == 0xDA:
            break
    data = frame[at:-2].replace(b"\xff\x00", b"\xff")
    bits = "".join(f"{b:08b}" for b in data)
    place = 0

    def symbol(table):
        nonlocal place
        for length in range(1, 17):
            found = table.get((length, int(bits[place : place + length], 2)))
            if found is not None:
                place += length
                return found
        raise AssertionError("no code")

    out, dc = [], 0
    for _ in range(width // 8 * (height // 8)):
        size = symbol(codes[0x00])
        if size:
            raw = int(bits[place : place + size], 2)
            place += size
            dc += raw if raw >> (size - 1) else raw - (1 << size) + 1
        assert symbol(codes[0x10]) == 0  # nothing but the mean
        out.append(128 + dc * quant[0] // 8)
    assert len(bits) - place < 8
    return width, height, out


def plain_file(media):
    """The samples of an AVI file's frames, by idx1, and its frames a second."""
    assert media[:4] == b"RIFF" and struct.unpack("<I", media[4:8])[0] == len(media) - 8 and media[8:12] == b"AVI "
    movi, fps, frames = media.index(b"movi"), None, []
    at = media.index(b"strh") + 8
    scale, rate = struct.unpack("<2I", media[at + 20 : at + 28])
    fps = rate / scale
    at = media.rindex(b"idx1")
    for k in range(struct.unpack("<I", media[at + 4 : at + 8])[0] // 16):
        name, flags, offset, size = struct.unpack("<4s3I", media[at + 8 + 16 * k : at + 24 + 16 * k])
        assert name == b"00dc" and flags & 0x10
        assert media[movi + offset : movi + offset + 8] == name + struct.pack("<I", size)
        frames.append(jpeg_blocks(media[movi + offset + 8 : movi + offset + 8 + size])[2])
    return frames, fps


def plain_feature(frames):
    """Shots by the differences of neighbouring frames' histograms, against their mean and deviation over the last twelve."""
    change = []
    for a, b in zip(frames, frames[1:]):
        counts = [[0] * 16, [0] * 16]
        for k, f in enumerate((a, b)):
            for v in f:
                counts[k][v // 16] += 1
        change.append(sum(abs(x - y) for x, y in zip(*counts)) / 128)
    starts = [0]
    for k in range(1, len(change)):
        seen = change[max(0, k - 12) : k]
        mean = sum(seen) / len(seen)
        spread = math.sqrt(max(0.0, sum(x * x for x in seen) / len(seen) - mean * mean))
        if change[k] > max(0.25, mean + 3 * spread):
            starts.append(k + 1)
    runs = list(zip(starts, [*starts[1:], len(frames)]))
    return f"frames={len(frames)};shots={len(runs)};peak={max(change, default=0):.4f};spans=" + ",".join(f"{a}-{b}" for a, b in runs)


def plain_row(doc_id, text):
    data = (text or "").encode()
    payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
    media = media_avi.encode(payload)
    frames, fps = plain_file(media)
    back = bytes(v for f in frames for v in f)
    assert back == payload and fps == 25
    return doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), plain_feature(frames)


def test_query_equals_a_plain_reader(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    short = sorted(docs, key=lambda r: len(r.text or ""))[:60]
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    got = {r.doc_id: tuple(r[n] for n in names) for r in media_avi.query(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for r in [*short, docs[0], docs[1]]:
        assert got[r.doc_id] == plain_row(r.doc_id, r.text)


@pytest.mark.parametrize("text", [None, "", "x" * 64, "\x00", "ÿ" * 200, "".join(chr(32 + i * 37 % 90) for i in range(3000)), "a" * 2000 + "\x7f" * 2000])
def test_awkward_texts_and_repeats(spark, tmp_path, text):
    rows = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, "x")], "doc_id long, text string, media string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in media_avi.query(spark, str(tmp_path)).collect()]
    want = plain_row(1, text)
    assert sorted(got, key=repr) == sorted([want, want, (None, *want[1:])], key=repr)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert media_avi.query(spark, str(tmp_path)).count() == 0


def test_payloads_of_all_bytes_come_back():
    payload = np.random.default_rng(0).integers(0, 256, 64 * 9, dtype=np.uint8).tobytes() + b"\xff\x00" * 32 + b"\x00\xff" * 32
    frames, _ = plain_file(media_avi.encode(payload))
    assert bytes(v for f in frames for v in f) == payload
