"""Texts as motion-JPEG AVI, and back: RIFF indexes, intra frames, shots (operator 4).

A sample is one 8x8 block of constant grey, so baseline JPEG keeps it exactly: its DC coefficient, quantised by 8, is the
sample less 128, and it has no other. A frame holds 64 samples. Reading goes by the file's own structure: the RIFF chunks and
idx1 give the frames, their markers the tables, and all frames with the same headers are Huffman-decoded in step, one lane a
frame. Shots are cut where the histograms of neighbouring frames differ more than they lately did.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UNIT = 64
SIDE = 64
FPS = 25
BINS = 16
#: Frames that the adaptive threshold looks back on, its deviations, and its least.
LOOK_BACK, DEVIATIONS, LEAST = 12, 3.0, 0.25

# Fixed values of the JPEG format: the order in which a block's coefficients are stored.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, lengths: list[int], symbols: bytes) -> bytes:
    return _segment(0xC4, bytes([kind, *lengths]) + symbols)


#: Twelve DC categories with codes of four bits; the only AC symbol ends the block, with a code of one bit.
HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\x08" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00")
    + _huffman(0x00, [0, 0, 0, 12] + [0] * 12, bytes(range(12)))
    + _huffman(0x10, [1] + [0] * 15, b"\0")
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)
TAIL = b"\xff\xd9"


def _scans(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each frame of 64 samples."""
    n = len(samples)
    level = samples.astype(np.int32) - 128
    change = np.diff(level, axis=1, prepend=np.zeros((n, 1), np.int32))
    size = np.zeros(512, np.int32)
    size[1:] = np.floor(np.log2(np.arange(1, 512))).astype(np.int32) + 1
    size = size[np.abs(change)]
    extra = np.where(change < 0, change + (1 << size) - 1, change)
    length = np.empty((n, UNIT + 1), np.int32)
    length[:, :UNIT] = 5 + size
    length[:, UNIT] = -length[:, :UNIT].sum(axis=1) % 8  # ones up to a whole byte
    code = np.empty((n, UNIT + 1), np.int32)
    code[:, :UNIT] = (size << (size + 1)) | (extra << 1)
    code[:, UNIT] = 0xFF
    code <<= 13 - length
    code[:, UNIT] = 0x1FFF
    places = np.arange(13)
    bits = (code[:, :, None] >> (12 - places) & 1).astype(np.uint8)
    data = np.packbits(bits[places < length[:, :, None]])
    lengths = length.sum(axis=1) // 8
    full = data == 0xFF
    if full.any():  # a zero goes behind each byte of ones
        at = np.cumsum(lengths) - lengths
        lengths = lengths + np.add.reduceat(full, at)
        data = np.insert(data, np.flatnonzero(full) + 1, 0)
    raw, ends = data.tobytes(), np.cumsum(lengths).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def encode(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload, a positive multiple of 64 bytes."""
    frames = [HEAD + scan + TAIL for scan in _scans(np.frombuffer(payload, np.uint8).reshape(-1, UNIT))]
    sizes = np.array([len(f) for f in frames])
    movi = b"".join(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) % 2) for f in frames)
    offsets = 4 + np.concatenate([[0], np.cumsum(8 + sizes + sizes % 2)[:-1]])
    index = np.zeros((len(frames), 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, offsets, sizes
    n, most = len(frames), int(sizes.max())
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<I2H8I4h", 0, 0, 0, 0, 1, FPS, 0, n, most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    body = b"AVI " + header + chunk(b"LIST", b"movi" + movi) + chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def frames_of(media: bytes) -> tuple[list[bytes], float]:
    """The video frames that idx1 points to, and frames a second."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index = float(FPS), None, None
    stack = [(12, len(media))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
            if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
                movi = at + 8
            elif name == b"LIST":
                stack.append((at + 12, at + 8 + size))
            elif name == b"strh" and media[at + 8 : at + 12] == b"vids":
                scale, rate = struct.unpack_from("<2I", media, at + 28)
                fps = rate / max(1, scale)
            elif name == b"idx1":
                index = np.frombuffer(media, "<u4", size // 4, at + 8).reshape(-1, 4)
            at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no movi list or no idx1")
    video = index[(index[:, 0] >> 16) == int.from_bytes(b"dc", "little")]
    return [media[movi + a + 8 : movi + a + 8 + n] for a, n in zip(video[:, 2].tolist(), video[:, 3].tolist())], fps


class Tables:
    """What a frame's headers say: size, quantisation, and Huffman codes as tables over 16 bits."""

    def __init__(self, head: bytes):
        at, self.codes = 2, {}
        while at < len(head):
            marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
            body = head[at + 4 : at + 2 + size]
            if marker == 0xDB:
                self.quant = np.frombuffer(body, np.uint8, 64, 1).astype(np.int64)
            elif marker == 0xC0:
                _, self.height, self.width, parts = struct.unpack_from(">BHHB", body)
                if parts != 1:
                    raise ValueError("only grey frames are read")
            elif marker == 0xC4:
                table, code, k = np.zeros(65536, np.int32), 0, 17
                for length in range(1, 17):
                    for _ in range(body[length]):
                        table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                self.codes[body[0]] = table
            elif marker not in (0xDA, 0xE0, 0xFE):
                raise ValueError(f"marker {marker:x} isn't read")
            at += 2 + size


def _head_length(frame: bytes) -> int:
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
    return at + 2 + int.from_bytes(frame[at + 2 : at + 4], "big")


def coefficients(scans: list[bytes], tables: Tables) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]:
    """DC coefficients (frame, block), and others by (block, place), quantised; every frame is a lane, all go in step."""
    blocks = -(-tables.width // 8) * -(-tables.height // 8)
    plain = [s.replace(b"\xff\0", b"\xff") for s in scans]
    wide = max(map(len, plain)) + 8
    data = np.frombuffer(b"".join(s.ljust(wide, b"\xff") for s in plain), np.uint8).astype(np.int64)
    start = np.arange(len(plain)) * (wide * 8)
    windows = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    bit = start.copy()

    def take(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and the place behind it."""
        found = codes[windows[at >> 3] >> (16 - (at & 7)) & 0xFFFF]
        return found & 255, at + (found >> 8)

    def value(at: np.ndarray, size: np.ndarray) -> np.ndarray:
        raw = windows[at >> 3] >> (16 - (at & 7)) & 0xFFFF
        raw >>= 16 - size
        return np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)

    direct = np.zeros((len(plain), blocks), np.int64)
    others: dict[tuple[int, int], np.ndarray] = {}
    last = np.zeros(len(plain), np.int64)
    for block in range(blocks):
        size, bit = take(tables.codes[0x00], bit)
        last = last + value(bit, size)
        bit = bit + size
        direct[:, block] = last
        lanes, place = np.arange(len(plain)), np.ones(len(plain), np.int64)
        while len(lanes):
            symbol, after = take(tables.codes[0x10], bit[lanes])
            if not symbol.any():
                bit[lanes] = after
                break
            run, size = symbol >> 4, symbol & 15
            place = place + run
            for p in np.unique(place[size > 0]):
                mine = (place == p) & (size > 0)
                others.setdefault((block, int(p)), np.zeros(len(plain), np.int64))[lanes[mine]] = value(after[mine], size[mine])
            bit[lanes] = after + size
            going = (symbol != 0) & (place < 63)
            lanes, place = lanes[going], place[going] + 1
    return direct, others


def pixels(frames: list[bytes]) -> np.ndarray:
    """Grey pixels (frame, block, 64) of frames that share their headers."""
    tables = Tables(frames[0][: _head_length(frames[0])])
    direct, others = coefficients([f[_head_length(f) : -2] for f in frames], tables)
    full = np.zeros((*direct.shape, 64))
    full[:, :, 0] = direct * tables.quant[0]
    for (block, place), values in others.items():
        full[:, block, ZIGZAG[place]] = values * tables.quant[place]
    u, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1) / 2
    planes = np.einsum("ux,fbuv,vy->fbxy", basis, full.reshape(*direct.shape, 8, 8), basis)
    return np.clip(np.rint(planes.reshape(*direct.shape, 64)) + 128, 0, 255).astype(np.uint8)


def samples(media: list[bytes]) -> tuple[list[np.ndarray], list[float]]:
    """For each file its blocks' mean grey values (frame, block), and its frames a second. Files are decoded together."""
    frames, counts, speeds = [], [], []
    for m in media:
        found, fps = frames_of(m)
        frames += found
        counts.append(len(found))
        speeds.append(fps)
    by_head: dict[bytes, list[int]] = {}
    length = 0
    for i, f in enumerate(frames):
        if not (length and by_head and f[:length] in by_head):
            length = _head_length(f)
        by_head.setdefault(f[:length], []).append(i)
    out: list = [None] * len(frames)
    for head, at in by_head.items():
        tables = Tables(head)
        direct, others = coefficients([frames[i][len(head) : -2] for i in at], tables)
        # a block's mean depends on its DC coefficient alone
        grey = np.clip(np.rint(direct * tables.quant[0] / 8) + 128, 0, 255).astype(np.uint8)
        for i, g in zip(at, grey):
            out[i] = g
    ends = np.cumsum(counts).tolist()
    return [np.array(out[a:b]) for a, b in zip([0, *ends], ends)], speeds


def shots(grey: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Runs of frames (first, end) between cuts, and the histogram differences."""
    n = len(grey)
    counts = np.zeros((n, BINS), np.int32)
    np.add.at(counts, (np.repeat(np.arange(n), grey.shape[1]), (grey >> 4).ravel()), 1)
    change = np.abs(np.diff(counts, axis=0)).sum(axis=1) / (2 * grey.shape[1])
    k = np.arange(len(change))
    first = np.maximum(0, k - LOOK_BACK)
    sums, squares = (np.concatenate([[0], np.cumsum(x)]) for x in (change, change**2))
    seen = np.maximum(1, k - first)
    mean = (sums[k] - sums[first]) / seen
    spread = np.sqrt(np.maximum(0, (squares[k] - squares[first]) / seen - mean**2))
    cuts = np.flatnonzero((change > np.maximum(LEAST, mean + DEVIATIONS * spread)) & (k > 0)) + 1
    bounds = [0, *cuts.tolist(), n]
    return list(zip(bounds, bounds[1:])), change


def feature(grey: np.ndarray) -> str:
    runs, change = shots(grey)
    return f"frames={len(grey)};shots={len(runs)};peak={change.max() if len(change) else 0:.4f};spans=" + ",".join(f"{a}-{b}" for a, b in runs)


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, and the text as an AVI file. A null or empty text is one frame of zeros; repeated rows and null ids stay."""

    def make():
        return lambda ids, texts: (ids, [encode(payload_of(t)) for t in common.as_bytes(texts)])

    return common.map_columns(docs, [F.col("doc_id").cast("long").alias("doc_id"), "text"], make, "doc_id long, media binary", rows=64)


def clips(media: DataFrame) -> DataFrame:
    """One row for each shot of each file in media (doc_id, media): its frames and times. A null file has none."""

    def make():
        def fn(ids, files):
            rows = [[] for _ in range(6)]
            whole = [(i, m) for i, m in zip(ids.to_pylist(), files.to_pylist()) if m is not None]
            for (doc, _), grey, fps in zip(whole, *samples([m for _, m in whole])):
                for k, (a, b) in enumerate(shots(grey)[0]):
                    for values, x in zip(rows, (doc, k, a, b, a / fps, b / fps)):
                        values.append(x)
            return rows

        return fn

    return common.map_columns(media, ["doc_id", "media"], make, "doc_id long, clip long, first_frame long, end_frame long, start_s double, end_s double", rows=128)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is stored, read back from the stored bytes and described, in one pass: the files are never shuffled.

    A null or empty text is one frame of zeros. Texts are taken whole, up to the 4 GB that a RIFF file can say. Rows come back as
    often as they occur, null ids too; an empty table gives none. Other columns are not read.
    """

    def make():
        def fn(ids, texts):
            texts = [t or b"" for t in common.as_bytes(texts)]
            media = [encode(payload_of(t)) for t in texts]
            columns = [[] for _ in range(7)]
            for text, file, grey in zip(texts, media, samples(media)[0]):
                back = grey.tobytes()
                for values, x in zip(columns, (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature(grey))):
                    values.append(x)
            return ids, *columns

        return fn

    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.map_columns(docs, ["doc_id", "text"], make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", rows=128)
