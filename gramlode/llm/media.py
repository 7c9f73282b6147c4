"""Media columns: AVI files of motion-JPEG frames, stored losslessly.

Bytes become 8-bit grey samples of 24 x 24 frames. Every frame is an intra frame, coded by the lossless process of
JPEG (ITU-T T.81, SOF3): left prediction, Huffman-coded differences. Reading parses the RIFF index, decodes all frames of a
chunk in step, and cuts shots where a frame's histogram difference exceeds an adaptive threshold; clips are timed rows.

A null text is empty and gives one frame of fill bytes. Equal texts give equal files. Every row is treated alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import bounded, text_chunks

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
#: Huffman codes of difference categories: (bits, categories), shortest first. Fixed values of this format.
CODES = ((3, (3, 4, 5, 6)), (4, (0, 1, 2, 7, 8)))
BINS, WINDOW, LEAST, FACTOR = 16, 8, 128, 2
#: Frames coded at once.
FRAMES_AT_ONCE = 1 << 14


def _jpeg_head() -> bytes:
    counts = bytes(next((len(s) for n, s in CODES if n == bits), 0) for bits in range(1, 17))
    symbols = bytes(x for _, s in CODES for x in s)
    dht = b"\xff\xc4" + struct.pack(">HB", 19 + len(symbols), 0) + counts + symbols
    sof = b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    sos = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
    return b"\xff\xd8" + dht + sof + sos


def _code_table(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Category to (code, bits), as a JPEG table defines them."""
    out, code, at = {}, 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            out[symbols[at]] = (code, bits)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _encode_tables() -> tuple[np.ndarray, np.ndarray]:
    """For differences -255 to 255: the bits to write, and how many."""
    head = _jpeg_head()
    table = _code_table(head[7:23], head[23 : 23 + sum(head[7:23])])
    value, bits = np.zeros(511, np.uint32), np.zeros(511, np.uint8)
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = table[cat]
        value[d + 255] = code << cat | (d if d > 0 else d + (1 << cat) - 1 if d < 0 else 0)
        bits[d + 255] = n + cat
    return value, bits


def _decode_tables(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For the next 12 bits: the difference and the bits it took; 0 bits where no code fits."""
    diff, took = np.zeros(4096, np.int16), np.zeros(4096, np.uint8)
    for cat, (code, n) in _code_table(counts, symbols).items():
        if n + cat > 12:
            continue
        for extra in range(1 << cat):
            d = extra if cat == 0 or extra >> (cat - 1) else extra - (1 << cat) + 1
            at = (code << cat | extra) << (12 - n - cat)
            diff[at : at + (1 << (12 - n - cat))] = d if cat else 0
            took[at : at + (1 << (12 - n - cat))] = n + cat
    return diff, took


def _scans(frames: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded, byte-stuffed data of all frames (n, 24, 24), and where each begins and the last ends."""
    value, bits = tables
    n = len(frames)
    x = frames.astype(np.int16)
    d = np.empty((n, SIDE, SIDE), np.int16)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    d = d.reshape(n, FRAME) + 255
    v, b = np.zeros((n, FRAME + 1), np.uint32), np.zeros((n, FRAME + 1), np.int64)
    v[:, :FRAME], b[:, :FRAME] = value[d], bits[d]
    pad = -b.sum(1) % 8  # ones fill the last byte
    v[:, FRAME], b[:, FRAME] = (1 << pad) - 1, pad
    size = b.sum(1) >> 3
    v, b = v.ravel(), b.ravel()
    at = np.cumsum(b) - b
    v = v << (24 - b - (at & 7)).astype(np.uint32)
    byte = at >> 3
    new = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
    v, byte = np.add.reduceat(v, new), byte[new]
    out = np.zeros(int(size.sum()) + 3, np.uint8)
    out[byte] += (v >> 16).astype(np.uint8)
    out[byte + 1] += (v >> 8 & 255).astype(np.uint8)
    out[byte + 2] += (v & 255).astype(np.uint8)
    out = out[:-3]
    ends = np.cumsum(size)
    full = out == 255
    more = np.cumsum(full)
    stuffed = np.zeros(len(out) + int(more[-1]), np.uint8)
    stuffed[np.arange(len(out)) + more - full] = out
    return stuffed, np.concatenate(([0], ends + more[ends - 1]))


def _avi(frames: list[bytes]) -> bytes:
    """One AVI file: headers, the frames in a movi list, an index."""
    chunks, entries, at = [], [], 4
    for f in frames:
        chunks.append(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1))
        entries.append(struct.pack("<4sIII", b"00dc", 16, at, len(f)))
        at += len(chunks[-1])
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    picture = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    part = lambda name, body: name + struct.pack("<I", len(body)) + body
    listed = lambda kind, body: part(b"LIST", kind + body)
    head = listed(b"hdrl", part(b"avih", main) + listed(b"strl", part(b"strh", stream) + part(b"strf", picture)))
    return part(b"RIFF", b"AVI " + head + listed(b"movi", b"".join(chunks)) + part(b"idx1", b"".join(entries)))


def write_avis(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """An AVI file for each text; fill bytes 255 make up a positive multiple of a frame."""
    tables, head = _encode_tables(), _jpeg_head()
    sizes = np.diff(offs)
    frames = np.maximum(1, -(-sizes // FRAME))
    first = np.concatenate(([0], np.cumsum(frames)))
    padded = np.full(int(first[-1]) * FRAME, 255, np.uint8)
    padded[np.arange(len(data)) + np.repeat(first[:-1] * FRAME - offs[:-1], sizes)] = data
    padded = padded.reshape(-1, SIDE, SIDE)
    coded: list[bytes] = []
    for at in range(0, len(padded), FRAMES_AT_ONCE):
        scan, ends = _scans(padded[at : at + FRAMES_AT_ONCE], tables)
        raw = scan.tobytes()
        coded += [b"".join((head, raw[a:b], b"\xff\xd9")) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return [_avi(coded[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _frames_of(avi: bytes) -> list[tuple[int, int]]:
    """Start and end of each video frame, by the file's index."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, found = 12, 0, []
    while at + 8 <= len(avi):
        name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = np.frombuffer(avi, "<u4", size // 4, at + 8).reshape(-1, 4)
            video = index[index[:, 0] == int.from_bytes(b"00dc", "little")]
            found = [(movi + int(o) + 8, movi + int(o) + 8 + int(n)) for o, n in video[:, 2:].tolist()]
        at += 8 + size + (size & 1)
    return found


def _parsed_head(jpeg: bytes) -> tuple[int, bytes, bytes]:
    """Where a frame's scan begins, and its Huffman table. Raises on any other coding."""
    at, counts, symbols, lossless = 2, b"", b"", False
    while True:
        mark, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        if mark == 0xC4:
            counts = jpeg[at + 5 : at + 21]
            symbols = jpeg[at + 21 : at + 21 + sum(counts)]
        elif 0xC0 <= mark <= 0xCF:
            lossless = mark == 0xC3 and struct.unpack_from(">BHHB", jpeg, at + 4) == (8, SIDE, SIDE, 1)
        at += 2 + size
        if mark == 0xDA:
            if not lossless or jpeg[at - 3] != 1:
                raise ValueError("not a lossless 24 x 24 grey frame with left prediction")
            return at, counts, symbols


def read_avis(avis: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The samples of all files' frames (n, 576), and where each file's begin and the last one's end."""
    places = [_frames_of(a) for a in avis]
    first = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int64)
    out = np.empty((int(first[-1]), FRAME), np.uint8)
    scans, head, parsed = [], None, None
    for avi, place in zip(avis, places):
        for a, b in place:
            if head is None or not avi.startswith(head, a):
                start, counts, symbols = _parsed_head(avi[a:b])
                if head is not None and (counts, symbols) != parsed:
                    raise ValueError("frames with several Huffman tables")
                head, parsed = avi[a : a + start], (counts, symbols)
            scans.append(avi[a + len(head) : b - 2])
    if not scans:
        return out, first
    diff, took = _decode_tables(*parsed)
    for at in range(0, len(scans), FRAMES_AT_ONCE):
        some = scans[at : at + FRAMES_AT_ONCE]
        raw = np.frombuffer(b"".join(some), np.uint8)
        stuffing = np.concatenate(([False], (raw[1:] == 0) & (raw[:-1] == 255)))
        ends = np.cumsum([len(s) for s in some])
        gone = np.cumsum(stuffing)
        starts = np.concatenate(([0], ends[:-1] - gone[ends[:-1] - 1]))
        raw = np.concatenate((raw[~stuffing], np.zeros(3, np.uint8))).astype(np.uint32)
        word = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
        pos = starts << 3
        d = np.empty((FRAME, len(some)), np.int16)
        for t in range(FRAME):  # one sample of every frame at a time
            look = word[pos >> 3] << (pos & 7).astype(np.uint32) >> np.uint32(12) & np.uint32(4095)
            d[t] = diff[look]
            pos += took[look]
        d = d.T.reshape(-1, SIDE, SIDE)
        d[:, 0, 0] += 128
        d[:, :, 0] = np.cumsum(d[:, :, 0], 1, dtype=np.int16)
        out[at : at + len(some)] = (np.cumsum(d, 2, dtype=np.int16) & 255).astype(np.uint8).reshape(-1, FRAME)
    return out, first


def shot_starts(samples: np.ndarray, first: np.ndarray) -> list[list[int]]:
    """Of each file, the frames at which a shot begins: 0, and those whose histogram differs from the frame before by
    ``LEAST`` and by ``FACTOR`` times the mean difference of up to ``WINDOW`` frames before."""
    n = len(samples)
    if not n:
        return [[] for _ in first[:-1]]
    hist = np.bincount((np.arange(n)[:, None] * BINS + (samples >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    change = np.zeros(n, np.int64)
    change[1:] = np.abs(np.diff(hist, axis=0)).sum(1)
    has = first[:-1][np.diff(first) > 0]
    change[has] = 0
    sums = np.concatenate(([0], np.cumsum(change)))
    start = np.repeat(first[:-1], np.diff(first))
    at = np.arange(n)
    low = np.maximum(start + 1, at - WINDOW)
    count = np.maximum(at - low, 0)
    cut = (change >= LEAST) & (change * np.maximum(count, 1) > FACTOR * (sums[at] - sums[np.minimum(low, at)]))
    cut[has] = True
    where = np.flatnonzero(cut)
    parts = np.searchsorted(where, first)
    return [(where[parts[i] : parts[i + 1]] - first[i]).tolist() for i in range(len(first) - 1)]


def _media(full: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for rows, data, offs in text_chunks(batches, budget=4 << 20):
            avis = write_avis(data, offs)
            samples, first = read_avis(avis)
            shots = shot_starts(samples, first)
            back = [samples[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
            cols = [
                rows.column(0),
                pa.array(np.diff(offs), pa.int64()),
                pa.array([len(b) for b in back], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
                pa.array([zlib.crc32(b[-32:]) for b in back], pa.int64()),
                pa.array([len(a) for a in avis], pa.int64()),
                pa.array([hashlib.sha256(a).hexdigest() for a in avis], pa.string()),
                pa.array([f"frames={len(b) // FRAME};shots={','.join(map(str, s))}" for b, s in zip(back, shots)], pa.string()),
            ]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if full:
                cols += [pa.array(avis, pa.binary()), pa.array(shots, pa.list_(pa.int32()))]
                names += ["media", "shots"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def media_columns(docs: DataFrame, *, full: bool = True) -> DataFrame:
    """Each text stored as an AVI file and read back: digests, features and, with ``full``, the file and its shots."""
    bounded(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary, shots array<int>" * full
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_media(full), schema)


def clips(media: DataFrame) -> DataFrame:
    """Timed rows of media_columns(): one for each shot, seconds from start to end."""
    frames = F.col("payload_bytes") / FRAME
    return media.select("doc_id", frames.alias("frames"), F.posexplode("shots").alias("clip", "first"), "shots").select(
        "doc_id", "clip", (F.col("first") / FPS).alias("start_s"),
        (F.coalesce(F.try_element_at("shots", F.col("clip") + 2).cast("double"), F.col("frames")) / FPS).alias("end_s"),
    )
