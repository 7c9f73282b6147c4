"""Byte-level BPE by monoid tree reduction.

A piece (one match of the splitting pattern) is halved down to single bytes. Two encoded neighbours are joined by
encoding a window round their border anew. A token sequence is the encoding of its bytes if and only if each two
neighbours of it would stay two tokens when encoded on their own; so the window grows until that holds at both of its
edges, and the tokens outside are then proven final. Decoding joins bytes up a tree.

A null text is an empty one and has no token. Every row is treated alone: repeated rows and ties give equal results,
an empty table gives an empty one, extra columns are left aside.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlode.llm.common import bounded, text_chunks

#: Distinct pieces that a task remembers, and the longest of them in bytes; beyond, they are encoded anew.
REMEMBERED, REMEMBERED_BYTES = 300_000, 256
#: Above every rank.
NEVER = 1 << 62
#: Bytes of a leaf of the tree, encoded by the plain rule.
LEAF = 12
#: White space as the reference tokenizer's regex engine has it (fixed values).
SPACE = r"\t\n\x0b\x0c\r\x20\x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Monoid:
    """Encodings as monoid elements: join() is associative and has the empty sequence as its unit."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.settled: dict[tuple[int, int], bool] = {}

    def merged(self, parts: list[bytes]) -> list[int]:
        """The plain rule on a short window: again and again, the leftmost pair of least rank becomes one token."""
        get = self.ranks.get
        pairs = [get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], NEVER)
        return [self.ranks[p] for p in parts]

    def window(self, data: bytes) -> list[int]:
        return self.merged([data[i : i + 1] for i in range(len(data))])

    def stays(self, left: int, right: int) -> bool:
        """Whether the two tokens, encoded together, come out as they are."""
        key = (left, right)
        found = self.settled.get(key)
        if found is None:
            found = self.window(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self.settled) > 200_000:
                self.settled.clear()
            self.settled[key] = found
        return found

    def join(self, a: list[int], b: list[int]) -> list[int]:
        if not a or not b or self.stays(a[-1], b[0]):
            return a + b
        left = right = 1
        while True:
            i, j = max(0, len(a) - left), min(len(b), right)
            middle = self.window(b"".join(self.bytes_of[t] for t in a[i:] + b[:j]))
            left_ok = i == 0 or self.stays(a[i - 1], middle[0])
            right_ok = j == len(b) or self.stays(middle[-1], b[j])
            if left_ok and right_ok:
                return a[:i] + middle + b[j:]
            left += left if not left_ok else 0
            right += right if not right_ok else 0

    def encode(self, piece: bytes) -> list[int]:
        """Halves, level by level from leaves of LEAF bytes, so that a long piece needs no deep recursion. A piece that is a
        token as a whole is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        level = [self.window(piece[i : i + LEAF]) for i in range(0, len(piece), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def decode(self, ids: list[int]) -> bytes:
        """Joins neighbours' bytes, runs of 4,096 tokens as leaves."""
        level = [b"".join(map(self.bytes_of.__getitem__, ids[i : i + 4096])) for i in range(0, len(ids), 4096)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


class Known(dict):
    """Piece to its ids as little-endian 32-bit integers."""

    def __init__(self, monoid: Monoid):
        self.monoid = monoid

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        ids = np.asarray(self.monoid.encode(raw), "<u4").tobytes()
        if len(raw) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


def _encoded(path: str, pattern: str, keep: int, ids: bool, decoded: bool):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import regex

        monoid = Monoid(read_ranks(path))
        known = Known(monoid)
        pieces = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")).findall
        for batch, _, _ in text_chunks(batches):  # small steps: tokens take more room than texts
            counts, ids_sha, back_sha, packs, backs = [], [], [], [], []
            for value in batch.column(keep):
                packed = b"".join(map(known.__getitem__, pieces(value.as_py() or "")))
                back = monoid.decode(np.frombuffer(packed, "<u4").tolist())
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                back_sha.append(hashlib.sha256(back).hexdigest())
                if ids:
                    packs.append(packed)
                if decoded:
                    backs.append(back)
            cols = [*batch.columns[:keep], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
            names = [*batch.schema.names[:keep], "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packs), "<i4"))))
                names.append("ids")
            if decoded:
                cols.append(pa.array(backs, pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, *, keep: tuple[str, ...] = ("doc_id",), ids: bool = True, decoded: bool = True) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of each text, and on demand ids and the decoded bytes."""
    bounded(docs.sparkSession)
    kept = [docs[c].alias(f"c{i}") for i, c in enumerate(keep)]
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded binary" * decoded
    out = docs.select(*kept, docs["text"].cast("string").alias("text")).mapInArrow(_encoded(ranks_path, pattern, len(keep), ids, decoded), schema)
    return out.toDF(*keep, *out.columns[len(keep) :])
