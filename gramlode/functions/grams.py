"""Grams: 3 ASCII-lowered bytes as one INT, b0 << 16 | b1 << 8 | b2."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: FNV-1a, 64 bits (fixed values).
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: The two characters outside ASCII that case folding maps to ASCII letters (fixed values).
FOLDS = {"K".encode(): b"k", "ſ".encode(): b"s"}


def fnv1a(data: bytes) -> int:
    h = FNV_START
    for b in data:
        h = (h ^ b) * FNV_PRIME & (1 << 64) - 1
    return h


def gram_key(raw: bytes) -> int:
    return int.from_bytes(raw, "big")


def gram_bytes(key: int) -> bytes:
    return key.to_bytes(3, "big")


def _keys(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.int32)
    return b[:-2] << 16 | b[1:-1] << 8 | b[2:]


def distinct_grams(content: bytes) -> np.ndarray:
    """Sorted. Where the content holds a character that folds to an ASCII letter, also the grams it has when folded."""
    low = content.lower()  # bytes.lower touches A-Z only
    keys = _keys(low) if len(low) > 2 else np.zeros(0, np.int32)
    if any(c in low for c in FOLDS):
        for c, to in FOLDS.items():
            low = low.replace(c, to)
        keys = np.concatenate((keys, _keys(low) if len(low) > 2 else keys[:0]))
    if len(keys) > 1 << 16:  # cheaper than sorting
        seen = np.zeros(1 << 24, bool)
        seen[keys] = True
        return np.flatnonzero(seen).astype(np.int32)
    return np.unique(keys)


def extract(batches: Iterator) -> Iterator:
    """mapInArrow: (file_id, content) to (gram, file_id), one row for each distinct gram of a file."""
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(0).to_pylist()
        held, some, n = [], [], 0
        for file_id, value in zip(ids, batch.column(1)):
            content = value.as_py()
            grams = distinct_grams(content.encode() if isinstance(content, str) else content or b"")
            some.append(np.full(len(grams), file_id, np.int64))
            held.append(grams)
            n += len(grams)
            if n > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.concatenate(some))], names=["gram", "file_id"])
                held, some, n = [], [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.concatenate(some))], names=["gram", "file_id"])
