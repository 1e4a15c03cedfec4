"""Rows of numbers as one binary column: what tasks hand each other in bulk costs Spark a row for each message, not one for each number."""

from __future__ import annotations

import json
import struct

import numpy as np
import zstandard


def pack(**arrays: np.ndarray) -> bytes:
    """One-dimensional arrays under their names; bytes of equal weight stand together, so that small numbers cost little."""
    head = json.dumps([(k, a.dtype.str, len(a)) for k, a in arrays.items()]).encode()
    body = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays.values() if len(a))
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(head)) + head + body)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + n, {}
    for name, kind, count in json.loads(raw[4 : 4 + n]):
        kind = np.dtype(kind)
        size = count * kind.itemsize
        out[name] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, count).T).view(kind).reshape(count) if count else np.zeros(0, kind)
        at += size
    return out


class Codes(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def cuts(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    start = runs(sorted_keys).tolist()
    return list(zip(start, [*start[1:], len(sorted_keys)][: len(start)], strict=True))


def cutter(outside: list[tuple[int, int]]) -> bytes:
    """A table for ``bytes.translate``: bytes in the ranges become blanks, A-Z small letters; ``split`` then cuts the words."""
    table = bytearray(range(256))
    for a, b in outside:
        table[a : b + 1] = b" " * (b + 1 - a)
    for upper in range(65, 91):
        if table[upper] != 32:
            table[upper] = upper + 32
    return bytes(table)
