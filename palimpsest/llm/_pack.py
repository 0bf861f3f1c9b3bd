"""Packed arrays: many small values as one binary cell."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(a: np.ndarray) -> bytes:
    """An integer array as differences in byte planes, compressed."""
    d = np.diff(a.astype(np.int64), prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.int64))


def squeeze(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b)


def unsqueeze(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def low_bytes(h: np.ndarray, n: int) -> bytes:
    """The n low bytes of each 64-bit value."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low_bytes(b: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, n)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :n] = raw
    return out.reshape(-1).view("<u8")
