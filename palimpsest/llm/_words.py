"""Vectorised words and hashes over Arrow text columns.

A batch of texts is one UTF-8 byte buffer with offsets.  Words are found with a
256-entry byte table, and no Python object is made per word (but for very long ones).

A word's hash is the polynomial of its seven-byte blocks and its length modulo the
prime 2**61 - 1, at a point drawn from a key.  Operators that take equal hashes for
equal words draw the key anew for each run (``new_key``), so whoever writes the
texts can't know it: two different words of up to 112 bytes then have the same hash
with odds of at most 17 / 2**61, whatever they are; longer ones go through keyed
BLAKE2.  Windows of words are Rabin-Karp sums modulo 2**64 of these hashes.  An odd
base modulo 2**64 loses bits on long self-similar sequences: 8 of the 64 for
windows of 8 to 15 words, no more than these.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
P61 = (1 << 61) - 1
LONG = 112  # bytes of a word from which on it is hashed by itself
_WORD_BASE = 0xD6E8FEB86659FD95
_BLOCK = 1 << 18  # bytes, or words, hashed at once

#: Words of every byte but the six ASCII white-space characters.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Words of digits, ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up), 1024)
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up, self.down


_WORDS = _Powers(_WORD_BASE)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ U(seed & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another system's C library
    _LIBC = None

_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)], U)  # the low k bytes


def new_key() -> int:
    """A secret point for the word hashes of one run; it goes to the tasks with their code, so a task that is run again has the same."""
    return int.from_bytes(os.urandom(7), "little") | 1


def times_plus(a: np.ndarray, k: int, b: np.ndarray) -> np.ndarray:
    """a * k + b modulo 2**61 - 1 for values below it, by halves of 32 bits."""
    low, p = U(0xFFFFFFFF), U(P61)
    ah, al, kh, kl = a >> U(32), a & low, U(k >> 32), U(k & 0xFFFFFFFF)
    mid = ah * kl + al * kh  # counts 2**32; 2**61 is 1
    end = al * kl
    out = (ah * kh << U(3)) + (mid >> U(29)) + ((mid & U((1 << 29) - 1)) << U(32)) + (end & p) + (end >> U(61)) + b
    out = (out & p) + (out >> U(61))
    return np.where(out >= p, out - p, out)


@dataclass
class Words:
    """Words of a batch: byte ranges, and the word range of each text."""

    data: np.ndarray  # uint8, lower-cased if asked for
    start: np.ndarray  # int64 byte positions
    end: np.ndarray
    first: np.ndarray  # int64, texts + 1: text t has words first[t]..first[t+1]

    def __len__(self) -> int:
        return len(self.start)

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text)

    def hashes(self, key: int = 0x9E3779B97F4A7C15) -> np.ndarray:
        """uint64 per word."""
        point = (key * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (P61 - 2) + 1
        out = np.empty(len(self), U)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        blocks = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))  # eight bytes from each place
        for i in range(0, len(self), _BLOCK):
            start, size = self.start[i : i + _BLOCK], (self.end - self.start)[i : i + _BLOCK]
            h = blocks[start] & _KEEP[np.minimum(size, 7)]
            at = np.flatnonzero((size > 7) & (size <= LONG))
            for done in range(7, LONG, 7):
                if not len(at):
                    break
                h[at] = times_plus(h[at], point, blocks[start[at] + done] & _KEEP[np.minimum(size[at] - done, 7)])
                at = at[size[at] > done + 7]
            h = times_plus(h, point, size.astype(U) % U(P61))
            for j in np.flatnonzero(size > LONG).tolist():
                word = self.data[start[j] : start[j] + size[j]].tobytes()
                h[j] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
            out[i : i + _BLOCK] = mix(h)
        return out


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (texts + 1) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Maximal runs of the table's bytes, cut at the ends of texts."""
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = table[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step[: len(data)] == 1) if len(data) else np.zeros(0, np.int64), np.flatnonzero(step == -1)
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return Words(data, start, end, np.searchsorted(start, offsets).astype(np.int64))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of every n consecutive hashes; position i covers i..i+n."""
    out = np.empty(max(0, len(h) - n + 1), U)
    for i in range(0, len(out), _BLOCK):
        own = h[i : i + _BLOCK + n - 1]
        up, down = _WORDS.get(len(own) + 1)
        total = np.zeros(len(own) + 1, U)
        np.cumsum(own * up[: len(own)], out=total[1:])
        m = len(own) - n + 1
        out[i : i + m] = mix((total[n:] - total[:m]) * down[:m], n)
    return out


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks, and what it holds is its machine's."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def chunks(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of a batch with at most that many bytes of text, or one row."""
    col = batch.column(column)
    n = batch.num_rows
    if not n:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1]
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, int(off[i]) + most, "right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i)
        i = j
    give_back()
