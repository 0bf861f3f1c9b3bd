"""Byte-level BPE encoding and decoding by corpus-level merge replay.

1. Texts are dealt, compressed, to groups of some megabytes by a hash.  A group sends
   each of its words once to the corpus's word table, in partitions by another hash.
2. There every distinct word is laid out once as a linked list of byte tokens.  An
   inverted index from merge rank (a token pair) to the positions where that pair
   stands is replayed in rank order; each merge touches only its two neighbours,
   whose new pairs enter the index.  The ids go back to the groups that sent the word.
3. There they meet the group's texts and are put together; decoding reads the ids alone.

Both passes over the texts read one exchange; what a group holds depends on the rows
alone, so a lost part of it can be made again.  Groups, partitions of the word table
and tasks follow the size of the input, so their sizes do not.

Defined results: a null text is empty (0 tokens); any length is encoded whole;
repeated rows give repeated results; an empty table gives an empty one; only the
two named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._pack import squeeze, unsqueeze
from palimpsest.llm._words import buffers, chunks, give_back

PAIRS = 500_000  # joined pairs that a worker keeps
GROUP_BYTES = 8 << 20  # of text that share a list of words
BUCKET_BYTES = 16 << 20  # of text for each partition of the word table, and each task
BATCH_BYTES = 1 << 20  # of text that is put together at once
REPLAY_BYTES = 1 << 20  # distinct words that are replayed at once


class Vocabulary:
    """Ranks of a byte-level BPE; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.byte_pair = np.array([ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)], np.int64)
        self.pair: dict[int, int] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())})

    def rank(self, a: int, b: int) -> int:
        """Rank of the joined pair, or -1."""
        key = a << 20 | b
        r = self.pair.get(key)
        if r is None:
            if len(self.pair) > PAIRS:
                self.pair.clear()
            r = self.pair[key] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word."""
        return [np.frombuffer(x, "<u4").tolist() for x in self.replay_packed(words)]

    def replay_packed(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, as little-endian unsigned 32-bit integers.  A word that
        is a token needs no merge."""
        whole = [self.ranks.get(w) for w in words]
        merged = iter(self._merged([w for w, r in zip(words, whole) if r is None]))
        return [next(merged) if r is None else r.to_bytes(4, "little") for r in whole]

    def _merged(self, words: list[bytes]) -> list[bytes]:
        rank, known = self.rank, self.pair.get
        # every word's byte tokens in one list, with -1 after each word
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size + 1) - 1
        n = int(ends[-1]) + 1 if len(words) else 0
        if not n:
            return []
        inside = np.ones(n, bool)
        inside[ends] = False
        raw = np.frombuffer(b"".join(words), np.uint8)
        start = np.full(n, -1, np.int64)
        start[inside] = self.single[raw]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        # the inverted index: merge rank -> positions where that pair stands
        index: dict[int, list[int]] = {}
        byte = np.zeros(n, np.int64)
        byte[inside] = raw
        at = np.flatnonzero(inside[:-1] & inside[1:])
        ranks = self.byte_pair[byte[at] << 8 | byte[at + 1]]
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cut = np.flatnonzero(np.diff(ranks)) + 1
        for p, q in zip([0, *cut.tolist()], [*cut.tolist(), len(at)]):
            if q > p:
                index[int(ranks[p])] = at[p:q].tolist()
        token = start.tolist()
        heap = sorted(index)
        while heap:
            r = heappop(heap)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            for k, p in enumerate(places):
                a = token[p]
                if a < 0:
                    continue
                q = right[p]
                b = token[q]
                if b < 0:
                    continue
                s = known(a << 20 | b)
                if (rank(a, b) if s is None else s) != r:
                    continue
                token[p], token[q] = r, -2
                q = right[p] = right[q]
                left[q] = p
                lower = False
                b = token[q]
                if b >= 0:
                    s = known(r << 20 | b)
                    if s is None:
                        s = rank(r, b)
                    if s >= 0:
                        lower = s < r
                        if s in index:
                            index[s].append(p)
                        else:
                            index[s] = [p]
                            heappush(heap, s)
                q = left[p]
                b = token[q] if q >= 0 else -1
                if b >= 0:
                    s = known(b << 20 | r)
                    if s is None:
                        s = rank(b, r)
                    if s >= 0:
                        lower |= s < r
                        if s in index:
                            index[s].append(q)
                        else:
                            index[s] = [q]
                            heappush(heap, s)
                if lower:  # a lower rank goes first; the rest of this one waits
                    if k + 1 < len(places):
                        index.setdefault(r, []).extend(places[k + 1 :])
                        heappush(heap, r)
                    break
        done = np.array(token, np.int64)
        live = done >= 0
        packed = done[live].astype("<u4").tobytes()
        upto = (4 * np.cumsum(live)[ends]).tolist()
        return [packed[p:q] for p, q in zip([0, *upto[:-1]], upto)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_KNOWN: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _KNOWN:
        _KNOWN[path] = Vocabulary.read(path)
    return _KNOWN[path]


def _u4(values) -> bytes:
    return np.asarray(values, "<u4").tobytes()


def _texts(t: pa.Table, split) -> Iterator[list[str]]:
    """The words of one text after the other."""
    for z in t.column("z"):
        yield split(unsqueeze(z.as_py()).decode("utf-8", "surrogatepass"))


def _listed(t: pa.Table, split, buckets: int) -> pa.Table:
    """The distinct words of one group: a row for each bucket."""
    found: dict[int, list[bytes]] = {}
    seen: set[str] = set()
    for words in _texts(t, split):
        seen.update(words)
    for w in seen:
        x = w.encode("utf-8", "surrogatepass")
        found.setdefault(zlib.crc32(x) % buckets, []).append(x)
    return pa.table({
        "group": pa.array([t.column("group")[0].as_py()] * len(found), pa.int32()), "bucket": pa.array(list(found), pa.int32()),
        "a": pa.array([squeeze(_u4([len(w) for w in c])) for c in found.values()], pa.binary()), "b": pa.array([squeeze(b"".join(c)) for c in found.values()], pa.binary()),
    })


def _cut(lengths: bytes, data: bytes, unit: int = 1) -> list[bytes]:
    end = (unit * np.cumsum(np.frombuffer(lengths, "<u4"), dtype=np.int64)).tolist()
    return [data[i:j] for i, j in zip([0, *end], end)]


def _replayed(t: pa.Table, v: Vocabulary) -> pa.Table:
    """One partition of the word table: every distinct word once; ids for each stretch that has it."""
    rows = [_cut(unsqueeze(a), unsqueeze(b)) for a, b in zip(t.column("a").to_pylist(), t.column("b").to_pylist())]
    ids: dict[bytes, bytes] = dict.fromkeys(w for r in rows for w in r)
    new, held = [], 0
    for w in [*ids, None]:
        if w is None or held > REPLAY_BYTES:
            ids.update(zip(new, v.replay_packed(new)))
            new, held = [], 0
        if w is not None:
            new.append(w)
            held += len(w)
    out = [[ids[w] for w in r] for r in rows]
    give_back()
    lengths, data = ([squeeze(x) for x in c] for c in zip(*((_u4([len(x) // 4 for x in r]), b"".join(r)) for r in out)))
    return pa.table({"group": t.column("group"), "a": t.column("a"), "b": t.column("b"), "c": pa.array(lengths, pa.binary()), "d": pa.array(data, pa.binary())})


def _joined(t: pa.Table, known: pa.Table, split, v: Vocabulary, id_col: str) -> pa.Table:
    """The ids of a group's texts from those of its words, and the bytes that they decode to."""
    ids: dict[str, bytes] = {}
    for a, b, c, d in zip(*(known.column(x).to_pylist() for x in "abcd")):
        ids.update(zip((w.decode("utf-8", "surrogatepass") for w in _cut(unsqueeze(a), unsqueeze(b))), _cut(unsqueeze(c), unsqueeze(d), 4)))
    get, bytes_of = ids.__getitem__, v.bytes_of.__getitem__
    # batches of bounded size, since a group's ids and bytes as one would be tens of megabytes in the JVM
    out: list[pa.RecordBatch] = []
    packed: list[bytes] = []
    plain: list[bytes] = []
    held = done = 0
    keys = t.column(id_col).combine_chunks()
    for n, words in enumerate(_texts(t, split), 1):
        packed.append(b"".join(map(get, words)))
        plain.append(b"".join(map(bytes_of, np.frombuffer(packed[-1], "<u4").tolist())))
        held += len(plain[-1])
        if held > BATCH_BYTES or n == t.num_rows:
            arrays = [keys.slice(done, n - done), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(plain, pa.binary())]
            out.append(pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_tokens", "ids", "decoded"]))
            packed, plain, held, done = [], [], 0, n
    give_back()
    if out:
        return pa.Table.from_batches(out)
    return pa.table({id_col: keys, "n_tokens": pa.array([], pa.int64()), "ids": pa.array([], pa.binary()), "decoded": pa.array([], pa.binary())})


def bpe(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens long, ids binary (little-endian unsigned 32-bit), decoded binary, one row per input row.

    ``path`` is a rank file that every executor has at that place (it comes with
    an installed library), ``pattern`` splits texts before the merges.
    """
    text = F.col(text_col).cast("string")
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups, buckets = int(max(16, size // GROUP_BYTES)), int(max(16, size // BUCKET_BYTES))
    kept = df.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(groups)).cast("int").alias("group"), F.col(id_col).alias(id_col), text.alias("__text"))
    kind = kept.schema[id_col].dataType.simpleString()

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text", 4 << 20):
                data, off = buffers(part.column("__text"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([squeeze(data[a:b].tobytes()) for a, b in zip(off[:-1], off[1:])], pa.binary())], names=["group", id_col, "z"])

    def splitter():
        import regex

        return regex.compile(pattern).findall

    parts = "group int, bucket int, a binary, b binary"
    docs = kept.mapInArrow(zipped, f"group int, `{id_col}` {kind}, z binary").repartition(buckets, "group")
    words = docs.groupBy("group").applyInArrow(lambda t: _listed(t, splitter(), buckets), parts).repartition(buckets, "bucket")
    known = words.groupBy("bucket").applyInArrow(lambda t: _replayed(t, vocabulary(path)), "group int, a binary, b binary, c binary, d binary").repartition(buckets, "group")
    out = f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary"
    return docs.groupBy("group").cogroup(known.groupBy("group")).applyInArrow(lambda t, k: _joined(t, k, splitter(), vocabulary(path), id_col), out)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
