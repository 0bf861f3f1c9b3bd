"""Cross-tokenizer alignment by a postings cogroup.

A text is encoded by tokenizer A (byte-level BPE) with a space before it, and by B
(pieces), which adds that space itself.  Where a token of A and one of B end at the same byte, the
two are linked, and the offsets where both end cut the tokens into groups.

1. A batch of texts (some megabytes) is encoded once.  Its links become postings: the
   multiplicity of each (A id, B id) pair in each document.  They are dealt to buckets
   by B id, as packed rows of the batch, and stored with the documents' own numbers.
2. A piece is one bucket of some batches; pieces have a bounded size, so a B id that
   every document holds is split over them.  Each piece sums its pairs, the sums are
   added up by pair, and each B id's highest count is found.
3. Postings and counts are shuffled together by piece and sorted, counts first, so
   Spark spills them as it needs.  A task streams through: it holds the counts of one bucket
   and one row of postings, and emits what that row adds to its batch's documents.
4. The contributions are summed by document.

What is shuffled back is two numbers per document and bucket; counts go once to each piece.

Defined results: null and empty texts, and those whose tokens do not spell the space and
the text, have no tokens: zeros and an empty column; texts are read whole; repeated rows count
again and give repeated results; an empty table gives an empty one; only the two named
columns are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._io import Scratch, stored
from palimpsest.llm._pack import pack, unpack
from palimpsest.llm._words import U, chunks, give_back, mix

BUCKETS = 32
BATCH_BYTES = 4 << 20  # of text that is encoded, and whose postings are dealt, at once
PIECE_BYTES = 1 << 30  # of text whose postings lie in one piece of each bucket
_FIELDS = "batch string, bucket int, pairs binary, totals binary, sizes binary, docs binary, times binary, place int, `{id}` {kind}, n_a long, n_b long, n_groups long, groups_sha256 string"


def _byte_of() -> dict[str, int]:
    """The byte of each letter of the byte-level alphabet: printable ones stand for themselves, the others for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, bytes_of: list[bytes], encode):
        if not all(bytes_of):
            raise ValueError("a token without bytes has no end of its own")
        self.bytes_of, self.encode = bytes_of, encode
        self.length = np.array([len(b) for b in bytes_of], np.int64)

    @classmethod
    def byte_level(cls, path: str, pattern: str) -> Side:
        """A byte-level BPE from its JSON file.  Where ids follow the merges, ids are ranks, and tiktoken encodes some four times faster than the file's own library."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_of()
        special = {a["id"]: a["content"] for a in spec["added_tokens"]}
        vocab = {**spec["model"]["vocab"], **{c: i for i, c in special.items()}}
        bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            bytes_of[i] = token.encode() if i in special else bytes(map(letters.__getitem__, token))
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if all(vocab["".join(m)] == 256 + k for k, m in enumerate(merges)):
            import tiktoken

            ranks = {b: i for i, b in enumerate(bytes_of) if i not in special and b}
            own = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            return cls(bytes_of, lambda texts: [own.encode_ordinary(t) for t in texts])
        import tokenizers

        plain = tokenizers.Tokenizer.from_file(path)
        plain.encode_special_tokens = True
        return cls(bytes_of, lambda texts: [plain.encode(t, add_special_tokens=False).ids for t in texts])

    @classmethod
    def pieces(cls, path: str) -> Side:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        bytes_of = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        return cls(bytes_of, lambda texts: own.encode(texts, num_threads=1))


_KNOWN: dict[tuple[str, str, str], tuple[Side, Side, list[bytes]]] = {}


def _sides(a: str, b: str, pattern: str) -> tuple[Side, Side, list[bytes]]:
    """Both tokenizers, and the pieces of the group column: A ids before ',' and '|', B ids before ',' and ';'."""
    if (a, b, pattern) not in _KNOWN:
        x, y = Side.byte_level(a, pattern), Side.pieces(b)
        _KNOWN[a, b, pattern] = x, y, [b"%d%b" % (i, mark) for side, marks in ((x, (b",", b"|")), (y, (b",", b";"))) for mark in marks for i in range(len(side.bytes_of))]
    return _KNOWN[a, b, pattern]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each text has."""
    size = np.array([len(x) for x in ids], np.int64)
    return np.fromiter((i for x in ids for i in x), np.int64, int(size.sum())), size


def aligned(texts: list[str | None], a: Side, b: Side, shown: list[bytes]) -> tuple[list[tuple[int, int, int, str]], np.ndarray, np.ndarray, np.ndarray]:
    """((n_a, n_b, n_groups, groups_sha256) of each text; text, A id and B id of each link."""
    rows, live = [(0, 0, 0, "")] * len(texts), [k for k, t in enumerate(texts) if t]
    ids_a, ids_b = a.encode([" " + texts[k] for k in live]), b.encode([texts[k] for k in live])
    good = [j for j, k in enumerate(live) if (want := (" " + texts[k]).encode()) == b"".join(map(a.bytes_of.__getitem__, ids_a[j])) and want == b"".join(map(b.bytes_of.__getitem__, ids_b[j]))]
    x, n_a = _flat([ids_a[j] for j in good])
    y, n_b = _flat([ids_b[j] for j in good])
    end_a, end_b = np.cumsum(a.length[x]), np.cumsum(b.length[y])  # of all texts one after the other, as both sides spell the same bytes
    last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
    # the group column: both sides in order of (group, side)
    vocab_a = len(a.bytes_of)
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    piece = np.concatenate([x + vocab_a * last_a, 2 * vocab_a + y + len(b.bytes_of) * last_b])
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    piece, edge, done = piece[order], np.cumsum(n_a + n_b), 0
    at = np.flatnonzero(last_a)
    text = np.repeat(np.arange(len(good)), n_a)[at]
    many = np.bincount(text, minlength=len(good))
    for j, e in enumerate(edge.tolist()):
        column = b"".join(map(shown.__getitem__, piece[done:e].tolist()))[:-1]
        rows[live[good[j]]] = (int(n_a[j]), int(n_b[j]), int(many[j]), sha256(column).hexdigest())
        done = e
    return rows, np.array([live[j] for j in good], np.int64)[text], x[at], y[last_b]


def _dealt(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes]]:
    """Packed postings by bucket: pairs (B id and A id as one number), their sums, and each pair's documents and multiplicities."""
    bucket = (mix(b.astype(U), 0xA116) % U(BUCKETS)).astype(np.int64)
    order = np.lexsort((doc, b << 20 | a, bucket))
    bucket, pair, doc = bucket[order], (b << 20 | a)[order], doc[order]
    head = np.ones(len(doc), bool)
    head[1:] = (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    bucket, pair, doc, times = bucket[at], pair[at], doc[at], np.diff(np.append(at, len(head)))
    edge = np.searchsorted(bucket, np.arange(BUCKETS + 1))
    for k in np.flatnonzero(np.diff(edge)).tolist():
        s = slice(edge[k], edge[k + 1])
        p = pair[s]
        new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        yield k, pack(p[new]), pack(np.add.reduceat(times[s], new)), pack(np.diff(np.append(new, len(p)))), pack(doc[s]), pack(times[s])


def _postings(batches: Iterator[pa.RecordBatch], names: list[str], a: str, b: str, pattern: str) -> Iterator[pa.RecordBatch]:
    side_a, side_b, shown = _sides(a, b, pattern)
    kinds = [pa.string(), pa.int32(), *[pa.binary()] * 5, pa.int32(), None, *[pa.int64()] * 3, pa.string()]

    def out(columns: list, n: int, kind: pa.DataType) -> pa.RecordBatch:
        arrays = [pa.nulls(n, k or kind) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        for part in chunks(batch, "__text", BATCH_BYTES):
            mark, n, ids = uuid.uuid4().hex, part.num_rows, part.column("__id")
            rows, *links = aligned(part.column("__text").to_pylist(), side_a, side_b, shown)
            yield out([[mark] * n, *[None] * 6, list(range(n)), ids, *map(list, zip(*rows))], n, ids.type)
            dealt = list(zip(*_dealt(*links)))
            if dealt:
                yield out([[mark] * len(dealt[0]), *map(list, dealt), *[None] * 6], len(dealt[0]), ids.type)
            give_back()


def _summed(t: pa.Table) -> pa.Table:
    """The sum of each pair of a piece."""
    pair, total = (np.concatenate([unpack(x) for x in t.column(c).to_pylist()]) for c in ("pairs", "totals"))
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    return pa.table({"pair": pa.array(pair[at]), "n": pa.array(np.add.reduceat(total[order], at))})


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces, counts before postings: what each row of postings adds to its batch's documents."""
    now, held, pair, count = None, [], None, None
    for batch in batches:
        key = list(zip(batch.column("bucket").to_pylist(), batch.column("salt").to_pylist()))
        out = []
        number, n = np.asarray(batch.column("pair").fill_null(-1)), np.asarray(batch.column("n").fill_null(0))
        i = 0
        while i < len(key):
            if key[i] != now:
                now, held, pair = key[i], [], None
            if number[i] >= 0:
                j = i + 1
                while j < len(key) and key[j] == now and number[j] >= 0:
                    j += 1
                held.append((number[i:j], n[i:j]))
                i = j
                continue
            if pair is None:
                pair, count = (np.concatenate(x) for x in zip(*held))
                order = np.argsort(pair)
                pair, count, held = pair[order], count[order], []
                head = np.flatnonzero(np.concatenate([[True], pair[1:] >> 20 != pair[:-1] >> 20]))
                highest = np.repeat(np.maximum.reduceat(count, head), np.diff(np.append(head, len(pair))))
                best = count == highest
            own, size, doc, times = (unpack(batch.column(c)[i].as_py()) for c in ("pairs", "sizes", "docs", "times"))
            at = np.repeat(np.searchsorted(pair, own), size)
            total, top = np.zeros(int(doc.max()) + 1, np.int64), np.zeros(int(doc.max()) + 1, np.int64)
            np.add.at(total, doc, times * count[at])
            np.add.at(top, doc, times * best[at])
            some = np.flatnonzero(total)
            out.append((batch.column("batch")[i].as_py(), pack(some), pack(top[some]), pack(total[some])))
            i += 1
        kinds = [pa.string(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 4, kinds)], names=["batch", "docs", "best", "total"])


def _finished(docs: pa.Table, parts: pa.Table, names: list[str]) -> pa.Table:
    """Contributions of all buckets, summed by document of one batch."""
    place = np.asarray(docs.column("place"))
    best, total = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    for d, t, c in zip(*(parts.column(x).to_pylist() for x in ("docs", "best", "total"))):
        at = unpack(d)
        best[at] += unpack(t)
        total[at] += unpack(c)
    groups = docs.column("n_groups")
    columns = [docs.column(names[0]), docs.column("n_a"), docs.column("n_b"), groups, groups, pa.array(best[place]), pa.array(total[place]), docs.column("groups_sha256")]
    return pa.table(columns, names=names)


def align(df: DataFrame, path_a: str, path_b: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row per input row.

    The two paths are files that every executor has at that place (they come with an
    installed library); ``pattern`` splits A's texts before its merges.  As every token has bytes,
    a group holds one link."""
    kept = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    size = kept.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    salts = int(max(1, -(-size // PIECE_BYTES)))
    kind = kept.schema["__id"].dataType.simpleString()
    fields = _FIELDS.format(id=id_col, kind=kind)
    names = ["batch", "bucket", "pairs", "totals", "sizes", "docs", "times", "place", id_col, "n_a", "n_b", "n_groups", "groups_sha256"]
    with Scratch(df.sparkSession) as scratch:
        found = scratch.stored(kept.mapInArrow(lambda it: _postings(it, names, path_a, path_b, pattern), fields), "postings", "none")
        salted = found.where("bucket is not null").withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int"))
        pieces = BUCKETS * salts
        sums = salted.select("bucket", "salt", "pairs", "totals").repartition(pieces, "bucket", "salt").groupBy("bucket", "salt").applyInArrow(_summed, "pair long, n long")
        counts = sums.groupBy("pair").agg(F.sum("n").alias("n"))
        bucket_of = salted.select("bucket", "salt").distinct()  # the pieces there are
        counts = scratch.stored(counts.mapInArrow(_with_bucket, "bucket int, pair long, n long"), "counts")
        sent = counts.join(F.broadcast(bucket_of) if pieces <= 100_000 else bucket_of, "bucket").select("bucket", "salt", F.lit(0).alias("kind"), "pair", "n", *(F.lit(None).cast(t).alias(c) for c, t in (("batch", "string"), ("pairs", "binary"), ("sizes", "binary"), ("docs", "binary"), ("times", "binary"))))
        both = sent.unionByName(salted.select("bucket", "salt", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("pair"), F.lit(None).cast("long").alias("n"), "batch", "pairs", "sizes", "docs", "times"))
        streamed = both.repartition(pieces, "bucket", "salt").sortWithinPartitions("bucket", "salt", "kind").mapInArrow(_streamed, "batch string, docs binary, best binary, total binary")
        docs = found.where("place is not null").select("batch", "place", id_col, "n_a", "n_b", "n_groups", "groups_sha256")
        result = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
        out = docs.groupBy("batch").cogroup(streamed.groupBy("batch")).applyInArrow(lambda d, p: _finished(d, p, result), schema)
        return stored(out, "alignment")


def _with_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bucket = (mix((np.asarray(batch.column("pair")) >> 20).astype(U), 0xA116) % U(BUCKETS)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column("pair"), batch.column("n")], names=["bucket", "pair", "n"])
