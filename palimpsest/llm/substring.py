"""Substring dedup: repeated token windows become maximal removal intervals.

Every window of ``n`` words gets a Rabin-Karp hash.  A word goes if a window over
it also starts in a row with a smaller id; overlapping windows merge into maximal
intervals.

1. Where the texts are read, a stretch of them is combined first: of each hash
   only the windows of the stretch's smallest id go on, the others are already
   known to be repeats.  A window that stands in a third of all rows thus reaches
   its bucket once per stretch.
2. Hashes are dealt to buckets by their top bits, as packed arrays (about nine
   bytes a window).  A bucket finds each hash's smallest id and returns the
   repeats.  The number of buckets follows the size of the input, so a bucket
   stays at about ``bucket_bytes`` of text; there are as many tasks.
3. Repeats meet their texts by a hash of the id, and the intervals are cut out.

Windows are told apart by 61 bits of hash and more as buckets grow, under a key drawn
for each run (see ``_words``): of N windows, one counts as repeated though none is equal
to it with odds of about N / 2**53 at worst, whatever the texts, and N / 2**61 for texts
that were not made to repeat themselves.  Different texts under one id are told apart
by 16 bits more: two of them swap their removals with odds of 1 in 65,536.

Defined results: null and empty texts have no words and lose none; a null id
counts as larger than every other; rows with one id never remove each other's
words, and rows that repeat keep and lose the same; texts are read whole; an
empty table gives an empty one; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._pack import from_low_bytes, low_bytes, pack, squeeze, unpack, unsqueeze
from palimpsest.llm._words import SPACED, U, Words, buffers, chunks, mix, new_key, windows, words

LAST = np.iinfo(np.int64).max  # stands for a null id
STRETCH_BYTES = 6 << 20
_FLAGS = "docs binary, tags binary, counts binary, places binary"


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(LAST)).astype(np.int64)


def _text_tags(w: Words, h: np.ndarray) -> np.ndarray:
    """16 bits of each text's words, to tell apart different texts of one id."""
    place = np.arange(len(h)) - np.repeat(w.first[:-1], w.per_text)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(mix(h + place.astype(U)), out=total[1:])
    return (mix(total[w.first[1:]] - total[w.first[:-1]]) & U(0xFFFF)).astype(np.int64)


def _window_hashes(w: Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie inside one text, and their hashes."""
    every = windows(h, n)
    inside = np.ones(len(every) + 1, bool)[: len(every)]
    for k in range(1, n):  # the n - 1 starts before each text's end
        bad = w.first[1:] - k
        bad = bad[(bad >= w.first[:-1]) & (bad < len(every))]
        inside[bad] = False
    at = np.flatnonzero(inside)
    return at, every[at]


def _rows(key: np.ndarray, count: int, text: np.ndarray, ids: np.ndarray, tags: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, tuple[bytes, bytes, bytes, bytes]]]:
    """Packed rows by key: entries must come in order of text and place."""
    order = np.argsort(key.astype(np.uint16) if count <= 1 << 16 else key, kind="stable")
    key, text, place = key[order], text[order], place[order]
    edge = np.searchsorted(key, np.arange(count + 1))
    for k in np.flatnonzero(np.diff(edge)):
        own = slice(edge[k], edge[k + 1])
        t = text[own]
        new = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        d = t[new]
        yield int(k), order[own], (pack(ids[d]), tags[d].astype("<u2").tobytes(), pack(np.diff(np.append(new, len(t)))), pack(place[own]))


def _entries(docs: bytes, tags: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = unpack(counts)
    return np.repeat(unpack(docs), n), np.repeat(np.frombuffer(tags, "<u2").astype(np.int64), n), unpack(places)


def _group(ids: np.ndarray, count: int) -> np.ndarray:
    return (mix(ids.view(U), 0x51ED) % U(count)).astype(np.int64)


def _combine(part: pa.RecordBatch, n: int, bits: int, key: int) -> Iterator[tuple]:
    """The packed rows of one stretch: (bucket, group or -1, hashes, *flags)."""
    ids = _ids(part.column("__id"))
    data, offsets = buffers(part.column("__text"))
    w = words(data, offsets, SPACED)
    h = w.hashes(key)
    at, wh = _window_hashes(w, h, n)
    if not len(at):
        return
    tags, text = _text_tags(w, h), w.text_of()[at]
    place = at - w.first[text]
    order = np.argsort(wh, kind="stable")
    sorted_h = wh[order]
    new = np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])
    group = np.cumsum(new) - 1
    doc = ids[text]
    least = np.empty(len(wh), np.int64)
    least[order] = np.minimum.reduceat(doc[order], np.flatnonzero(new))[group]
    first = doc == least
    own = np.flatnonzero(first)
    for k, rows, packed in _rows((wh[own] >> U(64 - bits)).astype(np.int64), 1 << bits, text[own], ids, tags, place[own]):
        yield k, -1, low_bytes(wh[own[rows]], 7), *packed
    own = np.flatnonzero(~first)
    if len(own):
        for k, _, packed in _rows(_group(doc[own], 1 << bits), 1 << bits, text[own], ids, tags, place[own]):
            yield k, k, b"", *packed


def _repeats(table: pa.Table, count: int) -> pa.Table:
    """Of one bucket: the entries whose hash also stands under a smaller id."""
    rows = table.select(["group", "hashes", "docs", "tags", "counts", "places"]).to_pydict()
    out = [(g, *(rows[c][i] for c in ("docs", "tags", "counts", "places"))) for i, g in enumerate(rows["group"]) if g >= 0]
    sent = [i for i, g in enumerate(rows["group"]) if g < 0]
    if sent:
        h = np.concatenate([from_low_bytes(rows["hashes"][i], 7) for i in sent])
        doc, tag, place = (np.concatenate(x) for x in zip(*(_entries(*(rows[c][i] for c in ("docs", "tags", "counts", "places"))) for i in sent)))
        order = np.argsort(h, kind="stable")
        h = h[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = order[doc[order] > least]
        if len(hit):
            hit = hit[np.lexsort((place[hit], tag[hit], doc[hit]))]
            doc, tag, place = doc[hit], tag[hit], place[hit]
            text = np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]))
            head = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1])
            out += [(g, *packed) for g, _, packed in _rows(_group(doc, count), count, text, doc[head], tag[head], place)]
    return pa.table({c: pa.array([r[k] for r in out], t) for k, (c, t) in enumerate((("group", pa.int32()), ("docs", pa.binary()), ("tags", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())))})


def covered(n_words: int, start: np.ndarray, n: int) -> np.ndarray:
    """Words under any of the windows that start there."""
    edge = np.bincount(start, minlength=n_words + 1) - np.bincount(np.minimum(start + n, n_words), minlength=n_words + 1)
    return np.cumsum(edge)[:n_words] > 0


def joined(w: Words, keep: np.ndarray, sep: int = 0x20) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of each text's kept words, joined by one separator."""
    k = np.flatnonzero(keep)
    first = np.searchsorted(k, w.first)
    length = (w.end - w.start)[k] + 1
    to = np.cumsum(length) - length
    total = int(length.sum())
    src = np.repeat(w.start[k] - to, length) + np.arange(total)
    out = np.append(w.data, np.uint8(sep))[np.minimum(src, len(w.data))] if total else np.zeros(0, np.uint8)
    out[to + length - 1] = sep
    edge = np.append(to, total)[first]
    last = edge[1:][edge[1:] > edge[:-1]] - 1  # the separator after a text's last word
    live = np.ones(total, bool)
    live[last] = False
    return out[live], edge - np.concatenate([[0], np.cumsum(edge[1:] > edge[:-1])])


def _cut(docs: pa.Table, flags: pa.Table, n: int, names: list[str], key: int) -> pa.Table:
    """Cut the repeats out of one group's texts."""
    texts = [unsqueeze(z) for z in docs.column("__z").to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    w = words(np.frombuffer(b"".join(texts), np.uint8), offsets, SPACED)
    gone = np.zeros(len(w), bool)
    if flags.num_rows and len(texts):
        rows = flags.select(["docs", "tags", "counts", "places"]).to_pydict()
        doc, tag, place = (np.concatenate(x) for x in zip(*(_entries(*r) for r in zip(*rows.values()))))
        ids, tags = _ids(docs.column("__id").combine_chunks()), _text_tags(w, w.hashes(key))
        order = np.lexsort((tag, doc))
        doc, tag, place = doc[order], tag[order], place[order]
        step = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]))
        range_of = {(d, t): (a, b) for d, t, a, b in zip(doc[step].tolist(), tag[step].tolist(), step.tolist(), np.append(step[1:], len(doc)).tolist())}
        starts = []
        for k, own in enumerate(zip(ids.tolist(), tags.tolist())):
            if own in range_of:
                a, b = range_of[own]
                starts.append(place[a:b] + w.first[k])
        if starts:
            gone = covered(len(w), np.concatenate(starts), n)
    total = np.concatenate([[0], np.cumsum(gone)])
    data, edge = joined(w, ~gone)
    kept = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(edge.astype("<i8").tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())
    columns = [docs.column("__id"), pa.array(w.per_text, pa.int64()), pa.array(np.diff(total[w.first]), pa.int64()), kept]
    return pa.table(columns, names=names)


def dedup(df: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 12 << 20) -> DataFrame:
    """id (an integer), n_words, n_removed, kept (the kept words joined by one space)."""
    kept = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    size = kept.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    bits = max(5, (size // bucket_bytes).bit_length())
    count, key = 1 << bits, new_key()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            t = pa.Table.from_batches(held).combine_chunks()
            rows = list(zip(*_combine(t.to_batches()[0], n, bits, key))) if t.num_rows else []
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows or [[]] * 7, kinds)], names=["bucket", "group", "hashes", "docs", "tags", "counts", "places"])

        held, size = [], 0
        for batch in batches:
            for part in chunks(batch, "__text", STRETCH_BYTES):
                m = len(buffers(part.column("__text"))[0])
                if held and size + m > STRETCH_BYTES:
                    yield out(held)
                    held, size = [], 0
                held.append(part)
                size += m
        if held:
            yield out(held)

    def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text", 4 << 20):
                data, off = buffers(part.column("__text"))
                z = [squeeze(data[a:b].tobytes()) for a, b in zip(off[:-1], off[1:])]
                ids = part.column("__id")
                yield pa.RecordBatch.from_arrays([pa.array(_group(_ids(ids), count), pa.int32()), ids, pa.array(z, pa.binary())], names=["group", "__id", "__z"])

    sent = kept.mapInArrow(send, f"bucket int, group int, hashes binary, {_FLAGS}")
    docs = kept.mapInArrow(zipped, "group int, __id long, __z binary")
    sent, docs = sent.repartition(count, "bucket"), docs.repartition(count, "group")
    found = sent.groupBy("bucket").applyInArrow(lambda t: _repeats(t, count), f"group int, {_FLAGS}")
    names = [id_col, "n_words", "n_removed", "kept"]
    return docs.groupBy("group").cogroup(found.groupBy("group")).applyInArrow(lambda d, f: _cut(d, f, n, names, key), f"`{id_col}` long, n_words long, n_removed long, kept string")
