"""Benchmark decontamination on a distributed positional inverted index.

The index is document-partitioned: each segment covers half a megabyte of whole
texts and stores its sorted terms, their counts, and the word positions of each
term (all terms of all texts).  Segments are written as a table in the shared
folder.  A query is matched inside each segment, so nothing is shuffled:

1. One pass over terms and counts alone sums the frequency of the test terms.
2. Each test window starts from the postings of its rarest term, shifted by that
   term's place in the window, and is intersected with the shifted postings of
   its other terms, rarest first.

Test texts are taken in blocks of a fixed size, so what is broadcast is bounded
however large the benchmark is.

Defined results: null and empty texts have no words and are hit by nothing; test
items without words or without id are left out; repeated items count once;
repeated rows of documents give repeated results; texts are read whole; an empty
table on either side gives no hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._io import Scratch, stored
from palimpsest.llm._pack import pack, unpack
from palimpsest.llm._words import ALNUM, U, buffers, chunks, new_key, words

SEGMENT_BYTES = 1 << 19  # larger rows, and codecs' buffers for them, swell a JVM
BLOCK_BYTES = 1 << 20  # of test texts that are matched at once; their tables take some 30 times as much
SLACK = 5  # words that a near match may have besides
_SEGMENT = "segment string, key long, first binary, terms binary, counts binary, positions binary"


def _segment(data: np.ndarray, offsets: np.ndarray, key: int) -> tuple[bytes, bytes, bytes, bytes]:
    w = words(data, offsets, ALNUM, lower=True)
    h = w.hashes(key)
    order = np.argsort(h, kind="stable")
    h = h[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(h)))
    return pack(w.first), h[at].astype("<u8").tobytes(), pack(counts), pack(order)


def index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The stored index, one row per segment: ids, then first (word offset of each
    text), terms, counts and positions as packed arrays."""
    kept = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    key = new_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column("__id").combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            parts = _segment(*buffers(t.column("__text")), key)
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            held.clear()
            return pa.RecordBatch.from_arrays([lists, pa.array([uuid.uuid4().hex]), pa.array([key], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)], names=["ids", "segment", "key", "first", "terms", "counts", "positions"])

        for batch in batches:
            for part in chunks(batch, "__text", SEGMENT_BYTES):
                n = len(buffers(part.column("__text"))[0])
                if held and size + n > SEGMENT_BYTES:
                    yield flush()
                    size = 0
                held.append(part)
                size += n
        if held:
            yield flush()

    kind = kept.schema["__id"].dataType.simpleString()
    return (scratch.stored if scratch else stored)(kept.mapInArrow(run, f"ids array<{kind}>, {_SEGMENT}"), "postings", "none")


class Phrases:
    """Windows of test items as term numbers, offsets and lengths, and the items' whole texts."""

    def __init__(self, items: list[tuple[str, str]], n: int, key: int, slack: int = SLACK):
        self.names = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.names)}
        data, offsets = buffers(pa.array([t for _, t in items], pa.string()))
        w = words(data, offsets, ALNUM, lower=True)
        h, length = w.hashes(key), w.per_text
        size = np.minimum(length, n)
        times = np.where(length > 0, length - size + 1, 0)
        text = np.repeat(np.arange(len(items)), times)
        start = w.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(times) - times, times)
        self.size = size[text]
        self.item = np.array([number[i] for i, _ in items], np.int64)[text]
        live = np.arange(n) < self.size[:, None]
        grid = h[np.minimum(start[:, None] + np.arange(n), max(len(h) - 1, 0))] if len(text) else np.zeros((0, n), U)
        self.terms = np.unique(grid[live])
        self.term = np.where(live, np.searchsorted(self.terms, grid), -1)
        self.offset = np.broadcast_to(np.arange(n), grid.shape)
        #: (item, its distinct terms, the stretch that may hold them) of each text
        self.texts = [(number[i], np.unique(np.searchsorted(self.terms, h[a:b])), int(b - a) + slack) for (i, _), a, b in zip(items, w.first[:-1], w.first[1:]) if b > a]
        self.text_terms = np.concatenate([np.zeros(0, np.int64), *(t for _, t, _ in self.texts)])
        self.text_first = np.cumsum([0, *(len(t) for _, t, _ in self.texts)])[:-1]

    def rarest_first(self, frequency: dict[int, int]) -> None:
        f = np.array([frequency.get(int(t), 0) for t in self.terms] + [np.iinfo(np.int64).max], np.int64)
        order = np.argsort(f[self.term], 1, kind="stable")  # term -1 reads the last: beyond the phrase
        self.term = np.take_along_axis(self.term, order, 1)
        self.offset = np.take_along_axis(self.offset, order, 1)


class Segment:
    """The postings of the asked terms in one segment."""

    def __init__(self, asked: np.ndarray, first: bytes, terms: bytes, counts: bytes, positions: bytes):
        self.first, own, count = unpack(first), np.frombuffer(terms, "<u8"), unpack(counts)
        self.n = int(self.first[-1])
        at = np.minimum(np.searchsorted(own, asked), max(len(own) - 1, 0))
        here = own[at] == asked if len(own) else np.zeros(len(asked), bool)
        starts = np.cumsum(count) - count
        self.count = np.where(here, count[at] if len(own) else 0, 0)
        k = np.flatnonzero(self.count)
        self.begin = np.cumsum(self.count) - self.count
        src = np.repeat(starts[at[k]] if len(own) else k, self.count[k]) + np.arange(int(self.count.sum())) - np.repeat(self.begin[k], self.count[k])
        self.position = unpack(positions)[src]
        self.key = np.repeat(k, self.count[k]) * (self.n + 1) + self.position  # ascending

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def matches(self, q: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of every exact occurrence inside one text."""
        live = q.term >= 0
        window = np.flatnonzero(((self.count[q.term] > 0) | ~live).all(1))
        lead = q.term[window, 0]
        times = self.count[lead]
        phrase = np.repeat(window, times)
        at = np.repeat(self.begin[lead] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        start = self.position[at] - q.offset[phrase, 0]
        ok = start >= 0
        phrase, start = phrase[ok], start[ok]
        for j in range(1, q.term.shape[1]):
            if not len(phrase):
                break
            t = q.term[phrase, j]
            want = t * (self.n + 1) + start + q.offset[phrase, j]
            found = self.key[np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)] == want
            found |= t < 0
            phrase, start = phrase[found], start[found]
        inside = start + q.size[phrase] <= self.first[self.text_of(start) + 1]
        return phrase[inside], start[inside]

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Texts with a stretch of at most ``span`` words that holds every one of the distinct terms."""
        terms = terms[np.argsort(self.count[terms], kind="stable")]
        if not len(terms) or not self.count[terms[0]]:
            return np.zeros(0, np.int64)
        places = [self.position[self.begin[t] : self.begin[t] + self.count[t]] for t in terms]
        text = self.text_of(places[0])
        low, high = np.maximum(places[0] - span + 1, self.first[text]), np.minimum(places[0] + span, self.first[text + 1])
        for p in places[1:]:
            at = np.searchsorted(p, low)
            ok = p[np.minimum(at, len(p) - 1)] < high
            low, high = low[ok & (at < len(p))], high[ok & (at < len(p))]
            if not len(low):
                return np.zeros(0, np.int64)
        edge = np.cumsum(np.bincount(low, minlength=self.n + 1) - np.bincount(high, minlength=self.n + 1))
        places = [p[edge[p] > 0] for p in places]
        mark = np.repeat(np.arange(len(places)), [len(p) for p in places])
        place = np.concatenate(places)
        order = np.argsort(place, kind="stable")
        place, mark = place[order], mark[order]
        last = np.full(len(place), np.iinfo(np.int64).max)
        for k in range(len(places)):
            last = np.minimum(last, np.maximum.accumulate(np.where(mark == k, place, -1)))
        text = self.text_of(place)
        return np.unique(text[(last >= 0) & (place - last < span) & (last >= self.first[text])])


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """Distinct (id, text) of the test items, in blocks of about BLOCK_BYTES."""
    kept = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    total = kept.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for k in range(n):
        yield sorted({(r["i"], r["t"]) for r in kept.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()})


def _frequencies(segments: DataFrame, asked: np.ndarray) -> dict[int, int]:
    """Occurrences of the asked terms in all texts; at most one row per asked term."""
    sent = segments.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts")):
                own = np.frombuffer(terms.as_py(), "<u8")
                if len(own):
                    at = np.minimum(np.searchsorted(own, sent.value), len(own) - 1)
                    total += np.where(own[at] == sent.value, unpack(counts.as_py())[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["k", "n"])

    rows = segments.select("terms", "counts").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {int(asked[r["k"]]): r["n"] for r in rows}


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", segments: DataFrame | None = None) -> DataFrame:
    """id, n_words, n_hit, items and near (sorted arrays of item ids: with exact windows, and
    with a near match of the whole item), one row per input row.

    ``segments`` is an index() of the documents, built here unless given.
    """
    with Scratch(documents.sparkSession) as scratch:
        segments = index(documents, id_col, text_col, scratch) if segments is None else segments
        kind = segments.schema["ids"].dataType.elementType.simpleString()
        spark, passes = segments.sparkSession, []
        own = segments.select("key").first()
        for block in _blocks(benchmark, item_col, item_text_col):
            q = Phrases(block, n, own["key"] if own else 1)
            q.rarest_first(_frequencies(segments, q.terms) if len(q.terms) else {})
            sent = spark.sparkContext.broadcast(q)  # of at most BLOCK_BYTES of test texts
            passes.append(segments.mapInArrow(lambda it, sent=sent: _match(it, sent.value, id_col), f"`{id_col}` {kind}, __text_no string, n_words long, n_hit long, __hit binary, items array<string>, near array<string>"))
        if len(passes) == 1:
            return stored(passes[0].select(id_col, "n_words", "n_hit", "items", "near"), "hits")
        every = passes[0]
        for p in passes[1:]:
            every = every.unionByName(p)
        united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        merged = every.groupBy("__text_no").agg(F.first(id_col).alias(id_col), F.first("n_words").alias("n_words"), F.collect_list("__hit").alias("__hits"), united("items"), united("near"))
        return stored(merged.select(id_col, "n_words", _union("__hits").alias("n_hit"), "items", "near"), "hits")


def _union(column: str):
    """Words hit in any block (one bitmap per block, none where nothing is hit)."""

    @F.pandas_udf("long")
    def count(hits):
        def of(many):
            bits = [np.frombuffer(b, np.uint8) for b in many if len(b)]
            return int(np.unpackbits(np.bitwise_or.reduce(bits)).sum()) if bits else 0

        return hits.map(of)

    return count(column)


def _match(batches: Iterator[pa.RecordBatch], q: Phrases, id_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            ids = batch.column("ids")[r].values
            first, terms, counts, positions = (batch.column(c)[r].as_py() for c in ("first", "terms", "counts", "positions"))
            s = Segment(q.terms, first, terms, counts, positions)
            phrase, start = s.matches(q)
            edge = np.bincount(start, minlength=s.n + 1) - np.bincount(start + q.size[phrase], minlength=s.n + 1)
            hit = np.cumsum(edge)[: s.n] > 0
            text = s.text_of(start)
            here = np.flatnonzero(np.logical_and.reduceat(s.count[q.text_terms] > 0, q.text_first)).tolist() if q.texts else []
            whole = [q.texts[k] for k in here]  # items all of whose terms stand in the segment
            found = [s.near(terms, span) for _, terms, span in whole]
            near = _named(np.concatenate([np.zeros(0, np.int64), *found]), np.repeat([i for i, _, _ in whole], [len(f) for f in found]).astype(np.int64), q.names, len(ids))
            total = np.concatenate([[0], np.cumsum(hit)])
            some = set(np.unique(text).tolist())
            bits = [np.packbits(hit[a:b]).tobytes() if t in some else b"" for t, (a, b) in enumerate(zip(s.first[:-1].tolist(), s.first[1:].tolist()))]
            mark = batch.column("segment")[r].as_py()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([f"{mark}-{t}" for t in range(len(ids))], pa.string()), pa.array(np.diff(s.first), pa.int64()), pa.array(np.diff(total[s.first]), pa.int64()), pa.array(bits, pa.binary()), _named(text, q.item[phrase], q.names, len(ids)), near],
                names=[id_col, "__text_no", "n_words", "n_hit", "__hit", "items", "near"],
            )


def _named(text: np.ndarray, item: np.ndarray, names: list[str], texts: int) -> pa.Array:
    """Per text the sorted names of its items, each once."""
    pair = np.unique(text * max(1, len(names)) + item)
    own: list[list[str]] = [[] for _ in range(texts)]
    for t, i in zip((pair // max(1, len(names))).tolist(), (pair % max(1, len(names))).tolist()):
        own[t].append(names[i])
    return pa.array(own, pa.list_(pa.string()))
