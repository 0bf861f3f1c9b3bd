"""N-gram Jaccard join with filters under several global token orders.

A text's set holds the hashes of its distinct word n-grams; equal sets form one
class, and only classes are compared.  Under any one global order of all n-grams,
two sets whose Jaccard similarity reaches t share an n-gram among the first
size - ceil(t * size) + 1 of each.  Three orders are used, each rare-first by a
counting table over the whole corpus (fixed size and half octaves, so rarity is
approximate, while the order is exact) with its own tie-breaking hash.

1. The first order's prefixes are dealt to buckets by hash, as packed arrays; a
   stretch of the corpus sends a class once, so copies are combined before they
   move.  Of a key's classes those stay together whose sizes allow a link; such a
   group yields one pair per class, with the group's hub.
2. A class's profile counts its n-grams in 128 parts of the hash space; what two
   profiles differ by is a lower bound of what the sets differ by.  Pairs with the hub
   that pass it must also share a prefix n-gram under the other two orders and are
   then verified on the full sets.  Verified links make components.
3. Two classes of one key that are not its hub are both members of its hub.  Hubs
   whose members now lie in one component are done: pairs inside a component can
   change nothing.  Members of the hubs that stay open are compared in blocks by matrix products,
   after the same filters, only across components.  A task returns of the links that it
   finds those that a spanning forest of its components needs, fewer than it has rows.  So no
   group of copies is ever expanded into rows of pairs, and no components that a link joins
   stay apart.

Classes are told apart by 64 bits of hash, n-grams by 64 (48 within a pair), under a key
drawn for each run (see ``_words``), so no text can be made to collide with another.

Defined results: null and empty texts have an empty set, size 0, and are linked
with nothing; a text of fewer than n words is one n-gram; rows with a null id get
a null component and link nothing; repeated rows give repeated results; texts are
read whole; an empty table gives an empty one; only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._io import Scratch, stored
from palimpsest.llm._pack import from_low_bytes, low_bytes, pack, unpack
from palimpsest.llm._words import SPACED, U, buffers, chunks, mix, new_key, windows, words
from palimpsest.llm.components import components

ORDERS = 3
TABLE_BITS = 22  # of the counting table
SLICES = 64
WAYS = 256  # tables that a task adds up at once
MARK_BITS = 28  # of the table of candidate classes, at most
STRETCH_BYTES = 2 << 20
BLOCK = 256  # classes that a task compares at once
PARTS = 128  # of a class's profile


class Grams(NamedTuple):
    """Length of the n-grams, and the key of their words' hashes."""

    n: int
    key: int


def sets(data: np.ndarray, offsets: np.ndarray, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """(first, value): text t has the distinct n-gram hashes value[first[t]:first[t+1]], ascending."""
    w, n = words(data, offsets, SPACED, lower=True), grams.n
    h, size, texts = w.hashes(grams.key), w.per_text, len(offsets) - 1
    text, value = [], []
    every = windows(h, n)
    of = w.text_of()
    if len(every):
        same = of[: len(every)] == of[n - 1 :]
        text.append(of[: len(every)][same])
        value.append(every[same])
    for m in range(1, n):
        short = np.flatnonzero(size == m)
        if len(short):
            text.append(short)
            value.append(windows(h, m)[w.first[short]])
    if not text:
        return np.zeros(texts + 1, np.int64), np.zeros(0, U)
    t, v = np.concatenate(text), np.concatenate(value)
    order = np.argsort(v)
    t, v = t[order], v[order]
    order = np.argsort(t.astype(np.uint16) if texts <= 1 << 16 else t, kind="stable")
    t, v = t[order], v[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (v[1:] != v[:-1])])
    t, v = t[new], v[new]
    return np.searchsorted(t, np.arange(texts + 1)), v


def classes(first: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One signed 64-bit name per set; 0 for the empty set."""
    total = np.zeros(len(value) + 1, U)
    np.cumsum(mix(value, 0xC1A55), out=total[1:])
    size = np.diff(first)
    c = mix(total[first[1:]] - total[first[:-1]] + size.astype(U))
    return np.where(size > 0, np.where(c == 0, U(1), c), U(0)).view(np.int64)


def profiles(first: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How many n-grams of each set lie in each part, at most 255."""
    part = (mix(value, 0x9F) >> U(64 - 7)).astype(np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.minimum(np.bincount(text * PARTS + part, minlength=(len(first) - 1) * PARTS), 255).astype(np.uint8).reshape(-1, PARTS)


def _slot(value: np.ndarray) -> np.ndarray:
    return (mix(value, 0xA0) >> U(64 - TABLE_BITS)).astype(np.int64)


def prefixes(first: np.ndarray, value: np.ndarray, counts: np.ndarray, order: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, place from 0) of every set's prefix under one order."""
    size = np.diff(first)
    most = size - -(-percent * size // 100) + 1
    text = np.repeat(np.arange(len(size)), size)
    rank = counts[_slot(value)].astype(U) << U(40) | mix(value, 0xB0 + order) >> U(24)
    by = np.argsort(rank, kind="stable")
    by = by[np.argsort(text[by].astype(np.uint16) if len(size) <= 1 << 16 else text[by], kind="stable")]
    place = np.arange(len(value)) - np.repeat(first[:-1], size)
    keep = place < np.repeat(most, size)
    return text[keep], value[by[keep]], place[keep]


def _stretches(batches: Iterator[pa.RecordBatch], grams: Grams) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in chunks(batch, "__text", STRETCH_BYTES):
            first, value = sets(*buffers(part.column("__text")), grams)
            yield part, first, value, classes(first, value)


def _once(first: np.ndarray, value: np.ndarray, names: np.ndarray, seen: set[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets without repeats of a class and without empty ones."""
    _, at = np.unique(names, return_index=True)
    at = at[names[at] != 0]
    if seen is not None:
        at = np.array([i for i in at.tolist() if int(names[i]) not in seen], np.int64)
        seen.update(names[at].tolist())
    size = np.diff(first)[at]
    edge = np.concatenate([[0], np.cumsum(size)])
    return edge, value[np.repeat(first[at] - edge[:-1], size) + np.arange(edge[-1])], names[at]


def _counted(kept: DataFrame, grams: Grams, keep: tuple[str, ...], scratch: Scratch) -> tuple[DataFrame, np.ndarray, int]:
    """(id, kept columns, class, size, profile) of each row; the counting table in half octaves; the sum of sizes."""
    kinds = "".join(f"`{c}` {kept.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << TABLE_BITS, np.int32)  # of one task
        names = ["id", *keep, "class", "size", "profile", "slice", "counts"]
        part = None
        for part, first, value, name in _stretches(batches, grams):
            np.add.at(table, _slot(value), 1)
            m = part.num_rows
            yield pa.RecordBatch.from_arrays([part.column("__id"), *(part.column(c) for c in keep), pa.array(name), pa.array(np.diff(first), pa.int64()), pa.array([p.tobytes() for p in profiles(first, value)], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        own = table.reshape(SLICES, -1)
        some = [k for k in range(SLICES) if own[k].any()]
        if some:
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, *(pa.nulls(len(some), part.schema.field(c).type) for c in keep), none, none, pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array([pack(own[k]) for k in some], pa.binary())], names=names)

    both = scratch.stored(kept.mapInArrow(run, f"id long, {kinds}class long, size long, profile binary, slice int, counts binary"), "classes")

    def add(t: pa.Table) -> pa.Table:
        total = None
        for b in t.column("counts"):
            c = unpack(b.as_py())
            total = c if total is None else total + c
        return pa.table({"slice": t.column("slice").slice(0, 1), "counts": pa.array([pack(total)], pa.binary())})

    part = both.where("slice is not null").select("slice", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("way"))
    if (part.groupBy("slice").count().agg(F.max("count")).first()[0] or 0) > WAYS:  # more tables than one task should add
        part = part.groupBy("slice", "way").applyInArrow(add, "slice int, counts binary")
    part = scratch.stored(part.groupBy("slice").applyInArrow(add, "slice int, counts binary"), "counts")
    table = np.zeros((SLICES, (1 << TABLE_BITS) // SLICES), np.int64)
    for r in part.toLocalIterator():  # SLICES rows of fixed size
        table[r["slice"]] = unpack(r["counts"])
    level = np.floor(2 * np.log2(table.reshape(-1) + 1)).astype(np.uint8)
    return both.where("slice is null").select("id", *keep, "class", "size", "profile"), level, int(table.sum())


def _heads(*columns: np.ndarray) -> np.ndarray:
    """True where a sorted row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _can_link(key: np.ndarray, size: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Rows, sorted by key and size, that some other row of their key may link with.

    Were the key their first common n-gram, the sets could share no more than ``rest``
    n-grams; a link needs percent / (100 + percent) of both sizes.  Rows of groups of
    more than 64 all stay."""
    n = len(key)
    keep = np.zeros(n, bool)
    for d in range(1, 65):
        if d >= n:
            break
        i = np.flatnonzero(key[d:] == key[:-d])
        if not len(i):
            return keep
        j = i + d
        need = percent * (size[i] + size[j])
        ok = (100 * size[i] >= percent * size[j]) & ((100 + percent) * rest[i] >= need) & ((100 + percent) * rest[j] >= need)
        keep[i[ok]] = keep[j[ok]] = True
    if n > 64:
        i = np.flatnonzero(key[64:] == key[:-64])
        keep |= np.isin(key, key[i])
    return keep


def _members(kept: DataFrame, counts, grams: Grams, percent: int, total: int, scratch: Scratch) -> DataFrame:
    """(class, hub): classes of like size that share a first-order prefix n-gram, as stars."""
    bits = max(6, (total // (1 << 21)).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, first, value, name in _stretches(batches, grams):
            if len(seen) > 200_000:
                seen.clear()
            first, value, name = _once(first, value, name, seen)
            text, key, place = prefixes(first, value, counts.value, 0, percent)
            to = (mix(key, 0xDEA1) >> U(64 - bits)).astype(np.int64)
            order = np.argsort(to.astype(np.uint16) if bits <= 16 else to, kind="stable")
            text, key, place, to = text[order], key[order], place[order], to[order]
            edge = np.searchsorted(to, np.arange((1 << bits) + 1))
            size, rows = np.diff(first), []
            for k in np.flatnonzero(np.diff(edge)).tolist():
                t = text[edge[k] : edge[k + 1]]
                new = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                rows.append((k, key[edge[k] : edge[k + 1]].tobytes(), name[t[new]].tobytes(), pack(size[t[new]]), pack(np.diff(np.append(new, len(t)))), pack(place[edge[k] : edge[k + 1]])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, [pa.int32(), *[pa.binary()] * 5])], names=["bucket", "keys", "classes", "sizes", "counts", "places"])

    def shared(t: pa.Table) -> pa.Table:
        rows = t.to_pydict()
        key = np.concatenate([np.frombuffer(b, "<u8") for b in rows["keys"]])
        times = [unpack(b) for b in rows["counts"]]
        name = np.concatenate([np.repeat(np.frombuffer(b, "<i8"), c) for b, c in zip(rows["classes"], times)])
        size = np.concatenate([np.repeat(unpack(b), c) for b, c in zip(rows["sizes"], times)])
        place = np.concatenate([unpack(b) for b in rows["places"]])
        # only keys that stand more than once go on
        order = np.argsort(key, kind="stable")
        k = key[order]
        twice = np.zeros(len(k) + 1, bool)
        twice[1:-1] = k[1:] == k[:-1]
        order = order[twice[1:] | twice[:-1]]
        order = order[np.lexsort((name[order], key[order]))]
        order = order[_heads(key[order], name[order])]
        order = order[np.lexsort((size[order], key[order]))]
        key, name, size, place = key[order], name[order], size[order], place[order]
        keep = _can_link(key, size, size - place, percent)
        key, name, size = key[keep], name[keep], size[keep]
        # a key's classes by size, cut where two neighbours are too far apart for any link across
        head = _heads(key)
        head[1:] |= 100 * size[:-1] < percent * size[1:]
        group = np.cumsum(head) - 1
        many = np.bincount(group)[group] > 1 if len(key) else head
        hub = np.minimum.reduceat(name, np.flatnonzero(head))[group] if len(key) else name
        return pa.table({"class": pa.array(name[many]), "hub": pa.array(hub[many])})

    sent = kept.mapInArrow(send, "bucket int, keys binary, classes binary, sizes binary, counts binary, places binary")
    return scratch.stored(sent.groupBy("bucket").applyInArrow(shared, "class long, hub long").where("class != hub").distinct(), "members")


def _sets_of(kept: DataFrame, wanted: DataFrame, counts, grams: Grams, percent: int) -> DataFrame:
    """(class, size, set, filter2, filter3) of the wanted classes, one row each.

    ``wanted`` (class, without repeats) is sent as a bit table of eight bits for each,
    at most 2**MARK_BITS; it lets a few others pass."""
    bits = min(MARK_BITS, max(16, (8 * wanted.count()).bit_length()))
    slot = F.col("class").bitwiseAND((1 << bits) - 1)
    marks = wanted.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(class & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for r in marks.toLocalIterator():  # at most 2**(MARK_BITS - 6) words
        table[r["w"]] = r["b"]
    sent = kept.sparkSession.sparkContext.broadcast(table.view(U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, first, value, name in _stretches(batches, grams):
            at = name.view(U) & U((1 << bits) - 1)
            marked = (sent.value[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)
            if len(seen) > 200_000:
                seen.clear()
            first, value, name = _once(first, value, np.where(marked, name, 0), seen)
            filters = []
            for o in range(1, ORDERS):
                text, key, _ = prefixes(first, value, counts.value, o, percent)
                edge = np.searchsorted(text, np.arange(len(name) + 1))
                filters.append([np.sort(key[a:b].astype(np.uint32)).tobytes() for a, b in zip(edge[:-1], edge[1:])])
            full = [low_bytes(np.sort(value[a:b] & U(0xFFFFFFFFFFFF)), 6) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.diff(first), pa.int64()), pa.array(full, pa.binary()), *(pa.array(f, pa.binary()) for f in filters)], names=["class", "size", "set", "filter2", "filter3"])

    found = kept.mapInArrow(run, "class long, size long, set binary, filter2 binary, filter3 binary")
    # a class comes about once from each task, always with the same row; the few unwanted ones do no harm
    return found.dropDuplicates(["class"])


def _share(a: bytes, b: bytes, kind: str) -> bool:
    return bool(len(np.intersect1d(np.frombuffer(a, kind), np.frombuffer(b, kind), assume_unique=False)))


def _linked(pairs: DataFrame, own: DataFrame, kept: DataFrame, counts, grams: Grams, percent: int, scratch: Scratch) -> DataFrame:
    """Of the pairs (a, b): those that pass the profiles, every order's filter and then the full sets."""

    def side(table: DataFrame, c: str) -> DataFrame:
        return table.select(F.col("class").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in table.columns if x != "class"))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16) for c in ("profile_a", "profile_b"))
            total = np.asarray(batch.column("size_a")) + np.asarray(batch.column("size_b"))
            # common = (total - difference) / 2 must reach percent / (100 + percent) of the total
            keep = (100 + percent) * (total - np.abs(p - q).sum(1, dtype=np.int64)) >= 2 * percent * total
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for f, g, h, i, p, q in zip(*(batch.column(c) for c in ("filter2_a", "filter2_b", "filter3_a", "filter3_b", "set_a", "set_b"))):
                if not (_share(f.as_py(), g.as_py(), "<u4") and _share(h.as_py(), i.as_py(), "<u4")):
                    keep.append(False)
                    continue
                x, y = from_low_bytes(p.as_py(), 6), from_low_bytes(q.as_py(), 6)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    few = scratch.stored(pairs.join(side(own, "a"), "a").join(side(own, "b"), "b").mapInArrow(possible, "a long, b long"), "pairs")
    full = _sets_of(kept, few.select(F.explode(F.array("a", "b")).alias("class")).distinct(), counts, grams, percent)
    # both joins read one exchange of the sets
    return scratch.stored(few.join(side(full, "a"), "a").join(side(full, "b"), "b").mapInArrow(verified, "a long, b long"), "links")


def _incidence(cells: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column, columns) of the values that stand in more than one cell."""
    row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    _, column, times = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    number = np.cumsum(times > 1) - 1
    return row[keep], number[column[keep]], int((times > 1).sum())


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each left cell shares with each right cell, by blocks of a matrix product."""
    row, column, width = _incidence([*left, *right])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, width, 4096):
        a, b = np.searchsorted(column, [c, c + 4096])
        m = np.zeros((len(left) + len(right), min(4096, width - c)), np.float32)
        m[row[a:b], column[a:b] - c] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out


def _dealt(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Members dealt to pairs of blocks (i <= j) of their hub; ``hubs`` has hub and blocks."""
    own = members.join(hubs, "hub").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def _prune(t: pa.Table, percent: int) -> pa.Table:
    """Of two blocks, the rows that some row of another label may link with, by size and profile."""
    r = t.to_pydict()
    side = np.array(r["block"]) == r["i"][0]
    left = np.flatnonzero(side)
    right = left if r["i"][0] == r["j"][0] else np.flatnonzero(~side)
    name, size, label = (np.array(r[c], np.int64) for c in ("class", "size", "label"))
    profile = np.frombuffer(b"".join(r["profile"]), np.uint8).reshape(-1, PARTS).astype(np.int16)
    keep = np.zeros(len(size), bool)
    for a in range(0, len(left), 64):
        at = left[a : a + 64]
        total = np.add.outer(size[at], size[right])
        differ = np.abs(profile[at][:, None, :] - profile[right][None, :, :]).sum(2, dtype=np.int64)
        # common = (total - difference) / 2 must reach percent / (100 + percent) of the total
        ok = ((100 + percent) * (total - differ) >= 2 * percent * total) & (label[at][:, None] != label[right][None, :])
        keep[at[ok.any(1)]] = True
        keep[right[ok.any(0)]] = True
    return pa.table({"class": pa.array(name[keep]), "hub": pa.array(np.array(r["hub"], np.int64)[keep])})


def _open(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(hub, class, label) of the hubs whose classes, the hub among them, are in several components."""
    every = members.unionByName(members.select(F.col("hub").alias("class"), "hub").distinct())
    named = every.join(labels.select(F.col("node").alias("class"), "label"), "class", "left").select("hub", "class", F.coalesce("label", "class").alias("label"))
    named = scratch.stored(named, "named")
    several = named.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("hub")
    return scratch.stored(named.join(several, "hub", "left_semi"), "open")


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the links (a, b) that join what those before them leave apart."""
    _, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = code[: len(a)], code[len(a) :]
    _, once = np.unique(np.minimum(a, b) * (len(code) + 1) + np.maximum(a, b), return_index=True)
    root, keep = list(range(len(code))), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for k, x, y in zip(once.tolist(), a[once].tolist(), b[once].tolist()):
        x, y = top(x), top(y)
        if x != y:
            root[y] = x
            keep.append(k)
    return np.array(keep, np.int64)


def _linked_in_blocks(rest: DataFrame, own: DataFrame, kept: DataFrame, counts, grams: Grams, percent: int, scratch: Scratch) -> DataFrame:
    """Links between classes of one hub that are in different components: classes whose
    profile allows none go, the others are dealt to blocks of about BLOCK; a task compares
    two blocks by a matrix product and returns only links, at most one less than it has labels."""
    hubs = rest.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = _dealt(rest, hubs).join(own, "class").select("hub", "i", "j", "block", "class", "label", "size", "profile")
    near = dealt.groupBy("hub", "i", "j").applyInArrow(lambda t: _prune(t, percent), "class long, hub long").distinct()
    rest = scratch.stored(rest.join(near, ["hub", "class"], "left_semi"), "near")
    full = _sets_of(kept, rest.select("class").distinct(), counts, grams, percent)
    rows = _dealt(rest, hubs).join(full, "class")

    def compare(t: pa.Table) -> pa.Table:
        r = t.to_pydict()
        same = r["i"][0] == r["j"][0]
        side = np.array(r["block"]) == r["i"][0]
        at = [np.flatnonzero(side), np.flatnonzero(side if same else ~side)]
        name, label, size = np.array(r["class"]), np.array(r["label"]), np.array(r["size"])
        ok = label[at[0]][:, None] != label[at[1]][None, :]
        small, large = np.minimum.outer(size[at[0]], size[at[1]]), np.maximum.outer(size[at[0]], size[at[1]])
        ok &= 100 * small >= percent * large
        if same:
            ok = np.triu(ok, 1)
        for c in ("filter2", "filter3"):  # a prefix n-gram in common under the other orders
            if ok.any():
                cells = [np.frombuffer(b, "<u4") for b in r[c]]
                ok &= _common([cells[k] for k in at[0]], [cells[k] for k in at[1]]) > 0
        i, j = np.nonzero(ok)
        if len(i):
            cells = [from_low_bytes(b, 6) for b in r["set"]]
            rows, back = np.unique(i, return_inverse=True)
            cols, down = np.unique(j, return_inverse=True)
            common = _common([cells[k] for k in at[0][rows]], [cells[k] for k in at[1][cols]])[back, down].astype(np.int64)
            linked = 100 * common >= percent * (size[at[0][i]] + size[at[1][j]] - common)
            i, j = i[linked], j[linked]
            tree = _forest(label[at[0][i]], label[at[1][j]])
            i, j = i[tree], j[tree]
        return pa.table({"a": pa.array(name[at[0][i]], pa.int64()), "b": pa.array(name[at[1][j]], pa.int64())})

    return scratch.stored(rows.groupBy("hub", "i", "j").applyInArrow(compare, "a long, b long").distinct(), "links")


def join(df: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id (an integer), the kept columns, n_shingles, component_id (the smallest id reachable
    by links) and component (a name that the rows of one component share, null where a row
    can have no link).  The result is stored; what led to it is deleted."""
    kept = df.select(F.col(id_col).cast("long").alias("__id"), *keep, F.col(text_col).cast("string").alias("__text"))
    grams = Grams(n, new_key())
    with Scratch(df.sparkSession) as scratch:
        rows, table, total = _counted(kept, grams, keep, scratch)
        known = kept.where("__id is not null").select("__id", "__text")
        counts = kept.sparkSession.sparkContext.broadcast(table)  # one byte per slot
        own = rows.where("id is not null and class != 0").select("class", "size", "profile").dropDuplicates(["class"])
        members = _members(known, counts, grams, percent, total, scratch)
        links = _linked(members.select(F.col("hub").alias("a"), F.col("class").alias("b")), own, known, counts, grams, percent, scratch)
        labels = components(links, scratch)
        rest = _open(members, labels, scratch)
        if not rest.isEmpty():
            more = _linked_in_blocks(rest, own, known, counts, grams, percent, scratch)
            if not more.isEmpty():
                labels = components(links.unionByName(more), scratch)

        least = rows.where("id is not null and class != 0").groupBy("class").agg(F.min("id").alias("least"))
        named = least.join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "least", F.coalesce("label", "class").alias("component"))
        named = scratch.stored(named, "named")
        roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
        of = named.join(roots, "component").select("class", "component", "component_id")
        out = rows.join(of, "class", "left")
        component = F.when(F.col("id").isNull(), F.lit(None).cast("long"))
        out = out.select(F.col("id").alias(id_col), *keep, F.col("size").alias("n_shingles"), component.otherwise(F.coalesce("component_id", "id")).alias("component_id"), component.otherwise(F.col("component")).alias("component"))
        return stored(out, "near")
