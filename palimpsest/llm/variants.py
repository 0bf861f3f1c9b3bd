"""Spelling variant grouping by rolling-hash deletions.

Two words are near if they differ by exactly one inserted, deleted or replaced code
point.  They then share a string: one with a place left out is the other, or both
with the same place left out.

1. Words are counted where their texts are read and summed by word; what is kept goes
   to a table.
2. A word's deletions are hashed without being built: the polynomial hash of a word
   without place i is its prefix hash before i plus its suffix hash behind i, shifted
   by one place.  All deletions of all words of one length are one numpy expression.
   Keys are dealt to buckets by their top bits (radix partition), as packed arrays.
3. A bucket sorts its keys and compares the strings behind equal ones, so hash
   collisions change nothing.  Of each group of words that share a string with a place
   left out (at most one for each letter of the alphabet) every member learns the
   group's size and its best other member; pairs are not listed.
4. What the buckets found is summed by word.  Roots follow the forms by pointer
   doubling; occurrences grow tenfold at each step, so the rounds are few.

A key's bucket holds one packed entry per word and place, and words of over
``SHORT`` code points would carry their text as often as they have places; those go by
their digest instead, and the few pairs that share a key are compared on their strings.

Defined results: null and empty texts have no words; a null id counts as an empty one in
the check sum; repeated rows count again; texts are read whole; an empty table gives an
empty one; only the two named columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._io import Scratch, stored
from palimpsest.llm._pack import squeeze, unsqueeze
from palimpsest.llm._words import U, chunks, mix

#: Maximal runs of A-Z, a-z and U+00C0 to U+00FF, in UTF-8.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
SHORT = 64  # code points of a word that goes to its buckets as a string
HELD = 200_000  # distinct words that a task sums up before it sends them
AT_ONCE = 20_000  # words whose deletions are hashed at once
BUCKET = 250_000  # keys of a bucket
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def misspelt(word: bytes, h: int) -> bytes:
    """The word without its code point h modulo its length."""
    letters = word.decode()
    i = h % len(letters)
    return (letters[:i] + letters[i + 1 :]).encode()


def _counts(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
        total.clear()
        return batch

    for batch in batches:
        for part in chunks(batch, "__text"):
            ids = part.column("__id").to_pylist()
            for i, t in zip(ids, pc.cast(part.column("__text"), pa.binary()).to_pylist()):
                if not t:
                    continue
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for w, n in Counter(RUN.findall(t.lower())).items():  # of bytes: A-Z alone
                    h = zlib.crc32(w, start)
                    if every and h % every == 0:
                        w = misspelt(w, h)
                    total[w] += n
                if len(total) > HELD:
                    yield out()
    if total:
        yield out()


def deletions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, word, place) of every deletion of the words (one byte a letter), and of each word itself at place -1."""
    size = np.array([len(w) for w in words], np.int64)
    key, word, place = [], [], []
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        power = np.full(n + 1, _BASE, U)
        power[0] = 1
        power = np.multiply.accumulate(power)
        letters = np.frombuffer(b"".join(words[i] for i in own.tolist()), np.uint8).reshape(len(own), n)
        prefix = np.zeros((len(own), n + 1), U)
        np.cumsum(letters * power[:n], axis=1, out=prefix[:, 1:])
        whole = prefix[:, -1:]
        suffix = (whole - prefix[:, 1:]) * U(_INVERSE)  # what stands behind a place, one place further left
        key.append(mix(np.concatenate([whole, prefix[:, :-1] + suffix], 1)).ravel())
        word.append(np.repeat(own, n + 1))
        place.append(np.tile(np.arange(-1, n), len(own)))
    none = np.zeros(0, np.int64)
    return np.concatenate([none.astype(U), *key]), np.concatenate([none, *word]), np.concatenate([none, *place])


def _sent(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Packed rows by bucket: keys, places, lengths, letters and counts of its entries."""
    for batch in batches:
        for i in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(i, AT_ONCE)
            words = [w.encode("latin-1") for w in part.column("word").to_pylist()]
            key, word, place = deletions(words)
            to = (key >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
            order = np.argsort(to, kind="stable")
            key, word, place, to = key[order], word[order], place[order], to[order]
            n, edge, rows = np.asarray(part.column("n")), np.searchsorted(to, np.arange((1 << bits) + 1)), []
            for k in np.flatnonzero(np.diff(edge)).tolist():
                at = slice(edge[k], edge[k + 1])
                own = [words[j] for j in word[at].tolist()]
                rows.append((k, key[at].astype("<u8").tobytes(), squeeze(place[at].astype("<i1").tobytes()), squeeze(bytes(map(len, own))), squeeze(b"".join(own)), squeeze(n[word[at]].astype("<i8").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, [pa.int32(), *[pa.binary()] * 5])], names=["bucket", "keys", "places", "sizes", "letters", "counts"])


def _heads(*columns: np.ndarray) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _neighbours(t: pa.Table) -> pa.Table:
    """(word, k, best_n, best): how many near words each word has in this bucket, and the most frequent one of them."""
    rows = t.to_pydict()
    read = lambda c, kind: np.frombuffer(b"".join(map(unsqueeze, rows[c])), kind)
    key, place, size, n = np.frombuffer(b"".join(rows["keys"]), "<u8"), read("places", "<i1").astype(np.int64), read("sizes", np.uint8).astype(np.int64), read("counts", "<i8")
    width = int(size.max())
    letters = np.zeros((len(key), width + 1), np.uint8)
    letters[:, :width][np.arange(width) < size[:, None]] = read("letters", np.uint8)
    step = np.arange(width)
    cut = np.take_along_axis(letters, step + ((place[:, None] >= 0) & (step >= place[:, None])), 1)
    name = np.ascontiguousarray(cut).view(f"S{width}").ravel()  # the string that each key stands for
    order = np.argsort(key, kind="stable")
    if ((key[order][1:] == key[order][:-1]) & (name[order][1:] != name[order][:-1])).any():  # a collision
        key = np.unique(name, return_inverse=True)[1].astype(U)
        order = np.argsort(key, kind="stable")
    group = np.cumsum(_heads(key[order])) - 1
    some = np.bincount(group)[group] > 1
    at, group = order[some], group[some]
    place, n = place[at], n[at]
    names, word = np.unique(np.ascontiguousarray(letters[at, :width]).view(f"S{width}").ravel(), return_inverse=True)  # in code-point order
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    # the same place left out: any other letter stands there
    o = np.lexsort((word, -n, place, group))
    o = o[place[o] >= 0]
    head = _heads(group[o], place[o])
    first = np.flatnonzero(head)
    many = np.diff(np.append(first, len(o)))
    mine = np.repeat(np.arange(len(first)), many)
    best = np.where(head, first[mine] + 1, first[mine])
    keep = many[mine] > 1
    found.append((word[o[keep]], many[mine][keep] - 1, n[o[best[keep]]], word[o[best[keep]]]))

    # a word, and those that are it but for one letter more
    centre = np.full(int(group.max()) + 1 if len(group) else 0, -1)
    whole = np.flatnonzero(place < 0)
    centre[group[whole]] = whole
    o = np.lexsort((word, -n, group))
    o = o[(place[o] >= 0) & (centre[group[o]] >= 0)]
    o = o[_heads(group[o], word[o])]
    c = centre[group[o]]
    found.append((word[o], np.ones(len(o), np.int64), n[c], word[c]))
    first = np.flatnonzero(_heads(c))
    found.append((word[c[first]], np.diff(np.append(first, len(c))), n[o[first]], word[o[first]]))

    who, k, other_n, other = (np.concatenate(x) for x in zip(*found))
    total = np.bincount(who, k, len(names)).astype(np.int64)
    o = np.lexsort((other, -other_n, who))
    o = o[_heads(who[o])]
    text = lambda x: pa.array([w.decode("latin-1") for w in names[x].tolist()], pa.string())
    return pa.table({"word": text(who[o]), "k": pa.array(total[who[o]]), "best_n": pa.array(other_n[o].astype(np.int64)), "best": text(other[o])})


def one_edit(a: str, b: str) -> bool:
    """Whether the two differ by exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _long_neighbours(words: DataFrame) -> DataFrame:
    """As _neighbours, for pairs with a word of over SHORT code points."""
    marked = words.where(F.length("word") >= SHORT).withColumn("id", F.unhex(F.sha2("word", 256)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, i in zip(batch.column("word").to_pylist(), batch.column("id").to_pylist()):
                key, _, place = deletions([word.encode("latin-1")])
                for a in range(0, len(key), 1 << 16):
                    k = key[a : a + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(place[a : a + len(k)]), pa.array([i] * len(k), pa.binary())], names=["key", "place", "id"])

    keys = marked.select("word", "id").mapInArrow(send, "key long, place long, id binary")
    a, b = keys.toDF("key", "place_a", "a"), keys.toDF("key", "place_b", "b")
    pairs = a.join(b, "key").where("a != b and ((place_a = place_b and a < b) or (place_a < 0 and place_b >= 0))").select("a", "b").distinct()
    side = lambda c: marked.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"), F.col("n").alias(f"{c}_n"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.greatest(F.length("a_word"), F.length("b_word")) > SHORT)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([one_edit(x, y) for x, y in zip(batch.column("a_word").to_pylist(), batch.column("b_word").to_pylist())], pa.bool_()))

    true = both.select("a_word", "a_n", "b_word", "b_n").mapInArrow(verified, "a_word string, a_n long, b_word string, b_n long")
    turned = true.select("b_word", "b_n", "a_word", "a_n")
    return true.union(turned).toDF("word", "n", "best", "best_n").select("word", F.lit(1).cast("long").alias("k"), "best_n", "best")


def variants(df: DataFrame, least_letters: int = 7, least_times: int = 2, factor: int = 10, misspell_every: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form (its near word of largest n, if that is ``factor`` times its own), root (the end of
    its forms), n, n_near, form_n.  ``misspell_every`` of 0 leaves the runs as they are."""
    kept = df.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    with Scratch(df.sparkSession) as scratch:
        counted = kept.mapInArrow(lambda it: _counts(it, misspell_every), "word string, n long")
        counted = counted.where(F.length("word") >= least_letters).groupBy("word").agg(F.sum("n").alias("n"))
        words = scratch.stored(counted.where(F.col("n") >= least_times), "words")
        size = words.agg(F.sum(F.length("word") + 1), F.max(F.length("word"))).first()
        bits = max(3, ((size[0] or 0) // BUCKET).bit_length())
        sent = words.where(F.length("word") <= SHORT).mapInArrow(lambda it: _sent(it, bits), "bucket int, keys binary, places binary, sizes binary, letters binary, counts binary")
        near = sent.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(_neighbours, "word string, k long, best_n long, best string")
        if (size[1] or 0) > SHORT:
            near = near.unionByName(_long_neighbours(words))
        near = near.groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("o"), "best")).alias("b"))
        named = words.join(near, "word", "left").withColumn("best_n", -F.col("b.o"))
        has = F.col("best_n") >= factor * F.col("n")
        formed = scratch.stored(named.select("word", F.when(has, F.col("b.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
        roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
        while True:
            further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
            moved = scratch.stored(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
            roots = moved.select("word", "root")
            if moved.where("moved").isEmpty():
                break
        out = formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return stored(out, "variants")
