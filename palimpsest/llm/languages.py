"""Language identification of words in code-switched text: a linear-chain conditional random field.

A word is a maximal run of ASCII letters and of bytes beyond ASCII.  Its features are
its prefixes and suffixes of one to four bytes, its byte pairs and triples with
the word's ends, its length, its capitals, and how far a lexicon gives it to each language.
Languages of neighbouring words are tied by learned transitions.  Forward-backward
gives every word the probability of each language; a text's language is the one with
the largest mean over its words, that mean is its score, and runs of
words of one likeliest language are the switches.

A chain is a whole text, however long.  Its words are cut into segments whose transfer
matrices are multiplied side by side; what enters and leaves each segment is passed
along the text, and the segments are then filled side by side again.  The result is
that of one pass from end to end, in a few hundred numpy steps for any batch.

The fit takes at most ``max_rows`` labelled texts of each language (those with the
least hash of id and text) and of each a stretch of ``fragment`` words at a place set by
that hash.  Half of the stretches make the lexicon, the other half the field's
training rows, so the field learns how far to trust a lexicon that has not seen them.
Training rows are made code-switched: pieces of stretches in random order.

Defined results: a null text, and one without a letter, is ``und`` with score 0; with no
labelled row every text is; ties go to the smallest language; labels that are null
are left out; repeated rows get repeated results; an empty table gives an empty one;
only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm._words import U, Words, buffers, chunks, mix, words

UNKNOWN = "und"
BITS = 18  # of the table of hashed features
SEGMENT = 64  # words of a chain that are filled in one go
LONGEST = 64  # bytes of a word that a training row may have

#: Words of ASCII letters and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x41:0x5B] = _ASCII_LETTER[0x61:0x7B] = True
_LOW = np.array([(1 << 8 * k) - 1 for k in range(5)], U)
_SHAPES = 12  # features of length and capitals


def _slots(value: np.ndarray, kind: int) -> np.ndarray:
    return (mix(value, 0xC5F * kind) >> U(64 - BITS)).astype(np.int64)


def features(w: Words, lexicon: Lexicon, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of the words given."""
    n, size = len(w), w.end - w.start
    own = np.arange(n)
    # the words one after the other, lower-cased, each between two marks
    first = np.cumsum(size + 2) - size - 2
    total = int((size + 2).sum())
    raw = np.zeros(total + 8, np.uint8)
    at = np.repeat(w.start - first - 1, size + 2) + np.arange(total)
    raw[:total] = w.data[np.clip(at, 0, max(0, len(w.data) - 1))]
    raw[:total] += 32 * ((raw[:total] >= 0x41) & (raw[:total] <= 0x5A)).astype(np.uint8)
    raw[first], raw[first + size + 1] = 2, 3
    eight = np.ndarray((total + 1,), "<u8", raw, strides=(1,))
    of = np.repeat(own, size + 2)
    out_word, out_feature = [], []

    def add(word: np.ndarray, feature: np.ndarray) -> None:
        out_word.append(word)
        out_feature.append(feature)

    for k in range(1, 5):
        has = np.flatnonzero(size >= k)
        add(has, _slots(eight[first[has] + 1] & _LOW[k], k))
        add(has, _slots(eight[first[has] + 1 + size[has] - k] & _LOW[k], 4 + k))
    for k in (2, 3):
        grams = np.arange(max(0, total - k + 1))
        grams = grams[of[grams] == of[np.minimum(grams + k - 1, max(0, total - 1))]]
        add(of[grams], _slots(eight[grams] & _LOW[k], 8 + k))
    start = w.data[w.start] if n else np.zeros(0, np.uint8)
    capital = (start >= 0x41) & (start <= 0x5A)
    add(own, (1 << BITS) + np.minimum(size, _SHAPES - 2) - 1)
    add(own[capital], np.full(int(capital.sum()), (1 << BITS) + _SHAPES - 1))
    level = lexicon.levels(w.hashes())
    for k in range(labels):
        add(own, (1 << BITS) + _SHAPES + 4 * k + level[:, k])
    return np.concatenate(out_word), np.concatenate(out_feature)


@dataclass
class Lexicon:
    """Words of the lexicon's stretches by hash, with their counts in each language."""

    key: np.ndarray
    count: np.ndarray

    def levels(self, h: np.ndarray) -> np.ndarray:
        """For each word and language: 0 not seen there, 1 seen, 2 half of its occurrences or more, 3 nearly all of three or more."""
        out = np.zeros((len(h), self.count.shape[1]), np.int64)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
            n = self.count[at] * (self.key[at] == h)[:, None]
            total = n.sum(1, keepdims=True)
            share = n / np.maximum(total, 1)
            out = (n > 0).astype(np.int64) + (share >= 0.5) + ((share >= 0.95) & (total >= 3))
        return out


def _segments(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each segment, -1 behind its end; the segment's text; its number in that text)."""
    size = np.diff(first)
    many = -(-size // SEGMENT)
    text = np.repeat(np.arange(len(size)), many)
    number = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    at = (first[text] + number * SEGMENT)[:, None] + np.arange(SEGMENT)
    return np.where(at < first[text + 1][:, None], at, -1), text, number


def forward_backward(emission: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, and scaled forward and backward values, of every word of every chain.

    Chain t has the words first[t]..first[t + 1].  Before a chain all languages are alike."""
    n, k = emission.shape
    e = np.exp(emission - emission.max(1, keepdims=True)) if n else emission
    a = np.exp(step - step.max())
    at, text, number = _segments(first)
    live = at >= 0
    forward, backward = np.ones((n, k)), np.ones((n, k))
    if not n:
        return forward, forward, backward
    weight = np.where(live[:, :, None], e[at], 1.0)
    # transfer matrix of each segment
    matrix = np.broadcast_to(np.eye(k), (len(at), k, k))
    for t in range(SEGMENT):
        k_live = live[:, t, None, None]
        nxt = np.where(k_live, (matrix @ a) * weight[:, t, None, :], matrix)
        matrix = nxt / nxt.max((1, 2), keepdims=True)
    # what enters each segment from the left and from the right, along the texts
    enter, leave = np.full((len(at), k), 1.0 / k), np.full((len(at), k), 1.0 / k)
    by = np.argsort(number, kind="stable")
    edge = np.searchsorted(number[by], np.arange(int(number.max()) + 2))
    for j in range(1, int(number.max()) + 1):
        s = by[edge[j] : edge[j + 1]]
        v = (enter[s - 1][:, None, :] @ matrix[s - 1])[:, 0]
        enter[s] = v / v.sum(1, keepdims=True)
    for j in range(int(number.max()), 0, -1):
        s = by[edge[j] : edge[j + 1]]
        v = (matrix[s] @ leave[s][:, :, None])[:, :, 0]
        leave[s - 1] = v / v.sum(1, keepdims=True)
    v = enter
    for t in range(SEGMENT):
        on = np.flatnonzero(live[:, t])
        if not len(on):
            break
        x = (v[on] @ a) * e[at[on, t]]
        x /= x.sum(1, keepdims=True)
        forward[at[on, t]] = x
        v = v.copy() if v is enter else v
        v[on] = x
    v = leave
    for t in range(SEGMENT - 1, -1, -1):
        on = np.flatnonzero(live[:, t])
        backward[at[on, t]] = v[on]
        x = (v[on] * e[at[on, t]]) @ a.T
        v = v.copy() if v is leave else v
        v[on] = x / x.sum(1, keepdims=True)
    post = forward * backward
    return post / post.sum(1, keepdims=True), forward, backward


@dataclass
class Model:
    labels: list[str]
    lexicon: Lexicon
    weight: np.ndarray  # features x labels
    step: np.ndarray  # labels x labels, transitions

    def emission(self, word: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(word, self.weight[feature, k], n) for k in range(len(self.labels))], 1)


def distinct(w: Words) -> tuple[Words, np.ndarray]:
    """The different words of a batch, and for each word which one it is."""
    _, at, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    return Words(w.data, w.start[at], w.end[at], np.array([0, len(at)])), which


def fit(rows: list[tuple[str, str]], rounds: int = 40, rate: float = 0.3, penalty: float = 1e-6, seed: int = 5) -> Model:
    """Fit on (language, stretch of words) rows, in an order that is fixed beforehand."""
    labels = sorted({y for y, _ in rows})
    k = len(labels)
    none = Lexicon(np.zeros(0, U), np.zeros((0, k), np.int64))
    size = (1 << BITS) + _SHAPES + 4 * k
    model = Model(labels, none, np.zeros((size, k)), np.zeros((k, k)))
    if k < 2:
        return model
    number, rng = {y: i for i, y in enumerate(labels)}, np.random.default_rng(seed)
    # of each language every other stretch goes to the lexicon
    turn, known, taught = [0] * k, [], []
    for y, t in rows:
        (known if turn[number[y]] % 2 == 0 else taught).append((number[y], t))
        turn[number[y]] += 1
    taught = taught or known
    w = words(*buffers(pa.array([t for _, t in known])), LETTERS)
    key, which = np.unique(w.hashes(), return_inverse=True)
    label = np.repeat([y for y, _ in known], w.per_text).astype(np.int64)
    model.lexicon = Lexicon(key, np.bincount(which * k + label, minlength=len(key) * k).reshape(-1, k))
    # pieces of 5 to 40 words, eight to a chain
    pieces = []
    for y, t in taught:
        own, i = t.split(" "), 0
        while i < len(own):
            j = i + int(rng.integers(5, 41))
            pieces.append((y, own[i:j]))
            i = j
    pieces = [pieces[i] for i in rng.permutation(len(pieces))]
    chains = [[(y, x) for y, own in pieces[i : i + 8] for x in own] for i in range(0, len(pieces), 8)]
    w = words(*buffers(pa.array([" ".join(x for _, x in c) for c in chains])), LETTERS)
    y = np.array([y for c in chains for y, _ in c], np.int64)
    if len(y) != len(w):
        raise ValueError("stretches must hold words of letters, divided by spaces")
    kinds, which = distinct(w)
    word, feature = features(kinds, model.lexicon, k)
    gold = np.bincount(which * k + y, minlength=len(kinds) * k).reshape(-1, k)
    inside = np.ones(len(y), bool)
    inside[w.first[:-1][w.per_text > 0]] = False
    later = np.flatnonzero(inside)
    follows = np.bincount(y[later - 1] * k + y[later], minlength=k * k).reshape(k, k)
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weight, model.step)]
    for r in range(1, rounds + 1):
        emission = model.emission(word, feature, len(kinds))[which]
        post, forward, backward = forward_backward(emission, model.step, w.first)
        missed = gold - np.stack([np.bincount(which, post[:, j], len(kinds)) for j in range(k)], 1)
        g_weight = np.stack([np.bincount(feature, missed[word, j], size) for j in range(k)], 1) / len(y)
        e = np.exp(emission - emission.max(1, keepdims=True))
        both = forward[later - 1][:, :, None] * np.exp(model.step) * (e * backward)[later][:, None, :]
        g_step = (follows - (both / both.sum((1, 2), keepdims=True)).sum(0)) / len(y)
        for p, g, m in zip((model.weight, model.step), (g_weight, g_step), moment):
            g = g - penalty * p
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
            p += rate * (m[0] / (1 - 0.9**r)) / (np.sqrt(m[1] / (1 - 0.99**r)) + 1e-5)
    model.weight = model.weight.astype(np.float32)
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, max_rows: int = 400, fragment: int = 160, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Fit on at most ``max_rows`` texts of each language whose crc32(id as text) mod 3 is not 1."""
    own = documents.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), F.col(label_col).cast("string").alias("__y"))
    own = own.where(F.col("__id").isNotNull() & F.col("__text").isNotNull() & F.col("__y").isNotNull() & ~held_out("__id"))
    own = own.withColumn("__h", F.xxhash64("__id", "__text"))
    many = own.groupBy("__y").agg(F.count("*").alias("__n"))  # one row per language
    # a share of each language by hash, some four times what is wanted, and of that the least hashes
    share = (F.col("__h").cast("double") / F.lit(2.0**64) + 0.5) * F.col("__n") <= 4.0 * max_rows
    near = own.join(F.broadcast(many), "__y").where(share)
    rank = F.row_number().over(Window.partitionBy("__y").orderBy("__h", "__text"))
    drawn = near.withColumn("__rank", rank).where(F.col("__rank") <= max_rows).select("__y", "__h", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text", 1 << 20):
                w = words(*buffers(part.column("__text")), LETTERS)
                out = []
                for a, b, h in zip(w.first[:-1].tolist(), w.first[1:].tolist(), np.asarray(part.column("__h")).tolist()):
                    i = a + h % max(1, b - a - fragment + 1)
                    span = [(s, e) for s, e in zip(w.start[i : min(b, i + fragment)].tolist(), w.end[i : min(b, i + fragment)].tolist()) if e - s <= LONGEST]
                    out.append(" ".join(w.data[s:e].tobytes().decode() for s, e in span))
                yield pa.RecordBatch.from_arrays([part.column("__y"), part.column("__h"), pa.array(out, pa.string())], names=["y", "h", "t"])

    rows = drawn.mapInArrow(run, "y string, h long, t string").where("t != ''").collect()  # max_rows stretches of each language
    return fit([(r["y"], r["t"]) for r in sorted(rows, key=lambda r: (r["h"], r["y"], r["t"]))])


def identify(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switches: bool = True) -> DataFrame:
    """id, lang_pred, score, and with ``switches`` the runs of words of one likeliest language, as
    language:first:end by word number, comma-joined; one row per input row."""
    kept = documents.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("__text"))
    sent = documents.sparkSession.sparkContext.broadcast(model)  # (2**BITS + a few) x languages, and the lexicon of the sample
    names = [id_col, "lang_pred", "score", *(["switches"] if switches else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        k = len(m.labels)
        for batch in batches:
            for part in chunks(batch, "__text", 1 << 20):
                data, offsets = buffers(part.column("__text"))
                w = words(data, offsets, LETTERS)
                lettered = _lettered(data, offsets, part.column("__text"))
                lang, score, runs = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), [""] * part.num_rows
                if k and len(w):
                    kinds, which = distinct(w)
                    post, _, _ = forward_backward(m.emission(*features(kinds, m.lexicon, k), len(kinds))[which], m.step, w.first)
                    of = w.text_of()
                    mean = np.stack([np.bincount(of, post[:, j], part.num_rows) for j in range(k)], 1) / np.maximum(w.per_text, 1)[:, None]
                    best = np.round(mean, 9).argmax(1)  # the first of equals: the smallest
                    lang = [m.labels[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())]
                    score = np.where(lettered, np.minimum(mean[np.arange(len(best)), best], 1.0), 0.0)
                    if switches:
                        runs = _runs(post.argmax(1), w, m.labels)
                columns = [part.column(id_col), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(runs, pa.string())]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    kind = kept.schema[id_col].dataType.simpleString()
    return kept.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double" + ", switches string" * switches)


def _lettered(data: np.ndarray, offsets: np.ndarray, column: pa.Array) -> np.ndarray:
    """Texts with a letter; only those without an ASCII one are looked at as strings."""
    many = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = many[offsets[1:]] > many[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(map(str.isalpha, column[i].as_py()))
    return out


def _runs(label: np.ndarray, w: Words, labels: list[str]) -> list[str]:
    new = np.ones(len(label), bool)
    new[1:] = label[1:] != label[:-1]
    new[w.first[:-1][w.per_text > 0]] = True
    at = np.flatnonzero(new)
    end, of = np.append(at[1:], len(label)), w.text_of()[at]
    out: list[list[str]] = [[] for _ in w.per_text]
    for i, j, t in zip(at.tolist(), end.tolist(), of.tolist()):
        out[t].append(f"{labels[label[i]]}:{i - int(w.first[t])}:{j - int(w.first[t])}")
    return [",".join(x) for x in out]
