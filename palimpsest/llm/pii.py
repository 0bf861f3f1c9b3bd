"""Personal data: fixed patterns, and a linear-chain conditional random field.

The field labels white-space separated words from features of their shape and of
their neighbours' shapes.  Only words with a digit or an @ may carry a label other
than "other"; every other word is fixed to "other", so by the Markov property a
text falls into independent runs of such words, and decoding the runs alone is
exact.  Runs of similar length are decoded together by Viterbi in numpy.  The
field is trained on a small labelled table (``text``, ``spans``) by gradient
ascent on the conditional log likelihood.

The patterns' spans always stay; the field adds those of its spans that overlap
none of them (card numbers only if their check digit holds).  One pass where the texts are read, no shuffle.

Defined results: a null text is empty and has no spans; texts of any length are
searched whole; offsets count code points, ends exclusive; repeated rows give
repeated results; an empty table gives an empty one; other columns are not read
unless named in ``keep``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._words import SPACED, buffers, chunks, words

KINDS = ("email", "ip", "card", "phone", "secret")  # spans are listed in this order
LABELS = ("other", *KINDS)
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        s = at
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        if m and s < at:
            out.append(("email", s, m.end()))
            done = m.end()
        elif s < at:
            done = at  # what stands before a failed @ can't match again
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# Features of a word and its neighbours.

_HEX = re.compile(r"[0-9a-fA-F]+\Z")
FEATURES = 46


def _core(word: str) -> tuple[int, int]:
    """Range of the word without the punctuation around it."""
    a, b = 0, len(word)
    while a < b and not (word[a].isalnum() or word[a] in "+("):
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return (a, b) if a < b else (0, len(word))


def _shape(w: str) -> list[bool]:
    n, d = len(w), sum("0" <= c <= "9" for c in w)
    letters = sum(c.isalpha() for c in w)
    dots, dashes = w.count("."), w.count("-")
    hexes = bool(_HEX.match(w))
    return [
        d == n, d == 1, d == 2, d == 3, d == 4, 5 <= d <= 6, d == 7, 8 <= d <= 12, 13 <= d <= 19, d > 19,
        "@" in w and dots > 0, "@" in w, dots == 1, dots == 2, dots == 3, dots > 3, dashes == 1, dashes == 2, dashes > 2,
        w[:1] == "+", w[:1] == "(", d > 0 and letters == 0 and d < n, letters > 0 and d > 0, letters > d > 0,
        n >= 16, n >= 24, n >= 32, hexes and n >= 16 and letters > 0, letters > 0 and d > 2 and n >= 20 and not ("@" in w or dots),
        "/" in w or ":" in w, "%" in w or "$" in w or "€" in w, bool(re.fullmatch(r"\(?[0-9]{3}\)?[-.]?[0-9]{3}[-.][0-9]{4}", w)),
        bool(re.fullmatch(r"[0-9]{3}[-.][0-9]{4}", w)), bool(re.fullmatch(r"\([0-9]{2,4}\)?", w)), bool(re.fullmatch(r"(19|20)[0-9]{2}", w)),
    ]


def _vector(before: str, word: str, after: str) -> list[float]:
    own, p, q = _shape(word), before.strip("\"'.,;"), after.strip("\"'.,;")
    d = lambda w: any("0" <= c <= "9" for c in w)
    near = [
        1, not before, before[-1:] in "=:" and bool(before), d(p), p[:1] == "+", bool(re.fullmatch(r"\([0-9]{2,4}", p.strip(")"))), len(p) == 4 and p.isdigit(),
        not after, d(q), len(q) == 4 and q.isdigit(), bool(re.fullmatch(r"[0-9]{3}[-.][0-9]{4}", q)),
    ]
    return [float(x) for x in (*own, *near)]


def runs(column: pa.Array) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """Words that may carry a label: (text, start, end) in code points without outer
    punctuation; their features; and the index of the first word of each run."""
    data, offsets = buffers(column)
    w = words(data, offsets, SPACED)
    marked = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 0x30) & (data <= 0x39) | (data == 0x40), out=marked[1:])
    at = np.flatnonzero(marked[w.end] > marked[w.start])
    if not len(at):
        return [], np.zeros((0, FEATURES)), np.zeros(0, np.int64)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    of = np.searchsorted(w.first, at, "right") - 1
    raw = data.tobytes()
    get = lambda i: raw[w.start[i] : w.end[i]].decode("utf-8", "replace")
    place, vector = [], []
    for i, t in zip(at.tolist(), of.tolist()):
        word = get(i)
        a, b = _core(word)
        s = int(points[w.start[i]] - points[offsets[t]])
        place.append((t, s + a, s + b))
        vector.append(_vector(get(i - 1)[-40:] if i > w.first[t] else "", word[a:b], get(i + 1)[:40] if i + 1 < w.first[t + 1] else ""))
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(of) != 0)])
    return place, np.array(vector), np.flatnonzero(new)


def _padded(start: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of like length: (words as a matrix with -1 beyond the end, lengths)."""
    length = np.diff(np.append(start, n))
    order = np.argsort(length, kind="stable")
    i = 0
    while i < len(order):
        top = max(8, 2 * int(length[order[i]]))
        j = i + int(np.searchsorted(length[order[i:]], top, "right"))
        j = min(j, i + 4096)
        rows = order[i:j]
        steps = np.arange(int(length[rows].max()))
        yield np.where(steps < length[rows][:, None], start[rows][:, None] + steps, -1), length[rows]
        i = j


class Field:
    """A linear-chain conditional random field; both ends of a run stand beside "other"."""

    def __init__(self, weight: np.ndarray, step: np.ndarray):
        self.weight, self.step = weight, step  # features x labels, labels x labels

    def viterbi(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The best label of each word."""
        out, emit = np.zeros(len(x), np.int64), x @ self.weight
        for at, length in _padded(start, len(x)):
            best = self.step[0] + emit[at[:, 0]]
            back = []
            for t in range(1, at.shape[1]):
                to = best[:, :, None] + self.step
                came = to.argmax(1)
                live = (at[:, t] >= 0)[:, None]
                best = np.where(live, to.max(1) + emit[at[:, t]], best)
                back.append(np.where(live, came, np.arange(len(self.step))))
            label = (best + self.step[:, 0]).argmax(1)
            for t in range(at.shape[1] - 1, -1, -1):
                live = at[:, t] >= 0
                out[at[live, t]] = label[live]
                if t:
                    label = back[t - 1][np.arange(len(label)), label]
        return out

    def gradient(self, x: np.ndarray, start: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Conditional log likelihood and its gradient."""
        emit, total = x @ self.weight, 0.0
        gw, gs = np.zeros_like(self.weight), np.zeros_like(self.step)
        for at, length in _padded(start, len(x)):
            n, steps = at.shape
            live = at >= 0
            e = emit[at]
            fwd, bwd = np.zeros((steps, n, len(self.step))), np.zeros((steps, n, len(self.step)))
            fwd[0] = self.step[0] + e[:, 0]
            for t in range(1, steps):
                fwd[t] = np.where(live[:, t, None], np.logaddexp.reduce(fwd[t - 1][:, :, None] + self.step, 1) + e[:, t], fwd[t - 1])
            z = np.logaddexp.reduce(fwd[-1] + self.step[:, 0], 1)
            bwd[-1] = self.step[:, 0]
            for t in range(steps - 2, -1, -1):
                bwd[t] = np.where(live[:, t + 1, None], np.logaddexp.reduce(self.step + (e[:, t + 1] + bwd[t + 1])[:, None, :], 2), self.step[:, 0])
            eye = np.eye(len(self.step))
            for t in range(steps):
                k = live[:, t]
                p = np.exp(fwd[t] + bwd[t] - z[:, None])[k]
                own = eye[y[at[k, t]]]
                gw += x[at[k, t]].T @ (own - p)
                if t:
                    both = np.exp(fwd[t - 1][k][:, :, None] + self.step + (e[:, t] + bwd[t])[k][:, None, :] - z[k][:, None, None])
                    gs += np.einsum("ni,nj->ij", eye[y[at[k, t - 1]]], own) - both.sum(0)
                else:
                    gs[0] += (own - p).sum(0)
            ends = at[np.arange(n), length - 1]
            p = np.exp(fwd[-1] + self.step[:, 0] - z[:, None])
            gs[:, 0] += (eye[y[ends]] - p).sum(0)
            total -= z.sum()
        total += emit[np.arange(len(x)), y].sum()
        first = np.zeros(len(x), bool)
        first[start] = True
        total += self.step[0, y[start]].sum() + self.step[y[:-1][~first[1:]], y[1:][~first[1:]]].sum() + self.step[y[np.append(start[1:], len(x)) - 1], 0].sum()
        return float(total), gw, gs


def parse(spans: str) -> list[Span]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def train(rows: list[tuple[str, str]], rounds: int = 250, rate: float = 0.1, penalty: float = 0.02) -> Field:
    """Fit on (text, spans) rows by Adam on the penalised likelihood."""
    place, x, start = runs(pa.array([t for t, _ in rows], pa.string()))
    spans = [parse(s) for _, s in rows]
    y = np.array([next((LABELS.index(k) for k, a, b in spans[t] if s < b and a < e), 0) for t, s, e in place], np.int64)
    field = Field(np.zeros((FEATURES, len(LABELS))), np.zeros((len(LABELS), len(LABELS))))
    if not len(y):
        return field
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in (field.weight, field.step)]
    for r in range(1, rounds + 1):
        _, gw, gs = field.gradient(x, start, y)
        for p, g, m in zip((field.weight, field.step), (gw, gs), moment):
            g = g / len(start) - penalty / len(LABELS) * p * 0.05
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
            p += rate * (m[0] / (1 - 0.9**r)) / (np.sqrt(m[1] / (1 - 0.99**r)) + 1e-8)
    return field


def labelled_rows(n: int = 900, seed: int = 11) -> list[tuple[str, str]]:
    """A small labelled table made by rule: sentences of invented words with one item each."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda: "".join(rng.choice(list("abdeghiklmnoprstuvz"), int(rng.integers(2, 9))))
    alnum = lambda k, a: "".join(rng.choice(list(a), k))
    hexes, more = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    make = [
        ("email", lambda: f"{word()}.{digits(2)}@{word()}{digits(1)}.{word()}.com"),
        ("email", lambda: f"{word()}@{word()}.{word()}"),
        ("ip", lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4))),
        ("card", lambda: digits(int(rng.choice([13, 15, 16, 16, 16, 19])))),
        ("card", lambda: " ".join(digits(4) for _ in range(4))),
        ("card", lambda: "-".join(digits(4) for _ in range(4))),
        ("phone", lambda: f"+{rng.integers(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}"),
        ("phone", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        ("phone", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"),
        ("phone", lambda: f"+{rng.integers(1, 99)} {digits(3)} {digits(3)} {digits(4)}"),
        ("secret", lambda: alnum(40, hexes)),
        ("secret", lambda: alnum(int(rng.integers(24, 48)), more) + digits(3)),
        ("secret", lambda: alnum(32, hexes)),
        ("", lambda: digits(int(rng.integers(1, 7)))),
        ("", lambda: f"{digits(1)}.{digits(1)}"),
        ("", lambda: f"{rng.integers(1900, 2100)}"),
        ("", lambda: f"{rng.integers(1900, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}"),
        ("", lambda: f"{digits(2)}:{digits(2)}"),
        ("", lambda: f"{digits(2)}%"),
        ("", lambda: f"{word()}{digits(int(rng.integers(1, 4)))}"),
        ("", lambda: f"{digits(3)} {digits(3)} {digits(2)}"),
        ("", lambda: f"{digits(1)}.{digits(2)}.{digits(1)}"),
        ("", lambda: f"@{word()}"),
    ]
    out = []
    for i in range(n):
        kind, item = make[i % len(make)]
        text = " ".join(word() for _ in range(int(rng.integers(0, 5))))
        if kind == "secret" and rng.random() < 0.7:
            text += str(rng.choice([" token =", " key:", " password =", " secret ="]))
        text = (text + " ").lstrip() + ('"' if (quoted := kind == "secret" and rng.random() < 0.6) else "")
        a = len(text)
        text += item()
        b = len(text)
        text += '"' * quoted + str(rng.choice(["", "", ".", ",", "***", "!!", "$$$"])) + " " + " ".join(word() for _ in range(int(rng.integers(0, 5))))
        out.append((text, f"{kind}:{a}:{b}" if kind else ""))
    return out


def labelled_table(spark: SparkSession, n: int = 900) -> DataFrame:
    return spark.createDataFrame(labelled_rows(n), "text string, spans string")


def field_of(labelled: DataFrame, max_rows: int = 20_000) -> Field:
    """Train on the labelled table, at most ``max_rows`` of it."""
    rows = labelled.where("text is not null").orderBy("text", "spans").limit(max_rows).collect()
    return train([(r["text"], r["spans"] or "") for r in rows])


def find(texts: pa.Array, field: Field) -> tuple[list[list[Span]], list[list[Span]]]:
    """The patterns' spans, and the spans that the field adds, of each text."""
    place, x, start = runs(texts)
    base: list[list[Span]] = [[] for _ in range(len(texts))]
    added: list[list[Span]] = [[] for _ in range(len(texts))]
    for t in dict.fromkeys(t for t, _, _ in place):
        base[t] = base_spans(texts[t].as_py())
    if place:
        label = field.viterbi(x, start)
        first = set(start.tolist())
        grown: list[tuple[int, Span]] = []
        for i, ((t, a, b), k) in enumerate(zip(place, label.tolist())):
            if k and grown and i not in first and label[i - 1] == k:
                grown[-1] = (t, (LABELS[k], grown[-1][1][1], b))
            elif k:
                grown.append((t, (LABELS[k], a, b)))
        for t, s in grown:
            if s[0] == "card" and not _checked(texts[t].as_py()[s[1] : s[2]]):
                continue
            if all(s[2] <= a or b <= s[1] for _, a, b in base[t]):
                added[t].append(s)
    return base, added


def _checked(text: str) -> bool:
    digits = "".join(c for c in text if "0" <= c <= "9")
    return 13 <= len(digits) <= 19 and luhn(digits)


def redacted(text: str, spans: list[Span]) -> str:
    """Every span, or union of overlapping ones, becomes [KIND] of its first."""
    out, done = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{k.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def pii(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the kept columns, base spans, all spans, and the text with all of them masked."""
    kept = df.select(*dict.fromkeys([id_col, *keep]), F.col(text_col).cast("string").alias("__text"))
    names = [c for c in kept.columns if c != "__text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "__text", 2 << 20):
                texts = part.column("__text")
                base, added = find(texts, field)
                clean = [(redacted(t, b + a) if b or a else t) for t, b, a in zip(texts.to_pylist(), base, added)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(map(listed, base), pa.string()), pa.array((listed(b + a) for b, a in zip(base, added)), pa.string()), pa.array(clean, pa.string())],
                    names=[*names, "base", "spans", "redacted"],
                )

    fields = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names)
    return kept.mapInArrow(run, f"{fields}, base string, spans string, redacted string")


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
