"""Spelling variants, language identification and token alignment against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import alignment, languages, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASH = ["word", "n", "key", "bucket", "batch", "place", "score", "salt"]


def documents(spark, rows):
    full = [(d, t, lang, "src", len(t or ""), *[None] * len(CLASH)) for d, t, lang in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3)


# Spelling variants.


def edited(rng, w):
    i, c = rng.randrange(len(w)), rng.choice("abcéÉ×zZ")
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def word_rows(seed=4):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÀ×") for _ in range(rng.randint(6, 11))) for _ in range(40)]
    base += ["aaaaaaaa", "aaaaaaa", "ab" * 31 + "c", "ab" * 32, "ab" * 32 + "c", "q" * 64, "q" * 65, "q" * 66, "x" * 300]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(1, 30)):
            w = base[min(int(rng.expovariate(0.12)), len(base) - 1)]
            words.append(edited(rng, w) if rng.random() < 0.15 else w)
            if len(w) > 60:
                words += [edited(rng, w)] * 2
        rows.append((i, rng.choice([" ", "-", ", ", "9"]).join(words), "en"))
    chain = ["rootword"] * 2000 + ["rootwore"] * 150 + ["rootxore"] * 12 + ["rootxoree"] * 2
    return rows + [(900, " ".join(chain), None), (None, "aaaaaaaa " * 5, None), (901, None, "en"), (902, "", "en"), (903, "... 12 ĀĀ", "en"), rows[0], rows[0]]


def variants_by_hand(rows, every=31):
    n = Counter()
    for d, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, out = {}, {}
    for w, k in n.items():
        other = [x for x in n if near(w, x)]
        best = min(other, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * k else None
        out[w] = len(other)
    rows = []
    for w, k in n.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, k, out[w], None if form[w] is None else n[form[w]]))
    return sorted(rows, key=str)


@pytest.mark.parametrize("every", [31, 0])
def test_variants(spark, every):
    rows = word_rows()
    got = [tuple(r) for r in variants.variants(documents(spark, rows), misspell_every=every).collect()]
    want = variants_by_hand(rows, every)
    assert sorted(got, key=str) == want
    assert any(r[1] != r[2] for r in want if r[1]) and any(len(r[0]) > 64 and r[4] for r in want)


def test_variants_empty(spark):
    assert variants.variants(documents(spark, word_rows()).limit(0)).count() == 0
    assert variants.variants(documents(spark, [(1, None, None), (2, "", None), (3, "short words", None)])).count() == 0


def test_deletion_keys_are_hashes_of_the_strings():
    words = [b"abcab", b"aab", b"ab", b"a", b"abab", b"\xe9\xe8"]
    key, word, place = variants.deletions(words)
    name = {}
    for k, w, p in zip(key.tolist(), word.tolist(), place.tolist()):
        s = words[w] if p < 0 else words[w][:p] + words[w][p + 1 :]
        assert name.setdefault(s, k) == k
    assert len(set(name.values())) == len(name) and len(key) == sum(len(w) + 1 for w in words)


def test_colliding_keys_change_nothing():
    rng = random.Random(9)
    base = ["".join(rng.choice("abc") for _ in range(7)) for _ in range(30)]
    words = sorted({w for b in base for w in [b, edited(rng, b), edited(rng, b)]})
    n = {w: rng.randrange(2, 90) for w in words}
    batch = pa.record_batch({"word": words, "n": pa.array([n[w] for w in words], pa.int64())})
    sent = pa.Table.from_batches(variants._sent(iter([batch]), 0))
    keys = np.frombuffer(sent.column("keys")[0].as_py(), "<u8")
    weak = sent.set_column(1, "keys", pa.array([(keys & np.uint64(7)).astype("<u8").tobytes()], pa.binary()))
    want = {w: (sum(near(w, x) for x in words), min((x for x in words if near(w, x)), key=lambda x: (-n[x], x), default=None)) for w in words}
    for t in (sent, weak):
        got = {r["word"]: (r["k"], r["best"]) for r in variants._neighbours(t).to_pylist()}
        assert got == {w: x for w, x in want.items() if x[0]}


def test_one_edit():
    for a, b in itertools.product(["".join(p) for k in range(4) for p in itertools.product("ab", repeat=k)], repeat=2):
        assert variants.one_edit(a, b) == near(a, b)


# Languages.


def plain_forward_backward(emission, step):
    n, k = emission.shape
    f, b = np.zeros((n, k)), np.zeros((n, k))
    f[0] = np.logaddexp.reduce(step, 0) - np.log(k) + emission[0]
    for t in range(1, n):
        f[t] = np.logaddexp.reduce(f[t - 1][:, None] + step, 0) + emission[t]
    for t in range(n - 2, -1, -1):
        b[t] = np.logaddexp.reduce(step + (emission[t + 1] + b[t + 1])[None, :], 1)
    z = np.logaddexp.reduce(f[-1])
    return np.exp(f + b - z)


def test_forward_backward_in_segments():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 5, 64, 65, 0, 128, 700, 3]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emission, step = rng.normal(0, 3, (int(first[-1]), 4)), rng.normal(0, 2, (4, 4))
    post, _, _ = languages.forward_backward(emission, step, first)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            assert np.allclose(post[a:b], plain_forward_backward(emission[a:b], step), atol=1e-9)


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(4)
    emission, step = rng.normal(0, 2, (5, 3)), rng.normal(0, 2, (3, 3))
    post = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        s = np.logaddexp.reduce(step[:, path[0]]) + sum(emission[t, y] for t, y in enumerate(path)) + sum(step[x, y] for x, y in zip(path, path[1:]))
        for t, y in enumerate(path):
            post[t, y] += np.exp(s)
    got, _, _ = languages.forward_backward(emission, step, np.array([0, 5]))
    assert np.allclose(got, post / post.sum(1, keepdims=True), atol=1e-9)


@pytest.fixture(scope="module")
def model(spark, sf):
    return languages.train(spark.read.parquet(f"{sf}/documents.parquet"))


def test_held_out_languages(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = languages.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(languages.held_out()).collect()
    assert len(got) > 50 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_what_is_held_out_teaches_nothing(spark, sf, model):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = docs.withColumn("lang", F.when(languages.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z")).repartition(7)
    again = languages.train(other)
    assert again.labels == model.labels and np.array_equal(again.weight, model.weight) and np.array_equal(again.step, model.step)


def test_code_switched_words(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(languages.held_out()).orderBy("doc_id").collect()
    rng, own = random.Random(2), defaultdict(list)
    for r in docs:
        own[r["lang"]] += re.findall(r"[^\W\d_]+", r["text"])
    rows, truth = [], {}
    for i in range(40):
        words, labels = [], []
        for lang in [rng.choice(sorted(own)) for _ in range(6)]:
            at, k = rng.randrange(max(1, len(own[lang]) - 30)), rng.randint(6, 30)
            part = own[lang][at : at + k]
            words += part
            labels += [lang] * len(part)
        rows.append((i, " ".join(words), None))
        truth[i] = labels
    assert (np.diag(model.step) > model.step.max(1) - 1e-9).all()  # languages stay
    right = total = 0
    for r in languages.identify(documents(spark, rows), model).collect():
        said = [lang for lang, a, b in (x.split(":") for x in r["switches"].split(",")) for _ in range(int(b) - int(a))]
        assert len(said) == len(truth[r["doc_id"]])
        right += sum(x == y for x, y in zip(said, truth[r["doc_id"]]))
        total += len(said)
    assert right >= 0.93 * total


def test_language_of_awkward_texts(spark, model):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 — … 😀 ٣", "en"), (4, "日本語", "en"), (None, "the and of that", None), (5, "the and " * 40_000, "en"), (5, "the and " * 40_000, "en"), (6, "A", "en")]
    got = {(r["doc_id"], r["lang_pred"] == "und"): r for r in languages.identify(documents(spark, rows), model).collect()}
    assert {d for d, und in got if und} == {1, 2, 3}
    assert all(got[d, True]["score"] == 0 and got[d, True]["switches"] == "" or d == 3 for d in (1, 2, 3))
    assert got[5, False]["lang_pred"] == "en" and got[5, False]["score"] > 0.9 and got[5, False]["switches"] == "en:0:80000"
    assert languages.identify(documents(spark, rows).limit(0), model).count() == 0
    nothing = languages.train(documents(spark, [(1, None, "en"), (2, "text", None), (None, "text", "en")]))
    assert {r["lang_pred"] for r in languages.identify(documents(spark, rows), nothing).collect()} == {"und"}


# Alignment.


def aligned_by_hand(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(P.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in keep} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in keep)}
    count, docs = Counter(), []
    for d, t, _ in rows:
        x = a.encode(" " + t, add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xb = [bytes(byte[c] for c in a.id_to_token(i)) for i in x]
        yb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, y)]
        if not t or b"".join(xb) != (" " + t).encode() or b"".join(yb) != (" " + t).encode():
            docs.append((d, 0, 0, [], ""))
            continue
        ends_a, ends_b = list(itertools.accumulate(map(len, xb))), list(itertools.accumulate(map(len, yb)))
        both = sorted(set(ends_a) & set(ends_b))
        at_a, at_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
        links, groups, i, j = [], [], 0, 0
        for e in both:
            links.append((x[at_a[e]], y[at_b[e]]))
            groups.append(",".join(map(str, x[i : at_a[e] + 1])) + "|" + ",".join(map(str, y[j : at_b[e] + 1])))
            i, j = at_a[e] + 1, at_b[e] + 1
        count.update(links)
        docs.append((d, len(x), len(y), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return sorted(((d, n, m, len(li), len(li), sum(count[x] == top[x[1]] for x in li), sum(count[x] for x in li), g) for d, n, m, li, g in docs), key=str)


def align_rows(spark, sf):
    own = [(r["doc_id"], r["text"], "en") for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    odd = ["", None, " ", "  two  spaces ", "tab\tand\nline\n\n", "<|endoftext|> <s> </s> <unk> plain", "▁ mark", "é 日本 😀 ﬁ", "a" * 3000, "x\u0000y", "The the THE", "don't we'll 1234567", " lead"]
    rows = own + [(1000 + i, t, None) for i, t in enumerate(odd)] + [(None, own[0][1], None), (None, "null id", None), own[1], own[1], (2000, " ".join(t for _, t, _ in own), None)]
    return rows


def test_alignment(spark, sf, monkeypatch):
    import public_tokenizers as P

    rows = align_rows(spark, sf)
    want = aligned_by_hand(rows)
    assert any(r[6] for r in want) and any(r[5] < r[4] for r in want)
    run = lambda: sorted((tuple(r) for r in alignment.align(documents(spark, rows), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN).collect()), key=str)
    assert run() == want
    monkeypatch.setattr(alignment, "PIECE_BYTES", 40_000)  # several pieces of each bucket
    assert run() == want


def test_alignment_empty(spark):
    import public_tokenizers as P

    go = lambda rows, n=None: alignment.align(documents(spark, rows).limit(len(rows) if n is None else n), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)
    assert go([(1, "a", None)], 0).count() == 0
    assert [tuple(r) for r in go([(1, None, None)]).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
