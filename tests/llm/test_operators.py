"""Each operator against brute force on small tables with every awkward case in them."""

import base64
import collections
import hashlib
import html
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm._io import Scratch, shared_dir
from palimpsest.llm import bpe, components, decontaminate, html_text, ngram_join, pii, quality, quality_rules, substring, url_lists, warc

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that the operators use inside, to clash with.
CLASH = ["class", "group", "hub", "key", "size", "text_no", "__id_x", "n_words", "score", "ids", "label"]


def sample(seed=3, n=60):
    """Texts with copies, near copies, shared passages, nulls, empties, one long text, repeats."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(20))
    rows = []
    for i in range(n):
        t = [word() for _ in range(rng.randint(1, 80))]
        if i % 5 == 0:
            t[len(t) // 2 : len(t) // 2] = passage.split()
        rows.append((i, " ".join(t)))
        if i % 7 == 0:
            rows.append((1000 + i, rows[-1][1]))
            near = list(t)
            near[rng.randrange(len(near))] = word()
            rows.append((2000 + i, " ".join(near)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n "), (5003, "one"), (5004, "ONE"), (None, passage), (5005, " ".join(word() for _ in range(30_000))), rows[0], rows[0]]
    return rows


def documents(spark, rows, seed=0):
    full = [(d, t, "en" if k % 3 else None, "src0", len(t or ""), *[None] * len(CLASH)) for k, (d, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)).repartition(3)


def key(r):
    return tuple(-1 if x is None else x for x in r)


@pytest.fixture(scope="module")
def rows():
    return sample()


def test_substring(spark, rows):
    n, least = 13, {}
    split = [(d, SPACED.findall(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            least[k] = min(least.get(k, 1 << 62), 1 << 61 if d is None else d)
    want = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < (1 << 61 if d is None else d):
                gone |= set(range(i, i + n))
        want.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = [tuple(r) for r in substring.dedup(documents(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[2] for r in got)


def test_substring_one_id_two_texts(spark):
    w = " ".join(f"w{i}" for i in range(20))
    got = substring.dedup(spark.createDataFrame([(1, w), (7, w), (7, w + " more words"), (7, "x " * 30)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (7, 0), (7, 20), (7, 20)]


def sets_of(text, n):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    known = [(d, sets_of(t, n)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((d, len(sets_of(t, n)), None if d is None else find(d)) for d, t in rows), key=key)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, rows, n, percent):
    found = ngram_join.join(documents(spark, rows), n, percent, keep=("lang",)).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=key)
    assert got == brute_components(rows, n, percent)
    names = collections.defaultdict(set)
    for r in found:
        assert (r["component"] is None) == (r["n_shingles"] == 0 or r["doc_id"] is None)
        if r["component"] is not None:
            names[r["component"]].add(r["component_id"])
    assert all(len(v) == 1 for v in names.values()) and {r["lang"] for r in found} == {"en", None}


def test_ngram_join_near_misses_around_a_hub(spark, monkeypatch):
    """Copies that differ from the base too much for a link, some of them linked with each other."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(40):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(150)] = f"x{i}{rng.random()}"
        rows.append((i, " ".join(t)))
        t[3] = f"y{i}"
        rows.append((100 + i, " ".join(t)))
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    got = sorted((tuple(r)[:3] for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()), key=key)
    assert got == brute_components(rows, 3, 90)


def test_what_operators_store_is_deleted(spark):
    docs = spark.createDataFrame([(i, "one two three four five six") for i in range(5)], "doc_id long, text string")
    folder = os.path.join(shared_dir(spark).removeprefix("file:").replace("//", "/"), "palimpsest")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    assert ngram_join.join(docs).where("component_id = 0").count() == 5
    assert decontaminate.contamination(docs, docs.withColumnRenamed("doc_id", "item_id")).where("n_hit = 6").count() == 5
    assert sorted(n.split("-")[0] for n in set(os.listdir(folder)) - before) == ["hits", "near"]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 101), (7, 7), (200, 200), (None, 3), (300, None), (None, None)], "a long, b long")
    with Scratch(spark) as scratch:
        got = {r["node"]: r["label"] for r in components.components(edges.withColumn("label", edges.a), scratch).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
        assert components.components(edges.limit(0), scratch).count() == 0


def test_url_lists(spark):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    entries = [
        ("l", "domain", "Bad.com", "block", "add", day(5)), ("l", "domain", "bad.com", "block", "remove", day(10)), ("l", "domain", "bad.com", "block", "remove", day(11)),
        ("l", "host", "good.bad.com", "allow", "add", day(1)), ("l", "prefix", "x.org/a/b", "block", "add", day(1)), ("l", "host", None, "block", "add", day(1)), ("m", "host", "never.org", "block", "remove", day(1)),
    ]
    captures = [
        (1, "http://bad.com/", day(4)), (2, "http://bad.com/", day(5)), (3, "https://u:p@www.BAD.com:80/x?q#f", day(9)), (4, "http://bad.com", day(10)), (5, "http://good.bad.com/", day(6)),
        (6, "http://x.org/a/b/c", day(2)), (7, "http://x.org/a/bc", day(2)), (8, None, day(6)), (9, "no url", day(6)), (10, "http://bad.com/", None), (11, "http://never.org/", day(6)), (2, "http://bad.com/", day(5)),
        (12, "http://bad.com./", day(6)), (13, "http://a:b@c@bad.com/", day(6)), (14, " HTTP://Bad.Com..:8080?x@good.bad.com", day(6)), (15, "http://ok.org/@bad.com", day(6)), (16, "http://[::1]:80/x", day(6)), (17, "", day(6)),
    ]
    e = spark.createDataFrame(entries, "list string, kind string, pattern string, verdict string, action string, dated string").withColumn("dated", url_lists.F.to_timestamp("dated"))
    c = spark.createDataFrame(captures, "page_id long, url string, fetched_at string").withColumn("fetched_at", url_lists.F.to_timestamp("fetched_at"))
    got = sorted((r["page_id"], r["decision"], r["n_active"]) for r in url_lists.evaluate(c, e).na.fill("-", ["decision"]).collect())
    assert got == [(1, "-", 0), (2, "block", 1), (2, "block", 1), (3, "block", 1), (4, "-", 0), (5, "allow", 2), (6, "block", 1), (7, "-", 0), (8, "-", 0), (9, "-", 0), (10, "-", 0), (11, "-", 0), (12, "block", 1), (13, "block", 1), (14, "block", 1), (15, "-", 0), (16, "-", 0), (17, "-", 0)]
    hosts = {r["page_id"]: r["host"] for r in url_lists.evaluate(c, e).collect()}
    assert [hosts[i] for i in (12, 13, 14, 15, 16, 17)] == ["bad.com", "bad.com", "bad.com", "ok.org", "[::1]", ""]
    assert url_lists.evaluate(c, e.limit(0)).where("blocked").count() == 0 and url_lists.evaluate(c.limit(0), e).count() == 0


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_RECORDS", 3)
    monkeypatch.setattr(warc, "BOUNDS_AT_ONCE", 1)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = [(i, f"http://h{i % 4}.example.com/p{i}?a=b c\n", ("same" if i % 5 == 0 else f"é{i}" * i)) for i in range(40)]
    pages += [(50, None, None), (51, "http://x.y/", ""), (52, "odd \x01 url", "long " * 200_000), (3, *pages[3][1:]), (None, "http://z/", "same"), (None, "http://z/", "alone")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, archive string")
    folder, directory = warc.write(df)
    assert directory.count() > 3 and directory.select("archive").distinct().count() > 4
    last = {}
    for p, _, h in pages:
        if p is not None:
            last[h or ""] = max(last.get(h or "", -1), p)
    want = []
    for p, _, h in pages:
        y = (h or "").encode()
        to = last.get(h or "")
        to = None if to == p or to is None else to
        want.append((p, len(y), base64.b32encode(hashlib.sha1(y).digest()).decode(), "response" if to is None else "revisit", to))
    got = [tuple(r)[:5] for r in warc.lookup(folder, directory, df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    one = warc.lookup(folder, directory, df.where("page_id = 7")).collect()
    assert [(r["page_id"], r["payload"]) for r in one] == [(7, pages[7][2].encode())]
    assert warc.lookup(folder, directory, spark.createDataFrame([(7, "http://other/")], "page_id long, url string")).count() == 0
    empty = warc.write(df.limit(0))
    assert warc.lookup(*empty, df).count() == 0
    assert warc.lookup(*warc.write(df, min_payload=10**9), df).where("record_type = 'revisit'").count() == 0


def test_warc_members_are_gzip(tmp_path):
    raw = zlib.decompress(warc.record(1, "http://a b/\r\n", b"body", None), 31)
    assert raw.startswith(b"WARC/1.1\r\n") and b"WARC-Target-URI: http://a%20b/%0D%0A\r\n" in raw and raw.endswith(b"body\r\n\r\n")


def test_quality_learns(spark, sf):
    docs, labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).select("doc_id", "score", quality.held_out().alias("h")).join(labels, "doc_id").where("h").collect()
    right = sum((r["score"] >= 0.3) == r["quality"] for r in got)
    assert right / len(got) > 0.9
    pos, neg = [r["score"] for r in got if r["quality"]], [r["score"] for r in got if not r["quality"]]
    assert np.mean([p > n for p in pos for n in neg]) > 0.93


def test_quality_awkward(spark, rows):
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(d, k % 2) for k, (d, _) in enumerate(rows[:40])] + [(1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    a = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(a) == len(rows) and all(0 <= r["score"] <= 1 for r in a)
    none = quality.train(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), none).count() == 0


def test_quality_scores_by_hand(spark, sf):
    """Each score again from one text's features, one by one; an id with several texts is learnt once."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    again = quality.train(docs.unionByName(docs), labels)
    assert np.array_equal(model.weight, again.weight) and model.bias == again.bias
    for r in quality.score(docs, model, keep=("text",)).collect():
        data, offsets = quality.buffers(pa.array([r["text"]], pa.string()))
        total = norm = 0.0
        for f in set(quality.indicators(data, offsets)[1].tolist()):
            total, norm = total + float(model.weight[f]), norm + float(model.scale2[f])
        margin = total / max(norm**0.5, 1e-9) + model.bias
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-min(35, max(-35, model.slope * margin + model.shift)))), abs=1e-6)


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(30, 6, replace=False)) for _ in range(40)]
    y = np.array([int(15 in r or rng.random() < 0.3) for r in rows])
    ratio = np.ones(1 << quality.BITS)
    w, b = quality.coordinate_descent(rows, y, ratio, 1.0, 400, 1)
    x = np.zeros((40, 31))
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(6)
    x[:, 30] = 1
    sign, cap = np.where(y > 0, 1, -1), np.where(y > 0, 40 / (2 * y.sum()), 40 / (2 * (40 - y.sum())))
    loss = lambda v: 0.5 * v @ v + (cap * np.maximum(0, 1 - sign * (x @ v))).sum()
    ours = np.append(w[:30], b)
    assert all(loss(ours) <= loss(ours + d) + 1e-2 for d in 0.05 * rng.normal(size=(200, 31)))


def tokenizer():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, rows, monkeypatch):
    path, pattern, theirs = tokenizer()
    rng = random.Random(1)
    more = [(9000 + i, "".join(rng.choice("aaabbc  \n'té€日🙂1,.") for _ in range(200))) for i in range(30)] + [(9100, "ab" * 40_000), (9101, "<|endoftext|>")]
    every = rows + more
    got = bpe.bpe(documents(spark, every), path, pattern).collect()
    want = collections.Counter((d, tuple(theirs.encode_ordinary(t or ""))) for d, t in every)
    assert collections.Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    assert collections.Counter((r["doc_id"], bytes(r["decoded"])) for r in got) == collections.Counter((d, (t or "").encode()) for d, t in every)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    v = bpe.Vocabulary.read(path)
    assert v.replay([b"international", b"abababab"]) == [theirs.encode_ordinary("international"), theirs.encode_ordinary("abababab")]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_pattern(t):
    out = []
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if k == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if k == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_pii_patterns_by_brute_force():
    rng = random.Random(2)
    for _ in range(4000):
        t = "".join(rng.choice("a1@.-+ (5%é") for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(t) == base_by_pattern(t), t
    for t in ("4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "a@b@c.com", "0255.1.1.1", "1" * 5000, "+1" + " " * 5000):
        assert pii.base_spans(t) == base_by_pattern(t)


def test_pii(spark, rows):
    field = pii.train(pii.labelled_rows(400))
    texts = [(1, "é mail a.b@c.org, card 4111111111111111 token = \"0123456789abcdef0123456789abcdef01234567\" end"), (2, "version 2.0 of 2024"), (3, "call (555) 123-4567 now")] + rows
    got = {r["doc_id"]: r for r in pii.pii(documents(spark, texts[:3]), field).collect()}
    assert got[1]["base"] == "email:7:16,card:23:39" and got[1]["spans"].startswith("email:7:16,card:23:39,secret:49:89")
    assert got[1]["redacted"] == "é mail [EMAIL], card [CARD] token = \"[SECRET]\" end" and got[2]["spans"] == "" and got[3]["spans"].startswith("phone:5:")
    every = pii.pii(documents(spark, texts), field).collect()
    assert len(every) == len(texts) and sum(r["redacted"] is None for r in every) == 1
    assert pii.pii(documents(spark, texts).limit(0), field).count() == 0


def test_field_decodes_the_best_path():
    rng = np.random.default_rng(0)
    field = pii.Field(rng.normal(size=(pii.FEATURES, 6)), rng.normal(size=(6, 6)))
    x, start = rng.normal(size=(7, pii.FEATURES)), np.array([0, 3, 4])
    got, emit = field.viterbi(x, start), x @ field.weight
    from itertools import product

    for a, b in ((0, 3), (3, 4), (4, 7)):
        total = lambda p: field.step[0, p[0]] + sum(emit[a + i, k] for i, k in enumerate(p)) + sum(field.step[p[i], p[i + 1]] for i in range(len(p) - 1)) + field.step[p[-1], 0]  # noqa: B023, E731
        assert tuple(got[a:b]) == max(product(range(6), repeat=b - a), key=total)


def test_quality_rules(spark, rows):
    lines = [(7000, "a b\na b\n\n \na b"), (7001, "x y z w v u t s q x y z w v u t s"), (7002, "# * $ | <>&%")]
    every = rows + lines
    labels = spark.createDataFrame([(d, 1) for d, _ in every], "doc_id long, quality int")
    got = quality_rules.judge(documents(spark, every), labels).collect()
    want = []
    for d, t in every:
        t = t or ""
        w = SPACED.findall(t)
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if SPACED.search(line):
                dup += line in seen
                seen.add(line)
        want.append((d, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(rep), len(w) < 20 or 100 * len(rep) > 30 * len(w)))
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(want, key=key)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # too few labels for any cutoff
    assert quality_rules.judge(documents(spark, every).limit(0), labels).count() == 0


def test_binomial_tail_and_cutoffs(spark):
    from math import comb, log

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(k, n) for n in (1, 30, 200) for k in (0, 1, 5) if k <= n], "k long, n long")
    for r in df.select("k", "n", quality_rules._tail(F.col("k"), F.col("n"), 0.03).alias("t")).collect():
        assert r["t"] == pytest.approx(log(sum(comb(r["n"], i) * 0.03**i * 0.97 ** (r["n"] - i) for i in range(r["k"] + 1))), abs=1e-9)


MEASURES = "__id long, __stratum string, __text long, n_words long, word_chars long, n_symbols long, n_capitals long, n_lines long, n_dup_lines long, n_repeat_words long"


def test_cutoffs_hold_the_risk_in_every_stratum(spark):
    """Good texts with symbols drawn alike in 40 strata, bad ones with more: the true share of good
    texts above a stratum's cutoffs must be at most the risk in all but a few strata."""
    rng = np.random.default_rng(1)
    good = lambda n: np.floor(rng.exponential(0.6, n)).astype(int)
    rows, labels, k = [], [], 0
    for stratum in range(40):
        for y, values in ((1, good(500)), (0, 4 + good(60))):
            for v in values.tolist():
                rows.append((k, f"s{stratum}", k, 100, 500, v, 5, 10, 0, 0))
                labels.append((k, y))
                k += 1
    rows += [(k, "small", k, 100, 500, 0, 5, 10, 0, 0)]
    labels += [(k, 1), (k, None), (None, 1)]
    cut = quality_rules.cutoffs(spark.createDataFrame(rows, MEASURES), spark.createDataFrame(labels, "doc_id long, quality int"), risk=0.05, delta=0.2).collect()
    used = [r["cut_symbols"] for r in cut if r["cut_symbols"] is not None]
    population = good(200_000)
    wrong = sum((population / 100 > c).mean() > 0.05 for c in used)
    assert len(used) >= 30 and wrong == 0 and {r["cut_symbols"] for r in cut if r["__stratum"] == "small"} == {None}
    assert np.mean([v / 100 > used[0] for v in (4 + good(1000)).tolist()]) > 0.9  # and it does reject bad ones


def test_copies_are_one_trial(spark):
    """A thousand copies of one good text are no evidence of a thousand texts."""
    rows = [(i, "en", 7, 100, 500, 0, 5, 10, 0, 0) for i in range(1000)] + [(2000 + i, "en", 100 + i, 100, 500, 9, 5, 10, 0, 0) for i in range(50)]
    labels = [(i, 1) for i in range(1000)] + [(2000 + i, 0) for i in range(50)]
    cut = quality_rules.cutoffs(spark.createDataFrame(rows, MEASURES), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all(r["cut_symbols"] is None for r in cut)


def test_quality_rules_reject_junk(spark, sf):
    """On labelled documents of every language the chosen cutoffs find most junk and few good texts."""
    big = sf.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judge(docs, labels).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id").where("not base_failed").selectExpr("lang", "quality", "cast(kept as int) as kept").groupBy("lang", "quality").avg("kept").collect()
    share = {(r[0], r[1]): r[2] for r in rows}
    assert all(v > 0.98 if y else v < 0.2 for (_, y), v in share.items()) and len(share) == 8


@pytest.mark.parametrize("block", [1 << 25, 60])
def test_contamination(spark, rows, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    item = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: item.findall((t or "").translate(LOWER))
    items = [(1, rows[5][1]), (2, " ".join(SPACED.findall(rows[0][1])[:5]).upper()), (3, "nowhere to be found"), (4, None), (5, ""), (None, rows[1][1]), (1, rows[5][1]), (6, "one")]
    got = decontaminate.contamination(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(13, len(w))
        for k in range(len(w) - m + 1) if m and i is not None else ():
            windows[tuple(w[k : k + m])].add(str(i))
    want = []
    for d, t in rows:
        w, hit, own = words(t), set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if found := windows.get(tuple(w[k : k + m])):
                    hit |= set(range(k, k + m))
                    own |= found
        want.append((d, len(w), len(hit), ",".join(sorted(own))))
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in got), key=key) == sorted(want, key=key)


def test_near_matches(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["a", "b", "c", "d", "e", "f", "G"]) for _ in range(rng.randint(0, n)))
    rows = [(i, text(40)) for i in range(60)] + [(100, "alpha x x beta"), (101, "beta " + "x " * 30 + "alpha"), (102, "Beta, alpha"), (103, None)]
    items = [(i, text(9)) for i in range(12)] + [(20, "alpha beta"), (21, "b b b b"), (21, "g"), (22, "zzz a"), (None, "a")]
    span = decontaminate.SLACK
    want = []
    for d, t in rows:
        w, own = (t or "").lower().replace(",", "").split(), set()
        for i, x in items:
            need = x.lower().split()
            if i is not None and need and any(set(need) <= set(w[k : k + len(need) + span]) for k in range(len(w))):
                own.add(str(i))
        want.append((d, sorted(own)))
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["near"]) for r in got) == want
    assert {d for d, o in want if "20" in o} == {100, 102}


def test_html_blocks_and_cut():
    weight = html_text.train(html_text.labelled_pages(150))
    held = html_text.labelled_pages(80, seed=77)
    assert sum(html_text.extract(h, weight) == t for h, t in held) / len(held) > 0.95
    page = '<html><head><title>t</title></head><body><nav><a href="/">Home</a></nav><article><h1>Head&eacute;</h1><p>First  line\n&amp; more of it.<p>Second<br>third line of the text.</article><script>var x = "<p>no</p>"</script><footer>&copy; me</footer>'
    assert html_text.extract(page, weight) == "Headé\nFirst line & more of it.\nSecond\nthird line of the text."
    for broken in (None, "", "<", "<p", "plain", "<p>a<!-- x", "<div " + "'" * 999, "<a href='x" + ">" * 5, "</p></div>" * 50, "<b>" * 20_000 + "x"):
        assert isinstance(html_text.extract(broken, weight), str)


@pytest.mark.parametrize("tag", ["<embed src=a>", "<embed src=a />", "<button>", "<select>", "<object data=a>", "<video>", "<svg/>"])
def test_html_reads_on_after(tag):
    assert [b[0] for b in html_text.blocks(f"<p>before</p>{tag}<p>after</p>{tag}<p>last</p>")] == ["before", "after", "last"]


def test_html_formulas_and_raw_text():
    assert [b[0] for b in html_text.blocks("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><p>after</p>")] == ["so x=1 holds", "after"]
    assert [b[0] for b in html_text.blocks("<p>a</p><button>no</button><object>no</object><p>b</p><script>var x")] == ["a", "b"]
    assert len(html_text.blocks("<p>a</p>" + "<button>" * 50_000 + "<p>b</p>")) == 2


def test_html_table(spark):
    weight = html_text.train(html_text.labelled_pages(60))
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (2, None, None, "x"), (1, "u", "<p>a</p>", "x")], "page_id long, url string, html string, text string")
    got = html_text.main_text(df, weight).collect()
    assert len(got) == 3 and got[0]["text"] == got[2]["text"]
    assert html_text.main_text(df.limit(0), weight).count() == 0


def test_max_flow_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    for _ in range(150):
        n = int(rng.integers(1, 8))
        s, t = rng.random(n) * 3, rng.random(n) * 3
        edges = [(i - 1, i, rng.random()) for i in range(1, n)] + [(int(a), int(b), rng.random()) for a, b in rng.integers(0, n, (3, 2)) if a != b]
        cost = lambda x: sum(t[i] if x[i] else s[i] for i in range(n)) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: B023, E731
        assert cost(html_text.max_flow(list(s), list(t), edges)) == pytest.approx(min(map(cost, product([0, 1], repeat=n))))


@pytest.mark.parametrize("call", ["substring", "join", "bpe", "decontaminate"])
def test_empty_tables(spark, call):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path, pattern, _ = tokenizer()
    run = {
        "substring": lambda: substring.dedup(docs), "join": lambda: ngram_join.join(docs), "bpe": lambda: bpe.bpe(docs, path, pattern),
        "decontaminate": lambda: decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")),
    }[call]
    assert run().count() == 0


def test_words_of_sliced_arrays():
    from palimpsest.llm import _words

    a = pa.array(["zero", "a b", None, "", "c d"]).slice(1)
    w = _words.words(*_words.buffers(a))
    assert w.first.tolist() == [0, 2, 2, 2, 4]
    h = w.hashes()
    assert len(set(h.tolist())) == 4
    assert html.unescape("&amp;") == "&"


def self_similar(bits=10):
    """Two words of 2**bits letters whose difference every polynomial hash modulo 2**64 misses."""
    a = "a"
    for _ in range(bits):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [4, 6, 10, 13])
def test_words_that_imitate_each_other(spark, bits):
    a, b = self_similar(bits)
    rest = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string")
    assert {r["n_removed"] for r in substring.dedup(docs).collect()} == {0}
    alone = spark.createDataFrame([(1, a), (2, b), (3, b)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.join(alone).collect()) == [(1, 1), (2, 2), (3, 2)]
    items = spark.createDataFrame([("x", b)], "item_id string, text string")
    assert sorted((r["doc_id"], r["n_hit"]) for r in decontaminate.contamination(alone, items).collect()) == [(1, 0), (2, 1), (3, 1)]


def test_word_hashes_by_definition():
    from palimpsest.llm import _words

    rng = random.Random(5)
    texts = ["".join(rng.choice("abé\0") for _ in range(rng.choice([1, 2, 6, 7, 8, 13, 14, 15, 21, 111, 112]))) for _ in range(300)]
    w = _words.words(*_words.buffers(pa.array(texts)))
    key = _words.new_key()
    point = (key * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % (_words.P61 - 2) + 1
    want = []
    for t in (w.data[a:b].tobytes() for a, b in zip(w.start, w.end)):
        h = 0
        for i in range(0, len(t), 7) if len(t) <= _words.LONG else []:
            h = (h * point + int.from_bytes(t[i : i + 7], "little")) % _words.P61
        h = (h * point + len(t)) % _words.P61
        want.append(h if len(t) <= _words.LONG else int.from_bytes(hashlib.blake2b(t, digest_size=8, key=key.to_bytes(8, "little")).digest(), "little"))
    assert w.hashes(key).tolist() == _words.mix(np.array(want, np.uint64)).tolist()
    assert w.hashes(key).tolist() != w.hashes(key + 2).tolist()
