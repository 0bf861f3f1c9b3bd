"""Encoders, their store, pair scorers, and recall with them and on an index."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.config import RecallConfig
from palimpsest.operators import models as M
from palimpsest.plans import recall as R
from palimpsest.plans import recall_many as RM
from palimpsest.views import AS_OF, view

MEMORIES = "id long, concept string, content string"


def now():
    return F.lit(AS_OF).cast("timestamp")


def test_encoding_is_the_model(spark):
    texts = ["Uno due", None, "", "x" * 50_000 + " due", "uno DUE", "é à"]
    got = [r["v"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3).select("i", M.encoding(M.hashed_encoder(32), F.col("t"), 2).alias("v")).orderBy("i").collect()]
    want = M.HashedEncoder(32)([t or "" for t in texts])
    assert got[1] is None and got[2] == [0.0] * 32 and got[0] == got[4]
    for a, b in zip(got, want):
        assert a is None or a == pytest.approx(b.tolist(), abs=1e-6)
    assert np.linalg.norm(got[3]) == pytest.approx(1, abs=1e-6)


def stopping(flag):
    """A model's factory: it stops at a text with a bad word while the file is there."""

    def factory():
        import os

        model = M.HashedEncoder(16)

        def encode(texts):
            if os.path.exists(flag) and any("bad" in t for t in texts):
                raise RuntimeError("model stopped")
            return model(texts)

        return encode

    return factory


def test_backfill_goes_on_where_it_stopped(spark, tmp_path):
    flag = tmp_path / "flag"
    flag.write_text("")
    slot = M.Slot("stopping", stopping(str(flag)))
    store = M.EncodedStore(spark, f"file://{tmp_path}/vectors", slot)
    rows = [(i, f"c{i}", f"text {i}") for i in range(60)] + [(60, "a", "bad"), (61, None, None), (62, "only", None), (None, "a", "b"), (3, "c3", "text 3")]
    slices = {r["id"]: r["slice"] for r in store.texts(spark.createDataFrame(rows, MEMORIES)).collect()}
    table = spark.createDataFrame(rows, MEMORIES)
    assert store.vectors(table).count() == 0
    with pytest.raises(Exception, match="model stopped"):
        store.backfill(table)
    kept = {r["id"] for r in store.stored().collect()}
    assert kept == {i for i, s in slices.items() if s < slices[60]}
    flag.unlink()
    assert store.backfill(table) == 62 - len(kept)  # 60 numbered, the bad one, the one without content
    assert store.backfill(table) == 0
    changed = spark.createDataFrame([r if r[0] != 5 else (5, "c5", "other") for r in rows], MEMORIES)
    assert [r["id"] for r in store.missing(changed).collect()] == [5]
    assert store.backfill(changed) == 1
    got = {r["id"]: r["vector"] for r in store.vectors(changed).collect()}
    assert sorted(got) == sorted([*range(61), 62])
    assert got[5] == pytest.approx(M.HashedEncoder(16)(["c5 other"])[0].tolist(), abs=1e-6)
    assert {r["id"]: r["vector"] for r in store.vectors(table).collect()}[5] == pytest.approx(M.HashedEncoder(16)(["c5 text 5"])[0].tolist(), abs=1e-6)
    assert M.EncodedStore(spark, f"file://{tmp_path}/vectors", M.hashed_encoder(8)).backfill(table) == 62  # another version
    assert store.backfill(spark.createDataFrame([], MEMORIES)) == 0


@pytest.fixture(scope="module")
def tables(spark, sf):
    memories, edges = view(spark, sf, "memories").persist(), view(spark, sf, "edges").persist()
    vectors = view(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).persist()
    yield memories, edges, vectors
    for t in (memories, edges, vectors):
        t.unpersist()


@pytest.fixture(scope="module")
def scorer(tables):
    return M.trained_scorer(M.labelled_pairs(tables[0].where("id % 2 = 0")))


def test_scorer_on_pairs_it_has_not_seen(tables, scorer):
    pairs = M.labelled_pairs(tables[0].where("id % 2 = 1"))
    z = scorer.factory()([q for q, *_ in pairs], [p for _, p, _ in pairs])
    right = np.mean((z > 0) == np.array([k == 1 for *_, k in pairs]))
    assert len(pairs) > 100 and right >= 0.85, right


def test_pair_scores(spark, scorer):
    rows = [(0, "alpha beta", "x: alpha beta gamma"), (1, None, "x"), (2, "alpha", None), (3, "", ""), (4, "!!", "delta"), (5, "zeta", "b: " + "word " * 20_000)]
    got = [r["s"] for r in spark.createDataFrame(rows, "i int, q string, p string").repartition(2).select("i", M.pair_score(scorer, F.col("q"), F.col("p"), 2).alias("s")).orderBy("i").collect()]
    for (_, q, p), s in zip(rows, got):
        want = 0.0 if q is None or p is None else 1 / (1 + np.exp(-scorer.factory()([q], [p])[0]))
        assert s == pytest.approx(want, abs=1e-9)
    assert got[0] > got[5]


ASKED = "the with from that reation haused"


def test_recall_blends_the_scores(tables, scorer):
    memories, edges, vectors = tables
    plain = {r["id"]: r for r in R.recall(memories, edges, None, ASKED, now(), cfg=RecallConfig(limit=200)).collect()}
    got = {r["id"]: r for r in R.recall(memories, edges, None, ASKED, now(), cfg=RecallConfig(limit=200), scorer=scorer).collect()}
    top = max(r["text_match"] for r in plain.values())
    w = max(0.3, min(0.7, 0.3 + 0.4 * (1 - top)))
    superseded = {r["id"] for r in memories.where("superseded_by is not null").collect()}
    assert got and set(got) == set(plain)
    for i, r in got.items():
        s = 1 / (1 + np.exp(-scorer.factory()([ASKED], [f"{r['concept']}: {r['content'][:400]}"])[0]))
        want = ((1 - w) * r["composite"] + w * s) * (0.15 if i in superseded else 1)
        assert r["final"] == pytest.approx(want, abs=1e-9)


def test_clear_winner_is_not_scored(spark):
    rows = [(1, "a", "b", 0.9, 3.0), (2, "a", "c", 0.2, 0.5)]
    pool = spark.createDataFrame(rows, "id long, concept string, content string, text_match double, composite double")

    def refuse():
        raise RuntimeError("the model was asked")

    bad = M.Slot("refuse", refuse)
    assert [r["rerank"] for r in R.reranked(pool, "a", bad, RecallConfig()).collect()] == [0.0, 0.0]
    with pytest.raises(Exception, match="the model was asked"):
        R.reranked(pool, "a", bad, RecallConfig(rerank_skip=False)).collect()


def test_recall_on_an_index_and_many_with_scores(spark, tables, scorer, tmp_path):
    memories, edges, vectors = tables
    cfg = RecallConfig(limit=5)
    path = f"file://{tmp_path}/index"
    R.stored_index(memories, path, cfg, ["en"])
    one = R.recall(memories, edges, None, ASKED, now(), cfg=cfg, agents=["en"], scorer=scorer).collect()
    indexed = R.recall(memories, edges, None, ASKED, now(), cfg=cfg, agents=["en"], scorer=scorer, index=path).collect()
    assert len(one) == 5 and [(r["id"], round(r["final"], 9), r["why"]) for r in indexed] == [(r["id"], round(r["final"], 9), r["why"]) for r in one]
    queries = spark.createDataFrame([(1, "en", ASKED), (2, "de", "der und die")], "query long, agent string, text string")
    many = RM.recall_many(memories, edges, None, queries, now(), cfg, scorer=scorer).where("query = 1").orderBy(F.desc(F.round("final", 9)), "id").collect()
    assert [r["id"] for r in many] == [r["id"] for r in one]
    assert [r["final"] for r in many] == pytest.approx([r["final"] for r in one], abs=1e-9)


def test_words_of_pairs():
    assert M.pair_features("", "a") == [1.0] + [0.0] * 7
    assert M.pair_features("a b", "a b")[1:5] == [1.0, 1.0, 1.0, 1.0] and re.match(r"pairs-", M.trained_scorer([]).version)


def test_expansion_skips_what_is_specific(spark):
    from palimpsest.operators import expansion as E

    rows = [(k, "alpha beta gamma alpha beta delta") for k in range(4)] + [(9, None), (10, "")]
    table = E.associations(spark.createDataFrame(rows, "id long, content string"), least=3)
    got = {(r["term"], r["other"]): r["n"] for r in table.collect()}
    assert all(got[b, a] == n for (a, b), n in got.items()) and ("alpha", "alpha") not in got
    asked = [(1, "gamma"), (2, ""), (3, None), (4, "gamma " * 10), (5, "one two three four five"), (6, "unknown"), (7, "Gamma!")]
    out = {r["id"]: r["expanded"] for r in E.expanded(spark.createDataFrame(asked, "id long, text string"), table).collect()}
    assert out[1].startswith("gamma ") and set(out[1].split()[1:]) == {o for t, o in got if t == "gamma"}
    assert (out[2], out[3], out[4], out[5], out[6]) == ("", None, "gamma " * 10, "one two three four five", "unknown")
    assert E.associations(spark.createDataFrame([], "id long, content string")).count() == 0
