"""Retrieval for many queries at once against one at a time."""

import pytest
from pyspark.sql import functions as F

from palimpsest.config import RecallConfig
from palimpsest.operators import search as Q
from palimpsest.plans import recall as R
from palimpsest.plans import recall_many as M
from palimpsest.sources.shared import Scratch
from palimpsest.views import AS_OF, view



def now():
    return F.lit(AS_OF).cast("timestamp")


@pytest.fixture(scope="module")
def tables(spark, sf):
    memories, edges = view(spark, sf, "memories").persist(), view(spark, sf, "edges").persist()
    vectors = view(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).persist()
    yield memories, edges, vectors
    for t in (memories, edges, vectors):
        t.unpersist()


def compared(got, want):
    assert [r["id"] for r in got] == [r["id"] for r in want]
    for a, b in zip(got, want):
        for c in ("final", "text_match", "vector_match", "decay", "hebbian", "graph_boost", "composite", "recall_confidence"):
            assert a[c] == pytest.approx(b[c], abs=1e-9), (a["id"], c)
        assert a["why"] == b["why"]


@pytest.mark.parametrize("cfg", [RecallConfig(limit=5), RecallConfig(limit=3, mode="auto", min_score=0.3, query_bridge=True)])
def test_same_as_one_at_a_time(spark, tables, cfg):
    memories, edges, vectors = tables
    own = memories.where("stage = 'active'").orderBy("id").limit(2 if cfg.mode == "balanced" else 1).collect()
    texts = [(r["id"], r["agent"], f"{r['concept']} {r['content']}") for r in own]
    texts += [(900, "en", "the with from that reation haused"), (901, "de", "Is it der With NICHT-12"), (902, "fr", "!! ..")]
    queries = spark.createDataFrame(texts, "query long, agent string, text string").withColumn("id", F.col("query")).join(vectors, "id", "left").drop("id")
    asked = {r["query"]: r for r in queries.collect()}
    got = {}
    for r in M.recall_many(memories, edges, vectors, queries, now(), cfg).orderBy("query", F.desc(F.round("final", 9)), "id").collect():
        got.setdefault(r["query"], []).append(r)
    some = 0
    for q, agent, text in texts:
        vector = asked[q]["vector"]
        want = R.recall(memories, edges, vectors if vector is not None else None, text, now(), vector, cfg, agents=[agent]).collect()
        compared(got.get(q, []), want)
        some += bool(want)
    assert some >= 2


def test_search_many_is_bm25(spark, tables, tmp_path):
    memories = tables[0].where("not retracted").withColumn("scope", F.lit(""))
    path = f"file://{tmp_path}/index"
    M.store_index(memories, path, 8)
    rows = [(1, "the with from that reation haused"), (2, "the"), (3, "zzz"), (4, "and of the in to is"), (5, memories.orderBy("id").first()["content"])]
    asked = spark.createDataFrame(rows, "query long, text string").select("query", F.lit("").alias("scope"), F.lit(0).alias("pass"), F.explode(M._terms(F.col("text"))).alias("term"))
    with Scratch(spark) as scratch:
        got = {}
        for r in M.search_many(spark, path, asked, 10, scratch).collect():
            got.setdefault(r["query"], {})[r["id"]] = r["score"]
    for q, text in rows:
        want = {r["id"]: r["score"] for r in Q.bm25(memories, text, 10).collect()}
        assert got.get(q, {}) == pytest.approx(want, abs=1e-9), q


def test_nothing_asked_nothing_found(spark, tables):
    memories, edges, vectors = tables
    none = spark.createDataFrame([(1, "en", None), (None, "en", "the"), (2, None, "the"), (3, "xx", "the")], "query long, agent string, text string")
    assert M.recall_many(memories, edges, None, none, now()).count() == 0
    assert M.recall_many(memories.limit(0), edges, None, none, now()).count() == 0


def test_discovery_and_sweep_by_recall(spark, tables):
    memories, edges, _ = tables
    few = memories.where("id % 20 = 0")
    links = M.discovered_links(memories, edges, None, few, now(), least=0.4).collect()
    pairs = {(r["src"], r["dst"]): r["weight"] for r in links}
    known = {(r["src"], r["dst"]) for r in edges.select("src", "dst").collect()}
    assert pairs and all((b, a) in pairs and pairs[b, a] == w and w >= 0.4 for (a, b), w in pairs.items())
    assert not any((a, b) in known or (b, a) in known for a, b in pairs)
    expired = memories.where("stage = 'staging'")
    swept = {r["id"]: r for r in M.swept_staging(memories, edges, None, expired, now()).collect()}
    assert set(swept) == {r["id"] for r in expired.select("id").collect()}
    for r in expired.orderBy("id").limit(3).collect():
        want = R.recall(memories, edges, None, f"{r['concept']} {r['content']}", now(), cfg=RecallConfig(limit=3, min_score=0.3), agents=[r["agent"]]).collect()
        assert swept[r["id"]]["action"] == ("promoted" if want else "discarded")
        assert swept[r["id"]]["score"] == pytest.approx(want[0]["final"] if want else 0.0, abs=1e-9)


def test_confidence_required(spark, tables):
    memories, edges, vectors = tables
    vector = vectors.where("id = 0").first()["vector"]
    run = lambda need: R.recall(memories, edges, vectors, "the with from that reation haused", now(), vector, RecallConfig(require_confidence=need)).collect()
    every = run(0.0)
    sure = every[0]["recall_confidence"]
    assert 0 < sure < 1 and {r["recall_confidence"] for r in every} == {sure}
    assert len(run(sure - 1e-6)) == len(every) and run(sure + 1e-6) == []


def test_entities_of_a_query(spark):
    rows = [(1, ["entity:Marcus Lee", "x"], 0.5), (2, ["marcus"], 0.5), (3, ["entity:the"], 0.9), (4, ["entity:marcus", "MARCUS lee"], 0.3), (5, ["marcus"], 0.05), (6, None, 0.5), (7, ["marcuslee"], 0.5)]
    pool = spark.createDataFrame(rows, "id long, tags array<string>, text_match double")
    got = {r["id"]: r["boost"] for r in R.entity_bridged(pool, "What did Marcus tell The team").collect()}
    assert got == {1: pytest.approx(0.2), 2: pytest.approx(0.2), 4: pytest.approx(0.24)}
    assert R.entity_bridged(pool, "The or And or marcus").count() == 0
