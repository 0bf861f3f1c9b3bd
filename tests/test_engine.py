"""Operators that SQL can't express, on small inputs worked out by hand or by brute force."""

import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import vector as V
from palimpsest.operators import consolidate as C
from palimpsest.operators import coordination as K
from palimpsest.operators import search as Q
from palimpsest.operators import windows as W
from palimpsest.operators import write as M
from palimpsest.sources import exchange as X
from palimpsest.streaming import operators as ST

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_coalesced_keeps_by_last_kept(spark):
    times = [0, 4, 9, 10, 12, 19, 20, 31]
    df = spark.createDataFrame([(i, "a", at(s)) for i, s in enumerate(times)] + [(100, "b", at(5))], "event_id long, agent string, ts timestamp")
    kept = {r["event_id"] for r in W.coalesced(df, seconds=10).collect()}
    assert kept == {0, 3, 6, 7, 100}


def test_sessions_split_at_a_whole_gap(spark):
    df = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(3599)), (3, "a", at(7199))], "event_id long, agent string, ts timestamp")
    assert sorted(r["n"] for r in W.sessions(df).collect()) == [1, 2]


def test_write_fold_reads_its_own_writes(spark):
    schema = "id long, agent string, concept string, content string, confidence double, access_count long, created_at timestamp, stage string, retracted boolean, superseded_by long"
    old = spark.createDataFrame([(1, "a", "Known", "x", 0.5, 0, T0, "active", False, None), (2, "a", "weak", "x", 0.2, 0, T0, "active", False, None)], schema)
    new = spark.createDataFrame([(10, "a", "known ", "y", 0.6), (11, "a", "fresh", "z", 0.6), (12, "a", "FRESH", "zz", 0.6), (13, "a", "weak", "w", 0.6)], "write_id long, agent string, concept string, content string, confidence double")
    got = {r["write_id"]: (r["action"], r["target"]) for r in M.folded_writes(old, new).collect()}
    assert got == {10: ("reinforce", 1), 11: ("create", None), 12: ("reinforce", 11), 13: ("supersede", 2)}


def test_write_fold_of_nothing(spark, sf):
    from palimpsest.views import view

    m = view(spark, sf, "memories")
    assert M.folded_writes(m, spark.createDataFrame([], "write_id long, agent string, concept string, content string, confidence double")).count() == 0


def test_clusters_need_every_member_close_enough(spark):
    vec = {1: [1.0, 0.0], 2: [0.9, 0.43589], 3: [0.5, 0.86603], 4: [-1.0, 0.0]}
    memories = spark.createDataFrame([("a", i, 10 - i, "active", False) for i in vec], "agent string, id long, access_count long, stage string, retracted boolean")
    vectors = spark.createDataFrame([("a", i, v) for i, v in vec.items()], "agent string, id long, vector array<double>")
    got = C.clusters(memories, vectors, C.ConsolidationConfig(cluster_similarity=0.65, complete_link=0.6)).collect()
    assert sorted((r["cluster"], r["id"]) for r in got) == [(1, 1), (1, 2)]


def test_similar_pairs_in_blocks(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(40, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([("a", i, x.tolist()) for i, x in enumerate(v)], "agent string, id long, vector array<double>")
    got = {(r["a"], r["b"]) for r in C.similar_pairs(df, 0.3, block=7).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if round(float(v[i] @ v[j]), 6) >= 0.3}


def test_redundant_keeps_the_better(spark):
    m = spark.createDataFrame([("a", 1, 0.9, 9, "active", False), ("a", 2, 0.3, 1, "active", False), ("a", 3, 0.9, 1, "active", False)], "agent string, id long, confidence double, access_count long, stage string, retracted boolean")
    v = spark.createDataFrame([("a", i, [1.0, 0.0]) for i in (1, 2, 3)], "agent string, id long, vector array<double>")
    assert [(r["id"], r["kept"]) for r in C.redundant(m, v).collect()] == [(2, 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.fixed_dictionaries({"a": st.one_of(st.integers(), st.text(max_size=8), st.none(), st.booleans()), "b": st.floats(allow_nan=False, allow_infinity=False)}), min_size=1, max_size=6))
def test_compression_reads_back(rows):
    text = json.dumps(rows, indent=2)
    out, kind = T.compress_json(text, 0)
    if kind == "table":
        assert json.dumps(T._decode(out)) == json.dumps(rows)
    else:
        assert out == text


def test_compression_passes_prose():
    assert T.compress_json("not json") == ("not json", "passthrough")
    assert T.compress_json("3")[1] == "json"


def test_densest_window():
    text = "x" * 300 + " needle and needle " + "y" * 300
    out = T.densest_window(text, ["needle"], 60)
    assert out.count("needle") == 2 and len(out) <= 60 and out.startswith("…") and out.endswith("…")
    assert T.densest_window("short", ["a"], 60) == "short"


def test_merge_content(spark):
    long = T.SEPARATOR.join(["old " * 200, "mid " * 200])
    rows = spark.createDataFrame([("a", "b"), ("ab", "b"), (long, "new"), ("a", None)], "o string, n string")
    got = [r[0] for r in rows.select(T.merge_content(F.col("o"), F.col("n"))).collect()]
    assert got == ["a" + T.SEPARATOR + "b", "ab", M.merged(long, "new"), "a"]
    assert "old" not in got[2] and got[2].endswith("new")


def test_entity_edges_count_common_entities(spark):
    names = lambda i: {"Acme", f"Rare{'abcdefghijklmnopqrstuvwxyz'[i % 26]}"} | ({"Bolt"} if i % 2 else set()) | ({"Core"} if i < 3 else set())
    rows = [(i, "a", "x", ", ".join(sorted(names(i))), "active", False) for i in range(150)] + [(200, "b", "x", "Acme", "active", False), (201, None, "x", "Acme", "active", False)]
    memories = spark.createDataFrame(rows, "id long, agent string, concept string, content string, stage string, retracted boolean")
    want = set()
    for i in range(150):
        k = sorted((-len(names(i) & names(j)), j) for j in range(150) if j != i)
        want |= {(i, j, -n) for n, j in k[:6]}
    assert {(r["src"], r["dst"], r["k"]) for r in M.entity_edges(memories).collect()} == want


@pytest.mark.parametrize("block", [7, 1000])
def test_heaviest_overlaps_by_brute_force(spark, block):
    import random

    rng = random.Random(3)
    own = {i: rng.sample(range(12), rng.randint(0, 5)) for i in range(60)}
    data = spark.createDataFrame([("a", i, t) for i, t in own.items()], "agent string, id long, terms array<long>")
    got = M.heaviest_overlaps(data.withColumn("weights", F.transform("terms", lambda t: (t + 1) / 4)), data, 4, block).collect()
    want = set()
    for i, t in own.items():
        s = sorted((-sum((x + 1) / 4 for x in set(t) & set(u)), j) for j, u in own.items() if j != i)
        want |= {(i, j, -v) for v, j in s[:4] if v}
    assert {(r["query"], r["id"], r["s"]) for r in got} == want


def test_text_match_of_copies(spark):
    memory = "id long, agent string, concept string, content string, retracted boolean"
    rows = [(1, "one", "alpha", "the only memory", False), (2, "two", "beta", "first of two", False), (3, "two", "gamma", "another thing", False)]
    rows += [(10 + i, "half", "copied", "the same text again", False) for i in range(4)] + [(20 + i, "half", f"other{i}", f"words number{i}", False) for i in range(4)]
    copies = [(1, "one", "alpha", "the only memory"), (101, "one", "alpha", "the only memory"), (102, "two", "beta", "first of two"), (103, "two", "gamma", "another thing"), (104, "half", "copied", "the same text again"), (105, "half", "new", "nothing known")]
    got = M.best_text_match(spark.createDataFrame(copies, "write_id long, agent string, concept string, content string"), spark.createDataFrame(rows, memory)).collect()
    assert {r["write_id"]: (r["id"], round(r["score"], 6), r["same_concept"]) for r in got} == {1: (1, 1.0, True), 101: (1, 1.0, True), 102: (2, 1.0, True), 103: (3, 1.0, True), 104: (10, 1.0, True)}


def test_text_match_weighs_by_rarity(spark):
    import math

    rows = [(i, "a", f"c{i}", " ".join(["common"] + ["some"] * (i % 2) + ["rare"] * (i == 4)), False) for i in range(6)]
    writes = spark.createDataFrame([(100, "a", "common", "some rare unknown"), (101, "a", "common", "x")], "write_id long, agent string, concept string, content string")
    got = M.best_text_match(writes, spark.createDataFrame(rows, "id long, agent string, concept string, content string, retracted boolean")).collect()
    idf = {t: math.log(1 + 6 / n) for t, n in (("common", 6), ("some", 3), ("rare", 1))}
    want = {100: (4, round((idf["common"] + idf["rare"]) / sum(idf.values()), 6)), 101: (0, 1.0)}
    assert {r["write_id"]: (r["id"], round(r["score"], 6)) for r in got} == want


def test_text_queries_read_every_text(spark, sf):
    import re

    from palimpsest.plans import catalog
    from palimpsest.views import view

    rows = {r["id"]: r["content"] for r in view(spark, sf, "memories").select("id", "content").collect()}
    assert any(not t.isascii() for t in rows.values())
    name, action = re.compile(r"\b([A-Z][a-z]{2,}(?:[ \t\n\x0b\f\r]+[A-Z][a-z]+)*)\b"), re.compile(T.ACTION_WORDS)
    entities = {i: len({x for x in name.findall(t) if len(x) <= 40 and x not in T.ENTITY_STOPWORDS}) for i, t in rows.items()}
    assert {r["id"]: r["n"] for r in catalog.queries()["tx11_entities_all"](spark, sf).collect()} == entities
    accepted = {i: len(t.strip(" ")) >= 20 and bool(action.search(t)) for i, t in rows.items()}
    assert {r["id"]: r["accepted"] for r in catalog.queries()["tx16_completion_gate_all"](spark, sf).collect()} == accepted


def test_whole_inputs(spark, sf):
    from palimpsest.plans import catalog
    from palimpsest.views import AS_OF, view

    q = catalog.queries()
    assert q["m3_write_fold"](spark, sf).count() == view(spark, sf, "memories").count()
    got = {r["id"]: (r["score"], r["action"]) for r in q["m16_sweep_all"](spark, sf).collect()}
    old = {r["id"]: r["old"] for r in view(spark, sf, "memories").select("id", (F.lit(AS_OF).cast("timestamp") - F.col("created_at").cast("timestamp") > F.expr("interval 1 day")).alias("old")).collect()}
    assert got and all(a == ("promoted" if s >= 0.6 else "discarded" if old[i] else "kept") for i, (s, a) in got.items())
    assert any(s not in (0.0, 0.7) for s, _ in got.values())
    counts = q["a5_staging_outcomes_all"](spark, sf).first()
    assert [counts["promoted"], counts["discarded"]] == [sum(a == k for _, a in got.values()) for k in ("promoted", "discarded")]


def test_delete_reads_every_edge(spark, sf):
    from palimpsest.plans import catalog
    from palimpsest.views import view

    ends = {x for r in view(spark, sf, "edges").select("src", "dst").collect() for x in r}
    gone = {r["id"] for r in catalog.queries()["c10_delete"](spark, sf).collect()}
    some = C.deleted(view(spark, sf, "memories"), view(spark, sf, "edges").where("src > 900"), catalog.now(), C.ConsolidationConfig(delete_days=10))
    cut = {r["id"] for r in some.collect()}
    assert not gone & ends and gone == cut - ends and cut & ends


def test_merge_query_appends_and_drops(spark, sf):
    from palimpsest.plans import catalog
    from palimpsest.views import view

    rows = {r["id"]: (r["concept"], r["content"]) for r in view(spark, sf, "memories").select("id", "concept", "content").collect()}
    want = {i: M.merged(t, rows[i + 1][0] if i + 1 in rows else "") for i, (_, t) in rows.items()}
    got = {r["id"]: r["content"] for r in catalog.queries()["tx17_merge_content_all"](spark, sf).collect()}
    assert got == want
    assert any(T.SEPARATOR in t for t in got.values()) and any(len(rows[i][1]) > M.CONTENT_LIMIT and got[i] == rows[i + 1][0].strip(" ") for i in got if i + 1 in rows)


def test_recall_expands_pronouns(spark, sf):
    from palimpsest.config import RecallConfig
    from palimpsest.operators import search as Q
    from palimpsest.plans import recall as R
    from palimpsest.views import view

    rows = [(1, "a", "Zanzibar", "zanzibar trip notes", ["zanzibar", "session-1", "low-x", "D1", "ab"], 9), (2, "a", "other", "was it booked", ["misc"], 1), (3, "b", "far", "elsewhere", ["elsewhere"], 99)]
    rows += [(10 + i, "a", f"filler{i}", f"words{i}", None, 0) for i in range(8)]
    m = spark.createDataFrame(rows, "id long, agent string, concept string, content string, tags array<string>, access_count long").withColumns({"stage": F.lit("active"), "retracted": F.lit(False)})
    scope = m.where("agent = 'a'")
    assert R.expanded_query(scope, "was it booked") == "was it booked zanzibar misc" and R.expanded_query(scope, "booked") == "booked"
    got = {r["id"]: r["score"] for r in R.text_hits(scope, scope, "was it booked", 30).collect()}
    passes = [{r["id"]: r["score"] for r in Q.bm25(scope, q, 30).collect()} for q in ("booked", "was it booked zanzibar misc")]
    assert got == {i: max(p.get(i, 0) for p in passes) for i in passes[0] | passes[1]} and 1 in got
    full = view(spark, sf, "memories").where("id < 40")
    marked = full.withColumn("content", F.when(F.col("id") == 5, "quokka").otherwise("plain")).withColumn("concept", F.concat(F.lit("c"), F.col("id"))).withColumn("tags", F.when(F.col("id") == 20, F.array(F.lit("quokka"))))
    found = R.recall(marked, view(spark, sf, "edges"), None, "what was that", F.lit("2024-02-01").cast("timestamp"), cfg=RecallConfig(min_score=0.0, include_stages=("active",))).collect()
    assert 5 in {r["id"] for r in found}


def test_rerank_blend_and_skip(spark):
    from palimpsest.config import RecallConfig
    from palimpsest.plans import recall as R

    def run(rows, **kw):
        pool = spark.createDataFrame(rows, "id long, composite double, text_match double, rr double")
        return {r["id"]: (r["reranker"], r["final"]) for r in R.blended(pool, "rr", RecallConfig(**kw)).collect()}

    clear = [(1, 0.9, 0.8, 0.1), (2, 0.6, 0.2, 0.9)]
    assert run(clear) == {1: (0.0, 0.9), 2: (0.0, 0.6)}
    assert run(clear, rerank_skip=False) == {1: (0.1, pytest.approx(0.62 * 0.9 + 0.38 * 0.1)), 2: (0.9, pytest.approx(0.62 * 0.6 + 0.38 * 0.9))}
    for kept in ([(1, 0.9, 0.79, 0.1), clear[1]], [(1, 0.89, 0.8, 0.1), clear[1]], clear[:1], [*clear, *((i, 0.1, 0.0, 0.0) for i in range(3, 22))]):
        assert run(kept)[1][0] == 0.1
    assert run([*clear, *((i, 0.1, 0.0, 0.0) for i in range(3, 22))], limit=11)[1][0] == 0.0
    assert run([]) == {}


def test_gate_margin_is_of_reranker_scores(spark):
    from palimpsest.config import RecallConfig
    from palimpsest.plans import recall as R

    rows = [(i, f, 0.9, 0.5, r, 0.9) for i, f, r in [(1, 0.9, 0.5), (2, 0.8, 0.6), (3, 0.7, 0.9), (4, 0.6, 0.1)]]
    pool = spark.createDataFrame(rows, "id long, final double, score double, vector_match double, reranker double, similarity double")
    got = {r["id"]: r["final"] for r in R.gated(pool, RecallConfig(weak_pool_penalty=True)).collect()}
    assert got == {1: 0.9, 2: 0.8, 3: 0.7, 4: 0.6}  # 0.9 - 0.6, in whatever order the rows stand
    thin = pool.withColumn("reranker", F.lit(0.5))
    assert {r["id"]: r["final"] for r in R.gated(thin, RecallConfig(weak_pool_penalty=True)).collect()} == {i: pytest.approx(0.4 * f) for i, f in got.items()}
    far = pool.withColumn("similarity", F.lit(0.3))
    assert R.gated(far, RecallConfig()).count() == 4  # three channels agree
    alone = far.withColumn("reranker", F.lit(0.0)).withColumn("vector_match", F.lit(0.0))
    assert R.gated(alone, RecallConfig()).count() == 0
    assert R.gated(alone.withColumn("similarity", F.lit(None).cast("double")), RecallConfig()).count() == 4
    assert R.gated(pool.withColumn("score", F.lit(None).cast("double")), RecallConfig()).count() == 4
    two = far.withColumn("vector_match", F.lit(0.0))
    assert R.gated(two, RecallConfig()).count() == 4 and R.gated(two, RecallConfig(abstain=0.1)).count() == 0


def test_auto_tags_order(spark):
    r = spark.createDataFrame([("Work", "I like the Python code at Acme Corp")], "c string, t string").select(T.auto_tags(F.col("c"), F.col("t")).alias("x")).first()["x"]
    assert r[0] == "cat:personal" and "cat:tech" in r and "entity:Acme Corp" in r and r[-1] == "cat:preference"


def test_detectors(spark):
    rows = ["Robert said do it", "Roberta said do it", "Completed event 12345 on 2024-01-01", "File read completed", None]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(T.is_feedback(F.col("t"), ("Robert", "Ann")), T.is_verified_record(F.col("t")), T.is_routine(F.col("t"))).collect()
    assert [tuple(g) for g in got] == [(True, False, False), (False, False, False), (False, True, False), (False, False, True), (False, False, False)]


def test_hashed_embedding_is_unit(spark):
    v = spark.createDataFrame([("a b c a",), ("",)], "t string").select(V.hashed_embedding(F.col("t"), 16).alias("v")).collect()
    assert sum(x * x for x in v[0]["v"]) == pytest.approx(1, abs=1e-5) and not any(v[1]["v"])


def test_snapshots(spark, tmp_path):
    store = X.SnapshotStore(spark, str(tmp_path / "s"), keep=2)
    for k in range(4):
        store.save("m", spark.range(k + 1), key="id")
    assert store.load("m").count() == 4 and store.load("m", 3).count() == 3
    with pytest.raises(ValueError):
        store.save("m", spark.createDataFrame([(1,), (1,)], "id long"), key="id")


def test_import_remaps_ids(spark, sf):
    from palimpsest.views import view

    m, e = view(spark, sf, "memories"), view(spark, sf, "edges")
    rows, edges = X.imported(m.where("agent = 'fr'"), m.where("agent = 'en'"), e, agent="new")
    ids = [r["id"] for r in rows.select("id").collect()]
    top = m.where("agent = 'fr'").agg(F.max("id")).first()[0]
    assert len(set(ids)) == len(ids) and min(ids) > top and rows.where("agent != 'new'").count() == 0
    ends = {r["src"] for r in edges.select("src").collect()} | {r["dst"] for r in edges.select("dst").collect()}
    assert ends <= set(ids)


def test_json_export(spark, sf, tmp_path):
    from palimpsest.views import view

    X.export_json(view(spark, sf, "memories"), view(spark, sf, "edges"), str(tmp_path / "out"), agent="en")
    assert spark.read.json(str(tmp_path / "out/memories")).count() == view(spark, sf, "memories").where("agent = 'en' and not retracted").count()


def run_stream(spark, df, mode="append"):
    name = f"s{abs(hash(str(df))) % 10**8}"
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name).collect()


@pytest.fixture()
def stream(spark, tmp_path):
    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        df.coalesce(1).write.parquet(str(tmp_path / f"in{len(list(tmp_path.iterdir()))}"))
        path = str(tmp_path / f"in{len(list(tmp_path.iterdir())) - 1}")
        return spark.readStream.schema(df.schema).parquet(path)

    return make


EVENTS = "event_id long, agent string, memory_id long, ts timestamp, event_type string, useful boolean"


def event(i, s, agent="a", memory=1, kind="view", useful=True):
    return (i, agent, memory, at(s), kind, useful)


def test_stream_sessions_like_batch(spark, stream):
    rows = [event(1, 0), event(2, 3599), event(3, 7199), event(4, 10**6)]
    got = run_stream(spark, ST.sessions(stream(rows, EVENTS)))
    assert sorted(r["n"] for r in got)[:2] == [1, 2]


def test_stream_coalesced_like_batch(spark, stream):
    rows = [event(i, s) for i, s in enumerate([0, 4, 9, 10, 12, 19, 20, 31])]
    got = {r["event_id"] for r in run_stream(spark, ST.coalesced(stream(rows, EVENTS)))}
    batch = {r["event_id"] for r in W.coalesced(spark.createDataFrame(rows, EVENTS), seconds=10).collect()}
    assert got == batch


def test_stream_feedback_join(spark, stream):
    a, f = [event(1, 0), event(2, 100)], [event(10, 59), event(11, 161)]
    got = run_stream(spark, ST.confirmed_feedback(stream(f, EVENTS), stream(a, EVENTS)))
    assert [(r["feedback_id"], r["activation_id"]) for r in got] == [(10, 1)]


def test_stream_counters(spark, stream):
    got = run_stream(spark, ST.checkpoint_counters(stream([event(1, 0), event(2, 1, kind="purchase"), event(3, 2)], EVENTS)), "complete")
    assert (got[0]["recalls"], got[0]["writes"]) == (2, 1)


@pytest.mark.parametrize(
    ("expression", "want"),
    [("0 3 * * *", True), ("1 3 * * *", False), ("*/5 3 * * *", True), ("0 1-4 * * *", True), ("0 3 1 1 1", True), ("0 3 2 * 1", False), ("0 3 * * 7", False), ("0 3 * *", False), ("0 3,5 * * *", True)],
)
def test_cron(expression, want):
    assert ST.cron_matches(expression, 0, 3, 1, 1, 1) is want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_breaker_by_hand(spark):
    """Threshold 2, cooldown 30 s: later failures keep the time of opening, one in half_open opens anew."""
    calls = [(0, False), (10, False), (20, False), (30, False), (40, False), (41, False), (50, False), (72, False), (73, True), (74, False), (75, False), (106, True), (107, True)]
    want = ["closed", "closed", "open", "open", "open", "half_open", "open", "half_open", "open", "closed", "closed", "half_open", "closed"]
    rows = [("a", k, t, ok) for k, (t, ok) in enumerate(calls)] + [("b", 100, 50, False)]
    df = spark.createDataFrame(rows, "agent string, event_id long, t long, ok boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["event_id"]: r["state"] for r in W.breaker_states(df, 2, 30).collect()}
    assert [got[k] for k in range(len(calls))] == want and got[100] == "closed"


def test_dispatch_by_hand(spark):
    tasks = spark.createDataFrame(
        [(1, 7, None, "pending", 1, 5, None), (2, None, "x", "pending", 9, 5, None), (3, None, None, "pending", 9, 4, None), (4, None, "x", "pending", 9, 1, 2), (5, None, "y", "pending", 1, 1, None), (6, None, None, "completed", 99, 0, None), (7, 7, None, "pending", 1, 4, None)],
        "id int, agent int, workspace string, status string, priority int, created_at int, blocked_by int")
    agents = spark.createDataFrame([(7, "x"), (8, "x"), (9, "y"), (10, None)], "id int, workspace string")
    assert {r["agent"]: r["id"] for r in K.next_for_agents(tasks, agents).collect()} == {7: 7, 8: 3, 9: 3, 10: 3}
    assert {r["agent"]: r["id"] for r in K.next_for_agents(tasks.where("id != 3"), agents).collect()} == {7: 7, 8: 2, 9: 5}


def test_stored_index_reads_only_the_asked_terms(spark, tmp_path):
    rows = [(i, f"concept {i % 3}", " ".join(f"w{(i * k) % 11}" for k in range(5)), ["kind=x", f"topic=t{i % 2}"]) for i in range(40)]
    m = spark.createDataFrame(rows, "id long, concept string, content string, tags array<string>")
    Q.store_index(m, str(tmp_path / "index"), buckets=8)
    for query in ("w3 w7 topic", "t1", "nothing here", "", "!"):
        ours = [(r["id"], round(r["bm25"], 9)) for r in Q.indexed_bm25(spark, str(tmp_path / "index"), query).collect()]
        assert sorted(ours) == sorted((r["id"], round(r["bm25"], 9)) for r in Q.bm25(m, query).collect()), query
    plan = Q.indexed_bm25(spark, str(tmp_path / "index"), "w3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,w3)" in plan
