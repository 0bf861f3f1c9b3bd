"""Faults found in round 4, each on a small input."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.operators import models as MO
from palimpsest.operators import write as WR
from palimpsest.operators.search import K1, B
from palimpsest.plans import catalog
from palimpsest.plans import recall_many as RM
from palimpsest.views import AS_OF, view


def test_f2_every_text_has_a_vector_of_unit_length(spark, tmp_path):
    texts = ["", " ", "!!! ...", "\u00dd.", "\u2603", "word", None, "a b"]  # the letters of the fourth cancel out
    docs = [(10 * i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ours = sorted(map(tuple, catalog.queries()["c1_backfill"](spark, str(tmp_path)).collect()))
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert ours == sorted(c.execute(catalog.oracle_sql()["c1_backfill"]).fetchall()) and len(ours) == 7
    assert not np.any(MO.HashedEncoder(16)([""]))


def test_f1_edges_are_made_once_for_many_recalls(spark, sf):
    memories, edges = view(spark, sf, "memories"), view(spark, sf, "edges").where("src < 200 and dst < 200").coalesce(2)
    n, seen = edges.count(), spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(w):
        seen.add(1)
        return w

    asked = RM.asked_of(memories.where("id in (0, 1)"))
    as_of = F.lit(AS_OF).cast("timestamp")
    got = RM.recall_many(memories, edges.withColumn("weight", counted("weight")), None, asked, as_of).count()
    assert got and n and seen.value == n


def test_f1_blocks_give_the_best_by_bm25(spark):
    """Common and rare terms, copies and ties at the cut, two passes, and memories and queries without terms."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    bag = lambda n: list(dict.fromkeys(words[int(400 * x**3)] for x in rng.random(n)))
    held = [bag(int(rng.integers(1, 80))) for _ in range(300)] + [[]]
    held += held[:40]  # copies
    tf = [rng.integers(1, 4, len(h)).astype(np.int32) if i < 301 else None for i, h in enumerate(held)]
    tf = [tf[i - 301] if t is None else t for i, t in enumerate(tf)]
    size = [int(t.sum()) for t in tf]
    ids = rng.permutation(len(held)) * 3
    asked = [bag(int(rng.integers(1, 60))) for _ in range(40)] + [["w0"], []]
    idf = {w: max(1e-6, float(x)) for w, x in zip(words, rng.normal(1, 1.5, 400))}
    mask = [[int(x) for x in rng.integers(1, 4, len(a))] for a in asked]
    mean = sum(size) / len(size)
    v = pa.table({"id": pa.array(ids), "len": pa.array(size, pa.int32()), "mean": [mean] * len(ids), "v_terms": [" ".join(h) for h in held], "tf": [t.tobytes() for t in tf]})
    q = pa.table({"query": pa.array(range(len(asked)), pa.int64()), "terms": [" ".join(a) for a in asked], "idf": pa.array([[idf[w] for w in a] for a in asked], pa.list_(pa.float64())), "mask": pa.array(mask, pa.list_(pa.int32()))})
    got = {}
    for r in RM._met(7)(None, q, v).to_pylist():
        got.setdefault((r["query"], r["pass"]), []).append((r["id"], round(r["bm25"], 9)))
    want = {}
    for k, a in enumerate(asked):
        for p in (0, 1):
            own = {w for w, m in zip(a, mask[k]) if m >> p & 1}
            score = {int(i): sum(idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * s / mean)) for w, n in zip(h, t.tolist()) if w in own) for i, h, t, s in zip(ids, held, tf, size)}
            best = sorted(((i, round(x, 9)) for i, x in score.items() if x > 0), key=lambda r: (-r[1], r[0]))[:7]
            if best:
                want[k, p] = best
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}


def test_f7_texts_are_split_once_for_the_best_matches(spark, sf):
    memories = view(spark, sf, "memories").coalesce(2)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    writes = memories.where("stage = 'staging'").select(F.col("id").alias("write_id"), "agent", "concept", "content")
    live = memories.where("stage = 'active' and not retracted")
    got = WR.best_text_match(writes, live.withColumn("content", counted("content"))).count()
    assert got and seen.value == live.count()
