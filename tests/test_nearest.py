"""Exact and inverted-file vector search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import nearest as N


def unit(rng, n, d):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, v, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in row]) for i, row in zip(ids if ids is not None else range(len(v)), v)], "id long, vector array<float>")


def by_hand(q, itself, v, ids, most):
    out = set()
    for k, (x, me) in enumerate(zip(q, itself)):
        sim = np.clip(v.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float), -1, 1)
        order = sorted((-np.rint(s * 1e5), i) for s, i in zip(sim, ids) if i != me)[:most]
        out |= {(k, r + 1, i) for r, (_, i) in enumerate(order)}
    return out


@pytest.mark.parametrize("block", [16_384, 50])
def test_exact(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "QUERIES", 7)
    rng = np.random.default_rng(1)
    v = unit(rng, 300, 8)
    v[200:260] = v[0]  # ties
    ids = rng.permutation(1000)[:300]
    q = [(k, int(ids[k]), [float(x) for x in v[k]]) for k in range(20)]
    queries = spark.createDataFrame(q, "query long, self long, vector array<float>")
    got = {(r["query"], r["rank"], r["id"]) for r in N.exact(queries, table(spark, v, ids), 9).collect()}
    assert got == by_hand(v[:20], ids[:20], v, ids, 9)


def test_own_list_only(spark):
    v = table(spark, np.eye(4)).withColumn("list", F.when(F.col("id") < 2, "a").otherwise("b"))
    q = v.where("id in (0, 3)").select(F.col("id").alias("query"), "vector", "list")
    assert sorted((r["query"], r["id"]) for r in N.exact(q, v, 5).collect()) == [(0, 0), (0, 1), (3, 2), (3, 3)]
    assert [(r["query"], r["id"]) for r in N.exact(q, v, 5, floor=0.5).orderBy("query").collect()] == [(0, 0), (3, 3)]


def test_awkward_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (None, [1.0, 0.0]), (4, [0.0, 1.0]), (4, [0.0, 1.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None), (None, [1.0, 0.0])], "query long, vector array<float>")
    assert [(r["query"], r["rank"], r["id"]) for r in N.exact(q, rows, 3).orderBy("query", "rank").collect()] == [(9, 1, 1), (9, 2, 4), (9, 3, 4)]
    N.store_lists(rows, f"file://{tmp_path}/few", lists=2)
    assert [(r["rank"], r["id"]) for r in N.probed(spark, f"file://{tmp_path}/few", q, 3, probes=9).orderBy("rank").collect()] == [(1, 1), (2, 4), (3, 4)]
    assert N.exact(q, rows.limit(0), 3).count() == 0
    N.store_lists(rows.limit(0), f"file://{tmp_path}/none")
    assert N.probed(spark, f"file://{tmp_path}/none", q).count() == 0


def test_recall_and_folders_read(spark, tmp_path):
    rng = np.random.default_rng(2)
    centre = unit(rng, 60, 16)
    v = centre[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 16)) * 0.12
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vectors, path = table(spark, v).repartition(3), f"file://{tmp_path}/lists"
    probes = N.store_lists(vectors, path, lists=50)
    assert 1 <= probes < 25
    queries = vectors.where("id % 100 = 0").select(F.col("id").alias("query"), F.col("id").alias("self"), "vector")
    truth = N.exact(queries, vectors).persist()
    one = N.recall_against(N.probed(spark, path, queries), truth).first()
    assert one["n"] == 400 and one["recall"] >= 0.9
    assert N.recall_against(N.probed(spark, path, queries, probes=50), truth).first()["recall"] == 1.0
    # every vector is indexed, once
    assert spark.read.parquet(f"{path}/vectors").count() == 4000
    # what is not probed is not read: it may be no Parquet at all
    one = queries.where("query = 100")
    want = N.probed(spark, path, one, probes=2).collect()
    centroids = np.array([r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])
    near = set(np.argsort(-(centroids @ np.array(one.first()["vector"], float)), kind="stable")[:2].tolist())
    folders = list((tmp_path / "lists" / "vectors").glob("list=*"))
    assert len(folders) > 30
    for folder in folders:
        if int(folder.name.split("=")[1]) not in near:
            for f in [*folder.glob(".*.crc"), *folder.glob("*.parquet")]:
                f.unlink() if f.suffix == ".crc" else f.write_bytes(b"none")
    assert N.probed(spark, path, one, probes=2).collect() == want and len(want) == 10
