"""Table migration: types, interruption, digests, refusals."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import migrate as MG


def blob(*xs):
    return bytearray(struct.pack(f"<{len(xs)}f", *xs))


def source(spark, n=40):
    rows = [(i, "a" if i % 2 else "b", i % 2 if i % 5 else None, blob(i, 0.5) if i % 3 else None, '["x","y%d"]' % i if i % 4 else None, None if i % 7 else "staging", "2024-01-02T03:04:05Z") for i in range(n)]
    memories = spark.createDataFrame(rows, "id long, agent string, retracted int, vector binary, tags string, stage string, created_at string")
    edges = spark.createDataFrame([(i, i + 1, "hebbian", 0.5, None) for i in range(n)], "src long, dst long, type string, weight double, activation_count long")
    agents = spark.createDataFrame([(f"agent {i}", None, 1_700_000_000_000 + i) for i in range(9)], "id string, config string, created_at long")
    activations = spark.createDataFrame([(i, "[1,2]") for i in range(5)], "event_id long, memory_ids string")
    staging = spark.createDataFrame([(1, "promoted"), (1, "promoted"), (None, "kept")], "memory_id long, action string")
    feedback = spark.createDataFrame([(i, 1) for i in range(3)], "event_id long, useful int")
    return {"memories": memories, "edges": edges, "agents": agents, "activations": activations, "staging_events": staging, "feedback": feedback}


def content(m, tables):
    return {t: sorted(map(repr, m.load(t).select(*sorted(m.load(t).columns)).drop("__chunk").collect())) for t in tables}


def test_types_and_rows(spark, tmp_path):
    src = source(spark)
    m = MG.Migration(spark, str(tmp_path / "m"), src, rows_per_chunk=7, at_once=2)
    assert m.planned()["episodes"] is None and m.planned()["memories"] == 40
    report = {r["table"]: r for r in m.run().collect()}
    assert {t: r["n_rows"] for t, r in report.items()} == {t: df.count() for t, df in src.items()}
    assert report["memories"]["chunks"] == 6 and report["agents"]["chunks"] == 2
    got = {r["id"]: r for r in m.load("memories").collect()}
    for i in range(40):
        assert got[i]["retracted"] is bool(i % 2 and i % 5)
        assert got[i]["vector"] == ([float(i), 0.5] if i % 3 else None)
        assert got[i]["tags"] == (["x", f"y{i}"] if i % 4 else None)
        assert got[i]["stage"] == ("active" if i % 7 else "staging")
    assert m.load("memories").select(F.unix_seconds("created_at")).first()[0] == int(dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc).timestamp())
    assert {r["config"] for r in m.load("agents").collect()} == {"{}"}
    assert sorted((r["memory_id"], r["action"]) for r in m.load("staging_events").where("memory_id = 1").collect()) == [(1, "promoted")] * 2
    assert m.load("staging_events").where("memory_id is null").count() == 1
    assert m.load("edges").agg(F.sum("activation_count")).first()[0] == 0


FEW = {t: MG.TABLES[t] for t in ("memories", "agents")}


@pytest.mark.parametrize("after", [0, 1, 3])
def test_broken_off_and_resumed(spark, tmp_path, monkeypatch, after):
    src = {t: source(spark)[t] for t in FEW}
    whole = MG.Migration(spark, str(tmp_path / "whole"), src, FEW, rows_per_chunk=14, at_once=4)
    whole.run()
    part = MG.Migration(spark, str(tmp_path / "part"), src, FEW, rows_per_chunk=14, at_once=1)
    record, n = MG.Migration._record, []

    def dying(self, rows):
        if len(n) == after:
            raise KeyboardInterrupt
        n.append(1)
        record(self, rows)

    monkeypatch.setattr(MG.Migration, "_record", dying)
    with pytest.raises(KeyboardInterrupt):
        part.run()
    monkeypatch.setattr(MG.Migration, "_record", record)
    if after == 1:  # one of three chunks is there
        with pytest.raises(ValueError, match="1 of 3 chunks"):
            part.load("memories")
    copied = {(r["table"], r["chunk"]): r["path"] for r in part.ledger().collect()}
    part.run()
    later = {(r["table"], r["chunk"]): r["path"] for r in part.ledger().collect()}
    assert copied.items() <= later.items()  # what was copied is not copied again
    assert content(part, src) == content(whole, src)
    before = part.ledger().count()
    part.run()
    assert part.ledger().count() == before


def test_a_changed_copy_is_refused(spark, tmp_path, monkeypatch):
    src = source(spark)
    m = MG.Migration(spark, str(tmp_path / "m"), src, FEW)
    real, calls = MG.digest, []

    def lossy(df, by, columns):
        calls.append(1)
        return real(df.where("id != 5") if len(calls) == 1 else df, by, columns)

    monkeypatch.setattr(MG, "digest", lossy)
    with pytest.raises(ValueError, match="differs"):
        m.run()
    assert m.ledger().count() == 0


def test_refusals(spark, tmp_path):
    src = source(spark)
    twice = src | {"memories": src["memories"].union(src["memories"].where("id = 3"))}
    with pytest.raises(ValueError, match="not unique"):
        MG.Migration(spark, str(tmp_path / "twice"), twice, FEW).run()
    torn = src | {"memories": src["memories"].withColumn("vector", F.when(F.col("id") == 4, F.lit(bytearray(b"abc"))).otherwise(F.col("vector")))}
    with pytest.raises(ValueError, match="1 values"):
        MG.Migration(spark, str(tmp_path / "torn"), torn, FEW).run()
    m = MG.Migration(spark, str(tmp_path / "lenient"), torn, FEW)
    assert {r["table"]: r["unreadable"] for r in m.run(strict=False).collect()}["memories"] == 1
    with pytest.raises(ValueError, match="no such table"):
        MG.Migration(spark, str(tmp_path / "none"), {}).run()


def test_ranges_reach_the_scan(spark, tmp_path):
    src = source(spark)
    path = str(tmp_path / "memories")
    src["memories"].write.parquet(path)
    part = MG.Migration._part(spark.read.parquet(path), "id", 1, 2, 4, [10, 20, 30])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,10)" in plan and "LessThan(id,30)" in plan
    assert sorted((r["id"], r["__chunk"]) for r in part.select("id", "__chunk").collect()) == [(i, 1 if i < 20 else 2) for i in range(10, 30)]


def test_empty_tables(spark, tmp_path):
    src = {t: df.limit(0) for t, df in source(spark).items()}
    m = MG.Migration(spark, str(tmp_path / "m"), src)
    assert {r["n_rows"] for r in m.run().collect()} == {0}
    assert m.load("memories").count() == 0 and dict(m.load("memories").dtypes)["retracted"] == "boolean"
