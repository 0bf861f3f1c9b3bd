"""Stateful streams against their batch forms, restarts included."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import windows as W
from palimpsest.sources.cursor import CursorSource, EventLog
from palimpsest.streaming import operators as ST
from palimpsest.streaming import stateful as SF

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
EVENTS = "event_id long, agent string, memory_id long, ts timestamp"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def made(n=300, seed=3, agents=("a", "b", None)):
    r = random.Random(seed)
    return [(i, r.choice(agents), r.choice([1, 2, 3, None]), at(r.randrange(0, 900))) for i in range(n)] + [(7, "a", 1, at(5)), (7, "a", 1, at(5))]


LAST = (10**6, "z", None, at(10**5))  # moves the watermark past all before it


def streamed(spark, tmp_path, rows, apply, parts=1, late="1 hour"):
    """Rows in files of their own, a batch each."""
    src = str(tmp_path / "in")
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], EVENTS).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([LAST], EVENTS).coalesce(1).write.mode("append").parquet(src)
    df = apply(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src), late)
    out = str(tmp_path / "out")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.read.parquet(out).collect()


@pytest.mark.parametrize("parts", [1, 4])
def test_rate_limit_is_exact_in_any_order(spark, tmp_path, parts):
    rows = made()
    random.Random(5).shuffle(rows)
    got = sorted((str(r["agent"]), r["event_id"], r["in_window"], r["limited"]) for r in streamed(spark, tmp_path, rows, lambda s, late: SF.rate_limited(s, 60, 8, late), parts))
    want = sorted((str(r["agent"]), r["event_id"], r["in_window"], r["limited"]) for r in W.rate_limited(spark.createDataFrame(rows, EVENTS), "agent", 60, 8).collect())
    assert got == want


def pairs(rows, seconds, most):
    out = []
    for agent in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == agent), key=lambda r: (r[3], r[0], -1 if r[2] is None else r[2]))
        for j, b in enumerate(own):
            for a in own[max(0, j - most + 1) : j]:
                if a[2] != b[2] and None not in (a[2], b[2]) and (b[3] - a[3]).total_seconds() <= seconds:
                    out.append((str(agent), b[0], a[0]))
    return sorted(out)


@pytest.mark.parametrize("most", [4, 50])
def test_pairs_of_the_last_activations(spark, tmp_path, most):
    rows = made()
    got = sorted((str(r["agent"]), r["event_id"], r["with_event"]) for r in streamed(spark, tmp_path, rows, lambda s, late: SF.recent_pairs(s, 30, most, late), 3))
    assert got and got == pairs(rows, 30, most)


def test_quiet_spells_fire_once(spark, tmp_path):
    rows = [(1, "a", 1, at(0)), (2, "a", 1, at(60)), (3, "a", 1, at(60 + 1800)), (4, "a", 1, at(60 + 1800 + 1799)), (5, "b", 1, at(100)), (6, "b", 1, at(50_000))]
    got = sorted((r["agent"], r["event_id"]) for r in streamed(spark, tmp_path, rows, lambda s, late: SF.quiescent(s, 30, late), 3))
    assert got == [("a", 2), ("a", 4), ("b", 5), ("b", 6)]


def test_quiet_spells_by_a_moving_clock(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    seen = []
    steps = [[(1, "a", 1, at(0)), (2, "b", 1, at(10))], [(3, "a", 1, at(1700))], [(4, "c", 1, at(1900))], [(5, "b", 1, at(9000))], [(6, "c", 1, at(20_000))]]
    for rows in steps:  # a run each: every one goes on where the last stopped
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(src)
        df = SF.quiescent(spark.readStream.schema(EVENTS).parquet(src), 30, "0 seconds")
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        seen.append(sorted((r["agent"], r["event_id"]) for r in spark.read.parquet(out).collect()))
    assert seen == [[], [], [("b", 2)], [("a", 3), ("b", 2), ("c", 4)], [("a", 3), ("b", 2), ("b", 5), ("c", 4)]]


def test_idle_keys_by_the_clock_on_the_wall(spark, tmp_path):
    src = str(tmp_path / "in")
    put = lambda *rows: spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(src)
    put((1, "a", 1, at(5)), (2, "b", 1, at(6)), (3, "a", 1, at(3)))
    df = SF.idle(spark.readStream.schema(EVENTS).parquet(src), 3 / 60)
    q = df.writeStream.format("memory").queryName("idle_keys").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        found = lambda: sorted(r["agent"] for r in spark.table("idle_keys").collect())
        end = time.time() + 60
        while found() != ["a", "b"] and time.time() < end:
            time.sleep(0.5)
        assert found() == ["a", "b"]
        time.sleep(4)
        assert found() == ["a", "b"]  # once a spell
        put((4, "a", 1, at(9)))
        while found() != ["a", "a", "b"] and time.time() < end:
            time.sleep(0.5)
        assert found() == ["a", "a", "b"]
    finally:
        q.stop()


@pytest.mark.parametrize("expression", ["0 3 * * *", "*/7 1-4 * * *", "0 0 1 1 *", "15,45 * * * 0", "5 * * * 7", "* * 31 2 *", "x * * * *", "0 3 * *"])
def test_cron_as_columns(spark, expression):
    minutes = [(T0 + dt.timedelta(minutes=11 * k),) for k in range(2000)]
    df = spark.createDataFrame(minutes, "ts timestamp")
    got = df.select(SF.cron_due(expression, F.col("ts")).alias("due"), F.date_format("ts", "m,H,d,M").alias("f"), (F.dayofweek("ts") - 1).alias("w")).collect()
    assert [r["due"] for r in got] == [ST.cron_matches(expression, *map(int, r["f"].split(",")), r["w"]) for r in got]


def test_ticks_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(at(20 * k),) for k in range(400)], "ts timestamp").repartition(3).write.parquet(src)
    ticks = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    for name, df, want in (("cron_t", SF.cron_ticks(ticks, "*/30 * * * *", "3 hours"), 5), ("timer_t", SF.timer_ticks(ticks, {"stale": 300, "purge": 3600}, "3 hours"), 27 + 3)):
        df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(120)
        rows = spark.table(name).collect()
        assert len(rows) == len(set(rows)) == want


SMALL = "event_id long, agent string, ts timestamp"


def test_cursor_restarts_behind_its_last_batch(spark, tmp_path):
    spark.dataSource.register(CursorSource)
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def more(ids):
        spark.createDataFrame([(i, "ab"[i % 2], at(i)) for i in ids] + [(None, "a", at(0))], SMALL).repartition(2).write.mode("append").parquet(src)

    def run(path, checkpoint, **options):
        df = spark.readStream.format("cursor").schema(SMALL).options(path=src, **options).load()
        q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted((r["event_id"], r["agent"], r["ts"]) for r in spark.read.schema(SMALL).parquet(path).collect())

    kept = lambda ids: spark.createDataFrame([(i, "ab"[i % 2], at(i)) for i in ids], SMALL).orderBy("event_id").collect()
    more(range(1, 40))
    assert run(out, cp) == [tuple(r) for r in kept(range(1, 40))]
    assert len(run(out, cp)) == 39  # nothing new, nothing twice
    more(range(40, 90))
    more([20])  # below the cursor
    assert run(out, cp) == [tuple(r) for r in kept(range(1, 90))]
    assert [r[0] for r in run(out + "2", cp + "2", since_id="50", where_agent="b")] == list(range(51, 90, 2))


def test_event_log_writes_a_batch_once(spark, tmp_path):
    src, cp = str(tmp_path / "in"), str(tmp_path / "cp")
    log = EventLog(spark, str(tmp_path / "log"), most=10)
    assert log.read(SMALL).count() == 0
    spark.createDataFrame([(i, "a", at(i)) for i in range(50)], SMALL).coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(SMALL).parquet(src)
    killed = []

    def torn(batch, number):  # stops between the rows and the ledger, once
        if not killed:
            killed.append(1)
            batch.limit(20).write.parquet(f"{log.folder}/rows/batch={number}")
            raise RuntimeError("killed")
        log.write(batch, number)

    start = lambda f: stream().writeStream.foreachBatch(f).option("checkpointLocation", cp).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        start(torn).awaitTermination(60)
    assert log.read(SMALL).count() == 0  # the torn batch is not seen
    assert start(log.write).awaitTermination(60)
    log.write(spark.createDataFrame([(i, "a", at(i)) for i in range(50)], SMALL), 0)  # replayed whole
    spark.createDataFrame([(i, "b", at(i)) for i in range(50, 60)], SMALL).coalesce(1).write.mode("append").parquet(src)
    q = log.sink(stream(), cp, 1).start()
    end = time.time() + 60
    while log.ledger().count() < 2 and time.time() < end:
        time.sleep(0.5)
    q.stop()
    assert sorted(r["event_id"] for r in log.read(SMALL).collect()) == list(range(60))
    assert sorted((r["batch"], r["n_rows"]) for r in log.ledger().collect()) == [(0, 50), (1, 10)]
    assert spark.read.parquet(f"{log.folder}/rows/batch=0").select(F.input_file_name().alias("f")).groupBy("f").count().where("count > 10").count() == 0
