"""Streams give what the batch forms give: files arrive one by one, a last row far ahead moves the watermark."""

from datetime import datetime, timedelta

import pytest

from weirstream.engine import Engine

BASE = datetime(2025, 3, 10, 13, 0, 0)
SCHEMA = "name string, ts timestamp, value int, n long"


def run(spark, tmp_path, rows, ops, timed=True):
    folder = tmp_path / "in"
    rows = [("a", BASE + timedelta(seconds=s), v) for s, v in rows]
    last = [("zz", BASE + timedelta(days=9 + i), 0) for i in range(2)] if timed else []
    for i, r in enumerate([*rows, *last]):
        spark.createDataFrame([(*r, i)], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))
    e = Engine(spark)
    e.register("t", df.withWatermark("ts", "3 seconds"), seq="n")
    out = e.execute(f"PRINT FROM t KEY BY WITH('fields'='name') {ops}").visible()
    q = out.writeStream.format("memory").queryName("out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    return [r for r in spark.table("out").collect() if r.asDict().get("name") != "zz"]


def test_watch_changed(spark, tmp_path):
    got = run(spark, tmp_path, [(i, v) for i, v in enumerate((1, 1, 2, 1))], "PROCESS WITH('identity'='field_value_watch_changed_emitter', 'eventtime'='ts', 'watch.field'='value')")
    assert [r.value for r in sorted(got, key=lambda r: r.ts)] == [1, 2, 1]


def test_disorder(spark, tmp_path):
    got = run(spark, tmp_path, [(s, s) for s in (0, 2, 4, 3, 11, 1)], "PROCESS WITH('identity'='disorder_discard', 'eventtime'='ts')")
    assert [r.value for r in got] == [0, 2, 3, 4, 11]


def test_deduplicate(spark, tmp_path):
    got = run(spark, tmp_path, [(1, 1), (2, 2), (30, 3), (32, 4)], "PROCESS WITH('identity'='deduplicate', 'eventtime'='ts', 'table.exec.state.ttl'='10 s')")
    assert sorted(r.value for r in got) == [1, 3]


def test_session_tumble(spark, tmp_path):
    got = run(spark, tmp_path, [(0, 1), (59, 2), (100, 3), (300, 4)], "PROCESS WITH('identity'='session_tumble_window', 'eventtime'='ts', 'fields'='name', 'values'='value', 'session.duration'='60 s')")
    assert [((r.ts - BASE).total_seconds(), r.value) for r in sorted(got, key=lambda r: r.ts)] == [(60, [1, 2]), (120, [3]), (360, [4])]


def test_running_sum(spark, tmp_path):
    got = run(spark, tmp_path, [(0, 1), (1, 2), (2, 3)], "SUM WITH('field'='value')", timed=False)
    assert sorted(r.value for r in got) == [1, 3, 6]


def test_reduce(spark, tmp_path):
    from weirstream.operators.running import reducer

    reducer("add_values")(lambda total, row: {**row, "value": total["value"] + row["value"]})
    got = run(spark, tmp_path, [(0, 1), (1, 2), (2, 3)], "REDUCE WITH('identity'='add_values')", timed=False)
    assert sorted((r.value, r.n) for r in got) == [(1, 0), (3, 1), (6, 2)]


def test_rebucket(spark, tmp_path):
    """Session windows dealt into tumbling windows, which come once the watermark has passed them by a session's length."""
    chain = "PROCESS WITH('identity'='session_tumble_window', 'eventtime'='ts', 'fields'='name', 'values'='value', 'session.duration'='60 s')"
    batch = [(0, 1), (59, 2), (100, 3), (300, 4)]
    windows = run(spark, tmp_path, batch, chain)
    start = int(BASE.timestamp()) * 1000
    assert len(windows) == 3
    schema = "name string, ts timestamp, stamps array<bigint>, value array<int>, n long"
    rows = [("a", r.ts, r.time_series, r.value, i) for i, r in enumerate(sorted(windows, key=lambda r: r.ts))] + [("zz", BASE + timedelta(days=9 + i), [0], [0], 9 + i) for i in range(2)]
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "sessions"))
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "sessions"))
    e = Engine(spark)
    e.register("sessions", df.withWatermark("ts", "3 seconds"), seq="n")
    out = e.execute("PRINT FROM sessions KEY BY WITH('fields'='name') PROCESS WITH('identity'='session_tumble_2_tumble_window', 'fields'='name', 'eventtime'='ts', 'values'='value', 'time-series.name'='stamps', 'session.duration'='60 s', 'tumble.interval'='50 s')").visible()
    q = out.writeStream.format("memory").queryName("dealt").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.awaitTermination(120)
    first = start // 50_000 * 50_000
    want: dict = {}
    for s, v in batch:
        want.setdefault((start + s * 1000) // 50_000 * 50_000, []).append(v)
    got = {int(r.ts.timestamp() * 1000) // 50_000 * 50_000: r.value for r in spark.table("dealt").collect() if r.name == "a"}
    assert got == want and first in got


def test_temporal_join(spark, tmp_path):
    for side, rows in (("l", [(1, 1), (2, 2), (3, 3)]), ("r", [(0, 10), (2, 20)])):
        data = [("a", BASE + timedelta(seconds=s), v, i) for i, (s, v) in enumerate(rows)] + [("zz", BASE + timedelta(days=9), 0, 99)]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / side / "0"))
        spark.createDataFrame([("zz", BASE + timedelta(days=19), 0, 100)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / side / "1"))
    e = Engine(spark)
    for side in "lr":
        df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / side / "*"))
        e.register(side, df.withWatermark("ts", "3 seconds"), seq="n")
        e.execute(f"CREATE STREAM {side}k FROM {side} KEY BY WITH('fields'='name')")
    out = e.execute("PRINT FROM lk CONNECT rk WITH('identity'='temporal_join', 'left.eventtime'='ts', 'right.eventtime'='ts', 'left.output.fields'='name, value', 'right.output.fields'='value AS r')").visible()
    q = out.writeStream.format("memory").queryName("joined").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert sorted((r.value, r.r) for r in spark.table("joined").collect() if r.name == "a") == [(1, 10), (2, 20), (3, 20)]
    with pytest.raises(ValueError):
        e.execute("PRINT FROM lk CONNECT rk WITH('identity'='temporal_join', 'left.eventtime'='ts', 'right.eventtime'='ts', 'right.order.type'='NEXT')")
