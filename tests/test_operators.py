"""Operators against hand-computed rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row

from weirstream.engine import Engine
from weirstream.operators.running import reducer
from weirstream.registry import NotKeyed, UnknownName

BASE = datetime(2025, 3, 10, 13, 0, 0)


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def ms(seconds):
    return 1741611600000 + int(seconds * 1000)


@pytest.fixture
def engine(spark):
    return Engine(spark)


def feed(engine, name, schema, rows, **options):
    df = engine.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", n long")
    engine.register(name, df, seq="n", **options)


SCORES = [("aaaa", 1, "p1", 4), ("bbbb", 2, "p2", 5), ("aaaa", 3, "p3", 6), ("aaaa", 1, "p4", 7), ("aaaa", 3, "p5", 8)]


@pytest.mark.parametrize(
    "op, scores, payloads",
    [
        ("SUM WITH('field'='score')", [1, 2, 4, 5, 8], ["p1", "p2", "p1", "p1", "p1"]),
        ("sum with('position'='1')", [1, 2, 4, 5, 8], ["p1", "p2", "p1", "p1", "p1"]),
        ("MIN WITH('field'='score')", [1, 2, 1, 1, 1], ["p1", "p2", "p1", "p1", "p1"]),
        ("MAX WITH('field'='score')", [1, 2, 3, 3, 3], ["p1", "p2", "p1", "p1", "p1"]),
        ("MIN BY WITH('field'='score')", [1, 2, 1, 1, 1], ["p1", "p2", "p1", "p1", "p1"]),
        ("MIN  BY WITH('field'='score', 'first'='false')", [1, 2, 1, 1, 1], ["p1", "p2", "p1", "p4", "p4"]),
        ("MAX BY WITH('field'='score')", [1, 2, 3, 3, 3], ["p1", "p2", "p3", "p3", "p3"]),
        ("MAX BY WITH('field'='score', 'first'='false')", [1, 2, 3, 3, 3], ["p1", "p2", "p3", "p3", "p5"]),
    ],
)
def test_running_aggregates(engine, op, scores, payloads):
    feed(engine, "s", "name string, score int, payload string, extra long", SCORES)
    rows = engine.execute(f"PRINT FROM s KEY BY WITH('fields'='name') {op}").df.orderBy("n").collect()
    assert [r.score for r in rows] == scores
    assert [r.payload for r in rows] == payloads


def test_reduce_runs_by_key(engine):
    @reducer("plus")
    def plus(a, b):
        return {**a, "score": a["score"] + b["score"]}

    feed(engine, "s", "name string, score int", [("n1", 1), ("n2", 2), ("n1", 2)])
    rows = engine.execute("CREATE STREAM out FROM s KEY BY WITH('fields'='name') REDUCE WITH('identity'='plus')").df.collect()
    assert sorted(r.score for r in rows) == [1, 2, 3]


def test_errors(engine):
    feed(engine, "s", "name string, score int", [("n1", 1)])
    with pytest.raises(NotKeyed):
        engine.execute("PRINT FROM s SUM WITH('field'='score')")
    with pytest.raises(RuntimeError):
        engine.execute("PRINT FROM s KEY BY WITH('fields'='name') SUM")
    with pytest.raises(ValueError):
        engine.execute("PRINT FROM s KEY BY WITH('fields'=' ')")
    with pytest.raises(ValueError):
        engine.execute("PRINT FROM s PROJECT")
    with pytest.raises(UnknownName):
        engine.execute("PRINT FROM s NOTHING WITH('a'='b')")
    with pytest.raises(ValueError):
        engine.execute("PRINT FROM s KEY BY WITH('fields'='name', 'parallelism'='2')")
    engine.execute("CREATE STREAM t FROM s FORWARD")
    with pytest.raises(ValueError):
        engine.execute("CREATE STREAM t FROM s FORWARD")


def test_project_and_union_chain(engine):
    feed(engine, "s1", "name string, score int", [("aaaa", 1), ("bbbb", 2)])
    feed(engine, "s2", "name string, score int", [("cccc", 3), ("aaab", 4), ("aaaa", 5)])
    engine.execute("CREATE STREAM both FROM s1 UNION s2 PROJECT WITH('field_indexes'='0,1')")
    rows = engine.execute("PRINT FROM both KEY BY WITH('fields'='name') SUM WITH('field'='score') FILTER WITH('expression'='name LIKE \\'aaa%\\'')").visible().collect()
    assert sorted((r.name, r.score) for r in rows) == [("aaaa", 1), ("aaaa", 6), ("aaab", 4)]


def test_select_refuses_aggregates(engine):
    feed(engine, "s", "name string", [("NsN",)])
    rows = engine.execute("PRINT FROM s MAP WITH('identity'='select', 'expression'='UPPER(name) AS a, LOWER(name) AS b')").visible().collect()
    assert rows == [Row(a="NSN", b="nsn")]
    with pytest.raises(ValueError):
        engine.execute("PRINT FROM s MAP WITH('expression'='SUM(name) AS x')")


LEFT = [("aaaa", 1, at(0)), ("aaab", 2, at(0)), ("aaaa", 3, at(0)), ("aaab", 4, at(0)), ("cccc", 4, at(6))]
RIGHT = [("aaaa", True, at(0)), ("aaab", False, at(0)), ("cccc", False, at(60))]


@pytest.mark.parametrize("text", ["JOIN r WITH('where'='name', 'equal.to'='name', 'window.size'='2 s', {})", "INTERVAL JOIN r2 WITH('lower'='-1 s', 'upper'='1 s', {})"])
def test_window_and_interval_join(engine, text):
    feed(engine, "l", "name string, score int, ts timestamp", LEFT)
    feed(engine, "r", "name string, male boolean, ts timestamp", RIGHT)
    engine.execute("CREATE STREAM l2 FROM l KEY BY WITH('fields'='name')")
    engine.execute("CREATE STREAM r2 FROM r KEY BY WITH('fields'='name')")
    rows = engine.execute("PRINT FROM l2 " + text.format("'left.eventtime'='ts', 'right.eventtime'='ts', 'right.output.fields'='male'")).visible().collect()
    assert sorted((r.name, r.score, r.male) for r in rows) == [("aaaa", 1, True), ("aaaa", 3, True), ("aaab", 2, False), ("aaab", 4, False)]


@pytest.mark.parametrize("order, tags", [("LAST", ["r1", "r2", "r2"]), ("FIRST", ["r1", "r1", "r1"])])
def test_temporal_join(engine, order, tags):
    feed(engine, "l", "name string, ts timestamp, tag string", [("a", at(i), f"l{i}") for i in (1, 2, 3)])
    feed(engine, "r", "name string, ts timestamp, tag string", [("a", at(0), "r1"), ("a", at(2), "r2")])
    for s in "lr":
        engine.execute(f"CREATE STREAM {s}k FROM {s} KEY BY WITH('fields'='name')")
    rows = engine.execute(f"PRINT FROM lk CONNECT rk WITH('identity'='temporal_join', 'left.eventtime'='ts', 'right.eventtime'='ts', 'right.order.type'='{order}', 'left.output.fields'='tag AS l', 'right.output.fields'='tag AS r')").df
    assert [r.r for r in rows.orderBy("l").collect()] == tags


def test_temporal_join_cases(engine):
    """Equal right times: the last arrival; no version yet: null with LEFT, dropped with INNER."""
    feed(engine, "l", "name string, ts timestamp", [("a", at(1)), ("a", at(5)), ("b", at(1))])
    feed(engine, "r", "name string, ts timestamp, v int", [("a", at(3), 1), ("a", at(3), 2), ("a", at(9), 3)])
    for s in "lr":
        engine.execute(f"CREATE STREAM {s}k FROM {s} KEY BY WITH('fields'='name')")
    base = "PRINT FROM lk CONNECT rk WITH('identity'='temporal_join', 'left.eventtime'='ts', 'right.eventtime'='ts', 'left.output.fields'='name, ts', 'right.output.fields'='v'"
    assert [r.v for r in engine.execute(base + ")").df.collect()] == [2]
    rows = engine.execute(base + ", 'join.type'='LEFT')").df.orderBy("name", "ts").collect()
    assert [r.v for r in rows] == [None, 2, None]
    with pytest.raises(ValueError):
        engine.execute(base + ", 'join.type'='FULL')")


def timed(engine, rows, options, schema="name string, ts timestamp, value int"):
    feed(engine, "t", schema, rows, row_time=options.pop("mark", None))
    pairs = ", ".join(f"'{k}'='{v}'" for k, v in options.items())
    return engine.execute(f"PRINT FROM t KEY BY WITH('fields'='name') PROCESS WITH('eventtime'='ts', {pairs})").df.orderBy("ts", "n").collect()


def test_deduplicate(engine):
    rows = [("a", at(s), i) for i, s in enumerate((1, 2, 30, 32), 1)]
    assert [r.value for r in timed(engine, rows, {"identity": "deduplicate", "table.exec.state.ttl": "10 s"})] == [1, 3]
    assert [r.value for r in timed(engine, rows, {"identity": "deduplicate", "order.type": "DESC", "emit": "running"})] == [1, 2, 3, 4]
    assert [r.value for r in timed(engine, rows, {"identity": "deduplicate", "order.type": "DESC"})] == [4]
    assert [r.value for r in timed(engine, [("a", at(1), 1), ("a", at(1), 2)], {"identity": "deduplicate"})] == [2]


def test_watch_changed(engine):
    rows = [("a", at(i), v) for i, v in enumerate((1, 1, 2, 2, 3, 3, 1, 1))]
    got = timed(engine, rows, {"identity": "field_value_watch_changed_emitter", "watch.field": "value"})
    assert [r.value for r in got] == [1, 2, 3, 1]
    rows = [("a", at(1), 1), ("a", at(2), 1), ("a", at(60), 1), ("a", at(61), 2)]
    got = timed(engine, rows, {"identity": "field_value_watch_changed_emitter", "watch.field": "value", "table.exec.state.ttl": "10 s"})
    assert [r.ts for r in got] == [at(1), at(60), at(61)]
    got = timed(engine, [("a", at(i), v) for i, v in enumerate((None, None, 1, None))], {"identity": "field_value_watch_changed_emitter", "watch.field": "value"})
    assert [r.value for r in got] == [None, 1, None]


def test_disorder_discard(engine):
    rows = [("a", at(s), s) for s in (0, 2, 4, 3, 6, 1, 11, 15)]
    got = timed(engine, rows, {"identity": "disorder_discard", "mark": "WATERMARK FOR ts AS ts - INTERVAL '3' SECOND"})
    assert [r.value for r in got] == [0, 2, 3, 4, 6, 11, 15]


@pytest.mark.parametrize("times, ends", [((0, 59.999, 100, 110, 120), (60, 120, 180)), ((0, 182), (60, 242)), ((0, 122), (60, 182)), ((0, 62), (60, 120)), ((0, 60), (60, 120)), ((0, 120), (60, 180)), ((0, 119.999), (60, 120))])
def test_session_tumble(engine, times, ends):
    got = timed(engine, [("a", at(t), i) for i, t in enumerate(times)], {"identity": "session_tumble_window", "fields": "name, value AS first, n", "values": "value", "session.duration": "60 s"})
    assert [int((r.ts - BASE).total_seconds()) for r in got] == list(ends)
    assert [t for r in got for t in r.time_series] == [ms(t) for t in times]
    assert all(r._window_start_timestamp + 60_000 == ms((r.ts - BASE).total_seconds()) for r in got)
    assert [r.first for r in got] == [r.value[0] for r in got]


def test_session_tumble_nulls(engine):
    rows = [("a", at(0), 1), ("a", at(1), None), ("a", None, 9)]
    got = timed(engine, rows, {"identity": "session_tumble_window", "fields": "name, n", "values": "value", "session.duration": "60 s"})
    assert len(got) == 1 and got[0].value == [1] and len(got[0].time_series) == 2


@pytest.mark.parametrize("interval, sizes", [("2 s", [2] * 15), ("5 s", [5] * 6), ("10 s", [10] * 3)])
def test_rebucket(engine, interval, sizes):
    feed(engine, "t", "name string, ts timestamp, v int", [("a", at(i), i) for i in range(30)])
    engine.execute("CREATE STREAM w FROM t KEY BY WITH('fields'='name') PROCESS WITH('identity'='session_tumble_window', 'eventtime'='ts', 'fields'='name', 'values'='v', 'session.duration'='5 s')")
    got = engine.execute(f"PRINT FROM w KEY BY WITH('fields'='name') PROCESS WITH('identity'='session_tumble_2_tumble_window', 'fields'='name', 'eventtime'='ts', 'values'='v', 'session.duration'='5 s', 'tumble.interval'='{interval}')").df.orderBy("ts").collect()
    assert [len(r.v) for r in got] == sizes
    assert [x for r in got for x in r.v] == list(range(30))
    assert all((r.ts - BASE).total_seconds() * 1000 % 1000 == 999 for r in got)


@pytest.mark.parametrize("identity, most, want", [("date_expansion", 4, [3, 4, 1]), ("date_hour_expansion", 96, [49, 96, 1])])
def test_expansion(engine, identity, most, want):
    day = 86_400
    spans = [(1735732800, 1735732800 + 2 * day), (1735732800, 1735732800 + 30 * day), (1735732800, 1735732800)]
    for (start, end), n in zip(spans, want):
        df = engine.spark.createDataFrame([(start, end, end)], "start_ts int, end_ts int, ts int")
        e = Engine(engine.spark)
        e.register("s", df)
        got = e.execute(f"PRINT FROM s FLAT MAP WITH('identity'='{identity}', 'timezone'='GMT+8', 'field.start-ts'='start_ts', 'field.end-ts'='end_ts', 'field.current-ts'='ts', 'max-count'='{most}')").df
        assert got.count() == n


def test_hour_expansion_across_midnight(engine):
    df = engine.spark.createDataFrame([(1735775999, 1735776001, 0)], "start_ts int, end_ts int, date int")
    engine.register("s", df)
    got = engine.execute("PRINT FROM s FLAT MAP WITH('identity'='date_hour_expansion', 'field.start-ts'='start_ts', 'field.end-ts'='end_ts', 'field.current-ts'='end_ts', 'max-count'='9')").df
    assert "date1" in got.columns
    assert sorted(r.hour for r in got.collect()) == [0, 23]


def test_aggregate_needs_a_window(engine):
    feed(engine, "t", "name string, event_ts timestamp, v int", [("a", at(0), 1), ("a", at(59), 2), ("a", at(60), 3)])
    text = "PRINT FROM t KEY BY WITH('fields'='name') AGGREGATE WITH('expression.select'='name, SUM(v) AS v', 'expression.groupby'='name{}')"
    rows = engine.execute(text.format(", TUMBLE(event_ts, INTERVAL \\'1\\' MINUTE)")).df.collect()
    assert sorted(r.v for r in rows) == [3, 3]
    with pytest.raises(RuntimeError):
        engine.execute(text.format(""))
