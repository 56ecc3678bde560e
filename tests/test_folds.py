"""Folds over sorted rows against plain loops, over small batches, and their time on one key."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weirstream.engine import Engine


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


def plain_windows(rows, d):
    out, state = {}, {}
    for k, t, n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        s = state.get(k)
        s = t if s is None or t >= s + 2 * d else s if t < s + d else s + d
        state[k] = s
        out.setdefault((k, s), []).append((t, n))
    return out


def plain_eras(rows, ttl):
    out, state = {}, {}
    for k, t, n in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        clean, era = state.get(k, (None, None))
        if clean is None or t >= clean:
            era = t
        if clean is None or t >= clean or t + ttl > clean:
            clean = t + ttl * 3 // 2
        state[k] = clean, era
        out.setdefault((k, era), []).append((t, n))
    return out


def run(spark, rows, chain):
    e = Engine(spark)
    e.register("r", spark.createDataFrame(rows, "k string, ts bigint, n bigint").repartition(3), seq="n")
    return e.execute(f"PRINT FROM r KEY BY WITH('fields'='k') {chain}").visible().collect()


def random_rows():
    rng = random.Random(4)
    return [(rng.choice("abcde") if rng.random() < 0.9 else None, rng.randrange(4000), i) for i in range(600)]


def test_windows(spark, small_batches):
    rows = random_rows()
    got = run(spark, rows, "PROCESS WITH('identity'='session_tumble_window', 'fields'='k', 'eventtime'='ts', 'values'='n', 'session.duration'='35')")
    assert {(r.k or "", r["_window_start_timestamp"]): list(zip(r.time_series, r.n)) for r in got} == plain_windows([(k or "", t, n) for k, t, n in rows], 35)


def test_eras(spark, small_batches):
    rows = random_rows()
    eras = plain_eras([(k or "", t, n) for k, t, n in rows], 20)
    for order, pick in (("ASC", lambda x: max(n for t, n in x if t == x[0][0])), ("DESC", lambda x: x[-1][1])):
        got = run(spark, rows, f"PROCESS WITH('identity'='deduplicate', 'eventtime'='ts', 'order.type'='{order}', 'table.exec.state.ttl'='20')")
        assert sorted(r.n for r in got) == sorted(pick(x) for x in eras.values()), order


def test_time_grows_with_the_rows_of_a_key(spark):
    def seconds(n):
        rows = spark.range(n).select(F.lit("a").alias("k"), (F.col("id") * 5).alias("ts"), F.col("id").alias("n"))
        e = Engine(spark)
        e.register("big", rows, seq="n")
        began = time.perf_counter()
        e.execute("PRINT FROM big KEY BY WITH('fields'='k') PROCESS WITH('identity'='session_tumble_window', 'fields'='k', 'eventtime'='ts', 'values'='n', 'session.duration'='1 d')").visible().collect()
        e.execute("PRINT FROM big KEY BY WITH('fields'='k') PROCESS WITH('identity'='deduplicate', 'eventtime'='ts', 'table.exec.state.ttl'='1 d')").visible().collect()
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(400_000) < 5 * seconds(100_000) + 5
