"""Functions, series and formats."""

import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirstream.functions import scalar, series, sketches
from weirstream.sources import TableDef, kafka_options, lake
from weirstream.sources.doris import DorisOptions, alive_backends, choose_backend, create_table, csv_line, headers_of, write_stream_load
from weirstream.sources.elasticsearch import ElasticsearchOptions, bulk_lines, index_name, write_bulk
from weirstream.sources.formats import changelog_csv, decode
from weirstream.sources.http import HttpOptions, write_requests
from weirstream.sources.protobuf import decode_messages, encode_messages
from weirstream.sources.retry import with_retries
from weirstream.types import FieldError, duration_ms, field_list, free_name


def test_field_lists():
    assert field_list("a, b AS c,a", ["a", "b"]) == [("a", "a"), ("b", "c")]
    assert field_list("a, *", ["a", "b"]) == [("a", "a"), ("b", "b")]
    assert field_list(None, ["a"]) == []
    with pytest.raises(FieldError):
        field_list("x", ["a"])
    assert free_name("date", ["date", "date1"]) == "date2"
    assert [duration_ms(x) for x in ("10 s", "1min", "2 d", "5")] == [10_000, 60_000, 172_800_000, 5]


def test_time_functions(spark):
    df = spark.createDataFrame([(1735768800000, 200)], "a bigint, b int")
    long, integer = T.LongType(), T.IntegerType()
    r = df.select(
        scalar.to_date(F.col("a"), long).alias("d"), scalar.to_date(F.col("a"), long, "GMT+8").alias("d8"), scalar.to_hour(F.col("a"), long).alias("h"), scalar.to_hour(F.col("a"), long, "GMT+8").alias("h8"),
        scalar.to_long_timestamp(scalar.to_timestamp(F.lit(100).cast("bigint"), long)).alias("m1"), scalar.to_long_timestamp(scalar.to_timestamp(F.col("b"), integer)).alias("m2"),
    ).first()
    assert (str(r.d), str(r.d8), r.h, r.h8, r.m1, r.m2) == ("2025-01-01", "2025-01-02", 22, 6, 100, 200_000)


def test_modular_and_hash(spark):
    df = spark.createDataFrame([(-7, 3), (None, 3), (5, 0), (-(2**63), 3)], "x bigint, m int")
    assert [r[0] for r in df.select(scalar.modular(F.col("x"), F.col("m"))).collect()] == [1, 0, 0, 0]
    # public vectors of MurmurHash3 x64 128
    assert scalar.murmur3_x64_128(b"", 0) == 0
    assert scalar.murmur3_x64_128(b"hello", 0) & (2**64 - 1) == 0xCBD8A7B341BD9B02
    guava = spark.sparkContext._jvm.com.google.common.hash.Hashing
    df = spark.createDataFrame([("abc",), (None,), ("a longer text of more than sixteen bytes",)], "s string")
    got = [r[0] for r in df.select(scalar.hash_code(F.col("s"), T.StringType())).collect()]
    want = [guava.murmur3_128(scalar.HASH_SEED).hashBytes(bytearray(s.encode())).asLong() if s else 0 for s in ("abc", None, "a longer text of more than sixteen bytes")]
    assert got == want


def test_sketches(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.9), (3, 0.3), (2, 0.3), (3, 0.1)], "x int, v double")
    assert df.agg(sketches.hyper_log_log(F.col("x"))).first()[0] == 3
    part = df.groupBy("x").agg(sketches.hyper_log_log_temporary(F.col("x")).alias("s"), sketches.percentile_temporary(F.col("v")).alias("q"))
    r = part.agg(sketches.hyper_log_log_merge(F.col("s")).alias("n"), sketches.percentile_merge(F.col("q"), 0.5).alias("p")).first()
    assert (r.n, r.p) == (3, 0.3)
    assert df.agg(sketches.percentile(F.col("v"), 0.9)).first()[0] == 1.0
    with pytest.raises(ValueError):
        sketches.percentile(F.col("v"), 2)


@pytest.mark.parametrize("kind, values", [("BOOLEAN", [True, False]), ("TINYINT", [1, -1]), ("SMALLINT", [300]), ("INT", [1, -(2**31)]), ("BIGINT", [2**40]), ("FLOAT", [0.5]), ("DOUBLE", [0.1]), ("STRING", ["a", "é" * 100, ""]), ("BINARY", [b"\x00\xff"])])
def test_series_round_trip(kind, values):
    assert series.unpack(series.pack([*values, None], kind), kind) == values


def test_series_is_big_endian(spark):
    assert series.pack([1, 2], "INT") == bytes([0, 0, 0, 1, 0, 0, 0, 2])
    df = spark.createDataFrame([([1, 2],), (None,)], "v array<bigint>").select(series.encode_series("BIGINT")("v").alias("b"))
    assert [r.v for r in df.select(series.decode_series("BIGINT")("b").alias("v")).collect()] == [[1, 2], None]


def test_formats(spark):
    lines = spark.createDataFrame([("INSERT|1|a",), ("DELETE|2|",)], "value string")
    assert [tuple(r) for r in changelog_csv(lines, "id INT, s STRING").collect()] == [("INSERT", 1, "a"), ("DELETE", 2, "")]
    with pytest.raises(TypeError):
        changelog_csv(lines, "id BIGINT")
    js = spark.createDataFrame([('{"a": 1, "t": "2025-01-01 12:00:00"}',), ("no json",)], "value string")
    rows = decode(js, {"format": "json"}, "a INT, t TIMESTAMP").collect()
    assert rows[0].a == 1 and rows[0].t == datetime(2025, 1, 1, 12)


def descriptor():
    from google.protobuf import descriptor_pb2

    fds = descriptor_pb2.FileDescriptorSet()
    f = fds.file.add(name="m.proto", package="p", syntax="proto3")
    m = f.message_type.add(name="M")
    for i, (n, t) in enumerate([("name", 9), ("score", 5), ("ts", 3)], 1):
        m.field.add(name=n, number=i, type=t, label=1)
    m.field.add(name="xs", number=4, type=5, label=3)
    return fds.SerializeToString()


def test_protobuf(spark):
    d = descriptor()
    df = spark.createDataFrame([("n", 1, 2, [1, 2]), ("m", None, None, None)], "name string, score int, ts bigint, xs array<int>")
    data = encode_messages(df, d, "p.M")
    assert [tuple(r) for r in decode_messages(data, "name string, score int, xs array<int>", d, "p.M").collect()] == [("n", 1, [1, 2]), ("m", 0, [])]
    bad = spark.createDataFrame([(bytearray([10, 100]),)], "value binary")
    assert decode_messages(bad, "name string", d, "p.M", ignore_errors=True).first().name is None
    with pytest.raises(Exception, match="cannot decode"):
        decode_messages(bad, "name string", d, "p.M").collect()
    with pytest.raises(ValueError):
        decode_messages(bad, "other string", d, "p.M")


class Server:
    def __init__(self, answer):
        self.seen = seen = []

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
                seen.append((self.path, dict(self.headers), body))
                code, data = answer(self.path, body)
                self.send_response(code)
                self.end_headers()
                self.wfile.write(data)

            do_PUT = do_POST

            def log_message(self, *a):
                pass

        self.http = HTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()


def test_http_sink(spark):
    server = Server(lambda path, body: (500 if path == "/bad" else 200, b""))
    df = spark.createDataFrame([(server.url + "/a", {"X": "1"}, "hi"), (None, None, "no"), (server.url + "/bad", None, "x")], "url string, headers map<string,string>, body string")
    options = HttpOptions.of({"request.type": "POST", "retry.count": "1", "retry.interval": "1ms", "code.ignore": "true"})
    assert write_requests(df, None, options) == {500: 1}
    assert sorted(x[0] for x in server.seen) == ["/a", "/bad"] and next(x for x in server.seen if x[0] == "/a")[2] == b"hi"
    with pytest.raises(Exception, match="failed after 1 retries"):
        write_requests(df, None, HttpOptions.of({"request.type": "POST", "retry.interval": "1ms"}))


def test_elasticsearch_sink(spark):
    server = Server(lambda path, body: (200, json.dumps({"items": []}).encode()))
    df = spark.createDataFrame([(1, "a", "INSERT"), (2, None, "DELETE"), (3, "c", "UPDATE_BEFORE")], "id int, v string, _op string")
    o = ElasticsearchOptions.of({"index": "x-{v}", "hosts": server.url, "document-type": "t"})
    lines = [r.line for r in bulk_lines(df, ["id"], o).collect()]
    assert lines == ['{"update":{"_index":"x-a","_type":"t","_id":"1"}}\n{"doc":{"id":1,"v":"a"},"doc_as_upsert":true}', '{"delete":{"_index":"x-null","_type":"t","_id":"2"}}']
    assert bulk_lines(df.drop("_op"), [], o).first().line.startswith('{"index":')
    assert write_bulk(df, TableDef("t", primary_key=["id"]), o) == 0 and server.seen[0][0] == "/_bulk"
    with pytest.raises(ValueError):
        index_name(df, "{a}-{b}")
    with pytest.raises(ValueError):
        index_name(df, "x-{now()|yyyy}", append_only=False)


def test_doris_sink(spark):
    server = Server(lambda path, body: (200, b'{"Status": "Success"}'))
    df = spark.createDataFrame([(1, "a\tb", ["x", "y"], {"k": "v", "n": None}), (2, None, None, None)], "id int, s string, a array<string>, m map<string,string>")
    o = DorisOptions.of({"fenodes": server.url[7:], "table.identifier": "db.t", "sink.column-separator": "\\t"})
    lines = [r[0] for r in df.select(csv_line(df, o)).collect()]
    assert lines == ['1\tab\t[x, y]\t{"k":"v"}', "2\t\\N\t\\N\t\\N"]
    assert write_stream_load(df.coalesce(1), None, o, 0) == 2
    assert server.seen[0][0] == "/api/db/t/_stream_load" and {k.lower(): v for k, v in server.seen[0][1].items()}["label"].startswith("db_t_")
    assert "label" not in headers_of(DorisOptions(group_commit="async_mode"), ["a"], "l")
    with pytest.raises(ValueError):
        DorisOptions.of({"fenodes": "x", "table.identifier": "a.b", "sink.properties.label": "x"})
    ddl = create_table(df.schema, "db.t", engine="OLAP", buckets="HASH(`id`) BUCKETS 4", keys=["id"], key_model="AGGREGATE", aggregates={"s": "REPLACE"}, types={"s": "VARCHAR(9)"}, properties={"replication_num": "1"})
    assert ddl.startswith("CREATE TABLE IF NOT EXISTS db.t (\n  `id` INT,\n  `s` VARCHAR(9) REPLACE,") and "AGGREGATE KEY(`id`)" in ddl
    rows = [{"Host": "a", "HttpPort": 1, "Alive": "true"}, {"Host": "b", "HttpPort": 1, "Alive": "false"}, {"Host": "c", "HttpPort": 1, "Alive": "true", "NodeRole": "computation"}]
    assert alive_backends(rows) == ["a:1"] and choose_backend(["a:1"], o, 0) == "a:1"


def test_small_helpers(spark):
    calls = []
    assert with_retries(lambda: calls.append(1) or len(calls), 2, 0) == 1
    with pytest.raises(RuntimeError):
        with_retries(lambda: 1 / 0, 1, 0)
    assert kafka_options({"topic": "t", "properties.bootstrap.servers": "h", "scan.startup.mode": "earliest-offset"}) == {"kafka.bootstrap.servers": "h", "subscribe": "t", "topic": "t", "startingOffsets": "earliest"}
    df = spark.createDataFrame([("k", (1, None))], "id string, f struct<a:int,b:int>")
    assert [(r.family, r.qualifier) for r in lake.hbase_cells(df).collect()] == [("f", "a")]
