"""Parser, script text, runner and SQL idioms."""

import pytest

from weirstream.dialect import ParseError, parse
from weirstream.plans.sqlcompat import rewrite_expression, rewrite_query
from weirstream.script.runner import run_script, table_definition
from weirstream.script.text import add_default_template, expand_macros, split_statements, strip_comments


def test_parse_a_chain():
    st = parse(
        """create Stream out with('a'='b') FROM src WITH('product.type'='Row')
        union s2 with('x'='y')  UNION s3
        MAP WITH('identity'='m1') key by with('fields'='a,b') process WITH('identity'='p', 'k'='it\\'s')
        Flat Map WITH('identity'='f') FILTER WITH('identity'='g');"""
    )
    assert (st.type, st.name, st.source) == ("STREAM", "out", "src")
    assert [o.type for o in st.ops] == ["UNION", "UNION", "MAP", "KEY BY", "PROCESS", "FLAT MAP", "FILTER"]
    assert [o.source for o in st.ops[:2]] == ["s2", "s3"]
    assert st.ops[0].source_options == {"x": "y"}
    assert st.ops[4].options == {"identity": "p", "k": "it's"}
    assert st.source_options == {"product.type": "Row"}


@pytest.mark.parametrize("bad", ["SELECT 1", "CREATE STREAM a", "PRINT FROM a MAP WITH('a'=1)", "PRINT FROM a MAP WITH('a'='b'", "PRINT FROM a UNION", "PRINT FROM a ^"])
def test_parse_errors(bad):
    with pytest.raises(ParseError, match="line 1:"):
        parse(bad)


def test_comments_and_splitting():
    assert strip_comments("-- a\n\n SELECT 'x -- y' -- z\n  FROM t;\n'a\n-- b'") == "SELECT 'x -- y'\nFROM t;\n'a\n-- b'"
    text = "SET 'a'='b;c';\nSELECT 1; SELECT 2;\nSELECT 3"
    assert split_statements(text) == ["SET 'a'='b;c'", "SELECT 1", "SELECT 2", "SELECT 3"]
    assert split_statements(text, strict=True) == ["SET 'a'='b;c'", "SELECT 1"]


def test_templates():
    assert add_default_template("x").startswith("<#import")
    assert add_default_template('<#import "own.ftl" as t>\nx') == '<#import "own.ftl" as t>\nx'
    text = add_default_template("CREATE TABLE a (x INT)\n<@template.table_socket_source port='99' byte\\-delimiter='7'/>")
    out = expand_macros(text, {"socket.hostname": "h"})
    assert "'hostname' = 'h'" in out and "'port' = '99'" in out and "'byte-delimiter' = '7'" in out and out.endswith(");")
    assert "SET 'table.exec.state.ttl' = '1 min';" in expand_macros(add_default_template("<@template.setting_table exec\\.state\\.ttl='1 min'/>"))
    with pytest.raises(ValueError):
        expand_macros(add_default_template("<@template.table_kafka_source format='json'/>"))
    with pytest.raises(ValueError):
        expand_macros(add_default_template("<@template.no_such_macro/>"))


def test_table_definition():
    t = table_definition("CREATE TABLE IF NOT EXISTS `t` (id BIGINT NOT NULL, n VARCHAR(9), at AS to_timestamp(id), f ROW<q STRING, r INT>, h MAP<STRING, STRING> METADATA FROM 'headers', PRIMARY KEY (id) NOT ENFORCED, WATERMARK FOR at AS at - INTERVAL '3' SECOND) PARTITIONED BY (d, h) WITH ('connector'='print', 'k'='a''b')")
    assert t.name == "t" and t.primary_key == ["id"] and t.partitions == ["d", "h"] and t.metadata == {"h": "headers"}
    assert t.columns == [("id", "BIGINT"), ("n", "STRING"), ("f", "STRUCT<q:STRING,r:INT>"), ("h", "MAP<STRING, STRING>")]
    assert t.computed == [("at", "to_timestamp(id)")] and t.options["k"] == "a'b"


def test_run_script(spark, tmp_path):
    spark.createDataFrame([(1, "n1", 1000), (1, "n1", 2000), (2, "n2", 61000)], "id int, name string, ms bigint").write.parquet(str(tmp_path / "in"))
    result = run_script(
        spark,
        f"""
        -- a script
        CREATE TABLE src (id INT, name STRING, ms BIGINT, ts AS to_timestamp(ms), WATERMARK FOR ts AS ts) WITH ('connector'='parquet', 'path'='{tmp_path}/in');
        <@template.udf_time/>
        <@template.udf_math/>
        SET 'jobparam.x' = 'y';
        CREATE VIEW v FROM src MAP WITH ('expression'='id, name, ms') KEY BY WITH('fields'='id') SUM WITH('field'='ms');
        CREATE TABLE out (name STRING, ms BIGINT, day DATE) PARTITIONED BY (day) WITH ('connector'='parquet', 'path'='{tmp_path}/out');
        INSERT INTO out SELECT UPPER(name), ms, to_date(ms) FROM v;
        """.replace("to_timestamp(ms)", "timestamp_millis(ms)"),
        settings=["SET 'a' = 'b'"],
    )
    assert result.engine.context.settings["a"] == "b" and spark.conf.get("jobparam.x") == "y"
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("name", "ms").collect()
    assert [(r.name, r.ms) for r in rows] == [("N1", 1000), ("N1", 3000), ("N2", 61000)] or [r.ms for r in rows] == [2000, 3000, 61000]
    assert str(rows[0].day) == "1970-01-01"
    with pytest.raises(ValueError, match="not supported"):
        run_script(spark, "DROP TABLE x;")


def test_temporal_table_function(spark):
    spark.createDataFrame([(1, 5), (1, 9)], "k int, t int").selectExpr("k", "timestamp_seconds(t) AS ts").createOrReplaceTempView("asks")
    spark.createDataFrame([(1, 4, "a"), (1, 7, "b")], "k int, t int, v string").selectExpr("k", "timestamp_seconds(t) AS ts", "v").createOrReplaceTempView("rates")
    from weirstream.script.runner import Runner

    r = Runner(spark)
    r.run("CREATE TEMPORARY TABLE FUNCTION rate KEY k TIMESTAMP ts FROM rates")
    rows = r.sql("SELECT q.ts, p.v FROM asks AS q, LATERAL TABLE(rate(q.ts)) AS p WHERE q.k = p.k").collect()
    assert sorted(x.v for x in rows) == ["a", "b"]


def test_idioms(spark):
    one = lambda e: spark.sql(f"SELECT {rewrite_expression(e)} AS x").first().x
    assert one("JSON_OBJECT('a' VALUE 1, 'b' VALUE CAST(NULL AS STRING))") == '{"a":1,"b":null}'
    assert one("MAP['a', 1]['a']") == 1
    assert one("ROW(1, 2).col2") == 2
    assert one("'TUMBLE(x, y)'") == "TUMBLE(x, y)"
    assert str(spark.sql("SELECT " + rewrite_expression("to_date(1735768800000, 'GMT+8')", {"to_date"}) + " AS x").first().x) == "2025-01-02"
    assert spark.sql("SELECT " + rewrite_expression("to_hour(1735768800000)", {"to_hour"}) + " AS x").first().x == 22
    spark.createDataFrame([("a", [1, 2])], "k string, xs array<int>").createOrReplaceTempView("arrays")
    text = "SELECT k, total FROM arrays LEFT JOIN LATERAL TABLE(aggregate(xs, 0, (a, x) -> a + x)) AS t(total) ON TRUE"
    assert spark.sql(rewrite_query(spark, text)).first().total == 3


def test_lists_of_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "x bigint, y string").createOrReplaceTempView("pairs")
    table = f"CREATE TABLE o (a BIGINT, b STRING) WITH ('connector'='parquet', 'path'='{tmp_path}/o');\n"
    run_script(spark, table + "CREATE VIEW vv (p, q) AS SELECT y, x FROM pairs; INSERT INTO o (b, a) SELECT p, q FROM vv; INSERT INTO o (a) SELECT x FROM pairs;")
    assert sorted((r.a, r.b or "") for r in spark.read.parquet(f"{tmp_path}/o").collect()) == [(1, ""), (1, "a"), (2, ""), (2, "b")]
    run_script(spark, table + "INSERT OVERWRITE o SELECT 7, 'z';")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/o").collect()] == [(7, "z")]
    for bad in ("INSERT INTO o (a, c) SELECT 1, 2;", "INSERT INTO o (a) SELECT 1, 2;", "CREATE VIEW w (p) AS SELECT 1, 2;", "CREATE TABLE q WITH ('connector'='print'); INSERT OVERWRITE q SELECT 1;"):
        with pytest.raises(ValueError):
            run_script(spark, table + bad)


def test_sketches_by_the_type_of_what_they_take(spark):
    """Merging partial sketches and digests by the same names; the number of slots and the compression are settings."""
    spark.range(7 * 500).selectExpr("id % 7 AS k", "id AS v", "CAST(id AS DOUBLE) AS d").createOrReplaceTempView("many")
    text = """
    <@template.udf_statistics hyperloglog\\.number\\.slot='65536' percentile\\.compression\\.temporary='4000'/>
    CREATE VIEW merged AS SELECT hyper_log_log(s) AS n, hyper_log_log(t) AS m, percentile(q, 0.5) AS p, percentile(top, 0.5) AS plain
      FROM (SELECT k, hyper_log_log_temporary(v) AS s, hyper_log_log_temporary(d) AS t, percentile_temporary(v) AS q, max(v) AS top FROM many GROUP BY k);
    CREATE VIEW nested AS SELECT hyper_log_log(v) + percentile(d, 0.5) AS x FROM many;
    """
    run_script(spark, text)
    r = spark.table("merged").first()
    assert abs(r.n - 3500) < 40 and abs(r.m - 3500) < 40 and abs(r.p - 1750) < 20 and r.plain == 3496
    assert abs(spark.table("nested").first().x - 5250) < 200
