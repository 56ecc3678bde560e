"""Connectors: what a declared table reads from and writes to."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class TableDef:
    """A declared table: columns, computed and metadata columns, watermark, key, partitions and options."""

    name: str
    columns: list[tuple[str, str]] = field(default_factory=list)
    computed: list[tuple[str, str]] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    watermark: str | None = None
    primary_key: list[str] = field(default_factory=list)
    partitions: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)

    @property
    def schema(self) -> str:
        return ", ".join(f"`{n}` {t}" for n, t in self.columns)


def kafka_options(options: dict[str, str]) -> dict[str, str]:
    """Spark's Kafka options for those of a declared table; properties.* are handed on to the client."""
    start = {"earliest-offset": "earliest", "latest-offset": "latest"}
    out = {"kafka." + k.removeprefix("properties."): v for k, v in options.items() if k.startswith("properties.")}
    out |= {"subscribe": options["topic"], "topic": options["topic"]}
    if "scan.startup.mode" in options:
        out["startingOffsets"] = start.get(options["scan.startup.mode"], "latest")
    return out


def open_source(spark: SparkSession, t: TableDef) -> DataFrame:
    """The rows of a declared table, decoded by its format."""
    from . import formats

    kind = t.options.get("connector", "")
    stream = t.options.get("streaming", "false").lower() == "true"
    reader = spark.readStream if stream else spark.read
    if kind in ("parquet", "paimon", "filesystem") and t.options.get("format", "parquet") == "parquet":
        reader = reader.schema(t.schema) if t.columns else reader
        return reader.parquet(t.options["path"])
    if kind == "filesystem":
        return formats.decode(reader.text(t.options["path"]), t.options, t.schema)
    if kind == "socket":
        from .socket import socket_lines

        return formats.decode(socket_lines(spark, t.options), t.options, t.schema)
    if kind == "kafka":
        lines = spark.readStream.format("kafka").options(**kafka_options(t.options)).load()
        return formats.decode(lines, t.options, t.schema)
    if kind == "datagen":
        rate = spark.readStream.format("rate").option("rowsPerSecond", t.options.get("rows-per-second", "10")).load() if stream else spark.range(int(t.options.get("number-of-rows", "100"))).withColumnRenamed("id", "value")
        return rate.select(*[F.col("value").cast(kind_).alias(name) for name, kind_ in t.columns])
    raise ValueError(f"connector {kind!r} has no source")


def write_sink(df: DataFrame, t: TableDef, overwrite: bool = False):
    """Write a batch, or start a stream, to a declared table; a batch returns None. Only files can be overwritten: a partitioned
    table in the partitions that rows come for, another whole."""
    kind = t.options.get("connector", "")
    if overwrite and kind not in ("parquet", "paimon", "filesystem"):
        raise ValueError(f"connector {kind!r} cannot overwrite")
    if t.columns and len(t.columns) == len(df.columns):
        df = df.toDF(*[n for n, _ in t.columns])
    if kind.endswith("elasticsearch-6"):
        from .elasticsearch import ElasticsearchOptions, write_bulk

        return _each_batch(df, t, lambda part, n: write_bulk(part, t, ElasticsearchOptions.of(t.options)))
    if kind == "http":
        from .http import HttpOptions, write_requests

        return _each_batch(df, t, lambda part, n: write_requests(part, t, HttpOptions.of(t.options)))
    if kind == "doris":
        from .doris import DorisOptions, write_stream_load

        return _each_batch(df, t, lambda part, n: write_stream_load(part, t, DorisOptions.of(t.options), n))
    if kind == "kafka":
        out = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
        return out.writeStream.format("kafka").options(**kafka_options(t.options)).options(**_checkpoint(t)).start() if df.isStreaming else out.write.format("kafka").options(**kafka_options(t.options)).save()
    if kind in ("parquet", "paimon", "filesystem"):
        from .lake import write_lake

        return write_lake(df, t, overwrite)
    if kind == "hbase-2.2":
        from .lake import hbase_cells

        return _each_batch(df, t, lambda part, n: hbase_cells(part).write.mode("append").parquet(t.options["path"]))
    if kind in ("print", "blackhole"):
        if df.isStreaming:
            return df.writeStream.format("console" if kind == "print" else "noop").outputMode("append").options(**_checkpoint(t)).start()
        return df.show(truncate=False) if kind == "print" else df.write.format("noop").mode("overwrite").save()
    raise ValueError(f"connector {kind!r} has no sink")


def _checkpoint(t: TableDef) -> dict[str, str]:
    return {"checkpointLocation": t.options["checkpoint"]} if "checkpoint" in t.options else {}


def _each_batch(df: DataFrame, t: TableDef, write):
    if not df.isStreaming:
        return write(df, 0)
    return df.writeStream.foreachBatch(write).options(**_checkpoint(t)).start()
