"""Doris sink: rows as CSV lines by stream load, labels that make repeated batches harmless, and table DDL."""

from __future__ import annotations

import json
import time
import urllib.request
import uuid
from base64 import b64encode
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import duration_ms
from .retry import with_retries

RESERVED = {"authorization", "label", "expect", "group_commit"}
SUCCESS = {"Success", "Label Already Exists"}


def unescape(text: str) -> str:
    """Backslash escapes of options, such as \\t or \\x01, as characters."""
    return text.encode("latin-1", "backslashreplace").decode("unicode_escape") if "\\" in text else text


def escape(text: str) -> str:
    """Control characters as \\xNN, the form that headers take."""
    return "".join(c if c.isprintable() else f"\\x{ord(c):02x}" for c in text)


@dataclass(frozen=True)
class DorisOptions:
    fenodes: str = ""
    table: str = ""
    username: str = "root"
    password: str = ""
    column_separator: str = "\t"
    line_delimiter: str = "\n"
    batch_bytes: int = 8 << 20
    interval_ms: int = 1000
    threads: int = 1
    retries: int = 3
    group_commit: str = "off_mode"
    group_commit_interval_ms: int = 10_000
    headers: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(o: dict[str, str]) -> DorisOptions:
        headers = {k.removeprefix("sink.properties."): v for k, v in o.items() if k.startswith("sink.properties.")}
        if bad := RESERVED & {k.lower() for k in headers}:
            raise ValueError(f"reserved headers: {sorted(bad)}")
        mode = o.get("sink.group-commit", "off_mode")
        if mode not in ("async_mode", "sync_mode", "off_mode"):
            raise ValueError(f"unknown group commit mode {mode}")
        return DorisOptions(
            o["fenodes"], o["table.identifier"], o.get("username", "root"), o.get("password", ""), unescape(o.get("sink.column-separator", "\\t")), unescape(o.get("sink.line-delimiter", "\\n")),
            int(o.get("sink.batch.bytes", 8 << 20)), duration_ms(o.get("sink.batch.interval", "1s")), int(o.get("sink.batch.threads", 1)), int(o.get("sink.max-retries", 3)), mode,
            duration_ms(o.get("sink.group-commit-interval", "10s")), headers,
        )


def _text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ", ", "null"), F.lit("]"))
    if isinstance(kind, T.MapType):
        return F.to_json(F.map_filter(c, lambda k, v: v.isNotNull()))
    if isinstance(kind, T.StructType):
        return F.to_json(c)
    return c.cast("string")


def csv_line(df: DataFrame, options: DorisOptions) -> Column:
    """A row as text: null as \\N; separators inside of values are removed."""
    marks = options.column_separator + options.line_delimiter
    values = [F.coalesce(F.translate(_text(F.col(f"`{f.name}`"), f.dataType), marks, ""), F.lit("\\N")) for f in df.schema.fields]
    return F.concat_ws(options.column_separator, *values)


def headers_of(options: DorisOptions, columns: list[str], label: str) -> dict[str, str]:
    out = {
        "Authorization": "Basic " + b64encode(f"{options.username}:{options.password}".encode()).decode(), "Expect": "100-continue", "format": "csv",
        "column_separator": escape(options.column_separator), "line_delimiter": escape(options.line_delimiter), "columns": ",".join(f"`{c}`" for c in columns), **options.headers,
    }
    return out | ({"label": label} if options.group_commit == "off_mode" else {"group_commit": options.group_commit})


def choose_backend(alive: list[str], options: DorisOptions, now_ms: int | None = None) -> str:
    """One backend for each interval, by table, so that group commits meet; without group commit the same rule spreads load."""
    if not alive:
        raise RuntimeError("no backend is alive")
    slot = (now_ms if now_ms is not None else int(time.time() * 1000)) // options.group_commit_interval_ms
    return sorted(alive)[(slot + sum(options.table.encode())) % len(alive)]


def alive_backends(rows: list[dict]) -> list[str]:
    """host:port of the mix nodes among rows of SHOW BACKENDS that are alive."""
    return [f"{r['Host']}:{r['HttpPort']}" for r in rows if str(r.get("Alive", "")).lower() == "true" and r.get("NodeRole", "mix") == "mix"]


def write_stream_load(df: DataFrame, table, options: DorisOptions, batch_id: int) -> int:
    """Load all rows before the batch ends; returns the number of lines.

    Labels name the streaming query, which keeps its id over restarts, batch, part and piece, so a batch that runs again loads
    nothing twice; a batch outside of a stream is a load of its own. Rows are dealt and sorted by their text, so that parts and
    pieces are the same when a batch runs again.
    """
    columns = df.columns
    query = df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
    run = query.replace("-", "")[:12] if query else uuid.uuid4().hex[:12]
    db, name = options.table.split(".")
    nodes = [x.strip() for x in options.fenodes.split(",")]

    def load(lines: list[str], label: str) -> None:
        data = options.line_delimiter.join(lines).encode()
        state = {"try": 0}

        def once() -> None:
            node = choose_backend(nodes, options, (int(time.time() * 1000) + state["try"] * options.group_commit_interval_ms))
            request = urllib.request.Request(f"http://{node}/api/{db}/{name}/_stream_load", data=data, headers=headers_of(options, columns, label), method="PUT")
            with urllib.request.urlopen(request, timeout=60) as reply:
                answer = json.loads(reply.read())
            if answer.get("Status") not in SUCCESS:
                raise RuntimeError(f"stream load: {answer}")

        with_retries(once, options.retries, options.interval_ms / 1000, lambda: state.update({"try": state["try"] + 1}))

    def part(frames):
        from pyspark import TaskContext

        at, n, piece, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        for frame in frames:
            for line in frame["line"]:
                held.append(line)
                size += len(line)
                n += 1
                if size >= options.batch_bytes:
                    load(held, f"{db}_{name}_{run}_{batch_id}_{at}_{piece}")
                    held, size, piece = [], 0, piece + 1
        if held:
            load(held, f"{db}_{name}_{run}_{batch_id}_{at}_{piece}")
        yield pd.DataFrame({"n": [n]})

    lines = df.select(csv_line(df, options).alias("line"))
    if query:
        lines = lines.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism), F.xxhash64("line")).sortWithinPartitions("line")
    return lines.mapInPandas(part, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def doris_type(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{doris_type(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"MAP<{doris_type(kind.keyType)}, {doris_type(kind.valueType)}>"
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision}, {kind.scale})"
    names = {T.StringType: "STRING", T.BooleanType: "BOOLEAN", T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INT", T.LongType: "BIGINT", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.DateType: "DATE", T.TimestampType: "DATETIME(3)", T.TimestampNTZType: "DATETIME(3)"}
    if type(kind) not in names:
        raise TypeError(f"Doris has no type for {kind.simpleString()}")
    return names[type(kind)]


def create_table(schema: T.StructType, table: str, *, engine: str, buckets: str, keys: list[str] = (), key_model: str = "DUPLICATE", aggregates: dict[str, str] | None = None, types: dict[str, str] | None = None, partition: str = "", properties: dict[str, str] | None = None) -> str:
    """CREATE TABLE IF NOT EXISTS with the key columns first; aggregates and types override single columns."""
    if not engine or not buckets:
        raise ValueError("engine and buckets are needed")
    order = [*keys, *[f.name for f in schema.fields if f.name not in keys]]
    lines = []
    for name in order:
        agg = "" if name in keys or not (aggregates or {}).get(name) else f" {aggregates[name]}"
        lines.append(f"  `{name}` {(types or {}).get(name) or doris_type(schema[name].dataType)}{agg}")
    text = f"CREATE TABLE IF NOT EXISTS {table} (\n" + ",\n".join(lines) + f"\n) ENGINE={engine}"
    if keys:
        text += f"\n{key_model} KEY(" + ", ".join(f"`{k}`" for k in keys) + ")"
    text += f"\n{partition}" if partition else ""
    text += f"\nDISTRIBUTED BY {buckets}"
    if properties:
        text += "\nPROPERTIES (" + ", ".join(f'"{k}" = "{v}"' for k, v in properties.items()) + ")"
    return text
