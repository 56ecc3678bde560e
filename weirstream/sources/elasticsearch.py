"""Elasticsearch 6 sink: rows to bulk actions, by key or appended, with dynamic index names and routing."""

from __future__ import annotations

import json
import re
import urllib.request
from base64 import b64encode
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import duration_ms
from .retry import with_retries

_PATTERN = re.compile(r"\{([^{}]*)\}")


@dataclass(frozen=True)
class ElasticsearchOptions:
    index: str
    document_type: str = "_doc"
    hosts: tuple[str, ...] = ()
    function: str = "default"
    key_delimiter: str = "_"
    routing: str | None = None
    failure_handler: str = "fail"
    bulk_actions: int = 1000
    bulk_bytes: int = 2 << 20
    retries: int = 8
    interval_s: float = 0.05
    username: str = ""
    password: str = ""

    @staticmethod
    def of(o: dict[str, str]) -> ElasticsearchOptions:
        handler = o.get("failure-handler", "fail")
        if handler not in ("fail", "ignore", "retry-rejected"):
            raise ValueError(f"unknown failure-handler {handler}")
        size = o.get("sink.bulk-flush.max-size", "2mb").lower().strip()
        scale = {"kb": 1 << 10, "mb": 1 << 20, "b": 1}
        found = re.fullmatch(r"(\d+)\s*(kb|mb|b)?", size)
        return ElasticsearchOptions(
            o["index"], o.get("document-type", "_doc"), tuple(x.strip() for x in o["hosts"].split(";")), o.get("function.id", "default"), o.get("document-id.key-delimiter", "_"), o.get("routing"), handler,
            int(o.get("sink.bulk-flush.max-actions", 1000)), int(found[1]) * scale[found[2] or "b"], int(o.get("sink.bulk-flush.backoff.max-retries", 8)), duration_ms(o.get("sink.bulk-flush.backoff.delay", "50ms")) / 1000,
            o.get("username", ""), o.get("password", ""),
        )


def index_name(df: DataFrame, pattern: str, append_only: bool = True) -> Column:
    """A static name; {field}; {field|format}; or {now()|format}. A null field prints as null. One pattern at most."""
    found = _PATTERN.findall(pattern)
    if len(found) > 1:
        raise ValueError(f"only one pattern is possible in {pattern!r}")
    if not found:
        return F.lit(pattern)
    before, after = _PATTERN.split(pattern)[0], _PATTERN.split(pattern)[-1]
    name, _, form = found[0].partition("|")
    name, form = name.strip(), form.strip()
    if name.lower() in ("now()", "current_timestamp"):
        if not append_only:
            raise ValueError("an index by system time needs an append-only table")
        value = F.date_format(F.current_timestamp(), form or "yyyy_MM_dd")
    else:
        kind = df.schema[name].dataType
        if isinstance(kind, T.DateType):
            value = F.date_format(name, form or "yyyy_MM_dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(name, form or "yyyy_MM_dd_HH_mm_ss")
        else:
            if form:
                raise ValueError(f"{name} of type {kind.simpleString()} takes no format")
            value = F.col(name).cast("string")
    return F.concat(F.lit(before), F.coalesce(value, F.lit("null")), F.lit(after))


def document_id(df: DataFrame, keys: list[str], delimiter: str = "_") -> Column:
    """Key fields as text, joined; dates and times in ISO form."""
    parts = []
    for k in keys:
        kind = df.schema[k].dataType
        parts.append(F.date_format(k, "yyyy-MM-dd'T'HH:mm:ss.SSS") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else F.col(k).cast("string"))
    return F.concat_ws(delimiter, *parts)


def bulk_lines(df: DataFrame, keys: list[str], options: ElasticsearchOptions) -> DataFrame:
    """(line): the action and source of each row as newline-delimited JSON. `_op` holds the row's kind, if there.

    With a key and the default function rows become upserts by id and deletes; without, or with append_only_function, they
    are indexed. Rows before an update are dropped.
    """
    append = options.function == "append_only_function" or not keys
    fields = [c for c in df.columns if c != "_op"]
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    meta = [index_name(df, options.index, append).alias("_index"), F.lit(options.document_type).alias("_type")]
    if keys:
        meta.append(document_id(df, keys, options.key_delimiter).alias("_id"))
    if options.routing:
        meta.append(index_name(df, options.routing).alias("routing"))
    meta = F.struct(*meta)
    act = lambda name: F.to_json(F.struct(meta.alias(name)))
    write = F.concat_ws("\n", act("index"), body) if append else F.concat_ws("\n", act("update"), F.concat(F.lit('{"doc":'), body, F.lit(',"doc_as_upsert":true}')))
    if "_op" in df.columns:
        df = df.where("_op NOT IN ('UPDATE_BEFORE', '-U') OR _op IS NULL")
        write = F.when(F.col("_op").isin("DELETE", "-D"), act("delete")).otherwise(write)
    return df.select(write.alias("line"))


def write_bulk(df: DataFrame, table, options: ElasticsearchOptions) -> int:
    """Send all rows in bulk requests before the batch ends; returns the number of failed items that were ignored."""
    lines = bulk_lines(df, table.primary_key, options)

    def post(lines_: list[str], host: str) -> list[dict]:
        request = urllib.request.Request(f"{host}/_bulk", data=("\n".join(lines_) + "\n").encode(), headers={"Content-Type": "application/x-ndjson"}, method="POST")
        if options.username:
            request.add_header("Authorization", "Basic " + b64encode(f"{options.username}:{options.password}".encode()).decode())
        with urllib.request.urlopen(request, timeout=30) as reply:
            return json.loads(reply.read()).get("items", [])

    def flush(lines_: list[str], n: int) -> int:
        items = with_retries(lambda: post(lines_, options.hosts[n % len(options.hosts)]), options.retries, options.interval_s)
        bad = [i for i, x in enumerate(items) if next(iter(x.values())).get("status", 200) >= 400]
        if bad and options.failure_handler == "fail":
            raise RuntimeError(f"{len(bad)} items failed: {items[bad[0]]}")
        if bad and options.failure_handler == "retry-rejected":
            again = [lines_[i] for i in bad if next(iter(items[i].values()))["status"] == 429]
            if len(again) < len(bad):
                raise RuntimeError(f"{len(bad) - len(again)} items failed")
            return flush(again, n + 1)
        return len(bad)

    def part(frames):
        for frame in frames:
            held, size, bad, n = [], 0, 0, 0
            for line in frame["line"]:
                held.append(line)
                size += len(line)
                if len(held) >= options.bulk_actions or size >= options.bulk_bytes:
                    bad += flush(held, n)
                    held, size, n = [], 0, n + 1
            yield pd.DataFrame({"bad": [bad + (flush(held, n) if held else 0)]})

    return lines.mapInPandas(part, "bad bigint").agg(F.coalesce(F.sum("bad"), F.lit(0))).first()[0]
