"""Statements to DataFrames: resolves names and folds operators over streams."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import operators  # noqa: F401  registers the operators
from .dialect import Statement, parse
from .registry import Context, StreamNode, find_operator
from .types import duration_ms

_WATERMARK = re.compile(r"(?is)WATERMARK\s+FOR\s+`?(\w+)`?\s+AS\s+(.*)")


def watermark(text: str) -> tuple[str, int]:
    """(column, delay in ms) of ``WATERMARK FOR c AS c - INTERVAL '3' SECOND``, ``... AS c`` or ``... AS SOURCE_WATERMARK()``."""
    found = _WATERMARK.fullmatch(text.strip())
    if not found:
        raise ValueError(f"no watermark: {text!r}")
    delay = re.search(r"(?is)-\s*INTERVAL\s*'\s*(\d+)\s*'\s*(\w+)", found[2])
    return found[1], duration_ms(f"{delay[1]} {delay[2].lower()}") if delay else 0


class Engine:
    """A session's streams, views and settings."""

    def __init__(self, spark: SparkSession, settings: dict[str, str] | None = None):
        self.spark = spark
        self.context = Context(spark, settings=dict(settings or {}))
        self.row_times: dict[str, tuple[str, int]] = {}
        self.printed: list[DataFrame] = []

    def register(self, name: str, df: DataFrame, *, seq: str | None = None, keys: tuple[str, ...] = (), row_time: str | None = None) -> None:
        """Make a DataFrame known as a stream and a view; seq names its column of arrival order."""
        self.context.streams[name] = StreamNode(df, keys, seq)
        if row_time:
            self.row_times[name] = watermark(row_time) if " " in row_time else (row_time, 0)
        df.createOrReplaceTempView(name)

    def source(self, name: str) -> StreamNode:
        if name in self.context.streams:
            return self.context.streams[name]
        return StreamNode(self.spark.table(name))

    def execute(self, text: str) -> StreamNode:
        return self.run(parse(text))

    def run(self, st: Statement) -> StreamNode:
        if st.name and st.name in self.context.streams:
            raise ValueError(f"stream {st.name} is defined twice")
        node, delay = self.source(st.source), self.row_times.get(st.source, ("", 0))[1]
        for op in st.ops:
            run, two, keyed = find_operator(op.type)
            if keyed:
                node.need_keys()
            other = self.source(op.source) if op.source else None
            if two and other is None:
                raise ValueError(f"{op.type} needs a second stream")
            options = {"delay": str(delay), **op.options}
            node = run(self.context, node, options, other)
            parallelism = int(op.options.get("parallelism", 0))
            if "parallelism" in op.options and parallelism <= 0:
                raise ValueError("parallelism is not positive")
            if parallelism and not node.df.isStreaming:
                node = node.on(node.df.repartition(parallelism, *node.keys) if node.keys else node.df.repartition(parallelism))
        if st.type == "PRINT":
            self.printed.append(node.visible())
            return node
        df = node.visible() if st.type == "VIEW" else node.df
        if "expression.watermark" in st.options:
            column, wait = watermark(st.options["expression.watermark"])
            self.row_times[st.name] = (column, wait)
            if df.isStreaming:
                df = df.withWatermark(column, f"{wait} milliseconds")
        node = node.on(df) if st.type == "STREAM" else StreamNode(df, (), node.seq if node.seq in df.columns else None)
        self.context.streams[st.name] = node
        node.visible().createOrReplaceTempView(st.name)
        return node
