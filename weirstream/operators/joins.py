"""Joins of two streams: as-of (temporal), interval, windowed, and generic connection."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import Context, StreamNode, find_function, function, operator
from ..types import duration_ms, field_list, millis
from .events import TTL


def _same_keys(left: StreamNode, right: StreamNode) -> list[tuple[str, str]]:
    a, b = left.need_keys(), right.need_keys()
    if len(a) != len(b):
        raise ValueError("both streams need as many key columns")
    return list(zip(a, b))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_time: str, right_time: str, *, left_fields="*", right_fields="*", how="INNER", order="LAST", right_seq: str | None = None) -> DataFrame:
    """Each left row with the right row of its key that is valid at its time.

    LAST: the right row of greatest time <= the left time. FIRST: the key's earliest right row, if its time is <= the left
    time. Right rows of equal key and time: the last arrival. Both sides are tagged and stacked, and one window by key and
    time carries the right row forward: one shuffle, no non-equi join, and a key's rows stream through sorted.
    """
    lf, rf = field_list(left_fields, [c for c in left.columns if not c.startswith("_")]), field_list(right_fields, [c for c in right.columns if not c.startswith("_")])
    lk, rk = [F.col(a) for a, _ in keys], [F.col(b) for _, b in keys]
    left_row, right_row = F.struct(*[F.col(a).alias(f"f{i}") for i, (a, _) in enumerate(lf)]), F.struct(*[F.col(a).alias(f"f{i}") for i, (a, _) in enumerate(rf)])
    time = lambda df, c: F.when(millis(df, c).isNull(), F.raise_error(F.lit("event time is null")).cast("bigint")).otherwise(millis(df, c))
    named = lambda ks: [k.alias(f"k{i}") for i, k in enumerate(ks)]
    arrival = F.col(right_seq) if right_seq else F.monotonically_increasing_id()
    l_ = left.select(*named(lk), time(left, left_time).alias("ms"), F.lit(1).alias("side"), F.lit(0).cast("bigint").alias("seq"), left_row.alias("l"))
    r_ = right.select(*named(rk), time(right, right_time).alias("ms"), F.lit(0).alias("side"), arrival.cast("bigint").alias("seq"), right_row.alias("r"))
    both = l_.unionByName(r_, allowMissingColumns=True)
    w = W.partitionBy(*[f"k{i}" for i in range(len(keys))]).orderBy("ms", "side", "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    if order.upper() == "LAST":
        found = F.last("r", ignorenulls=True).over(w)
    else:
        # the earliest right time, and of its rows the last arrival: equal times sort by arrival
        found = F.max_by("r", F.when(F.col("r").isNotNull(), F.struct(-F.col("ms"), F.col("seq")))).over(w)
    joined = both.withColumn("r", found).where("side = 1")
    if how.upper() == "INNER":
        joined = joined.where("r IS NOT NULL")
    names = [b for _, b in lf]
    out = [F.col(f"l.f{i}").alias(b) for i, (_, b) in enumerate(lf)]
    for i, (_, b) in enumerate(rf):
        out.append(F.col(f"r.f{i}").alias(b))
        names.append(b)
    if len(set(names)) < len(names):
        raise ValueError(f"output fields are not distinct: {names}")
    return joined.select(*out)


@function("temporal_join")
def temporal_join(ctx: Context, node: StreamNode, options: dict, other: StreamNode | None = None) -> StreamNode:
    keys = _same_keys(node, other)
    how, order = options.get("join.type", "INNER").upper(), options.get("right.order.type", "LAST").upper()
    if how not in ("INNER", "LEFT") or order not in ("FIRST", "LAST"):
        raise ValueError(f"temporal_join takes INNER or LEFT and FIRST or LAST, not {how} and {order}")
    fields = {"left_fields": options.get("left.output.fields", "*"), "right_fields": options.get("right.output.fields", "*")}
    if node.df.isStreaming:
        from ..streaming.processors import temporal_join_stream

        return StreamNode(temporal_join_stream(node, other, keys, options["left.eventtime"], options["right.eventtime"], how, order, duration_ms(ctx.option(options, TTL, "2 min")), **fields))
    return StreamNode(as_of_join(node.df, other.df, keys, options["left.eventtime"], options["right.eventtime"], how=how, order=order, right_seq=other.seq, **fields))


@operator("CONNECT", two=True)
def connect(ctx: Context, node: StreamNode, options: dict, other: StreamNode | None = None) -> StreamNode:
    """A function over two streams, such as temporal_join, or a registered co-process function by key."""
    if options.get("identity") in co_processes:
        return _co_process(node, other, *co_processes[options["identity"]])
    return find_function(options.get("identity"))(ctx, node, options, other)


#: Co-process functions: (left rows, right rows) of a key as pandas frames to one frame, with its schema.
co_processes: dict[str, tuple[Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], str]] = {}


def co_process(identity: str, schema: str):
    def add(f):
        co_processes[identity] = (f, schema)
        return f

    return add


def _co_process(node: StreamNode, other: StreamNode, f, schema: str) -> StreamNode:
    keys = _same_keys(node, other)
    return StreamNode(node.df.groupBy(*[a for a, _ in keys]).cogroup(other.df.groupBy(*[b for _, b in keys])).applyInPandas(f, schema))


def _sided(node: StreamNode, other: StreamNode) -> tuple[DataFrame, DataFrame]:
    return node.visible().alias("l"), other.visible().alias("r")


def _picked(options: dict, left: DataFrame, right: DataFrame) -> list:
    lf, rf = field_list(options.get("left.output.fields", "*"), left.columns), field_list(options.get("right.output.fields", "*"), right.columns)
    taken = {b for _, b in lf}
    return [F.col(f"l.{a}").alias(b) for a, b in lf] + [F.col(f"r.{a}").alias(b) for a, b in rf if b not in taken]


@operator("INTERVAL JOIN", two=True, keyed=True)
def interval_join(ctx: Context, node: StreamNode, options: dict, other: StreamNode | None = None) -> StreamNode:
    """Pairs of a key whose right time lies in [left + lower, left + upper]; inner. With `identity`, a registered function."""
    if "identity" in options:
        return find_function(options["identity"])(ctx, node, options, other)
    keys = _same_keys(node, other)
    left, right = _sided(node, other)
    return StreamNode(_interval(left, right, keys, options["left.eventtime"], options["right.eventtime"], _signed(options["lower"]), _signed(options["upper"])).select(*_picked(options, left, right)))


def _signed(text: str) -> int:
    text = str(text).strip()
    return -duration_ms(text[1:]) if text.startswith("-") else duration_ms(text)


def _interval(left: DataFrame, right: DataFrame, keys, left_time: str, right_time: str, lower: int, upper: int) -> DataFrame:
    """A range join by time buckets as wide as the interval: the equi-join key is (key, bucket), so a hot key is spread over
    its buckets, and each right row meets at most two of them. Streams keep the plain condition that their state needs."""
    on = [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in keys]
    if left.isStreaming or right.isStreaming:
        a, b = F.col(f"l.{left_time}"), F.col(f"r.{right_time}")
        return left.join(right, [*on, b >= a + F.expr(f"INTERVAL {lower} MILLISECONDS"), b <= a + F.expr(f"INTERVAL {upper} MILLISECONDS")])
    width = max(upper - lower, 1)
    names = [c for c in left.columns], [c for c in right.columns]
    left = left.withColumn("_lm", millis(left, left_time)).withColumn("_bucket", F.floor((F.col("_lm") + lower) / width))
    right = right.withColumn("_rm", millis(right, right_time)).withColumn("_own", F.floor(F.col("_rm") / width))
    right = right.withColumn("_bucket", F.explode(F.array(F.col("_own") - 1, F.col("_own"))))
    l_, r_ = left.alias("l"), right.alias("r")
    return l_.join(r_, [*on, F.col("l._bucket") == F.col("r._bucket"), F.col("r._rm").between(F.col("l._lm") + lower, F.col("l._lm") + upper)])


@operator("JOIN", two=True)
def window_join(ctx: Context, node: StreamNode, options: dict, other: StreamNode | None = None) -> StreamNode:
    """Inner equi-join of rows in the same tumbling window: `where`, `equal.to`, `window.size` and event times; or `identity`."""
    if "identity" in options:
        return find_function(options["identity"])(ctx, node, options, other)
    left, right = _sided(node, other)
    size = duration_ms(options["window.size"])
    mine, theirs = options.get("where", ",".join(node.keys)), options.get("equal.to", ",".join(other.keys))
    keys = list(zip([x.strip() for x in mine.split(",")], [x.strip() for x in theirs.split(",")]))
    picked = _picked(options, left, right)
    if left.isStreaming or right.isStreaming:
        left = left.withColumn("_w", F.window(options["left.eventtime"], f"{size} milliseconds")).alias("l")
        right = right.withColumn("_w", F.window(options["right.eventtime"], f"{size} milliseconds")).alias("r")
    else:
        left = left.withColumn("_w", F.floor(millis(left, options["left.eventtime"]) / size)).alias("l")
        right = right.withColumn("_w", F.floor(millis(right, options["right.eventtime"]) / size)).alias("r")
    on = [F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in keys]
    return StreamNode(left.join(right, [*on, F.col("l._w") == F.col("r._w")]).select(*picked))
