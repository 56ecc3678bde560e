"""Event-time operators by key: de-duplication, disorder discard, change watch, and the state lifetime they share."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import Context, StreamNode, function
from ..types import duration_ms, millis
from .folds import FIRST, by_key, with_eras

TTL = "table.exec.state.ttl"
#: Rows of a chunk of arrival numbers in the two-level running maximum.
CHUNK = 1 << 20


def _timed(node: StreamNode, options: dict) -> tuple[StreamNode, str]:
    """With `_ms`, the event time in milliseconds; a null event time is an error."""
    if "eventtime" not in options:
        raise ValueError("option eventtime is missing")
    node = node.sequenced()
    ms = millis(node.df, options["eventtime"])
    checked = F.when(ms.isNull(), F.raise_error(F.lit("event time is null")).cast("bigint")).otherwise(ms)
    return node.on(node.df.withColumn("_ms", checked)), options["eventtime"]


@function("deduplicate")
def deduplicate(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """The earliest row of a key (order.type ASC) or the latest (DESC); equal times: the last arrival.

    With a state lifetime the earliest or latest of each era of a key's state. `emit`='running' gives, for DESC, every row later than all before it in
    arrival order, as a stream with one row for each watermark does.
    """
    keys = node.need_keys()
    asc = options.get("order.type", "ASC").upper() == "ASC"
    ttl = ctx.option(options, TTL)
    if node.df.isStreaming:
        from ..streaming.processors import deduplicate_stream

        return node.on(deduplicate_stream(node, options["eventtime"], asc, duration_ms(ttl or "2 min")))
    node, _ = _timed(node, options)
    names = [c for c in node.df.columns if c != "_ms"]
    if not asc and options.get("emit") == "running":
        before = W.partitionBy(*keys).orderBy(node.seq).rowsBetween(W.unboundedPreceding, -1)
        later = F.coalesce(F.col("_ms") > F.max("_ms").over(before), F.lit(True))
        return node.on(node.df.withColumn("_later", later).where("_later").select(*names))
    if ttl:
        eras = with_eras(by_key(node.df, keys, "_ms", node.seq, _next=F.lead("_ms")), duration_ms(ttl))
        if asc:  # of the rows of an era's first time the last
            return node.on(eras.where("_ms = _era_ms AND (_next IS NULL OR _next <> _ms)").select(*names))
        latest = W.partitionBy(*keys, "_era_ms").orderBy(F.desc("_ms"), F.desc(node.seq))
        return node.on(eras.withColumn("_n", F.row_number().over(latest)).where("_n = 1").select(*names))
    order = W.partitionBy(*keys).orderBy(F.col("_ms") if asc else F.desc("_ms"), F.desc(node.seq))
    return node.on(node.df.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*names))


@function("field_value_watch_changed_emitter")
def watch_changed(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """A key's first row in event time and every row whose `watch.field` differs from the row before (nulls compare equal)."""
    keys = node.need_keys()
    field, ttl = options["watch.field"], ctx.option(options, TTL)
    if node.df.isStreaming:
        from ..streaming.processors import watch_changed_stream

        return node.on(watch_changed_stream(node, options["eventtime"], field, duration_ms(ttl or "2 min")))
    node, _ = _timed(node, options)
    names = [c for c in node.df.columns if c != "_ms"]
    df = by_key(node.df, keys, "_ms", node.seq, _before=F.lag(field))
    fresh = FIRST
    if ttl:
        df, fresh = with_eras(df, duration_ms(ttl)), "_era_first"
    return node.on(df.where(F.col(fresh) | ~F.col(field).eqNullSafe(F.col("_before"))).select(*names))


@function("disorder_discard")
def disorder_discard(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """Drop rows older than the watermark: the greatest time that arrived before, over all keys, less `delay`.

    The watermark is global, so the running maximum has no partition. It is taken in two levels: maxima of chunks of arrival
    numbers, their running maximum (a row a chunk), then the running maximum inside each chunk.
    """
    node.need_keys()
    if node.df.isStreaming:
        from ..streaming.processors import disorder_discard_stream

        return node.on(disorder_discard_stream(node, options["eventtime"]))
    node, _ = _timed(node, options)
    names = [c for c in node.df.columns if c != "_ms"]
    delay = duration_ms(ctx.option(options, "delay", "0"))
    df = node.df.withColumn("_chunk", F.floor(F.col(node.seq).cast("bigint") / CHUNK))
    tops = df.groupBy("_chunk").agg(F.max("_ms").alias("_top"))
    tops = tops.select(F.col("_chunk").alias("_c"), F.max("_top").over(W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    inside = W.partitionBy("_chunk").orderBy(node.seq).rowsBetween(W.unboundedPreceding, -1)
    df = df.join(tops, df["_chunk"] == tops["_c"]).withColumn("_wm", F.greatest(F.max("_ms").over(inside), "_before") - delay)
    return node.on(df.where("_wm IS NULL OR _ms >= _wm").select(*names))
