"""Session-tumble windows, and their re-bucketing into epoch-aligned tumbling windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.series import decode_column
from ..registry import Context, StreamNode, function
from ..types import duration_ms, field_list, free_name, kind_of, like_event_time, millis
from .folds import by_key, window_rows

START = "_window_start_timestamp"


@function("session_tumble_window")
def session_tumble_window(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """One row for each window: `fields` of its first row, `values` as arrays in time order, event time = window end, the
    series of times in milliseconds, and the window's start. Rows without event time are skipped; null values add nothing.
    """
    keys, duration = list(node.need_keys()), duration_ms(options["session.duration"])
    names = node.visible().columns
    fields, values = field_list(options["fields"], names), field_list(options.get("values"), names)
    time, series = options["eventtime"], options.get("time-series.name", "time_series")
    kind = kind_of(node.df, time)
    if node.df.isStreaming:
        from ..streaming.processors import session_tumble_stream

        return StreamNode(session_tumble_stream(node, fields, values, time, series, duration, duration_ms(options.get("disorder.max-tolerance.duration", "0"))))
    node = node.sequenced()
    df = node.df.withColumn("_ms", millis(node.df, time)).where("_ms IS NOT NULL")
    packed = window_rows(by_key(df, keys, "_ms", node.seq), [a for a, _ in fields], [a for a, _ in values], duration)
    out = [F.col(f"f{i}").alias(b) for i, (_, b) in enumerate(fields)] + [F.col(f"v{i}").alias(b) for i, (_, b) in enumerate(values)]
    end = like_event_time(F.col("_start") + duration, kind).alias(time if time not in {b for _, b in fields + values} else free_name(time, [b for _, b in fields + values]))
    return StreamNode(packed.select(*out, end, F.col("_times").alias(series), F.col("_start").alias(START)))


def _sorted(rows: Column, kinds: list) -> Column:
    """Rows in the order of their fields o1 and o2, which are distinct; by plain sorting where the other fields have an order."""
    return F.array_sort(rows, _by_order) if any("map<" in k.simpleString() for k in kinds) else F.sort_array(rows)


def _by_order(a: Column, b: Column) -> Column:
    return F.when(a["o1"] < b["o1"], -1).when(a["o1"] > b["o1"], 1).when(a["o2"] < b["o2"], -1).when(a["o2"] > b["o2"], 1).otherwise(0)


@function("session_tumble_2_tumble_window")
def session_to_tumble(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """Deal the points of session windows into tumbling windows of `tumble.interval`, aligned with the epoch.

    Series may be arrays or packed bytes (then `values.origin-type` names one type a value). Event time is the window's end
    less a millisecond; `fields` are those of the first row that falls into the window.
    """
    keys, interval = list(node.need_keys()), duration_ms(options["tumble.interval"])
    node = node if node.df.isStreaming else node.sequenced()
    names = node.visible().columns
    fields, values = field_list(options["fields"], names), field_list(options.get("values"), names)
    time, series = options["eventtime"], options.get("time-series.name", "time_series")
    types = [x.strip() for x in options.get("values.origin-type", "").split(",") if x.strip()]
    if values and not types and any(kind_of(node.df, a).typeName() == "binary" for a, _ in values):
        raise ValueError("values.origin-type needs one type for each value")
    df = node.df.where(F.col(time).isNotNull())
    stamps = decode_column(df, series, "BIGINT")
    arrays = [decode_column(df, a, types[i] if i < len(types) else None) for i, (a, _) in enumerate(values)]
    if node.df.isStreaming:
        from ..streaming.processors import session_to_tumble_stream

        return StreamNode(session_to_tumble_stream(node, stamps, arrays, fields, values, time, series, interval, duration_ms(options["session.duration"])))
    zipped = F.arrays_zip(stamps.alias("ts"), *[x.alias(f"v{i}") for i, x in enumerate(arrays)])
    points = df.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(node.seq).alias("o"), *[F.col(a).alias(f"f{i}") for i, (a, _) in enumerate(fields)],
        F.posexplode(F.transform(zipped, lambda z: F.struct(z["ts"].alias("ts"), *[z[f"v{i}"].alias(f"v{i}") for i in range(len(values))]))).alias("p", "z"),
    )
    start = F.expr(f"(z.ts div {interval}) * {interval}")
    points = points.where("z.ts IS NOT NULL").withColumn("_start", start)
    row = F.struct(F.col("z.ts").alias("o1"), F.struct("o", "p").alias("o2"), F.col("z"), *[f"f{i}" for i in range(len(fields))])
    packed = points.groupBy(*[f"k{i}" for i in range(len(keys))], "_start").agg(_sorted(F.collect_list(row), [f.dataType for f in points.schema.fields]).alias("_rows"))
    out = [F.element_at("_rows", 1)[f"f{i}"].alias(b) for i, (_, b) in enumerate(fields)]
    out.append(like_event_time(F.col("_start") + interval - 1, kind_of(node.df, time)).alias(time))
    for i, (_, b) in enumerate(values):
        out.append(F.filter(F.transform("_rows", _inner(f"v{i}")), lambda x: x.isNotNull()).alias(b))
    return StreamNode(packed.select(*out, F.transform("_rows", _inner("ts")).alias(series)))


def _inner(name: str):
    return lambda r: r["z"][name]
