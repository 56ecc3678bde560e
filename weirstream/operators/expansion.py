"""Date and date-hour expansion: a row becomes one row for each day (hour) from its end backwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..registry import Context, StreamNode, function
from ..types import free_name, unix_seconds


def _local_bounds(node: StreamNode, options: dict) -> tuple[Column, Column]:
    """Start and end as timestamps in the option's zone. A missing current time, or an end before the start, is an error."""
    df, zone = node.df, options.get("timezone", "GMT")
    current = unix_seconds(df, options["field.current-ts"])
    current = F.when(current.isNull() | (current == 0), F.raise_error(F.lit("current time is null or 0")).cast("int")).otherwise(current)
    start, end = unix_seconds(df, options["field.start-ts"]), unix_seconds(df, options["field.end-ts"])
    end = F.when(end > 0, end).otherwise(current)
    start = F.when(start > 0, start).otherwise(F.lit(0))
    start = F.when(end < start, F.raise_error(F.lit("end time is before start time")).cast("int")).otherwise(start)
    local = lambda c: F.from_utc_timestamp(F.to_utc_timestamp(F.timestamp_seconds(c), F.current_timezone()), F.lit(zone))
    return local(start), local(end)


@function("date_expansion")
def date_expansion(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """At most max-count (2) rows, a day each, from the end's date backwards; adds `date`."""
    start, end = _local_bounds(node, options)
    most = int(options.get("max-count", 2))
    name = free_name("date", node.df.columns)
    df = node.df.withColumn("_s", F.to_date(start)).withColumn("_e", F.to_date(end))
    n = F.least(F.lit(most), F.datediff("_e", "_s") + 1)
    df = df.withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn(name, F.date_sub("_e", F.col("_i")))
    return node.on(df.drop("_s", "_e", "_i"))


@function("date_hour_expansion")
def date_hour_expansion(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """At most max-count (2) rows, a calendar hour each, from the end's hour backwards; adds `date` and `hour`."""
    start, end = _local_bounds(node, options)
    most = int(options.get("max-count", 2))
    date, hour = free_name("date", node.df.columns), free_name("hour", node.df.columns)
    df = node.df.withColumn("_s", start).withColumn("_e", end)
    n = F.datediff(F.to_date("_e"), F.to_date("_s")) * 24 + F.hour("_e") - F.hour("_s") + 1
    df = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.least(F.lit(most), n) - 1)))
    # steps in whole hours of the local calendar, free of daylight saving: days and hours are counted apart
    at = F.hour("_e") - F.col("_i")
    df = df.withColumn(date, F.date_add(F.to_date("_e"), F.floor(at / 24).cast("int"))).withColumn(hour, F.pmod(at, F.lit(24)).cast("int"))
    return node.on(df.drop("_s", "_e", "_i"))
