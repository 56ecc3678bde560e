"""Streaming forms of the stateful operators, by transformWithState with event-time timers.

Every processor keeps rows of a key until the watermark has passed their time, then handles them in order of event time and
arrival, as the batch forms do over all rows. Rows later than the watermark are dropped by Spark before they get here.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..registry import SEQ, StreamNode
from ..types import field_list, like_event_time, millis

BLOB = T.StructType([T.StructField("blob", T.BinaryType())])
MS = "_ms"


def named(names: list[str], values: list) -> Row:
    return Row(*names)(*values)


def plain(row) -> dict:
    """A nested row as a dict, as which it may come already."""
    return {} if row is None else row if isinstance(row, dict) else row.asDict()


class Timed(StatefulProcessor):
    """Buffers rows by time; subclasses say what to do with rows that are due, given a small memo of the key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", BLOB)
        self.memo = handle.getValueState("memo", BLOB)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        least = None
        for row in rows:
            values = row.asDict()
            self.buffer.appendValue((pickle.dumps(values),))
            least = values[MS] if least is None else min(least, values[MS])
        if least is not None:
            self.handle.registerTimer(max(least, timerValues.getCurrentWatermarkInMs()) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [pickle.loads(bytes(x[0])) for x in self.buffer.get()]
        due = sorted((x for x in waiting if x[MS] <= now), key=lambda x: (x[MS], x.get(SEQ) or 0))
        later = [x for x in waiting if x[MS] > now]
        self.buffer.clear()
        for x in later:
            self.buffer.appendValue((pickle.dumps(x),))
        memo = pickle.loads(bytes(self.memo.get()[0])) if self.memo.exists() else {}
        out = list(self.due(due, memo, now))
        wake = memo.get("wake")
        if memo:
            self.memo.update((pickle.dumps(memo),))
        else:
            self.memo.clear()
        times = [x[MS] + 1 for x in later] + ([wake] if wake and wake > now else [])
        if times:
            self.handle.registerTimer(min(times))
        return iter(out)

    def due(self, rows: list[dict], memo: dict, now: int) -> Iterator[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Remembering(Timed):
    """With a lifetime of the key's memory in event time: cleaned 1.5 * ttl after the row that last set the clean-up time."""

    def __init__(self, names: list[str], ttl: int):
        self.names, self.ttl = names, ttl

    def due(self, rows, memo, now):
        for row in rows:
            if memo.get("wake") and row[MS] >= memo["wake"]:
                memo.clear()
            if not memo.get("wake") or row[MS] + self.ttl > memo["wake"]:
                memo["wake"] = row[MS] + self.ttl * 3 // 2
            if self.passes(row, memo):
                yield named(self.names, [row[n] for n in self.names])
        if memo.get("wake") and now >= memo["wake"]:
            memo.clear()

    def passes(self, row: dict, memo: dict) -> bool:
        raise NotImplementedError


class Deduplicator(Remembering):
    def __init__(self, names, ttl, asc: bool):
        super().__init__(names, ttl)
        self.asc = asc

    def due(self, rows, memo, now):
        last = {row[MS]: row for row in rows}  # of equal times the last arrival
        return super().due(list(last.values()), memo, now)

    def passes(self, row, memo):
        seen = memo.get("ms")
        if seen is None or (row[MS] < seen if self.asc else row[MS] > seen):
            memo["ms"] = row[MS]
            return True
        return False


class ChangeWatch(Remembering):
    def __init__(self, names, ttl, field: str):
        super().__init__(names, ttl)
        self.field = field

    def passes(self, row, memo):
        value = row[self.field]
        changed = "value" not in memo or memo["value"] != value
        memo["value"] = value
        return changed


class InOrder(Timed):
    """Rows in event-time order, once the watermark has reached them."""

    def __init__(self, names: list[str]):
        self.names = names

    def due(self, rows, memo, now):
        return (named(self.names, [row[n] for n in self.names]) for row in rows)


class AsOf(Timed):
    """The temporal join: left rows meet the version of the right side that is valid at their time."""

    def __init__(self, left: list[str], right: list[str], how: str, order: str, ttl: int):
        self.left, self.right, self.how, self.order, self.ttl = left, right, how, order, ttl

    def due(self, rows, memo, now):
        versions: list[tuple[int, dict]] = memo.get("versions", [])
        for row in sorted(rows, key=lambda x: (x[MS], x["_side"], x.get(SEQ) or 0)):
            if row["_side"] == 0:
                value = plain(row["_r"])
                if self.order == "LAST" or not versions or versions[0][0] == row[MS]:
                    versions = [(row[MS], value)]
                continue
            found = versions[-1][1] if versions and versions[-1][0] <= row[MS] else None
            if found is None and self.how == "INNER":
                continue
            left = plain(row["_l"])
            yield named([*self.left, *self.right], [*[left[n] for n in self.left], *[(found or {}).get(n) for n in self.right]])
        if rows:
            memo["wake"] = rows[-1][MS] + self.ttl * 3 // 2
        memo["versions"] = versions
        if memo.get("wake") and now >= memo["wake"]:
            memo.clear()


class SessionTumble(Timed):
    """Session-tumble windows: an open window, and the end of the one before while it may be continued."""

    def __init__(self, fields: list[str], values: list[str], duration: int, out: list[str]):
        self.fields, self.values, self.duration, self.out = fields, values, duration, out

    def _emit(self, memo: dict) -> Row:
        w = memo.pop("open")
        memo["ended"] = w["start"] + self.duration
        end = w["start"] + self.duration
        return named(self.out, [*w["first"], *w["series"], end, w["stamps"], w["start"]])

    def due(self, rows, memo, now):
        for row in rows:
            t = row[MS]
            if "open" in memo and t >= memo["open"]["start"] + self.duration:
                yield self._emit(memo)
            if "open" not in memo:
                ended = memo.pop("ended", None)
                start = ended if ended is not None and ended <= t < ended + self.duration else t
                memo["open"] = {"start": start, "first": [row[f] for f in self.fields], "series": [[] for _ in self.values], "stamps": []}
            w = memo["open"]
            for series, name in zip(w["series"], self.values):
                if row[name] is not None:
                    series.append(row[name])
            w["stamps"].append(t)
        if "open" in memo and now >= memo["open"]["start"] + self.duration:
            yield self._emit(memo)
        if "ended" in memo and now >= memo["ended"] + self.duration:
            memo.pop("ended")
        memo.pop("wake", None)
        if "open" in memo:
            memo["wake"] = memo["open"]["start"] + self.duration
        elif "ended" in memo:
            memo["wake"] = memo["ended"] + self.duration


class Running(StatefulProcessor):
    """Running aggregates: one row out for each row in, in order of arrival."""

    def __init__(self, names: list[str], field: str, kind: str, first: bool, keys: list[str]):
        self.names, self.field, self.kind, self.first, self.keys = names, field, kind, first, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memo = handle.getValueState("memo", BLOB)

    def handleInputRows(self, key, rows, timerValues):
        state = pickle.loads(bytes(self.memo.get()[0])) if self.memo.exists() else None
        out = []
        for row in sorted((r.asDict() for r in rows), key=lambda x: x.get(SEQ) or 0):
            state = dict(row) if state is None else self._step(state, row)
            out.append(named(self.names, [state[n] for n in self.names]))
        self.memo.update((pickle.dumps(state),))
        return iter(out)

    def _step(self, state: dict, row: dict) -> dict:
        a, b, f = state[self.field], row[self.field], self.field
        if self.kind == "sum":
            return {**state, f: b if a is None else a if b is None else a + b}
        better = b is not None and (a is None or (b < a if self.kind.startswith("min") else b > a))
        if self.kind in ("min", "max"):
            return {**state, f: b if better else a}
        return dict(row) if better or (a == b and not self.first) else state

    def close(self) -> None:
        pass


class Reducing(Running):
    """A user's binary function over rows (dicts) in order of arrival."""

    def __init__(self, names: list[str], function):
        self.names, self.function = names, function

    def _step(self, state: dict, row: dict) -> dict:
        keep = {n: state[n] for n in self.names}
        return {**state, **self.function(keep, {n: row[n] for n in self.names})}


class Rebucketing(Timed):
    """Points of session windows in tumbling windows, given out once the watermark has passed a window's end and a session's length."""

    def __init__(self, fields: list[str], values: list[str], interval: int, duration: int, out: list[str]):
        self.fields, self.values, self.interval, self.duration, self.out = fields, values, interval, duration, out

    def handleInputRows(self, key, rows, timerValues):
        memo = pickle.loads(bytes(self.memo.get()[0])) if self.memo.exists() else {}
        now = timerValues.getCurrentWatermarkInMs()
        for row in sorted((r.asDict() for r in rows), key=lambda r: r.get(SEQ) or 0):
            for i, ts in enumerate(row["_stamps"] or ()):
                start = ts // self.interval * self.interval if ts is not None else None
                if start is None or start + self.interval + self.duration <= now:
                    continue  # too late for its window
                window = memo.setdefault(start, {"first": [row[f] for f in self.fields], "stamps": [], "series": [[] for _ in self.values]})
                window["stamps"].append(ts)
                for series, name in zip(window["series"], self.values):
                    value = row[name][i] if row[name] is not None and i < len(row[name]) else None
                    if value is not None:
                        series.append(value)
        return self._left(memo, now, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        memo = pickle.loads(bytes(self.memo.get()[0])) if self.memo.exists() else {}
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for start in sorted(memo):
            if start + self.interval + self.duration <= now:
                w = memo.pop(start)
                out.append(named(self.out, [*w["first"], start + self.interval - 1, *w["series"], w["stamps"]]))
        return self._left(memo, now, out)

    def _left(self, memo: dict, now: int, out: list[Row]) -> Iterator[Row]:
        if memo:
            self.memo.update((pickle.dumps(memo),))
            self.handle.registerTimer(max(min(memo) + self.interval + self.duration, now + 1))
        else:
            self.memo.clear()
        return iter(out)


def _prepared(node: StreamNode, event_time: str) -> tuple[DataFrame, list[str]]:
    names = node.visible().columns
    df = node.df.withColumn(MS, millis(node.df, event_time))
    if node.seq and node.seq != SEQ:
        df = df.withColumn(SEQ, F.col(node.seq))
    return df, names


def _run(df: DataFrame, keys, processor: StatefulProcessor, schema, time: bool = True) -> DataFrame:
    return df.groupBy(*keys).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime" if time else "None")


def deduplicate_stream(node: StreamNode, event_time: str, asc: bool, ttl: int) -> DataFrame:
    df, names = _prepared(node, event_time)
    return _run(df, node.keys, Deduplicator(names, ttl, asc), node.visible().schema)


def watch_changed_stream(node: StreamNode, event_time: str, field: str, ttl: int) -> DataFrame:
    df, names = _prepared(node, event_time)
    return _run(df, node.keys, ChangeWatch(names, ttl, field), node.visible().schema)


def disorder_discard_stream(node: StreamNode, event_time: str) -> DataFrame:
    df, names = _prepared(node, event_time)
    return _run(df, node.keys, InOrder(names), node.visible().schema)


def running_stream(node: StreamNode, kind: str, field: str, first: bool = True) -> DataFrame:
    df = node.df.withColumn(SEQ, F.col(node.seq)) if node.seq and node.seq != SEQ else node.df
    return _run(df, node.keys, Running(node.visible().columns, field, kind, first, list(node.keys)), node.visible().schema, time=False)


def temporal_join_stream(node: StreamNode, other: StreamNode, keys, left_time: str, right_time: str, how: str, order: str, ttl: int, left_fields: str, right_fields: str) -> DataFrame:
    lf, rf = field_list(left_fields, node.visible().columns), field_list(right_fields, other.visible().columns)
    lrow, rrow = F.struct(*[F.col(a).alias(b) for a, b in lf]), F.struct(*[F.col(a).alias(b) for a, b in rf])
    named = lambda cols: [F.col(c).alias(f"k{i}") for i, c in enumerate(cols)]
    seq = lambda n: (F.col(n.seq) if n.seq else F.lit(0)).cast("bigint").alias(SEQ)
    ltype, rtype = node.df.select(lrow.alias("x")).schema[0].dataType, other.df.select(rrow.alias("x")).schema[0].dataType
    left = node.df.select(*named([a for a, _ in keys]), millis(node.df, left_time).alias(MS), F.lit(1).alias("_side"), seq(node), lrow.alias("_l"), F.lit(None).cast(rtype).alias("_r"), F.col(left_time).alias("_t"))
    right = other.df.select(*named([b for _, b in keys]), millis(other.df, right_time).alias(MS), F.lit(0).alias("_side"), seq(other), F.lit(None).cast(ltype).alias("_l"), rrow.alias("_r"), F.col(right_time).alias("_t"))
    schema = T.StructType([*ltype.fields, *[T.StructField(f.name, f.dataType, True) for f in rtype.fields]])
    return _run(left.union(right), [f"k{i}" for i in range(len(keys))], AsOf([b for _, b in lf], [b for _, b in rf], how, order, ttl), schema)


def session_tumble_stream(node: StreamNode, fields, values, event_time: str, series: str, duration: int, tolerance: int) -> DataFrame:
    """tolerance is part of the watermark's delay in streams: declare delay + tolerance there."""
    df, _ = _prepared(node, event_time)
    df = df.where(F.col(MS).isNotNull())
    kinds = {f.name: f.dataType for f in node.df.schema.fields}
    schema = T.StructType(
        [T.StructField(b, kinds[a]) for a, b in fields] + [T.StructField(b, T.ArrayType(kinds[a])) for a, b in values]
        + [T.StructField("_end", T.LongType()), T.StructField(series, T.ArrayType(T.LongType())), T.StructField("_window_start_timestamp", T.LongType())]
    )
    out = _run(df, node.keys, SessionTumble([a for a, _ in fields], [a for a, _ in values], duration, schema.names), schema)
    return out.select(*[b for _, b in [*fields, *values]], F.timestamp_millis("_end").alias(event_time), series, "_window_start_timestamp")


def reduce_stream(node: StreamNode, function) -> DataFrame:
    df = node.df.withColumn(SEQ, F.col(node.seq)) if node.seq and node.seq != SEQ else node.df
    return _run(df, node.keys, Reducing(node.visible().columns, function), node.visible().schema, time=False)


def session_to_tumble_stream(node: StreamNode, stamps, arrays, fields, values, event_time: str, series: str, interval: int, duration: int) -> DataFrame:
    """stamps and arrays: columns of the decoded series; rows whose event time is null are dropped."""
    df = node.df.withColumn(SEQ, F.col(node.seq)) if node.seq and node.seq != SEQ else node.df
    names = [f"_v{i}" for i in range(len(values))]
    df = df.where(F.col(event_time).isNotNull()).withColumn("_stamps", stamps)
    for name, array in zip(names, arrays):
        df = df.withColumn(name, array)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType(
        [T.StructField(b, kinds[a]) for a, b in fields] + [T.StructField("_end", T.LongType())] + [T.StructField(b, kinds[n]) for n, (_, b) in zip(names, values)]
        + [T.StructField(series, T.ArrayType(T.LongType()))]
    )
    out = _run(df, node.keys, Rebucketing([a for a, _ in fields], names, interval, duration, schema.names), schema)
    end = like_event_time(F.col("_end"), kinds[event_time]).alias(event_time)
    return out.select(*[b for _, b in fields], end, *[b for _, b in values], series)
