"""Field lists, option parsing and time coercion shared by all operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FieldError(ValueError):
    """A field list names a column that is not there."""


def field_list(text: str | None, columns: list[str]) -> list[tuple[str, str]]:
    """Parse ``'a, b AS c'`` or ``'*'`` into (column, output name) pairs.

    Elements are split on commas, trimmed and made distinct; any element ``*`` means all columns; the alias separator is
    `` AS `` in capitals. None gives no fields.
    """
    if text is None:
        return []
    items = list(dict.fromkeys(x.strip() for x in text.split(",")))
    if "*" in items:
        return [(c, c) for c in columns]
    out = []
    for item in items:
        name, _, alias = item.partition(" AS ")
        name, alias = name.strip(), (alias or name).strip()
        if name not in columns:
            raise FieldError(f"field not found: {name}")
        out.append((name, alias))
    return out


def select_fields(df: DataFrame, text: str) -> list[Column]:
    return [df[a].alias(b) for a, b in field_list(text, df.columns)]


def free_name(name: str, taken: list[str]) -> str:
    """name, or name1, name2, ... if taken."""
    i, out = 0, name
    while out in taken:
        i += 1
        out = f"{name}{i}"
    return out


def kind_of(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def millis(df: DataFrame, column: str) -> Column:
    """Epoch milliseconds of an event-time column: timestamps with or without zone (as UTC), BIGINT milliseconds, INT seconds."""
    kind, c = kind_of(df, column), F.col(column)
    if isinstance(kind, T.TimestampType):
        return F.unix_millis(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_millis(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()))
    if isinstance(kind, T.LongType):
        return c
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        return c.cast("bigint") * 1000
    raise TypeError(f"{column} of type {kind.simpleString()} is no event time")


def unix_seconds(df: DataFrame, column: str) -> Column:
    """Unix seconds as INT: INT as it is, BIGINT milliseconds and timestamps divided by 1000 towards zero; null stays null."""
    kind = kind_of(df, column)
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        return F.col(column).cast("int")
    m = millis(df, column)
    return (F.signum(m) * F.floor(F.abs(m) / 1000)).cast("bigint").cast("int")


def like_event_time(value: Column, kind: T.DataType) -> Column:
    """Milliseconds back to the type of the event-time column."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_millis(value)
    if isinstance(kind, T.TimestampNTZType):
        return F.from_utc_timestamp(F.timestamp_millis(value), F.current_timezone()).cast("timestamp_ntz")
    return value if isinstance(kind, T.LongType) else (value / 1000).cast(kind)


_UNITS = {
    "ms": 1, "milli": 1, "millis": 1, "millisecond": 1, "milliseconds": 1,
    "s": 1000, "sec": 1000, "secs": 1000, "second": 1000, "seconds": 1000,
    "m": 60_000, "min": 60_000, "minute": 60_000, "minutes": 60_000,
    "h": 3_600_000, "hour": 3_600_000, "hours": 3_600_000,
    "d": 86_400_000, "day": 86_400_000, "days": 86_400_000,
}


def duration_ms(text: str | int) -> int:
    """``'10 s'``, ``'1min'``, ``'2 d'`` or plain milliseconds."""
    found = re.fullmatch(r"\s*(\d+)\s*([a-zA-Z]*)\s*", str(text))
    if not found or found[2].lower() not in {"", *_UNITS}:
        raise ValueError(f"no duration: {text!r}")
    return int(found[1]) * _UNITS.get(found[2].lower() or "ms", 1)


def top_level_split(text: str, mark: str = ",", brackets: str = "([{)]}") -> list[str]:
    """Split outside of brackets and quotes."""
    half = len(brackets) // 2
    out, depth, quote, last = [], 0, "", 0
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in brackets[:half]:
            depth += 1
        elif ch in brackets[half:]:
            depth -= 1
        elif ch == mark and not depth:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]] if x.strip()]
