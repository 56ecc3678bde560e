"""Streams, and the registries of operators and functions that user code extends."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrival order, added where a source has none.
SEQ = "_seq"


class UnknownName(LookupError):
    """No operator or function of this name is registered."""


class NotKeyed(RuntimeError):
    """An operator that works by key met a stream without KEY BY."""


@dataclass(frozen=True)
class StreamNode:
    """A DataFrame with the properties that chained operators hand on: key columns and the column of arrival order."""

    df: DataFrame
    keys: tuple[str, ...] = ()
    seq: str | None = None

    def on(self, df: DataFrame, **changes) -> StreamNode:
        return replace(self, df=df, **changes)

    def need_keys(self) -> tuple[str, ...]:
        if not self.keys:
            raise NotKeyed("stream is not a keyed stream")
        return self.keys

    def sequenced(self) -> StreamNode:
        """With a column of arrival order; without one the order of the scan counts."""
        if self.seq and self.seq in self.df.columns:
            return self
        return replace(self, df=self.df.withColumn(SEQ, F.monotonically_increasing_id()), seq=SEQ)

    def visible(self) -> DataFrame:
        return self.df.drop(SEQ)


@dataclass
class Context:
    """What operators may use: the session, the streams of the script, its settings."""

    spark: SparkSession
    streams: dict[str, StreamNode] = field(default_factory=dict)
    settings: dict[str, str] = field(default_factory=dict)

    def option(self, options: dict[str, str], name: str, default: str | None = None) -> str | None:
        """An operator's option, else the session's setting, else the default."""
        return options.get(name, self.settings.get(name, default))


Operator = Callable[[Context, StreamNode, dict[str, str], "StreamNode | None"], StreamNode]
_operators: dict[str, tuple[Operator, bool, bool]] = {}
_functions: dict[str, Operator] = {}


def operator(name: str, *, two: bool = False, keyed: bool = False):
    """Register an operator keyword; two: it takes a second stream; keyed: it needs KEY BY before it."""

    def add(f: Operator) -> Operator:
        key = " ".join(name.upper().split())
        if key in _operators:
            raise ValueError(f"operator {key} is registered twice")
        _operators[key] = (f, two, keyed)
        return f

    return add


def function(identity: str):
    """Register a function that PROCESS, MAP, FLAT MAP, FILTER, REDUCE, CONNECT, TRANSFORM or JOIN can name as identity."""

    def add(f: Operator) -> Operator:
        if identity in _functions:
            raise ValueError(f"function {identity} is registered twice")
        _functions[identity] = f
        return f

    return add


def find_operator(name: str) -> tuple[Operator, bool, bool]:
    if name not in _operators:
        raise UnknownName(f"unknown operator {name}")
    return _operators[name]


def find_function(identity: str | None) -> Operator:
    if not identity:
        raise UnknownName("option identity is missing")
    if identity not in _functions:
        raise UnknownName(f"unknown function {identity}")
    return _functions[identity]


def operator_names() -> list[str]:
    return sorted(_operators, key=len, reverse=True)
