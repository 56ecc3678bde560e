"""Runs scripts: SET, CREATE TABLE ... WITH, CREATE FUNCTION, views, INSERT INTO, and the dialect's statements."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from importlib import import_module
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialect import ParseError, parse
from ..engine import Engine, watermark
from ..functions import scalar, series
from ..plans.sqlcompat import CREATABLE, closing, rewrite_expression, rewrite_query
from ..sources import TableDef, open_source, write_sink
from ..types import top_level_split
from .text import prepare, split_statements


class Unsupported(ValueError):
    """A statement that scripts do not take."""


#: Last part of a function's class path, lower-cased, to the built-in function it stands for, where names differ.
CLASSES = {
    "totimestamp3": "to_timestamp", "tolongtimestamp": "to_long_timestamp", "timestamp2date": "to_date", "timestamp2hour": "to_hour", "hashcode": "hash_code", "lineseparator": "line_separator",
    "percentiletemporary": "percentile_temporary", "hyperloglogtemporary": "hyper_log_log_temporary", "hyperloglog": "hyper_log_log",
    **{f"session{k}valuecollect": f"session_{k}_collect" for k in series.COLLECTS},
}


class Insert(NamedTuple):
    """A sink's name, what goes there, and whether it replaces what is there."""

    name: str
    df: DataFrame
    overwrite: bool = False


@dataclass
class Result:
    """What a script leaves: its engine, printed frames, and its sinks with what they started."""

    engine: Engine
    printed: list[DataFrame] = field(default_factory=list)
    inserts: list[Insert] = field(default_factory=list)
    started: list = field(default_factory=list)


_SET = re.compile(r"(?is)SET\s+'([^']*)'\s*=\s*'([^']*)'")
_TABLE = re.compile(r"(?is)CREATE\s+(?:TEMPORARY\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.`]+)\s*")
_TABLE_REST = re.compile(r"(?is)\s*(?:COMMENT\s+'[^']*'\s*)?(?:PARTITIONED\s+BY\s*\(([^)]*)\)\s*)?WITH\s*\((.*)\)")
_FUNCTION = re.compile(r"(?is)CREATE\s+(?:TEMPORARY\s+)?(?:SYSTEM\s+)?FUNCTION\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.]+)\s+AS\s+'([^']+)'(?:\s+LANGUAGE\s+\w+)?")
_TEMPORAL = re.compile(r"(?is)CREATE\s+TEMPORARY\s+TABLE\s+FUNCTION\s+(\w+)\s+KEY\s+(\w+)\s+TIMESTAMP\s+(\w+)\s+FROM\s+([\w.]+)")
_VIEW = re.compile(r"(?is)CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMPORARY\s+)?VIEW\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.`]+)\s*(?:\(([^)]*)\)\s*)?AS\s+(.*)")
_INSERT = re.compile(r"(?is)INSERT\s+(INTO|OVERWRITE)\s+([\w.`]+)\s*(?:\(([^)]*)\))?\s*((?:SELECT|WITH|VALUES)\b.*)")


def _names(text: str) -> list[str]:
    """A list of column names; comments after them are dropped."""
    return [re.match(r"`?([^`\s]+)`?", x)[1] for x in top_level_split(text)]


def _pairs(text: str) -> dict[str, str]:
    out = {}
    for item in top_level_split(text):
        m = re.fullmatch(r"(?s)'((?:[^']|'')*)'\s*=\s*'((?:[^']|'')*)'", item)
        if not m:
            raise ParseError(f"no option: {item!r}")
        out[m[1]] = m[2].replace("''", "'")
    return out


#: DDL type names that differ from Spark's.
_TYPES = [(r"(?i)\bTIMESTAMP_LTZ\s*(?:\(\d+\))?", "TIMESTAMP"), (r"(?i)\bTIMESTAMP\s*\(\d+\)(?:\s+WITH\s+LOCAL\s+TIME\s+ZONE)?", "TIMESTAMP"), (r"(?i)\b(VARCHAR|CHAR)\s*\(\d+\)", "STRING"), (r"(?i)\b(VARBINARY|BYTES)\b(\s*\(\d+\))?", "BINARY"), (r"(?i)\bROW\s*<", "STRUCT<")]


def table_definition(text: str) -> TableDef:
    """Parse CREATE TABLE: columns, computed and metadata columns, WATERMARK, PRIMARY KEY, partitions, options."""
    text = text.strip().rstrip(";")
    m, columns = _TABLE.match(text), ""
    rest = text[m.end() :] if m else ""
    if rest.startswith("("):
        end = closing(rest, 0)
        columns, rest = rest[1:end], rest[end + 1 :]
    tail = _TABLE_REST.fullmatch(rest)
    if not m or not tail:
        raise ParseError(f"no CREATE TABLE ... WITH: {text[:60]!r}")
    out = TableDef(m[1].strip("`"), options=_pairs(tail[2]), partitions=[x.strip(" `") for x in (tail[1] or "").split(",") if x.strip()])
    for item in top_level_split(columns, brackets="([<)]>"):
        upper = item.upper()
        if upper.startswith("WATERMARK"):
            out.watermark = item
        elif upper.startswith(("PRIMARY KEY", "CONSTRAINT")):
            out.primary_key = [x.strip(" `") for x in re.search(r"\(([^)]*)\)", item)[1].split(",")]
        else:
            name, rest = re.match(r"(?s)`?([\w]+)`?\s+(.*)", item).groups()
            computed = re.match(r"(?is)AS\s+(.*)", rest)
            if computed:
                out.computed.append((name, computed[1]))
                continue
            meta = re.search(r"(?is)\bMETADATA(?:\s+FROM\s+'([^']*)')?(?:\s+VIRTUAL)?", rest)
            if meta:
                out.metadata[name] = meta[1] or name
                rest = rest[: meta.start()]
            rest = re.sub(r"(?is)\s+(NOT\s+)?NULL\b|\s+PRIMARY\s+KEY.*|\s+COMMENT\s+'[^']*'", lambda x: "", rest)
            for pattern, to in _TYPES:
                rest = re.sub(pattern, to, rest)
            if "STRUCT<" in rest:
                rest = re.sub(r"(?<=[<,])\s*`?(\w+)`?\s+(?=[A-Za-z])", r"\1:", rest)
            out.columns.append((name, rest.strip()))
    return out


class Runner:
    def __init__(self, spark: SparkSession, settings: dict[str, str] | None = None):
        self.spark, self.engine = spark, Engine(spark, settings)
        self.tables: dict[str, TableDef] = {}
        self.created: set[str] = set()
        self.lookups: dict[str, tuple[str, str, str]] = {}
        self.table_functions: set[str] = set()
        self.result = Result(self.engine)

    def run(self, statement: str) -> None:
        """Base SQL first; what it does not take, the dialect gets; if that fails too, the first error counts."""
        try:
            self._base(statement)
        except Unsupported as first:
            try:
                parsed = parse(statement)
            except ParseError as second:
                raise (second if re.match(r"(?is)\s*(CREATE\s+(STREAM|VIEW)|PRINT)\b", statement) else first) from None
            self._ensure(parsed.source)
            for op in parsed.ops:
                if op.source:
                    self._ensure(op.source)
            self.engine.run(parsed)
            self.result.printed = self.engine.printed

    def _base(self, text: str) -> None:
        if m := _SET.fullmatch(text):
            if not m[1] or not m[2]:
                raise ValueError("SET needs a key and a value")
            key = m[1].removeprefix("jobparam.")
            self.engine.context.settings[m[1]] = m[2]
            if key != m[1]:
                self.spark.conf.set(m[1], m[2])
        elif m := _TEMPORAL.fullmatch(text):
            self.lookups[m[1]] = (m[2], m[3], m[4])
        elif re.match(r"(?is)CREATE\s+(TEMPORARY\s+)?TABLE\b", text):
            if (t := table_definition(text)).name in self.tables:
                if re.match(r"(?is)CREATE\s+(TEMPORARY\s+)?TABLE\s+IF\s+NOT", text):
                    return
                raise ValueError(f"table {t.name} is defined twice")
            self.tables[t.name] = t
        elif m := _FUNCTION.fullmatch(text):
            self._function(m[1], m[2])
        elif re.match(r"(?is)CREATE\s+VIEW\s+\S+\s+(WITH\s*\(|FROM\b)", text):
            raise Unsupported(text)
        elif m := _VIEW.fullmatch(text):
            df = self.sql(m[3])
            if m[2] is not None:
                names = _names(m[2])
                if len(names) != len(df.columns):
                    raise ValueError(f"view {m[1]} names {len(names)} columns of {len(df.columns)}")
                df = df.toDF(*names)
            df.createOrReplaceTempView(m[1].strip("`"))
        elif m := _INSERT.fullmatch(text):
            name, overwrite = m[2].strip("`"), m[1].upper() == "OVERWRITE"
            if name not in self.tables:
                raise ValueError(f"unknown table {name}")
            df = self.sql(m[4])
            if overwrite and df.isStreaming:
                raise ValueError("a stream cannot overwrite a table")
            if m[3] is not None:
                df = self._arranged(self.tables[name], df, _names(m[3]))
            self.result.inserts.append(Insert(name, df, overwrite))
        elif m := re.fullmatch(r"(?is)CREATE\s+CATALOG\s+(\w+)\s+WITH\s*\((.*)\)", text):
            self.engine.context.settings |= {f"catalog.{m[1]}.{k}": v for k, v in _pairs(m[2]).items()}
        elif m := re.fullmatch(r"(?is)CREATE\s+DATABASE\s+(?:IF\s+NOT\s+EXISTS\s+)?([\w.]+)", text):
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {m[1].split('.')[-1]}")
        elif m := re.fullmatch(r"(?is)USE\s+CATALOG\s+(\w+)", text):
            self.engine.context.settings["catalog"] = m[1]
        elif m := re.fullmatch(r"(?is)USE\s+([\w.]+)", text):
            self.spark.catalog.setCurrentDatabase(m[1].split(".")[-1])
        else:
            raise Unsupported(f"statement is not supported: {text[:80]}")

    @staticmethod
    def _arranged(t: TableDef, df: DataFrame, names: list[str]) -> DataFrame:
        """The columns of a row by the names of an INSERT's list, in the order of the table; those not named are null."""
        if len(names) != len(df.columns) or len(set(names)) < len(names):
            raise ValueError(f"INSERT INTO {t.name} names {names} for {len(df.columns)} columns")
        df, types = df.toDF(*names), dict(t.columns)
        if not types:
            return df
        if unknown := [n for n in names if n not in types]:
            raise ValueError(f"table {t.name} has no columns {unknown}")
        return df.select(*[F.col(n) if n in names else F.lit(None).cast(kind).alias(n) for n, kind in types.items()])

    def _function(self, name: str, path: str) -> None:
        last = path.rpartition(".")[2].lower()
        builtin = name if name in CREATABLE or name in ("hash_code",) or name in {f"session_{k}_collect" for k in series.COLLECTS} else CLASSES.get(last, last)
        if builtin in CREATABLE:
            self.created.add(builtin)
        elif builtin == "hash_code":
            seed = int(self.engine.context.settings.get("jobparam.hashcode.seed", scalar.HASH_SEED))
            self.spark.udf.register(name, scalar.hash_code_function(seed))
        elif (kind := re.fullmatch(r"session_(\w+)_collect", builtin)) and kind[1] in series.COLLECTS:
            self.spark.udf.register(name, series.collect_function(kind[1]))
        else:
            module, _, attribute = path.rpartition(".")
            f = getattr(import_module(module), attribute)
            if type(f).__name__ == "UserDefinedTableFunction":
                self.spark.udtf.register(name, f)
                self.table_functions.add(name)
            else:
                self.spark.udf.register(name, f)

    def _ensure(self, name: str) -> None:
        """Open a declared table when it is first read."""
        if name in self.tables and name not in self.engine.context.streams:
            t = self.tables[name]
            df = open_source(self.spark, t)
            for column, expression in t.computed:
                df = df.withColumn(column, F.expr(rewrite_expression(expression, self.created)))
            mark = t.watermark or t.options.get("watermark")
            if mark:
                column, delay = watermark(mark)
                if df.isStreaming:
                    df = df.withWatermark(column, f"{delay} milliseconds")
            self.engine.register(name, df, seq=t.options.get("sequence.field"), row_time=mark)

    def sql(self, text: str) -> DataFrame:
        for name in self.tables:
            if re.search(rf"(?i)(?<![\w.]){re.escape(name)}(?!\w)", text):
                self._ensure(name)
        text = self._lookup(text)
        times = {k: v[0] for k, v in self.engine.row_times.items()}
        return self.spark.sql(rewrite_query(self.spark, text, self.created, times, settings=self.engine.context.settings, tables=self.table_functions))

    def _lookup(self, text: str) -> str:
        """A temporal table function, LATERAL TABLE(f(l.ts)) AS r WHERE l.k = r.k, as FOR SYSTEM_TIME AS OF."""
        m = re.search(r"(?is)FROM\s+(\w+)(?:\s+AS)?\s+(\w+)\s*,\s*LATERAL\s+TABLE\s*\(\s*(\w+)\s*\(([\w.]+)\)\s*\)\s+(?:AS\s+)?(\w+)\s+WHERE\s+([\w.]+\s*=\s*[\w.]+)", text)
        if not m or m[3] not in self.lookups:
            return text
        _, time, table = self.lookups[m[3]]
        self._ensure(table)
        self.engine.row_times.setdefault(table, (time, 0))
        return text[: m.start()] + f"FROM {m[1]} AS {m[2]} JOIN {table} FOR SYSTEM_TIME AS OF {m[4]} AS {m[5]} ON {m[6]}" + re.sub(r"(?i)^\s*AND\b", " WHERE", text[m.end() :])


def run_script(spark: SparkSession, text: str, settings: list[str] | None = None, *, values: dict[str, str] | None = None, strict: bool = False, start: bool = True) -> Result:
    """Run a script; settings are statements that run before it. With start, its sinks run: batches to their end, streams
    until stopped (one query a sink)."""
    runner = Runner(spark)
    for statement in [*(settings or []), *split_statements(prepare(text, values), strict)]:
        runner.run(statement.strip().rstrip(";"))
    if start:
        for name, df, overwrite in runner.result.inserts:
            runner.result.started.append(write_sink(df, runner.tables[name], overwrite))
        for df in runner.result.printed:
            runner.result.started.append(write_sink(df, TableDef("print", options={"connector": "print"})))
    return runner.result
