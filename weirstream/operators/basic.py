"""Projections, filters, key choice, unions and generic hooks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..plans.sqlcompat import rewrite_expression, window_select
from ..registry import SEQ, Context, StreamNode, find_function, function, operator
from ..types import field_list, top_level_split


def _call(ctx, node, options, other=None):
    return find_function(options.get("identity"))(ctx, node, options, other)


@operator("MAP")
def map_(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """1 to 1: a registered function, or a projection by `expression`."""
    return _call(ctx, node, {"identity": "select", **options} if "expression" in options else options)


@operator("FLAT MAP")
def flat_map(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    return _call(ctx, node, options)


@operator("FILTER")
def filter_(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """A registered predicate function, or a condition by `expression`."""
    if "expression" in options and "identity" not in options:
        return node.on(node.df.where(rewrite_expression(options["expression"])))
    return _call(ctx, node, options)


_AGGREGATES = re.compile(r"(?i)\b(sum|count|avg|min|max|collect_list|collect_set|explode|inline|stack)\s*\(")


@function("select")
def select(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """A pure projection: `expression`='a, UPPER(b) AS c'. Aggregates and generators are refused."""
    text = options.get("expression")
    if not text:
        raise ValueError("option expression is missing")
    if _AGGREGATES.search(text):
        raise ValueError(f"select takes scalar expressions only: {text}")
    out = node.df.selectExpr(*[rewrite_expression(x) for x in top_level_split(text)])
    keys = tuple(k for k in node.keys if k in out.columns)
    if node.seq in (None, *out.columns) or node.seq not in node.df.columns:
        return node.on(out, keys=keys)
    # the order of arrival goes along, unseen
    hidden = node.df.selectExpr(*[rewrite_expression(x) for x in top_level_split(text)], f"`{node.seq}` AS {SEQ}")
    return node.on(hidden, keys=keys, seq=SEQ)


@function("row_2_pojo")
def row_to_struct(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """Map columns onto a registered record type: fields by name or alias, converted by code with {column}; absent: defaults."""
    fields = record_types[options.get("return.class") or options["mapping.class"]]
    out = []
    for name, (alias, kind, convert, default) in fields.items():
        source = alias if alias in node.df.columns else name if name in node.df.columns else None
        if source is None:
            out.append(F.lit(default).cast(kind).alias(name))
        elif convert:
            if "{column}" not in convert:
                raise ValueError("convert code must contain {column}")
            out.append(F.expr(convert.replace("{column}", f"`{source}`")).cast(kind).alias(name))
        else:
            out.append(F.col(source).cast(kind).alias(name))
    return node.on(node.df.select(*out), keys=(), seq=None)


#: Record types for row_2_pojo: name to {field: (alias, type, convert code, default)}.
record_types: dict[str, dict[str, tuple[str, str, str | None, object]]] = {}


def record_type(name: str, **fields) -> None:
    """Register a record type; a field is its SQL type or a tuple (alias, type[, convert[, default]])."""
    full = {}
    for key, given in fields.items():
        given = (key, given) if isinstance(given, str) else tuple(given)
        full[key] = (*given, *(None,) * (4 - len(given)))
    record_types[name] = full


@operator("PROJECT")
def project(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """Columns by position: `field_indexes`='0,2'."""
    if "field_indexes" not in options:
        raise ValueError("option field_indexes is missing")
    names = [c for c in node.df.columns if c != SEQ]
    picked = [names[int(i)] for i in options["field_indexes"].split(",")]
    keys = tuple(k for k in node.keys if k in picked)
    if node.seq in (None, *picked) or node.seq not in node.df.columns:
        return node.on(node.df.select(*picked), keys=keys)
    return node.on(node.df.select(*picked, F.col(node.seq).alias(SEQ)), keys=keys, seq=SEQ)


@operator("PROCESS")
def process(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    return _call(ctx, node, options)


@operator("TRANSFORM")
def transform(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """A registered function over one stream, or two."""
    return _call(ctx, node, options, other)


@operator("TRANSFORM_WITH", two=True)
def transform_with(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    return _call(ctx, node, options, other)


@operator("FORWARD")
def forward(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """Rows stay where they are; Spark needs no hint for that."""
    return node


@operator("KEY BY")
def key_by(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    if "parallelism" in options:
        raise ValueError("parallelism cannot be set on KEY BY")
    return find_function(options.get("identity", "key_by_rowdata"))(ctx, node, options, other)


@function("key_by_rowdata")
def key_by_fields(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """Key columns by `fields`; the shuffle happens in the operator that needs it."""
    text = options.get("fields", "")
    if not text.strip():
        raise ValueError("option fields is blank")
    return node.on(node.df, keys=tuple(a for a, _ in field_list(text, node.df.columns)))


@operator("UNION", two=True)
def union(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """All rows of both streams; the second arrives after the first where no order is known."""
    if "parallelism" in options:
        raise ValueError("parallelism cannot be set on UNION")
    if node.visible().columns != other.visible().columns:
        raise ValueError("UNION needs the same columns on both sides")
    if node.seq and other.seq and node.seq == other.seq:
        return node.on(node.df.unionByName(other.df), keys=())
    return StreamNode(node.visible().unionByName(other.visible()))


@operator("AGGREGATE", keyed=True)
def aggregate(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """A windowed group-by: `expression.select` and `expression.groupby` with TUMBLE, HOP or SESSION(column, INTERVAL ...)."""
    node.need_keys()
    chosen, grouped = options.get("expression.select"), options.get("expression.groupby")
    if not chosen or not grouped:
        raise ValueError("AGGREGATE needs expression.select and expression.groupby")
    if not re.search(r"(?i)\b(TUMBLE|HOP|SESSION)\s*\(", grouped):
        raise RuntimeError("AGGREGATE needs a TUMBLE, HOP or SESSION window")
    return StreamNode(window_select(node.visible(), chosen, grouped))
