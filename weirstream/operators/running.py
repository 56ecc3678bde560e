"""Running keyed aggregates: one output row for each input row, in arrival order."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import Context, StreamNode, function, operator


def _field(node: StreamNode, options: dict) -> str:
    if "field" in options:
        return options["field"]
    if "position" in options:
        return node.visible().columns[int(options["position"])]
    raise RuntimeError("one of the options field and position is needed")


def _so_far(node: StreamNode) -> W:
    return W.partitionBy(*node.need_keys()).orderBy(node.seq).rowsBetween(W.unboundedPreceding, W.currentRow)


def _rolling(name: str):
    """SUM, MIN, MAX: the field's running aggregate; other columns as in the key's first row."""

    def run(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
        node.need_keys()
        if node.df.isStreaming:
            from ..streaming.processors import running_stream

            return node.on(running_stream(node, name, _field(node, options)))
        node = node.sequenced()
        field, w = _field(node, options), _so_far(node)
        kind = node.df.schema[field].dataType
        out = []
        for c in node.df.columns:
            if c == field:
                out.append(getattr(F, name)(c).over(w).cast(kind).alias(c))
            elif c == node.seq or c in node.keys:
                out.append(F.col(c))
            else:
                out.append(F.first(c).over(w).alias(c))
        return node.on(node.df.select(*out))

    return run


def _extreme(name: str):
    """MIN BY, MAX BY: the whole winning row; on ties the earliest if first=true (the default), else the latest."""

    def run(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
        node.need_keys()
        first = str(options.get("first", "true")).lower() == "true"
        if node.df.isStreaming:
            from ..streaming.processors import running_stream

            return node.on(running_stream(node, name, _field(node, options), first))
        node = node.sequenced()
        field, w = _field(node, options), _so_far(node)
        early = (name == "min_by") == first
        tie = F.col(node.seq) if early else -F.col(node.seq)
        rest = [c for c in node.df.columns if c != node.seq and c not in node.keys]
        won = getattr(F, name)(F.struct(*rest), F.struct(F.col(field), tie)).over(w)
        picked = node.df.withColumn("_won", won)
        return node.on(picked.select(*[F.col(f"_won.{c}").alias(c) if c in rest else F.col(c) for c in node.df.columns]))

    return run


for _word in ("sum", "min", "max"):
    operator(_word, keyed=True)(_rolling(_word))
    function(f"aggregation_{_word}")(_rolling(_word))
for _word in ("min", "max"):
    operator(f"{_word} by", keyed=True)(_extreme(f"{_word}_by"))
    function(f"aggregation_{_word}_by")(_extreme(f"{_word}_by"))

#: User functions for REDUCE: two rows (dicts) to one.
reducers: dict[str, Callable[[dict, dict], dict]] = {}


def reducer(identity: str):
    def add(f: Callable[[dict, dict], dict]):
        reducers[identity] = f
        return f

    return add


@operator("REDUCE", keyed=True)
def reduce_(ctx: Context, node: StreamNode, options: dict, other=None) -> StreamNode:
    """A user's binary function, running: each key's rows pass through one task in arrival order; in streams the state is the last row.

    An arbitrary Python function has no Catalyst form, so this is the one running aggregate that leaves the JVM; SUM, MIN,
    MAX and their BY forms do not.
    """
    keys = node.need_keys()
    if options.get("identity") not in reducers:
        raise LookupError(f"unknown reduce function {options.get('identity')}")
    f = reducers[options["identity"]]
    if node.df.isStreaming:
        from ..streaming.processors import reduce_stream

        return node.on(reduce_stream(node, f))
    node = node.sequenced()
    seq, names = node.seq, [c for c in node.df.columns if c != node.seq]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, state = rows.sort_values(seq), [], None
        for row in rows.to_dict("records"):
            at = row.pop(seq)
            state = row if state is None else f(dict(state), row)
            out.append({**state, seq: at})
        return pd.DataFrame(out, columns=[*names, seq])

    schema = node.df.select(*names, seq).schema
    return node.on(node.df.select(*names, seq).groupBy(*keys).applyInPandas(run, schema))
