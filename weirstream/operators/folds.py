"""Sequential rules over the sorted rows of each key: one shuffle, rows stream through a task, state is carried along."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST = "_first_of_key"


def by_key(df: DataFrame, keys: Sequence[str], *order: str, **more: Column) -> DataFrame:
    """df with a mark on each key's first row, and further window columns; rows then lie by key, in order, in each part."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumns({FIRST: F.row_number().over(w) == 1} | {name: c.over(w) for name, c in more.items()})


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bool]]:
    """(begin, end, whether a key begins) of the runs of one key in a batch."""
    first = np.flatnonzero(batch.column(FIRST).to_numpy(zero_copy_only=False))
    edges = np.unique(np.concatenate([[0], first, [batch.num_rows]])).tolist()
    news = set(first.tolist())
    for a, b in zip(edges, edges[1:]):
        yield a, b, a in news


def window_rows(df: DataFrame, fields: list[str], values: list[str], duration: int) -> DataFrame:
    """One row for each session-tumble window of rows sorted by key and `_ms`: the first of each field (f0, ...), the values
    without nulls as arrays (v0, ...), `_start`, and the times as the array `_times`.

    A window opens at a key's first row t0 and holds rows before t0 + D; a row before t0 + 2 D opens the next window at t0 +
    D, a later one a new session at its own time. A task holds the rows of the open window.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType(
        [T.StructField(f"f{i}", types[c]) for i, c in enumerate(fields)] + [T.StructField(f"v{i}", T.ArrayType(types[c])) for i, c in enumerate(values)]
        + [T.StructField("_start", T.LongType()), T.StructField("_times", T.ArrayType(T.LongType()))]
    )
    names = schema.names
    picked = df.select(FIRST, F.col("_ms"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])

    def windows(batch: pa.RecordBatch, begins: list[int], starts: list[int]) -> pa.RecordBatch:
        """The windows that begin at these rows; the last ends with the batch."""
        edges = np.append(np.array(begins, np.int64), batch.num_rows)
        out = [batch.column(f"f{i}").take(pa.array(begins, pa.int64())) for i in range(len(fields))]
        for name in [*[f"v{i}" for i in range(len(values))], "_ms"]:
            column = batch.column(name)
            upto = np.concatenate([[0], np.cumsum(column.is_valid().to_numpy(zero_copy_only=False))])
            lists = pa.ListArray.from_arrays(pa.array(upto[edges].astype(np.int32)), column.drop_null())
            out.append(lists)
        out.insert(len(out) - 1, pa.array(starts, pa.int64()))
        return pa.RecordBatch.from_arrays(out, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        start = opened = None

        def closed() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                yield windows(table.to_batches()[0], [0], [opened])

        for batch in batches:
            ms, begins, starts = batch.column("_ms").to_pylist(), [], []
            for i, end, new in _segments(batch):
                start = None if new else start
                while i < end:
                    if start is not None:
                        i = bisect_left(ms, start + duration, i, end)
                        if i == end:
                            break
                    start = start + duration if start is not None and ms[i] < start + 2 * duration else ms[i]
                    begins.append(i)
                    starts.append(start)
                    i += 1
            if not begins:
                held.append(batch)
                continue
            if begins[0]:
                held.append(batch.slice(0, begins[0]))
            yield from closed()
            if len(begins) > 1:
                whole = batch.slice(begins[0], begins[-1] - begins[0])
                yield windows(whole, [b - begins[0] for b in begins[:-1]], starts[:-1])
            held, opened = [batch.slice(begins[-1])], starts[-1]
        yield from closed()

    return picked.mapInArrow(run, schema)


def with_eras(df: DataFrame, ttl_ms: int) -> DataFrame:
    """Rows sorted by key and `_ms`, with `_era_first`, whether the key's state is new at the row, and `_era_ms`, the time of the
    row at which it was.

    State is cleaned at 1.5 * ttl after the row that last set the clean-up time; a row at ts sets it if none is set or ts +
    ttl lies beyond it.
    """
    hold = ttl_ms * 3 // 2
    schema = T.StructType([*df.schema.fields, T.StructField("_era_first", T.BooleanType()), T.StructField("_era_ms", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean = era = None
        for batch in batches:
            ms = batch.column("_ms").to_pylist()
            first, of = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, np.int64)
            for i, end, new in _segments(batch):
                clean = None if new else clean
                while i < end:
                    if clean is not None:  # rows that leave the clean-up time as it is
                        j = bisect_left(ms, clean - ttl_ms + 1, i, end)
                        of[i:j] = era
                        i = j
                        if i == end:
                            break
                    if clean is None or ms[i] >= clean:
                        era, first[i] = ms[i], True
                    of[i], clean = era, ms[i] + hold
                    i += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first), pa.array(of)], names=schema.names)

    return df.mapInArrow(run, schema)
