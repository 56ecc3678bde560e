"""Operator 9: embedding near-dedup by a subspace pigeonhole join.

Unit vectors at cosine >= t are at squared distance <= 2 - 2t. Vectors are rotated (a fixed random rotation, so that blocks
spread alike) and split into blocks of dimensions; each block gets a share of that budget in proportion to its dimensions,
and in at least one block a pair keeps within its share. So a range join in each block, with radius the root of its share,
finds every pair.

A block's range join partitions the subspace by pivots: a vector's home is the cell of its nearest pivot, and it visits the
cells whose bounding hyperplane towards its home lies within the radius, so two vectors within the radius meet in the home
cell of each. Cells with very many vectors are dealt in parts. Within a part, candidates are found in the block's few
dimensions by one product of single precision; connected candidates form a group, its members fetch their whole vectors, and
pairs are verified in double precision. Only members of groups, their link counts and one edge each are rows: pairs never
are. A pair counts in the first block that finds it, at the home cell of the vector for which it counts.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite numbers, link with nothing; vectors of
different lengths link with none of each other, and those of each length are joined by themselves, whatever their number;
equal vectors are folded first and count each other; a null id is kept and links with nothing; repeated rows of a vec_id
count once and get the same result; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .components import component_ids

BLOCKS = 4
#: Cells of a block: one for so many vectors, between these bounds. In evenly spread data a vector visits a third or so of the
#: cells, so more cells cost more rows and save little.
MIN_PIVOTS, MAX_PIVOTS, VECTORS_A_PIVOT = 16, 512, 4096
#: Vectors of a part of a cell: some megabytes of block coordinates.
PART = 1 << 15
#: Products of a part held at once.
TILE = 1 << 22
#: What rounding to single precision can move a squared distance by, and more.
SLACK = 1e-4


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def bounds_of(dim: int, blocks: int) -> list[int]:
    """Where the blocks begin and end; short vectors have a block for each dimension."""
    blocks = min(blocks, dim)
    return [round(i * dim / blocks) for i in range(blocks + 1)]


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, which rows are usable vectors, and these, normalised in double precision."""
    flat, offsets = column.flatten(), column.offsets.to_numpy()
    size, first = np.diff(offsets), offsets[:-1] - offsets[0]
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    there = column.is_valid().to_numpy(zero_copy_only=False) & (size > 0)
    for dim in np.unique(size[there]).tolist():
        rows = np.flatnonzero(there & (size == dim))
        x = values[first[rows][:, None] + np.arange(dim)]
        top = np.abs(x).max(axis=1)
        fine = np.isfinite(x).all(axis=1) & (top > 0)
        x = x[fine] / top[fine][:, None]
        yield rows[fine], x / np.linalg.norm(x, axis=1)[:, None]


def cells(y: np.ndarray, pivots: np.ndarray, radius: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first vector, home cells, visited cells) in one block, for some vectors at a time."""
    square = (pivots**2).sum(axis=1)
    gaps = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * pivots @ pivots.T, 0))  # at most MAX_PIVOTS squared
    for lo in range(0, len(y), 1024):
        part = y[lo : lo + 1024]
        d = (part**2).sum(axis=1)[:, None] - 2 * part @ pivots.T + square[None]
        home = d.argmin(axis=1)
        near = d - d[np.arange(len(part)), home][:, None] <= 2 * gaps[home] * (radius + SLACK) + SLACK
        near[np.arange(len(part)), home] = True
        yield lo, home, near


def _place(budget: float, blocks: int, pivots: dict[int, np.ndarray]):
    """A row for each block and cell that a vector visits; pivots, by length, are whole rotated vectors."""
    turns = {dim: rotation(dim) for dim in pivots}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                every = part.column(0).to_numpy(zero_copy_only=False)
                for rows, x in unit_rows(part.column(1)):
                    ids, dim = every[rows], x.shape[1]
                    y, bounds = x @ turns[dim], bounds_of(dim, blocks)
                    for b in range(len(bounds) - 1):
                        own = y[:, bounds[b] : bounds[b + 1]]
                        coords = np.ascontiguousarray(own.astype(np.float32)).view(np.uint8).reshape(len(ids), -1)
                        radius = np.sqrt(budget * own.shape[1] / dim + SLACK)  # the one that pairs are found within
                        for lo, home, near in cells(own, pivots[dim][:, bounds[b] : bounds[b + 1]], radius):
                            row, cell = np.nonzero(near)
                            data = np.ascontiguousarray(coords[lo + row]).ravel()
                            offsets = (np.arange(len(row) + 1) * coords.shape[1]).astype(np.int32)
                            packed = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                            n = len(row)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(cell.astype(np.int32)), pa.array(ids[lo + row]), pa.array(home[row] == cell), packed],
                                names=["dim", "block", "cell", "vec_id", "home", "coords"],
                            )

    return run


class Groups:
    """Disjoint sets of numbers below n; merging is vectorised by row."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.label[i]
        while len(other := np.flatnonzero(self.label[r] != r)):
            r[other] = self.label[r[other]]
        self.label[i] = r
        return r

    def merge(self, i: int, mates: np.ndarray) -> None:
        every = np.unique(np.append(self.roots(mates), self.roots(np.array([i]))))
        self.label[every] = every[0]


def _groups_in(budget: float, blocks: int):
    """Groups of connected candidates in a part of a cell: homes of chunk i against all vectors of chunk j."""

    def run(group: pa.Table) -> pa.Table:
        dim, block = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
        bounds = bounds_of(dim, blocks)
        share = budget * (bounds[block + 1] - bounds[block]) / dim + SLACK
        ids = group.column("vec_id").to_numpy()
        x = np.frombuffer(b"".join(group.column("coords").to_pylist()), np.float32).reshape(len(ids), -1)
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        # one product gives xy - |x|^2 / 2 - |y|^2 / 2, minus half the squared distance
        half, one = (x**2).sum(axis=1, keepdims=True) / np.float32(2), np.ones((len(ids), 1), np.float32)
        left, right = np.hstack([x, one, -half]), np.hstack([x, -half, one])[b].T.copy()
        groups, live = Groups(len(ids)), np.zeros(len(ids), bool)
        step = max(1, TILE // max(1, len(b)))
        for lo in range(0, len(a), step):
            rows = a[lo : lo + step]
            hit = np.flatnonzero((left[rows] @ right).ravel() >= np.float32(-share / 2))
            r, c = rows[hit // len(b)], b[hit % len(b)]
            other = ids[r] != ids[c]
            r, c = r[other], c[other]
            live[r] = live[c] = True
            for part in np.split(np.arange(len(r)), np.flatnonzero(np.diff(r)) + 1) if len(r) else ():
                groups.merge(int(r[part[0]]), c[part])
        keep = np.flatnonzero(live)
        cols = [group.column(c).take(pa.array(keep)) for c in ("dim", "block", "cell", "i", "j", "vec_id", "asks")]
        return pa.table([*cols, pa.array(groups.roots(keep).astype(np.int64))], names=["dim", "block", "cell", "i", "j", "vec_id", "asks", "kind"])

    return run


def _verify(budget: float, blocks: int, cosine: float):
    """(vec_id, n_links, low): links of the asking vectors that this block finds first, and an edge to the group's smallest id."""

    def run(group: pa.Table) -> pa.Table:
        dim, block = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
        bounds = bounds_of(dim, blocks)
        ids, copies = group.column("vec_id").to_numpy(), group.column("copies").to_numpy()
        x = group.column("unit").combine_chunks()
        x = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy().reshape(-1, dim)
        y = (x @ rotation(dim)).astype(np.float32).astype(float)
        asks = group.column("asks").to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        links = np.zeros(len(a), np.int64)
        every, place = np.unique(ids, return_inverse=True)
        groups = Groups(len(every))
        step = max(1, TILE // 8 // max(1, len(b)))
        for lo in range(0, len(a), step):
            rows = a[lo : lo + step]
            linked = (x[rows] @ x[b].T >= cosine) & (ids[rows][:, None] != ids[b][None])
            for e in range(block + 1):
                p, q = y[rows, bounds[e] : bounds[e + 1]], y[b, bounds[e] : bounds[e + 1]]
                near = (p**2).sum(axis=1)[:, None] + (q**2).sum(axis=1)[None] - 2 * p @ q.T <= budget * p.shape[1] / dim + SLACK
                linked &= near if e == block else ~near
            links[lo : lo + step] = linked @ copies[b]
            for r in np.flatnonzero(linked.any(axis=1)):
                groups.merge(int(place[rows[r]]), place[b[linked[r]]])
        zero = np.zeros(len(every), np.int64)
        tops = every[groups.roots(np.arange(len(every)))]
        return pa.table({"vec_id": np.concatenate([ids[a], every]), "n_links": np.concatenate([links, zero]), "low": np.concatenate([ids[a], tops])})

    return run


def linked_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, blocks: int = BLOCKS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("raw"))
    budget = 2 - 2 * cosine

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in unit_rows(batch.column(1)) if batch.num_rows else ():
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), lists], names=["vec_id", "unit"])

    once = rows.where("vec_id IS NOT NULL").mapInArrow(units, "vec_id bigint, unit array<double>")
    once = materialise(once, "units")
    # equal vectors fold into the smallest id; the hash decides the shuffle, the vector itself what is equal
    folded = once.groupBy("unit").agg(F.min("vec_id").alias("first"), F.countDistinct("vec_id").alias("copies"))
    folded = materialise(folded, "folded")
    several = folded.where("copies > 1").withColumnRenamed("unit", "same")
    twins = materialise(once.join(several, once["unit"] == several["same"]).select("vec_id", "first").distinct(), "twins")
    reps = folded.select(F.col("first").alias("vec_id"), "unit", "copies")
    none = rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    pivots: dict[int, np.ndarray] = {}
    for dim, n in reps.groupBy(F.size("unit")).count().collect():  # a row for each length
        n_pivots = int(min(MAX_PIVOTS, max(MIN_PIVOTS, n // VECTORS_A_PIVOT)))
        some = reps.where(F.size("unit") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()
        pivots[dim] = np.array([r["unit"] for r in some], float).reshape(-1, dim) @ rotation(dim)
    if not pivots:
        return none
    keys = ["dim", "block", "cell"]
    placed = materialise(reps.select("vec_id", "unit").mapInArrow(_place(budget, blocks, pivots), "dim int, block int, cell int, vec_id bigint, home boolean, coords binary"), "placed")
    # homes are dealt in ni parts and all visitors in nj: a home row goes to each of the nj, a visitor's row to each of the ni
    counts = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("m")).where("m > 0")
    in_parts = lambda c: F.ceil(F.col(c) / F.lit(PART)).cast("int")
    parts = F.broadcast(materialise(counts.select(*keys, in_parts("m").alias("ni"), in_parts("n").alias("nj")), "parts"))  # at most blocks * MAX_PIVOTS rows a length
    dealt = placed.join(parts, keys)
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = [*keys, "vec_id", "coords"]
    asking = dealt.where("home").withColumn("j", every("nj")).select(*cols, own("ni").alias("i"), "j", F.lit(True).alias("asks"))
    asked = dealt.withColumn("i", every("ni")).select(*cols, "i", own("nj").alias("j"), F.lit(False).alias("asks"))
    grouped = asking.unionByName(asked).groupBy(*keys, "i", "j").applyInArrow(
        _groups_in(budget, blocks), "dim int, block int, cell int, i int, j int, vec_id bigint, asks boolean, kind bigint"
    )
    grouped = materialise(grouped, "groups")
    checked = grouped.join(reps, "vec_id").groupBy(*keys, "i", "j", "kind").applyInArrow(_verify(budget, blocks, cosine), "vec_id bigint, n_links bigint, low bigint")
    checked = materialise(checked, "checked")
    edges = checked.where("low <> vec_id").select(F.col("low").alias("a"), F.col("vec_id").alias("b"))
    edges = edges.unionByName(twins.where("first <> vec_id").select(F.col("first").alias("a"), F.col("vec_id").alias("b")))
    found = component_ids(edges)
    links = checked.groupBy("vec_id").agg(F.sum("n_links").alias("links"))
    # copies share the links of their first, and link with each other
    counts = reps.join(links, "vec_id", "left").select(F.col("vec_id").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")).where("n_links > 0")
    counts = materialise(counts, "counts")
    own = counts.join(twins, "first", "left").select(F.coalesce("vec_id", "first").alias("id2"), "n_links")
    out = rows.select("vec_id").join(own, F.col("vec_id") == F.col("id2"), "left").join(found, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op9_subspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND array_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN comp c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
