"""Operator 5: mixing sources to target weights.

Sizes are aggregated per source (a partial sum before the shuffle), targets follow from weights by water-filling, and each
document is taken floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction of
rate = target / size of its source.

Defined cases: a null or empty text has size 0; a null source is a source of its own, ordered last; a source of size 0 has
target 0 and its documents rate 0; repeated rows draw the same number, as their doc_id is the same; an empty table gives
no rows; extra columns are kept. The columns that :func:`take` adds are named ``mix_...``; if a column of the input begins so,
they are named ``mix__...``, or with as many underscores as it takes, and :func:`emit` returns the input's columns as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, bounded, materialise, table, unit_hash

#: Source tables up to this many rows are broadcast (a row is some 50 bytes); beyond it, a salted join takes over.
BROADCAST_SOURCES = 100_000
SALTS = 64


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), max_rate: float = 3.0) -> DataFrame:
    """From (source, source_size): add weight and target.

    Weights repeat over the sources in code-point order, null last. Targets share the total in proportion to weight; one
    stops at max_rate times its size and the excess goes to the others by weight. Sorted by max_rate * size / weight the
    stopped sources are a prefix, so running sums give the fixed point without iterating.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_rate))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(everything))
        .withColumn("target", F.coalesce(F.least(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")))
        .select("source", "source_size", "weight", "target")
    )


def free_prefix(columns: Sequence[str]) -> str:
    """``mix_``, with more underscores while a column begins so."""
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def take(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    max_rate: float = 3.0,
    seed: int = 20,
) -> DataFrame:
    """All rows of docs with mix_size, mix_source_size, mix_target and mix_copies (how often the mix takes the row)."""
    p = free_prefix(docs.columns)
    sized = docs.withColumn(f"{p}size", F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(WORD)).cast("bigint"))
    sizes = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(f"{p}size").alias("source_size"))
    targets = materialise(source_targets(materialise(sizes, "mix-sizes"), weights, max_rate), "mix-targets").select(
        F.col("source").alias(f"{p}key"), F.col("source_size").alias(f"{p}source_size"), F.col("target").alias(f"{p}target")
    )
    if bounded(targets, BROADCAST_SOURCES):
        joined = sized.join(F.broadcast(targets), sized[source_col].eqNullSafe(targets[f"{p}key"]))
    else:
        salted = sized.withColumn(f"{p}salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
        spread = targets.withColumn(f"{p}salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        on = salted[source_col].eqNullSafe(spread[f"{p}key"]) & (salted[f"{p}salt"] == spread[f"{p}salt2"])
        joined = salted.join(spread, on).drop(f"{p}salt", f"{p}salt2")
    rate = F.when(F.col(f"{p}source_size") > 0, F.col(f"{p}target") / F.col(f"{p}source_size")).otherwise(F.lit(0.0))
    extra = (unit_hash(F.col(id_col), seed) < rate - F.floor(rate)).cast("int")
    return joined.withColumn(f"{p}copies", (F.floor(rate) + extra).cast("int")).drop(f"{p}key")


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs mix_copies times (at most ceil(max_rate)), columns as in docs."""
    copies = free_prefix(docs.columns) + "copies"
    taken = take(docs, **options).where(F.col(copies) > 0)
    return taken.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return take(docs).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


#: Targets by source from a table `named` in DuckDB; also used by the pipeline's SQL.
TARGETS_SQL = """
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight, source_size * 3.0::DOUBLE AS cap FROM sizes),
levels AS (SELECT *, sum(source_size) OVER () AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before_it,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w FROM weighed),
flood AS (SELECT *, max(CASE WHEN (total - before_it)::DOUBLE / left_w * weight < cap THEN (total - before_it)::DOUBLE / left_w END) OVER () AS lv FROM levels),
targets AS (SELECT source, source_size, coalesce(least(lv * weight, cap), cap) AS target FROM flood),
rated AS (SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  ('0x' || substr(md5('20:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
"""
SIZE_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT"
OP5_SQL = f"""
WITH sized AS (SELECT doc_id, source, {SIZE_SQL} AS size FROM documents), {TARGETS_SQL}
SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed
"""
