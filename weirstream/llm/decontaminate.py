"""Operator 4: benchmark decontamination by size-partitioned MinHash containment search, DataFrame functions only.

Items are partitioned by the number q of their distinct shingles, of five words, or for an item of n < 5 words of n words. In
a partition the MinHash sketch of an item keeps its k(q) = q - ceil(t*q) + 1 smallest hashes (bottom-k). A document that
contains at least t*q of the item's shingles misses at most k(q) - 1 of them, so it shares a sketch hash for certain:
candidates lose nothing, however long the document is. The document side keeps, as its sketch, the hashes that may be a
sketch hash of some item, by a bitmap of fixed size. Candidates are verified by exact containment over all shingles.

A text is compared without case (A-Z) and ASCII punctuation. Defined cases: an item of one to four words is one shingle, its
whole sequence, found wherever a document holds these words in a row; a text without words has no shingle and is in no
result; null texts count as empty; null ids are kept and all rows without an id count as one; repeated rows of an item_id or a
doc_id count as one; ties cannot arise; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, bitmap_of, bounded, in_bitmap, materialise, table

#: ASCII punctuation, dropped before words are cut.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_WORDS = 5
#: Tables of item shingles up to this many rows (16 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_SHINGLES = 500_000


def shingle_hashes(text: Column, sizes: Sequence[int] = (N_WORDS,)) -> Column:
    """Distinct 64-bit hashes of the shingles of a text, of each of the sizes that the text is long enough for."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + PUNCTUATION, LOWER)
    cut = F.filter(F.split(plain, SPACE), lambda w: w != "")
    hashed = F.transform(cut, lambda w: F.xxhash64(w))

    def of_size(h: Column, n: int) -> Column:
        last = F.size(h) - (n - 1)
        return F.when(last < 1, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(*([F.lit(n)] if n < N_WORDS else []), *[F.element_at(h, i + j) for j in range(n)]))
        )

    # the array is held by a one-element transform: its words are hashed once, not once for each use below
    return F.element_at(F.transform(F.array(hashed), lambda h: F.array_distinct(F.concat(*[of_size(h, n) for n in sizes]))), 1)


def item_hashes(text: Column) -> Column:
    """The shingles of an item: of five words, or of all its words if these are fewer."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + PUNCTUATION, LOWER)
    n = F.size(F.filter(F.split(plain, SPACE), lambda w: w != ""))
    out = shingle_hashes(text)
    for few in range(1, N_WORDS):
        out = F.when(n == few, shingle_hashes(text, (few,))).otherwise(out)
    return out


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    containment: float = 0.75,
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared): the items of which a document holds at least the given part of the shingles."""
    parts = (100 * containment).__round__()
    item_sets = materialise(
        items.select(F.col(item_id_col).alias("item_id"), F.explode_outer(item_hashes(F.col(item_text_col))).alias("h"))
        .where("h IS NOT NULL")
        .distinct(),
        "items",
    )
    plain = F.translate(F.coalesce(F.col(item_text_col), F.lit("")), UPPER + PUNCTUATION, LOWER)
    n_words = F.size(F.filter(F.split(plain, SPACE), lambda w: w != ""))
    short = items.select(n_words.alias("n")).where(F.col("n").between(1, N_WORDS - 1)).distinct().collect()  # at most four rows
    shingle_sizes = (N_WORDS, *sorted(r["n"] for r in short))
    by_item = W.partitionBy("item_id")
    sizes = item_sets.withColumn("n_item", F.count("*").over(by_item)).withColumn(
        "place", F.row_number().over(by_item.orderBy("h"))
    )
    # integer arithmetic: k = q - ceil(parts * q / 100) + 1
    k = F.col("n_item") - F.expr(f"({parts} * n_item + 99) div 100") + 1
    sketches = materialise(sizes.where(F.col("place") <= k).select("item_id", "h"), "sketches")
    small = bounded(item_sets, BROADCAST_SHINGLES)
    hint = F.broadcast if small else (lambda df: df)

    sets = docs.select(F.col(id_col).alias("doc_id"), shingle_hashes(F.col(text_col), shingle_sizes).alias("hs"))
    probes = sketches.select("h").distinct()
    bitmap = bitmap_of(probes)
    # explode_outer: for explode, the optimiser would compute the sets again to filter out empty ones
    sketched = sets.select("doc_id", F.explode_outer(F.filter("hs", lambda x: in_bitmap(bitmap, x))).alias("h"))
    sketched = sketched.where("h IS NOT NULL")
    candidates = materialise(
        sketched.join(hint(probes), "h", "left_semi").join(hint(sketches), "h").select("doc_id", "item_id").distinct(),
        "candidates",
    )
    # exact: whole sets of the candidate documents against whole sets of their candidate items
    ids = candidates.select(F.col("doc_id").alias("of")).distinct()
    known = item_sets.select("h").distinct()
    found = (
        docs.join(ids, docs[id_col].eqNullSafe(ids["of"]), "left_semi")
        .select(F.col(id_col).alias("doc_id"), F.explode_outer(shingle_hashes(F.col(text_col), shingle_sizes)).alias("h"))
        .where("h IS NOT NULL")
        .join(hint(known), "h", "left_semi")
        .distinct()
        .join(hint(item_sets), "h")
        .groupBy("doc_id", "item_id")
        .agg(F.count("*").alias("n_shared"))
    )
    n = item_sets.groupBy(F.col("item_id").alias("i")).agg(F.count("*").alias("n_item"))
    sought = candidates.select(F.col("doc_id").alias("d"), F.col("item_id").alias("e"))
    return (
        found.join(sought, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("e")))
        .join(hint(n), F.col("item_id").eqNullSafe(F.col("i")))
        .where(100 * F.col("n_shared") >= parts * F.col("n_item"))
        .select("doc_id", "item_id", "n_item", "n_shared")
    )


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs in which no item is contained, columns as in docs."""
    hit = contained_items(docs, items, id_col=id_col, **options).select(F.col("doc_id").alias("hit_id")).distinct()
    hit = materialise(hit, "contaminated")
    return docs.join(hit, docs[id_col].eqNullSafe(hit["hit_id"]), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: `contained(doc_id, item_id, n_item, n_shared)` from a table `docs(doc_id, text)`; also used by the pipeline's SQL.
CONTAINED_SQL = r"""
texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM docs UNION ALL SELECT 'i', item_id, text FROM benchmark),
cut AS (SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM texts),
short AS (SELECT DISTINCT len(w) AS n FROM cut WHERE kind = 'i' AND len(w) BETWEEN 1 AND 4 UNION ALL SELECT 5),
shingles AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS s
  FROM cut, short WHERE len(w) >= n AND (kind = 'd' OR n = least(len(w), 5))),
item_n AS (SELECT id, count(*) AS n_item FROM shingles WHERE kind = 'i' GROUP BY id),
contained AS (SELECT d.id AS doc_id, i.id AS item_id, n.n_item, count(*) AS n_shared
  FROM shingles d JOIN shingles i ON d.kind = 'd' AND i.kind = 'i' AND d.s = i.s JOIN item_n n ON n.id = i.id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * n.n_item)
"""
OP4_SQL = f"WITH docs AS (SELECT doc_id, text FROM documents), {CONTAINED_SQL} SELECT doc_id, item_id, n_item, n_shared FROM contained"
