"""Operator 6: MinHash near-dedup with odd sketches.

Each text's set of five-word shingles gives 128 MinHash samples. Bands of four samples find candidates; the samples folded
into a parity bitmap (odd sketch) give, by the population count of an XOR, a similarity estimate that discards poor
candidates; the rest are confirmed on full shingle sets, 100 * intersection >= 75 * union.

Scale: equal sets are folded into one representative first, so groups of copies cost one row each. In each band bucket
every document is compared with the bucket's smallest id (a star); only where a bucket still holds several components are
other pairs looked at, in blocks of some 256 x 256 sketches within a task, and confirmed there: no pair table is made. A
pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**32 < 6e-6; the sketch passes estimates from 0.5, more
than six standard deviations below 0.75.

Defined cases: null or empty texts have an empty set and link with nothing; texts of 1 to 4 words are one shingle; repeated
rows of a doc_id get the same component; a null doc_id is kept and links with nothing; empty tables give no rows; extra
columns are ignored. Hashes of shingles have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vectext as V
from .common import materialise, small_batches, table
from .components import component_ids

SAMPLES, ROWS, BITS = 128, 4, 512
LEAST_ESTIMATE = 0.5
BLOCK = 256
PARTNERS, PART_SHINGLES = 64, 1 << 18
_rng = np.random.default_rng(7)
_MULTIPLY = [V.U(x) for x in _rng.integers(1, 1 << 62, SAMPLES) * 2 + 1]
_ADD = [V.U(x) for x in _rng.integers(0, 1 << 62, SAMPLES)]
_BAND = np.array([V.U(x) for x in _rng.integers(1, 1 << 62, ROWS) * 2 + 1])
#: Most differing bits of two sketches whose estimate 1 + BITS / (4 SAMPLES) ln(1 - 2 d / BITS) is LEAST_ESTIMATE.
MOST_BITS = int(BITS / 2 * (1 - np.exp((LEAST_ESTIMATE - 1) * 4 * SAMPLES / BITS)))
SIGNATURE = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, sketch array<bigint>"


def signatures(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n, 32) and odd sketches (n, 8) of non-empty shingle sets."""
    n = len(bounds) - 1
    least = np.empty((n, SAMPLES), V.U)
    for i in range(SAMPLES):
        least[:, i] = np.minimum.reduceat(values * _MULTIPLY[i] + _ADD[i], bounds[:-1])
    at = np.arange(n)[:, None] * BITS + (V.mixed(least + np.arange(SAMPLES, dtype=V.U)[None, :]) % V.U(BITS)).astype(np.int64)
    parity = (np.bincount(at.ravel(), minlength=n * BITS) & 1).astype(np.uint8)
    sketch = np.packbits(parity.reshape(n, BITS), axis=1).view(np.int64)
    grouped = V.mixed(least).reshape(n, SAMPLES // ROWS, ROWS)
    bands = V.mixed((grouped * _BAND).sum(axis=2, dtype=V.U) + np.arange(SAMPLES // ROWS, dtype=V.U)[None, :])
    return bands.view(np.int64), sketch


def _lists(rows: np.ndarray, present: np.ndarray) -> pa.Array:
    """A list column with rows for the texts that are present and empty lists for the others."""
    at = np.concatenate([[0], np.cumsum(present * rows.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in V.chunks(batch.column(1)):
            values, bounds = V.shingles(*V.word_hashes(data, offsets))
            n = np.diff(bounds)
            has = n > 0
            width = SAMPLES // ROWS
            bands, sketch = np.zeros((0, width), np.int64), np.zeros((0, BITS // 64), np.int64)
            k1, k2 = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
            if has.any():
                starts = np.concatenate([bounds[:-1][has], bounds[-1:]])
                bands, sketch = signatures(values, starts)
                k1[has] = np.add.reduceat(values, starts[:-1]).view(np.int64)
                k2[has] = np.add.reduceat(V.mixed(values ^ V.U(0x5851F42D4C957F2D)), starts[:-1]).view(np.int64)
            ids = batch.column(0).slice(lo, hi - lo).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n.astype(np.int64)), pa.array(k1), pa.array(k2), _lists(bands, has), _lists(sketch, has)],
                names=["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"],
            )


def _bits_apart(a: str, b: str):
    return sum((F.bit_count(F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))) for i in range(1, BITS // 64)), F.bit_count(F.element_at(a, 1).bitwiseXOR(F.element_at(b, 1))))


def _sets_of(texts: DataFrame, schema: str) -> DataFrame:
    """Append the set (raw hashes) computed from the last column, text, to the columns before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in V.chunks(batch.column(batch.num_columns - 1)):
                values, bounds = V.shingles(*V.word_hashes(data, offsets))
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, V.binary_column(values, bounds)], names=[*batch.schema.names[:-1], "set"])

    return texts.mapInArrow(run, schema)


FILTER_BITS = 23


def only_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of texts whose doc_id may be among ids: none of those is lost, and most others need no shuffle.

    Ids are hashed into a bitmap of 2**FILTER_BITS bits (1 MB, whatever the input's size), gathered as at most 2**17 words.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    bits = ids.select(slot.alias("s")).select((F.col("s") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, CAST(s % 64 AS INT))").alias("b"))
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in bits.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        words[r["w"]] = r["b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            kept = batch.filter(pa.array(have[batch.column(2).to_numpy(zero_copy_only=False)]))
            if kept.num_rows:
                yield kept.select(["doc_id", "text"])

    return texts.where("doc_id IS NOT NULL").select("doc_id", "text", slot.alias("slot")).mapInArrow(run, "doc_id bigint, text string")


def _similar(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which sorted sets of others have 100 * intersection >= 75 * union with the sorted set a."""
    sizes = np.array([len(x) for x in others])
    every = np.concatenate(others)
    at = np.searchsorted(a, every)
    at[at == len(a)] = 0
    same = np.add.reduceat((a[at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * same >= 75 * (len(a) + sizes - same)


def _confirm_star(group: pa.Table) -> pa.Table:
    sets = [np.frombuffer(x, V.U) for x in group.column("set").to_pylist()]
    ids, is_hub = group.column("doc_id").to_pylist(), group.column("is_hub").to_pylist()
    hub = is_hub.index(True)
    rest = [i for i in range(len(ids)) if not is_hub[i] and len(sets[i])]
    passed = _similar(sets[hub], [sets[i] for i in rest]) if rest else []
    b = [ids[i] for i, ok in zip(rest, passed) if ok]
    return pa.table({"a": pa.array([ids[hub]] * len(b), pa.int64()), "b": pa.array(b, pa.int64())})


def confirmed_stars(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (hub, doc_id, n_shingles), those similar on full sets, as edges (a, b).

    A hub with many partners is dealt with in parts of some PARTNERS partners or PART_SHINGLES shingles, whichever is less, each
    with its own copy of the hub's set.
    """
    n_parts = F.ceil(F.greatest(F.count("*") / F.lit(PARTNERS), F.sum("n_shingles") / F.lit(PART_SHINGLES))).cast("int")
    parts = materialise(pairs.groupBy("hub").agg(n_parts.alias("parts")), "parts")
    dealt = pairs.join(parts, "hub").select("doc_id", "hub", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"))
    # at most one hub a band for each document: the list is short
    asked = dealt.groupBy("doc_id").agg(F.collect_list(F.struct("hub", "part")).alias("asks"))
    every = materialise(asked.join(parts.select(F.col("hub").alias("doc_id"), "parts"), "doc_id", "full"), "asked")
    sets = _sets_of(only_ids(texts, every).join(every, "doc_id").select("doc_id", "asks", "parts", "text"), "doc_id bigint, asks array<struct<hub:bigint,part:int>>, parts int, set binary")
    own = F.when(F.col("parts").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.col("doc_id").alias("hub"), p.alias("part"), F.lit(True).alias("is_hub"))))
    asks = F.transform("asks", lambda x: F.struct(x["hub"].alias("hub"), x["part"].alias("part"), F.lit(False).alias("is_hub")))
    none = F.array().cast("array<struct<hub:bigint,part:int,is_hub:boolean>>")
    rows = sets.select("doc_id", "set", F.inline(F.concat(F.coalesce(own, none), F.coalesce(asks, none))))
    return rows.groupBy("hub", "part").applyInArrow(_confirm_star, "a bigint, b bigint")


def _candidates_in_block(group: pa.Table) -> pa.Table:
    """Documents of a block that have a partner of another component within the sketches' reach."""
    left = np.array(group.column("is_left").to_pylist(), bool)
    ids, comps = group.column("doc_id").to_numpy(), group.column("comp").to_numpy()
    sketch = np.array(group.column("sketch").to_pylist(), np.int64).view(V.U)
    a, b = np.flatnonzero(left), np.flatnonzero(~left)
    active = np.zeros(len(ids), bool)
    for i in a:
        near = np.bitwise_count(sketch[b] ^ sketch[i]).sum(axis=1) <= MOST_BITS
        near &= comps[b] != comps[i]
        if near.any():
            active[i] = True
            active[b[near]] = True
    names = ["bkey", "i", "j", "doc_id", "comp", "is_left", "sketch"]
    return group.select(names).filter(pa.array(active))


def _confirm_block(group: pa.Table) -> pa.Table:
    """Edges that join the components of a block: full sets of candidates are compared until they are one component."""
    left = np.array(group.column("is_left").to_pylist(), bool)
    ids, comps = group.column("doc_id").to_numpy(), group.column("comp").to_numpy()
    sketch = np.array(group.column("sketch").to_pylist(), np.int64).view(V.U)
    sets = [np.frombuffer(x, V.U) for x in group.column("set").to_pylist()]
    of = {int(c): int(c) for c in comps}

    def root(c: int) -> int:
        while of[c] != c:
            of[c] = of[of[c]]
            c = of[c]
        return c

    b = np.flatnonzero(~left)
    out_a, out_b = [], []
    for i in np.flatnonzero(left):
        own = root(int(comps[i]))
        near = np.bitwise_count(sketch[b] ^ sketch[i]).sum(axis=1) <= MOST_BITS
        near &= np.array([root(int(c)) != own for c in comps[b]])
        others = b[near]
        if not len(others):
            continue
        for k in others[_similar(sets[i], [sets[k] for k in others])]:
            if (r := root(int(comps[k]))) != root(own):
                of[r] = root(own)
                out_a.append(int(ids[i]))
                out_b.append(int(ids[k]))
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialise(texts.mapInArrow(_sign, SIGNATURE), "signed")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["k1", "k2", "n_shingles"]
    copies = materialise(full.groupBy(*same).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    folded = materialise(full.join(copies, same, "left").select("doc_id", "first", "n_shingles", "bands", "sketch"), "folded")
    equal = folded.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    lone = folded.where("first IS NULL OR doc_id = first")

    banded = lone.select("doc_id", F.explode("bands").alias("bkey"))
    buckets = materialise(banded.groupBy("bkey").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub <> last").drop("last"), "buckets")
    members = materialise(banded.join(buckets, "bkey").select("bkey", "hub", "doc_id"), "members")
    sketches = lone.select("doc_id", "n_shingles", "sketch")
    of_hub = sketches.select(F.col("doc_id").alias("hub"), F.col("sketch").alias("hub_sketch"))
    stars = members.where("doc_id <> hub").select("hub", "doc_id").distinct()
    near = stars.join(sketches, "doc_id").join(of_hub, "hub").where(_bits_apart("sketch", "hub_sketch") <= MOST_BITS)
    pairs = materialise(near.select("hub", "doc_id", "n_shingles"), "pairs")
    edges = materialise(confirmed_stars(texts, pairs), "edges")
    found = component_ids(edges)

    # what is left: buckets that still hold documents of several components, beyond their star
    comp, hub_comp = found.select(F.col("id").alias("doc_id"), F.col("component_id").alias("c")), found.select(F.col("id").alias("hub"), F.col("component_id").alias("h"))
    placed = materialise(
        members.join(comp, "doc_id", "left").join(hub_comp, "hub", "left")
        .select("bkey", "doc_id", F.coalesce("c", "doc_id").alias("comp"), (F.coalesce("c", "doc_id") != F.coalesce("h", "hub")).alias("apart")),
        "placed",
    )
    open_ = placed.groupBy("bkey").agg(F.count("*").alias("n"), F.sum(F.col("apart").cast("int")).alias("m")).where("n > 2 AND m > 0")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"), F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    open_ = materialise(open_.select("bkey", blocks[0].alias("ni"), blocks[1].alias("nj")), "open")
    joined = [found.select(F.col("id").alias("a"), F.col("component_id").alias("b")), equal]
    if not open_.isEmpty():
        rows = placed.join(open_, "bkey").join(sketches, "doc_id")
        own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        cols = ["bkey", "doc_id", "comp", "sketch"]
        lefts = rows.where("apart").withColumn("j", own("nj")).withColumn("i", F.explode(every("ni"))).select(*cols, "i", "j", F.lit(True).alias("is_left"))
        rights = rows.withColumn("i", own("ni")).withColumn("j", F.explode(every("nj"))).select(*cols, "i", "j", F.lit(False).alias("is_left"))
        schema = "bkey bigint, i int, j int, doc_id bigint, comp bigint, is_left boolean, sketch array<bigint>"
        active = materialise(lefts.unionByName(rights).groupBy("bkey", "i", "j").applyInArrow(_candidates_in_block, schema), "active")
        if not active.isEmpty():
            wanted = materialise(active.select("doc_id").distinct(), "wanted")
            sets = materialise(_sets_of(only_ids(texts, wanted).join(wanted, "doc_id"), "doc_id bigint, set binary"), "sets")
            more = active.join(sets.dropDuplicates(["doc_id"]), "doc_id").groupBy("bkey", "i", "j").applyInArrow(_confirm_block, "a bigint, b bigint")
            joined.append(materialise(more, "more"))
    every_edge = joined[0]
    for df in joined[1:]:
        every_edge = every_edge.unionByName(df)
    final = component_ids(every_edge)
    out = signed.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def first_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document is the first of its component, columns as in docs."""
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col).where("NOT kept").select(F.col("doc_id").alias("gone_id"))
    gone = materialise(gone, "gone")
    return docs.join(gone, docs[id_col] == gone["gone_id"], "left_anti")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: `grouped(doc_id, n_shingles, component_id)` from a table `docs(doc_id, text)`; also used by the pipeline's SQL.
GROUPED_SQL = r"""
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM docs),
dsh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM dw),
dn AS (SELECT doc_id, count(*) AS n FROM dsh GROUP BY doc_id),
dlinks AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM dsh a JOIN dsh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN dn p ON p.doc_id = a.doc_id JOIN dn q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, l.y FROM reach r JOIN dlinks l ON r.y = l.x),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x),
grouped AS (SELECT d.doc_id, coalesce(dn.n, 0) AS n_shingles, comp.component_id FROM docs d JOIN comp USING (doc_id) LEFT JOIN dn USING (doc_id))
"""
OP6_SQL = f"WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents), {GROUPED_SQL} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM grouped"
