"""What the operators of this subpackage share: tables, the shared folder, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only where it is unset (local runs)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="weirstream-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows: texts are some kilobytes each, and a batch is held by JVM and Python alike."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def bounded(df: DataFrame, max_rows: int) -> bool:
    """Whether a table has at most max_rows rows; stops counting beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased words of a text as an array; null and empty texts have none."""
    return F.filter(F.split(lower_az(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def unit_hash(key: Column, seed: int) -> Column:
    """A double in [0, 1) from 52 bits of an MD5 of seed and key; the same in any engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


#: Words (of 64 bits) of a bitmap of hashes: 128 kB, whatever the size of the table; and at most, where it is sized by the table.
BITMAP_WORDS, MAX_BITMAP_WORDS = 1 << 14, 1 << 15


def bitmap_words(keys: int) -> int:
    """Words of a bitmap for 32 bits a key, up to 256 kB (65,000 keys), beyond which more hashes pass for nothing."""
    return min(max(BITMAP_WORDS, 1 << max(keys // 2 - 1, 0).bit_length()), MAX_BITMAP_WORDS)


def _places(h: Column, size: int, probes: int) -> list[Column]:
    """The bits of a hash: as many as probes, from the hash and hashes of it."""
    return [F.pmod(h if k == 0 else F.xxhash64(h, F.lit(k)), F.lit(64 * size)) for k in range(probes)]


def bitmap_of(hashes: DataFrame, size: int = BITMAP_WORDS, probes: int = 1) -> Column:
    """A constant array of `size` numbers with `probes` bits set for each hash of a table (h); at most `size` rows are gathered.

    It lets every hash of the table through. With one probe it lets few others through while the table has up to some hundred
    thousand rows; with three and a size of bitmap_words, fewer than 1 in 1000 of the others.
    """
    places = hashes.select(F.explode(F.array(*_places(F.col("h"), size, probes))).alias("p"))
    bits = places.select(F.shiftright("p", 6).cast("int").alias("w"), F.expr("shiftleft(1L, CAST(p % 64 AS INT))").alias("b"))
    words = [0] * size
    for r in bits.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        words[r["w"]] = r["b"]
    # one literal, which the optimiser turns into a constant array
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def in_bitmap(bitmap: Column, h: Column, size: int = BITMAP_WORDS, probes: int = 1) -> Column:
    """Whether all bits of a hash are set in a bitmap of the same size and probes."""
    found = [F.getbit(F.get(bitmap, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in _places(h, size, probes)]
    return reduce(Column.__and__, found)
