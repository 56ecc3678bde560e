"""Lake tables as partitioned Parquet, partition times, and column families as cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def partition_time(date: Column, hour: Column) -> Column:
    """The time of a partition by its date (yyyyMMdd) and hour (HH)."""
    return F.to_timestamp(F.concat(date, hour), "yyyyMMddHH")


def write_lake(df: DataFrame, table, overwrite: bool = False):
    """Append to Parquet files with zstd, or replace them, partitioned as declared; rows are dealt by partition, so each writes few
    files. Replacing a partitioned table leaves the partitions that no row is for."""
    options = {"compression": table.options.get("compression", "zstd")} | ({"partitionOverwriteMode": "dynamic"} if overwrite else {})
    if df.isStreaming:
        writer = df.writeStream.format("parquet").options(**options, path=table.options["path"], checkpointLocation=table.options["checkpoint"])
        return (writer.partitionBy(*table.partitions) if table.partitions else writer).start()
    writer = (df.hint("rebalance", *table.partitions) if table.partitions else df).write.mode("overwrite" if overwrite else table.options.get("mode", "append")).options(**options)
    return (writer.partitionBy(*table.partitions) if table.partitions else writer).parquet(table.options["path"])


def hbase_cells(df: DataFrame, row_key: str | None = None) -> DataFrame:
    """(row_key, family, qualifier, value) of the non-null cells; families are the struct columns of df."""
    row_key = row_key or next(f.name for f in df.schema.fields if not isinstance(f.dataType, T.StructType))
    cells = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            for q in f.dataType.fields:
                cells.append(F.struct(F.lit(f.name).alias("family"), F.lit(q.name).alias("qualifier"), F.col(f.name)[q.name].cast("string").cast("binary").alias("value")))
    return df.select(F.col(row_key).cast("string").cast("binary").alias("row_key"), F.inline(F.array(*cells))).where("value IS NOT NULL")
