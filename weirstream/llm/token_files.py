"""Operator 1: token counts by separator scan.

Flat token files hold token ids of a fixed width, little-endian, each document ended by an identifier, and no index. They are
cut in blocks of whole tokens; each block is read by byte range and searched for the identifier with one vectorised
comparison. A block yields the tokens between its separators; an exclusive prefix sum over the separators of the blocks
before it (in two levels, so that no task holds all blocks of a long file) gives the number of its first document, and the
pieces of a document that crosses blocks, the last of one, whole blocks and the first of another, add up.

The query writes such files itself from the documents: each task tokenises its part and writes one file to the shared
folder, and a table of (file, place, doc_id), which Spark commits, names the files that count. A task that is run again
writes another file; files that no committed row names are ignored.

Defined cases: a null or empty text is a document without tokens; tokens after the last separator form a last document; an
empty file has none; a file whose size is no multiple of the identifiers' width is refused, as it is torn; a null doc_id is
kept; repeated rows are documents of their own; empty tables give no rows; extra columns are ignored; the identifier cannot
arise from a text, as special tokens are encoded as ordinary text.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, scratch_path, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_TEXT = 50256
#: Fixed value: the split pattern that belongs to this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 1 << 21
SUPER = 4096


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and path from a URI or a plain path, on executors and driver alike."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}", end: int = END_OF_TEXT, dtype: str = "<u2") -> DataFrame:
    """Tokenise docs into flat files below folder; returns the committed table (file, place, doc_id).

    The vocabulary file (below a megabyte) is read by the driver and sent to the executors, which need not have it.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = None
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        name, place, out = f"{uuid.uuid4().hex}.tokens", 0, None
        try:
            for batch in batches:
                if encoding is None:
                    encoding, out = _encoder(ranks.value), fs.open_output_stream(f"{root}/{name}")
                for text in batch.column(1):
                    ids = encoding.encode_ordinary(text.as_py() or "")
                    out.write(np.array([*ids, end], dtype=dtype).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(place, place + n)), batch.column(0).cast(pa.int64())], names=["file", "place", "doc_id"])
                place += n
        finally:
            if out is not None:
                out.close()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(run, "file string, place bigint, doc_id bigint"), "token-places")


def scan_token_files(files: DataFrame, folder: str, *, end: int = END_OF_TEXT, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, place, n_tokens) of every document in the files (a column `file`, names below folder)."""
    width = np.dtype(dtype).itemsize

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            found = [fs.get_file_info(f"{root}/{x}").size for x in batch.column(0).to_pylist()]
            if torn := [x for x, n in zip(batch.column(0).to_pylist(), found) if n % width]:
                raise ValueError(f"size is no multiple of {width} bytes: {torn}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n // width for n in found], pa.int64())], names=["file", "tokens"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            for name, block, size in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                with fs.open_input_file(f"{root}/{name}") as f:
                    data = np.frombuffer(f.read_at(width * min(block_tokens, size - block * block_tokens), width * block * block_tokens), dtype)
                ends = np.flatnonzero(data == end)
                runs = np.diff(np.concatenate([[-1], ends, [len(data)]])) - 1  # head, inner documents, tail
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([runs.tolist()], pa.list_(pa.int64()))], names=["file", "block", "ends", "runs"])

    listed = files.select("file").distinct().mapInArrow(sizes, "file string, tokens bigint")
    n_blocks = F.greatest(F.lit(0), F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("bigint"))
    blocks = listed.where("tokens > 0").select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks - 1)).alias("block"), "tokens")
    parts = files.sparkSession.sparkContext.defaultParallelism * 4
    found = materialise(blocks.repartition(parts, "file", "block").mapInArrow(scan, "file string, block bigint, ends bigint, runs array<bigint>"), "blocks")

    counts = found.select("file", "block", "ends", F.floor(F.col("block") / SUPER).alias("group"))
    before = lambda *keys: W.partitionBy(*keys)
    groups = counts.groupBy("file", "group").agg(F.sum("ends").alias("group_ends"))
    upto = before("file").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("file", "group", F.coalesce(F.sum("group_ends").over(upto), F.lit(0)).alias("group_first"))
    inside = before("file", "group").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.withColumn("own_first", F.coalesce(F.sum("ends").over(inside), F.lit(0))).join(groups, ["file", "group"])
    firsts = firsts.select("file", "block", (F.col("group_first") + F.col("own_first")).alias("first"))
    numbered = found.join(firsts, ["file", "block"])
    pieces = numbered.select("file", "first", "ends", F.posexplode("runs").alias("k", "n"))
    whole = pieces.where("k > 0 AND k < ends").select("file", (F.col("first") + F.col("k")).alias("place"), F.col("n").alias("n_tokens"))
    edge = pieces.where("k = 0 OR k = ends").select("file", (F.col("first") + F.col("k")).alias("place"), "n", (F.col("k") < F.col("ends")).alias("closed"))
    joined = edge.groupBy("file", "place").agg(F.sum("n").alias("n_tokens"), F.max("closed").alias("closed"))
    # what follows a file's last separator is a document only if it has tokens
    joined = joined.where("closed OR n_tokens > 0").select("file", "place", "n_tokens")
    return whole.unionByName(joined)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    places = write_token_files(table(spark, sf_dir, "documents"), folder)
    counts = scan_token_files(places, folder)
    return places.join(counts, ["file", "place"]).select("doc_id", "n_tokens")
