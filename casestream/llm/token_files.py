"""Token ids in ORC files: integer run-length encoding, stripes, row indexes
and Bloom filters on doc_id.

Documents are dealt out by ranges of doc_id and sorted, so the files, and the
rows inside them, ascend by doc_id. A reader takes stripes in parallel, and a
lookup by doc_id skips files, stripes and row groups by their least and largest
doc_id and by the Bloom filters, before any ids are read.

Defined cases: a null or empty text is a row with the end id alone; a null
doc_id comes first; rows that repeat a doc_id stand one after the other, and each is found at its own
place, since a row's number in its file is stored with it; a text may be of any length; an empty table writes no rows; other
columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import public_tokenizer, scratch_path, text_slices
from .tokens import encoder

END_ID = 1
#: Bytes of text that a file holds at most, but for a range of equal doc_ids.
FILE_BYTES = 256 << 20
_ROW = "doc_id bigint, n_tokens bigint, ids array<int>, row bigint"
_DIGEST = "doc_id bigint, n_tokens bigint, row bigint, ids_crc32 bigint, file string"


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, done = encoder(path).encode, 0
        for batch in batches:
            for row, data, offsets in text_slices(batch.column("text")):
                ids, at = encode(data, offsets)
                closed = np.insert(ids, at[1:], end_id)
                at = (at + np.arange(len(at))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(closed.astype(np.int32)))
                numbers = np.arange(done, done + len(at) - 1, dtype=np.int64)
                done += len(numbers)
                columns = [batch.column("doc_id").slice(row, len(numbers)), pa.array(np.diff(at).astype(np.int64)), lists, pa.array(numbers)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "row"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        columns = [*(batch.column(c) for c in ("doc_id", "n_tokens", "row")), pa.array(crc, pa.int64()), batch.column("file")]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _DIGEST.split(", ")])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, stripe_mb: int = 16) -> None:
    """Write (doc_id, n_tokens, ids, row) of all rows of `docs` as ORC under `path`; row counts the rows of a file."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # As many files as keep FILE_BYTES of text each; not coalesced by size, so that encoding, which costs far more than reading, stays spread.
    whole = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-whole // FILE_BYTES))
    dealt = texts.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32("text"))
    rows = dealt.mapInArrow(_encode(tokenizer, end_id), _ROW)
    options = {
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
        "orc.create.index": "true",
        "orc.row.index.stride": "1000",
        "orc.stripe.size": str(stripe_mb << 20),
        "orc.compress": "ZSTD",
    }
    rows.write.options(**options).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, row) of the files under `path`; filters on doc_id are
    answered from their metadata first."""
    return spark.read.schema(_ROW).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (the ids of all documents before it), n_tokens and the
    crc32 of its ids, from the files."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")
    read = read_token_files(spark, path).select("doc_id", "n_tokens", "row", "ids", name)
    digests = read.mapInArrow(_digest, _DIGEST)
    # A file is one range of doc_id; the number in its name is that of the range. There are as many rows here as files.
    per_file = read_token_files(spark, path).select("n_tokens", name).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = Window.partitionBy(F.lit(0)).orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_file.select(F.col("file").alias("__file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = digests.withColumn("upto", F.sum("n_tokens").over(inside)).join(ahead, F.col("file") == F.col("__file"))
    return placed.select("doc_id", (F.col("ahead") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table, written and read back."""
    path = scratch_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizer())
    return token_index(spark, path)
