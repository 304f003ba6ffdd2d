"""Files that are dropped into a folder, taken in over micro-batches: admitted by size, the others listed, and
the files deleted when what they held is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import UPLOAD_BYTES
from ..sources.versioned import Folder

#: What a folder's files are to a stream.
FILE = "path string, modificationTime timestamp, length bigint, content binary"


def file_stream(spark: SparkSession, folder: str, glob: str = "*", files_per_trigger: int = 1000, delete: bool = True) -> DataFrame:
    """The files of `folder` whose names match, as rows of FILE. With `delete` Spark deletes a micro-batch's files once a
    later one has begun, so those of the last one are left to `sweep`. An empty file holds nothing and makes no row."""
    reader = spark.readStream.format("binaryFile").schema(FILE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("cleanSource", "delete") if delete else reader).load(folder)


def ingest(files: DataFrame, out: str, checkpoint: str, limit: int = UPLOAD_BYTES):
    """Start taking in what is there: out/admitted/batch=<n> holds the files of at most `limit` bytes, out/refused/batch=<n> paths and
    lengths of the others, whose content is never read. A micro-batch that runs again writes the same anew."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.where(F.col("length") <= limit).write.mode("overwrite").parquet(f"{out}/admitted/batch={number}")
        rows.where(F.col("length") > limit).select("path", "length").write.mode("overwrite").parquet(f"{out}/refused/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admitted(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{FILE}, batch int").parquet(f"{out}/admitted")


def refused(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("path string, length bigint, batch int").parquet(f"{out}/refused")


def sweep(spark: SparkSession, out: str, folder: str) -> int:
    """Delete the source files that are written to `out`, admitted or refused, and are still there: how many. Streams the
    paths, so the driver holds none but those of one partition."""
    there, n = Folder(spark, folder), 0
    done = admitted(spark, out).select("path").union(refused(spark, out).select("path"))
    for row in done.toLocalIterator():
        name = row.path.rpartition("/")[2]
        n += there.exists(name) and there.delete(name)
    return n


def drop_job(spark: SparkSession, folder: str) -> bool:
    """Delete a job's folder and all that is in it; false if it isn't there."""
    return Folder(spark, folder).delete()
