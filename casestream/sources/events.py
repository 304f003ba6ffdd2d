"""A sink for event frames: whole micro-batches or nothing, and nothing after a connection's close.

    path/staged/<file>.parquet   frames as tasks write them (key, seq, frame, closes)
    path/batches/<n>.json        the files of micro-batch n, written when all its tasks have ended

A reader follows the batches' lists, so frames of failed or repeated tasks are never seen; a batch that
is committed again changes nothing. The fence is laid when frames are read: of each key, those that come after the first
one that closes it, by (batch, seq), don't exist, whichever writer sent them. Tasks write through `Store`, each its own file."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

from .files_anywhere import Store

FRAMES = "key string, seq bigint, frame string, closes boolean"
#: Frames that a task holds before they are written.
GROUP = 20_000


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    frames: int


class EventSink(DataSource):
    """`df.writeStream.format("event_frames").option("path", ...)` for rows of FRAMES."""

    @classmethod
    def name(cls) -> str:
        return "event_frames"

    def schema(self) -> str:
        return FRAMES

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return _Writer(self.options["path"])


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        import pyarrow as pa
        import pyarrow.parquet as pq

        kind = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("frame", pa.string()), ("closes", pa.bool_())])
        store, name, held, n, out = Store(self.path), f"staged/{uuid.uuid4().hex}.parquet", [], 0, None

        def flush():
            nonlocal out, held
            if out is None:
                store.fs.create_dir(store.at("staged"))
                out = pq.ParquetWriter(store.at(name), kind, filesystem=store.fs)
            columns = zip(*held, strict=True)
            out.write_table(pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kind.types, strict=True)], schema=kind))
            held = []

        for row in iterator:
            held.append((row["key"], row["seq"], row["frame"], bool(row["closes"])))
            n += 1
            if len(held) == GROUP:
                flush()
        if held:
            flush()
        if out is not None:
            out.close()
        return Written(name if n else None, n)

    def commit(self, messages: list, batchId: int) -> None:
        store, files = Store(self.path), [m.file for m in messages if m is not None and m.file]
        if store.exists(f"batches/{batchId}.json"):  # a batch that runs again: the first one counts
            self.abort(messages, batchId)
        else:
            store.publish_json(f"batches/{batchId}.json", {"files": files, "frames": sum(m.frames for m in messages if m is not None)})

    def abort(self, messages: list, batchId: int) -> None:
        for m in messages:
            if m is not None and m.file:
                Store(self.path).delete(m.file)


def write_events(frames: DataFrame, path: str, checkpoint: str):
    """A writer that takes a stream of FRAMES to the sink; start it with a trigger of choice."""
    frames.sparkSession.dataSource.register(EventSink)
    return frames.writeStream.format("event_frames").option("path", path).option("checkpointLocation", checkpoint)


def fenced(frames: DataFrame, order: list[str], key: str = "key", closes: str = "closes") -> DataFrame:
    """The frames up to and including the first that closes its key. One smallest place for each key is all that is
    worked out, so a long connection is never gathered."""
    place = F.struct(*order)
    ends = frames.where(closes).groupBy(F.col(key).alias("__key")).agg(F.min(place).alias("__end"))
    joined = frames.join(ends, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.where(F.col("__end").isNull() | (place <= F.col("__end"))).drop("__key", "__end")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(key, seq, frame, closes, batch) of the committed batches, behind the fence."""
    store, parts = Store(path), []
    for name in store.names("batches"):
        if name.endswith(".json") and not name.startswith("_"):
            batch = int(name.removesuffix(".json"))
            parts += [(f"{path.rstrip('/')}/{f}", batch) for f in store.read_json(f"batches/{name}")["files"]]
    if not parts:
        return spark.createDataFrame([], f"{FRAMES}, batch bigint")
    which = spark.createDataFrame([(f.rpartition("/")[2], b) for f, b in parts], "__file string, batch bigint")
    rows = spark.read.schema(FRAMES).parquet(*[f for f, _ in parts]).select("*", F.col("_metadata.file_name").alias("__file"))
    return fenced(rows.join(which, "__file").drop("__file"), ["batch", "seq"])


def purge(path: str) -> int:
    """Delete the files that no batch names, of tasks that were lost before they could be told to abort. No writer may be at work."""
    store = Store(path)
    named = {f for n in store.names("batches") if n.endswith(".json") and not n.startswith("_") for f in store.read_json(f"batches/{n}")["files"]}
    left = [f"staged/{n}" for n in store.names("staged") if f"staged/{n}" not in named]
    for name in left:
        store.delete(name)
    return len(left)
