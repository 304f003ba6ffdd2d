"""Chat messages: two input dialects to one ordered list of model messages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, truthy

# Fixed value: the message that opens every conversation.
SYSTEM = (
    "You are a helpful legal assistant that excels at being factual, while also being kind and formal. "
    "Depending on the user inquiry, you can be informative beyond the immediate question. "
    "You frequently work with the elderly in need of free legal advice. "
    "You only provide answers in Croatian."
)
#: Characters of running texts that a task hands on at once.
RUNNING_CHARS = 4_000_000
MESSAGES = "array<struct<role:string,content:string,parts:array<struct<text:string>>>>"


def decode(bodies: DataFrame, column: str = "messages", key: str = "conv_id") -> DataFrame:
    """JSON bodies to rows (key, turn from 0, role, content, parts); what isn't a filled array gives no rows."""
    found = F.from_json(column, MESSAGES)
    return bodies.select(key, F.posexplode(F.when(F.size(found) > 0, found)).alias("turn", "m")).select(key, "turn", "m.role", "m.content", "m.parts")


def from_client(messages: DataFrame) -> DataFrame:
    """Client rows (text, is_user) to (role, content); blank messages go, with or without an attachment."""
    role = F.when(F.col("is_user"), "user").otherwise("assistant")
    return messages.withColumns({"role": role, "content": F.col("text")}).where(~is_blank("content"))


def _content() -> Column:
    first = F.get("parts", F.lit(0))["text"]
    return F.when(truthy("content"), F.col("content")).when(truthy(first), first)


def _kind() -> Column:
    return F.when(F.col("role") == "user", "human").when(F.col("role").isin("model", "assistant"), "ai")


def normalise(messages: DataFrame, key: str = "conv_id", files: DataFrame | None = None, system: str = SYSTEM) -> DataFrame:
    """(key, pos, kind, content): the system message at -1, then the valid messages at their
    own turns. Rows without role, without content or with another role go. `files` (key,
    mime_type, original_filename) adds a note to a user message that is the very last of
    all its conversation's messages, valid or not."""
    if "parts" not in messages.columns:
        messages = messages.withColumn("parts", F.lit(None).cast("array<struct<text:string>>"))
    last = F.max("turn").over(Window.partitionBy(key))
    rows = messages.select(key, F.col("turn").cast("long").alias("pos"), "role", "content", "parts", (F.col("turn") == last).alias("is_last"))
    rows = rows.withColumns({"kind": _kind(), "content": _content()}).where(truthy("role") & F.col("kind").isNotNull() & F.col("content").isNotNull())
    if files is not None:
        rows = rows.join(files.select(key, "mime_type", "original_filename"), key, "left")
        label = F.when(F.contains("mime_type", F.lit("pdf")), "PDF").otherwise("image")
        note = F.concat("content", F.lit("\n\n(Attached "), label, F.lit(": "), "original_filename", F.lit(")"))
        there = F.col("is_last") & (F.col("kind") == "human") & F.col("original_filename").isNotNull()
        rows = rows.withColumn("content", F.when(there, note).otherwise(F.col("content")))
    opening = messages.select(key).distinct().select(key, F.lit(-1).cast("long").alias("pos"), F.lit("system").alias("kind"), F.lit(system).alias("content"))
    return opening.unionByName(rows.select(key, "pos", "kind", "content"))


def last_n(messages: DataFrame, n: int = 50, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages of each conversation."""
    place = Window.partitionBy(key).orderBy(F.col(order).desc())
    return messages.withColumn("__from_end", F.row_number().over(place)).where(F.col("__from_end") <= n).drop("__from_end")


def write_history(messages: DataFrame, path: str, n: int = 50, key: str = "conv_id", order: str = "turn") -> None:
    """Write the last n messages of each conversation; they replace what was stored."""
    last_n(messages, n, key, order).write.mode("overwrite").parquet(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored messages; none for a first visit, when nothing is stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def without_last(messages: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    return messages.withColumn("__last", F.max(order).over(Window.partitionBy(key))).where(F.col(order) < F.col("__last")).drop("__last")


def _in_turn(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """Chunks of one conversation after the other, each in its order, in the partitions that fold them."""
    rows = chunks.select(F.col(key).alias("key"), F.col(order).alias("place"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.repartition("key").sortWithinPartitions("key", "place")


def running_text(chunks: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(key, order, running): each chunk with all text up to and including it. What comes out grows with the square of a
    conversation; what a task holds is one text and about RUNNING_CHARS of rows. `running_digest` is linear."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, begun, parts, size = None, False, [], 0
        for batch in batches:
            out, held = [], 0
            for k, place, more in batch.itertuples(index=False):
                if not begun or k != last:
                    last, begun, parts, size = k, True, [], 0
                if parts and more:
                    parts = ["".join(parts)]
                parts.append(more)
                size += len(more)
                out.append((k, place, "".join(parts)))
                held += size
                if held > RUNNING_CHARS:
                    yield pd.DataFrame(out, columns=["key", "place", "running"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["key", "place", "running"])

    return _folded(chunks, key, order, text, fold, "running string")


def running_digest(chunks: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(key, order, n_chars, running_md5): length and MD5 of all text up to and including each chunk. One pass, one digest
    in memory: linear in a conversation, whatever its length."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, begun, digest, n = None, False, None, 0
        for batch in batches:
            out = []
            for k, place, more in batch.itertuples(index=False):
                if not begun or k != last:
                    last, begun, digest, n = k, True, hashlib.md5(usedforsecurity=False), 0
                digest.update(more.encode())
                n += len(more)
                out.append((k, place, n, digest.copy().hexdigest()))
            yield pd.DataFrame(out, columns=["key", "place", "n_chars", "running_md5"])

    return _folded(chunks, key, order, text, fold, "n_chars bigint, running_md5 string")


def _folded(chunks: DataFrame, key: str, order: str, text: str, fold, made: str) -> DataFrame:
    rows = _in_turn(chunks, key, order, text)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("key", "place"))
    return rows.mapInPandas(fold, f"{kinds}, {made}").withColumnsRenamed({"key": key, "place": order})


def token_content(content: str = "content", text: str = "text", chunk: str = "chunk") -> Column:
    """What a streamed item says: its content, else text, else itself; null where none is filled."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (content, text, chunk)])


def token_frames(items: DataFrame, key: str = "conv_id", order: str = "turn", failed: str = "failed") -> DataFrame:
    """(key, order, frame): a streamed item's frame; empty items make none. From the first item whose
    stream `failed` on, one error frame stands in place of all that would follow."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.max(F.col(failed).cast("int")).over(before), F.lit(0)) == 1
    said = token_content()
    body = F.when(F.col(failed), F.to_json(F.struct(F.lit("Streaming failed").alias("error")))).when(said.isNotNull(), F.to_json(F.struct(said.alias("content"))))
    rows = items.withColumns({"__later": earlier, "__body": body}).where(~F.col("__later") & F.col("__body").isNotNull())
    return rows.select(key, order, F.concat(F.lit("data: "), "__body", F.lit("\n\n")).alias("frame"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of connections whose chunks come one after the other: what follows the last blank line is all that is held."""
    key, begun, number, rest = None, False, 0, ""
    for batch in batches:
        out = []
        for k, chunk in zip(batch["key"], batch["chunk"], strict=True):
            if begun and k != key:
                out.append((key, number, rest))
            if not begun or k != key:
                key, begun, number, rest = k, True, 0, ""
            *done, rest = (rest + chunk).split("\n\n")
            for frame in done:
                out.append((key, number, frame))
                number += 1
        yield pd.DataFrame(out, columns=["key", "frame_no", "frame"])
    if begun:
        yield pd.DataFrame([(key, number, rest)], columns=["key", "frame_no", "frame"])


def frames(chunks: DataFrame, key: str = "conv_id", order: str = "seq", chunk: str = "chunk", buffered: bool = True) -> DataFrame:
    """Event frames out of text chunks: (key, frame_no, payload). Frames end at a blank line and begin
    with "data:". Buffered, a frame may reach over chunks, and what is left at the end counts too;
    unbuffered, each chunk is cut by itself, and a frame must begin with "data: "."""
    marked = lambda f: F.regexp_replace(f, r"^([\s\S]*?)data: ", "$1")  # noqa: E731  the first mark only
    if buffered:
        rows = chunks.select(F.col(key).alias("key"), F.col(order).alias("seq"), F.coalesce(chunk, F.lit("")).alias("chunk"))
        cut = rows.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(_cut, f"key {rows.schema['key'].dataType.simpleString()}, frame_no bigint, frame string")
        return cut.where(F.ltrim("frame").startswith("data:")).select(F.col("key").alias(key), "frame_no", marked(F.col("frame")).alias("payload"))
    cut = chunks.select(key, order, F.posexplode(F.split(chunk, "\n\n", -1)).alias("k", "frame")).where(F.col("frame").startswith("data: "))
    number = F.row_number().over(Window.partitionBy(key).orderBy(order, "k")) - 1
    return cut.select(key, number.cast("long").alias("frame_no"), marked(F.col("frame")).alias("payload"))


def encode_frames(events: DataFrame, columns: list[str]) -> DataFrame:
    """Events as frames, in a column `frame`."""
    return events.withColumn("frame", F.concat(F.lit("data: "), F.to_json(F.struct(*columns)), F.lit("\n\n")))
