"""Queries over streams, state, stores and sources, each with its DuckDB SQL: stream jobs
take what there is of the given tables in several micro-batches, stop, and are read back."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analyze as A
from ..operators.replies import ReplyStore
from ..session import scratch
from ..sources.tables import entry_stream, find_entries, table, write_archive
from ..sources.versioned import Folder
from .oracle import ORACLES as _BATCH
from .queries import SCALED, _chunks

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that processors with several kinds of state need, for the streams that are started inside."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _fed(spark: SparkSession, rows: DataFrame, folder: str, batches: int) -> DataFrame:
    """A stream of `rows`, written as files and taken in about so many micro-batches."""
    rows.write.parquet(folder)
    n = len(spark.read.schema(rows.schema).parquet(folder).inputFiles())
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-n // batches))).parquet(folder)


def sse_frames_stream(spark, sf):
    """The frames of `sse_frames` from chunks that come in no order, over several micro-batches."""
    from ..streaming.frames import frame_stream

    folder = scratch(spark, "chunk-stream")
    rows = _chunks(spark, sf)
    # Chunks of one connection go to different files, so they come in different micro-batches.
    mixed = rows.repartition(8, F.xxhash64("conv_id", "seq"))
    with keyed_state(spark):
        writer = frame_stream(_fed(spark, mixed, f"{folder}/in", 3)).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
        writer.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("key").cast("long").alias("conv_id"), "frame_no", "payload")


def _half(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The events up to the middle of their time, and those after it."""
    events = table(spark, sf, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(seconds), F.max(seconds)).first()
    early = seconds <= ((low or 0) + (high or 0)) // 2
    return events.where(early), events.where(~early)


def _bucket_runs(spark: SparkSession, sf: str, folder: str) -> None:
    """The token bucket over the first half of the events; it stops, and starts again from its state for the second."""
    from ..streaming.token_bucket import token_bucket_stream

    with keyed_state(spark):
        for part in _half(spark, sf):
            part.write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(part.schema).parquet(f"{folder}/in")
            writer = token_bucket_stream(stream, "user_id", *SCALED, expire=False).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
            writer.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()


def token_bucket_restart(spark, sf):
    """The verdicts of `token_bucket` from a stream that was stopped half-way."""
    folder = scratch(spark, "bucket-restart")
    _bucket_runs(spark, sf, folder)
    out = spark.read.parquet(f"{folder}/out")
    return out.select("event_id", F.col("key").cast("long").alias("user_id"), "allowed", "reason", "retry_after_ms")


def token_bucket_states(spark, sf):
    """What the state store holds for each client after that."""
    from ..streaming.token_bucket import bucket_states

    folder = scratch(spark, "bucket-states")
    _bucket_runs(spark, sf, folder)
    return bucket_states(spark, f"{folder}/state").select(F.col("key").cast("long").alias("user_id"), "hour_tokens", "hour_last", "five_tokens", "five_last")


def token_sink(spark, sf):
    """The frames of `token_frames`, streamed to the event sink without a thought for what follows a failure, read back behind its fence."""
    from ..sources.events import read_events, write_events

    folder = scratch(spark, "token-sink")
    said, failed = F.when(F.col("turn") % 2 == 1, F.col("role")), F.col("turn") == 3
    body = F.when(failed, F.to_json(F.struct(F.lit("Streaming failed").alias("error")))).when(said.isNotNull(), F.to_json(F.struct(said.alias("content"))))
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("seq"), F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("frame"), failed.alias("closes"))
    # A connection's frames come in order: its turns are dealt to the micro-batches by their number.
    for k in range(3):
        part = rows.where((F.col("seq") >= 2 * k) & ((F.col("seq") < 2 * k + 2) if k < 2 else F.lit(True)) & F.col("frame").isNotNull())
        part.write.mode("append").parquet(f"{folder}/in")
        write_events(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), f"{folder}/sink", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return read_events(spark, f"{folder}/sink").select(F.col("key").cast("long").alias("conv_id"), F.col("seq").alias("turn"), "frame")


_RESULT = (
    '<li class="item row"><div><a href="/objave/{0}" target="_blank"> Document {0} </a><a href="?text={0}">D-{0}</a></div>'
    '<div><small>Sud</small><a href="/objave-sudova/1"><span>Court {1}</span></a></div><span class="m-date">{2}</span></li>'
)


def _archive(spark: SparkSession, sf: str) -> DataFrame:
    """Result pages of each source: its documents in order, a page for each thousand ids."""
    rows = table(spark, sf, "documents").where("source is not null").select("doc_id", F.col("source").alias("search_term"), F.floor(F.col("doc_id") / 1000).cast("int").alias("page"), "lang", "n_chars")
    item = F.lit(_RESULT)
    for i, c in enumerate((F.col("doc_id").cast("string"), F.col("lang"), F.col("n_chars").cast("string"))):
        item = F.replace(item, F.lit("{%d}" % i), c)
    html = F.concat(F.lit("<ul>"), T.ordered_text(F.col("item"), F.col("doc_id"), ""), F.lit("</ul>"))
    pages = rows.withColumn("item", item).groupBy("search_term", "page").agg(html.alias("html"))
    return pages.select("search_term", "page", F.lit("http://host.example/s").alias("url"), "html")


def _terms(spark: SparkSession, sf: str) -> list[str]:
    """The terms that are searched for: as many as there are sources."""
    return sorted(r[0] for r in table(spark, sf, "documents").where("source is not null").select("source").distinct().collect())


def _found(entries: DataFrame) -> DataFrame:
    return entries.select("search_term", "page", "result_pos", "title", "case_number", "court", "date", "detail_link")


def search_entries(spark, sf):
    """Every source looked up by the search source, in a task for each term and 64 pages."""
    folder = scratch(spark, "search-archive")
    write_archive(_archive(spark, sf), folder)
    return _found(find_entries(spark, _terms(spark, sf), archive=folder))


def search_stream(spark, sf):
    """The same as a stream, over an archive that grows between two runs of it."""
    folder, pages = scratch(spark, "search-stream"), _archive(spark, sf)
    most = table(spark, sf, "documents").agg(F.floor(F.max("doc_id") / 2000)).first()[0] or 0
    for part in (pages.where(F.col("page") <= most), pages.where(F.col("page") > most)):
        write_archive(part, f"{folder}/archive")
        stream = entry_stream(spark, _terms(spark, sf), archive=f"{folder}/archive")
        _found(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def reply_store(spark, sf):
    """Texts asked in two runs, those of even ids first: each document with the run that made its reply, or with the failure."""
    store = ReplyStore(spark, scratch(spark, "reply-store"))
    docs = table(spark, sf, "documents").select("doc_id", "text", F.lit(None).cast(A.PARTIES).alias("participants"))
    store.ask(docs.where("doc_id % 2 = 0"), "text", _by_length, "first")
    both = store.ask(docs, "text", _by_length, "second")
    return both.select("doc_id", F.col("run").alias("asked_in"), "reply", "error")


def _by_length():
    def reply(text: str) -> str:
        if len(text) % 5 == 0:
            raise RuntimeError("the model is down")
        return f"A text of {len(text)}"

    return reply


def observed_counts(spark, sf):
    """Counts of an analysis as a batch and as a stream, from what was observed while they ran."""
    from ..streaming import observe as O

    folder = scratch(spark, "observed")
    labels = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("labelled"))
    rows = table(spark, sf, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    rows = rows.select("doc_id", "text", F.when(F.col("labelled").isNull(), F.lit("no result")).alias("error"))
    done, seen = O.observed(rows, O.run_counts())
    done.write.parquet(f"{folder}/batch")
    counts = [("batch", *(seen.get[k] for k in ("n_files", "n_failed", "n_chars")))]
    stream = _fed(spark, spark.read.parquet(f"{folder}/batch"), f"{folder}/in", 3)
    query = O.observed_stream(stream, O.run_counts()).writeStream.format("noop").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    total = O.totals(query)
    counts.append(("stream", *(total.get(k, 0) for k in ("n_files", "n_failed", "n_chars"))))
    return spark.createDataFrame(counts, "run string, n_files bigint, n_failed bigint, n_chars bigint")


def file_ingest(spark, sf):
    """Documents dropped as files of JSON lines, among others; taken in over several micro-batches and deleted."""
    from ..streaming import ingest as I

    folder = scratch(spark, "file-ingest")
    lines = table(spark, sf, "documents").select(F.to_json(F.struct("doc_id", "text"), {"ignoreNullFields": "false"}).alias("line"))
    lines.repartition(8).write.option("maxRecordsPerFile", 400).text(f"{folder}/drop")
    n = len(spark.read.schema("value string").text(f"{folder}/drop").inputFiles())
    files = I.file_stream(spark, f"{folder}/drop", "part-*.txt", max(1, -(-n // 3)))
    I.ingest(files, f"{folder}/out", f"{folder}/state").awaitTermination()
    I.sweep(spark, f"{folder}/out", f"{folder}/drop")
    left = sum(x.startswith("part-") for x in Folder(spark, f"{folder}/drop").names())
    held = I.admitted(spark, f"{folder}/out").select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")).where("line <> ''")
    doc = held.select(F.from_json("line", "doc_id bigint, text string").alias("d"))
    return doc.select("d.doc_id", F.length("d.text").cast("long").alias("n_chars"), F.lit(left).cast("long").alias("files_left"))


QUERIES = {f.__name__: f for f in (sse_frames_stream, token_bucket_restart, token_bucket_states, token_sink, search_entries, search_stream, reply_store, observed_counts, file_ingest)}

_SEARCH = """
SELECT source AS search_term, CAST(doc_id // 1000 AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) - 1 AS INTEGER) AS result_pos,
       'Document ' || doc_id AS title, 'D-' || doc_id AS case_number, 'Court ' || lang AS court, CAST(n_chars AS VARCHAR) AS date, 'http://host.example/objave/' || doc_id AS detail_link
FROM documents WHERE source IS NOT NULL"""

_COUNTED = "SELECT count(*) AS n_files, count(*) FILTER (l.doc_id IS NULL) AS n_failed, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"

ORACLES = {
    "sse_frames_stream": _BATCH["sse_frames"],
    "token_bucket_restart": _BATCH["token_bucket"],
    "token_bucket_states": _BATCH["token_bucket"].replace(
        "SELECT event_id, user_id, allowed, reason, CAST(retry_after_ms AS BIGINT) AS retry_after_ms FROM f",
        "SELECT user_id, CAST(h AS BIGINT) AS hour_tokens, CAST(hl AS BIGINT) AS hour_last, CAST(s AS BIGINT) AS five_tokens, CAST(sl AS BIGINT) AS five_last FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1",
    ),
    "token_sink": _BATCH["token_frames"],
    "search_entries": _SEARCH,
    "search_stream": _SEARCH,
    "reply_store": """
WITH r AS (SELECT text, CASE WHEN bool_or(doc_id % 2 = 0) THEN 'first' ELSE 'second' END AS run FROM documents WHERE text IS NOT NULL AND length(text) % 5 <> 0 GROUP BY text)
SELECT doc_id, run AS asked_in, CASE WHEN run IS NOT NULL THEN 'A text of ' || length(d.text) END AS reply, CASE WHEN length(d.text) % 5 = 0 THEN 'the model is down' END AS error
FROM documents d LEFT JOIN r ON r.text = d.text""",
    "observed_counts": f"SELECT 'batch' AS run, * FROM ({_COUNTED}) UNION ALL SELECT 'stream', * FROM ({_COUNTED})",
    "file_ingest": "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS files_left FROM documents",
}
