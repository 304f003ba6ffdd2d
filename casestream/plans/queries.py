"""The library's queries over the driver's tables.

documents.source stands for a search term and doc_id, descending, for the order of its
results; labels for analysis outcomes; orders for entries of a customer's term; events for
requests; conversations for chats."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analyze as A
from ..operators import chat as C
from ..operators import digest as D
from ..operators import limits as L
from ..operators import payload as P
from ..operators import select as S
from ..operators import subscriptions as U
from ..session import scratch
from ..sources import files as Files
from ..sources import html as H
from ..sources.tables import table
from .analysis import chat_turn as answer_chats
from .analysis import daily_check, first_case_by_detail_pages, processed_cases

SCALED = (L.Bucket(5, 28_800_000), L.Bucket(3, 14_400_000))


def _newest():
    return [F.col("doc_id").desc()]


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumnRenamed("source", "search_term")


def _case_rows(spark: SparkSession, sf: str, n: int) -> DataFrame:
    """The newest n documents of each term as entries of one document each, analysed if labelled."""
    chosen = S.latest_n(_documents(spark, sf), n, order=_newest())
    labels = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("analysed"))
    title, summary = F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.when(F.col("analysed"), F.col("text"))
    return chosen.join(labels, "doc_id", "left").select("search_term", "case_pos", "doc_id", title.alias("title"), F.col("lang").alias("date"), F.lit(0).alias("doc_pos"), summary.alias("summary"))


def digest_latest_two(spark, sf):
    return D.per_term(D.per_entry(_case_rows(spark, sf, 2)))


def latest_n_with_documents(spark, sf):
    there = _documents(spark, sf).select("search_term", "doc_id").join(table(spark, sf, "labels"), "doc_id")
    return S.latest_n(there, 3, order=_newest()).select("search_term", "case_pos", "doc_id", "quality")


def first_with_documents(spark, sf):
    entries = _documents(spark, sf).select("search_term", "doc_id", "lang")
    return S.first_with_links(entries, table(spark, sf, "labels").where("toxic = 1"), "doc_id", order=_newest()).select("search_term", "doc_id", "lang")


def latest_per_case(spark, sf):
    orders = table(spark, sf, "orders").withColumns({"case_number": F.when(F.col("o_orderkey") % 7 != 0, F.concat_ws("/", "o_custkey", "o_orderpriority")).otherwise(F.lit("")), "title": F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))})
    return S.latest_per_case(orders, order=[F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_orderkey", "case_number", "title")


def status_annotation(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select("doc_id", A.status(F.col("n_chars") >= 300, F.when(F.col("quality").isNull(), F.lit("no result"))).alias("status"))


def case_counts(spark, sf):
    docs = _documents(spark, sf).groupBy("search_term").agg(F.count(F.lit(1)).alias("n_results"), F.countDistinct("lang").alias("n_langs"), F.array_sort(F.collect_set("lang")).alias("langs"))
    linked = docs.withColumn("document_links", F.transform("langs", lambda x: F.struct(F.concat(F.lit("file:"), x).alias("url"), x.alias("text"))))
    out = P.document_summary(linked)
    return out.select("search_term", "n_results", "document_count", F.array_join(F.transform("documents", lambda d: F.concat(d["name"], F.lit("="), d["url"])), ";").alias("documents"))


def single_case_summary(spark, sf):
    rows = _case_rows(spark, sf, 3).withColumn("doc_pos", F.col("case_pos")).withColumn("case_pos", F.lit(1))
    return D.per_term(D.per_entry(rows))


def comparative_context(spark, sf):
    """Twenty ids in a row stand for an entry's documents; a term's newest three entries, with all of theirs."""
    docs = _documents(spark, sf).withColumn("entry", F.floor(F.col("doc_id") / 20))
    newest = S.latest_n(docs.select("search_term", "entry").distinct(), 3, order=[F.col("entry").desc()])
    rows = docs.join(newest, ["search_term", "entry"]).join(table(spark, sf, "labels"), "doc_id", "left")
    rows = rows.select("search_term", "case_pos", F.concat(F.lit("Entry "), "entry").alias("title"), F.lit(None).cast("string").alias("date"), F.col("doc_id").alias("doc_pos"), F.when(F.col("quality") == 1, F.col("text")).alias("summary"))
    return D.per_term(D.per_entry(rows))


def synthesis_prompts(spark, sf):
    both = digest_latest_two(spark, sf).unionByName(single_case_summary(spark, sf).withColumn("search_term", F.concat("search_term", F.lit("*"))))
    return both.select("search_term", F.md5(D.synthesis_prompt(F.col("n_cases"), F.col("context"))).alias("prompt_md5"))


def _answer():
    def reply(prompt: str) -> str:
        if len(prompt) % 3 == 0:
            raise RuntimeError("the model is down")
        return f"Overview of {len(prompt)}"

    return reply


def synthesis_texts(spark, sf):
    """Terms with two entries, with one, and (named with ?) without any."""
    two = D.per_term(D.per_entry(_case_rows(spark, sf, 2)))
    one = single_case_summary(spark, sf).withColumn("search_term", F.concat("search_term", F.lit("*")))
    both = two.unionByName(one)
    none = two.select(F.concat("search_term", F.lit("?")).alias("search_term"))
    return D.final_texts(both, _answer, both.select("search_term").union(none))


def progress_errors(spark, sf):
    """Runs that fail: before the search, in it, and with the default message."""
    message = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("No entry for "), "o_orderpriority"))
    failed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("search_term"), message.alias("message"), (F.col("o_orderkey") % 2 == 0).alias("begun"))
    return P.error_events(failed)


def token_frames(spark, sf):
    """Streams that fail at their fourth turn."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 1, F.col("role")).alias("content"), F.lit(None).cast("string").alias("text"), F.lit("").alias("chunk"), (F.col("turn") == 3).alias("failed"))
    return C.token_frames(rows)


def _files(spark, sf):
    docs = _documents(spark, sf)
    chosen = S.latest_n(docs, 2, order=_newest())
    people = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit("Ana").alias("name"), F.lit("00000000001").alias("oib"), F.lit("N/A").alias("address"), F.col("lang").alias("role"))))
    return chosen.select(
        "search_term", "case_pos", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("doc_id").cast("string").alias("case_number"), F.lit("Court").alias("court"), F.col("lang").alias("date"),
        F.concat(F.lit("http://host.example/"), "doc_id").alias("detail_link"), people.alias("participants"), F.when(F.col("doc_id") % 5 != 0, F.lit(0)).alias("doc_pos"), F.lit("http://host.example/a.zip").alias("url"), F.lit("a.txt").alias("file_name"), "text",
    )


def nested_payload(spark, sf):
    return processed_cases(_files(spark, sf)).select("search_term", F.to_json("processed_cases").alias("processed_cases"), "comparative_analysis")


def payload_shape(spark, sf):
    out = processed_cases(_files(spark, sf))
    total = lambda f: F.aggregate(F.transform("processed_cases", f), F.lit(0), lambda a, x: a + x)
    return out.select("search_term", F.size("processed_cases").alias("n_cases"), total(lambda c: F.size(c["files"])).alias("n_files"), total(lambda c: F.size(F.filter(c["analysis"]["individualAnalyses"], lambda a: a["error"].isNull()))).alias("n_good"), F.get("processed_cases", F.lit(0))["caseResult"]["title"].alias("first_title"))


def prompt_text(spark, sf):
    person = F.array(F.struct(F.lit("Ana \"A\"").alias("name"), F.lit("00000000001").alias("oib"), F.lit(None).cast("string").alias("address"), F.col("lang").alias("role")))
    people = F.when(F.col("doc_id") % 3 == 0, F.array().cast(A.PARTIES)).when(F.col("doc_id") % 3 == 1, F.concat(person, person).cast(A.PARTIES))
    docs = table(spark, sf, "documents").select("doc_id", "text", people.alias("participants"))
    return docs.select("doc_id", F.md5(A.prompt(F.col("text"), F.col("participants"))).alias("prompt_md5"))


def _moody():
    def reply(prompt: str) -> str:
        k = len(prompt.partition("Text:\n\n")[2]) % 5
        if k == 0:
            raise RuntimeError("the model is down")
        return "```json\nSorry, " if k == 1 else A.whole_text(prompt)

    return reply


def model_extract(spark, sf):
    """Some texts are blank, and the analyzer fails for some and says no JSON for others."""
    text = F.when(F.col("doc_id") % 11 == 0, F.lit(" \t\n")).otherwise(F.col("text"))
    person = F.array(F.struct(F.lit("Ana").alias("name"), F.lit("1").alias("oib"), F.lit("N/A").alias("address"), F.lit("Party").alias("role")))
    docs = table(spark, sf, "documents").select("doc_id", text.alias("text"), F.when(F.col("doc_id") % 2 == 0, person).cast(A.PARTIES).alias("participants"))
    return A.analyze(docs, _moody).select("doc_id", F.col("ai_result.summary").alias("summary"), F.size("ai_result.parties").alias("n_parties"), "error")


def progress_events(spark, sf):
    rows = _case_rows(spark, sf, 2)
    return P.progress_events(rows.select("search_term", "case_pos", "title", F.when(F.col("summary").isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias("n_docs")))


def download_progress(spark, sf):
    docs = _documents(spark, sf).select("search_term", "doc_id")
    return P.download_progress(docs, ["search_term"], "doc_id").select("search_term", "doc_id", F.col("progress").cast("long").alias("progress"))


def safe_names(spark, sf):
    name = F.when(F.col("p_partkey") % 5 == 0, F.lit("")).otherwise(F.concat("p_name", F.lit(" č/"), F.col("p_partkey").cast("string"), F.lit(".Pdf")))
    return table(spark, sf, "part").select("p_partkey", T.download_name(name).alias("download_name"), T.export_name(T.or_else(name, F.concat(F.lit("Document_"), F.col("p_partkey").cast("string")))).alias("export_name"))


def markdown_export(spark, sf):
    rows = _case_rows(spark, sf, 2).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("file "), F.col("doc_id").cast("string"))))
    files = P.markdown_export(rows).select("search_term", "case_pos", "file_name", "content")
    whole = P.comparison_export(D.per_term(D.per_entry(_case_rows(spark, sf, 2))).withColumn("case_number", F.when(F.col("search_term") != "src1", F.col("search_term"))))
    return files.unionByName(whole.select("search_term", F.lit(0).alias("case_pos"), "file_name", "content"))


def extension_ladder(spark, sf):
    pages = table(spark, sf, "pages")
    name = F.element_at(F.split("url", "/"), -1)
    disposition = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('attachment; filename="'), name, F.lit('.a%2Bb+c.pdf"'))).when(F.col("page_id") % 4 == 1, F.lit("attachment; filename*=UTF-8''bad%ZZ.doc")).when(F.col("page_id") % 4 == 2, F.lit("inline"))
    kinds = F.array(*[F.lit(m) for m in ("application/octet-stream", "application/pdf", "text/html; charset=utf-8", "application/x-unknown")])
    mime = F.get(kinds, F.pmod(F.floor(F.col("page_id") / 4), F.lit(4)).cast("int"))
    text = F.when(F.col("page_id") % 3 == 0, F.lit("Archive.ZIP")).otherwise(F.lit("other"))
    return pages.select("page_id", T.extension_of_download(disposition, mime, text).alias("extension"))


def fence_strip_parse(spark, sf):
    k = F.col("event_id") % 4
    reply = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("\t "), "props", F.lit("﻿\n"))).when(k == 2, F.concat(F.lit("Here: "), "props")).otherwise(F.lit('{"summary": "s", "k": 1}'))
    return table(spark, sf, "events").select("event_id", A.parse_reply(reply).alias("r")).select("event_id", F.col("r.raw_json").alias("raw_json"), F.col("r.result.summary").alias("summary"), F.col("r.error").alias("error"))


def _subscribers(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("email"), F.col("c_mktsegment").alias("search_term"), (F.col("c_acctbal") > 0).alias("is_active"), F.md5("c_name").alias("unsubscribe_token")
    )


def _requests(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    subs = _subscribers(spark, sf)
    term = F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).when(F.col("o_orderkey") % 2 == 0, F.col("search_term")).otherwise(F.col("o_orderpriority"))
    return orders.join(subs, F.col("o_custkey") == F.col("id")).select(F.col("o_orderkey").alias("request_no"), "email", term.alias("search_term")), subs


def subscribe_inserts(spark, sf):
    return U.split_requests(*_requests(spark, sf))[0].select("request_no", "email", "search_term")


def subscribe_conflicts(spark, sf):
    return U.split_requests(*_requests(spark, sf))[1].select("request_no", "email", "search_term")


def subscribe_ids(spark, sf):
    requests, subs = _requests(spark, sf)
    return U.insert(U.split_requests(requests, subs)[0], subs).select("id", "email", "search_term", "is_active", "last_seen_case_identifier")


def unsubscribe(spark, sf):
    subs = _subscribers(spark, sf)
    return U.unsubscribe(subs, subs.where("id % 10 = 0").select("unsubscribe_token")).select("id", "is_active")


def active_subscriptions(spark, sf):
    return U.active(_subscribers(spark, sf)).select("id", "email")


def _latest_orders(spark, sf):
    entries = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("search_term"), "o_orderkey", "o_orderdate", "o_orderpriority")
    newest = S.first_per_term(entries, order=[F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return newest.select("search_term", F.col("o_orderkey").cast("string").alias("case_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("title"), F.lit("N/A").alias("court"), F.lit("http://host.example").alias("detail_link"))


def _followers(spark, sf, latest):
    subs = _subscribers(spark, sf).withColumn("search_term", F.col("id").cast("string"))
    seen = latest.select("search_term", T.identifier("case_number", "date").alias("__seen"))
    last = F.when(F.col("id") % 3 == 1, F.col("__seen")).when(F.col("id") % 3 == 2, F.lit("old"))
    return subs.join(seen, "search_term", "left").withColumn("last_seen_case_identifier", last).drop("__seen")


def change_detection(spark, sf):
    latest = _latest_orders(spark, sf)
    return U.changes(_followers(spark, sf, latest), latest).select("id", "email", "search_term", "identifier", "last_seen_case_identifier")


def cursor_advance(spark, sf):
    latest = _latest_orders(spark, sf)
    subs = _followers(spark, sf, latest)
    sent = U.changes(subs, latest).select(F.col("id").alias("subscription_id"), "identifier").where("subscription_id % 4 <> 0")
    return U.advance(subs, sent).select("id", "last_seen_case_identifier")


def mail_outbox(spark, sf):
    latest = _latest_orders(spark, sf)
    due = U.changes(_followers(spark, sf, latest), latest).withColumn("analysis", F.concat(F.lit("Analysis of "), "case_number"))
    return P.mail_outbox(due).select("subscription_id", "identifier", "recipient", "subject", F.md5("body").alias("body_md5"))


def daily_check_notices(spark, sf):
    latest = _latest_orders(spark, sf).withColumns({"result_pos": F.lit(0), "document_download_link": F.when(F.col("case_number").cast("long") % 2 == 0, F.lit("http://host.example/preuzimanje")), "document_link_text": F.lit(None).cast("string")})
    analyse = lambda cases: cases.select("search_term", F.concat(F.lit("About "), "case_number").alias("analysis"))
    return daily_check(_followers(spark, sf, latest), latest, analyse).select("id", "identifier", "analysis")


def change_feed(spark, sf):
    """Cursors after a run of the feed; every fourth subscription's mail isn't delivered."""
    from ..sources.versioned import VersionedTable
    from ..streaming.change_feed import change_feed as feed

    latest = _latest_orders(spark, sf)
    folder = scratch(spark, "change-feed")
    subs = _followers(spark, sf, latest)
    cursor = VersionedTable.create(subs, f"{folder}/cursor", ["id"], buckets=16)
    # The newest order has no document where its key is odd; the one before it then counts.
    orders = table(spark, sf, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())) - 1
    entries = orders.select(
        F.col("o_custkey").cast("string").alias("search_term"), place.alias("result_pos"), F.col("o_orderkey").cast("string").alias("case_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("title"),
        F.lit("N/A").alias("court"), F.lit("http://host.example").alias("detail_link"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("http://host.example/preuzimanje")).alias("document_download_link"), F.lit(None).cast("string").alias("document_link_text"),
    )
    entries.write.parquet(f"{folder}/entries")
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 100_000).parquet(f"{folder}/entries")
    deliver = lambda mail: mail.where("subscription_id % 4 <> 0")
    analyse = lambda cases: cases.select("search_term", F.concat(F.lit("About "), "case_number").alias("analysis"))
    feed(stream, cursor, f"{folder}/outbox", f"{folder}/state", deliver, analyse).awaitTermination()
    mail = spark.read.schema("subscription_id bigint, body string").parquet(f"{folder}/outbox/mail").select("subscription_id", F.md5("body").alias("body_md5"))
    return cursor.read().join(mail, F.col("id") == F.col("subscription_id"), "left").select("id", "last_seen_case_identifier", "body_md5")


def _messages(spark, sf):
    return table(spark, sf, "conversations").withColumn("content", F.when(F.col("turn") % 3 != 2, F.col("text"))).withColumn("parts", F.when(F.col("turn") % 3 == 2, F.array(F.struct(F.col("text").alias("text")))))


def chat_normalised(spark, sf):
    return C.normalise(_messages(spark, sf)).select("conv_id", "pos", "kind", "content")


def chat_attachment(spark, sf):
    files = table(spark, sf, "conversations").select("conv_id").distinct().where("conv_id % 2 = 0").select("conv_id", F.when(F.col("conv_id") % 4 == 0, "application/pdf").otherwise("image/png").alias("mime_type"), F.concat(F.lit("file-"), F.col("conv_id").cast("string")).alias("original_filename"))
    return C.normalise(_messages(spark, sf), files=files).where("kind = 'human'").select("conv_id", "pos", "content")


def chat_last_n(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return C.last_n(rows, 3)


def chat_without_last(spark, sf):
    return C.without_last(table(spark, sf, "conversations").select("conv_id", "turn", "role"))


def chat_running_text(spark, sf):
    return C.running_digest(table(spark, sf, "conversations").select("conv_id", "turn", "text")).select("conv_id", "turn", "running_md5")


def chat_client_messages(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("is_user"), F.when(F.col("turn") == 3, F.lit(" \t \n")).otherwise(F.col("text")).alias("text"))
    return C.from_client(rows).select("conv_id", "turn", "role", F.length("content").cast("long").alias("n_chars"))


def chat_json_bodies(spark, sf):
    rows = table(spark, sf, "conversations")
    bodies = rows.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))).alias("messages"))
    bodies = bodies.withColumn("messages", F.when(F.col("conv_id") % 10 == 0, F.lit("[]")).when(F.col("conv_id") % 10 == 1, F.lit("not json")).otherwise(F.col("messages")))
    return C.decode(bodies).select("conv_id", F.col("turn").cast("long").alias("pos"), "role", "content")


def token_stream(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.col("role")).alias("content"), F.when(F.col("turn") % 3 == 0, F.col("role")).alias("text"), F.lit("").alias("chunk"))
    return rows.withColumn("said", C.token_content()).where("said is not null").select("conv_id", "turn", "said")


def token_bucket(spark, sf):
    return L.token_bucket(table(spark, sf, "events"), "user_id", *SCALED).select("event_id", "user_id", "allowed", "reason", "retry_after_ms")


def token_bucket_stream(spark, sf):
    from ..streaming.token_bucket import token_bucket_stream as stream

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
        out = scratch(spark, "token-bucket")
        writer = stream(events, "user_id", *SCALED, expire=False).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").outputMode("append")
        writer.trigger(availableNow=True).start(out).awaitTermination()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    return spark.read.parquet(out).select("event_id", F.col("key").cast("long").alias("user_id"), "allowed", "reason", "retry_after_ms")


def fixed_windows(spark, sf):
    return L.fixed_windows(table(spark, sf, "events"), "user_id", ("1 minute", 1), ("1 day", 5)).select("event_id", "pass_first", "allowed")


def queue_times(spark, sf):
    jobs = table(spark, sf, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival"), ((F.col("event_id") % 7 + 1) * 3_600_000).alias("service"))
    return L.queue_times(jobs, ["user_id"], "arrival", "service", "event_id").select("event_id", "start", "end")


def _chunks(spark, sf):
    """The messages of each conversation as one text of event frames, cut every 40 characters; the last chunk ends the connection."""
    body = F.to_json(F.struct(F.col("text").alias("content")), {"ignoreNullFields": "false"})
    rows = table(spark, sf, "conversations").withColumn("frame", F.concat(F.lit("data: "), body, F.lit("\n\n")))
    whole = rows.groupBy("conv_id").agg(T.ordered_text(F.col("frame"), F.col("turn"), "").alias("whole"))
    last = F.floor((F.length("whole") - 1) / 40)
    cut = whole.select("conv_id", "whole", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("seq"))
    return cut.select("conv_id", "seq", F.expr("substring(whole, cast(seq * 40 + 1 as int), 40)").alias("chunk"), (F.col("seq") == F.col("last")).alias("ended"))


def sse_frames(spark, sf):
    return C.frames(_chunks(spark, sf))


def sse_frames_unbuffered(spark, sf):
    return C.frames(_chunks(spark, sf), buffered=False)


_ITEM = (
    '<li class="item row"><div><a href="/objave/{0}" target="_blank"> Title {0} </a><a href="?text={0}">St-{0}/2000</a></div>'
    '<div><small>Sud</small><a href="/objave-sudova/1"><span>Court {1}</span></a></div><span class="m-date">{2}</span>'
    '<div><small class="text-muted d-block">Sudionici</small><div class="d-block"><span class="badge badge-info">Party</span><span>Ana {1}</span>'
    '<small data-original-title="OIB"><sup>OIB</sup>00000000001</small></div></div>{3}</li>'
)


def _result_pages(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    link = F.when(F.col("o_orderkey") % 2 == 0, F.lit('<a href="/d/preuzimanje">Get</a>')).otherwise(F.lit(""))
    item = F.lit(_ITEM)
    for i, c in enumerate((F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.col("day"), link)):
        item = F.replace(item, F.lit("{%d}" % i), c)
    html = F.concat(F.lit("<ul>"), T.ordered_text(F.col("item"), F.col("o_orderkey"), ""), F.lit("</ul>"))
    return rows.withColumn("item", item).groupBy("o_custkey").agg(html.alias("html")).select("o_custkey", F.lit("http://host.example/s?q=1").alias("url"), "html")


def html_entries(spark, sf):
    found = H.html_entries(_result_pages(spark, sf), "o_custkey")
    person = F.get("participants", F.lit(0))
    return found.select("o_custkey", "result_pos", "title", "detail_link", "case_number", "court", "date", "document_download_link", F.concat_ws("|", person["name"], person["oib"], person["address"], person["role"]).alias("person"))


def html_entries_plain(spark, sf):
    return H.html_entries(_result_pages(spark, sf), "o_custkey", full=False).select("o_custkey", "result_pos", "title", "court")


def html_links(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", "url", F.expr("concat('<section id=\"dokumenti\"><a href=\"/x', page_id, '/preuzimanje\"> A\\n  b </a><p><a href=\"/no\">n</a></p></section><a href=\"/y/preuzimanje\">z</a>')").alias("html"))
    return H.html_links(rows).select("page_id", "link_pos", F.regexp_extract("url", "/x[0-9]+/.*$", 0).alias("path"), "text")


def html_navigation(spark, sf):
    return H.html_links(table(spark, sf, "pages"), navigation=True).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"))


def _archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w") as z:
                z.writestr("inner/", "")
                z.writestr("inner/a.txt", text)
                z.writestr("b.bin", "x")
            out.append((doc_id, f"{doc_id}.ZIP" if doc_id % 2 else f"{doc_id}.zip", raw.getvalue() if doc_id % 10 else b"broken"))
        yield pd.DataFrame(out, columns=["doc_id", "path", "content"])


def zip_entries(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", "text").mapInPandas(_archives, "doc_id bigint, path string, content binary")
    return Files.extract_text(Files.expand_archives(files, keep=["doc_id"])).select("doc_id", "entry_pos", "entry_name", F.length("text").cast("long").alias("n_chars"), F.col("error").isNotNull().alias("failed"))


def _named(spark, sf):
    """Documents as files of several kinds: texts, PDFs that only OCR can read, capitals in suffixes, broken ones."""
    ends = F.array(*[F.lit(x) for x in (".txt", ".pdf", ".PDF", ".TXT", ".docx", ".bin")])
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.get(ends, (F.col("doc_id") % 6).cast("int")))
    return table(spark, sf, "documents").select("doc_id", name.alias("entry_name"), F.col("text").cast("binary").alias("content"))


def _pages_of(content: bytes) -> list[str]:
    """An OCR stand-in: two pages, or a failure where the size is a multiple of seven."""
    if len(content) % 7 == 0:
        raise OSError("unreadable image")
    return [f"page one of {len(content)}", "page two"]


def text_by_suffix(spark, sf):
    """Texts by suffix with OCR, and what is left for the dead letters."""
    texts = Files.extract_text(_named(spark, sf), ocr=_pages_of)
    dead = Files.unreadable(texts).select("doc_id", F.lit(True).alias("unreadable"))
    return texts.join(dead, "doc_id", "left").select("doc_id", F.md5("text").alias("text_md5"), F.coalesce("unreadable", F.lit(False)).alias("unreadable"))


def archive_listing(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", "text").mapInPandas(_archives, "doc_id bigint, path string, content binary")
    return Files.archive_listing(files).select("path", "status", F.array_join("extracted_files", ",").alias("names"), F.col("error_message").isNotNull().alias("failed"))


def _fetch(url: str) -> tuple[bytes, dict[str, str]]:
    """A fetch stand-in: the URL's bytes and headers by its page number."""
    number = int(url.rpartition("#")[2])
    if number % 5 == 0:
        raise OSError(f"404 for {number}")
    return url.encode(), {"content-type": "application/pdf"} if number % 2 else {"content-disposition": 'attachment; filename="a.docx"'}


def download_files(spark, sf):
    """Downloads, each by itself, written to a job's folder under safe names and read back."""
    links = table(spark, sf, "pages").select("page_id", F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("url"))
    got = Files.download(links, _fetch)
    end = T.extension_of_download("disposition", "mime", F.lit("x"))
    named = got.select("page_id", "error", "content", F.concat(T.download_name(F.concat(F.lit("Page "), F.col("page_id").cast("string"))), end).alias("file_name"))
    folder = scratch(spark, "downloads")
    Files.write_files(named.where("error is null"), folder)
    there = spark.read.parquet(folder).select("file_name", F.octet_length("content").cast("long").alias("n_bytes"))
    failed = F.col("error").isNotNull()
    return named.select("page_id", "error", F.when(~failed, F.col("file_name")).alias("file_name")).join(there, "file_name", "left").select("page_id", "file_name", "n_bytes", "error")


def detail_page_cases(spark, sf):
    """The newest document of each term with links on its detail page, with all of them."""
    entries = _documents(spark, sf).select("search_term", F.col("doc_id").alias("entry_id"), (-F.col("doc_id")).alias("result_pos"))
    pages = entries.where("entry_id % 7 = 3").select("entry_id", F.explode(F.sequence(F.lit(0), (F.col("entry_id") % 3).cast("int"))).alias("link_pos"))
    links = pages.withColumns({"url": F.concat_ws("/", F.lit("http://host.example"), "entry_id", "link_pos"), "text": F.concat(F.lit("Doc "), "link_pos")})
    found = first_case_by_detail_pages(entries, links)
    return found.select("search_term", "entry_id", F.array_join(F.transform("document_links", lambda x: F.concat(x["url"], F.lit("="), x["text"])), ";").alias("links"))


def _echo():
    def reply(chat: str) -> str:
        messages = json.loads(chat)
        if len(messages) % 4 == 0:
            raise RuntimeError("the model is down")
        return f"{len(messages)} messages, the last of {len(messages[-1]['content'])}"

    return reply


def chat_turn(spark, sf):
    return answer_chats(_messages(spark, sf), _echo).select("conv_id", "reply", "error")


def chat_history(spark, sf):
    """Stored, and read again; a folder that isn't there reads as a first visit."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    folder = scratch(spark, "history")
    schema = "conv_id bigint, turn bigint, role string, text string"
    first_visit = C.read_history(spark, folder, schema)
    C.write_history(rows, folder, 4)
    return C.read_history(spark, folder, schema).union(first_visit).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def term_checks(spark, sf):
    odd = F.concat(F.lit(" \t"), F.left("p_name", (F.col("p_partkey") % 12).cast("int")), F.lit("\n"))
    return table(spark, sf, "part").select("p_partkey", T.is_search_term(odd).alias("enough"))


def iso_times(spark, sf):
    return table(spark, sf, "events").select("event_id", T.iso_time("ts").alias("iso"), F.year("ts").alias("year"))


def inline_data(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.data_url(F.col("html").cast("binary"), "image/png")).alias("url_md5"))


def upload_admission(spark, sf):
    kinds = F.array(*[F.lit(m) for m in ("application/pdf", "image/png", "text/html", "image/tiff")])
    rows = table(spark, sf, "pages").select("page_id", F.get(kinds, (F.col("page_id") % 4).cast("int")).alias("mime"), (F.length("html").cast("long") * 200).alias("length"))
    return Files.admitted(rows)


def clamp_settings(spark, sf):
    k = F.col("event_id") % 6
    shown = F.when(k == 0, F.lit("abc")).when(k == 1, F.lit(None).cast("string")).otherwise((F.col("event_id") % 23).cast("string"))
    return table(spark, sf, "events").select("event_id", T.text_size(shown).alias("size"))


def search_by_term(spark, sf):
    return S.by_term(_documents(spark, sf), "src3").select("doc_id", "lang")


def display_defaults(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority")).alias("court"))
    return P.display(rows, ["court"])


def whitespace(spark, sf):
    odd = F.concat(F.lit("﻿ \t"), F.col("p_name"), F.lit("   OIB OIB x\n"))
    return table(spark, sf, "part").select("p_partkey", T.trimmed(odd).alias("trimmed"), T.one_space(odd).alias("one_space"), T.trimmed(T.without_first(odd, "OIB")).alias("without_first"))


QUERIES = {
    f.__name__: f
    for f in (
        digest_latest_two, latest_n_with_documents, first_with_documents, latest_per_case, status_annotation, case_counts, single_case_summary, comparative_context,
        synthesis_prompts, synthesis_texts, progress_errors, token_frames, change_feed, nested_payload, payload_shape, prompt_text, model_extract, progress_events, download_progress, safe_names, markdown_export, extension_ladder,
        fence_strip_parse, subscribe_inserts, subscribe_conflicts, subscribe_ids, unsubscribe, active_subscriptions, change_detection, cursor_advance, mail_outbox,
        daily_check_notices, chat_normalised, chat_attachment, chat_last_n, chat_without_last, chat_running_text, chat_client_messages, chat_json_bodies, token_stream,
        token_bucket, token_bucket_stream, fixed_windows, queue_times, sse_frames, sse_frames_unbuffered, html_entries, html_entries_plain, html_links, html_navigation,
        zip_entries, text_by_suffix, archive_listing, download_files, detail_page_cases, chat_turn, chat_history, term_checks, iso_times, inline_data, upload_admission, clamp_settings, search_by_term, display_defaults, whitespace,
    )
}
