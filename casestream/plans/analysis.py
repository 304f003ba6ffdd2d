"""Composite operators: the whole analysis of a term's newest entries, the daily check, a chat turn."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analyze import analyze, default_analyzer
from ..operators.chat import normalise
from ..operators.digest import per_entry, per_term
from ..operators.payload import CASE_FIELDS, nested_payload
from ..operators.replies import ReplyStore
from ..operators.select import document_links, first_per_term, first_with_links, latest_n, with_documents
from ..operators.subscriptions import changes
from ..session import scratch
from ..sources.files import download, expand_archives, extract_text
from ..sources.tables import find_entries


def latest_with_documents(entries: DataFrame, n: int = 2) -> DataFrame:
    """The newest n entries of each term that have documents, and their links."""
    return document_links(latest_n(with_documents(entries), n))


def first_case_with_documents(entries: DataFrame) -> DataFrame:
    return document_links(first_per_term(with_documents(entries)), F.lit("Preuzimanje dokumenta"))


def first_case_by_detail_pages(entries: DataFrame, links: DataFrame, key: str = "entry_id") -> DataFrame:
    """The newest entry whose detail page has links, with all of them in order."""
    gathered = links.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("link_pos", "url", "text"))).alias("l"))
    gathered = gathered.select(key, F.transform("l", lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text"))).alias("document_links"))
    return first_with_links(entries, links, key).join(gathered, key)


def case_files(cases: DataFrame, fetch: Callable[[str], tuple[bytes, dict[str, str]]], pdf=None, ocr=None, term: str = "search_term") -> DataFrame:
    """A row for each document of each case, its text read; a case without any keeps one row
    whose doc_pos is null. Archives are recognised by the extension that the download gives."""
    from ..functions.text import extension_of_download

    case = [term, "case_pos", *CASE_FIELDS]
    linked = cases.select(*case, F.posexplode_outer("document_links").alias("link_pos", "link")).select(*case, "link_pos", "link.url", F.col("link.text").alias("link_text"))
    got = download(linked.where("url is not null"), fetch).where("error is null").drop("error")
    got = got.withColumn("path", F.concat_ws("", F.lit("document"), extension_of_download("disposition", "mime", "link_text"))).where("path <> 'document'")
    keep = [term, "case_pos", "link_pos", "url", "link_text"]
    opened = expand_archives(got.select("path", *keep, "content"), "path", keep)
    archive = F.lower("path").endswith(".zip")
    readers = {k: v for k, v in (("pdf", pdf), ("ocr", ocr)) if v}
    named = opened.withColumn("entry_name", F.when(archive, F.col("entry_name")).otherwise(F.col("path")))
    texts = extract_text(named, **readers)
    place = F.row_number().over(_case_order(term)) - 1
    files = texts.withColumn("doc_pos", place).select(term, "case_pos", "doc_pos", "url", F.when(archive, F.col("entry_name")).otherwise(F.col("link_text")).alias("file_name"), "text")
    return cases.select(*case).join(files, [term, "case_pos"], "left")


def _case_order(term: str):
    from pyspark.sql import Window

    return Window.partitionBy(term, "case_pos").orderBy("link_pos", "entry_pos")


def processed_cases(files: DataFrame, make: Callable[[], Callable[[str], str]] = default_analyzer, synthesise: Callable | None = None, term: str = "search_term", store: ReplyStore | None = None) -> DataFrame:
    """One row for each term: the nested result. `files` are rows of `case_files`; a case
    without files has empty arrays. `synthesise` maps (n_cases, context) columns to the final text; by
    default the context itself. Files are read and analysed once, and the analysed rows written to the shared folder, from which
    all else is made; equal prompts are asked once, over all runs if a `store` is given."""
    spark = files.sparkSession
    store = store or ReplyStore(spark, scratch(spark, "replies"))
    done, folder = analyze(files, make, store), scratch(spark, "analysed")
    there = F.col("doc_pos").isNotNull()
    done.withColumns({c: F.when(there, F.col(c)) for c in ("ai_result", "raw_json", "error")}).write.parquet(folder)
    both = spark.read.parquet(folder)
    shown = both.withColumn("summary", F.col("ai_result.summary"))
    digest = per_term(per_entry(shown, term), term)
    digest = digest.withColumn("context", synthesise(F.col("n_cases"), F.col("context"))) if synthesise else digest
    named = both.drop("text").withColumnRenamed("file_name", "text")
    return nested_payload(named, digest, term)


def run_analysis(entries: DataFrame, fetch, n: int = 2, make=default_analyzer, synthesise=None, pdf=None, ocr=None, store: ReplyStore | None = None) -> DataFrame:
    """From entries to the final nested result of each term."""
    return processed_cases(case_files(latest_with_documents(entries, n), fetch, pdf, ocr), make, synthesise, store=store)


def run_terms(spark: SparkSession, terms: list[str], fetch, search: dict[str, str], **options) -> DataFrame:
    """The whole analysis from search terms: `search` are the options of `SearchSource`, which looks the terms up in tasks
    of their own; their newest entries are analysed as by `run_analysis`. Results are placed by page and place on the page."""
    found = find_entries(spark, terms, **search)
    return run_analysis(found.withColumn("result_pos", F.struct("page", "result_pos")), fetch, **options)


def daily_check(subscriptions: DataFrame, entries: DataFrame, analyse: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Notices due: changed subscriptions with the analysis of their newest entry. Each term is
    looked up and analysed once, and only terms with a changed subscription are analysed.
    `analyse` maps entries to (search_term, analysis)."""
    due = changes(subscriptions, first_per_term(with_documents(entries)))
    if analyse is None:
        return due.withColumn("analysis", F.lit(""))
    terms = due.select("search_term").distinct()
    return due.join(analyse(latest_with_documents(entries.join(terms, "search_term", "left_semi"), 1)), "search_term", "left")


def chat_turn(messages: DataFrame, reply: Callable[[], Callable[[str], str]], files: DataFrame | None = None, key: str = "conv_id") -> DataFrame:
    """(key, reply, error): the model's answer to each conversation's normalised messages, as JSON."""
    from ..operators.analyze import calls

    rows = normalise(messages, key, files)
    packed = rows.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind", "content"))), lambda m: F.struct(m["kind"].alias("role"), m["content"].alias("content")))).alias("chat"))
    return packed.select(key, calls(reply)("chat").alias("r")).select(key, "r.*")
