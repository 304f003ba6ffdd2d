"""Ordered digests of analysed documents: by entry, then over the entries of a term."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ordered_text, truthy
from .analyze import calls
from .replies import ReplyStore

# The texts that stand for a missing analysis.
NO_DATA = "Nema dostupnih podataka za generiranje analize."
NO_SUMMARY = "Analiza dokumenata nije uspješno izvršena za jedinu pronađenu objavu."
NO_DOCUMENTS = "Nema dokumenata za analizu."
SINGLE_FAILED = "Greška pri generiranju završnog sažetka."
SEVERAL_FAILED = "Greška pri generiranju usporedne analize."


def good_summary(summary: Column) -> Column:
    """The summary of a successful analysis, else null."""
    return F.when(truthy(summary), summary)


def per_entry(files: DataFrame, term: str = "search_term") -> DataFrame:
    """One row for each entry: its good summaries in document order, joined both ways.
    `files` has the term, case_pos, title, date, doc_pos and summary; an entry without
    files is a row whose doc_pos is null."""
    good = good_summary(F.col("summary"))
    order = F.col("doc_pos")
    return files.groupBy(term, "case_pos").agg(
        F.first("title").alias("title"),
        F.first("date").alias("date"),
        F.count("doc_pos").alias("n_docs"),
        ordered_text(good, order, "\n").alias("lines"),
        ordered_text(good, order, "\n\n---\n\n").alias("single"),
    )


def entry_block(case_pos: Column, title: Column, date: Column, summaries: Column) -> Column:
    """An entry's block in the comparison; a missing field reads undefined."""
    field = lambda c: F.coalesce(c.cast("string"), F.lit("undefined"))
    return F.concat(F.lit("--- Case Entry "), case_pos.cast("string"), F.lit(" ---\nTitle: "), field(title), F.lit("\nDate: "), field(date), F.lit("\nSummary of Documents:\n"), F.coalesce(summaries, F.lit("")), F.lit("\n\n"))


def per_term(entries: DataFrame, term: str = "search_term") -> DataFrame:
    """One row for each term: the number of entries, and the context of its synthesis: the
    summaries of a single entry (or the text that says that there are none), or the blocks of several."""
    block = entry_block(F.col("case_pos"), F.col("title"), F.col("date"), F.col("lines"))
    both = entries.groupBy(term).agg(F.count(F.lit(1)).alias("n_cases"), F.sum("n_docs").alias("n_docs"), ordered_text(block, F.col("case_pos"), "").alias("several"), F.first("single").alias("single"))
    one = F.when(truthy("single"), F.col("single")).otherwise(F.lit(NO_SUMMARY))
    return both.select(term, "n_cases", "n_docs", F.when(F.col("n_cases") == 1, one).otherwise(F.col("several")).alias("context"))


def final_summary(n_docs: Column) -> Column:
    """What an entry without documents says in place of a summary; null for others."""
    return F.when(F.coalesce(n_docs, F.lit(0)) == 0, F.lit(NO_DOCUMENTS))


def synthesis_prompt(n_cases: Column, context: Column) -> Column:
    """The request for the final text; null where the context is already final."""
    # The wording of both requests.
    one = F.concat(F.lit("Synthesize the following summaries into a coherent overview (in Croatian):\n\n"), context, F.lit(". Try to extrapolate what might happen next in the case going forward, and what the next steps are for the parties involved."))
    several = F.concat(
        F.lit("Synthesize the following "),
        n_cases.cast("string"),
        F.lit(" summaries into a coherent overview, in Croatian. Try to predict the most likely developments in the case, as well as what the next steps are for the parties involved.\n    Here is the data:\n"),
        context,
        F.lit(". In case there are any numerical figures try to arrange them into a table for clarity."),
    )
    return F.when((n_cases == 0) | ((n_cases == 1) & (context == NO_SUMMARY)), F.lit(None).cast("string")).when(n_cases == 1, one).otherwise(several)


def final_texts(digest: DataFrame, make: Callable[[], Callable[[str], str]], terms: DataFrame | None = None, term: str = "search_term", store: ReplyStore | None = None) -> DataFrame:
    """(term, n_cases, analysis) of `per_term` rows: the model's text, or the one that says that its
    call failed, that no summary is good, or, for those of `terms` without entries, that there is no data. With a
    `store` equal requests are made once over all its runs."""
    every = digest if terms is None else terms.select(term).distinct().join(digest, term, "left")
    every = every.withColumn("n_cases", F.coalesce("n_cases", F.lit(0)).cast("long"))
    request = synthesis_prompt(F.col("n_cases"), F.col("context"))
    if store is None:
        asked = every.withColumn("__said", calls(make)(request))
    else:
        asked = store.ask(every.withColumn("__request", request), "__request", make).withColumn("__said", F.struct("reply", "error"))
    failed = F.when(F.col("n_cases") == 1, F.lit(SINGLE_FAILED)).otherwise(F.lit(SEVERAL_FAILED))
    said = F.when(F.col("__said.error").isNotNull(), failed).otherwise(F.coalesce("__said.reply", "context"))
    return asked.select(term, "n_cases", F.when(F.col("n_cases") == 0, F.lit(NO_DATA)).otherwise(said).alias("analysis"))
