"""Choosing entries. Order is data: `result_pos` counts from the newest entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import or_else, truthy


def with_documents(entries: DataFrame, link: str = "document_download_link") -> DataFrame:
    """Entries that have a document link."""
    return entries.where(truthy(link))


def latest_n(entries: DataFrame, n: int = 2, term: str = "search_term", order: list[Column] | None = None) -> DataFrame:
    """The first n entries of each term, with case_pos from 1. The rank limit is applied before the shuffle too."""
    place = Window.partitionBy(term).orderBy(*(order or [F.col("result_pos")]))
    return entries.withColumn("case_pos", F.row_number().over(place)).where(F.col("case_pos") <= n)


def first_per_term(entries: DataFrame, term: str = "search_term", order: list[Column] | None = None) -> DataFrame:
    return latest_n(entries, 1, term, order).drop("case_pos")


def first_with_links(entries: DataFrame, links: DataFrame, key: str, term: str = "search_term", order: list[Column] | None = None) -> DataFrame:
    """The first entry of each term whose detail page has links."""
    return first_per_term(entries.join(links.select(key).distinct(), key, "left_semi"), term, order)


def latest_per_case(entries: DataFrame, number: str = "case_number", title: str = "title", order: list[Column] | None = None) -> DataFrame:
    """The first entry of each case: its number, or else its title. Entries with neither go."""
    keyed = entries.withColumn("__case", or_else(number, or_else(title, F.lit(None).cast("string")))).where("__case is not null")
    place = Window.partitionBy("__case").orderBy(*(order or [F.col("result_pos")]))
    return keyed.withColumn("__nth", F.row_number().over(place)).where("__nth = 1").drop("__case", "__nth")


def document_links(entries: DataFrame, default: Column | None = None) -> DataFrame:
    """Entries with document_links: one link, its text by default built from the case number."""
    text = or_else("document_link_text", default if default is not None else F.concat(F.lit("Dokumenti za "), F.col("case_number")))
    return entries.withColumn("document_links", F.array(F.struct(F.col("document_download_link").alias("url"), text.alias("text"))))


def by_term(entries: DataFrame, term: str, column: str = "search_term") -> DataFrame:
    """A search: the filter reaches the scan."""
    if not term:
        raise ValueError("a search term is needed")
    return entries.where(F.col(column) == term)


search_by_id = search_by_name = search_by_case_number = by_term
