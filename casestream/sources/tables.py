"""Snapshot tables, the subscriptions' database, and a search source with filter pushdown and offsets."""

from __future__ import annotations

import importlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from .files_anywhere import Store
from .html import html_entries


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def subscriptions_jdbc(spark: SparkSession, url: str, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """Active subscriptions; the predicate runs in the database. With `bounds`, about the least and largest id, the
    table is read in so many ranges of ids at once (rows outside the bounds are in the first or last)."""
    reader = spark.read.format("jdbc").options(url=url, dbtable="subscriptions", **options)
    if bounds:
        reader = reader.options(partitionColumn="id", lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load().where("is_active = true")


# -- search ----------------------------------------------------------------


PAGE = "search_term string, page int, url string, html string"


class ArchiveSearch:
    """Searches an archive of result pages: Parquet (page, url, html) under search_term=<term>, pages numbered from 0 and
    never changed once there. A live search has the same two methods."""

    def __init__(self, options: dict[str, str]):
        self.store = Store(options["archive"])

    def _pages(self, term: str):
        from urllib.parse import quote

        import pyarrow.dataset as ds

        # Spark writes a partition's value with these characters escaped; a term without pages has no folder.
        escaped = "".join(quote(c, safe="") if c in "\"#%'*/:=?\\\x7f{[]^" or c < " " else c for c in term)
        folder = f"search_term={escaped}"
        return ds.dataset(self.store.at(folder), filesystem=self.store.fs, format="parquet") if self.store.exists(folder) else None

    def n_pages(self, term: str) -> int:
        import pyarrow.compute as pc

        found = self._pages(term)
        numbers = found.to_table(columns=["page"]).column("page") if found else []
        return pc.max(numbers).as_py() + 1 if len(numbers) else 0

    def pages(self, term: str, first: int, last: int) -> Iterator[tuple[int, str, str]]:
        """(page, url, html) of the pages from `first` up to before `last`, in order."""
        import pyarrow.dataset as ds

        found = self._pages(term)
        if found is not None:
            for page in range(first, last):
                for r in found.to_table(columns=["page", "url", "html"], filter=ds.field("page") == page).to_pylist():
                    yield page, r["url"], r["html"]


class SearchSource(DataSource):
    """`spark.read.format("case_search")`: the result pages that a search finds for terms, as PAGE.

    `archive` names a folder for `ArchiveSearch`, or `search` ("module:Class") another search, made with the options. The terms
    come from a pushed equality or IN filter on search_term, or from the option `terms`, one on each line. Each term is read by
    tasks of its own, of `pages_each` pages at most, so that a term with many results isn't one task. As a stream,
    an offset holds how many pages of each term have been read: a restart repeats nothing, and a batch that runs again reads the same."""

    @classmethod
    def name(cls) -> str:
        return "case_search"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _SearchStream(self.options)


class _Part(InputPartition):
    def __init__(self, term: str, first: int, last: int):
        self.term, self.first, self.last = term, first, last


class _Search:
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)
        self.terms = [t for t in options.get("terms", "").split("\n") if t]

    def _made(self):
        module, _, name = self.options.get("search", "").partition(":")
        return getattr(importlib.import_module(module), name)(self.options) if module else ArchiveSearch(self.options)

    def _parts(self, term: str, first: int, last: int) -> list[_Part]:
        each = int(self.options.get("pages_each", "64"))
        return [_Part(term, a, min(a + each, last)) for a in range(first, last, each)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for page, url, html in self._made().pages(partition.term, partition.first, partition.last):
            yield (partition.term, page, url, html)


class _SearchReader(_Search, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("search_term",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.terms = [t for t in self.terms if t in asked] if self.terms else sorted(t for t in asked if t is not None)
                self.filtered = True
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if not self.terms and not getattr(self, "filtered", False):
            raise ValueError("a search term is needed")
        search = self._made()
        return [p for t in dict.fromkeys(self.terms) for p in self._parts(t, 0, search.n_pages(t))] or [_Part("", 0, 0)]


class _SearchStream(_Search, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {t: 0 for t in self.terms}

    def latestOffset(self) -> dict:
        search = self._made()
        return {t: search.n_pages(t) for t in self.terms}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [p for t, last in end.items() for p in self._parts(t, start.get(t, 0), last)]

    def commit(self, end: dict) -> None:
        pass


#: Filters go to sources that are written in Python; off by default.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def search_pages(spark: SparkSession, terms: list[str], **options: str) -> DataFrame:
    """The result pages of the given terms (`options`: archive or search). A filter on search_term narrows the search itself."""
    spark.dataSource.register(SearchSource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("case_search").options(terms="\n".join(terms), **options).load()


def find_entries(spark: SparkSession, terms: list[str], **options: str) -> DataFrame:
    """The entries of the given terms: search_term, page and those of `html_entries`."""
    return html_entries(search_pages(spark, terms, **options), ["search_term", "page"])


def entry_stream(spark: SparkSession, terms: list[str], **options: str) -> DataFrame:
    """The entries of the given terms as they are published."""
    spark.dataSource.register(SearchSource)
    return html_entries(spark.readStream.format("case_search").options(terms="\n".join(terms), **options).load(), ["search_term", "page"])


def write_archive(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Result pages (search_term, page, url, html) as `ArchiveSearch` reads them."""
    pages.repartition("search_term", "page").write.mode(mode).partitionBy("search_term").parquet(path)
