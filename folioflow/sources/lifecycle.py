"""Sources, formats, sinks and extractors as registered plugins, and the life of a source.

A source connects (and then knows its number of records) and gives pages; what else it may do has a
default. Sources hold a DataFrame; file and feed sources parse once and keep the result as a table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import identity_sha1, lock_name
from ..operators import search
from ..operators.library import whole_row
from ..operators.matching import uniquified
from ..plugins import REGISTRY, plugin, register
from . import readers
from .records import FileFormatError, with_fields

__all__ = ["REGISTRY", "plugin", "register"]

#: Records that a page of an online provider holds. Fixed values.
PAGE_SIZES = {"PubMed": 25, "ArXiv": 25, "GoogleScholar": 10, "SpringerLink": 10, "ACM": 20, "JSTOR": 25, "CiteSeerX": 25, "GoogleBooks": 25}
#: Seconds until an online search warns, and until it ends. Fixed values.
SEARCH_WARN, SEARCH_END = 15, 35

class Source:
    """What every source can do; ``load`` is all that a new one must bring."""

    order: tuple = ()
    needs_match_before_import = False

    def __init__(self, spark: SparkSession, query: str = "", limit: int = 10):
        self.spark, self.query, self.limit = spark, query, limit
        self.records: DataFrame | None = None
        self.total_entries: int | None = None
        self._pages: dict[tuple[int, int], DataFrame] = {}

    def load(self) -> DataFrame:
        raise NotImplementedError

    def connect(self) -> int:
        self.records = self.load()
        self.total_entries = self.records.count()
        return self.total_entries

    def connect_within(self, warn: float = SEARCH_WARN, end: float = SEARCH_END, on_warn=None, canceled=None) -> int:
        """As ``connect``, with a warning after some seconds; after some more, or once a user cancels, its jobs end."""
        from ..streaming.run import limited

        return limited(self.spark, self.connect, warn, end, on_warn, canceled)

    def page(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        if self.records is None:
            self.connect()
        return search.page(self.records, offset, limit or self.limit, [F.col(c).desc() if d else F.col(c) for c, d in self.order])

    def kept_page(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        """As ``page``; a page that was asked for before is not worked out again until ``cleanup``."""
        key = (offset, limit or self.limit)
        if key not in self._pages:
            self._pages[key] = self.page(offset, limit).persist()
        return self._pages[key]

    def all(self, most: int | None = None) -> DataFrame:
        """Every record; the first ``most`` where a bound is wanted."""
        if self.records is None:
            self.connect()
        return search.all_rows(self.records, [F.col(c).desc() if d else F.col(c) for c, d in self.order], most)

    def find_guid(self, guid: str) -> DataFrame:
        return self.records.where(F.col("guid") == guid)

    def needs_completing(self) -> Column:
        return F.lit(False)

    def complete_details(self, records: DataFrame) -> DataFrame:
        return records

    def match(self, records: DataFrame) -> DataFrame:
        return records.limit(0)

    def cleanup(self) -> None:
        for page in [*self._pages.values(), *([self.records] if self.records is not None else [])]:
            page.unpersist()
        self._pages.clear()


@register("source", "file")
class FileSource(Source):
    """A citation file: found format, parsed once, blank keys, one record of each identity."""

    order = (("position", False),)

    def __init__(self, spark, path: str, **more):
        super().__init__(spark, **more)
        self.path = path

    def load(self) -> DataFrame:
        from .detect import text_format

        files = readers.text_files(self.spark, self.path)
        kinds = [r["f"] for r in files.select(text_format(F.col("content")).alias("f")).distinct().collect()]  # one small row a format
        if len(kinds) != 1 or kinds[0] not in readers.PARSERS:
            raise FileFormatError(f"{self.path}: {', '.join(map(str, kinds)) or 'nothing'}")
        parsed = readers.read_ris_files(self.spark, self.path) if kinds[0] == "RIS" else readers.read_bibtex_files(self.spark, self.path)
        return readers.import_records(parsed).persist()

    def table_name(self) -> str:
        """The name of the table that keeps the parsed records."""
        return self.spark.range(1).select(lock_name(F.lit(self.path)).alias("n")).first()["n"]


@register("source", "feed")
class FeedSource(Source):
    """A feed's files; every item lacks its details until it is matched. Of items with one identity, that whose link sorts first stays."""

    order = (("linkout", False), ("title", False))

    def __init__(self, spark, path: str, **more):
        super().__init__(spark, **more)
        self.path = path

    def load(self) -> DataFrame:
        items = with_fields(readers.read_feed(self.spark, self.path))
        items = items.withColumn("sha1", identity_sha1(F.col("authors"), F.col("title")))
        return uniquified(items, ["sha1"], [F.col("linkout").asc_nulls_last(), whole_row(items)]).persist()

    def reload(self) -> int:
        self.cleanup()
        return self.connect()

    def needs_completing(self) -> Column:
        return F.col("needs_details")

    def complete_details(self, records: DataFrame) -> DataFrame:
        return records.withColumn("needs_details", F.lit(False))


@register("source", "db")
class LibrarySource(Source):
    """A library's records that match a query; newest first. Sorting may be left out for many, as an option."""

    order = (("created", True), ("guid", False))
    trash = False

    def __init__(self, spark, table: DataFrame, fields: dict[str, Column], sort_limit: int | None = None, **more):
        super().__init__(spark, **more)
        self.table, self.fields, self.sort_limit = table, fields, sort_limit

    def load(self) -> DataFrame:
        return search.search(self.table, self.query, self.fields, {"guid": F.col("guid")}, self.trash)

    def page(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        if self.records is None:
            self.connect()
        if self.sort_limit is not None and self.total_entries >= self.sort_limit:
            return search.page(self.records, offset, limit or self.limit)
        return super().page(offset, limit)


@register("source", "trash")
class TrashSource(LibrarySource):
    trash = True


@register("source", "provider")
class ProviderSource(Source):
    """An online provider, by a table of what it would answer; there is no network here."""

    needs_match_before_import = True
    order = (("guid", False),)

    def __init__(self, spark, name: str, answers: DataFrame, fields: dict[str, Column], **more):
        super().__init__(spark, **({"limit": PAGE_SIZES[name]} | more))
        self.name, self.answers, self.fields = name, answers, fields

    def load(self) -> DataFrame:
        return search.search(self.answers, self.query, self.fields)

    def match(self, records: DataFrame) -> DataFrame:
        from ..operators.matching import match_by_priority

        return match_by_priority(records.withColumnRenamed("guid", "record"), self.answers, "record")


def url_match(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Records with a link, completed from the page there; empty and word-processor links are refused by the reader.

    Of pages with one address the one with the smallest ``page_id`` counts, or where they have none, the smallest text."""
    from ..operators.matching import merge_record
    from ..operators.webpages import extract_records

    order = F.struct(*(c for c in ("page_id", "html") if c in pages.columns))
    one = pages.where("url is not null and html is not null").groupBy("url").agg(F.min_by("html", order).alias("html"))
    linked = records.where(F.col("linkout").isNotNull()).select(F.col("guid").alias("_key"), F.col("linkout").alias("url")).join(one, "url")
    found = extract_records(linked, key="_key").where("error is null")
    have = [c for c in records.columns if c in found.columns and c != "guid"]
    return merge_record(records, found.select(F.col("_key").alias("guid"), *have), "guid", have, keep=("guid", "citekey", "sha1"))


def enough_typed(c: Column, least: int = 3) -> Column:
    """``typed_enough`` of a column."""
    return (c == "") | (F.length(F.regexp_replace(c, r"\s", "")) >= least)


def typed_enough(text: str, least: int = 3) -> bool:
    """Whether an input is long enough to search for; an empty one resets."""
    return not text or len(re.sub(r"\s", "", text)) >= least
