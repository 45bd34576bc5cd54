"""Citations for a word processor: XML requests in, XML answers out, for any number of documents at once.

A document keeps its own records as one string, so that it can be opened where the library isn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import __version__
from ..functions.structured import from_xml_text, xml_text
from ..operators import search
from ..sources.records import FIELDS, PUBLICATION, QueryError, with_fields
from .writers import STYLES, styled_citation

REQUEST = "documentID string, style string, documentLibrary string, citations struct<citation:array<struct<item:array<string>>>>"
_RECORDS = T.ArrayType(PUBLICATION)


def ping(spark: SparkSession) -> DataFrame:
    """One row ``xml`` with the version."""
    return spark.range(1).select(xml_text(F.struct(F.lit(__version__).alias("version")), "xml").alias("xml"))


def list_styles(spark: SparkSession) -> DataFrame:
    """One row ``xml`` with the names of all styles."""
    return spark.range(1).select(xml_text(F.struct(F.array(*map(F.lit, sorted(STYLES))).alias("style")), "xml").alias("xml"))


def library_string(records: Column) -> Column:
    """A list of records as a string without line ends or markup."""
    return F.base64(F.to_json(records).cast("binary"))


def opened(requests: DataFrame) -> DataFrame:
    """documentID and the record fields of what each document of the requests (column ``xml``) keeps; none for a new one."""
    r = requests.select(from_xml_text(F.col("xml"), REQUEST, "xml").alias("r")).select("r.documentID", "r.documentLibrary")
    kept = F.from_json(F.unbase64("documentLibrary").cast("string"), _RECORDS)
    return r.select("documentID", F.explode(kept).alias("p")).select("documentID", "p.*")


def search_results(library: DataFrame, query: str, fields: dict[str, Column], limit: int = 10) -> DataFrame:
    """One row ``xml`` with id and title of the first matches, in order of their ids."""
    found = search.page(search.search(library, query, fields, {"guid": F.col("guid")}).select(F.col("guid").alias("id"), "title"), 0, limit, [F.col("id")])
    return found.agg(F.array_sort(F.collect_list(F.struct("id", "title"))).alias("result")).select(xml_text(F.struct("result"), "xml").alias("xml"))


def format_citations(requests: DataFrame, library: DataFrame) -> DataFrame:
    """documentID and an ``xml`` answer for each request (column ``xml``): marks like [1,2] for the citations, their ids, the numbered
    bibliography in the order of first use, and the cited records as the document's own library. Unknown ids have no text."""
    r = requests.select(from_xml_text(F.col("xml"), REQUEST, "xml").alias("r")).select("r.documentID", F.lower("r.style").alias("style"), F.posexplode("r.citations.citation").alias("place", "c"))
    items = r.select("documentID", "style", "place", F.posexplode("c.item").alias("at", "id")).withColumn("id", F.trim("id"))
    first = items.groupBy("documentID", "style", "id").agg(F.min(F.struct("place", "at")).alias("first"))
    numbers = first.withColumn("n", F.row_number().over(Window.partitionBy("documentID").orderBy("first"))).drop("first")
    records = with_fields(library)
    texts = records.select(F.col("guid").alias("id"), F.struct(*FIELDS).alias("record"), *(styled_citation(records, s).alias(f"_{k}") for k, s in enumerate(STYLES)))
    text = F.lit(None).cast("string")
    for k, s in enumerate(STYLES):
        text = F.when(F.col("style") == s, F.col(f"_{k}")).otherwise(text)
    unknown = F.raise_error(F.concat(F.lit("no style "), F.coalesce("style", F.lit("given")))).cast("string")
    cited = numbers.join(texts, "id", "left").withColumn("text", F.when(F.coalesce(F.col("style").isin(*STYLES), F.lit(False)), text).otherwise(unknown))
    line = F.concat(F.col("n").cast("string"), F.lit(". "), F.coalesce("text", F.lit("")))
    works = cited.groupBy("documentID").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("bibliography"),
        library_string(F.transform(F.array_sort(F.collect_list(F.when(F.col("record").isNotNull(), F.struct("n", "record")))), lambda x: x["record"])).alias("documentLibraryString"),
    )
    marks = items.join(numbers.select("documentID", "id", "n"), ["documentID", "id"]).groupBy("documentID", "place").agg(F.array_sort(F.collect_list(F.struct("at", "n", "id"))).alias("x"))
    marks = marks.select("documentID", "place", F.concat(F.lit("["), F.array_join(F.transform("x", lambda i: i["n"].cast("string")), ","), F.lit("]")).alias("mark"), F.struct(F.transform("x", lambda i: i["id"]).alias("item")).alias("ids"))
    whole = marks.groupBy("documentID").agg(F.array_sort(F.collect_list(F.struct("place", "mark", "ids"))).alias("x")).join(works, "documentID")
    answer = F.struct(
        F.struct(F.transform("x", lambda i: i["mark"]).alias("citation")).alias("citations"), F.struct(F.transform("x", lambda i: i["ids"]).alias("citation")).alias("ids"), "bibliography", "documentLibraryString"
    )
    return whole.select("documentID", xml_text(answer, "xml").alias("xml"))


def command(spark: SparkSession, name: str, **given) -> DataFrame:
    """The answer of a command by its name, with what that command takes."""
    known = {"ping": ping, "list_styles": list_styles, "open": lambda _, **x: opened(**x), "search": lambda _, **x: search_results(**x), "format_citations": lambda _, **x: format_citations(**x)}
    if name not in known:
        raise QueryError(f"no command {name}")
    return known[name](spark, **given)
