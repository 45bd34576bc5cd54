"""The publication record: its schema, codecs of its multi-valued fields, and error classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTITY = ("guid", "sha1", "citekey", "doi", "pmid", "arxivid", "eprint", "isbn", "issn", "lccn")
BIBLIOGRAPHIC = (
    "pubtype", "title", "booktitle", "series", "authors", "editors", "journal", "volume", "issue", "number", "pages", "year", "month", "day",
    "publisher", "organization", "school", "address", "edition", "chapter", "howpublished", "keywords", "abstract", "affiliation", "note", "annote", "url", "linkout", "language",
)
MEMBERSHIP = ("labels", "folders_tmp")
FIELDS = (*IDENTITY, *BIBLIOGRAPHIC, *MEMBERSHIP)
PUBTYPES = ("ARTICLE", "INBOOK", "BOOK", "INCOLLECTION", "MANUAL", "MASTERSTHESIS", "MISC", "INPROCEEDINGS", "PROCEEDINGS", "PHDTHESIS", "TECHREPORT", "UNPUBLISHED")

PUBLICATION = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])

#: Tables of a library. Constraints (unique guid and sha1, pair keys) are kept by the operators that write.
LIBRARY = {
    "publications": "guid string, sha1 string, pdf string, pdf_name string, attachments string, annote string, labels string, labels_tmp string, folders string, trashed boolean, times_read int, created timestamp, last_read timestamp",
    "collections": "guid string, name string, type string, parent string, sort_order int, hidden boolean, style string",
    "collection_publication": "collection_guid string, publication_guid string",
    "attachments": "guid string, publication string, name string, local_file string, md5 string, is_pdf boolean, size long",
    "changelog": "counter long, guid string, type string",
    "settings": "key string, value string",
    "queue": "jobid string, guid string, status string, type string, hidden boolean, error boolean, duration long",
    "journals": "short string, long string, issn string, essn string, source string, url string, icon string, reviewed boolean",
}
#: Columns that a keyword query may name. Fixed values.
SEARCH_FIELDS = ("guid", "text", "abstract", "notes", "title", "key", "author", "year", "journal", "keyword", "folderid", "labelid")


class FolioError(Exception):
    """Any error that this package raises on purpose. ``payload`` names what it is about, where a class says so."""

    about: str | None = None

    def __init__(self, message: str = "", payload=None):
        super().__init__(message)
        self.payload = payload

    def __reduce__(self):
        return type(self), (*self.args, self.payload)


class CanceledError(FolioError):
    """A user, or a time limit, has ended an action."""


class DuplicateError(FolioError):
    """A record that is there already."""


class QueryError(FolioError):
    pass


class FileError(FolioError):
    about = "file"


class FileReadError(FileError):
    pass


class FileFormatError(FileError):
    pass


class FileWriteError(FileError):
    pass


class FolderNotEmptyError(FileError):
    pass


class FileSyncError(FolioError):
    about = "file"


class FileSyncConflictError(FileSyncError):
    """Both sides have changed a file."""


class DatabaseError(FileReadError):
    pass


class DatabaseMissingError(DatabaseError):
    pass


class DatabaseVersionError(DatabaseError):
    pass


class NetError(FolioError):
    pass


class NetGetError(NetError):
    about = "code"


class NetFormatError(NetError):
    about = "content"


class NetMatchError(NetError):
    """A provider has nothing that matches."""


class SiteError(FolioError):
    about = "url"


class UnknownSiteError(SiteError):
    pass


class ScrapeError(SiteError):
    """A page of a known site that isn't as it should be."""


class ExtractionError(FolioError):
    """A document whose layout gives no record."""


class ToolError(FolioError):
    """The program that reads documents has failed."""


def list_of(c: Column, by: str) -> Column:
    """The items of a delimited field, trimmed, without empty ones; null for an absent field."""
    items = F.filter(F.transform(F.split(c, by), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.isNotNull() & (c != ""), items)


def with_fields(df: DataFrame) -> DataFrame:
    """All record fields, missing ones as nulls, extra ones behind."""
    have = set(df.columns)
    return df.select(*(F.col(f) if f in have else F.lit(None).cast("string").alias(f) for f in FIELDS), *(c for c in df.columns if c not in FIELDS))
