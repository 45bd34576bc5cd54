"""File formats as plugins: what can be read, what can be written, and the one that fits a file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plugins import REGISTRY, plugin, register
from . import libraries, readers
from .detect import text_format
from .records import FileFormatError, FileReadError, with_fields


@dataclass
class Format:
    """A format by what it can do; a part that is absent can't be done."""

    name: str
    reader: Callable[[SparkSession, str], DataFrame] | None = None
    writer: Callable[[DataFrame, str], None] | None = None

    @property
    def readable(self) -> bool:
        return self.reader is not None

    @property
    def writable(self) -> bool:
        return self.writer is not None

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        if not self.readable:
            raise FileFormatError(f"{self.name} can't be read", path)
        return self.reader(spark, path)

    def write(self, df: DataFrame, path: str) -> None:
        if not self.writable:
            raise FileFormatError(f"{self.name} can't be written", path)
        self.writer(df, path)


def _text(out_format: str) -> Callable[[DataFrame, str], None]:
    def write(df: DataFrame, path: str) -> None:
        from ..sinks.writers import export_text

        export_text(df, out_format).write.text(path)

    return write


def _export_library(df: DataFrame, path: str) -> None:
    from ..sinks.writers import export_library

    export_library(df, path)


def _library(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, path: libraries.READERS[name](readers.binary_files(spark, path))


def _feed(spark: SparkSession, path: str) -> DataFrame:
    return with_fields(readers.read_feed(spark, path))


for _format in (
    Format("BIBTEX", readers.read_bibtex_files, _text("bibtex")),
    Format("RIS", readers.read_ris_files, _text("ris")),
    Format("RSS", _feed),
    Format("ZOTERO", _library("ZOTERO")),
    Format("MENDELEY", _library("MENDELEY")),
    Format("NATIVE", _library("NATIVE")),
    Format("LIBRARY", readers.read_library, _export_library),
    Format("CITATIONS", writer=_text("citations")),
    Format("EMAIL", writer=_text("email")),
):
    register("format", _format.name)(_format)


def guess_format(spark: SparkSession, path: str) -> Format:
    """The format of the file or files at a path; an error where they have none or several."""
    try:
        kinds = libraries.library_formats(readers.binary_files(spark, path)).select("format").distinct().collect()  # a row for each format
        found = {r["format"] for r in kinds} - {None}
        if not found:
            texts = readers.text_files(spark, path).select(text_format(F.col("content")).alias("f")).distinct().collect()
            found = {r["f"] for r in texts}
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileReadError(f"no file at {path}", path) from None
        raise
    if len(found) != 1 or None in found:
        raise FileFormatError(f"{path}: {', '.join(sorted(map(str, found))) or 'nothing'}", path)
    return plugin("format", found.pop())


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file by the format that it turns out to have."""
    return guess_format(spark, path).read(spark, path)


def formats(readable: bool | None = None, writable: bool | None = None) -> list[str]:
    """Names of the formats that can be read, written, or both."""
    return sorted(f.name for f in REGISTRY["format"].values() if readable in (None, f.readable) and writable in (None, f.writable))
