"""``spark.read``, ``readStream`` and ``write`` for citation files: format("bibtex") and format("ris").

Reading: a partition for each file; equality tests on record fields are pushed down and tested before rows are made. Streams take files in order of their time of change. Writing: each task writes a file under a name that readers
pass over, and only the commit of the whole job gives the files of the tasks that succeeded their names; an abort drops them. Paths may be in any store that
Arrow opens.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from .bibtex import bibtex_records
from .records import FIELDS, FileFormatError
from .ris import ris_byte_records

#: The setting under which Spark offers filters to a source.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _store(path: str):
    """The file system of a path, of any kind that Arrow opens, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


def _files(path: str) -> list:
    """The files at a path, in a folder or of a pattern, with their times; names that begin with _ or . are passed over."""
    from pyarrow import fs

    store, at = _store(path)
    base = re.split(r"[*?\[]", at)[0].rpartition("/")[0] if re.search(r"[*?\[]", at) else at
    info = store.get_file_info(base)
    if info.type == fs.FileType.Directory:
        inside = store.get_file_info(fs.FileSelector(base, recursive=True))
        return sorted((f for f in inside if f.is_file and (base == at or fnmatch(f.path, at)) and not re.search(r"/[_.]", f.path[len(base) :])), key=lambda f: f.path)
    return [info] if info.is_file else []


class _Records:
    """What batch and stream readers share: the records of one file that meet the filters."""

    parse: Callable[[bytes], Iterable[dict]]
    tests: tuple[tuple[str, frozenset], ...] = ()

    def records(self, file: str) -> Iterator[tuple]:
        store, _ = _store(self.path)
        with store.open_input_stream(file) as f:
            for k, r in enumerate(self.parse(f.read())):
                if all(r.get(c) in some for c, some in self.tests):
                    yield (file, k, *(r.get(c) for c in FIELDS))


class Reader(_Records, DataSourceReader):
    def __init__(self, path: str, parse):
        self.path, self.parse = path, parse

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in FIELDS:
                self.tests += ((name, frozenset([f.value] if isinstance(f, EqualTo) else f.value)),)
            else:
                yield f

    def partitions(self):
        files = _files(self.path)
        if not files:
            raise FileFormatError(f"no file at {self.path}", self.path)
        return [InputPartition(f.path) for f in files]

    def read(self, partition):
        return self.records(partition.value)


class StreamReader(_Records, DataSourceStreamReader):
    """New files by their time of change, in nanoseconds: an offset is the time of the last file that was taken."""

    def __init__(self, path: str, parse):
        self.path, self.parse = path, parse

    def initialOffset(self) -> dict:
        return {"after": 0}

    def latestOffset(self) -> dict:
        return {"after": max((f.mtime_ns for f in _files(self.path)), default=0)}

    def partitions(self, start: dict, end: dict):
        return [InputPartition(f.path) for f in _files(self.path) if start["after"] < f.mtime_ns <= end["after"]]

    def read(self, partition):
        return self.records(partition.value)

    def commit(self, end: dict) -> None:
        pass


def bibtex_text(record: dict) -> str:
    """A record as an entry, as ``sinks.writers.bibtex_entry`` gives it."""
    from ..sinks.writers import BIBTEX_ORDER, EXPORT_FIELDS

    shown = [(f, n) for f, n in BIBTEX_ORDER if EXPORT_FIELDS.get(f, 1)] + [(f, f) for f, on in EXPORT_FIELDS.items() if on and f not in dict(BIBTEX_ORDER)]
    width = max(len(n) for _, n in BIBTEX_ORDER if n in ("journal", "title")) + 1
    value = lambda f: re.sub(r"\s*-+\s*", "--", record[f]) if f == "pages" else record[f]
    lines = [f"  {n.ljust(width)} = {{{value(f)}}}" for f, n in shown if record.get(f) not in (None, "", "0")]
    return f"@{record.get('pubtype') or 'MISC'}{{{record.get('citekey') or ''},\n" + ",\n".join(lines) + "\n}\n"


def ris_text(record: dict) -> str:
    """A record as tagged lines, as ``sinks.writers.ris_entry`` gives it."""
    from ..sinks.writers import RIS_ORDER, RIS_TYPES

    has = lambda f: record.get(f) not in (None, "", "0")
    lines = [f"TY  - {RIS_TYPES.get(record.get('pubtype'), 'GEN')}"]
    for f, tag in (("authors", "AU"), ("editors", "A2")):
        lines += [f"{tag}  - {x.strip(' ')}" for x in re.split(r"\s+and\s+", record[f])] if has(f) else []
    if has("year"):
        lines.append("PY  - " + "/".join([record["year"], record.get("month") or "", record.get("day") or "", ""]))
    lines += [f"{tag}  - {record[f]}" for f, tag in RIS_ORDER if has(f)]
    if has("pages"):
        lines += [f"{tag}  - {x}" for tag, x in zip(("SP", "EP"), re.split("-+", record["pages"]), strict=False)]
    if has("keywords"):
        lines += [f"KW  - {x.strip(' ')}" for x in record["keywords"].split(";")]
    return "\n".join([*lines, "ER  - "]) + "\n"


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


class Writer(DataSourceWriter):
    def __init__(self, path: str, text: Callable[[dict], str], suffix: str, names: list[str], overwrite: bool):
        self.path, self.text, self.suffix, self.names, self.overwrite, self.job = path, text, suffix, names, overwrite, uuid.uuid4().hex

    def _hidden(self, at: str) -> str:
        return f"{at.rstrip('/')}/_writing-{self.job}"

    def write(self, iterator) -> Written:
        store, at = _store(self.path)
        rows, out, file = 0, None, f"{self._hidden(at)}/{uuid.uuid4().hex}.{self.suffix}"
        try:
            for row in iterator:
                if out is None:
                    store.create_dir(self._hidden(at), recursive=True)
                    out = store.open_output_stream(file)
                out.write((self.text({n: None if v is None else str(v) for n, v in zip(self.names, row, strict=True)}) + "\n").encode())
                rows += 1
        finally:
            if out is not None:
                out.close()
        return Written(file if rows else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, at = _store(self.path)
        store.create_dir(at, recursive=True)
        old = [f.path for f in _files(self.path)] if self.overwrite else []
        for k, m in enumerate(m for m in messages if m is not None and m.file):
            store.move(m.file, f"{at.rstrip('/')}/part-{k:05d}-{self.job}.{self.suffix}")
        for f in old:
            store.delete_file(f)
        if store.get_file_info(self._hidden(at)).type == fs.FileType.Directory:
            store.delete_dir(self._hidden(at))  # files of attempts that failed or came second
        store.open_output_stream(f"{at.rstrip('/')}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, at = _store(self.path)
        if store.get_file_info(self._hidden(at)).type == fs.FileType.Directory:
            store.delete_dir(self._hidden(at))


def _source(kind: str, parse, text, suffix: str):
    class Citations(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            from .readers import PARSED

            return PARSED

        def reader(self, schema):
            return Reader(self.options.get("path"), parse)

        def streamReader(self, schema):
            return StreamReader(self.options.get("path"), parse)

        def writer(self, schema, overwrite):
            unknown = [c for c in schema.names if c not in (*FIELDS, "path", "position")]
            if unknown:
                raise FileFormatError(f"no fields of a record: {', '.join(unknown)}", self.options.get("path"))
            return Writer(self.options.get("path"), text, suffix, schema.names, overwrite)

    return Citations


def register_sources(spark: SparkSession) -> None:
    """Makes format("bibtex") and format("ris") known to a session, which offers filters to such sources from then on."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(_source("bibtex", lambda b: bibtex_records(b.decode("utf-8", "replace")), bibtex_text, "bib"))
    spark.dataSource.register(_source("ris", ris_byte_records, ris_text, "ris"))
