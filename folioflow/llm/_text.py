"""Byte-level tokenisation and Arrow helpers shared by the operators.

The tokenisers work on UTF-8 bytes with C-speed methods: ``bytes.split()`` splits at exactly
the six ASCII white-space bytes 0x20 and 0x09-0x0D, ``bytes.lower()`` folds exactly A-Z, and a
translation table turns every byte outside ``[0-9a-z]`` and 0x80-0xFF into a space.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_ALNUM = bytes(
    (b + 32) if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after folding A-Z."""
    return text.lower().split()


def alnum_spaced(text: bytes) -> bytes:
    """The text with blanks for all bytes that stand in no ``alnum_words``, and A-Z folded."""
    return text.translate(_ALNUM)


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after folding A-Z."""
    return text.translate(_ALNUM).split()


def column_bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column; a null gives the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    if data is None:
        for _ in range(len(column)):
            yield b""
        return
    view = memoryview(data)
    if column.null_count:
        ok = column.is_valid().to_numpy(zero_copy_only=False)
        for k in range(len(column)):
            yield bytes(view[offs[k] : offs[k + 1]]) if ok[k] else b""
    else:
        for k in range(len(column)):
            yield bytes(view[offs[k] : offs[k + 1]])


#: Bytes of a batch that an operator's function sees at once.
SLICE_BYTES = 6 << 20


def settle() -> None:
    """Give free memory back at a task's end: Spark keeps workers for later tasks, idle ones count, too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.num_rows:
        rows = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_arrow(df: DataFrame, fn, schema: T.StructType, barrier: bool = False) -> DataFrame:
    """``mapInArrow`` with a function that takes a record batch and returns a list of columns in schema order.

    The function sees slices of about ``SLICE_BYTES``, so a worker's memory doesn't follow the size of Spark's batches."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) and c.type == f.type else cast(c, f.type) for c, f in zip(fn(piece), arrow, strict=True)],
                    schema=arrow,
                )
        settle()

    def cast(c, kind):
        return c.cast(kind) if isinstance(c, pa.Array) else pa.array(c, type=kind)

    return df.mapInArrow(run, schema, barrier=barrier)


def fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    """The fields of the named columns, nullable."""
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]
