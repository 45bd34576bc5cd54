"""Tables of tokenised blocks: each row holds the words of many texts as numbers of a sorted vocabulary.

A task packs its texts into blocks of about ``BLOCK_BYTES`` (a longer text is a block of its own) and every
block becomes a row of a table in the shared folder. From then on a block has one number and one order of
words, whatever executor is lost later, so that other tables can speak of "the 17th word of block 5". Between two
texts, and wherever ``cut`` puts the byte 0xFF, stands a boundary, the number behind the last word's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._store import written
from ._text import column_bytes, settle

#: Bytes of text in a block, unless a single text has more.
BLOCK_BYTES = 12 << 20
#: The byte of a boundary: no UTF-8 text has it, and it sorts behind all that do.
EDGE = b"\xff"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2**64 as compressed planes of bytes; planes of zeros are left out."""
    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a, np.uint64)
        width = (int(a.max(initial=0)).bit_length() + 7) // 8
        head += [len(a), width]
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    raw = np.array(head, np.int64).tobytes() + b"".join(body)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 + 16 * n, []
    for size, width in head.reshape(-1, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        whole = np.zeros((size, 8), np.uint8)
        whole[:, :width] = planes.T
        out.append(whole.view(np.uint64).reshape(-1).astype(np.int64))
        at += size * width
    return out


def classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some numbers: a place of each distinct one in ascending order, which of them stands at each place, and how often each does."""
    order = np.argsort(keys)
    ascending = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]])) if len(keys) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.repeat(np.arange(len(first)), counts)
    return order[first], inverse, counts


def squeezed(words: list[bytes]) -> bytes:
    """Words without blanks, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(b" ".join(words))


def words_of(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return raw.split(b" ") if raw else []


def word_array(blob: bytes) -> pa.Array:
    """``words_of`` as an array."""
    return parted(zstandard.ZstdDecompressor().decompress(blob))


def parted(text: bytes) -> pa.Array:
    """The words between a text's blanks, as an array that is made without an object for each word."""
    raw = np.frombuffer(text, np.uint8)
    inside = raw != 0x20
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    offsets = np.zeros(len(edges) // 2 + 1, np.int32)
    np.cumsum(edges[1::2] - edges[::2], out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])


def numbered(tokens: list[bytes] | pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The sorted vocabulary without the boundary, and each token's place in it."""
    found = (tokens if isinstance(tokens, pa.Array) else pa.array(tokens, pa.binary())).dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    vocabulary = found.dictionary.take(pa.array(order)).to_pylist()
    if vocabulary and vocabulary[-1] == EDGE:
        vocabulary.pop()
    return vocabulary, place[found.indices.to_numpy()]


def token_blocks(df: DataFrame, cut: Callable[[bytes], bytes], path: str, text: str = "text", group: str | None = None, keys: list[str] | None = None, size: int = BLOCK_BYTES) -> DataFrame:
    """The written table (block, group, words, keys, vocabulary, tokens) of ``df``'s texts; words is their number.

    cut makes of a text its words, parted by blanks, and boundaries of its own. group: a string column whose
    values don't share a block's row. keys: columns that are kept, an array with one element for each text."""
    kept = [T.StructField(c, df.schema[c].dataType) for c in keys or []]
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("group", T.StringType()), T.StructField("words", T.LongType()),
        *([T.StructField("keys", T.ArrayType(T.StructType(kept)))] if kept else []),
        T.StructField("vocabulary", T.BinaryType()), T.StructField("tokens", T.BinaryType()),
    ])
    arrow = to_arrow_schema(schema)
    rows = df.select(text, *([group] if group else []), *(keys or []))

    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        texts: dict[str | None, list[bytes]] = {}
        given: dict[str | None, list[pa.StructArray]] = {}
        held = 0

        def block():
            nonlocal count
            for g in sorted(texts, key=str):
                words, ids = numbered((b" \xff ".join(texts[g]) + b" \xff").split())
                columns = [pa.array([(task << 24) + count], pa.int64()), pa.array([g], pa.string()), pa.array([int((ids < len(words)).sum())], pa.int64())]
                if kept:
                    flat = pa.concat_arrays(given[g])
                    columns.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat).cast(arrow.field("keys").type))
                columns += [pa.array([squeezed(words)], pa.binary()), pa.array([packed(ids)], pa.binary())]
                count += 1
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
            texts.clear()
            given.clear()

        for batch in batches:
            names = batch.column(1).to_pylist() if group else [None] * batch.num_rows
            own = pa.StructArray.from_arrays([batch.column(batch.num_columns - len(kept) + k) for k in range(len(kept))], [f.name for f in kept]) if kept else None
            for k, (g, t) in enumerate(zip(names, column_bytes(batch.column(0)), strict=True)):
                texts.setdefault(g, []).append(cut(t))
                if kept:
                    given.setdefault(g, []).append(own.slice(k, 1))
                held += len(t)
                if held >= size:
                    yield from block()
                    held = 0
        if texts:
            yield from block()
        settle()

    return written(rows.mapInArrow(run, schema), path)
