"""Similarity hash of 64 bits: each token's hash votes on every bit.

Tokens are runs of ASCII letters and digits and of bytes from 0x80; only those of more than three bytes
count. The token hash is the public-domain Jenkins ``lookup3`` little-endian function, as two 32-bit
halves from two seeds. A bit is set iff its votes, less half of the tokens (rounded down), are not
negative; so a text with at most one token has all bits set.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seeds of the two halves. Fixed values.
SEED_1, SEED_2 = 0xAC867C1D, 0x5434E4C4
#: Tokens of at most so many bytes don't count.
SHORT = 3
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MASK = 0xFFFFFFFF


def _rotated(x: int, k: int) -> int:
    return (x << k | x >> (32 - k)) & _MASK


#: Rotations of the mixing and of the final step. Fixed values of the published function.
MIX = (4, 6, 8, 16, 19, 4)
FINAL = (14, 11, 25, 16, 4, 14, 24)


def lookup3(data: bytes, seed_c: int = 0, seed_b: int = 0) -> tuple[int, int]:
    """Two 32-bit hashes of the bytes."""
    n = len(data)
    s = [(0xDEADBEEF + n + seed_c) & _MASK] * 3
    s[2] = (s[2] + seed_b) & _MASK
    at = 0
    while n - at > 12:
        for k in range(3):
            s[k] = (s[k] + int.from_bytes(data[at + 4 * k : at + 4 * k + 4], "little")) & _MASK
        for turn, r in enumerate(MIX):  # each word in turn loses one neighbour, takes its rotation and gives to the other
            x, y, z = turn % 3, (turn + 2) % 3, (turn + 1) % 3
            s[x] = (s[x] - s[y]) & _MASK
            s[x] ^= _rotated(s[y], r)
            s[y] = (s[y] + s[z]) & _MASK
        at += 12
    if at < n:
        rest = data[at:].ljust(12, b"\0")
        for k in range(3):
            s[k] = (s[k] + int.from_bytes(rest[4 * k : 4 * k + 4], "little")) & _MASK
        for turn, r in enumerate(FINAL):
            x, y = (turn + 2) % 3, (turn + 1) % 3
            s[x] = ((s[x] ^ s[y]) - _rotated(s[y], r)) & _MASK
    return s[2], s[1]


def token_hash(token: bytes) -> int:
    high, low = lookup3(token, SEED_1, SEED_2)
    return ((high << 32) + low) & 0xFFFFFFFFFFFFFFFF


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint32(k) | x >> np.uint32(32 - k)


def _hashed(data: np.ndarray, size: np.ndarray, seed_c: int, seed_b: int) -> np.ndarray:
    """``lookup3`` of rows of blocks of three words, as one number each; size: bytes of each row."""
    start = (np.uint64(0xDEADBEEF + seed_c) + size).astype(np.uint32)
    s = [start.copy(), start.copy(), start + np.uint32(seed_b)]
    n = data.shape[1]
    for block in range(n):
        for k in range(3):
            s[k] += data[:, block, k]
        if block < n - 1:
            for turn, r in enumerate(MIX):
                x, y, z = turn % 3, (turn + 2) % 3, (turn + 1) % 3
                s[x] = (s[x] - s[y]) ^ _turned(s[y], r)
                s[y] = s[y] + s[z]
    for turn, r in enumerate(FINAL):
        x, y = (turn + 2) % 3, (turn + 1) % 3
        s[x] = (s[x] ^ s[y]) - _turned(s[y], r)
    return (s[2].astype(np.uint64) << np.uint64(32)) + s[1]


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    """``token_hash`` of many tokens at once: those with as many 12-byte blocks run together."""
    out = np.empty(len(tokens), np.uint64)
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    blocks = np.maximum((size + 11) // 12, 1)
    for n in np.unique(blocks).tolist():
        rows = np.flatnonzero(blocks == n)
        data = np.frombuffer(b"".join(tokens[k].ljust(12 * n, b"\0") for k in rows.tolist()), "<u4").reshape(len(rows), n, 3)
        hashed = _hashed(data, size[rows].astype(np.uint64), SEED_1, SEED_2)
        out[rows] = np.where(size[rows] > 0, hashed, (np.uint64(0xDEADBEEF + SEED_1 + SEED_2 & _MASK) << np.uint64(32)) + np.uint64(0xDEADBEEF + SEED_1 & _MASK))
    return out


def _votes(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0xFFFFFFFFFFFFFFFF
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(0, dtype=np.int64) - len(hashes) // 2 >= 0).tobytes(), "big")


def simhashes(texts: list[str | None]) -> np.ndarray:
    """The hashes of texts; each distinct token of the list is hashed once."""
    numbers: dict[bytes, int] = {}
    lists = [[numbers.setdefault(t, len(numbers)) for t in _TOKEN.findall((x or "").encode()) if len(t) > SHORT] for x in texts]
    hashes = token_hashes(list(numbers))
    return np.array([_votes(hashes[own]) if own else 0xFFFFFFFFFFFFFFFF for own in lists], np.uint64)


def simhash(text: str | None) -> int:
    """The hash as an unsigned number."""
    return int(simhashes([text])[0])


#: Seeds of the hash of a run. Fixed values.
WIDE_1, WIDE_2 = 0x2C759C01, 0xFEF136D7


def simhash_wide(text: str | None, k: int = 3) -> int:
    """Votes of runs of ``k`` tokens, of any length, each for or against a bit; a run's hash folds its tokens' hashes."""
    tokens = _TOKEN.findall((text or "").encode())
    if not tokens:
        return 0xFFFFFFFFFFFFFFFF
    kinds = {t: n for n, t in enumerate(dict.fromkeys(tokens))}
    hashes = np.concatenate([np.zeros(k - 1, np.uint64), token_hashes(list(kinds))[[kinds[t] for t in tokens]]])
    runs = np.lib.stride_tricks.sliding_window_view(hashes, k)
    data = np.ascontiguousarray(runs).view("<u4").reshape(len(runs), 2 * k)
    padded = np.zeros((len(runs), -(-2 * k // 3) * 3), np.uint32)
    padded[:, : 2 * k] = data
    votes = _hashed(padded.reshape(len(runs), -1, 3), np.full(len(runs), 8 * k, np.uint64), WIDE_1, WIDE_2)
    bits = np.unpackbits(votes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) - len(runs) >= 0).tobytes(), "big")


@F.pandas_udf(T.LongType())
def simhash_wide64(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``simhash_wide`` as a signed column."""
    for texts in batches:
        yield pd.Series(np.array([simhash_wide(t) for t in texts], np.uint64).view(np.int64))


@F.pandas_udf(T.LongType())
def simhash64(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The hash as a signed column."""
    for texts in batches:
        yield pd.Series(np.concatenate([simhashes(texts[k : k + 2000].tolist()) for k in range(0, len(texts), 2000)] or [np.empty(0, np.uint64)]).view(np.int64))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def binary_digits(c: Column) -> Column:
    return F.lpad(F.bin(c), 64, "0")
