"""Suffix sorting by the difference cover {1, 2} modulo 3, on whole arrays.

Triples at sampled places are sorted and named, names are sorted recursively until they differ or
cover the wanted prefix, and the remaining third is merged by (symbol, rank) and (symbol, symbol, rank).
Keys carry their places in their low bits where 64 bits hold both, so that values rather than places are sorted.
"""

from __future__ import annotations

import numpy as np

#: Triples of at most so many possible values are named by a table of these instead of a sort.
TABLE = 1 << 21


def _bits(top: int) -> int:
    return max(1, int(top).bit_length())


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their keys, and the keys in order."""
    low = _bits(len(key))
    if bits + low > 64:
        order = np.argsort(key)
        return order, key[order]
    both = (key.astype(np.uint64) << np.uint64(low)) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << low) - 1)).astype(np.int64), both >> np.uint64(low)


def _ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Dense ranks from 1 of the keys, and the largest one."""
    order, k = _sorted(key, bits)
    name = np.ones(len(k), np.int64)
    name[1:] = k[1:] != k[:-1]
    np.cumsum(name, out=name)
    out = np.empty(len(key), np.int64)
    out[order] = name
    return out, int(name[-1]) if len(name) else 0


def _joined(*parts: tuple[np.ndarray, int]) -> tuple[np.ndarray, int]:
    """One key that orders like the tuple of (values, largest value), and its bits; ranks stand in where it would not fit."""
    key, top = parts[0]
    key, bits = key.astype(np.uint64), _bits(top)
    for values, most in parts[1:]:
        more = _bits(most)
        if bits + more > 64:
            ranks, top = _ranked(key, bits)
            key, bits = ranks.astype(np.uint64), _bits(top)
        if bits + more > 64:  # ranks of more than 2**32 places and values as large: rank the pairs
            order = np.lexsort((values, key))
            new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (values[order][1:] != values[order][:-1])])
            key = np.empty(len(order), np.uint64)
            key[order] = np.cumsum(new)
            bits = _bits(len(order))
            continue
        key, bits = (key << np.uint64(more)) | values.astype(np.uint64), bits + more
    return key, bits


def _named(t: np.ndarray, sample: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """Names of the triples at the sampled places, and how many there are."""
    a, b, c = t[sample], t[sample + 1], t[sample + 2]
    if (top + 1) ** 3 <= TABLE:
        key = (a * (top + 1) + b) * (top + 1) + c
        there = np.zeros((top + 1) ** 3, np.bool_)
        there[key] = True
        rank = np.cumsum(there, dtype=np.int32)
        return rank[key], int(rank[-1])
    return _ranked(*_joined((a, top), (b, top), (c, top)))


def suffix_order(s: np.ndarray, top: int, depth: int, covered: int = 1, wanted: np.ndarray | None = None) -> np.ndarray:
    """The wanted places of ``s`` (values 1 to top) in the order of their suffixes' first ``depth`` units.

    covered: units that one value stands for. wanted: marks of places; all if not given. Names are made of all
    sampled places, but only the suffixes of wanted places and of the two after each are put into order.
    Suffixes that agree to the depth come in any order."""
    n = len(s)
    wanted = np.ones(n, bool) if wanted is None else wanted
    if n < 3:
        return np.array(sorted(np.flatnonzero(wanted).tolist(), key=lambda k: s[k:].tolist()), np.int64)
    kind = np.int32 if max(top, n + 3) < 1 << 31 else np.int64
    t = np.zeros(n + 3, kind)
    t[:n] = s
    need = np.zeros(n + 3, bool)
    need[:n] = wanted
    need[1:] |= need[:-1]
    need[1:] |= need[:-1]
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3, dtype=kind), np.arange(2, n, 3, dtype=kind)])
    names, count = _named(t, sample, top)
    own = need[sample]
    rank = np.zeros(n + 3, kind)
    if count < len(sample) and 3 * covered < depth:
        # the names of the places 1 mod 3, then those of 2 mod 3: a separator's work is done by the padding
        by = sample[suffix_order(names, count, depth, 3 * covered, own)]
        count = len(by)
        rank[by] = np.arange(1, count + 1)
    else:
        some = np.flatnonzero(own)
        rank[sample[some]] = names[some]
        by = sample[some[_sorted(names[some], _bits(count))[0]]]
    # suffixes that agree to the depth may stand in any order among themselves, here and in the merge
    by = by[need[by] & (by < n)]
    by = by[wanted[by]]
    which = by % 3
    first, second = by[which == 1], by[which == 2]
    zero = np.arange(0, n, 3, dtype=kind)
    zero = zero[wanted[zero]]
    # how many sampled suffixes of either class come before each of the others
    at, _ = _sorted(*_joined((t[zero], top), (rank[zero + 1], count)))
    zero = zero[at]
    one = np.concatenate([first, zero])
    one, _ = _joined((t[one], top), (rank[one + 1], count))
    before = np.searchsorted(np.sort(one[: len(first)]), one[len(first) :])
    two = np.concatenate([second, zero])
    two, _ = _joined((t[two], top), (t[two + 1], top), (rank[two + 2], count))
    before += np.searchsorted(np.sort(two[: len(second)]), two[len(second) :])
    before = np.maximum.accumulate(before)
    out = np.empty(len(by) + len(zero), np.int64)
    rest = np.ones(len(out), bool)
    before += np.arange(len(zero))
    rest[before] = False
    out[before] = zero
    out[rest] = by
    return out


def equal_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each a and b are equal; compared eight bytes at a time."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(text) + 1,), (1,))
    same = np.ones(len(a), bool)
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        on = np.flatnonzero(same)
        same[on] = words[a[on] + k] == words[b[on] + k]
    return same
