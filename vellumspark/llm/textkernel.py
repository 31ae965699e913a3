"""Whole Arrow text columns as numpy arrays: words, their 64-bit hashes, shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
BLOCK = 2_000_000
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What is no ASCII letter or digit parts words here; bytes of other scripts belong to words.
PUNCT = np.ones(256, bool)
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of a range from which on it is hashed by BLAKE2b.
LONG = 256
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1), base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of about `most` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, row, 64-bit hash) of every word; ASCII letters count as lower case unless told otherwise."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U)
    full = ~space[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    first = full.copy()
    first[1:] &= ~full[:-1] | cut[1:n]
    last = full.copy()
    last[:-1] &= ~full[1:] | cut[1:n]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(at, a, "right") - 1
    return a, b, row, spans(LOWER[data] if lower else data, a, b)


def spans(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [a, b): a polynomial modulo 2**64, then mixed with the length.

    Long ranges of two letters can be made to collide under any such polynomial; those of LONG bytes and more take BLAKE2b.
    """
    n = len(data)
    total = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(BASE, n), out=total[1:])
    h = (total[b] - total[a]) * powers(INVERSE, n + 1)[a]
    h = mix(h ^ ((b - a).astype(U) * U(0xD6E8FEB86659FD93)))
    for k in np.flatnonzero(b - a >= LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[a[k] : b[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each row's distinct shingles of `size` words, sorted; all its words as one if it has fewer."""
    count = np.bincount(row, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(count)])
    x = np.zeros(max(0, len(h) - size + 1), U)
    for k in range(size):
        x += mix(h[k : len(h) - size + 1 + k] + U((k * 0x632BE59BD9B4E019 + size) & (2**64 - 1))) * U(2 * k + 3)
    inside = row[: len(x)] == row[size - 1 :] if len(x) else np.zeros(0, bool)
    x, owner = mix(x[inside]), row[: len(inside)][inside]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = []
        for r in short:
            own = h[begin[r] : begin[r + 1]]
            y = U(len(own))
            with np.errstate(over="ignore"):
                for v in own:
                    y = y * U(0x100000001B3) + v
            extra.append(y)
        x, owner = np.concatenate([x, mix(np.array(extra, U))]), np.concatenate([owner, short])
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    if len(x):
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
        x, owner = x[new], owner[new]
    return x, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n_rows))]).astype(np.int64)
