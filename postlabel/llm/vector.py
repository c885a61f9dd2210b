"""Numpy helpers over many texts at once: bytes, words, 64-bit hashes of words and shingles.

All arithmetic is on unsigned 64-bit integers modulo 2**64. Texts come as an Arrow string
column, whose buffers are used as they are, in chunks of bounded bytes (a longer text is a
chunk of its own), so that memory does not grow with the number of rows in a batch.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK_BYTES = 2 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_table(seed: int) -> np.ndarray:
    """A fixed random 64-bit number for each byte value."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 256, dtype=U)


_TABLE = byte_table(20177)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse for i < n, grown on demand and kept by the worker."""
    if len(_powers[0]) < n:
        for slot, base in enumerate((_BASE, _INVERSE)):
            table = np.full(max(n, CHUNK_BYTES + 1), U(base))
            table[0] = 1
            _powers[slot] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the offsets between them; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    first = int(offs[0])
    return np.frombuffer(data, np.uint8)[first : int(offs[-1])], offs - first


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Returns freed memory to the system.

    A worker goes from one step's tasks to the next one's, and would else hold the most that
    each step ever took, in pieces the next cannot use.
    """
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES):
    """Yields (first row, last row, bytes, offsets) for runs of whole texts of about ``limit`` bytes."""
    give_back()
    data, offs = string_buffers(column)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def lookup(values) -> np.ndarray:
    """A 256-entry boolean table, true at ``values``."""
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


WORD = ~lookup(SPACE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offs: np.ndarray, word: np.ndarray = WORD):
    """Starts and ends of words, and the index of each text's first word (one more at the end).

    A word is a maximal run of bytes that ``word`` allows; none crosses a text's end.
    """
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = word[data]
    before, after = inside[:-2].copy(), inside[2:].copy()
    cuts = offs[(offs > 0) & (offs < n)]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside[1:-1] & ~before)
    ends = np.flatnonzero(inside[1:-1] & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which ``span_hash`` takes the polynomial hash of any span of values."""
    power, inverse = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * power[:-1], out=sums[1:])
    return sums, inverse


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``prefix_sums`` of bytes."""
    return prefix_sums(_TABLE[data])


def span_hash(sums: np.ndarray, inverse: np.ndarray, starts, ends) -> np.ndarray:
    """Hashes of the bytes between starts and ends, wherever they stand."""
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True, word: np.ndarray = WORD):
    """Hashes of all words and the index of each text's first word."""
    starts, ends, first = word_bounds(data, offs, word)
    sums, inverse = prefix_hash(LOWER[data] if lower else data)
    return span_hash(sums, inverse, starts, ends), first


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` words in a row; those that cross a text's end are the caller's to drop."""
    n = max(0, len(words) - size + 1)
    total = np.full(n, U(size))
    for i in range(size):
        total = total * U(_BASE) + words[i : i + n]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
