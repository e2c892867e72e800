"""Array arithmetic over batches of UTF-8 texts.

Words are cut and hashed for a whole Arrow batch at once: byte classes give the
word borders, and prefix sums of a polynomial give a 64-bit number per word and
per window of words. All class tables only name ASCII bytes, so cutting bytes
cuts between code points.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes handled at a time; a longer single text is handled alone and whole.
PIECE = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = int(_rng.integers(1, 1 << 62)) * 2 + 1
_WSTEP = int(_rng.integers(1, 1 << 62)) * 2 + 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def tidy() -> None:
    """Gives freed memory back to the system: workers stay alive between stages, beside a JVM that needs it then."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_held: dict[str, Callable[[], None]] = {}


def holds(module: str, forget: Callable[[], None]) -> None:
    """Tells how to give up what a worker remembers between the tasks of a module's functions."""
    _held[module] = forget


def others_forget(module: str) -> None:
    for owner, forget in _held.items():
        if owner != module:
            forget()


def tidied(function):
    """A function over Arrow batches that tidies up when it has had all. A worker that begins it gives up what other modules remember."""
    module = function.__module__

    @functools.wraps(function)
    def run(batches):
        others_forget(module)
        try:
            yield from function(batches)
        finally:
            tidy()

    return run


def classes(separators) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


#: ``[^\x20\x09-\x0D]+``
SPACE_WORDS = classes([0x20, *range(0x09, 0x0E)])
_fold = np.arange(256, dtype=np.uint8)
_fold[ord("A") : ord("Z") + 1] += 32
FOLDED = _BYTE[_fold]
EXACT = _BYTE


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and its inverse modulo 2**64 for i < n at least."""
    have = _powers.get(step)
    if have is None or len(have[0]) < n:
        n = PIECE + 1024 if n <= PIECE + 1024 else 1 << (n - 1).bit_length()
        inverse = pow(step, -1, 1 << 64)
        have = tuple(
            np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, s, U)]), dtype=U)
            for s in (step, inverse)
        )
        if n <= 4 * PIECE:
            _powers[step] = have
    return have


class Words:
    """Words of a run of texts: ``first``/``end`` byte borders, ``doc`` index, ``count`` per text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = data, offsets
        n, docs = len(data), len(offsets) - 1
        isword = table[data]
        begins = isword.copy()
        ends = isword.copy()
        if n:
            begins[1:] &= ~isword[:-1]
            ends[:-1] &= ~isword[1:]
            borders = offsets[:-1][offsets[:-1] < offsets[1:]]  # of texts that are not empty
            begins[borders] = isword[borders]
            before = borders[borders > 0] - 1
            ends[before] = isword[before]
        self.first = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        marks = np.searchsorted(self.first, offsets)
        self.count = np.diff(marks)
        self.start_of_doc = marks[:-1]
        self.doc = np.repeat(np.arange(docs), self.count)

    def hashes(self, values: np.ndarray = FOLDED) -> np.ndarray:
        up, down = powers(_STEP, len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, U)
        np.cumsum(values[self.data] * up[: len(self.data)], out=sums[1:])
        h = (sums[self.end] - sums[self.first]) * down[self.first]
        return mix(h + (self.end - self.first).astype(U))


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A number for each k consecutive entries (across texts too; callers mask those)."""
    n = len(words)
    if n < k:
        return np.zeros(0, U)
    up, down = powers(_WSTEP, n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((mix(words, seed + 7) if seed else words) * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1], seed)


def window_starts(count: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Positions at which k words of one text begin."""
    return ranges(start, np.maximum(count - k + 1, 0))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... (count[i] of them), for all i in turn."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return np.arange(total, dtype=np.int64) + shift


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of at most ``limit`` bytes together, or of one longer text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def runs(batches, table: np.ndarray = SPACE_WORDS, column: str = "text", limit: int = PIECE):
    """(rows of the batch, their Words) for all batches in turn."""
    for batch in batches:
        data, offsets = texts(batch.column(batch.schema.get_field_index(column)))
        for a, b in pieces(offsets, limit):
            yield batch.slice(a, b - a), Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], table)


def binary_rows(values: np.ndarray, counts: np.ndarray, item: int) -> pa.Array:
    """A binary column whose row i holds the next counts[i] entries of ``values`` (``item`` bytes each)."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * item
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch holds more than 2 GiB")
    return pa.Array.from_buffers(
        pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    )
