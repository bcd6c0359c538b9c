"""Words of whole Arrow columns as runs of word bytes, found by array operations.

The word rules of the operators that use this ask of a code point whether it is ASCII and
which one, so a byte decides: all bytes of other code points are word bytes or none is.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BYTES = np.arange(256)
#: A-Z to a-z and nothing else.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Word bytes after lower-casing: letters and all beyond ASCII; with digits.
LETTERS = (_BYTES >= 128) | ((_BYTES >= 97) & (_BYTES <= 122))
ALNUM = LETTERS | ((_BYTES >= 48) & (_BYTES <= 57))
#: All but ASCII white space.
FILLED = ~np.isin(_BYTES, [32, 9, 10, 11, 12, 13])


def slices(batch: pa.RecordBatch, column: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have ``limit`` bytes together; a longer text is alone.  The parts
    are copies: some of Arrow's functions on texts go wrong on an array that begins inside another's buffers."""
    part = lambda i, n: batch.slice(i, n).take(pa.array(range(n), pa.int64()))
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > at and total + n > limit:
            yield part(at, i - at)
            at, total = i, 0
        total += n
    if batch.num_rows > at:
        yield part(at, batch.num_rows - at)


@functools.cache
def _trim() -> Callable[[int], int]:
    """The C library's ``malloc_trim``; nothing where it has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Memory that is free goes back to the machine: a worker waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def sliced(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """All batches in ``slices``; those without rows are left out."""
    for batch in batches:
        for part in slices(batch, column):
            yield part
            give_back()


def runs(texts: pa.Array, inside: np.ndarray, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words before each text and in all, starts, ends) of a column of texts, A-Z lower-cased unless told.

    Starts and ends count bytes of the text's own UTF-8.  Null counts as empty.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw is not None else np.zeros(0, np.uint8)
    data, at = LOWER[data] if lower else data, at - at[0]
    word = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # a word ends where its text does
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[word]))
    first = np.searchsorted(starts, at)
    own = np.repeat(at[:-1], np.diff(first))
    return words, first, starts - own, ends - own


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes; each distinct word is hashed once."""
    code = words.dictionary_encode()
    kinds = code.dictionary.cast(pa.large_binary()).to_pylist()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, kinds), np.uint64, len(kinds))[code.indices.to_numpy()]
