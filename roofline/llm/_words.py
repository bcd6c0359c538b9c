"""Texts cut into chunks that encode on their own: each distinct chunk is encoded once a batch.

Arrow cuts the texts and numbers the distinct chunks; Python sees only those, behind a
bounded memo that lives as long as the worker; Arrow puts the results together again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


#: Bytes of an entry besides its key and result: two objects and a place in the table.
ENTRY = 180


class Memo(dict):
    """Two generations of remembered results: when the younger has half of ``limit`` bytes, the older goes."""

    def __init__(self, compute: Callable[[str], bytes], limit: int, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.older, self.held = compute, limit, longest, {}, 0

    def __missing__(self, key: str) -> bytes:
        out = self.older.pop(key, None)
        if out is None:
            out = self.compute(key)
        if len(key) <= self.longest:
            self.held += len(key) + len(out) + ENTRY
            if 2 * self.held > self.limit:
                self.older, self.held = dict(self), 0
                self.clear()
            self[key] = out
        return out

    def once(self, key: str) -> bytes:
        """The result of a key that is not worth a place: one that is not remembered is made and forgotten."""
        return self[key] if key in self or key in self.older else self.compute(key)


def encode_chunks(texts: pa.Array, memo: Memo) -> list[bytes]:
    """For each text the joined results of its chunks, which one blank separates."""
    return encode_distinct(texts, lambda chunks: [memo[c] for c in chunks.dictionary.to_pylist()])


def encode_distinct(texts: pa.Array, encode: Callable[[pa.DictionaryArray], list[bytes]]) -> list[bytes]:
    """``encode_chunks`` with a function that gives the results of a column's distinct chunks, in their order."""
    cut = pc.split_pattern(texts, " ")
    bounds = cut.offsets.to_numpy()
    chunks = cut.flatten().dictionary_encode()
    results = pa.array(encode(chunks), pa.large_binary()).take(chunks.indices)
    at = np.frombuffer(results.buffers()[1], np.int64)[results.offset:results.offset + len(results) + 1]
    data = memoryview(results.buffers()[2] or b"")
    ends = at[bounds - bounds[0]].tolist()
    return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]
