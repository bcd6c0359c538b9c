"""Winnowing: a document's fingerprint is the rightmost smallest k-gram hash of every window.

Two texts that share a stretch of ``window + k - 1`` characters share a fingerprint hash,
whose positions tell where.  Hashes and window minima are array operations over a whole
text; the positions of the selected grams are kept.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import U64, documents, shuffle_partitions, strings

BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(int(BASE), -1, 2**64))
K, WINDOW = 8, 9


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    out[1:] = base
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def rolling_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of each k-gram: differences of prefix sums of code * base^i, brought to base^0."""
    n = len(codes)
    sums = np.zeros(n + 1, U64)
    np.cumsum(mix(codes.astype(U64) + U64(1)) * powers(BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(INVERSE, n - k + 1)) >> U64(32)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the selected grams, by position.

    The smallest hash of every ``window`` grams, the rightmost where several are equal.
    A text shorter than that is one window; one shorter than ``k`` is one gram; an empty
    text has none.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    grams = rolling_hashes(codes, min(k, len(codes)))
    n = len(grams)
    # Hash above, distance from the end below: the minimum is the rightmost smallest.
    best = (grams << U64(32)) | np.arange(n - 1, -1, -1, dtype=U64)
    width, todo = 1, min(window, n)
    while width < todo:
        step = min(width, todo - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    best = best[np.flatnonzero(np.diff(best, prepend=best[0] + U64(1)))]
    return best >> U64(32), (n - 1) - (best & U64(0xFFFFFFFF)).astype(np.int64)


def to_string(hashes: np.ndarray, positions: np.ndarray) -> str:
    """The grams as ``hash@distance`` in hexadecimal, each distance from the gram before."""
    return " ".join(f"{h:08x}@{d:x}" for h, d in zip(hashes.tolist(), np.diff(positions, prepend=0).tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct hashes of either that both have; 1 for two empty fingerprints."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def fingerprint_documents(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """(doc_id, pos, hash): one row per selected gram, for joins on shared passages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
                h, p = winnow(text, k, window)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(h), pa.int64()), pa.array(p),
                                                  pa.array(h.astype(np.int64))], names=["doc_id", "pos", "hash"])
    return documents(docs, id_col, text_col).select("doc_id", "text").mapInArrow(run, "doc_id long, pos long, hash long")


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many first code points of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _ranges(rows: DataFrame, n: int) -> tuple[list[int], dict[int, int | None], dict[int, int]]:
    """Bounds that cut the ids into ``n`` ranges, the largest id of each range that has rows (range 0: null
    ids), and the range that follows each in descending order of ids.  As many numbers as ranges."""
    at = [i / n for i in range(1, n)]
    bounds = sorted({int(x) for x in rows.approxQuantile("doc_id", at, 0.25 / n)}) if at else []

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int | None] = {}
        for b in batches:
            for doc in b.column(0).to_pylist():
                r = 0 if doc is None else 1 + bisect.bisect_right(bounds, doc)
                top[r] = doc if doc is None else max(doc, top.get(r, doc))
        yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int64()), pa.array(list(top.values()), pa.int64())],
                                         names=["r", "top"])
    found = rows.select("doc_id").mapInArrow(tops, "r long, top long").groupBy("r").agg(F.max("top")).collect()
    top = dict(sorted(((r, x) for r, x in found), reverse=True))
    order = list(top)
    return bounds, top, dict(zip(order, order[1:] + order[:1]))


def fingerprint_edits(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next smaller doc_id (after the last: the first);
    rows of one id follow by the hash of their text, null ids come last.  Null texts are
    empty.  Texts are dealt once, compressed, to ranges of ids; the first document of each
    range goes to the range before as well, so that a range is worked through on its own.
    An empty table gives no rows.
    """
    rows = documents(docs, id_col, text_col)
    n = 4 * shuffle_partitions(docs.sparkSession)
    bounds, top, follow = _ranges(rows, n)
    heads: dict[int, list[int]] = {}  # range -> ranges whose next document is its first
    for r, f in follow.items():
        heads.setdefault(f, []).append(r)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out = []
            for doc, text, h in zip(b.column(0).to_pylist(), strings(b.column(1)), b.column(2).to_pylist()):
                r = 0 if doc is None else 1 + bisect.bisect_right(bounds, doc)
                z = pack.compress(text.encode("utf-8"))
                out.append((r, False, doc, h, z))
                if doc == top[r]:
                    out += [(p, True, doc, h, z) for p in heads[r]]
            cols = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["r", "is_next", "doc_id", "thash", "z"])

    dealt = rows.mapInArrow(deal, "r long, is_next boolean, doc_id long, thash long, z binary")
    ordered = dealt.repartition(n, "r").sortWithinPartitions(
        "r", "is_next", F.col("doc_id").desc_nulls_last(), "thash")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, out = zstandard.ZstdDecompressor(), []
        held = None  # (range, doc_id, text, hashes, positions) waiting for its next document

        def done(prev: tuple, text: str, hashes: np.ndarray) -> None:
            edit = edited(prev[2], text)
            eh, ep = winnow(edit, k, window)
            out.append((prev[1], len(prev[2]), hashlib.sha256(edit.encode("utf-8")).hexdigest(),
                        to_string(prev[3], prev[4]), to_string(eh, ep), likeness(prev[3], eh), likeness(prev[3], hashes)))

        def batch() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[
                "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            out.clear()
            return made

        for b in batches:
            for r, is_next, doc, z in zip(*(b.column(c).to_pylist() for c in ("r", "is_next", "doc_id", "z"))):
                if is_next and (held is None or held[0] != r):
                    continue  # a further row with the first id of the range that follows
                text = unpack.decompress(z, max_output_size=1 << 31).decode("utf-8") if z else ""
                hashes, positions = winnow(text, k, window)
                if held is not None and held[0] == r:
                    done(held, text, hashes)
                held = None if is_next else (r, doc, text, hashes, positions)
                if len(out) >= 1000:
                    yield batch()
        if out:
            yield batch()

    return ordered.select("r", "is_next", "doc_id", "z").mapInArrow(
        work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
