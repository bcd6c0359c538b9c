"""Substring dedup: windows of words that also start in an earlier document.

The anchor of a window is its rightmost smallest 8-gram hash, so equal windows have equal
anchors.  Windows of a document that follow each other with one anchor are a segment.
Segments are compared in three steps.  Words count as equal when their bytes' 64-bit hashes
are, segments when in addition their anchors and the hash over all their words are:

1. Anchors that only one document has are done: none of their windows repeats.
2. A segment that an earlier document has word for word repeats as a whole; copies and
   the inside of shared passages end here, whatever their number.
3. What is left are different segments with one anchor (edited copies, the edges of
   shared passages), each once.  They are sharded by anchor; each shard builds a
   compressed FM-index (a wavelet matrix of packed bits over the k-ordered BWT) of its
   segments and streams them through it: backward search gives at each word the longest
   match to its left in an earlier document, and intervals of at least the threshold
   are reported.  An anchor with more than ``block`` different segments would make a
   shard as large as the group; its windows are counted by hash instead, with partial
   aggregation, which is exact for groups of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, U64, carried, cut, documents, map_batches, same_row, shared_dir, utf8
from ._runs import FILLED, runs, sliced
from ._runs import word_hashes as batch_hashes
from .fingerprints import BASE, INVERSE, mix, powers

GRAM = 8
IS_SPACE = np.isin(np.arange(256, dtype=np.uint8), np.frombuffer(SPACE, np.uint8))
FORTH, BACK = powers(BASE, 1 << 16), powers(INVERSE, 1 << 16)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those of longer texts are not kept."""
    return (FORTH[:n], BACK[:n]) if n <= len(FORTH) else (powers(BASE, n), powers(INVERSE, n))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of the values, from prefix sums.  The values must be hashes themselves
    and the stretches at most some hundred long: sums modulo 2^64 of a longer stretch of two values that
    take turns can be equal whatever the values are."""
    forth, back = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * forth[:len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64) * BASE)


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs without ASCII white space."""
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = IS_SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    words = raw.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def segments(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, hash of all words covered) of each segment."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none, none
    n = len(words) - GRAM + 1
    at = np.arange(n)
    grams = range_hashes(words, at, at + GRAM)
    # Sliding minimum over the grams of a window; of equal hashes the rightmost.
    span = window - GRAM + 1
    if n >= 1 << 20:
        raise ValueError("a text is handled in stretches below 2^20 words")
    best = (grams & ~U64(0xFFFFF)) | (n - 1 - at).astype(U64)
    width = 1
    while width < span:
        step = min(width, span - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    first = np.flatnonzero(np.diff(best, prepend=best[0] + U64(1)))
    last = np.append(first[1:], len(best)) - 1
    spot = n - 1 - (best[first] & U64(0xFFFFF)).astype(np.int64)
    return first, last, grams[spot].view(np.int64), range_hashes(words, first, last + window).view(np.int64)


STRETCH = 1 << 19


def document_segments(raw: bytes, window: int) -> tuple[np.ndarray, ...]:
    """``segments`` of a text of any length."""
    return long_segments(word_hashes(raw), window)


def long_segments(words: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """``segments`` of any number of words, in overlapping stretches."""
    if len(words) <= STRETCH:
        return segments(words, window)
    parts = []
    for i in range(0, len(words) - window + 1, STRETCH):
        a, b, g, h = segments(words[i:i + STRETCH + window - 1], window)
        parts.append((a + i, b + i, g, h))
    return tuple(np.concatenate(x) for x in zip(*parts))


def segment_table(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, thash, a, b, anchor, seg) of ``documents()``; rows without an id have no place in the order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            words, place, _, _ = runs(b.column(1), FILLED, lower=False)
            hashes, rows, cols = batch_hashes(words), [], []
            for i in range(b.num_rows):
                got = long_segments(hashes[place[i]:place[i + 1]], window)
                if len(got[0]):
                    rows.append(np.full(len(got[0]), i))
                    cols.append(got)
            if rows:
                which = pa.array(np.concatenate(rows))
                a, e, g, h = (np.concatenate(x) for x in zip(*cols))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(which), b.column(2).take(which), pa.array(a.astype(np.int32)),
                     pa.array(e.astype(np.int32)), pa.array(g), pa.array(h)],
                    names=["doc_id", "thash", "a", "b", "anchor", "seg"])
    return docs.where("doc_id is not null").mapInArrow(
        run, "doc_id long, thash long, a int, b int, anchor long, seg long")


class FMIndex:
    """FM-index of sequences of small integers: backward search for patterns up to ``order`` long.

    The suffixes are sorted by their first ``order`` symbols, which is all that patterns of
    that length can see.  The BWT is a wavelet matrix: one packed bit vector per bit of the
    alphabet with a count per 64 bits.
    """

    def __init__(self, text: np.ndarray, order: int):
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        width = 1
        while width < order:
            after = np.full(n, -1, np.int64)
            after[:-width] = rank[width:]
            rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
            width *= 2
        self.sa = np.argsort(rank, kind="stable")
        bwt = text[self.sa - 1]
        self.sigma = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.levels = []  # (packed bits, ones before each word, zeros in all)
        for shift in range(max(1, int(self.sigma - 1).bit_length()) - 1, -1, -1):
            bit = (bwt >> shift & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(-n % 64 + 64, np.uint8)), bitorder="little").view(U64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])
            self.levels.append((shift, packed, ones, n - int(bit.sum())))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the BWT before each place."""
        start = np.zeros(len(at), np.int64)
        for shift, packed, ones, zeros in self.levels:
            bit = (symbol >> shift & 1).astype(bool)

            def count(i):
                word = i >> 6
                return ones[word] + np.bitwise_count(packed[word] & ((U64(1) << (i & 63).astype(U64)) - U64(1)))
            a, b = count(start), count(at)
            start, at = np.where(bit, zeros + a, start - a), np.where(bit, zeros + b, at - b)
        return at - start

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of the patterns with one more symbol in front."""
        return self.before[symbol] + self.rank(symbol, lo), self.before[symbol] + self.rank(symbol, hi)


class RangeMin:
    """Smallest value of any range: a sparse table."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        width = 1
        while 2 * width <= len(values):
            self.rows.append(np.minimum(self.rows[-1][:-width], self.rows[-1][width:]))
            width *= 2

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.rows[0].dtype)
        for k in np.unique(level):
            on = level == k
            out[on] = np.minimum(self.rows[k][lo[on]], self.rows[k][hi[on] - (1 << int(k))])
        return out


def earlier_matches(texts: list[np.ndarray], docs: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of the stretches of ``threshold`` symbols that also stand in a text of a smaller document.

    Matching statistics, kept as far as the threshold: for every end the match is extended
    to the left for as long as a smaller document has it.
    """
    sizes = np.array([len(t) for t in texts])
    symbols = np.unique(np.concatenate(texts), return_inverse=True)[1] + 1  # 0 ends a text
    starts = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    inside = np.ones(len(text), bool)
    inside[starts + sizes] = False
    text[inside] = symbols
    owner = np.repeat(docs, sizes + 1)
    index = FMIndex(text, threshold)
    smallest = RangeMin(owner[index.sa])
    ends = np.concatenate([np.arange(s + threshold, s + n + 1) for s, n in zip(starts, sizes)])
    number = np.repeat(np.arange(len(texts)), sizes - threshold + 1)
    lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(text), np.int64)
    live = np.arange(len(ends))
    for depth in range(1, threshold + 1):
        lo[live], hi[live] = index.extend(lo[live], hi[live], text[ends[live] - depth])
        live = live[smallest(lo[live], hi[live]) < docs[number[live]]]
        if not len(live):
            break
    return number[live], ends[live] - threshold - starts[number[live]]


def _merge(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:-1]) > 0


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, thash, z) of ``documents()``, with the row it carries: the texts compressed, for a shuffle."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1)
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array([pack.compress(x) for x in utf8(b.column(1))], pa.binary()), *b.columns[3:]],
            names=["doc_id", "thash", "z", *b.schema.names[3:]])
    return map_batches(docs, run, carried("doc_id long, thash long, z binary", docs))


def _unpack(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z, max_output_size=1 << 31)


def repeated_spans(docs: DataFrame, window: int, block: int, home: str) -> DataFrame:
    """(doc_id, thash, a, b): windows a to b of a row of ``documents()`` also start in a smaller document."""
    rows = cut(segment_table(docs, window), f"{home}/segments")
    anchors = cut(rows.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                  .where("least < most").select("anchor", "least"), f"{home}/anchors")
    shared = cut(rows.join(anchors, "anchor"), f"{home}/shared")
    first = cut(shared.groupBy("anchor", "seg").agg(F.min(F.struct("doc_id", "thash", "a", "b")).alias("first"),
                                                    F.min("least").alias("least")), f"{home}/first")
    held = shared.join(first.select("anchor", "seg", F.col("first.doc_id").alias("earliest")), ["anchor", "seg"])
    whole = held.where("earliest < doc_id").select("doc_id", "thash", "a", "b")
    own = held.where("earliest = doc_id").select("anchor", "seg", "doc_id", "thash", "a")  # wherever it stands there
    kinds = cut(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), f"{home}/kinds")
    mixed = first.join(kinds, "anchor").select("anchor", "seg", "first.*", (F.col("kinds") > block).alias("large"))
    per_doc = mixed.groupBy("doc_id", "thash").agg(F.collect_list(F.struct("a", "b", "anchor", "seg", "large")).alias("segs"))
    texts = packed_texts(docs)
    met = texts.join(per_doc, ["doc_id", "thash"]).select("doc_id", "z", "segs")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            out = []
            for doc, z, segs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "segs"))):
                raw = _unpack(z)
                starts, ends = word_bounds(raw)
                for s in segs:
                    out.append((s["anchor"], s["seg"], doc, s["large"], raw[starts[s["a"]]:ends[s["b"] + window - 1]]))
            cols = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["anchor", "seg", "doc_id", "large", "words"])
    found = cut(met.mapInArrow(words, "anchor long, seg long, doc_id long, large boolean, words binary"), f"{home}/words")
    spans = "anchor long, seg long, lo int, hi int"

    def search(group: pa.Table) -> pa.Table:
        # A shard: about ``block`` different segments, or one anchor's if they are more, up to that many.
        texts = pc.split_pattern_regex(group["words"].cast(pa.string()).combine_chunks(), "[ \t\n\x0b\x0c\r]+")
        code = texts.flatten().dictionary_encode().indices.to_numpy()
        at = texts.offsets.to_numpy()
        number, start = earlier_matches([code[i:j] for i, j in zip(at, at[1:])], group["doc_id"].to_numpy(), window)
        # Starts that follow each other in one segment are one interval.
        new = np.ones(len(start), bool)
        new[1:] = (np.diff(number) != 0) | (np.diff(start) != 1)
        first_, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(start))[:int(new.sum())] - 1
        take = pa.array(number[first_])
        return pa.table({"anchor": group["anchor"].take(take), "seg": group["seg"].take(take),
                         "lo": pa.array(start[first_].astype(np.int32)), "hi": pa.array(start[last].astype(np.int32))})

    small = found.where("not large")
    shards = max(1, small.count() // block)
    searched = small.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).select(
        "shard", "anchor", "seg", "doc_id", "words").groupBy("shard").applyInArrow(search, spans)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3):
            which, cols = [], []
            for i, raw in enumerate(batch.column(3).to_pylist()):
                values = word_hashes(raw)
                at = np.arange(len(values) - window + 1)
                which.append(np.full(len(at), i))
                # Two hashes of the window, the second over other values for the words.
                cols.append((at, range_hashes(values, at, at + window).view(np.int64),
                             range_hashes(mix(values + BASE), at, at + window).view(np.int64)))
            if which:
                take = pa.array(np.concatenate(which))
                lo, h, g = (np.concatenate(x) for x in zip(*cols))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(lo.astype(np.int32)),
                                                  pa.array(h), pa.array(g)], names=["anchor", "seg", "doc_id", "lo", "h", "g"])
    hashed = found.where("large").select("anchor", "seg", "doc_id", "words").mapInArrow(
        windows, "anchor long, seg long, doc_id long, lo int, h long, g long")
    least = cut(hashed.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                .where("least < most").select("h", "g", "least"), f"{home}/windows")
    counted = hashed.join(least, ["h", "g"]).where("least < doc_id").select("anchor", "seg", "lo", F.col("lo").alias("hi"))
    parts = searched.unionByName(counted).join(own, ["anchor", "seg"]).select(
        "doc_id", "thash", (F.col("a") + F.col("lo")).alias("a"), (F.col("a") + F.col("hi")).alias("b"))
    return whole.unionByName(parts)


def substring_dedup(docs: DataFrame, window: int = 50, block: int = 2000, id_col: str = "doc_id",
                    text_col: str = "text", carry: bool = False, layout: bool = False) -> DataFrame:
    """(doc_id, thash, text, n_words, n_removed): the words left, joined by one blank.

    Words are runs without ASCII white space, unchanged.  A word goes when a window of
    ``window`` words that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input.  Null, empty and short texts have no windows; rows
    that share an id are one document; rows without an id neither lose words nor count as
    earlier.  An empty table gives no rows.  ``carry`` adds ``row``, the row's other
    columns; ``layout`` leaves a text that loses nothing as it is.
    """
    home = shared_dir(docs.sparkSession)
    rows = documents(docs, id_col, text_col, carry)
    spans = repeated_spans(rows.select("doc_id", "text", "thash"), window, block, home)
    per_row = spans.groupBy("doc_id", "thash").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    texts = packed_texts(rows)
    extra = [texts["row"]] if carry else []
    met = texts.join(per_row, same_row(texts, per_row), "left").select(texts["doc_id"], texts["thash"], "z", "spans", *extra)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out, n, gone = [], [], []
        for z, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            raw = _unpack(z)
            words = raw.split()
            n.append(len(words))
            if spans:
                drop = _merge([(s["a"], s["b"] + window) for s in spans], len(words))
                words = [w for w, d in zip(words, drop.tolist()) if not d]
            gone.append(n[-1] - len(words))
            out.append(raw if layout and not gone[-1] else b" ".join(words))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()).cast(pa.string()),
                                           pa.array(n, pa.int64()), pa.array(gone, pa.int64()), *b.columns[4:]],
                                          names=["doc_id", "thash", "text", "n_words", "n_removed", *b.schema.names[4:]])
    return map_batches(met, run, carried("doc_id long, thash long, text string, n_words long, n_removed long", rows))
