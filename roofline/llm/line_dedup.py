"""Line dedup: exact reference counts behind sharded cuckoo filters, reversible by document.

The index of a corpus is two tables.  ``counts`` holds for each line key (a 128-bit hash
of the normalised line) the number of documents with it, sharded by the key.  ``filters``
holds for each shard a cuckoo filter of the keys that reached ``min_docs``.  Inserting
documents adds to the counts and puts the keys that cross ``min_docs`` into their
filters; deleting documents subtracts and takes the keys that fall below out again, so
an insertion followed by the deletion of the same documents gives the old index back.
Looking up goes to the filters first; only lines that a filter knows are joined with the
exact counts, so false positives of the filters never reach the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE, U64, carried, cut, documents, map_batches, same_row, shared_dir, shuffle_partitions, utf8

LINES_SCHEMA = "doc_id long, thash long, keys array<binary>"
COUNTS_SCHEMA = "shard int, key binary, n_docs long"
FILTERS_SCHEMA = "shard int, buckets long, slots binary"
SLOTS, KICKS = 4, 500


def line_key(line: bytes) -> bytes:
    """A line's key: stripped of ASCII white space, A-Z lower-cased."""
    return line.strip(SPACE).lower()


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key has two buckets.  Keys are 64-bit hashes."""

    def __init__(self, buckets: int = 64, slots: np.ndarray | None = None):
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots.reshape(-1, SLOTS)

    @property
    def mask(self) -> int:
        return len(self.slots) - 1

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        """Room for ``n`` keys at a load of four fifths at most."""
        return cls(1 << max(4, int(np.ceil(np.log2(max(n, 1) / (SLOTS * 0.8))))))

    @staticmethod
    def fingerprint(h):
        return (h >> U64(48)) | U64(1)

    @staticmethod
    def spread(fp):
        return (fp * U64(0x5BD1E9955BD1E995)) >> U64(20)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp = self.fingerprint(hashes)
        first = hashes & U64(self.mask)
        return fp.astype(np.uint16), first.astype(np.int64), ((first ^ self.spread(fp)) & U64(self.mask)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(hashes)
        return ((self.slots[a] == fp[:, None]) | (self.slots[b] == fp[:, None])).any(axis=1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False when the filter is full; it must then be built anew, larger, from the exact counts."""
        rng = np.random.default_rng(len(hashes))
        for fp, a, b in zip(*(x.tolist() for x in self.places(hashes))):
            at = a
            for bucket in (a, b):
                if (free := np.flatnonzero(self.slots[bucket] == 0)).size:
                    self.slots[bucket, free[0]] = fp
                    break
            else:
                for _ in range(KICKS):
                    slot = int(rng.integers(SLOTS))
                    fp, self.slots[at, slot] = int(self.slots[at, slot]), fp
                    with np.errstate(over="ignore"):
                        at = int((U64(at) ^ self.spread(U64(fp))) & U64(self.mask))
                    if (free := np.flatnonzero(self.slots[at] == 0)).size:
                        self.slots[at, free[0]] = fp
                        break
                else:
                    return False
        return True

    def delete(self, hashes: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for fp, a, b in zip(*(x.tolist() for x in self.places(hashes))):
            for bucket in (a, b):
                if (held := np.flatnonzero(self.slots[bucket] == fp)).size:
                    self.slots[bucket, held[0]] = 0
                    break


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """The upper 64 bits of 128-bit keys (the lower ones choose the shard)."""
    return np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2)[:, 0].astype(U64)


@dataclass
class LineIndex:
    """``counts`` and ``filters`` of a corpus, in the shared folder."""
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int

    @staticmethod
    def empty(spark: SparkSession, min_docs: int = 10, shards: int | None = None) -> LineIndex:
        return LineIndex(spark.createDataFrame([], COUNTS_SCHEMA), spark.createDataFrame([], FILTERS_SCHEMA),
                         shards or shuffle_partitions(spark), min_docs)


def line_keys(docs: DataFrame) -> DataFrame:
    """The distinct line keys of each row of ``documents()``."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keys = [list({xxhash.xxh3_128_digest(line_key(x)) for x in raw.split(b"\n")} - {EMPTY}) for raw in utf8(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.list_(pa.binary()))],
                                          names=["doc_id", "thash", "keys"])
    return map_batches(docs, run, LINES_SCHEMA)


#: A key of no code points is never dropped.
EMPTY = xxhash.xxh3_128_digest(b"")


def _shard(shards: int):
    return F.pmod(F.conv(F.hex(F.substring("key", 13, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int").alias("shard")


def update(index: LineIndex, lines: DataFrame, sign: int, home: str) -> LineIndex:
    """The index with the documents of ``lines`` (from ``line_keys``) put in (1) or taken out (-1)."""
    # One (key, row) each: every row is a document.
    own = lines.select("doc_id", F.explode("keys").alias("key"))
    change = own.groupBy("key").agg(F.count(F.lit(1)).alias("d")).select(
        _shard(index.shards), "key", F.lit(0).cast("long").alias("n"), (F.col("d") * sign).alias("d"))
    old = index.counts.select("shard", "key", F.col("n_docs").alias("n"), F.lit(0).cast("long").alias("d"))
    both = cut(old.unionByName(change).groupBy("shard", "key").agg(F.sum("n").alias("n"), F.sum("d").alias("d")),
               f"{home}/change")
    after, m = F.col("n") + F.col("d"), index.min_docs
    counts = both.select("shard", "key", after.alias("n_docs")).where("n_docs > 0")
    crossing = both.where((F.col("n") >= m) != (after >= m)).select("shard", "key", (after >= m).alias("up"))
    hot = counts.where(F.col("n_docs") >= m).select("shard", "key")

    def step(shard: tuple, changed: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        # A shard's keys over the threshold: bounded by the number of shards, which grows with the corpus.
        up, down = (key_hashes(changed.key[changed.up == x].tolist()) for x in (True, False))
        f = CuckooFilter(slots=np.frombuffer(held.slots[0], np.uint16).copy()) if len(held) else CuckooFilter.sized(len(up))
        f.delete(down)
        buckets = len(f.slots) if f.insert(up) else 0
        return pd.DataFrame({"shard": [shard[0]], "buckets": [buckets], "slots": [f.slots.tobytes()]})

    def rebuild(shard: tuple, keys: pd.DataFrame) -> pd.DataFrame:
        n = 2 * len(keys)
        while not (f := CuckooFilter.sized(n)).insert(key_hashes(keys.key.tolist())):
            n *= 2
        return pd.DataFrame({"shard": [shard[0]], "buckets": [len(f.slots)], "slots": [f.slots.tobytes()]})

    stepped = cut(crossing.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInPandas(step, FILTERS_SCHEMA),
                  f"{home}/stepped")
    # A filter that had no room (0 buckets) is built anew from the exact counts.
    full = stepped.where("buckets = 0").select("shard")
    anew = hot.join(full, "shard", "left_semi").groupBy("shard").applyInPandas(rebuild, FILTERS_SCHEMA)
    kept = index.filters.join(stepped.select("shard"), "shard", "left_anti")
    filters = cut(stepped.where("buckets > 0").unionByName(anew).unionByName(kept), f"{home}/filters")
    return LineIndex(counts, filters, index.shards, index.min_docs)


def insert(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    home = shared_dir(docs.sparkSession)
    return update(index, cut(line_keys(documents(docs, id_col, text_col)), f"{home}/lines"), 1, home)


def delete(index: LineIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
    home = shared_dir(docs.sparkSession)
    return update(index, cut(line_keys(documents(docs, id_col, text_col)), f"{home}/lines"), -1, home)


def known_lines(lines: DataFrame, index: LineIndex, salts: int = 16) -> DataFrame:
    """(doc_id, thash, key) of the lines in at least ``min_docs`` documents: filter, then exact counts.

    A shard's filter meets the lines of that shard in ``salts`` groups, so a line that a
    third of the documents hold is spread over ``salts`` tasks.
    """
    rows = lines.select("doc_id", "thash", F.explode("keys").alias("key"))
    rows = rows.select(_shard(index.shards), F.pmod(F.col("thash"), F.lit(salts)).cast("int").alias("salt"),
                       "doc_id", "thash", "key")
    filters = index.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "slots")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.select(["doc_id", "thash", "key"])
        if not right.num_rows or not left.num_rows:
            return out.slice(0, 0)
        f = CuckooFilter(slots=np.frombuffer(right["slots"][0].as_py(), np.uint16))
        return out.filter(pa.array(f.contains(key_hashes(left["key"].to_pylist()))))

    likely = rows.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt")).applyInArrow(
        probe, "doc_id long, thash long, key binary")
    exact = index.counts.where(F.col("n_docs") >= index.min_docs).select("key")
    return likely.join(exact, "key", "left_semi")


def drop_lines(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, thash, text, n_lines, n_dropped): each row of ``documents()`` without the lines of its known keys."""
    per_row = known.groupBy("doc_id", "thash").agg(F.collect_set("key").alias("keys"))
    extra = [docs["row"]] if "row" in docs.columns else []
    met = docs.join(per_row, same_row(docs, per_row), "left").select(
        docs["doc_id"], docs["thash"], docs["text"], per_row["keys"], *extra)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, n, gone = [], [], []
        for raw, keys in zip(utf8(b.column(2)), b.column(3).to_pylist()):
            lines, drop = raw.split(b"\n"), set(keys or ())
            kept = [x for x in lines if xxhash.xxh3_128_digest(line_key(x)) not in drop] if drop else lines
            texts.append(b"\n".join(kept))
            n.append(len(lines))
            gone.append(len(lines) - len(kept))
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()),
             pa.array(gone, pa.int64()), *b.columns[4:]],
            names=["doc_id", "thash", "text", "n_lines", "n_dropped", *b.schema.names[4:]])
    return map_batches(met, run, carried("doc_id long, thash long, text string, n_lines long, n_dropped long", docs))


def line_dedup(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id",
               text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, thash, text, n_lines, n_dropped): texts without the lines known in ``min_docs`` documents.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased; empty
    keys always stay.  ``keep_first``: a known line stays in the row with the smallest
    (doc_id, thash) that has it, so that of many copies of a document one stays whole.
    ``carry`` adds ``row``, the row's other columns.
    Null and empty texts are one empty line.  Each row counts as a document; a null
    doc_id is an id like another (the smallest).  An empty table gives no rows.
    """
    home = shared_dir(docs.sparkSession)
    rows = documents(docs, id_col, text_col, carry)
    lines = cut(line_keys(rows.select("doc_id", "text", "thash")), f"{home}/lines")
    index = update(LineIndex.empty(docs.sparkSession, min_docs), lines, 1, home)
    known = known_lines(lines, index)
    if keep_first:
        known = cut(known, f"{home}/known")
        row = F.struct("doc_id", "thash")
        first = known.groupBy("key").agg(F.min(row).alias("first"))
        known = known.join(first, "key").where(~row.eqNullSafe(F.col("first"))).select("doc_id", "thash", "key")
    return drop_lines(rows, known)
