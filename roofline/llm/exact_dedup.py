"""Exact dedup by content-defined chunk recipes.

A document is cut into chunks where a rolling gear hash of the last 32 bytes has its
upper bits zero, so equal stretches of text give equal chunks wherever they stand.
Each chunk gets a verified identifier: its 64-bit hash where all chunks with that hash
agree in SHA-256 and length, its SHA-256 otherwise.  A document is then its recipe, the
ordered list of its chunk identifiers, and two documents are equal when their recipes
are.  Only recipes move between machines, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, cut, documents, shared_dir, utf8

GEAR = np.random.default_rng(20260801).integers(0, 2**32, 256, dtype=np.uint32)
CHUNK_SCHEMA = ("rid long, doc_id long, text_sha256 string, "
                "chunks array<struct<key: long, sha: binary, len: int>>")


def gear_hash(data: np.ndarray) -> np.ndarray:
    """For each byte the gear hash of the 32 bytes that end there: h = sum(G[b] << age)."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        older = h[:-s] << np.uint32(s)
        h = h.copy()
        h[s:] += older
    return h


def chunk_ends(data: bytes, avg_bits: int = 10, min_size: int = 256, max_size: int = 8192) -> list[int]:
    """Ends of the chunks: where the hash has ``avg_bits`` zero upper bits, within the size limits."""
    n = len(data)
    if n <= min_size:
        return [n] if n else []
    found = np.flatnonzero(gear_hash(np.frombuffer(data, np.uint8)) < np.uint32(1 << (32 - avg_bits))) + 1
    ends, last = [], 0
    for end in (*found.tolist(), n):
        while end - last > max_size:
            last += max_size
            ends.append(last)
        if end - last >= min_size or end == n and end > last:
            ends.append(end)
            last = end
    return ends


def chunk_documents(docs: DataFrame, avg_bits: int = 10, min_size: int = 256, max_size: int = 8192,
                    normalise=ascii_lower, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its chunks; ``rid`` numbers the rows."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for b in batches:
            shas, chunks = [], []
            for raw in utf8(b.column(1)):
                data = normalise(raw)
                shas.append(hashlib.sha256(data).hexdigest())
                last, own = 0, []
                for end in chunk_ends(data, avg_bits, min_size, max_size):
                    piece = data[last:end]
                    own.append({"key": xxhash.xxh3_64_intdigest(piece) - (1 << 63),
                                "sha": hashlib.sha256(piece).digest(), "len": end - last})
                    last = end
                chunks.append(own)
            ids = pa.array(range(rid, rid + b.num_rows), pa.int64())
            rid += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [ids, b.column(0), pa.array(shas, pa.string()),
                 pa.array(chunks, pa.list_(pa.struct([("key", pa.int64()), ("sha", pa.binary()), ("len", pa.int32())])))],
                names=["rid", "doc_id", "text_sha256", "chunks"])

    return documents(docs, id_col, text_col).select("doc_id", "text").mapInArrow(run, CHUNK_SCHEMA)


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """(key, sole): whether all chunks with this 64-bit key are one chunk by SHA-256 and length."""
    what = F.struct("sha", "len")
    return chunks.groupBy("key").agg((F.min(what) == F.max(what)).alias("sole"))


def recipes(chunked: DataFrame) -> DataFrame:
    """(rid, doc_id, text_sha256, recipe): the ordered list of verified chunk identifiers."""
    rows = chunked.select("rid", "doc_id", "text_sha256", F.posexplode_outer("chunks").alias("pos", "c"))
    rows = rows.select("rid", "doc_id", "text_sha256", "pos", "c.key", "c.sha", "c.len")
    ids = chunk_ids(chunked.select(F.explode("chunks").alias("c")).select("c.*"))
    named = rows.join(ids, "key", "left").withColumn(
        "id", F.when(F.col("sole"), F.hex("key")).otherwise(F.hex("sha")))
    parts = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id")))
    return (named.groupBy("rid").agg(F.first("doc_id").alias("doc_id"),
                                     F.first("text_sha256").alias("text_sha256"),
                                     F.transform(F.array_sort(parts), lambda x: x["id"]).alias("recipe")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **chunking) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  Of equal texts the row with
    the largest doc_id stays (of rows that share it, one).  A null text is empty and equal
    to every empty text; a null doc_id loses to any other.  An empty table gives no rows.
    """
    home = shared_dir(docs.sparkSession)
    chunked = cut(chunk_documents(docs, id_col=id_col, text_col=text_col, **chunking), f"{home}/chunks")
    rows = cut(recipes(chunked), f"{home}/recipes")
    groups = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "rid")).alias("keep"),
                                        F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "recipe").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256")
