"""Concatenate and cut: documents as one token stream, cut into fixed windows.

Pass one tokenises every document once and writes its ids with its offset within the
partition that held it.  The totals of the partitions (one number each) give, by a
prefix sum, the global offset of each partition; pass two cuts each document where the
windows of the global stream end and writes one boundary record per piece.  Nothing is
shuffled, no task sees more than a batch of rows, and the only padding is after the
last id of the stream.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, documents, shared_dir
from ._runs import sliced
from .word_bpe import word_encoder

PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def token_stream(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(part, start, n, doc_id, ids): ids are little-endian unsigned 32 or 16 bit with ``end_id`` last,
    ``start`` the number of ids before them in partition ``part``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, enc = TaskContext.get().partitionId(), 0, word_encoder(tokenizer)
        tail = np.array([end_id], enc.dtype).tobytes()
        for b in sliced(batches, 1):
            ids = [x + tail for x in enc.encode(b.column(1))]
            n = np.array([len(x) // enc.dtype.itemsize for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int64()), pa.array(starts), pa.array(n), b.column(0),
                 pa.array(ids, pa.binary())], names=["part", "start", "n", "doc_id", "ids"])
    return documents(docs, id_col, text_col).select("doc_id", "text").mapInArrow(
        run, "part long, start long, n long, doc_id long, ids binary")


def cut_windows(stream: DataFrame, window: int) -> DataFrame:
    """Boundary records of the pieces that the windows of the global stream cut."""
    # One number per partition of pass one, not per row.
    totals = stream.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4):
            out: list[tuple] = []
            parts, starts, ns, docs, ids = (b.column(c).to_pylist() for c in ("part", "start", "n", "doc_id", "ids"))
            for part, start, n, doc, raw in zip(parts, starts, ns, docs, ids):
                at = base[part] + start
                tokens = np.frombuffer(raw, np.dtype(f"<u{len(raw) // n}")).astype("<u4")
                done = 0
                while done < n:
                    seq, offset = divmod(at + done, window)
                    size = min(n - done, window - offset)
                    out.append((doc, done, size, zlib.crc32(tokens[done:done + size]), n, seq, offset))
                    done += size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                                        "sequence_id", "offset"])
    return stream.mapInArrow(run, PIECE_SCHEMA)


def pack(docs: DataFrame, window: int = 2048, tokenizer: str | None = None, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The stream is cut every ``window`` ids; only the last sequence can be short.  A null or
    empty text is the end id alone.  A null doc_id and repeated rows are packed like any
    other; an empty table gives no rows.  The order of documents is that of the scan.
    """
    stream = token_stream(docs, tokenizer or default_tokenizer(), end_id, id_col, text_col)
    return cut_windows(cut(stream, f"{shared_dir(docs.sparkSession)}/tokens"), window)
