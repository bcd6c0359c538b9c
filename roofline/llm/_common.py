"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ._runs import sliced

#: ASCII white space of the word and line rules: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that all machines of the cluster share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def cut(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors cost no recomputation."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, text, thash): the two columns used, whatever else the table has.

    ``doc_id`` and ``thash`` (a hash of the text) name a row; rows equal in both are
    copies of one row and get the same decisions.  ``carry`` adds ``row``, the row's
    columns but for the text.
    """
    text = F.col(text_col).cast("string")
    row = [F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row")] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                       F.xxhash64(text).alias("thash"), *row)


def carried(ddl: str, docs: DataFrame) -> T.StructType:
    """A schema, with the ``row`` that ``documents()`` carries if it does."""
    schema = T.StructType.fromDDL(ddl)
    return schema.add("row", docs.schema["row"].dataType) if "row" in docs.columns else schema


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Join condition of two tables by (doc_id, thash); null ids meet null ids."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["thash"] == b["thash"])


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` of a function on one batch, in slices of some megabytes: a worker that a later operator
    takes over keeps what its largest batch needed."""
    text = next((i for i, f in enumerate(df.schema) if isinstance(f.dataType, (T.StringType, T.BinaryType))), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if text is None else sliced(batches, text):
            if b.num_rows:
                yield fn(b)
    return df.mapInArrow(run, schema)


def ascii_lower(data: bytes) -> bytes:
    """A-Z to a-z and nothing else (bytes.lower() leaves non-ASCII bytes alone)."""
    return data.lower()
