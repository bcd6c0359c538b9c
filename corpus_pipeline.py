"""The corpus pipeline: language ID, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before kept;
all but the last return the columns of ``documents``, with ``n_chars`` counted anew where
a text has changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roofline.llm import language_id, line_dedup, near_dedup, packing, substring_dedup
from roofline.llm._common import cut, same_row, shared_dir

#: Language models are learned and rejections made per row; no SQL states them.
ORACLE_SQL = None


def _with_text(docs: DataFrame, done: DataFrame) -> DataFrame:
    """The columns of ``docs`` from an operator's rows: ``text`` is new, the others are in ``row``."""
    n = F.length("text").cast("long")
    own = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, n).otherwise(F.col("row.n_chars"))}
    return done.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; rejected are those without letters or unlike every language."""
    done = language_id.identify(docs, language_id.train(docs), carry=True).where("not rejected")
    return _with_text(docs, done.withColumn("n_dropped", F.lit(0)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents stay in the first of them only; documents left without a text go."""
    done = line_dedup.line_dedup(docs, min_docs=10, keep_first=True, carry=True)
    return _with_text(docs, done.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the first.

    Rows that repeat an id and a text are one document and stay together.
    """
    groups = near_dedup.near_groups(docs, k=5, percent=80)
    kept = groups.where(F.struct("doc_id", "thash").eqNullSafe(F.col("first"))).select("doc_id", "thash")
    kept = cut(kept.distinct(), f"{shared_dir(spark)}/kept")
    rows = docs.withColumn("thash", F.xxhash64(F.col("text").cast("string")))
    return rows.join(kept, same_row(rows, kept), "left_semi").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of fifty words that an earlier document has go; documents left without a text go.
    A text that loses nothing keeps its line breaks."""
    done = substring_dedup.substring_dedup(docs, window=50, carry=True, layout=True)
    return _with_text(docs, done.where("n_removed = 0 or text != ''").withColumn("n_dropped", F.col("n_removed")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the sequences of 2048 tokens."""
    return packing.pack(docs, window=2048)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near),
          ("substring_dedup", passages), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again before the next."""
    home = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"{home}/{name}")
    return docs
