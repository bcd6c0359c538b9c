"""Dedup: seen ids, content signatures, seen-store maintenance (A13, D3, D4, F2,
H1-H5, E10).

The seen store grows for ever, so it is a table joined with ``left_anti``; Spark
picks a sort-merge or hash join, and AQE broadcasts it only when the runtime size
is small.  Signatures are uniform hashes except for null, so a null signature is
grouped under the listing's own id and never forms one hot group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import content_signature

SEEN_COLS = ["key", "title", "url", "source"]


def read_seen(spark, *paths: str, fmt: str = "parquet") -> DataFrame:
    """Ids from every store; a missing store counts as empty, an unreadable one
    raises;
    JSON stores may be ``{"seen": [...]}`` or a bare list; null ids are dropped."""
    frames = []
    for p in paths:
        try:
            if fmt == "json":
                raw = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").text(p, wholetext=True)
                arr = F.coalesce(
                    F.from_json(F.get_json_object("value", "$.seen"), "array<string>"),
                    F.from_json("value", "array<string>"))
                df = raw.select(F.explode(arr).alias("key"))
            else:
                df = spark.read.parquet(p)
        except AnalysisException as e:  # only an absent store is empty
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        frames.append(seen_frame(df))
    if not frames:
        return spark.createDataFrame([], "key string, title string, url string, source string")
    return seen_union(*frames)


def seen_frame(df: DataFrame) -> DataFrame:
    cols = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in SEEN_COLS]
    return df.select(*cols).filter(F.col("key").isNotNull())


def seen_union(*stores: DataFrame) -> DataFrame:
    """H1: union of the stores, one row per key (the first store's row wins)."""
    tagged = [seen_frame(s).withColumn("_store", F.lit(i)) for i, s in enumerate(stores)]
    u = reduce(lambda a, b: a.unionByName(b), tagged)
    first = u.groupBy("key").agg(F.min_by(F.struct("title", "url", "source"), F.col("_store")).alias("r"))
    return first.select("key", "r.title", "r.url", "r.source")


def only_new(listings: DataFrame, seen: DataFrame, key: str = "listing_id") -> DataFrame:
    """D3: listings whose id is absent from the union of the seen stores."""
    return listings.join(seen.select(F.col("key").alias(key)), key, "left_anti")


def with_signature(listings: DataFrame) -> DataFrame:
    return listings.withColumn("signature", content_signature("price", "sqm", "rooms", "location"))


def only_new_signatures(listings: DataFrame, seen: DataFrame) -> DataFrame:
    """Listings whose signature is not in the store; a null signature passes."""
    return listings.join(seen.select(F.col("key").alias("signature")), "signature", "left_anti")


def split_reposts(listings: DataFrame, order: list[str], seen: DataFrame | None = None) -> DataFrame:
    """F2 (+ D4 when ``seen`` is given): mark reposts of the same flat.

    Adds ``dropped`` (boolean) and ``kept_id`` (the listing that represents the
    signature).  The first listing per signature in fetch order is kept unless the
    signature is already seen; null signatures are never dropped.  Expects one row
    per listing id (after F1) and a ``signature`` column (``with_signature``).

    Rows are grouped by the signature, or by their own id when it is null, so null
    signatures never form one hot group; the first member per group is a
    ``min_by`` aggregate (combined map-side) joined back on the group key."""
    group = F.coalesce(F.col("signature"), F.concat(F.lit("id:"), F.col("listing_id")))
    x = listings.withColumn("_g", group)
    first = x.groupBy("_g").agg(
        F.min_by(F.col("listing_id"), F.struct(*[F.col(c) for c in order])).alias("_kept"))
    if seen is not None:
        # Seen keys are ids and "sig:" keys; an "id:" group key never matches one.
        known = seen.select(F.col("key").alias("_g")).distinct().withColumn("_known", F.lit(True))
        first = first.join(known, "_g", "left")
    else:
        first = first.withColumn("_known", F.lit(None).cast("boolean"))
    known = F.coalesce(F.col("_known"), F.lit(False))
    has_sig = F.col("signature").isNotNull()
    return x.join(first, "_g").select(
        *listings.columns,
        (has_sig & (known | (F.col("listing_id") != F.col("_kept")))).alias("dropped"),
        F.when(~has_sig, F.col("listing_id")).when(~known, F.col("_kept")).alias("kept_id"))


def repost_groups(listings: DataFrame, order: list[str]) -> DataFrame:
    """Members per signature and the first member in fetch order."""
    keyed = listings.filter(F.col("signature").isNotNull())
    return keyed.groupBy("signature").agg(
        F.count(F.lit(1)).alias("members"),
        F.min_by(F.col("listing_id"), F.struct(*[F.col(c) for c in order])).alias("first_id"))


def seen_rows(kept: DataFrame, dropped: DataFrame) -> DataFrame:
    """H2: rows to add to the seen store: each kept listing (id, title, url, source)
    plus its signature when it has one; each dropped repost by id only."""
    ids = kept.select(F.col("listing_id").alias("key"), "title", "url", "source")
    sigs = kept.filter(F.col("signature").isNotNull()).select(F.col("signature").alias("key"))
    drop = dropped.select(F.col("listing_id").alias("key"))
    return ids.unionByName(sigs, allowMissingColumns=True).unionByName(drop, allowMissingColumns=True)


def seen_append(existing: DataFrame, additions: DataFrame) -> DataFrame:
    """H3: the rows an idempotent append writes: keys not yet stored, once each."""
    fresh = additions.join(existing.select("key"), "key", "left_anti")
    return fresh.groupBy("key").agg(*[F.first(c, ignorenulls=True).alias(c) for c in SEEN_COLS[1:]])


def store_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """H5: keys present in exactly one of two stores, with the store that has it."""
    ka = a.select("key").distinct().withColumn("in_a", F.lit(True))
    kb = b.select("key").distinct().withColumn("in_b", F.lit(True))
    j = ka.join(kb, "key", "full_outer")
    return j.filter(F.col("in_a").isNull() | F.col("in_b").isNull()).select(
        "key", F.when(F.col("in_a").isNotNull(), "a").otherwise("b").alias("only_in"))
