"""Landed pages: scan, page plan and page-walk cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import page_url, with_radius

PAGE_SCHEMA = ("search_id bigint, page_no int, url string, attempt int, status int, error string, "
               "fetched_at timestamp_ntz, body string")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: landed pages with an explicit schema (no inference, no probe)."""
    return spark.read.format(fmt).schema(PAGE_SCHEMA).load(path)


def read_pages_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A1 as a stream of newly landed files."""
    r = spark.readStream.format("parquet").schema(PAGE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def plan_pages(searches: DataFrame, max_pages: int) -> DataFrame:
    """The URL of pages 1..max_pages per search, radius applied first."""
    base = with_radius("url", "radius_km")
    return (searches.select("search_id", base.alias("_base"),
                            F.explode(F.sequence(F.lit(1), F.lit(max(1, max_pages)))).alias("page_no"))
            .select("search_id", "page_no", page_url("_base", "page_no").alias("page_url")))


def cut_page_walk(cards: DataFrame, pages: DataFrame, max_pages: int, id_col: str = "listing_id") -> DataFrame:
    """Per search, keep pages in order until the first page that is missing,
    failed (page > 1), or brings no id unseen on earlier pages, or ``max_pages``.
    An error on page 1 fails the whole search.  Repeats inside one page are kept.

    ``cards``: (search_id, page_no, pos, id...); ``pages``: (search_id, page_no,
    failed) for every fetched page.  All steps are aggregations and joins on keys."""
    # Pages past max_pages are never walked; dropping them first bounds every
    # per-search list below by max_pages.
    cards = cards.filter(F.col("page_no") <= max_pages)
    pages = pages.filter(F.col("page_no") <= max_pages)
    first_seen = cards.groupBy("search_id", id_col).agg(F.min("page_no").alias("_first"))
    fresh = first_seen.groupBy("search_id", F.col("_first").alias("page_no")).agg(F.count(F.lit(1)).alias("fresh"))
    pg = (pages.select("search_id", "page_no", "failed")
          .join(fresh, ["search_id", "page_no"], "left")
          .withColumn("fresh", F.coalesce("fresh", F.lit(0))))
    # A page stops the walk when it failed or brought nothing new.
    stop = F.when(F.col("failed") | (F.col("fresh") == 0), F.col("page_no"))
    cuts = pg.groupBy("search_id").agg(
        F.min(stop).alias("_stop"),
        F.max(F.when(F.col("page_no") == 1, F.col("failed"))).alias("_p1_failed"),
        F.sort_array(F.collect_set("page_no")).alias("_pages"))
    # The first page number missing from the fetched pages also stops the walk.
    missing = F.aggregate(F.col("_pages"), F.lit(1), lambda acc, p: F.when(p == acc, acc + 1).otherwise(acc))
    cuts = cuts.select("search_id", F.least(F.coalesce("_stop", F.lit(max_pages + 1)), missing,
                                            F.lit(max_pages + 1)).alias("cut"),
                       F.coalesce("_p1_failed", F.lit(False)).alias("source_failed"))
    kept = (cards.join(first_seen, ["search_id", id_col])
            .join(cuts, "search_id")
            .filter(~F.col("source_failed") & (F.col("page_no") < F.col("cut")) & (F.col("page_no") == F.col("_first")))
            .drop("_first", "cut", "source_failed"))
    return kept
