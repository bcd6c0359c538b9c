"""From landed bodies to the cycle (I1 with A1, A2, A4, A5, A8, A9), batch by batch.

Search pages and feed bodies land in two folders, each a file stream.  A micro-batch has
what both have landed since the last one: the last attempt at a page counts; pages are
cut into cards and feeds into items where they lie, before anything is shuffled; the page
walk of each search ends where the rules say; and what is left goes through the cycle of
``cycle_stream``, with the outcome of every source for the run log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delivery as V
from ..sources import extract as X
from ..sources import pages as P
from .cycle_stream import Written, cycle_batch_writer

#: The fetch order of extracted listings.
PAGE_ORDER = ["search_id", "kind", "page_no", "pos"]
PAGE, FEED = "page", "feed"
_KEY = ["search_id", "kind", "page_no"]
#: Bodies are dealt out in this many tasks a core, so that the last ones leave few cores idle.
TASKS_A_CORE = 4


def deal_out(bodies: DataFrame, *key: str) -> DataFrame:
    """Rows with bodies spread by key before they are scanned: a body takes far more work than its compressed size
    tells, by which files and small exchanges are put together."""
    spark = bodies.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return bodies.repartition(n, *key)


def last_attempts(landed: DataFrame) -> DataFrame:
    """(search_id, kind, page_no, attempt, outcome, status, error): the last attempt at each page and feed."""
    place = F.struct(F.coalesce("attempt", F.lit(0)).alias("attempt"), "status", "error")
    last = landed.groupBy(*_KEY).agg(F.max_by(place, F.coalesce("attempt", F.lit(0))).alias("l"))
    return last.select(*_KEY, "l.*").withColumn("outcome", V.fetch_outcome("status"))


def landed_listings(landed: DataFrame, max_pages: int = 20, spec: X.CardSpec = X.PORTAL_SPEC,
                    feed_source: str = "rss", written: Written | None = None) -> tuple[DataFrame, DataFrame]:
    """(listings, source outcomes) of landed pages and feeds (``PAGE_SCHEMA`` and ``kind``).

    A page that failed ends its search's walk; a failed first page or feed fails the
    source.  Outcomes: (source, level, message, count), one per search and kind, as the
    run log has them; the count is that of the listings fetched.  ``written`` stores what is read more than
    once (cards, items, listings), so that a body is scanned once."""
    written = written or (lambda name, df: df)
    tried = last_attempts(landed)
    attempt = F.coalesce("attempt", F.lit(0)).alias("attempt")
    bodies = landed.select(*_KEY, attempt, "url", "body", V.fetch_outcome("status").alias("_outcome")).where("_outcome = 'ok'")
    keep = [*_KEY, "attempt"]
    cards = X.extract_cards(deal_out(bodies.where(F.col("kind") == PAGE).drop("_outcome"), *keep), spec, keep=keep)
    items = X.split_feed(deal_out(bodies.where(F.col("kind") == FEED).select(*keep, "body"), *keep), keep=keep)
    items = written("items", X.extract_feed_items(items, keep=[*keep, "pos"], source=feed_source))
    cards = written("cards", cards)
    counts = tried.where("outcome = 'ok'").select(*keep)
    cards = cards.join(counts, keep, "left_semi")
    walked = P.cut_page_walk(cards, tried.where(F.col("kind") == PAGE).select(
        "search_id", "page_no", (F.col("outcome") != "ok").alias("failed")), max_pages)
    listings = walked.unionByName(items.join(counts, keep, "left_semi"), allowMissingColumns=True).drop("attempt", "missing")
    listings = written("listings", listings.withColumn("features", F.array().cast("array<string>")))
    first = tried.where("page_no = 1")
    n = listings.groupBy("search_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    why = F.coalesce(F.col("error"), F.concat(F.lit("HTTP "), F.col("status").cast("string")), F.lit("no response"))
    ok = F.col("outcome") == "ok"
    # The messages that the run log counts sources by.
    outcomes = first.join(n, ["search_id", "kind"], "left").select(
        F.concat_ws(":", F.col("search_id").cast("string"), "kind").alias("source"),
        F.when(ok, "info").when(F.col("outcome") == "blocked", "warning").otherwise("error").alias("level"),
        F.when(ok, "ok").when(F.col("outcome") == "blocked", F.concat(F.lit("403_blocked: "), why))
        .otherwise(F.concat(F.lit("failed: "), why)).alias("message"),
        F.when(ok, F.coalesce("n", F.lit(0))).alias("count"))
    return listings, outcomes


def landed_details(pages: DataFrame, key: str = "listing_id", body: str = "body"):
    """A4 for the cycle: the details of the listings it asks for, read from landed detail pages.  Only the
    pages of those are parsed."""
    def details(wanted: DataFrame) -> DataFrame:
        asked = pages.select(key, body).join(wanted.select(key).distinct(), key, "left_semi")
        return X.extract_details(deal_out(asked, key), key=key, body=body)
    return details


def page_batch_writer(spark: SparkSession, searches: DataFrame, seen_path: str, results_path: str, outbox_path: str, now,
                      detail_pages: DataFrame | None = None, max_pages: int = 20, spec: X.CardSpec = X.PORTAL_SPEC,
                      feed_source: str = "rss", **options):
    """The ``foreachBatch`` function over landed pages and feeds; ``options`` as for ``cycle_batch_writer``."""
    details = landed_details(detail_pages) if detail_pages is not None else None
    return cycle_batch_writer(spark, searches, seen_path, results_path, outbox_path, PAGE_ORDER, now, details,
                              enrich_source=spec.source, prepare=lambda b, w: landed_listings(b, max_pages, spec, feed_source, w), **options)


def run_page_stream(spark: SparkSession, pages_dir: str, feeds_dir: str, searches: DataFrame, seen_path: str,
                    results_path: str, outbox_path: str, checkpoint: str, now, max_files_per_trigger: int | None = None,
                    available_now: bool = True, interval: str = "30 minutes", **options):
    """I1 over landed pages and feed bodies; returns the StreamingQuery.  A cycle is a micro-batch, so what a
    poll lands must be handed over together: ``max_files_per_trigger`` files of either folder."""
    pages = P.read_pages_stream(spark, pages_dir, max_files_per_trigger).withColumn("kind", F.lit(PAGE))
    feeds = P.read_pages_stream(spark, feeds_dir, max_files_per_trigger).withColumn("kind", F.lit(FEED))
    writer = pages.unionByName(feeds).writeStream.foreachBatch(
        page_batch_writer(spark, searches, seen_path, results_path, outbox_path, now, **options)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
