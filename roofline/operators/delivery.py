"""Delivery: fetch/send outcomes, retries, caps and outboxes (A9, B17, E9, F8, F9,
G1, J4-J8).

Sending is outside Spark; these operators prepare *outbox* rows (one per message
and channel) and derive the delivery state from the table of attempts.  The
notify cap is a per-batch top-k (``orderBy(...).limit(cap)`` plans as a
distributed TakeOrderedAndProject) plus an anti join for the overflow, never a
window without a partition key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import format_attrs, html_escape, retry_delay_seconds

MAX_NOTIFY_ATTEMPTS = 5
DEFAULT_CAP = 15
# Statuses a sender retries (null = timeout / connection error).
RETRYABLE_STATUS = [429, 500, 502, 503, 504]
CHANNELS = ["telegram", "email", "ha"]


def fetch_outcome(status="status") -> F.Column:
    """403 blocked (never retried); 5xx or no response retryable; other >= 400
    failed, including 429; else ok."""
    s = F.col(status)
    return (F.when(s.isNull(), "retryable").when(s == 403, "blocked")
            .when((s >= 500) & (s < 600), "retryable").when(s >= 400, "failed").otherwise("ok"))


def is_retryable_send(status="status") -> F.Column:
    s = F.col(status)
    return s.isNull() | s.isin(*RETRYABLE_STATUS)


def retry_queue(attempts: DataFrame, item: list[str], order: str = "attempt") -> DataFrame:
    """For items whose last attempt failed retryably, when to try again:
    ``Retry-After`` seconds if numeric (floored at 0), else 2^(attempt+1) with the
    0-based attempt number."""
    last = attempts.groupBy(*item).agg(F.max_by(F.struct("at", order, "status", "retry_after"),
                                                F.col(order)).alias("_l")).select(*item, "_l.*")
    due = last.filter(is_retryable_send("status"))
    delay = retry_delay_seconds(F.col(order) - 1, "retry_after")
    return due.select(*item, F.col(order).alias("attempts"), delay.alias("delay_s"),
                      (F.col("at") + F.make_interval(secs=delay)).alias("next_attempt_at"))


def channel_outcomes(attempts: DataFrame, item: list[str]) -> DataFrame:
    """Per item, one nullable boolean per channel: true if any attempt on it
    succeeded (a status below 400), false if all failed, null when the channel was not used."""
    ok = F.col("status") < 400
    return attempts.groupBy(*item).agg(*[
        F.bool_or(F.when(F.col("channel") == ch, F.coalesce(ok, F.lit(False)))).alias(f"{ch}_ok")
        for ch in CHANNELS])


def delivery_status(outcomes: DataFrame) -> DataFrame:
    """any_sent = some channel true; any_failed = some channel false."""
    flags = [F.col(f"{ch}_ok") for ch in CHANNELS]
    any_sent = F.lit(False)
    any_failed = F.lit(False)
    for f in flags:
        any_sent = any_sent | F.coalesce(f, F.lit(False))
        any_failed = any_failed | F.coalesce(~f, F.lit(False))
    return outcomes.withColumn("any_sent", any_sent).withColumn("any_failed", any_failed)


def delivery_attempts(status: DataFrame, key: str = "listing_id", cycle: str = "cycle",
                      max_attempts: int = MAX_NOTIFY_ATTEMPTS, prior: DataFrame | None = None) -> DataFrame:
    """attempts per listing over cycles; rows up to the first of (delivered,
    attempt ``max_attempts``).  ``settled`` marks the last kept row: delivered or
    given up; a settled listing is persisted as seen and never retried.  ``prior``
    (key, n, settled) continues counts from before."""
    w = Window.partitionBy(key).orderBy(cycle)
    # Only the first ``max_attempts`` cycles of a listing can be kept; filtering on
    # the row number lets Spark cut each key to that many rows map-side
    # (WindowGroupLimit), so a hot listing never reaches one task whole.
    x = status.withColumn("n", F.row_number().over(w).cast("bigint")).filter(F.col("n") <= max_attempts)
    if prior is not None:
        before = prior.select(key, F.col("n").alias("_n"), F.col("settled").alias("_s"))
        x = (x.join(before, key, "left").filter(~F.coalesce("_s", F.lit(False)))
             .withColumn("n", F.col("n") + F.coalesce("_n", F.lit(0))).filter(F.col("n") <= max_attempts).drop("_n", "_s"))
    x = x.withColumn("_done", (F.col("any_sent") | (F.col("n") >= max_attempts)).cast("int"))
    x = x.withColumn("_prior", F.coalesce(F.max("_done").over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_done")
    kept = x.filter(F.col("_prior") == 0).drop("_prior")
    return (kept.withColumn("settled", F.col("any_sent") | (F.col("n") >= max_attempts))
            .withColumn("gave_up", ~F.col("any_sent") & (F.col("n") >= max_attempts)))


def commit_set(attempts: DataFrame, key: str = "listing_id", channels: bool = True) -> DataFrame:
    """What a cycle persists: delivered or given up, and without any channel
    everything; undelivered listings below the limit stay unseen."""
    if not channels:
        return attempts.select(key, "cycle", F.lit("no_channel").alias("reason"))
    s = attempts.filter(F.col("settled"))
    return s.select(key, "cycle", F.when(F.col("any_sent"), "delivered").otherwise("gave_up").alias("reason"))


def notify_cap(new: DataFrame, order: list[str], cap: int = DEFAULT_CAP):
    """F8/G1: (individual, overflow): the first ``cap`` new listings in order get an
    individual message with their position; the rest go to one summary."""
    top = new.orderBy(*order).limit(cap)
    pos = F.row_number().over(Window.orderBy(*order))  # over at most ``cap`` rows
    individual = top.withColumn("position", pos)
    key = "listing_id"
    overflow = new.join(top.select(key), key, "left_anti")
    return individual, overflow


def summary_lines(overflow: DataFrame, order: list[str]) -> DataFrame:
    """The overflow summary as ordered lines: a header with the count, then one
    bullet per listing (ordered by the fetch-order columns).  Lines, not one string,
    so the overflow is never gathered into a single row."""
    header = overflow.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 0).select(
        F.lit(0).alias("line_no"),
        # Fixed value: the summary header format.
        F.concat(F.lit("➕ "), F.col("n").cast("string"), F.lit(" weitere neue Inserate:")).alias("line"))
    bullets = overflow.select(F.lit(1).alias("line_no"),
                              F.concat(F.lit("• "), html_escape("title"), F.lit(" — "), html_escape("url")).alias("line"),
                              *order)
    return header.unionByName(bullets, allowMissingColumns=True)


def outbox_chat(listings: DataFrame) -> DataFrame:
    """HTML caption; a photo message when a thumbnail is present."""
    attrs = format_attrs("price", "rooms", "sqm", "location")
    caption = F.concat(F.lit("<b>"), html_escape("title"), F.lit("</b>\n"), html_escape(attrs), F.lit("\n"),
                       F.lit('<a href="'), html_escape("url"), F.lit('">'), html_escape("url"), F.lit("</a>"))
    has_thumb = F.coalesce(F.col("thumbnail"), F.lit("")) != ""
    return listings.select("listing_id", F.when(has_thumb, "photo").otherwise("message").alias("kind"),
                           F.when(has_thumb, F.col("thumbnail")).alias("photo"), caption.alias("text"))


def outbox_mail(listings: DataFrame, app: str = "roofline") -> DataFrame:
    """Subject, plain text and HTML body of the mail."""
    attrs = format_attrs("price", "rooms", "sqm", "location")
    has_thumb = F.coalesce(F.col("thumbnail"), F.lit("")) != ""
    img = F.when(has_thumb, F.concat(F.lit('<img src="'), html_escape("thumbnail"), F.lit('" alt=""><br>'))) \
        .otherwise(F.lit(""))
    html = F.concat(F.lit("<html><body><h3>"), html_escape("title"), F.lit("</h3><p>"), html_escape(attrs),
                    F.lit("</p>"), img, F.lit('<p><a href="'), html_escape("url"), F.lit('">'), html_escape("url"),
                    F.lit("</a></p></body></html>"))
    return listings.select("listing_id",
                           F.concat(F.lit(f"[{app}] "), F.col("title")).alias("subject"),
                           F.concat_ws("\n", "title", attrs, "url").alias("plain"), html.alias("html"))


def outbox_webhook(listings: DataFrame) -> DataFrame:
    """The webhook JSON body, nulls kept."""
    body = F.struct("listing_id", "title", "url", "price", "rooms", "sqm", "location", "source")
    return listings.select("listing_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))
