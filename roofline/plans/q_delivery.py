"""Registered queries: delivery and fetch attempts over the V adapter (A9, B17, E9,
F9, J8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery as V
from . import adapters as A
from .oracle_adapters import with_ctes
from .registry import register

ITEM = ["listing_id", "cycle"]
_CO = {"co": """
SELECT listing_id, cycle,
  bool_or(CASE WHEN channel = 'telegram' THEN coalesce(status < 400, false) END) AS telegram_ok,
  bool_or(CASE WHEN channel = 'email' THEN coalesce(status < 400, false) END) AS email_ok,
  bool_or(CASE WHEN channel = 'ha' THEN coalesce(status < 400, false) END) AS ha_ok
FROM attempts GROUP BY listing_id, cycle""",
       "ds": """
SELECT *, coalesce(telegram_ok, false) OR coalesce(email_ok, false) OR coalesce(ha_ok, false) AS any_sent,
          coalesce(NOT telegram_ok, false) OR coalesce(NOT email_ok, false) OR coalesce(NOT ha_ok, false) AS any_failed
FROM co""",
       "da": """
SELECT * FROM (
  SELECT *, coalesce(max(CASE WHEN any_sent OR n >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY listing_id ORDER BY cycle
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY cycle) AS n FROM ds) a) b
WHERE prior = 0"""}


def status(t):
    return V.delivery_status(V.channel_outcomes(A.delivery_attempts(t), ITEM))


def attempts(t):
    return V.delivery_attempts(status(t))


@register("fetch_outcome", sql=with_ctes("attempts") + """
SELECT listing_id, cycle, arg_max(CASE WHEN status IS NULL THEN 'retryable' WHEN status = 403 THEN 'blocked'
  WHEN status >= 500 AND status < 600 THEN 'retryable' WHEN status >= 400 THEN 'failed' ELSE 'ok' END, attempt) AS last_outcome,
  count(*) AS attempts
FROM attempts GROUP BY listing_id, cycle""")
def q_fetch_outcome(t):
    """Outcome class of the last attempt per (listing, cycle)."""
    a = A.delivery_attempts(t).withColumn("outcome", V.fetch_outcome("status"))
    return a.groupBy(*ITEM).agg(F.max_by("outcome", "attempt").alias("last_outcome"),
                                F.count(F.lit(1)).alias("attempts"))


@register("retry_queue", sql=with_ctes("attempts", extra={"last": """
SELECT listing_id, cycle, max(attempt) AS attempts, arg_max("at", attempt) AS at_, arg_max_null(status, attempt) AS st,
       arg_max_null(retry_after, attempt) AS ra
FROM attempts GROUP BY listing_id, cycle"""}) + """
SELECT listing_id, cycle, attempts, delay_s, at_ + to_microseconds(CAST(delay_s * 1000000 AS BIGINT)) AS next_attempt_at
FROM (SELECT *, CASE WHEN ra IS NOT NULL THEN greatest(0.0, CAST(ra AS DOUBLE)) ELSE pow(2.0, attempts) END AS delay_s
      FROM last WHERE st IS NULL OR st IN (429, 500, 502, 503, 504)) x""")
def q_retry_queue(t):
    """Next attempt time for items whose last attempt failed retryably."""
    return V.retry_queue(A.delivery_attempts(t), ITEM).withColumn("attempts", F.col("attempts").cast("bigint"))


@register("delivery_status", sql=with_ctes("attempts", extra=_CO) + """
SELECT listing_id, cycle, telegram_ok, email_ok, ha_ok, any_sent, any_failed FROM ds""")
def q_delivery_status(t):
    """Per listing and cycle, channel outcomes and their rollup."""
    return status(t)


@register("delivery_attempts", sql=with_ctes("attempts", extra=_CO) + """
SELECT listing_id, cycle, n, any_sent, any_sent OR n >= 5 AS settled, NOT any_sent AND n >= 5 AS gave_up FROM da""")
def q_delivery_attempts(t):
    """bounded retry over cycles (107 delivered, 43 given up at sf0.01)."""
    return attempts(t).select("listing_id", "cycle", F.col("n").cast("bigint").alias("n"), "any_sent",
                              "settled", "gave_up")


@register("commit_set", sql=with_ctes("attempts", extra=_CO) + """
SELECT listing_id, cycle, CASE WHEN any_sent THEN 'delivered' ELSE 'gave_up' END AS reason
FROM da WHERE any_sent OR n >= 5""")
def q_commit_set(t):
    """The listings each cycle persists as seen."""
    return V.commit_set(attempts(t))
