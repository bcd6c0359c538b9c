"""Registered queries: results table and availability over the A adapter (A15, C5,
D7, D8, E11, I8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results as R
from . import adapters as A
from .oracle_adapters import with_ctes
from .registry import register

NOW = "2024-01-08 00:00:00"
INTERVAL_DAYS = 3
_UPD = {"elig": """
SELECT * FROM results WHERE lower(coalesce(CAST(available AS VARCHAR), '')) NOT IN ('false', '0')
  AND source = 'kleinanzeigen' AND listing_id IS NOT NULL AND coalesce(url, '') <> ''""",
        "upd": f"""
SELECT e.listing_id,
  CASE WHEN NOT alive THEN false END AS available,
  CASE WHEN NOT alive THEN TIMESTAMP '{NOW}' END AS removed_at,
  TIMESTAMP '{NOW}' AS last_checked,
  CASE WHEN NOT alive AND (e.status IS NULL OR e.status IN ('', 'new')) THEN 'expired' END AS status
FROM elig e JOIN (SELECT listing_id, CASE WHEN http_status IN (404, 410) THEN false
                    WHEN http_status < 400 THEN NOT (
                      contains(lower(body), 'ist nicht mehr verfügbar') OR contains(lower(body), 'wurde gelöscht')
                      OR contains(lower(body), 'nicht mehr verfügbar') OR contains(lower(body), 'anzeige wurde nicht gefunden'))
                    END AS alive FROM fetches) f ON f.listing_id = e.listing_id
WHERE alive IS NOT NULL"""}


def eligible(t):
    return R.recheck_eligible(R.still_available(A.results_table(t)))


def updates(t):
    return R.availability_updates(eligible(t), A.recheck_fetches(t), NOW)


@register("still_available", sql=with_ctes("results") + """
SELECT listing_id FROM results WHERE lower(coalesce(CAST(available AS VARCHAR), '')) NOT IN ('false', '0')""")
def q_still_available(t):
    """Results not marked unavailable (null kept)."""
    return R.still_available(A.results_table(t)).select("listing_id")


@register("eligible_rows", sql=with_ctes("results", extra={"elig": _UPD["elig"]}) + "SELECT listing_id FROM elig")
def q_eligible_rows(t):
    """Available portal rows with id and URL."""
    return eligible(t).select("listing_id")


@register("recheck_due", sql=with_ctes("results") + f"""
SELECT listing_id FROM results
WHERE last_checked IS NULL OR date_diff('day', CAST(last_checked AS DATE), CAST(TIMESTAMP '{NOW}' AS DATE)) >= {INTERVAL_DAYS}""")
def q_recheck_due(t):
    """I8: never checked or checked 3+ days before now."""
    return R.recheck_due(A.results_table(t), NOW, INTERVAL_DAYS).select("listing_id")


@register("availability_updates", sql=with_ctes("results", "fetches", extra=_UPD) + """
SELECT listing_id, available, removed_at, last_checked, status FROM upd""")
def q_availability_updates(t):
    """Removed / alive verdicts as update rows; unknown gives none."""
    return updates(t)


@register("apply_updates", sql=with_ctes("results", "fetches", extra=_UPD) + """
SELECT r.listing_id, coalesce(u.status, r.status) AS status, coalesce(u.available, r.available) AS available,
       coalesce(u.last_checked, r.last_checked) AS last_checked, coalesce(u.removed_at, r.removed_at) AS removed_at
FROM results r LEFT JOIN upd u ON u.listing_id = r.listing_id""")
def q_apply_updates(t):
    """The next version of the results table."""
    new = R.apply_updates(A.results_table(t), updates(t))
    return new.select("listing_id", "status", "available", "last_checked", "removed_at")


@register("results_breakdown", sql=with_ctes("results") + """
SELECT search_type, status, count(*) AS results, CAST(GROUPING_ID(search_type, status) AS BIGINT) AS level
FROM results GROUP BY ROLLUP (search_type, status)""")
def q_results_breakdown(t):
    """Results by search_type x status with subtotals."""
    return R.results_breakdown(A.results_table(t)).withColumn("level", F.col("level").cast("bigint"))
