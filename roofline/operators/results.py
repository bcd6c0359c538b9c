"""Results table: rows, availability and lifecycle.

The results table is updated by versioned overwrite (plain Parquet has no MERGE):
``apply_updates`` returns the new version as a left join of the table to the
update rows; the caller writes it to a new path and never overwrites the path it
reads from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .enrich import DETAIL_KEYS

# Lifecycle statuses.
INITIAL_STATUS = "new"
EXPIRED_STATUS = "expired"
UNTOUCHED_STATUSES = ["", "new"]  # plus null
PORTAL_SOURCE = "kleinanzeigen"

# The columns of a results row.
RESULT_COLS = ["listing_id", "title", "url", "source", "search_type", "status", "price", "rooms", "sqm",
               "location", "description", *DETAIL_KEYS, "features", "available", "last_checked",
               "first_seen"]


def result_rows(listings: DataFrame, now) -> DataFrame:
    """The row written for each persisted listing: status ``new``, empty
    search_type as null, features joined by ``", "`` (empty as null), available,
    first_seen = last_checked = now."""
    now_ts = F.lit(now).cast("timestamp_ntz")
    def opt(c, t):
        return F.col(c) if c in listings.columns else F.lit(None).cast(t)
    feats = F.col("features") if "features" in listings.columns else F.array().cast("array<string>")
    return listings.select(
        "listing_id", "title", "url", "source",
        F.when(F.col("search_type") != "", F.col("search_type")).alias("search_type"),
        F.lit(INITIAL_STATUS).alias("status"),
        "price", "rooms", "sqm", "location", "description",
        *[opt(k, "double" if k in ("bedrooms", "bathrooms", "additional_costs", "warm_rent") else "string").alias(k)
          for k in DETAIL_KEYS],
        F.when(F.size(feats) > 0, F.array_join(feats, ", ")).alias("features"),
        F.lit(True).alias("available"),
        now_ts.alias("last_checked"), now_ts.alias("first_seen"))


def still_available(results: DataFrame) -> DataFrame:
    """Rows not marked unavailable; a null ``available`` is kept."""
    a = F.coalesce(F.lower(F.col("available").cast("string")), F.lit(""))
    return results.filter(~a.isin("false", "0"))


def recheck_eligible(results: DataFrame) -> DataFrame:
    """Only portal listings with an id and a URL are rechecked."""
    return results.filter((F.col("source") == PORTAL_SOURCE) & F.col("listing_id").isNotNull()
                          & (F.coalesce(F.col("url"), F.lit("")) != ""))


def recheck_due(results: DataFrame, now, interval_days: int) -> DataFrame:
    """I8: never checked, or checked at least ``interval_days`` days before ``now``."""
    now_ts = F.lit(now).cast("timestamp_ntz")
    age = F.datediff(now_ts, F.col("last_checked"))
    return results.filter(F.col("last_checked").isNull() | (age >= interval_days))


def availability_verdict(status, body) -> F.Column:
    """D7 verdict as a nullable boolean: false = removed (404/410, or a page below
    400 with a removal marker), true = alive, null = unknown (blocked or other error)."""
    from ..functions import is_removed_text
    s = F.col(status)
    return (F.when(s.isin(404, 410), F.lit(False))
            .when(s < 400, ~is_removed_text(body)))


def availability_updates(results: DataFrame, fetches: DataFrame, now) -> DataFrame:
    """Update rows for the rechecked results.  Removed: available false,
    removed_at, last_checked, and status ``expired`` only if untouched; alive:
    last_checked only; unknown: no row."""
    now_ts = F.lit(now).cast("timestamp_ntz")
    j = results.select("listing_id", F.col("status").alias("_status")).join(
        fetches.select("listing_id", availability_verdict("http_status", "body").alias("_alive")), "listing_id")
    j = j.filter(F.col("_alive").isNotNull())
    removed = ~F.col("_alive")
    untouched = F.col("_status").isNull() | F.col("_status").isin(*UNTOUCHED_STATUSES)
    return j.select(
        "listing_id",
        F.when(removed, F.lit(False)).alias("available"),
        F.when(removed, now_ts).alias("removed_at"),
        now_ts.alias("last_checked"),
        F.when(removed & untouched, F.lit(EXPIRED_STATUS)).alias("status"))


def apply_updates(table: DataFrame, updates: DataFrame, key: str = "listing_id") -> DataFrame:
    """Partial-column upsert: a column changes only where the update row sets
    it (non-null); other columns and rows without an update stay as they are."""
    upd_cols = [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias("_u_" + c) for c in upd_cols])
    j = table.join(u, key, "left")
    return j.select(*[F.coalesce(F.col("_u_" + c), F.col(c)).alias(c) if c in upd_cols else F.col(c)
                      for c in table.columns])


def results_breakdown(results: DataFrame) -> DataFrame:
    """Results by search_type x status with subtotals (rollup)."""
    return (results.rollup("search_type", "status")
            .agg(F.count(F.lit(1)).alias("results"), F.grouping_id().alias("level")))


def write_version(table: DataFrame, base: str, version: int) -> str:
    """D8 sink: write the next version of a table to its own folder (plain Parquet
    has no MERGE).  The caller reads version ``n`` and writes ``n + 1``, so a job
    never overwrites the path it reads from."""
    path = f"{base.rstrip('/')}/v={version}"
    table.write.mode("errorifexists").parquet(path)
    return path
