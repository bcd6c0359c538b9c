"""Cross-cycle state from the run table.

The reference keeps the failure streak and the alerted flag in memory; here they
are derived from the run table with windows per host ordered by time, so they
survive restarts.  A host's runs are one per poll interval, so each partition
is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_APP = "roofline"


def _w(host: str, order: list[str]):
    return Window.partitionBy(host).orderBy(*order)


def failure_streak(runs: DataFrame, host: str = "host", order=("started_at", "run_id")) -> DataFrame:
    """F5 + F6: consecutive failed runs (reset by success or partial) and the
    finished_at of the last non-failed run so far."""
    order = list(order)
    w = _w(host, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failed = (F.col("status") == "failed").cast("int")
    island = F.sum(1 - failed).over(w)
    with_island = runs.withColumn("_failed", failed).withColumn("_island", island)
    wi = Window.partitionBy(host, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding,
                                                                          Window.currentRow)
    return (with_island
            .withColumn("consecutive_failures", F.sum("_failed").over(wi).cast("bigint"))
            .withColumn("last_success_at",
                        F.last(F.when(F.col("status") != "failed", F.col("finished_at")), ignorenulls=True).over(w))
            .drop("_failed", "_island"))


def alert_edges(streaks: DataFrame, threshold: int, host: str = "host",
                order=("started_at", "run_id")) -> DataFrame:
    """one ``alert`` when the streak first reaches the threshold, one
    ``recovery`` at the next non-failed run after an alert."""
    if threshold < 1:
        raise ValueError("threshold must be >= 1")
    prev = F.lag("consecutive_failures").over(_w(host, list(order)))
    s = F.col("consecutive_failures")
    edge = (F.when(s == threshold, F.lit("alert"))
            .when((s == 0) & (prev >= threshold), F.lit("recovery")))
    return streaks.withColumn("edge", edge).filter(F.col("edge").isNotNull())


def alert_texts(edges: DataFrame, app: str = DEFAULT_APP) -> DataFrame:
    """The alert outbox text of each edge."""
    # The outage and recovery message formats.
    outage = F.concat(F.lit(f"⚠️ {app}: "), F.col("consecutive_failures").cast("string"),
                      F.lit(" cycles failed in a row — check sources/logs."))
    recovery = F.lit(f"✅ {app}: recovered, cycles succeeding again.")
    return edges.withColumn("text", F.when(F.col("edge") == "alert", outage).otherwise(recovery))


def latest_heartbeat(runs: DataFrame, host: str = "host") -> DataFrame:
    """The newest run per host (``max_by`` aggregate, no sort)."""
    rest = [c for c in runs.columns if c != host]
    order = F.struct("finished_at", "run_id")
    return (runs.groupBy(host).agg(F.max_by(F.struct(*rest), order).alias("_r"))
            .select(host, *[F.col("_r." + c).alias(c) for c in rest]))


def health_verdict(heartbeats: DataFrame, now, stale_after_s: int, threshold: int) -> DataFrame:
    """Unhealthy when the streak reached the threshold or the last cycle is older
    than ``stale_after_s`` at ``now``; a host without a heartbeat is healthy."""
    now_ts = F.lit(now).cast("timestamp_ntz")
    age_s = (F.unix_micros(F.to_timestamp(now_ts)) - F.unix_micros(F.to_timestamp("finished_at"))) / 1e6
    stale = F.col("finished_at").isNotNull() & (age_s > stale_after_s)
    failing = F.coalesce(F.col("consecutive_failures"), F.lit(0)) >= threshold
    return heartbeats.withColumn("age_s", age_s).withColumn("healthy", ~(stale | failing))
