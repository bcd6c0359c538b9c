"""Registered queries: run log and health (A14, C6, D9, E4-E8, F3-F7, G2, I6, I7, I9,
J3, J10) over the R adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health as H
from ..operators import runlog as R
from . import adapters as A
from ._common import scratch
from .oracle_adapters import with_ctes
from .registry import register

NOW = "2024-01-31 00:00:00"
RETENTION_DAYS = 10
THRESHOLD = 3
STALE_AFTER_S = 2 * 86400
EVENT_ORDER = ["at", "event_no"]

_EV = {"ev": """
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY "at", event_no) AS seq,
       (epoch_us("at") - epoch_us(min("at") OVER (PARTITION BY run_id))) // 1000 AS elapsed_ms
FROM run_events""",
       "agg": """
SELECT run_id, min("at") AS started_at, max("at") AS finished_at,
       (epoch_us(max("at")) - epoch_us(min("at"))) // 1000 AS duration_ms,
       count(*) FILTER (WHERE phase = 'fetch_source' AND regexp_matches(message, '^(ok|failed:|403_blocked:)')) AS sources_polled,
       CAST(coalesce(sum(count) FILTER (WHERE phase = 'fetch_source'), 0) AS BIGINT) AS fetched,
       CAST(coalesce(last(count ORDER BY seq) FILTER (WHERE phase = 'dedup'), 0) AS BIGINT) AS new,
       count(*) FILTER (WHERE phase = 'notify_item' AND level = 'info' AND message NOT LIKE '%summary(%') AS notified,
       count(*) FILTER (WHERE phase = 'run_error') > 0 AS crashed,
       count(*) FILTER (WHERE level = 'error') AS errors,
       count(*) FILTER (WHERE phase = 'fetch_source' AND (starts_with(message, 'failed:') OR starts_with(message, '403_blocked:'))) AS failed_sources,
       string_agg(source, ',' ORDER BY seq) FILTER (WHERE phase = 'fetch_source' AND (starts_with(message, 'failed:') OR starts_with(message, '403_blocked:'))) AS fs,
       any_value(host) AS host
FROM ev GROUP BY run_id""",
       "runs": """
SELECT run_id, started_at, finished_at, duration_ms, sources_polled, fetched, new, notified, errors, crashed,
       failed_sources, CASE WHEN failed_sources > 0 THEN 'failed_sources=' || fs END AS error_summary, host,
       CASE WHEN crashed THEN 'failed' WHEN failed_sources = 0 AND errors = 0 THEN 'success'
            WHEN sources_polled > 0 AND failed_sources >= sources_polled THEN 'failed' ELSE 'partial' END AS status
FROM agg""",
       "streaks": """
SELECT *, CAST(sum(is_failed) OVER (PARTITION BY host, island ORDER BY started_at, run_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS consecutive_failures
FROM (SELECT *, sum(1 - is_failed) OVER (PARTITION BY host ORDER BY started_at, run_id
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
      FROM (SELECT *, CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS is_failed FROM runs) a) b""",
       "streaks2": """
SELECT *, last_value(CASE WHEN status <> 'failed' THEN finished_at END IGNORE NULLS)
            OVER (PARTITION BY host ORDER BY started_at, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_success_at
FROM streaks""",
       "edges": f"""
SELECT * FROM (SELECT *, CASE WHEN consecutive_failures = {THRESHOLD} THEN 'alert'
                         WHEN consecutive_failures = 0 AND lag(consecutive_failures) OVER (PARTITION BY host ORDER BY started_at, run_id) >= {THRESHOLD}
                         THEN 'recovery' END AS edge FROM streaks) x WHERE edge IS NOT NULL"""}


def events(t):
    return t.memo("events", lambda: R.number_events(A.run_events(t), EVENT_ORDER))


def runs(t):
    return t.memo("runs", lambda: R.run_records(events(t)))


def streaks(t):
    return t.memo("streaks", lambda: H.failure_streak(runs(t)))


@register("event_seq", sql=with_ctes("run_events", extra=_EV) + "SELECT run_id, event_id, seq FROM ev")
def q_event_seq(t):
    """events numbered 1..n per run by (time, event id)."""
    return events(t).select("run_id", "event_id", "seq")


@register("event_elapsed", sql=with_ctes("run_events", extra=_EV) + "SELECT run_id, event_id, elapsed_ms FROM ev")
def q_event_elapsed(t):
    """milliseconds since the run's first event."""
    return events(t).select("run_id", "event_id", "elapsed_ms")


@register("run_totals", sql=with_ctes("run_events", extra=_EV) + """
SELECT run_id, started_at, finished_at, duration_ms, sources_polled, fetched, new, notified, errors, crashed, failed_sources,
       error_summary, host FROM runs""")
def q_run_totals(t):
    """E4 + E6: totals, failed-source summary and duration per run."""
    return R.summarize_runs(events(t))


@register("run_status", sql=with_ctes("run_events", extra=_EV) + """
SELECT status, count(*) AS runs FROM runs GROUP BY status""")
def q_run_status(t):
    """E5: runs per status."""
    return runs(t).groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


@register("runs_over_time", sql=with_ctes("run_events", extra=_EV) + """
SELECT CAST(date_trunc('day', started_at) AS TIMESTAMP) AS bucket, status, count(*) AS runs,
       CAST(sum(new) AS BIGINT) AS new, CAST(sum(notified) AS BIGINT) AS notified
FROM runs GROUP BY 1, 2""")
def q_runs_over_time(t):
    """Runs by day and status."""
    return R.runs_over_time(runs(t)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register("cycle_health", sql=with_ctes("run_events", extra=_EV) + """
SELECT CAST(date_trunc('day', started_at) AS TIMESTAMP) AS bucket, count(*) AS runs,
       round(quantile_cont(duration_ms, 0.5), 3) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 3) AS p95_ms,
       avg(duration_ms) AS avg_ms, max(errors) AS max_errors
FROM runs GROUP BY 1""")
def q_cycle_health(t):
    """Duration percentiles and error maximum per day."""
    return R.cycle_health(runs(t)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register("failure_streak", sql=with_ctes("run_events", extra=_EV) + """
SELECT host, run_id, status, consecutive_failures FROM streaks""")
def q_failure_streak(t):
    """consecutive failed runs per host."""
    return streaks(t).select("host", "run_id", "status", "consecutive_failures")


@register("last_success", sql=with_ctes("run_events", extra=_EV) + """
SELECT host, run_id, last_success_at FROM streaks2""")
def q_last_success(t):
    """finished_at of the last non-failed run so far, per host."""
    return streaks(t).select("host", "run_id", "last_success_at")


@register("alert_edges", sql=with_ctes("run_events", extra=_EV) + """
SELECT host, run_id, edge, consecutive_failures FROM edges""")
def q_alert_edges(t):
    """outage alerts at streak = 3 and recoveries after them."""
    return H.alert_edges(streaks(t), THRESHOLD).select("host", "run_id", "edge", "consecutive_failures")


@register("outbox_alerts", sql=with_ctes("run_events", extra=_EV) + f"""
SELECT host, run_id, CASE WHEN edge = 'alert'
  THEN '⚠️ {H.DEFAULT_APP}: ' || CAST(consecutive_failures AS VARCHAR) || ' cycles failed in a row — check sources/logs.'
  ELSE '✅ {H.DEFAULT_APP}: recovered, cycles succeeding again.' END AS text FROM edges""")
def q_outbox_alerts(t):
    """One alert text row per edge."""
    return H.alert_texts(H.alert_edges(streaks(t), THRESHOLD)).select("host", "run_id", "text")


@register("latest_heartbeat", sql=with_ctes("run_events", extra=_EV) + """
SELECT host, arg_max(run_id, (finished_at, run_id)) AS run_id, arg_max(status, (finished_at, run_id)) AS status,
       max(finished_at) AS finished_at FROM runs GROUP BY host""")
def q_latest_heartbeat(t):
    """The newest run per host."""
    return H.latest_heartbeat(runs(t)).select("host", "run_id", "status", "finished_at")


@register("health_verdict", sql=with_ctes("run_events", extra=_EV) + f"""
SELECT host, run_id, consecutive_failures,
       (epoch_us(TIMESTAMP '{NOW}') - epoch_us(finished_at)) / 1e6 AS age_s,
       NOT ((epoch_us(TIMESTAMP '{NOW}') - epoch_us(finished_at)) / 1e6 > {STALE_AFTER_S}
            OR consecutive_failures >= {THRESHOLD}) AS healthy
FROM (SELECT host, arg_max(run_id, (finished_at, run_id)) AS run_id,
             arg_max(consecutive_failures, (finished_at, run_id)) AS consecutive_failures,
             max(finished_at) AS finished_at FROM streaks GROUP BY host) h""")
def q_health_verdict(t):
    """Health per host at a fixed ``now``: streak and staleness."""
    hb = H.latest_heartbeat(streaks(t))
    return H.health_verdict(hb, NOW, STALE_AFTER_S, THRESHOLD).select(
        "host", "run_id", "consecutive_failures", "age_s", "healthy")


@register("retention_split", sql=with_ctes("run_events", extra=_EV) + f"""
SELECT 'run' AS kind, run_id AS id FROM runs WHERE started_at < TIMESTAMP '{NOW}' - INTERVAL {RETENTION_DAYS} DAY
UNION ALL SELECT 'event', event_id FROM ev WHERE "at" < TIMESTAMP '{NOW}' - INTERVAL {RETENTION_DAYS} DAY""")
def q_retention_split(t):
    """Runs and events older than the retention window, each by its own time."""
    r, e = R.retention_split(runs(t), events(t), NOW, RETENTION_DAYS)
    return (r.select(F.lit("run").alias("kind"), F.col("run_id").alias("id"))
            .unionByName(e.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"))))


@register("retention_keep", sql=with_ctes("run_events", extra=_EV) + f"""
SELECT 'run' AS kind, run_id AS id FROM runs WHERE started_at >= TIMESTAMP '{NOW}' - INTERVAL {RETENTION_DAYS} DAY
UNION ALL SELECT 'event', event_id FROM ev
WHERE run_id IN (SELECT run_id FROM runs WHERE started_at >= TIMESTAMP '{NOW}' - INTERVAL {RETENTION_DAYS} DAY)""")
def q_retention_keep(t):
    """What survives pruning; events stay with their run."""
    r, e = R.retention_keep(runs(t), events(t), NOW, RETENTION_DAYS)
    return (r.select(F.lit("run").alias("kind"), F.col("run_id").alias("id"))
            .unionByName(e.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"))))


@register("merge_backlog", sql=with_ctes("run_events", extra=_EV) + """
SELECT 'run' AS kind, run_id AS id, status AS what FROM runs UNION ALL SELECT 'event', event_id, phase FROM ev""")
def q_merge_backlog(t):
    """Runs and events before Jan 20 plus a backlog from Jan 15 replayed: each once."""
    def merged(df, when, key):
        stored = df.filter(F.col(when) < F.lit("2024-01-20").cast("timestamp_ntz"))
        backlog = df.filter(F.col(when) >= F.lit("2024-01-15").cast("timestamp_ntz"))
        return R.merge_backlog(stored, backlog, key)
    r = merged(runs(t).select("run_id", "status", "started_at"), "started_at", "run_id")
    e = merged(events(t).select("event_id", "phase", "at"), "at", "event_id")
    return (r.select(F.lit("run").alias("kind"), F.col("run_id").alias("id"), F.col("status").alias("what"))
            .unionByName(e.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("phase").alias("what"))))


@register("backlog_explode", sql=with_ctes("run_events", extra=_EV) + """
SELECT e.run_id, e.seq, e.phase, e.level, e.message, e."at", r.status
FROM ev e JOIN runs r ON e.run_id = r.run_id""")
def q_backlog_explode(t):
    """Runs written as JSONL backlog lines (J3 fallback format) and read back."""
    r = runs(t).select("run_id", "started_at", "finished_at", "duration_ms", "status", "sources_polled",
                       "fetched", "new", "notified", "errors", "error_summary", "host")
    lines = R.backlog_lines(r, events(t))
    br, be = R.read_run_backlog(lines)
    return be.join(br.select("run_id", "status"), "run_id").select(
        "run_id", "seq", "phase", "level", "message", "at", "status")


@register("run_drilldown", sql=with_ctes("run_events", extra=_EV) + """
SELECT e.run_id, e.seq, e.phase, e.level, e.message FROM ev e
WHERE e.run_id IN (SELECT run_id FROM runs WHERE status = 'failed')""")
def q_run_drilldown(t):
    """The events of every failed run, in order."""
    r = runs(t).filter(F.col("status") == "failed")
    return R.run_drilldown(r, events(t)).select("run_id", "seq", "phase", "level", "message")


@register("run_payload", sql=with_ctes("run_events", extra=_EV) + """
SELECT run_id, status, substr(error_summary, 1, 2000) AS error_summary, n_events
FROM runs JOIN (SELECT run_id, count(*) AS n_events FROM ev GROUP BY run_id) e USING (run_id)""")
def q_run_payload(t):
    """Runs and events written through the sink and read back."""
    base = scratch(t, "run_payload")
    where = R.write_runs(R.run_payload(runs(t)), R.event_payload(events(t)), f"{base}/log", f"{base}/quarantine")
    if where != "primary":
        raise RuntimeError(f"run log went to {where}")
    n = t.spark.read.parquet(f"{base}/log/events").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_events"))
    return t.spark.read.parquet(f"{base}/log/runs").join(n, "run_id").select("run_id", "status", "error_summary", "n_events")
