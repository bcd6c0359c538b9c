"""Run-log analytics.

Events are numbered and timed per run with window functions over ``run_id`` (a
run is one cycle, so a partition is one cycle's events); totals are one grouped
aggregation per run, never one action per figure.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bounded_text

log = logging.getLogger(__name__)

RUN_EVENT_SCHEMA = ("run_id string, seq bigint, phase string, level string, message string, "
                    "source string, count bigint, elapsed_ms bigint, at timestamp_ntz, event_id string")
RUN_SCHEMA = ("run_id string, started_at timestamp_ntz, finished_at timestamp_ntz, duration_ms bigint, "
              "status string, trigger string, sources_polled bigint, fetched bigint, filtered bigint, "
              "new bigint, notified bigint, errors bigint, error_summary string, host string, version string")
BACKLOG_SCHEMA = f"run struct<{RUN_SCHEMA}>, events array<struct<{RUN_EVENT_SCHEMA}>>"

FAILED_PREFIXES = ("failed:", "403_blocked:")
MAX_TEXT = 2000
# Backlog lines keep full microsecond timestamps.
JSON_OPTS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
             "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _ms(a, b) -> F.Column:
    """Milliseconds from timestamp ``a`` to ``b``."""
    return (F.unix_micros(F.to_timestamp(b)) - F.unix_micros(F.to_timestamp(a))).cast("bigint") / 1000


def number_events(events: DataFrame, order: list[str]) -> DataFrame:
    """F3 + F4: ``seq`` 1..n per run in ``order``, and ms since the run's first event, with one exchange by run."""
    run = Window.partitionBy("run_id")
    return events.withColumns({"seq": F.row_number().over(run.orderBy(*order)).cast("bigint"),
                               "elapsed_ms": _ms(F.min("at").over(run), F.col("at")).cast("bigint")})


def is_failed_source(message="message", phase="phase") -> F.Column:
    """A ``fetch_source`` event whose message says the source failed or was blocked.
    ``enrich failed:`` shares the phase but is not a failed source."""
    m = F.col(message)
    return (F.col(phase) == "fetch_source") & (m.startswith(FAILED_PREFIXES[0]) | m.startswith(FAILED_PREFIXES[1]))


def is_polled_source(message="message", phase="phase") -> F.Column:
    """The one event that each polled source leaves: ok, failed or blocked."""
    return is_failed_source(message, phase) | ((F.col(phase) == "fetch_source") & F.col(message).startswith("ok"))


def is_notified(message="message", phase="phase", level="level") -> F.Column:
    """An individually delivered listing: undelivered and given-up ones are warnings and errors, and
    those of the overflow summary say so."""
    return (F.col(phase) == "notify_item") & (F.col(level) == "info") & ~F.contains(F.col(message), F.lit("summary("))


def summarize_runs(events: DataFrame) -> DataFrame:
    """E4 + E6: run totals from numbered events (``seq`` required).

    polled = source outcomes; fetched = their counts; new = the count of the last dedup
    event (a cycle with reposts writes a second one); notified = delivered individual
    messages; errors = error-level events; crashed = a ``run_error`` event; failed
    sources in order, repeats kept, whole (``run_payload`` bounds what is stored)."""
    dedup = F.col("phase") == "dedup"
    failed = F.array_sort(F.collect_list(F.when(is_failed_source(), F.struct("seq", "source"))))
    totals = events.groupBy("run_id").agg(
        F.min("at").alias("started_at"), F.max("at").alias("finished_at"),
        F.count_if(is_polled_source()).alias("sources_polled"),
        F.coalesce(F.sum(F.when(F.col("phase") == "fetch_source", F.col("count"))), F.lit(0)).cast("bigint").alias("fetched"),
        F.coalesce(F.max_by(F.when(dedup, F.col("count")), F.when(dedup, F.col("seq"))), F.lit(0)).cast("bigint").alias("new"),
        F.count_if(is_notified()).alias("notified"),
        F.count_if(F.col("level") == "error").alias("errors"),
        F.coalesce(F.bool_or(F.col("phase") == "run_error"), F.lit(False)).alias("crashed"),
        F.first("host", ignorenulls=True).alias("host"), failed.alias("_failed"))
    summary = F.when(F.size("_failed") > 0, F.concat(F.lit("failed_sources="), F.array_join(F.col("_failed.source"), ",")))
    return totals.select(
        "run_id", "started_at", "finished_at",
        _ms(F.col("started_at"), F.col("finished_at")).cast("bigint").alias("duration_ms"),
        "sources_polled", "fetched", "new", "notified", "errors", "crashed",
        F.size("_failed").cast("bigint").alias("failed_sources"), summary.alias("error_summary"), "host")


def classify_run(failed_sources="failed_sources", errors="errors", polled="sources_polled",
                 crashed="crashed", explicit=None) -> F.Column:
    """E5: failed after a crash or when every polled source failed; success without failed
    sources and errors; partial otherwise; an explicit status wins."""
    f, e, p = F.col(failed_sources), F.col(errors), F.col(polled)
    status = (F.when(F.col(crashed), "failed").when((f == 0) & (e == 0), "success")
              .when((p > 0) & (f >= p), "failed").otherwise("partial"))
    return F.coalesce(F.col(explicit), status) if explicit else status


def run_records(events: DataFrame) -> DataFrame:
    """Run rows (E4-E6) with their status."""
    return summarize_runs(events).withColumn("status", classify_run())


def runs_over_time(runs: DataFrame, unit: str = "day") -> DataFrame:
    """Runs per time bucket and status, with sums of new and notified."""
    return (runs.groupBy(F.date_trunc(unit, "started_at").alias("bucket"), "status")
            .agg(F.count(F.lit(1)).alias("runs"), F.sum("new").cast("bigint").alias("new"),
                 F.sum("notified").cast("bigint").alias("notified")))


def runs_over_time_stream(events: DataFrame, unit: str = "1 day", delay: str = "1 hour", tie: str = "event_id") -> DataFrame:
    """E7 in event time, over a stream of run events (``at`` a timestamp): (bucket, status, runs, new, notified).

    The events of a run within a window are its totals there (E4, E5); the runs of a
    window are then counted by status, and the row is final: it comes out when the
    watermark, ``delay`` behind the latest event of the batches before, has passed the
    window's end.  An event counts until then, the batch that closes its window included;
    a later one is left out.  A run whose events lie in two windows counts in both.  State
    is the runs of the open windows."""
    dedup = F.col("phase") == "dedup"
    last = F.max_by(F.when(dedup, F.col("count")), F.when(dedup, F.struct("at", tie)))
    runs = events.withWatermark("at", delay).groupBy(F.window("at", unit).alias("_w"), "run_id").agg(
        F.count_if(is_polled_source()).alias("sources_polled"), F.count_if(is_failed_source()).alias("failed_sources"),
        F.count_if(F.col("level") == "error").alias("errors"),
        F.coalesce(F.bool_or(F.col("phase") == "run_error"), F.lit(False)).alias("crashed"),
        F.coalesce(last, F.lit(0)).cast("bigint").alias("new"), F.count_if(is_notified()).alias("notified"))
    runs = runs.select(F.window_time("_w").alias("_t"), classify_run().alias("status"), "new", "notified")
    return runs.groupBy(F.window("_t", unit).alias("_b"), "status").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("new").cast("bigint").alias("new"),
        F.sum("notified").cast("bigint").alias("notified")).select(F.col("_b.start").alias("bucket"), "status", "runs", "new", "notified")


def cycle_health(runs: DataFrame, unit: str = "day") -> DataFrame:
    """Duration percentiles (exact), mean and error maximum per bucket, from the counts of
    each duration, so that a bucket's buffer holds distinct durations only.

    Durations are whole milliseconds and the percentiles interpolate at multiples
    of 0.05, so rounding them to 3 decimals is exact; it removes last-bit
    differences of the interpolation arithmetic between engines."""
    each = runs.groupBy(F.date_trunc(unit, "started_at").alias("bucket"), "duration_ms").agg(
        F.count(F.lit(1)).alias("n"), F.max("errors").alias("errors"))
    return each.groupBy("bucket").agg(
        F.sum("n").alias("runs"), F.round(F.percentile("duration_ms", 0.5, F.col("n")), 3).alias("p50_ms"),
        F.round(F.percentile("duration_ms", 0.95, F.col("n")), 3).alias("p95_ms"),
        (F.sum(F.col("duration_ms") * F.when(F.col("duration_ms").isNotNull(), F.col("n")))
         / F.sum(F.when(F.col("duration_ms").isNotNull(), F.col("n")))).alias("avg_ms"),
        F.max("errors").alias("max_errors"))


def retention_split(runs: DataFrame, events: DataFrame, now, days: int):
    """(runs to prune, events to prune).  Runs by ``started_at``, events by ``at``,
    each against ``now - days``; days <= 0 disables pruning."""
    if days <= 0:
        return runs.limit(0), events.limit(0)
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
    return runs.filter(F.col("started_at") < cutoff), events.filter(F.col("at") < cutoff)


def retention_keep(runs: DataFrame, events: DataFrame, now, days: int):
    """What stays: runs newer than the cutoff and the events of those runs
    (events go with their run, so a run is never left without its events)."""
    if days <= 0:
        return runs, events
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))
    kept = runs.filter(F.col("started_at") >= cutoff)
    return kept, events.join(kept.select("run_id"), "run_id", "left_semi")


def merge_backlog(stored: DataFrame, backlog: DataFrame, key: str) -> DataFrame:
    """Replayed rows are inserted once: union, one row per key (stored wins)."""
    s = stored.withColumn("_src", F.lit(0))
    b = backlog.withColumn("_src", F.lit(1))
    u = s.unionByName(b)
    rest = [c for c in stored.columns if c != key]
    first = u.groupBy(key).agg(F.min_by(F.struct(*rest), F.col("_src")).alias("_r"))
    return first.select(key, *[F.col("_r." + c).alias(c) for c in rest])


def backlog_lines(runs: DataFrame, events: DataFrame) -> DataFrame:
    """J3 fallback: one JSON line per run with its events nested (the quarantine
    format), built with ``to_json``."""
    ev = events.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(
        "seq", "run_id", "phase", "level", "message", "source", "count", "elapsed_ms", "at",
        "event_id"))).alias("events"))
    j = runs.join(ev, "run_id", "left")
    run_cols = [c for c in runs.columns]
    return j.select(F.to_json(F.struct(F.struct(*run_cols).alias("run"), "events"), JSON_OPTS).alias("value"))


def read_run_backlog(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parse JSONL backlog lines (blank lines ignored) into runs and events."""
    parsed = (lines.filter(F.trim("value") != "")
              .select(F.from_json("value", BACKLOG_SCHEMA, JSON_OPTS).alias("b")))
    runs = parsed.select("b.run.*")
    events = parsed.select(F.explode("b.events").alias("e")).select("e.*")
    return runs, events


def run_payload(runs: DataFrame) -> DataFrame:
    """The run row as stored: error_summary bounded to 2000 characters."""
    return runs.withColumn("error_summary", bounded_text("error_summary", MAX_TEXT))


def event_payload(events: DataFrame) -> DataFrame:
    return events.withColumn("message", bounded_text("message", MAX_TEXT))


def run_drilldown(runs: DataFrame, events: DataFrame) -> DataFrame:
    """The events of the given runs, those of a run together and in ``seq`` order."""
    return (events.join(runs.select("run_id"), "run_id", "left_semi").repartition("run_id")
            .sortWithinPartitions("run_id", "seq"))


def read_run_backlog_files(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """A14 over JSONL files: one run with nested events per line."""
    return read_run_backlog(spark.read.text(path))


def write_runs(runs: DataFrame, events: DataFrame, primary: str, quarantine: str,
               batch_id: int | None = None) -> str:
    """Append runs and events to the primary tables; what cannot be written there goes to
    the quarantine folder as JSONL backlog lines.  Never raises: the run log is
    observational.  Returns ``primary``, ``quarantine`` or ``lost``.  Events go first, so a
    run row in the primary table has its events there.  With a ``batch_id`` each batch has
    a folder of its own, which a replay overwrites."""
    def put(df: DataFrame, name: str) -> None:
        if batch_id is None:
            df.write.mode("append").parquet(f"{primary}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{primary}/{name}/batch_id={batch_id}")
    try:
        put(events, "events")
        put(runs, "runs")
        return "primary"
    except Exception:  # noqa: BLE001
        try:
            out = quarantine if batch_id is None else f"{quarantine}/batch_id={batch_id}"
            backlog_lines(runs, events).write.mode("append" if batch_id is None else "overwrite").text(out)
            return "quarantine"
        except Exception:  # noqa: BLE001
            log.exception("run log of batch %s could not be written", batch_id)
            return "lost"
