"""The poll cycle as a Structured Streaming query.

* I1: newly landed listing files are a file stream; every micro-batch runs the batch
  cycle (``plans.cycle.run_cycle``) inside ``foreachBatch``.  Every sink has a folder per
  batch id, which a replayed batch overwrites, and the commit mark comes last: a crash at
  any point and the replay after it leave each row once.  A failing batch leaves a
  ``failed`` run and is raised, so that the checkpoint hands it out again.
* I2: a run that starts with an empty seen table is a *prime*: it stores everything and
  notifies nothing.
* I3: ids and signatures live in a seen *table*, joined with ``left_anti``; it never
  expires, so it is not kept in a state store.  A ``SeenStore`` keeps it bucketed by key.
* I4: a listing is stored as seen once it is delivered, given up, or there is no channel;
  the retry counters of the others are a small table carried from batch to batch.
* I5: a large first load is split by ``maxFilesPerTrigger``; it stays a prime to its end,
  and signatures written by one batch hide reposts in the next.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import delivery as V
from ..operators import results as R
from ..operators import runlog as RL
from ..operators.seen_store import SeenStore
from ..plans.cycle import Cycle, Details, run_cycle

log = logging.getLogger(__name__)

SEEN_TABLE_SCHEMA = "key string, title string, url string, source string, batch_id bigint"
STATE_SCHEMA = "listing_id string, n bigint, settled boolean, batch_id bigint"
#: Sends the rows of an outbox; gives (listing_id, any_sent).
Deliver = Callable[[DataFrame, int], DataFrame]
#: Stores rows under a name, in the batch's folder, and gives them back as a table.
Written = Callable[[str, DataFrame], DataFrame]
#: Makes (listings, source outcomes) of a batch of landed rows, with ``Written`` for what it reads more than once.
Prepare = Callable[[DataFrame, Written], tuple[DataFrame, DataFrame]]


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of batch folders; empty only where the path is absent."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def stage_table(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    """A table between the stages of a batch, no sink: written to the batch's folder and read again."""
    at = f"{path}/batch_id={batch_id}"
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def outbox_rows(c: Cycle, order: list[str]) -> DataFrame:
    """The messages of a cycle: an ``item`` per individual listing and the ``summary`` of the overflow
    as one line per listing, with the columns that order it."""
    line = F.concat(F.lit("• "), F.col("title"), F.lit(" — "), F.col("url"))
    ord_ = F.struct(*order).alias("ord")
    items = c.individual.select(F.lit("item").alias("kind"), "listing_id", F.col("position").cast("bigint").alias("position"),
                                F.lit(None).cast("string").alias("line"), ord_)
    rest = c.overflow.select(F.lit("summary").alias("kind"), "listing_id", F.lit(None).cast("bigint").alias("position"),
                             line.alias("line"), ord_)
    return items.unionByName(rest)


def cycle_events(c: Cycle, status: DataFrame | None, run_id: str, now, outcomes: DataFrame | None = None) -> DataFrame:
    """The run events of a cycle: source outcomes, funnel counts and notifications, in order.  ``outcomes``
    (source, level, message, count) are those of the landing; without them every source with listings is ok."""
    at = F.lit(now).cast("timestamp_ntz")

    def event(df, rank, phase, message, level="info", source=None, count=None):
        col = lambda x, t: x if x is not None else F.lit(None).cast(t)
        return df.select(F.lit(run_id).alias("run_id"), F.lit(rank).alias("rank"), F.lit(phase).alias("phase"),
                         (level if not isinstance(level, str) else F.lit(level)).alias("level"),
                         (message if not isinstance(message, str) else F.lit(message)).alias("message"),
                         col(source, "string").alias("source"), col(count, "bigint").alias("count"), at.alias("at"))
    total = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    if outcomes is None:
        per_source = c.fetched.groupBy("search_id").agg(F.count(F.lit(1)).alias("n"))
        fetches = event(per_source, 1, "fetch_source", "ok", source=F.col("search_id").cast("string"), count=n)
    else:
        fetches = event(outcomes, 1, "fetch_source", F.col("message"), level=F.col("level"), source=F.col("source"), count=F.col("count"))
    out = (fetches
           .unionByName(event(total(c.filtered), 2, "filter", "candidates kept", count=n))
           .unionByName(event(total(c.new), 3, "dedup", F.concat(n.cast("string"), F.lit(" new")), count=n))
           .unionByName(event(total(c.kept), 4, "dedup", "after content dedup", count=n)))
    if status is not None:
        sent, over = F.col("any_sent"), F.col("kind") == "summary"
        note = F.concat(F.when(over, "summary(1)").otherwise("item"),
                        F.when(sent, "").when(F.col("settled"), "; gave up").otherwise("; undelivered"))
        level = F.when(sent, "info").when(F.col("settled"), "error").otherwise("warning")
        told = status.join(c.kept.select("listing_id", F.col("source").alias("_source")), "listing_id", "left")
        out = out.unionByName(event(told, 5, "notify_item", note, level=level, source=F.col("_source")))
    out = RL.number_events(out, ["rank", "source"]).withColumn(
        "event_id", F.concat_ws("-", "run_id", F.col("seq").cast("string")))
    return out.drop("rank")


def run_row(events: DataFrame, host: str, trigger: str, version: str) -> DataFrame:
    """The ``RUN_SCHEMA`` row of a cycle's events."""
    rec = RL.run_records(events.withColumn("host", F.lit(host)))
    kept = events.where("phase = 'filter'").select("run_id", F.col("count").alias("filtered"))
    return rec.join(kept, "run_id", "left").select(
        "run_id", "started_at", "finished_at", "duration_ms", "status", F.lit(trigger).alias("trigger"), "sources_polled",
        "fetched", F.coalesce("filtered", F.lit(0)).cast("bigint").alias("filtered"), "new", "notified", "errors",
        "error_summary", "host", F.lit(version).alias("version"))


def cycle_batch_writer(spark: SparkSession, searches: DataFrame, seen_path: str, results_path: str,
                       outbox_path: str, order: list[str], now, details: Details | None = None,
                       cap: int = V.DEFAULT_CAP, enrich_source: str | None = None, prime: bool | None = None,
                       runs_path: str | None = None, keep_going: bool = False, deliver: Deliver | None = None,
                       max_attempts: int = V.MAX_NOTIFY_ATTEMPTS, host: str = "stream", version: str = "",
                       prepare: Prepare | None = None, content_dedup: bool = True, store: SeenStore | None = None):
    """The ``foreachBatch`` function of I1.

    ``store``: keep the seen keys in a bucketed store, merged after each committed batch, in place of
    a folder per batch under ``seen_path`` (which still names the folders beside it).

    ``prepare`` makes listings and source outcomes of a batch of landed bodies and stores the listings and all
    else that it uses twice (``<seen_path>_listings``, ...); the outcomes and the details that are asked for are
    written too (``_outcomes``, ``_details``), so a body is scanned once, whatever the number of sinks; so are the
    listings that several sinks read (``_filtered``, ``_new``, ``_signed``, ``_flagged``), so a sink's plan begins there.
    ``deliver`` sends an outbox and tells what was sent; without it there is no channel
    and every listing is stored.  ``prime``: as said, or (None) whether the seen table is
    empty.  ``runs_path``: where each batch leaves its run and events.  ``keep_going``
    logs a failing batch without raising it: its files are then not read again."""
    attempts_path, commits = f"{seen_path.rstrip('/')}_attempts", f"{seen_path.rstrip('/')}_commits"

    def log_run(runs: DataFrame, events: DataFrame, batch_id: int) -> None:
        if runs_path is not None:
            RL.write_runs(RL.run_payload(runs), RL.event_payload(events), runs_path, f"{runs_path}_quarantine", batch_id)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        try:
            _process(batch, batch_id)
        except Exception as exc:
            log.exception("cycle batch %s failed", batch_id)
            crash = spark.createDataFrame([(f"batch-{batch_id}", 1, "run_error", "error", f"in run_cycle: {exc}"[:2000], None, None, 0)],
                                          "run_id string, seq bigint, phase string, level string, message string, "
                                          "source string, count bigint, elapsed_ms bigint")
            crash = crash.withColumns({"at": F.lit(now).cast("timestamp_ntz"), "event_id": F.col("run_id")})
            log_run(run_row(crash, host, "stream", version), crash, batch_id)
            if not keep_going:
                raise

    def carried_counters(batch_id: int) -> DataFrame:
        """The counters that the last committed batch left; a failed batch in between leaves none."""
        done = read_table(spark, commits, "done boolean, batch_id bigint").where(F.col("batch_id") < batch_id)
        last = done.agg(F.max("batch_id")).first()[0]
        return read_table(spark, attempts_path, STATE_SCHEMA).where(F.col("batch_id") == (-1 if last is None else last))

    def settle(outbox: DataFrame, batch_id: int) -> DataFrame:
        """(listing_id, kind, any_sent, n, settled) of this batch's messages (F9 over the carried counters)."""
        prior = carried_counters(batch_id)
        sent = deliver(outbox, batch_id).select("listing_id", "any_sent")
        j = outbox.select("listing_id", "kind").join(sent, "listing_id", "left").join(
            prior.select("listing_id", F.col("n").alias("_n")), "listing_id", "left")
        ok = F.coalesce("any_sent", F.lit(False))
        j = j.select("listing_id", "kind", ok.alias("any_sent"), (F.coalesce("_n", F.lit(0)) + 1).alias("n"))
        status = j.withColumn("settled", F.col("any_sent") | (F.col("n") >= max_attempts))
        # Counters of listings that this batch did not have are carried on.
        carried = prior.join(outbox, "listing_id", "left_anti").select("listing_id", "n", "settled")
        write_batch(status.where(~F.col("settled")).select("listing_id", "n", "settled").unionByName(carried),
                    attempts_path, batch_id)
        return status

    def _process(batch: DataFrame, batch_id: int) -> None:
        done = read_table(spark, commits, "done boolean, batch_id bigint")
        if not done.filter(F.col("batch_id") == batch_id).isEmpty():
            return  # a committed batch handed out again
        # A replayed batch does not see what its first run stored.
        if store is not None:
            seen = store.rows(before=batch_id)
        else:
            seen = read_table(spark, seen_path, SEEN_TABLE_SCHEMA).where(F.col("batch_id") != batch_id).drop("batch_id")
        is_prime = seen.isEmpty() if prime is None else prime
        outcomes, rich = None, details

        def written(name: str, df: DataFrame) -> DataFrame:
            return stage_table(df, f"{seen_path.rstrip('/')}_{name}", batch_id)
        if prepare is not None:
            batch, outcomes = prepare(batch, written)
            outcomes = written("outcomes", outcomes)
        if callable(details):
            rich = lambda wanted: written("details", details(wanted))
        c = run_cycle(batch, searches, seen, rich, order, now, cap=cap, prime=is_prime,
                      enrich_source=enrich_source, materialize=written, content_dedup=content_dedup)
        status, stored = None, c.kept
        if not is_prime:
            write_batch(outbox_rows(c, order), outbox_path, batch_id)
            if deliver is not None:
                outbox = spark.read.parquet(f"{outbox_path}/batch_id={batch_id}")
                write_batch(settle(outbox, batch_id), f"{outbox_path.rstrip('/')}_status", batch_id)
                status = spark.read.parquet(f"{outbox_path.rstrip('/')}_status/batch_id={batch_id}")
                stored = c.kept.join(status.where("settled"), "listing_id", "left_semi")
        elif deliver is not None:
            write_batch(carried_counters(batch_id).drop("batch_id"), attempts_path, batch_id)
        write_batch(R.result_rows(stored, now), results_path, batch_id)
        additions = D.seen_rows(stored, c.dropped)
        if store is not None:
            store.append(additions, batch_id, replace=True)
        else:
            write_batch(D.seen_append(seen, additions), seen_path, batch_id)
        if runs_path is not None:
            events = cycle_events(c, status, f"batch-{batch_id}", now, outcomes).persist()
            log_run(run_row(events, host, "stream", version), events, batch_id)
            events.unpersist()
        # The commit mark: all sinks of the batch are complete.
        write_batch(spark.createDataFrame([(True,)], "done boolean"), commits, batch_id)
        if store is not None:
            store.compact()

    return on_batch


def run_stream(spark: SparkSession, source_dir: str, schema: str, searches: DataFrame, seen_path: str,
               results_path: str, outbox_path: str, checkpoint: str, order: list[str], now,
               details: Details | None = None, max_files_per_trigger: int | None = None,
               available_now: bool = True, interval: str = "30 minutes", cap: int = V.DEFAULT_CAP,
               prime: bool | None = None, **writer_options):
    """Start the cycle stream; returns the StreamingQuery.

    ``prime`` None: an ``available_now`` run that starts with an empty seen table is the
    initial load and stays silent through all its batches; a continuous stream is silent
    for the batches that find the table empty."""
    if prime is None and available_now:
        store = writer_options.get("store")
        prime = (store.rows() if store is not None else read_table(spark, seen_path, SEEN_TABLE_SCHEMA)).isEmpty()
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    writer = stream.writeStream.foreachBatch(cycle_batch_writer(
        spark, searches, seen_path, results_path, outbox_path, order, now, details, cap, prime=prime, **writer_options)) \
        .option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def stream_dedup(stream: DataFrame, key: str = "listing_id") -> DataFrame:
    """I3, id-only variant: first occurrence of each id across the whole stream
    (state grows with the ids; the table form above is the default)."""
    return stream.dropDuplicates([key])


def attempts_batch_writer(spark: SparkSession, out_path: str, max_attempts: int = V.MAX_NOTIFY_ATTEMPTS):
    """I4: F9 across micro-batches of (listing_id, cycle, any_sent): the counters are a table per batch,
    merged with the batch by key; rows of a settled listing are ignored."""
    state_path = f"{out_path.rstrip('/')}_state"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        prior = read_table(spark, state_path, STATE_SCHEMA).where(F.col("batch_id") == batch_id - 1).drop("batch_id")
        write_batch(V.delivery_attempts(batch, max_attempts=max_attempts, prior=prior), out_path, batch_id)
        new = spark.read.parquet(f"{out_path}/batch_id={batch_id}").groupBy("listing_id").agg(
            F.max("n").alias("n"), F.bool_or("settled").alias("settled"))
        write_batch(new.unionByName(prior.join(new, "listing_id", "left_anti")), state_path, batch_id)
    return on_batch


def stream_attempts(status_stream: DataFrame, out_path: str, checkpoint: str,
                    max_attempts: int = V.MAX_NOTIFY_ATTEMPTS):
    """I4: run the retry counters over a stream of delivery statuses to its present end."""
    writer = attempts_batch_writer(status_stream.sparkSession, out_path, max_attempts)
    return (status_stream.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
