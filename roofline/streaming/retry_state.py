"""Delivery retries as keyed state with event-time timers.

``retry_state`` takes a stream of single send attempts in any order within the watermark's delay.  The
state of a listing is its open cycles (one merged row each), its counter, and the retries that are not
due yet.  One timer drives it, set to what comes first: a cycle is counted when the watermark passes its
end, a retry is handed out when the watermark has passed both that end and its ``next_attempt_at``, and the
mark of a settled listing goes after its time, so what stays is bounded by the listings still open.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import retry_delay_seconds
from ..operators import delivery as V

_MERGED = ("listing_id string, cycle bigint, end_us bigint, attempt bigint, sent boolean, retryable boolean, "
           "delay_s double, next_us bigint")
_OUT = ("listing_id string, cycle bigint, kind string, n bigint, any_sent boolean, settled boolean, gave_up boolean, "
        "attempts bigint, delay_s double, next_us bigint")
#: The state of a listing is one value, read and written once a call: a call of the state store is a round trip.
_LISTING = ("n bigint, settled_ms bigint, timer_ms bigint, "
            "open array<struct<cycle bigint, end_ms bigint, attempt bigint, sent boolean, retryable boolean, "
            "delay_s double, next_us bigint>>, "
            "due array<struct<cycle bigint, n bigint, attempt bigint, delay_s double, next_us bigint>>")
#: Timer-driven state lives in RocksDB; its memory is one pool per executor, however many partitions there are.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def state_conf(spark: SparkSession) -> Iterator[None]:
    """``STATE_CONF`` while a query is started: a query keeps the settings that it started with."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per listing and cycle of a batch: sent by any attempt, and the last attempt.  A listing with
    very many attempts is merged before it is shuffled."""
    key = ["listing_id", "cycle"]
    for x in batches:
        x = x.sort_values(["attempt", "retryable", "next_us"], kind="stable")
        x["sent"] = x.groupby(key, sort=False)["sent"].transform("max")
        yield x.drop_duplicates(key, keep="last")


class RetryProcessor(StatefulProcessor):
    """The state of one listing; see the module's docstring."""

    def __init__(self, max_attempts: int, settled_for_ms: int):
        self.max_attempts, self.settled_for_ms = max_attempts, settled_for_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.listing = handle.getValueState("listing", _LISTING)

    def _load(self) -> tuple[int, int, int, dict, dict]:
        """(counter, end of the settled cycle or -1, timer or -1, open cycles, retries that are not due yet)."""
        state = self.listing.get()
        if state is None:
            return 0, -1, -1, {}, {}
        n, settled_ms, timer_ms, opened, due = state
        return n, settled_ms, timer_ms, {x[0]: tuple(x[1:]) for x in opened}, {x[0]: tuple(x[1:]) for x in due}

    def _store(self, now: int, n: int, settled_ms: int, timer_ms: int, opened: dict, due: dict) -> None:
        """Write the state back with a timer at the first thing that comes after ``now``; an empty one goes."""
        at = [v[0] for v in opened.values()] + [-(-v[3] // 1000) for v in due.values()]
        if settled_ms >= 0:
            at.append(settled_ms + self.settled_for_ms)
        first = min(at, default=-1)
        if first != timer_ms:
            if timer_ms > now:
                self.handle.deleteTimer(timer_ms)
            if first >= 0:
                self.handle.registerTimer(first)
        if n == 0 and not opened and not due:
            self.listing.clear()
        else:
            self.listing.update((n, settled_ms, first, [(k, *v) for k, v in opened.items()], [(k, *v) for k, v in due.items()]))

    def _ignored(self, end: int, settled_ms: int) -> bool:
        return 0 <= settled_ms and end <= settled_ms + self.settled_for_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, (n, settled_ms, timer_ms, opened, due) = timerValues.getCurrentWatermarkInMs(), self._load()
        new = False
        for r in rows:
            end = r.end_us // 1000
            if end > now and not self._ignored(end, settled_ms):
                opened[r.cycle] = self._later(opened.get(r.cycle), (end, r.attempt, r.sent, r.retryable, r.delay_s, r.next_us))
                new = True
        if new:
            self._store(now, n, settled_ms, timer_ms, opened, due)
        return iter(())

    @staticmethod
    def _later(a: tuple | None, b: tuple) -> tuple:
        """The later of two merged attempts of a cycle, sent if either was; the cycle's end is the first one said."""
        if a is None:
            return b
        x = max(a, b, key=lambda r: (r[1], r[3], r[5]))
        return (a[0], x[1], a[2] or b[2], *x[3:])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Timers set here are looked at in the next batch, so all that the watermark has passed is done at once.
        now, out = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), []
        n, settled_ms, timer_ms, opened, due = self._load()
        for cycle, (end, attempt, sent, retryable, delay, next_us) in sorted(opened.items()):
            if end > now:
                continue
            del opened[cycle]
            if self._ignored(end, settled_ms):
                continue
            n, settled_ms = (1, -1) if settled_ms >= 0 else (n + 1, -1)
            given_up = not sent and n >= self.max_attempts
            out.append(self._row(key, cycle, "attempt", n, sent, sent or given_up, given_up, None, None, None))
            if retryable:
                due[cycle] = (n, attempt, delay, next_us)
            if sent or given_up:
                settled_ms = end
        for cycle, waits in sorted(due.items()):
            if -(-waits[3] // 1000) <= now:
                out.append(self._row(key, cycle, "retry", waits[0], None, None, None, *waits[1:]))
                del due[cycle]
        if 0 <= settled_ms <= now - self.settled_for_ms:
            n, settled_ms = 0, -1
        self._store(now, n, settled_ms, timer_ms, opened, due)
        return iter(out)

    @staticmethod
    def _row(key, cycle, kind, n, sent, settled, gave_up, attempts, delay, next_us) -> Row:
        return Row(listing_id=key[0], cycle=cycle, kind=kind, n=n, any_sent=sent, settled=settled, gave_up=gave_up,
                   attempts=attempts, delay_s=delay, next_us=next_us)

    def close(self) -> None:
        pass


def retry_state(attempts: DataFrame, delay: str = "1 day", max_attempts: int = V.MAX_NOTIFY_ATTEMPTS,
                settled_for_s: int = 30 * 86400) -> DataFrame:
    """A stream of attempts (listing_id, cycle, cycle_end, attempt, at, channel, status, retry_after) as
    rows of two kinds:

    * ``attempt``: one per listing and cycle that has ended, up to the first that was delivered or is attempt
      ``max_attempts`` (``n``, ``any_sent``, ``settled``, ``gave_up`` as in ``delivery.delivery_attempts``);
    * ``retry``: of those cycles, each whose last attempt failed retryably, once it is due (``attempts``,
      ``delay_s``, ``next_attempt_at`` as in ``delivery.retry_queue``).

    A cycle ends when a cycle that ends ``delay`` later has been seen; attempts at an ended cycle come too late
    and are left out, as by any watermark.  ``cycle_end`` is one value per cycle and grows with it.  Cycles of a
    settled listing that end within ``settled_for_s`` seconds of event time after the settled one are ignored; with
    a later one it starts anew: it is for the seen store to keep it from being sent.  A row without listing, cycle, end or attempt number has no place
    in the order and is left out; without a time it counts, but asks for no retry, as does a wait beyond 10^12 seconds.
    Of repeated attempt numbers the one to be retried latest counts.  Needs ``state_conf`` at the start."""
    wait = retry_delay_seconds(F.col("attempt") - 1, "retry_after")
    sent = F.coalesce(F.col("channel").isin(*V.CHANNELS) & (F.col("status") < 400), F.lit(False))
    x = attempts.select(
        F.col("listing_id").cast("string").alias("listing_id"), F.col("cycle").cast("bigint").alias("cycle"),
        F.unix_micros(F.col("cycle_end").cast("timestamp")).alias("end_us"), F.col("attempt").cast("bigint").alias("attempt"),
        sent.alias("sent"), V.is_retryable_send("status").alias("retryable"),
        F.when(wait <= 1e12, wait).alias("delay_s"), F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"))
    x = x.dropna(subset=["listing_id", "cycle", "end_us", "attempt"])
    next_us = F.col("at_us") + (F.col("delay_s") * 1000000).cast("bigint")
    retry = F.col("retryable") & next_us.isNotNull()
    x = x.select("listing_id", "cycle", "end_us", "attempt", "sent", retry.alias("retryable"),
                 F.when(retry, F.col("delay_s")).otherwise(0.0).alias("delay_s"), F.when(retry, next_us).otherwise(0).alias("next_us"))
    x = x.mapInPandas(_merge, _MERGED).withColumn("cycle_end", F.timestamp_micros("end_us")).withWatermark("cycle_end", delay)
    out = x.groupBy("listing_id").transformWithState(RetryProcessor(max_attempts, settled_for_s * 1000), _OUT, "Append", "EventTime")
    return out.withColumn("next_attempt_at", F.timestamp_micros("next_us")).drop("next_us")


def start_retry_state(attempts: DataFrame, out_path: str, checkpoint: str, interval: str | None = None, **options):
    """Start ``retry_state`` into a Parquet sink: to the stream's present end, or every ``interval``."""
    with state_conf(attempts.sparkSession):
        w = (retry_state(attempts, **options).writeStream.format("parquet").option("path", out_path)
             .option("checkpointLocation", checkpoint).outputMode("append"))
        return (w.trigger(availableNow=True) if interval is None else w.trigger(processingTime=interval)).start()
