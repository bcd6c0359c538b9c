"""Registered queries: the streaming operators.

Each query lands the adapter rows as files in a scratch folder under the shared
checkpoint directory (chunk by chunk, in order), runs the stream with ``availableNow``
after each landing and returns the sink table.  Rows-only checks; the stream-equals-batch comparisons are in ``tests/test_streaming.py``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runlog as RL
from ..streaming import cycle_stream as CS
from ..streaming import retry_state as RS
from . import adapters as A
from ._common import clean_searches, scratch
from .oracle_adapters import ORDER_SQL, staged_ctes, with_ctes
from .q_delivery import _CO
from .q_runlog import _EV
from .registry import register

NOW = "2024-02-01 00:00:00"


def land(df, path: str, chunk_col: str, chunks, start) -> None:
    """Hand over ``df`` as successive landings in ``path``, one per value of ``chunks``, and run the stream that
    ``start(source)`` gives to its present end after each: a landing is one batch, however many files it has.
    The rows are written once, by the tasks that make them, and each landing is a copy of its files' rows, so
    no task has more than a file's share; they are not gathered by chunk."""
    df.write.partitionBy(chunk_col).parquet(f"{path}-all")
    whole = df.sparkSession.read.schema(df.schema).parquet(f"{path}-all")
    for i in chunks:
        whole.filter(F.col(chunk_col) == i).drop(chunk_col).write.mode("append").parquet(path)
        start(df.sparkSession.readStream.schema(df.drop(chunk_col).schema).parquet(path)).awaitTermination()


def _land_listings(t, base, start):
    land(A.listings(t).withColumn("_chunk", (F.col("search_id") % 4).cast("int")), f"{base}/in", "_chunk", range(4), start)


def _run_cycle_stream(t, name, prime=None):
    base = scratch(t, name)
    writer = CS.cycle_batch_writer(t.spark, clean_searches(t), f"{base}/seen", f"{base}/results", f"{base}/outbox",
                                   A.LISTING_ORDER, NOW, prime=prime)
    _land_listings(t, base, lambda s: s.writeStream.foreachBatch(writer).option("checkpointLocation", f"{base}/ckpt")
                   .trigger(availableNow=True).start())
    return base


def _staged(body: str) -> str:
    """The four landings of the cycle stream, one after the other, without details and channel."""
    landed = {"landed": "SELECT *, search_id % 4 AS chunk FROM listings"}
    each = "\nUNION ALL ".join(body.format(b=b) for b in range(4))
    return with_ctes("listings", "searches", extra=landed).rstrip("\n") + ",\n" + staged_ctes(4, ORDER_SQL) + each


@register("stream_cycle", sql=_staged("SELECT listing_id, CASE WHEN search_type <> '' THEN search_type END AS search_type, "
                                      "CAST({b} AS BIGINT) AS batch_id FROM stored{b}"))
def q_stream_cycle(t):
    """I1 + I2 + I3: the cycle over four landings; the first batch primes."""
    base = _run_cycle_stream(t, "cycle")
    return t.spark.read.parquet(f"{base}/results").select("listing_id", "search_type", F.col("batch_id").cast("bigint").alias("batch_id"))


@register("stream_prime_chunks", sql=_staged("SELECT key, CAST({b} AS BIGINT) AS batch_id FROM keys{b}"))
def q_stream_prime_chunks(t):
    """A prime split into chunks; signatures stored by a chunk hide reposts in
    later chunks.  Returns the seen table."""
    base = _run_cycle_stream(t, "prime", prime=True)
    return t.spark.read.parquet(f"{base}/seen").select("key", F.col("batch_id").cast("bigint").alias("batch_id"))


@register("stream_dedup", sql=with_ctes("listings") + "SELECT DISTINCT listing_id FROM listings")
def q_stream_dedup(t):
    """I3, id-only: ``dropDuplicates`` on a stream of the landed listings."""
    base = scratch(t, "dedup")
    _land_listings(t, base, lambda s: CS.stream_dedup(s.select("listing_id", "search_id")).writeStream.format("parquet")
                   .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
                   .trigger(availableNow=True).start())
    return t.spark.read.parquet(f"{base}/out").select("listing_id")


@register("runs_over_time_stream", sql=with_ctes("run_events", extra=_EV) + """
SELECT date_trunc('day', started_at)::TIMESTAMP AS bucket, status, count(*) AS runs, CAST(sum(new) AS BIGINT) AS new,
       CAST(sum(notified) AS BIGINT) AS notified
FROM runs WHERE date_trunc('day', started_at) + INTERVAL 1 DAY <= (SELECT max("at") FROM run_events) - INTERVAL 1 HOUR
GROUP BY 1, 2""")
def q_runs_over_time_stream(t):
    """E7 as a stream: the run events of every ten days as a landing; the windows that the watermark has closed."""
    base = scratch(t, "runs_over_time")
    ev = A.run_events(t).withColumns({"at": F.col("at").cast("timestamp"), "event_no": F.col("event_no").cast("bigint")})
    ev = ev.withColumn("_chunk", F.floor(F.datediff("at", F.lit("2024-01-01")) / 10).cast("int"))
    chunks = sorted(r[0] for r in ev.select("_chunk").distinct().collect()) or [0]
    land(ev, f"{base}/in", "_chunk", chunks, lambda s: RL.runs_over_time_stream(s, tie="event_no").writeStream
         .format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .outputMode("append").trigger(availableNow=True).start())
    return t.spark.read.parquet(f"{base}/out").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@register("stream_attempts", sql=with_ctes("attempts", extra=_CO) + """
SELECT listing_id, cycle, n, any_sent, any_sent OR n >= 5 AS settled, NOT any_sent AND n >= 5 AS gave_up FROM da""")
def q_stream_attempts(t):
    """I4: the bounded delivery retry counter carried over one landing per ten cycles (0-9, 10-19, ...)."""
    from ..operators import delivery as V
    base = scratch(t, "attempts")
    st = V.delivery_status(V.channel_outcomes(A.delivery_attempts(t), ["listing_id", "cycle"]))
    st = st.select("listing_id", "cycle", "any_sent").withColumn("_chunk", F.floor(F.col("cycle") / 10).cast("int"))
    chunks = sorted(r[0] for r in st.select("_chunk").distinct().collect()) or [0]
    land(st, f"{base}/in", "_chunk", chunks, lambda s: CS.stream_attempts(s, f"{base}/out", f"{base}/ckpt"))
    return t.spark.read.parquet(f"{base}/out").select("listing_id", "cycle", "n", "any_sent", "settled", "gave_up")


_ENDED = {"mark": """
SELECT max(DATE '2024-01-01' + CAST(cycle + 1 AS INTEGER))::TIMESTAMP - INTERVAL 132 HOUR AS mark FROM attempts""",
          "ended": """
SELECT listing_id, cycle, n, any_sent FROM da, mark WHERE (DATE '2024-01-01' + CAST(cycle + 1 AS INTEGER))::TIMESTAMP <= mark""",
          "last": """
SELECT listing_id, cycle, max(attempt) AS attempts, arg_max("at", attempt) AS at_, arg_max_null(status, attempt) AS st,
       arg_max_null(retry_after, attempt) AS ra
FROM attempts GROUP BY listing_id, cycle""",
          "waits": """
SELECT *, at_ + to_microseconds(CAST(delay_s * 1000000 AS BIGINT)) AS next_attempt_at
FROM (SELECT *, CASE WHEN ra IS NOT NULL THEN greatest(0.0, CAST(ra AS DOUBLE)) ELSE pow(2.0, attempts) END AS delay_s
      FROM last WHERE st IS NULL OR st IN (429, 500, 502, 503, 504)) x"""}


@register("stream_retry_state", sql=with_ctes("attempts", extra={**_CO, **_ENDED}) + """
SELECT listing_id, cycle, 'attempt' AS kind, n, any_sent, any_sent OR n >= 5 AS settled, NOT any_sent AND n >= 5 AS gave_up,
       CAST(NULL AS BIGINT) AS attempts, CAST(NULL AS DOUBLE) AS delay_s, CAST(NULL AS TIMESTAMP) AS next_attempt_at
FROM ended
UNION ALL
SELECT e.listing_id, e.cycle, 'retry', e.n, NULL, NULL, NULL, w.attempts, w.delay_s, w.next_attempt_at
FROM ended e JOIN waits w USING (listing_id, cycle), mark WHERE w.next_attempt_at <= mark""")
def q_stream_retry_state(t):
    """I4 + B17 as keyed state: attempts of two five-day periods mixed in every landing; the cycles that the
    watermark (5.5 days) has ended, and the retries of theirs that are due by then."""
    base = scratch(t, "retry_state")
    a = A.delivery_attempts(t)
    a = a.select("listing_id", "cycle", "attempt", F.col("at").cast("timestamp").alias("at"), "channel", "status", "retry_after",
                 (F.lit("2024-01-01").cast("date") + (F.col("cycle") + 1).cast("int")).cast("timestamp").alias("cycle_end"),
                 (F.floor(F.col("cycle") / 5) + F.col("event_id") % 2).cast("int").alias("_chunk"))
    chunks = sorted(r[0] for r in a.select("_chunk").distinct().collect()) or [0]
    # The test rows go on for settled listings, so their marks stay to the end.
    land(a, f"{base}/in", "_chunk", chunks, lambda s: RS.start_retry_state(
        s, f"{base}/out", f"{base}/ckpt", delay="132 hours", settled_for_s=400 * 86400))
    return t.spark.read.parquet(f"{base}/out").withColumn("next_attempt_at", F.col("next_attempt_at").cast("timestamp_ntz"))
