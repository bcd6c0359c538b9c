"""The stream from landed pages and feeds, and the staged oracles of the stream queries."""
import uuid
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from roofline.operators import delivery as V
from roofline.plans import adapters as A
from roofline.plans import q_pages as Q
from roofline.plans import registry
from roofline.session import ensure_checkpoint_dir
from roofline.streaming import cycle_stream as CS
from roofline.streaming import page_stream as PS

SMALL = "/root/testdata/sf0.001"


def oracle(name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    registry.load_all()
    got = con.execute(registry.ORACLE[name])
    names = [d[0] for d in got.description]
    return names, Counter(got.fetchall())


def rows(df, names):
    return Counter(tuple(r) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def landed(spark):
    return Q.run_pages(A.Tables(spark, SMALL), "test-pages")


@pytest.mark.parametrize("name", ["stream_pages", "stream_pages_runs"])
def test_pages_to_results_equal_the_staged_cycle(spark, landed, monkeypatch, name):
    monkeypatch.setattr(Q, "run_pages", lambda t, name: landed)
    names, want = oracle(name)
    assert rows(registry.QUERIES[name](A.Tables(spark, SMALL)), names) == want and len(want) > 2


def test_the_stream_leaves_undelivered_listings_unseen(spark, landed):
    seen = spark.read.parquet(f"{landed}/seen").where("key not like 'sig:%'").select("key")
    status = spark.read.parquet(f"{landed}/outbox_status")
    assert status.where("settled").join(seen, status["listing_id"] == seen["key"], "left_anti").count() == 0
    assert status.where("n = 2 and not any_sent").where("not settled").count() == 0
    tried = status.groupBy("listing_id").agg(F.max("n").alias("n"), F.bool_or("settled").alias("settled"))
    assert tried.where("n > 1").count() > 0 and tried.where("not settled").count() > 0


@pytest.mark.parametrize("name", ["stream_cycle", "stream_prime_chunks"])
def test_cycle_streams_equal_the_staged_cycle(spark, name):
    names, want = oracle(name)
    assert rows(registry.QUERIES[name](A.Tables(spark, SMALL)), names) == want


LANDED = ("search_id bigint, page_no int, url string, attempt int, status int, error string, "
          "fetched_at timestamp_ntz, body string, kind string")


def advert(i):
    return f"<article class=aditem data-adid={i}><a class=ellipsis href=/s/{i}>Ad {i}</a></article>"


def test_last_attempts_walks_and_outcomes(spark):
    feed = "<rss><item><title>F</title><link>https://f/1</link><guid>f1</guid></item></rss>"
    data = [
        (1, 1, "https://p/1", 0, 500, None, None, None, PS.PAGE), (1, 1, "https://p/1", 1, 200, None, None, advert(1) + advert(2), PS.PAGE),
        (1, 2, "https://p/1", 0, 200, None, None, advert(2), PS.PAGE), (1, 3, "https://p/1", 0, 200, None, None, advert(3), PS.PAGE),
        (2, 1, "https://p/2", 0, 403, None, None, None, PS.PAGE), (2, 2, "https://p/2", 0, 200, None, None, advert(4), PS.PAGE),
        (3, 1, "https://p/3", None, 200, None, None, advert(5), PS.PAGE), (3, 2, "https://p/3", None, None, "timeout", None, None, PS.PAGE),
        (3, 3, "https://p/3", None, 200, None, None, advert(6), PS.PAGE),
        (4, 1, "https://f", 0, 200, None, None, feed, PS.FEED), (5, 1, "https://f", 0, None, "reset", None, None, PS.FEED),
        (6, 1, "https://p/6", 0, 200, None, None, "", PS.PAGE)]
    listings, outcomes = PS.landed_listings(spark.createDataFrame(data, LANDED))
    assert {(r.search_id, r.page_no, r.listing_id) for r in listings.collect()} == {
        (1, 1, "kleinanzeigen:1"), (1, 1, "kleinanzeigen:2"), (3, 1, "kleinanzeigen:5"), (4, 1, "rss:f1")}
    assert {tuple(r) for r in outcomes.collect()} == {
        ("1:page", "info", "ok", 2), ("2:page", "warning", "403_blocked: HTTP 403", None), ("3:page", "info", "ok", 1),
        ("4:feed", "info", "ok", 1), ("5:feed", "error", "failed: reset", None), ("6:page", "info", "ok", 0)}


def test_counters_survive_a_failed_batch(spark):
    """With keep_going a failed batch leaves no counters; those of the last committed one go on."""
    from test_streaming import Store
    send = lambda outbox, batch_id: outbox.select("listing_id", F.lit(False).alias("any_sent"))
    s = Store(spark, prime=False, deliver=send, keep_going=True, max_attempts=3)
    bad = s.listings(0, 2).withColumn("price", F.raise_error(F.lit("no")).cast("double"))
    for batch, rows_ in enumerate([s.listings(0, 2), bad, s.listings(0, 2), s.listings(0, 2)]):
        s.writer()(rows_, batch)
    status = {(r.batch_id, r.listing_id): r.n for r in spark.read.parquet(f"{s.base}/out_status").collect()}
    assert status == {(b, f"x:{i}"): n for b, n in ((0, 1), (2, 2), (3, 3)) for i in range(2)}
    assert {r.key for r in CS.read_table(spark, f"{s.base}/seen", CS.SEEN_TABLE_SCHEMA).collect()} == {"x:0", "x:1"}
    assert V.MAX_NOTIFY_ATTEMPTS == 5


def test_reposts_stay_where_content_dedup_is_off(spark):
    from test_streaming import Store
    base = f"{ensure_checkpoint_dir(spark)}/repost-{uuid.uuid4().hex}"
    s = Store(spark, prime=True)
    twins = s.listings(0, 3).withColumns({"price": F.lit(900.0), "sqm": F.lit(65.0), "location": F.lit("Jena")})
    for off in (False, True):
        s.base = f"{base}-{off}"
        s.writer(content_dedup=not off)(twins, 0)
        assert s.count("res") == (3 if off else 1)
        assert spark.read.parquet(f"{s.base}/seen").where("key like 'sig:%'").count() == 1
