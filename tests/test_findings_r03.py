"""Small tests of the work's shape: what is read once, dealt out, and handed over whole."""
import uuid

import pytest
from pyspark.sql import functions as F

from roofline.plans import adapters as A
from roofline.plans import q_extract, q_streaming
from roofline.session import ensure_checkpoint_dir
from roofline.sources import extract as X
from roofline.streaming import page_stream as PS

SMALL = "/root/testdata/sf0.001"
LANDED = ("search_id long, kind string, page_no int, url string, attempt int, status int, error string, "
          "fetched_at timestamp_ntz, body string")


def folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def test_a_landing_is_one_batch_and_keeps_its_files(spark):
    base, batches = folder(spark, "land"), []
    df = spark.range(0, 800, 1, 8).select("id", F.when(F.col("id") < 3, 0).otherwise(1).alias("c"))

    def start(source):
        return (source.writeStream.foreachBatch(lambda b, i: batches.append((i, b.count())))
                .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q_streaming.land(df, f"{base}/in", "c", [0, 1], start)
    assert batches == [(0, 3), (1, 797)]
    assert len(spark.read.parquet(f"{base}/in").inputFiles()) > 4


def test_landed_bodies_are_scanned_once(spark):
    body = '<article class="aditem" data-adid="7"><a class="ellipsis" href="/x">T</a></article>'
    landed = spark.createDataFrame([(1, PS.PAGE, 1, "https://p/", 0, 200, None, None, body)], LANDED)
    base, names = folder(spark, "once"), []

    def written(name, df):
        names.append(name)
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")
    listings, outcomes = PS.landed_listings(landed, written=written)
    assert sorted(names) == ["cards", "items", "listings"]
    for df in (listings, outcomes):
        assert "MapInArrow" not in df._jdf.queryExecution().toString()
    assert [r.listing_id for r in listings.collect()] == ["kleinanzeigen:7"] and outcomes.first()["count"] == 1


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("scan", [X.detail_pairs, lambda p: X.scan_elements(p, "body", None, {}, ["page_id"], text=False)])
def test_detail_pages_of_one_small_file_are_many_tasks(spark, uncoalesced, scan):
    pages = q_extract.detail_pages(A.Tables(spark, SMALL))
    assert scan(pages).rdd.getNumPartitions() > 1


def test_match_all_tests_no_keywords_per_pair(spark, uncoalesced):
    """The join with the searches has bounds only, so it is compiled; the listings of one file are many tasks."""
    from roofline.operators import matching as M
    li = spark.createDataFrame([("a", "Red ring", "x", "d", 5.0, 1.0, 1.0), ("b", "blue", "x", "d", None, 1.0, 1.0)],
                               "listing_id string, title string, location string, description string, price double, "
                               "rooms double, sqm double").coalesce(1)
    s = spark.createDataFrame(
        [(1, "", None, 6.0, ["red"], None), (2, "", None, None, None, ["red"]), (3, "", 6.0, None, None, []),
         (4, "", None, None, [], None), (5, "", None, None, ["red", "ring"], ["blue"])],
        "search_id long, search_type string, min_rent double, max_rent double, required_keywords array<string>, "
        "excluded_keywords array<string>").withColumns({c: F.lit(None).cast("double") for c in (
            "min_rooms", "max_rooms", "min_sqm", "max_sqm")})
    got = M.match_all(li, s)
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "_bucket" in x]
    assert joins and not any("lambda" in x for x in joins)
    assert "price" in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning(title" in x)
    assert {(r.listing_id, r.match_search_id) for r in got.collect()} == {
        ("a", 1), ("a", 4), ("a", 5), ("b", 2), ("b", 3), ("b", 4)}
