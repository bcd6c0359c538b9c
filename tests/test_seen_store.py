"""The bucketed seen store: same rows as the plain operators, no exchange on its side, safe to replay."""
import uuid

import pytest
from pyspark.sql import functions as F

from roofline.operators import dedup as D
from roofline.operators.seen_store import SEEN_SCHEMA, SeenStore
from roofline.session import ensure_checkpoint_dir


@pytest.fixture
def path(spark):
    return f"{ensure_checkpoint_dir(spark)}/it's a store-{uuid.uuid4().hex}"


def rows(spark, *keys, title="t"):
    return spark.createDataFrame([(k, title, None, "s") for k in keys], SEEN_SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keys(df):
    return sorted(r.key for r in df.collect())


def test_appends_merges_and_probes_equal_the_plain_operators(spark, path):
    store, want = SeenStore(spark, path, buckets=4, fanout=2), spark.createDataFrame([], SEEN_SCHEMA)
    parts = [[f"k{i}" for i in range(lo, lo + 40)] for lo in (0, 20, 60, 10, 90, 300, 0)]
    for batch, part in enumerate(parts):
        add = rows(spark, *part, *part[:5], None, title=f"t{batch}")
        want = want.unionByName(D.seen_append(want, add.filter("key IS NOT NULL"))).cache()
        assert store.append(add, batch) and not store.append(add, batch)
        store.compact()
    assert sorted(map(tuple, store.rows().collect())) == sorted(map(tuple, want.collect()))
    # Seven batches in binary: a run of four, one of two and one of one.
    assert [(r.level, r.first_batch, r.last_batch) for r in store.runs()] == [(2, 0, 3), (1, 4, 5), (0, 6, 6)]
    listings = spark.range(0, 500, 3).select(F.concat(F.lit("k"), "id").alias("listing_id"), F.col("id").alias("_seen"))
    assert sorted(map(tuple, store.only_new(listings).collect())) == sorted(map(tuple, D.only_new(listings, want).collect()))
    again = SeenStore(spark.newSession(), path, buckets=4, fanout=2)  # another session, tables not yet known to it
    assert keys(again.rows()) == keys(want)


def test_only_the_listings_are_shuffled(spark, path):
    store = SeenStore(spark, path, buckets=4, fanout=3)
    for batch in range(3):
        store.append(rows(spark, *[f"{batch}-{i}" for i in range(9)]), batch)
    listings = spark.range(50).select(F.concat(F.lit("1-"), "id").alias("listing_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        probe = plan(store.only_new(listings))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert probe.count("Exchange") == 1 and probe.count("Bucketed: true") == 3
    assert probe.index("Exchange") < probe.index("Union")  # on the listings' side, above the runs
    merged = plan(store.rows().groupBy("key").count())
    assert "Exchange" not in merged
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,1-3)]" in plan(store.lookup("1-3"))
    assert keys(store.lookup("1-3", "2-8", "none")) == ["1-3", "2-8"]
    assert store.compact() == 1 and len(store.runs()) == 1 and len(store.superseded()) == 3
    assert keys(store.rows()) == sorted(f"{b}-{i}" for b in range(3) for i in range(9))


def test_null_keys_empty_stores_and_extra_columns(spark, path):
    store = SeenStore(spark, path, buckets=3)
    listings = spark.createDataFrame([("a", 1, "x"), (None, 2, "y"), (None, 2, "y"), ("b", 3, None)], "signature string, key int, title string")
    assert store.rows().count() == 0 and store.compact() == 0 and store.only_new(listings, "signature").count() == 4
    assert store.append(rows(spark), 0) and store.rows().count() == 0
    assert store.only_new(listings, "signature").count() == 4
    assert store.append(spark.createDataFrame([("a", 7)], "key string, listing_id int"), 5)  # only the key, and a column of its own
    left = store.only_new(listings, "signature")
    assert left.columns == listings.columns and sorted(map(str, left.collect())) == sorted(map(str, listings.collect()[1:]))
    assert [tuple(r) for r in store.rows().collect()] == [("a", None, None, None)]
    assert not store.append(rows(spark, "late"), 3)
    with pytest.raises(ValueError):
        SeenStore(spark, path, buckets=4).rows()


def test_a_crash_before_the_manifest_leaves_the_last_state(spark, path, monkeypatch):
    store = SeenStore(spark, path, buckets=2, fanout=2)
    store.append(rows(spark, "a"), 0)
    commit = SeenStore._commit
    monkeypatch.setattr(SeenStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.append(rows(spark, "b", "half"), 1)
    assert keys(store.rows()) == ["a"]
    monkeypatch.setattr(SeenStore, "_commit", commit)
    assert store.append(rows(spark, "b"), 1) and keys(store.rows()) == ["a", "b"]
    monkeypatch.setattr(SeenStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.compact()
    monkeypatch.setattr(SeenStore, "_commit", commit)
    assert keys(store.rows()) == ["a", "b"] and store.compact() == 1 and keys(store.rows()) == ["a", "b"]


def test_a_batch_may_replace_what_it_stored_until_it_is_merged(spark, path):
    store = SeenStore(spark, path, buckets=2, fanout=2)
    store.append(rows(spark, "a"), 0)
    store.append(rows(spark, "b", "c"), 1)
    assert keys(store.rows(before=1)) == ["a"]
    assert store.append(rows(spark, "a", "c", "d"), 1, replace=True) and keys(store.rows()) == ["a", "c", "d"]
    store.compact()
    assert not store.append(rows(spark, "e"), 1, replace=True) and keys(store.rows()) == ["a", "c", "d"]


def test_bloom_filters_are_as_large_as_their_keys_need(spark, path):
    store = SeenStore(spark, path, buckets=4)
    store.append(rows(spark, *[f"k{i}" for i in range(40)]), 0)
    store.append(spark.range(200000).select(F.concat(F.lit("n"), "id").alias("key")), 1)
    small, large = (sorted(spark.read.format("binaryFile").load(f"{path}/runs/{r.run}").select("length").toPandas()["length"]) for r in store.runs())
    assert len(small) == len(large) == 4 and small[-1] < 10_000 and large[0] > 50_000
