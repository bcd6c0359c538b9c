"""Queries that meet every row of their tables."""


def rows(spark, name, sf_dir):
    import __spark_entry__ as E
    return E.queries()[name](spark, sf_dir).collect()


def test_signatures_of_all_searches_are_tested(spark, sf_dir):
    """Of every listing: returned, or hidden by an older row; none left out by its search."""
    first = {r.listing_id: r.search_id for r in rows(spark, "first_match_wins", sf_dir)}
    got = {r.listing_id: r.search_id for r in rows(spark, "new_signatures_all", sf_dir)}
    assert got.items() <= first.items() and 0 < len(got) < len(first)
    assert {s for s in first.values() if s % 5 == 0} == {s for s in got.values() if s % 5 == 0} != set()


def test_searches_grow_with_the_suppliers(spark, sf_dir):
    """One search per supplier (the one without a URL is dropped), and listings meet more than 25 of them."""
    n = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert len(rows(spark, "searches_clean_supplier", sf_dir)) == n - 1 > 25
    import __spark_entry__ as E
    met = E.queries()["match_all_searches_supplier"](spark, sf_dir).select("match_search_id").distinct().count()
    assert met > 25


def test_an_active_primary_keeps_the_static_list_out(spark, sf_dir):
    got = rows(spark, "searches_fallback_active", sf_dir)
    assert got and all(r.search_id % 2 == 0 for r in got)


def test_attempts_of_late_cycles_are_streamed(spark, sf_dir):
    """Events after the first days moved two months on: the stream has every row that the batch has."""
    from pyspark.sql import functions as F

    from roofline.plans import adapters as A
    from roofline.plans.registry import QUERIES, load_all
    load_all()
    t = A.Tables(spark, sf_dir)
    t.events = t.events.withColumn("ts", F.when(F.dayofmonth("ts") > 3, F.col("ts") + F.expr("INTERVAL 60 DAYS"))
                                   .otherwise(F.col("ts")))
    want = sorted(map(tuple, QUERIES["delivery_attempts"](t).collect()))
    assert max(r[1] for r in want) > 30
    assert sorted(map(tuple, QUERIES["stream_attempts"](t).collect())) == want
