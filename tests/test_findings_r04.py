"""Small tests of the work's shape: bodies dealt out before the scan, tags read once, stages counted where they are stored."""
import uuid

from pyspark.sql import functions as F

from roofline.plans import adapters as A
from roofline.plans._common import clean_searches
from roofline.plans.cycle import run_cycle
from roofline.session import cut_lineage, ensure_checkpoint_dir
from roofline.sources import markup as M
from roofline.streaming import page_stream as PS

SMALL = "/root/testdata/sf0.001"
LANDED = ("search_id long, kind string, page_no int, url string, attempt int, status int, error string, "
          "fetched_at timestamp_ntz, body string")
CARD = '<article class="aditem" data-adid="{0}"><a class="ellipsis" href="/{0}">T</a></article>'


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_landed_bodies_of_one_file_are_scanned_in_several_tasks_a_core(spark):
    rows = [(i, PS.PAGE, 1, "https://p/", 0, 200, None, None, CARD.format(i)) for i in range(300)]
    rows += [(i, PS.FEED, 1, "https://f/", 0, 200, None, None, f"<rss><item><title>T</title><link>/{i}</link></item></rss>")
             for i in range(300)]
    base, tasks = f"{ensure_checkpoint_dir(spark)}/dealt-{uuid.uuid4().hex}", {}

    def written(name, df):
        tasks[name] = df.rdd.getNumPartitions()
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")
    listings, outcomes = PS.landed_listings(spark.createDataFrame(rows, LANDED).coalesce(1), written=written)
    assert min(tasks["cards"], tasks["items"]) >= 4 * spark.sparkContext.defaultParallelism
    assert listings.count() == 600 and outcomes.count() == 600
    pages = spark.range(300).select(F.col("id").cast("string").alias("listing_id"), F.lit("<p id=viewad-price>7").alias("body"))
    details = PS.landed_details(pages.coalesce(1))(spark.range(0, 300, 2).select(F.col("id").cast("string").alias("listing_id")))
    assert details.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert [r.price for r in details.collect()] == [7.0] * 150


def test_a_tag_is_read_once_however_many_others_there_were():
    page = "".join(f'<p class="x" title="{i}">' for i in range(3 * M.KEPT))
    M.scan(page, (M.Node("p", "x"),), {})
    assert M.attributes(' class="kept"') is M.attributes(' class="kept"') and len(M._KNOWN) <= M.KEPT
    scanner, read = M.Scanner((M.Node("p", "x"),), {}), []
    made = scanner.tag
    scanner.tag = lambda *tag: read.append(tag) or made(*tag)
    assert [len(scanner.scan('<p class="x">a</p><br><p class="x">b</p>')) for _ in range(3)] == [2, 2, 2]
    assert sorted(name for _, name, _ in read) == ["br", "p", "p"]
    scanner.scan(page)
    assert len(scanner.known) <= M.KEPT


def test_tags_with_an_open_quote_depend_on_what_follows():
    node = (M.Node("p", "x"),)
    scanner = M.Scanner(node, {})
    first, second = "<p class=x title='a>b</p>", "<p class=x title='a>b</p>c' id=1>d</p>"
    for page, html in ((first, "b"), (second, "d"), (first, "b")):
        assert [x.html for x in scanner.scan(page)] == [html]


def test_what_the_run_log_counts_is_stored(spark):
    """The filtered listings are matched once: the new ones begin there."""
    t, names, plans = A.Tables(spark, SMALL), [], {}

    def cut(name, df):
        names.append(name)
        plans[name] = plan(df)
        return cut_lineage(df) if name == "filtered" else df
    seen = spark.createDataFrame([], "key string, title string, url string, source string")
    details = lambda wanted: A.detail_rows(t).join(wanted, "listing_id", "left_semi")
    c = run_cycle(A.listings(t), clean_searches(t), seen, details, A.LISTING_ORDER, "2024-01-01", materialize=cut)
    assert names == ["filtered", "new", "signed", "flagged"]
    assert "Window" in plans["filtered"] and "Window" not in plans["new"] and "Window" not in plan(c.filtered)
