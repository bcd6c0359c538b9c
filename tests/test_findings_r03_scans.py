"""Small tests of work that is done once: a page's URL, a detail page's scan, a cycle's stages."""
from roofline.plans import _common, q_extract, q_funnel
from roofline.plans import adapters as A
from roofline.sources import extract as X

SMALL = "/root/testdata/sf0.001"
CARD = '<article class="aditem" data-adid="{}"><a class="ellipsis" href="{}">T</a></article>'


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_pages_url_is_split_below_the_scan(spark):
    hrefs = ["/a", "b", "//c/d", "https://e/f", "?g"]
    rows = [(i, url, "".join(CARD.format(n, h) for n, h in enumerate(hrefs)))
            for i, url in enumerate(["https://p.example:81/x/y?z", "no url", None])]
    cards = X.extract_cards(spark.createDataFrame(rows, "page_id int, url string, body string"))
    above, below = plan(cards).split("MapInArrow", 1)
    assert "parse_url" not in above.lower().replace("urlevaluator", "_url") and "ParseUrl" in below
    got = {i: [r.url for r in cards.where(f"page_id = {i}").orderBy("pos").collect()] for i in range(3)}
    absent = "https://www.kleinanzeigen.de"
    want = lambda o, s: [f"{o}/a", f"{o}/b", f"{s}://c/d", "https://e/f", f"{o}?g"]
    assert got == {0: want("https://p.example:81", "https"), 1: want(absent, "https"), 2: want(absent, "https")}


def test_a_detail_page_is_scanned_once_without_a_shuffle(spark):
    li = "<li class=addetailslist--detail>{}<span class=addetailslist--detail--value>{}</span></li>"
    body = ("<p id=viewad-price>1.200 &euro;</p><ul>" + li.format("Zimmer", "auf Anfrage") + li.format("Zimmer:", "3")
            + li.format("Etage", "2") + "<li class=addetailslist--detail>Wohnfl&auml;che</li>" + li.format("Kaution / Anteile", "5 €")
            + "<li class='addetailslist--detail checklisttag'>Balkon</li></ul><span class=checklisttag></span>"
              "<div id=viewad-description-text>A <b>b</b></div>")
    pages = spark.createDataFrame([(1, body), (2, ""), (3, None)], "page_id int, body string")
    details = X.extract_details(pages)
    text = plan(details)
    assert text.count("MapInArrow") == 1 and "Exchange" not in text
    one, none = details.orderBy("page_id").collect()
    assert (one.price, one.rooms, one.floor, one.sqm, one.deposit) == (1200.0, None, "2", None, "5 €")
    assert one.features == ["Balkon"] and one.description == "A b"
    assert none.page_id == 2 and none.features == [] and none.price is None and none.floor is None


def test_detail_pages_stay_dealt_out(spark):
    """A small exchange is not put together again before the scan."""
    pages = q_extract.detail_pages(A.Tables(spark, SMALL))
    assert X.extract_details(pages).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_cycles_stages_are_made_once(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(_common, "cut_lineage", lambda df, cut=_common.cut_lineage: cuts.append(df) or cut(df))
    got = {r["mode"]: (r.stored, r.notified) for r in q_funnel.q_prime_vs_steady(A.Tables(spark, SMALL)).collect()}
    assert got["prime"] == (got["steady"][0], 0) and got["steady"][1] > 0
    # The signed listings and the flagged ones, of both cycles; the second reads no listing again.
    assert [plan(df).count("Window [") > 0 for df in cuts] == [True, False]


def test_unequal_plans_are_cut_on_their_own(spark):
    cut = _common.cut_once(A.Tables(spark, SMALL))
    a, b, c = (cut("x", spark.range(n).selectExpr("id * 2 AS x")) for n in (3, 4, 3))
    assert (a.count(), b.count()) == (3, 4) and a is c


def test_the_sinks_of_a_batch_begin_at_the_flagged_listings(spark, monkeypatch):
    """No sink's plan goes back to what was fetched, matched or deduplicated."""
    from roofline.streaming import cycle_stream as CS
    from test_streaming import Store
    plans = {}

    def spy(write):
        def told(df, path, batch_id):
            plans[path.rsplit("/", 1)[-1]] = plan(df), df.inputFiles()
            return write(df, path, batch_id)
        return told
    for name in ("write_batch", "stage_table"):
        monkeypatch.setattr(CS, name, spy(getattr(CS, name)))
    s = Store(spark, prime=False)
    s.writer()(s.listings(0, 5), 0)
    assert s.count("res") == 5
    assert "Window" in plans["seen_signed"][0] and "Window" not in plans["seen_flagged"][0]
    for sink in ("res", "seen"):
        text, files = plans[sink]
        assert "Window" not in text and files and all("seen_flagged" in f for f in files)
