"""Scenario tests: small input tables -> expected rows (FIXTURES §4)."""
from pyspark.sql import functions as F

from roofline.operators import dedup as D
from roofline.operators import delivery as V
from roofline.operators import enrich as E
from roofline.operators import health as H
from roofline.operators import matching as M
from roofline.operators import results as R
from roofline.operators import runlog as RL
from roofline.sources import extract as X
from roofline.sources import pages as P
from roofline.sources import searches as S

ORDER = ["search_id", "page_no", "pos"]


def _walk(spark, pages, max_pages=20, failed=()):
    rows = [(1, p, i, str(x)) for p, ids in enumerate(pages, start=1) for i, x in enumerate(ids)]
    cards = spark.createDataFrame(rows, "search_id long, page_no int, pos int, listing_id string")
    pg = spark.createDataFrame([(1, p, p in failed) for p in range(1, len(pages) + 1)],
                               "search_id long, page_no int, failed boolean")
    out = P.cut_page_walk(cards, pg, max_pages).orderBy("page_no", "pos")
    return [int(r.listing_id) for r in out.collect()]


def test_page_walk(spark):
    assert _walk(spark, [[1, 2], [3, 4], []]) == [1, 2, 3, 4]
    assert _walk(spark, [[1, 2], [1, 2]]) == [1, 2]
    assert _walk(spark, [[i] for i in range(10)], max_pages=3) == [0, 1, 2]
    assert _walk(spark, [[1, 2], [3], [4]], failed={2}) == [1, 2]
    assert _walk(spark, [[1, 2], [3]], failed={1}) == []
    assert _walk(spark, [[1, 1], [2]]) == [1, 1, 2]  # repeats inside a page are kept


def _listings(spark, rows):
    return spark.createDataFrame(rows, "listing_id string, source string, title string, url string, price double, "
                                       "rooms double, sqm double, location string, description string, "
                                       "thumbnail string, search_id long, page_no int, pos int")


def test_notify_cap_and_summary(spark):
    rows = [(f"x:{i}", "x", f"T{i}", f"u{i}", None, None, None, None, None, None, 1, 1, i) for i in range(20)]
    ind, over = V.notify_cap(_listings(spark, rows), ORDER, 15)
    assert ind.count() == 15 and over.count() == 5
    assert sorted(r.position for r in ind.collect()) == list(range(1, 16))
    lines = V.summary_lines(over, ORDER).orderBy("line_no", "pos").collect()
    assert lines[0].line == "➕ 5 weitere neue Inserate:" and lines[1].line == "• T15 — u15"


def test_same_id_two_searches_one_row(spark):
    rows = [("x:1", "x", "t", "u", 950.0, None, None, None, None, None, 2, 1, 0),
            ("x:1", "x", "t", "u", 950.0, None, None, None, None, None, 1, 1, 0)]
    out = M.first_match_wins(_listings(spark, rows), ORDER).collect()
    assert len(out) == 1 and out[0].search_id == 1


def test_a_listing_meets_the_bounds_and_words_of_its_own_search(spark):
    """Three searches bound size, rooms or words; what a listing does not say never rules it out."""
    bounds = "min_rent double, max_rent double, min_rooms double, max_rooms double, min_sqm double, max_sqm double"
    words = "required_keywords array<string>, excluded_keywords array<string>"
    s = spark.createDataFrame([
        (11, "haus", None, None, None, None, 40.0, 60.0, [], []),
        (12, "", 300.0, None, 2.5, None, None, None, [], []),
        (13, "", None, None, None, None, None, None, ["garten"], ["keller"])], f"search_id long, search_type string, {bounds}, {words}")
    listing = lambda i, search, price, rooms, sqm, title: (
        f"x:{i}", "x", title, "u", price, rooms, sqm, None, None, None, search, 1, i)
    rows = [listing(0, 11, 9000.0, None, 40.0, "t"), listing(1, 11, None, None, 60.5, "t"), listing(2, 11, 1.0, 9.0, None, "t"),
            listing(3, 12, None, 2.5, 999.0, "t"), listing(4, 12, 299.0, 3.0, None, "t"), listing(5, 12, 300.0, 2.0, None, "t"),
            listing(6, 13, None, None, None, "Garten und Hof"), listing(7, 13, 1.0, 1.0, 1.0, "Garten, Keller"), listing(8, 13, 1.0, 1.0, 1.0, "Hof")]
    out = {r.listing_id: r.search_type for r in M.match_per_search(_listings(spark, rows), s).collect()}
    assert out == {"x:0": "haus", "x:2": "haus", "x:3": "", "x:6": ""}


def _status(spark, rows):
    df = spark.createDataFrame(rows, "listing_id string, cycle long, telegram_ok boolean, email_ok boolean, ha_ok boolean")
    return V.delivery_status(df)


def test_delivery_bounded_retry(spark):
    st = _status(spark, [("a", c, False, None, None) for c in range(1, 8)])
    out = V.delivery_attempts(st).orderBy("cycle").collect()
    assert [r.n for r in out] == [1, 2, 3, 4, 5]
    assert [r.settled for r in out] == [False] * 4 + [True] and out[-1].gave_up


def test_one_channel_ok_is_delivered(spark):
    r = _status(spark, [("a", 1, True, False, None)]).first()
    assert r.any_sent and r.any_failed
    assert V.delivery_attempts(_status(spark, [("a", 1, True, False, None)])).first().settled


def _runs(spark, statuses):
    rows = [("h", f"r{i}", f"2024-01-01 00:0{i}:00", s) for i, s in enumerate(statuses, start=1)]
    df = spark.createDataFrame(rows, "host string, run_id string, t string, status string")
    return df.select("host", "run_id", F.col("t").cast("timestamp_ntz").alias("started_at"),
                     F.col("t").cast("timestamp_ntz").alias("finished_at"), "status")


def test_alert_edges(spark):
    streak = H.failure_streak(_runs(spark, ["failed", "failed", "failed", "success"]))
    edges = {r.run_id: r.edge for r in H.alert_edges(streak, 2).collect()}
    assert edges == {"r2": "alert", "r4": "recovery"}
    assert [r.consecutive_failures for r in streak.orderBy("run_id").collect()] == [1, 2, 3, 0]


def test_partial_resets_streak(spark):
    streak = H.failure_streak(_runs(spark, ["failed", "partial", "failed"])).orderBy("run_id").collect()
    assert [r.consecutive_failures for r in streak] == [1, 0, 1]


def _sig_rows(spark, rows):
    return D.with_signature(_listings(spark, rows))


def test_repost_collapses(spark):
    rows = [("x:1", "x", "t", "u", 900.0, 2.0, 65.0, "10115 Berlin", None, None, 1, 1, 0),
            ("x:2", "y", "t", "u", 900.4, 2.0, 64.9, "Berlin", None, None, 1, 1, 1)]
    out = {r.listing_id: r.dropped for r in D.split_reposts(_sig_rows(spark, rows), ORDER).collect()}
    assert out == {"x:1": False, "x:2": True}
    kept = D.split_reposts(_sig_rows(spark, rows), ORDER)
    seen = D.seen_rows(kept.filter(~F.col("dropped")), kept.filter(F.col("dropped")))
    keys = {r.key for r in seen.collect()}
    assert {"x:1", "x:2"} <= keys and any(k.startswith("sig:") for k in keys)


def test_repost_across_cycles(spark):
    first = _sig_rows(spark, [("x:1", "x", "t", "u", 900.0, 2.0, 65.0, "Berlin", None, None, 1, 1, 0)])
    store = D.seen_rows(first, first.limit(0))
    second = _sig_rows(spark, [("x:2", "x", "t", "u", 900.0, 2.0, 65.0, "Berlin", None, None, 1, 1, 0)])
    assert D.split_reposts(second, ORDER, store).first().dropped


def test_no_price_never_collapses(spark):
    rows = [("x:1", "x", "t", "u", None, 2.0, 65.0, "Berlin", None, None, 1, 1, 0),
            ("x:2", "x", "t", "u", None, 2.0, 65.0, "Berlin", None, None, 1, 1, 1)]
    assert D.split_reposts(_sig_rows(spark, rows), ORDER).filter("dropped").count() == 0


def test_enrichment_fills_only_missing(spark):
    li = _listings(spark, [("x:1", "x", "t", "u", None, None, 45.0, None, "short", None, 1, 1, 0)]) \
        .withColumn("features", F.array().cast("array<string>"))
    det = spark.createDataFrame([("x:1", 900.0, 2.0, 99.0, "long text", ["Balkon", "Keller"])],
                                "listing_id string, price double, rooms double, sqm double, description string, "
                                "features array<string>")
    r = E.enrich(li, det).first()
    assert (r.price, r.rooms, r.sqm, r.description, r.features, r.missing) == \
        (900.0, 2.0, 45.0, "long text", ["Balkon", "Keller"], [])
    rows = R.result_rows(E.enrich(li, det).withColumn("search_type", F.lit("")), "2024-01-01").first()
    assert rows.features == "Balkon, Keller" and rows.search_type is None and rows.status == "new"


def test_inheritance(spark):
    raw = spark.createDataFrame([(1, "https://a/x", "1200", "3"), (2, "https://a/y", "", None)],
                                "search_id long, url string, max_rent string, min_rooms string")
    for c in ("enabled", "label", "source_type", "search_type", "radius_km", "min_rent", "max_rooms", "min_sqm",
              "max_sqm", "required_keywords", "excluded_keywords"):
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    d = spark.createDataFrame([(None, 1400.0, 2.0, None, None, None, [], ["tausch"])],
                              "min_rent double, max_rent double, min_rooms double, max_rooms double, min_sqm double, "
                              "max_sqm double, required_keywords array<string>, excluded_keywords array<string>")
    out = {r.search_id: r for r in S.read_searches(raw, d).collect()}
    assert (out[1].max_rent, out[1].min_rooms) == (1200.0, 3.0)
    assert (out[2].max_rent, out[2].min_rooms, out[2].excluded_keywords) == (1400.0, 2.0, ["tausch"])
    assert out[1].enabled and out[1].source_type == "rss"


def test_availability(spark):
    res = spark.createDataFrame(
        [("k:1", "new"), ("k:2", "new"), ("k:3", None), ("k:4", "interested"), ("k:5", "new")],
        "listing_id string, status string")
    fetch = spark.createDataFrame(
        [("k:1", 200, "alles gut"), ("k:2", 200, "Anzeige wurde gelöscht"), ("k:3", 404, None),
         ("k:4", 410, None), ("k:5", 403, None)], "listing_id string, http_status int, body string")
    upd = {r.listing_id: r for r in R.availability_updates(res, fetch, "2024-01-01").collect()}
    assert set(upd) == {"k:1", "k:2", "k:3", "k:4"}
    assert upd["k:1"].available is None and upd["k:1"].status is None
    assert upd["k:2"].status == "expired" and upd["k:3"].status == "expired" and upd["k:4"].status is None
    assert upd["k:4"].available is False


def test_run_status(spark):
    def status(events):
        df = spark.createDataFrame(events, "run_id string, phase string, level string, message string, source string")
        df = df.withColumn("seq", F.monotonically_increasing_id()).withColumn("count", F.lit(None).cast("bigint")) \
            .withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("host", F.lit("h"))
        return RL.run_records(df).first().status
    ok = ("r", "fetch_source", "info", "ok", "a")
    assert status([ok, ("r", "fetch_source", "error", "failed: x", "b")]) == "partial"
    assert status([("r", "fetch_source", "error", "failed: x", "a"),
                   ("r", "fetch_source", "warning", "403_blocked: y", "b")]) == "failed"
    assert status([ok, ("r", "fetch_source", "warning", "enrich failed: z", "a")]) == "success"


def test_health(spark):
    hb = spark.createDataFrame([("a", "2024-01-01 00:00:00", 0), ("b", "2024-01-01 00:00:00", 3),
                                ("c", "2023-12-31 23:56:40", 0)], "host string, t string, consecutive_failures long")
    hb = hb.withColumn("finished_at", F.col("t").cast("timestamp_ntz"))
    out = {r.host: r.healthy for r in H.health_verdict(hb, "2024-01-01 00:00:00", 100, 3).collect()}
    assert out == {"a": True, "b": False, "c": False}


# Adverts of our own; the class and attribute names are the portal's (fixed values).
PORTAL_PAGE = """<html><body>
<article data-adid='41' class='aditem is-top'><div class='aditem-image'><a href="/x"><img data-src="lazy.jpg" src='https://pics/41.png'></a></div>
 <div class="aditem-main--top--left"><i class="pin"></i> 99423 <div>Weimar</div> West </div>
 <h2><a href="/s-anzeige/hof?a=1&amp;b=2" class="ellipsis">Hof &ndash; 2&nbsp;Zimmer</a></h2>
 <p class="x aditem-main--middle--description">Ofen &amp; Garten, ab&hellip; f&#252;r 2</p>
 <p class="aditem-main--middle--price-shipping--price"> 512,50 &euro; VB </p>
 <span class="simpletag">2 Zimmer</span><span class="simpletag">47,5 m&sup2;</span></article>
<article class="aditem-promo" data-adid="42"><a class="ellipsis" href="/promo">no card</a></article>
<article class="aditem" data-adid="43"><a class="ellipsis" href="https://other.example/a/43">Loft</a>
 <div class="aditem-image"><img data-imgsrc="https://pics/43.png"></div>
 <p class="aditem-main--middle--price-shipping--price">zu verschenken</p></article>
<article class="aditem" data-adid="44"><a class="ellipsis">no link</a></article>
<article class="aditem" data-adid="45"><a class="ellipsis" href="/y"> </a></article>
</body></html>"""


def test_portal_cards(spark):
    pages = spark.createDataFrame([(1, "https://portal.example/mieten/c88", PORTAL_PAGE)], "page_id long, url string, body string")
    a, b = X.extract_cards(pages, X.PORTAL_SPEC).orderBy("pos").collect()
    assert (a.listing_id, a.url) == ("kleinanzeigen:41", "https://portal.example/s-anzeige/hof?a=1&b=2")
    assert (a.title, a.description) == ("Hof – 2\u00a0Zimmer", "Ofen & Garten, ab… für 2")
    assert (a.price, a.rooms, a.sqm, a.thumbnail) == (512.5, 2.0, 47.5, "https://pics/41.png")
    assert a.location == "99423 Weimar West"
    assert (b.listing_id, b.url, b.thumbnail) == ("kleinanzeigen:43", "https://other.example/a/43", "https://pics/43.png")
    assert (b.price, b.rooms, b.sqm, b.location) == (None, None, None, None)


DETAIL_PAGE = """<h2 class="big" id='viewad-price'>612 &euro;</h2><ul>
<li class='addetailslist--detail'>Wohnfl&auml;che:<span class='addetailslist--detail--value'>49,5 m&sup2;</span></li>
<li class="addetailslist--detail">Zimmer <span data-x="1" class="addetailslist--detail--value">1,5</span></li>
<li class="addetailslist--detail">Etage<span class="addetailslist--detail--value">DG</span></li>
<li class="addetailslist--detail">Verf&#252;gbar ab<span class="addetailslist--detail--value">sofort</span></li>
<li class="addetailslist--detail">Kaution<span class="addetailslist--detail--value">zwei Mieten</span></li>
<li class="addetailslist--detail">Warmmiete<span class="addetailslist--detail--value">auf Anfrage</span></li>
<li class="addetailslist--detail">Warmmiete<span class="addetailslist--detail--value">700</span></li>
<li class="addetailslist--details">Badezimmer<span class="addetailslist--detail--value">8</span></li>
</ul><div><span class="checklisttag"><b>Ofen</b></span><li class="checklisttag on">Garten</li></div>
<p id="viewad-description-text">Zwei <b>helle</b> R&auml;ume</p>"""


def test_detail_page(spark):
    pages = spark.createDataFrame([(1, DETAIL_PAGE), (2, "<p>nothing</p>"), (3, None)], "page_id long, body string")
    out = {r.page_id: r for r in X.extract_details(pages).collect()}
    d = out[1]
    assert (d.price, d.sqm, d.rooms, d.floor, d.available_from, d.deposit) == (612.0, 49.5, 1.5, "DG", "sofort", "zwei Mieten")
    assert d.warm_rent is None  # the first value counts, even when it is no number
    assert d.bathrooms is None and d.bedrooms is None
    assert d.features == ["Ofen", "Garten"] and d.description == "Zwei helle Räume"
    assert out[2].price is None and out[2].sqm is None and out[2].features == []


def test_feed_items(spark):
    items = spark.createDataFrame([
        (1, "<item><title>3 Zimmer Wohnung 750 €</title><link>https://f/1</link><guid>listing-1</guid>"
            "<description>Schön, 70 m2</description></item>"),
        (2, "<item><title>Ohne Text</title><link>https://f/2</link></item>"),
        (3, "<item><title></title><link>https://f/3</link></item>")], "n long, item_xml string")
    out = {r.n: r for r in X.extract_feed_items(items).collect()}
    assert set(out) == {1, 2}
    assert out[1].listing_id == "rss:listing-1" and out[1].rooms == 3.0 and out[1].price == 750.0
    assert out[1].sqm == 70.0 and out[2].description is None and out[2].listing_id.startswith("rss:")


def test_fetch_outcome(spark):
    df = spark.createDataFrame([(403,), (500,), (429,), (404,), (None,), (200,)], "status int")
    got = [r.o for r in df.select(V.fetch_outcome("status").alias("o")).collect()]
    assert got == ["blocked", "retryable", "failed", "failed", "retryable", "ok"]


def test_error_summary_bound_is_exact(spark):
    for names in ([f"s{i}" for i in range(1500)], ["a"] * 1500, [""] * 1400):
        rows = [("r", i, "fetch_source", "error", "failed: x", n) for i, n in enumerate(names)]
        df = spark.createDataFrame(rows, "run_id string, seq long, phase string, level string, message string, "
                                         "source string")
        df = df.withColumn("count", F.lit(None).cast("bigint")) \
            .withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("host", F.lit("h"))
        r = RL.summarize_runs(df).first()
        assert r.failed_sources == len(names)
        whole = "failed_sources=" + ",".join(names)
        assert r.error_summary == whole
        assert RL.run_payload(RL.summarize_runs(df)).first().error_summary == whole[:2000]


def test_match_all_by_price_buckets_equals_all_pairs(spark):
    s = spark.createDataFrame([(i, "", float(100 * i)) for i in range(1, 8)],
                              "search_id long, search_type string, max_rent double")
    for c in ("min_rent", "min_rooms", "max_rooms", "min_sqm", "max_sqm"):
        s = s.withColumn(c, F.lit(None).cast("double"))
    s = s.withColumn("required_keywords", F.array().cast("array<string>")) \
        .withColumn("excluded_keywords", F.array().cast("array<string>"))
    rows = [(f"x:{i}", "x", "t", "u", float(70 * i), None, None, None, None, None, 1, 1, i) for i in range(12)]
    li = _listings(spark, rows)
    li = li.unionByName(_listings(spark, [("x:none", "x", "t", "u", None, None, None, None, None, None, 1, 1, 99)]))
    got = {(r.listing_id, r.match_search_id) for r in M.match_all(li, s).collect()}
    want = {(f"x:{i}", k) for i in range(12) for k in range(1, 8) if 70 * i <= 100 * k} | {("x:none", k) for k in range(1, 8)}
    assert got == want


def test_feed_files_and_backlog_files(spark, tmp_path):
    feed = tmp_path / "feed.xml"
    feed.write_text("<rss><channel><item><title>2 Zimmer 65 m2</title><link>https://f/1</link>"
                    "<guid>g1</guid><description>700 € warm</description></item>"
                    "<item><title></title><link>https://f/2</link></item></channel></rss>", encoding="utf-8")
    items = X.read_feed_items(spark, str(feed)).collect()
    # The keyword windows keep the source's quirk: 12 characters
    # before "m2" reach back to "2 Zimmer", and before "€" to "r 65 m2 700 €".
    assert [(r.listing_id, r.rooms, r.sqm, r.price) for r in items] == [("rss:g1", 2.0, 2.0, 65.0)]
    runs = spark.createDataFrame([("r1", "success")], "run_id string, status string")
    events = spark.createDataFrame([("r1", 1, "run_start", "info", "m", None, None, 0, None, "e1")],
                                   RL.RUN_EVENT_SCHEMA)
    where = RL.write_runs(runs, events, str(tmp_path / "db"), str(tmp_path / "q"))
    assert where == "primary"
    lines = RL.backlog_lines(runs, events)
    lines.write.text(str(tmp_path / "backlog"))
    r, e = RL.read_run_backlog_files(spark, str(tmp_path / "backlog"))
    assert r.first().run_id == "r1" and e.first().event_id == "e1"
    p = R.write_version(runs, str(tmp_path / "results"), 1)
    assert spark.read.parquet(p).count() == 1
