"""Registered queries: the cycle from landed pages and feeds (I1 with A1, A2, A4, A5, A8, A9, D5, I4, J3).

The listings of the L adapter, one search per supplier, are rendered in the portal's markup
and as feed bodies, landed in three polls, and the stream reads them back.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html_escape
from ..operators.runlog import is_failed_source
from ..sources import extract as X
from ..sources import pages as P
from ..streaming import page_stream as S
from . import adapters as A
from ._common import active_dim, clean_searches, scratch
from .oracle_adapters import per_supplier_sql, staged_ctes, with_ctes
from .registry import register

POLLS, PER_PAGE, MAX_PAGES, MAX_ATTEMPTS = 3, 40, 20, 2
NOW = "2024-02-01 00:00:00"
LINES = ", ".join(A.LINE_KEY)
#: Between the numbers of a feed text, longer than a keyword's window.
WORD = " Wohngelegenheit "


def adverts(t):
    """The listings of the active searches with their poll, kind and place on a page."""
    g = A.supplier_tables(t)
    li = A.listings(g).join(active_dim(g).select("search_id"), "search_id", "left_semi")
    w = Window.partitionBy("search_id", "chunk", "kind").orderBy(*A.LINE_KEY)
    li = li.withColumns({"chunk": (F.col("l_orderkey") % POLLS).cast("int"),
                         "kind": F.when(F.col("source") == "feed", S.FEED).otherwise(S.PAGE),
                         # Two decimals in feeds: a keyword's window holds twelve characters.
                         "price": F.when(F.col("source") == "feed", F.floor(F.col("price") * 100) / 100).otherwise(F.col("price")),
                         "native": F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))})
    n = F.row_number().over(w) - 1
    return g, li.withColumns({"page_no": F.when(F.col("kind") == S.FEED, 1).otherwise(F.floor(n / PER_PAGE) + 1).cast("int"), "pos": n})


def number(c):
    """A number as German text; null stays null."""
    return F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))


def optional(before: str, value, after: str):
    return F.coalesce(F.concat(F.lit(before), value, F.lit(after)), F.lit(""))


def card(odd):
    """An advert in the portal's markup; ``odd`` ones have other quotes, an unclosed element and deeper ones."""
    pick = lambda a, b: F.when(odd, F.lit(a)).otherwise(F.lit(b))
    return F.concat(
        pick("<article data-adid=", "<article class='x aditem' data-adid=\""), F.col("native"), pick(" class=aditem>", '">'),
        optional('<div class="aditem-image"><img src="', F.col("thumbnail"), '"></div>'),
        pick("<div class=aditem-main--top--left><div><div><div><div>", '<div class="aditem-main--top--left">'),
        html_escape("location"), pick("</div></div></div></div></div>", "</div>"),
        pick("<a href=/s-anzeige/", "<h2><a class=\"ellipsis\" href='/s-anzeige/"), F.col("native"), pick(" class=ellipsis>", "'>"),
        html_escape("title"), pick("</a><b>", "</a></h2>"), F.lit('<p class="aditem-main--middle--description">'), html_escape("description"),
        F.lit("</p>"), optional('<p class="aditem-main--middle--price-shipping--price">', number("price"), " &euro;</p>"),
        optional('<span class="simpletag">', number("rooms"), " Zimmer</span>"),
        optional('<span class="simpletag">', number("sqm"), " m&sup2;</span>"), F.lit("</article>"))


def feed_text():
    return F.concat("description", F.lit(WORD), optional("", number("price"), " €"), F.lit(WORD),
                    optional("", number("rooms"), " Zimmer"), F.lit(WORD), optional("", number("sqm"), " m²"))


def landings(t):
    """(pages and feeds in ``PAGE_SCHEMA`` with ``kind`` and ``chunk``, the tables with the searches).

    Some first pages are blocked, some third pages and feeds fail, some second pages answer at the second try."""
    g, li = adverts(t)
    odd = F.col("l_linenumber") % 2 == 1
    item = X.feed_item_xml(F.col("title"), F.concat(F.lit("https://listings.example/feed/"), "native"), F.col("native"), feed_text())
    html = F.when(F.col("kind") == S.FEED, item).otherwise(card(odd))
    body = F.array_join(F.sort_array(F.collect_list(F.struct("pos", html.alias("h")))).getField("h"), "\n")
    pages = li.groupBy("search_id", "chunk", "kind", "page_no").agg(body.alias("inner"))
    feed, k = F.col("kind") == S.FEED, F.col("search_id") + F.col("chunk")
    body = F.when(feed, F.concat(F.lit("<rss><channel>"), "inner", F.lit("</channel></rss>"))).otherwise(
        F.concat(F.lit("<html><body><ul>"), "inner", F.lit("</ul></body></html>")))
    status = (F.when(feed & (k % 13 == 4), F.lit(None).cast("int")).when(~feed & (k % 11 == 3) & (F.col("page_no") == 1), 403)
              .when(~feed & (k % 11 == 5) & (F.col("page_no") == 3), 500).otherwise(200))
    twice = ~feed & (k % 11 == 7) & (F.col("page_no") == 2)
    tries = F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    pages = pages.withColumns({"body": body, "status": status, "attempt": F.explode(tries)})
    pages = pages.withColumn("status", F.when(twice & (F.col("attempt") == 0), 503).otherwise(F.col("status")))
    url = F.concat(F.lit("https://www.kleinanzeigen.de/s-wohnung/"), F.col("search_id").cast("string"), F.lit("/"),
                   F.col("page_no").cast("string"))
    return g, pages.select(
        "chunk", "kind", F.col("search_id").cast("bigint").alias("search_id"), "page_no", url.alias("url"), "attempt", "status",
        F.when(F.col("status").isNull(), "timeout").alias("error"), F.lit(NOW).cast("timestamp_ntz").alias("fetched_at"),
        F.when(F.col("status") == 200, F.col("body")).alias("body"))


def detail_pages(t):
    """A portal detail page for every listing with details."""
    d = A.detail_rows(t).where(F.col("listing_id").startswith("board:"))
    item = lambda label, value: optional(f'<li class="addetailslist--detail">{label}<span class="addetailslist--detail--value">',
                                         value, "</span></li>")
    checks = F.array_join(F.transform("features", lambda x: F.concat(F.lit("<span class=checklisttag>"), html_escape(x), F.lit("</span>"))), "")
    body = F.concat(F.lit("<h2 id=viewad-price>"), number("price"), F.lit(" &euro;</h2><ul>"), item("Zimmer:", number("rooms")),
                    item("Wohnfläche:", number("sqm")), item("Etage", F.col("floor")), item("Warmmiete", number("warm_rent")),
                    item("Wohnungstyp", F.col("apartment_type")), F.lit("</ul>"), checks,
                    F.lit("<p id='viewad-description-text'>"), html_escape("description"), F.lit("</p>"))
    return d.select(F.concat(F.lit("kleinanzeigen:"), F.substring_index("listing_id", ":", -1)).alias("listing_id"), body.alias("body"))


def deliver(outbox, batch_id):
    """Stands in for the sender: a message arrives unless its hash says otherwise."""
    digit = F.substring(F.sha1(F.concat("listing_id", F.lit(f":{batch_id}")).cast("binary")), 1, 1)
    return outbox.select("listing_id", (~digit.isin("0", "1", "2", "3")).alias("any_sent"))


def run_pages(t, name):
    """The stream over three landings; the folder with its sinks."""
    base, spark = scratch(t, name), t.spark
    g, landed = landings(t)
    landed.write.partitionBy("chunk", "kind").parquet(f"{base}/rendered")
    detail_pages(t).write.parquet(f"{base}/detail_pages")
    columns = [c.split()[0] for c in P.PAGE_SCHEMA.split(", ")]
    for poll in range(POLLS):
        for kind in (S.PAGE, S.FEED):
            rows = spark.read.schema(landed.schema).parquet(f"{base}/rendered").where((F.col("chunk") == poll) & (F.col("kind") == kind))
            rows.select(*columns).write.mode("append").parquet(f"{base}/{kind}")
        # The poll is all that is new, however many files it has: one batch.
        S.run_page_stream(spark, f"{base}/{S.PAGE}", f"{base}/{S.FEED}", clean_searches(g), f"{base}/seen", f"{base}/results",
                          f"{base}/outbox", f"{base}/ckpt", NOW, prime=False,
                          detail_pages=spark.read.parquet(f"{base}/detail_pages"), deliver=deliver, max_pages=MAX_PAGES,
                          max_attempts=MAX_ATTEMPTS, runs_path=f"{base}/log").awaitTermination()
    return base


_NATIVE = "CAST(l_partkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"
_TEXT = lambda c: f"replace(CAST({c} AS VARCHAR), '.', ',')"
_LANDED = {
    "placed": f"""SELECT l.* EXCLUDE (features) REPLACE (CASE WHEN l.source = 'feed' THEN floor(l.price * 100) / 100 ELSE l.price END AS price), {_NATIVE} AS native, CAST(l_orderkey % {POLLS} AS INTEGER) AS chunk,
  CASE WHEN l.source = 'feed' THEN 'feed' ELSE 'page' END AS kind,
  row_number() OVER (PARTITION BY search_id, l_orderkey % {POLLS}, l.source ORDER BY {LINES}) - 1 AS pos
FROM listings l WHERE search_id IN (SELECT search_id FROM searches WHERE enabled AND url <> '')""",
    "paged": f"SELECT *, CASE WHEN kind = 'feed' THEN 1 ELSE pos // {PER_PAGE} + 1 END AS page_no FROM placed",
    "ok": """SELECT * FROM paged WHERE CASE WHEN kind = 'feed' THEN (search_id + chunk) % 13 <> 4
  ELSE NOT ((search_id + chunk) % 11 = 3) AND NOT ((search_id + chunk) % 11 = 5 AND page_no >= 3) END""",
    "walk": """SELECT *, min(page_no) OVER (PARTITION BY search_id, chunk, kind, native) AS first_page FROM ok""",
    "stale": """SELECT w.search_id, w.chunk, min(w.page_no) AS cut FROM (SELECT search_id, chunk, page_no, count(*) FILTER (WHERE first_page = page_no) AS fresh
FROM walk WHERE kind = 'page' GROUP BY 1, 2, 3) w WHERE fresh = 0 GROUP BY 1, 2""",
    "landed": f"""SELECT w.search_id, w.chunk, w.kind, w.page_no, w.pos, title,
  CASE WHEN w.kind = 'feed' THEN 'rss:' ELSE 'kleinanzeigen:' END || native AS listing_id,
  CASE WHEN w.kind = 'feed' THEN 'rss' ELSE 'kleinanzeigen' END AS source, price, rooms, sqm,
  CASE WHEN w.kind = 'page' THEN location END AS location,
  CASE WHEN w.kind = 'page' THEN description ELSE trim(description || '{WORD}' || coalesce({_TEXT('price')} || ' €', '') || '{WORD}' ||
       coalesce({_TEXT('rooms')} || ' Zimmer', '') || '{WORD}' || coalesce({_TEXT('sqm')} || ' m²', '')) END AS description
FROM walk w LEFT JOIN stale s ON s.search_id = w.search_id AND s.chunk = w.chunk AND w.kind = 'page'
WHERE w.first_page = w.page_no AND w.page_no <= {MAX_PAGES} AND (s.cut IS NULL OR w.page_no < s.cut)""",
    "portal": "SELECT * REPLACE ('kleinanzeigen:' || split_part(listing_id, ':', 2) AS listing_id) FROM details WHERE listing_id LIKE 'board:%'"}
_ORDER = ", ".join(S.PAGE_ORDER)
_SENT = "substr(sha1(k.listing_id || ':{b}'), 1, 1) NOT IN ('0', '1', '2', '3')"


def _sql(body: str) -> str:
    ctes = with_ctes("listings", "searches", "details", extra=_LANDED).rstrip("\n")
    return per_supplier_sql(ctes + ",\n" + staged_ctes(POLLS, _ORDER, details="portal", portal="kleinanzeigen", sent=_SENT,
                                                       max_attempts=MAX_ATTEMPTS) + body)


_EACH = lambda sql: "\nUNION ALL ".join(sql.format(b=b) for b in range(POLLS))


@register("stream_pages", sql=_sql(_EACH("""
SELECT listing_id, title, source, price, rooms, sqm, location, description, floor, warm_rent,
       CASE WHEN len(features) > 0 THEN array_to_string(features, ', ') END AS features, CAST({b} AS BIGINT) AS batch_id FROM stored{b}""")))
def q_stream_pages(t):
    """Three landings of pages and feeds through the stream, with details, delivery and the run log: the results."""
    return t.spark.read.parquet(f"{run_pages(t, 'pages')}/results").select(
        "listing_id", "title", "source", "price", "rooms", "sqm", "location", "description", "floor", "warm_rent", "features",
        F.col("batch_id").cast("bigint").alias("batch_id"))


@register("stream_pages_runs", sql=_sql(_EACH("""
SELECT CAST({b} AS BIGINT) AS batch_id, (SELECT count(*) FROM landed WHERE chunk = {b}) AS fetched, (SELECT count(*) FROM first{b}) AS filtered,
       (SELECT count(*) FROM kept{b}) AS new, (SELECT count(*) FROM status{b} WHERE any_sent AND NOT over) AS notified,
       (SELECT count(*) FROM (SELECT DISTINCT search_id, kind FROM placed WHERE chunk = {b}) s) AS sources_polled,
       (SELECT count(*) FROM (SELECT DISTINCT search_id, kind FROM placed WHERE chunk = {b}) s WHERE CASE WHEN kind = 'feed'
          THEN (search_id + {b}) % 13 = 4 ELSE (search_id + {b}) % 11 = 3 END) AS failed_sources,
       (SELECT count(*) FROM (SELECT DISTINCT search_id, kind FROM placed WHERE chunk = {b}) s WHERE kind = 'feed' AND (search_id + {b}) % 13 = 4)
         + (SELECT count(*) FROM status{b} WHERE settled AND NOT any_sent) AS errors""")))
def q_stream_pages_runs(t):
    """J3 of the same stream: the run that each batch logs, and the failed sources among its events."""
    log = f"{run_pages(t, 'pages_runs')}/log"
    events = t.spark.read.parquet(f"{log}/events")
    failed = events.groupBy(F.col("batch_id").alias("b")).agg(F.count_if(is_failed_source()).alias("failed_sources"))
    runs = t.spark.read.parquet(f"{log}/runs")
    return runs.join(failed, runs["batch_id"] == failed["b"]).select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "fetched", "filtered", "new", "notified", "sources_polled",
        "failed_sources", "errors")
