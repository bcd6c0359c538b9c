"""Registered queries: extraction and scalar expressions over pages, documents,
searches and listings (A1-A8, B2, B7-B11, B18-B21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import (bounded_text, format_attrs, html_escape, is_removed_text, keyword_window, node_text,
                         page_url, stable_id, strip_text, url_origin, with_radius)
from ..sources import extract as X
from ..sources import pages as P
from . import adapters as A
from ._common import clean_searches, scratch
from .oracle_adapters import format_attrs_sql, html_escape_sql, with_ctes
from .registry import register

MAX_PAGES = 20
# The references that occur in the test pages.
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&ndash;", "–"),
             ("&#8364;", "€"), ("&euro;", "€"), ("&auml;", "ä"), ("&amp;", "&"), ("&amp", "&")]


def _decode_sql(x: str) -> str:
    s = x
    for a, b in _ENTITIES:
        s = f"replace({s}, '{a}', '{b}')"
    return s


def node_text_sql(x: str) -> str:
    h = f"regexp_replace({x}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '<x>', 'g')"
    pieces = f"list_transform(string_split_regex({h}, '<[^>]*>'), lambda p: trim({_decode_sql('p')}, ' \t\n\r\x0b\x0c'))"
    return f"nullif(array_to_string(list_filter({pieces}, lambda p: p <> ''), ' '), '')"


def pages(t):
    """P: the pages table as landed search pages."""
    return t.pages.select("page_id", (F.col("page_id") % A.N_SEARCHES).alias("search_id"), "url",
                          F.col("html").alias("body"))


@register("scan_pages", sql="""
SELECT page_id % 25 AS search_id, url, length(html) AS n_chars FROM pages""")
def q_scan_pages(t):
    """A1: the pages landed in their schema and read with it."""
    path = f"{scratch(t, 'scan_pages')}/landed"
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    pages(t).select("search_id", F.lit(1).alias("page_no"), "url", null("attempt", "int"), F.lit(200).alias("status"),
                    null("error", "string"), null("fetched_at", "timestamp_ntz"), "body").write.parquet(path)
    return P.read_pages(t.spark, path).select("search_id", "url", F.length("body").alias("n_chars"))


@register("extract_cards", sql=f"""
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, 'board:' || substr(sha1(link), 1, 16) AS listing_id, title, link AS url
FROM (SELECT page_id, pos, {node_text_sql('t')} AS title, h,
             CASE WHEN h SIMILAR TO '[A-Za-z][A-Za-z0-9+.\\-]*:.*' THEN h
                  WHEN starts_with(h, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1) || ':' || h
                  WHEN starts_with(h, '/') OR starts_with(h, '?') OR starts_with(h, '#') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || h
                  ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || '/' || h END AS link
      FROM (SELECT page_id, url, pos, regexp_extract(card, '<a href="([^"]*)">', 1) AS h,
                   regexp_extract(card, '<a href="[^"]*">(.*?)</a>', 1) AS t
            FROM (SELECT page_id, url, unnest(cards) AS card, unnest(generate_series(1, len(cards))) AS pos
                  FROM (SELECT page_id, url, regexp_extract_all(html, '(<li><a href="[^"]*">.*?</a></li>)', 1) AS cards FROM pages) a) b) c) d
WHERE title IS NOT NULL AND h IS NOT NULL AND h <> ''""")
def q_extract_cards(t):
    """A2 + B2 + B7 + B21: every navigation link of a page as a card."""
    c = X.extract_cards(pages(t), X.LINK_SPEC, keep=["page_id", "url"])
    return c.select("page_id", "pos", "listing_id", "title", "url")


@register("url_origin", sql="""
SELECT page_id, CASE WHEN o <> '' THEN o ELSE 'https://www.kleinanzeigen.de' END AS origin
FROM (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)', 1) AS o FROM pages) x""")
def q_url_origin(t):
    """Scheme and authority of every page URL."""
    return t.pages.select("page_id", url_origin("url").alias("origin"))


@register("stable_id", sql="""
SELECT page_id, 'page:' || coalesce(nullif(CASE WHEN page_id % 2 = 1 THEN CAST(page_id AS VARCHAR) ELSE '' END, ''),
                                    substr(sha1(url), 1, 16)) AS listing_id FROM pages""")
def q_stable_id(t):
    """B2: native ids for odd pages, URL hashes for the others."""
    native = F.when(F.col("page_id") % 2 == 1, F.col("page_id").cast("string")).otherwise(F.lit(""))
    return t.pages.select("page_id", stable_id(F.lit("page"), native, "url").alias("listing_id"))


@register("node_text", sql=f"""
SELECT page_id, {node_text_sql("html")} AS text FROM pages""")
def q_node_text(t):
    """The text of every whole page, entities decoded."""
    return t.pages.select("page_id", node_text("html").alias("text"))


@register("html_escape", sql=f"""
SELECT page_id, {html_escape_sql("html")} AS escaped FROM pages""")
def q_html_escape(t):
    """Every whole page escaped for HTML."""
    return t.pages.select("page_id", html_escape("html").alias("escaped"))


def detail_pages(t):
    """A portal detail page per part, in the portal's markup: attributes in either order and quote, entities.
    The parts are dealt out before, by a number that stays: a row is small, the scan of its page is not."""
    n = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    p, s = lambda c: F.col(c).cast("string"), F.lit
    item = lambda i, label, value: F.concat(
        s(["<li class='addetailslist--detail' data-n=\"1\">", '<li id="a" class="x addetailslist--detail">'][i % 2] + label),
        s('<span class="addetailslist--detail--value">'), value, s("</span></li>"))
    items = [item(0, "Wohnfl&auml;che:", F.concat(p("p_size"), s(",5 m&sup2;"))),
             item(1, "Zimmer", F.when(F.col("p_size") % 5 == 0, s("auf Anfrage")).otherwise(p("p_size"))),
             item(0, "Zimmer", s("99")), item(1, "Etage", F.col("p_brand")), item(0, "Verf&#252;gbar ab", html_escape("p_type")),
             item(1, "Kaution / Anteile", F.concat(p("p_partkey"), s(" &euro;")))]
    body = F.concat(s("<h2 class='big' id='viewad-price'>"), (F.col("p_partkey") % 4000).cast("string"), s(" &euro;</h2><ul>"),
                    *items, s("</ul><div><span class=\"checklisttag\"><b>"), html_escape("p_brand"),
                    s("</b></span><li class='checklisttag on'>Garten</li></div><p id=\"viewad-description-text\">Teil <i>"),
                    html_escape("p_name"), s("</i> &ndash; neu</p>"))
    return t.part.repartition(n, "p_partkey").select(F.col("p_partkey").alias("page_id"), body.alias("body"))


@register("extract_details", sql="""
SELECT p_partkey AS page_id, CAST(p_partkey % 4000 AS DOUBLE) AS price, p_size + 0.5::DOUBLE AS sqm,
       CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS rooms, p_brand AS floor, p_type AS available_from,
       CAST(p_partkey AS VARCHAR) || ' €' AS deposit, p_brand || '|Garten' AS features, 'Teil ' || p_name || ' – neu' AS description
FROM part""")
def q_extract_details(t):
    """A4: every field of a detail page per part."""
    d = X.extract_details(detail_pages(t))
    return d.select("page_id", "price", "sqm", "rooms", "floor", "available_from", "deposit",
                    F.array_join("features", "|").alias("features"), "description")


@register("detail_pairs", sql="""
SELECT p_partkey AS page_id, CAST(pos AS INTEGER) AS pos, label, value FROM (
  SELECT p_partkey, unnest([0, 1, 2, 3, 4, 5]) AS pos,
         unnest(['wohnfläche', 'zimmer', 'zimmer', 'etage', 'verfügbar ab', 'kaution / anteile']) AS label,
         unnest([CAST(p_size AS VARCHAR) || ',5 m²', CASE WHEN p_size % 5 = 0 THEN 'auf Anfrage' ELSE CAST(p_size AS VARCHAR) END,
                 '99', p_brand, p_type, CAST(p_partkey AS VARCHAR) || ' €']) AS value FROM part) x""")
def q_detail_pairs(t):
    """A4, first half: the label/value pairs of a detail page per part."""
    return X.detail_pairs(detail_pages(t)).select("page_id", "pos", "label", "value")


@register("feed_items", sql="""
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'rss:' || substr(sha1('https://f/' || p_partkey), 1, 16)
            ELSE 'rss:' || p_partkey END AS listing_id, p_name AS title, 'https://f/' || p_partkey AS url,
       CAST(p_size AS DOUBLE) AS price, p_type || ' für ' || p_size || ' €' AS description
FROM part WHERE p_size % 7 <> 0""")
def q_feed_items(t):
    """A5: feed bodies of about ten parts, every other one Atom, split into items and parsed."""
    key = F.col("p_partkey").cast("string")
    link = F.concat(F.lit("https://f/"), key)
    title = F.when(F.col("p_size") % 7 != 0, F.col("p_name")).otherwise(F.lit(""))
    text = F.concat("p_type", F.lit(" für "), F.col("p_size").cast("string"), F.lit(" €"))
    guid = F.when(F.col("p_partkey") % 3 != 0, key)
    rss = X.feed_item_xml(title, link, guid, text)
    atom = F.concat(F.lit("<entry><title>"), html_escape(title), F.lit('</title><link rel="self" href="https://self/"/><link href="'),
                    link, F.lit('"/>'), F.when(guid.isNotNull(), F.concat(F.lit("<id>"), guid, F.lit("</id>"))).otherwise(F.lit("")),
                    F.lit("<summary>"), html_escape(text), F.lit("</summary></entry>"))
    feed = F.floor(F.col("p_partkey") / 10).alias("feed")
    is_atom = F.col("feed") % 2 == 1
    bodies = t.part.select(feed, rss.alias("rss"), atom.alias("atom")).groupBy("feed").agg(
        F.concat(F.lit("<feed>"), F.array_join(F.collect_list(F.when(is_atom, F.col("atom")).otherwise(F.col("rss"))), "\n"),
                 F.lit("</feed>")).alias("body"))
    out = X.extract_feed_items(X.split_feed(bodies), keep=["feed"])
    return out.select(F.regexp_extract("url", "[0-9]+$", 0).cast("bigint").alias("id"), "listing_id", "title", "url", "price", "description")


@register("keyword_window", sql="""
SELECT doc_id, CASE WHEN p1 > 0 THEN substr(text, greatest(1, p1 - 12), p1 + 1 - greatest(1, p1 - 12))
                    WHEN p2 > 0 THEN substr(text, greatest(1, p2 - 12), p2 + 3 - greatest(1, p2 - 12))
                    WHEN p3 > 0 THEN substr(text, greatest(1, p3 - 12), p3 + 5 - greatest(1, p3 - 12)) END AS window
FROM (SELECT doc_id, text, strpos(lower(text), '€') AS p1, strpos(lower(text), 'eur') AS p2,
             strpos(lower(text), 'miete') AS p3 FROM documents) d""")
def q_keyword_window(t):
    """The price window of every document (keywords in list order)."""
    return t.documents.select("doc_id", keyword_window("text", ["€", "eur", "miete"]).alias("window"))


@register("bounded_text", sql="SELECT doc_id, substr(text, 1, 2000) AS bounded FROM documents")
def q_bounded_text(t):
    """Document texts bounded to 2000 characters."""
    return t.documents.select("doc_id", bounded_text("text").alias("bounded"))


@register("removed_markers", sql="""
SELECT doc_id, contains(lower(text), 'ist nicht mehr verfügbar') OR contains(lower(text), 'wurde gelöscht')
  OR contains(lower(text), 'nicht mehr verfügbar') OR contains(lower(text), 'anzeige wurde nicht gefunden') AS removed
FROM documents""")
def q_removed_markers(t):
    """Removal markers in whole document texts."""
    return t.documents.select("doc_id", is_removed_text("text").alias("removed"))


@register("strip_text", sql="""
SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS stripped FROM conversations""")
def q_strip_text(t):
    """Conversation texts with white space stripped off both ends."""
    return t.conversations.select("conv_id", "turn", strip_text("text").alias("stripped"))


_URL_PARTS = "'^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)?([^?#]*)(.*)$'"


def _page_url_sql(u: str, n: str) -> str:
    segs = (f"list_filter(string_split(regexp_extract({u}, {_URL_PARTS}, 2), '/'), "
            f"lambda s: s <> '' AND NOT regexp_matches(s, '^seite:\\d+$'))")
    paged = (f"CASE WHEN len({segs}) > 0 AND regexp_matches({segs}[-1], 'c\\d') "
             f"THEN list_concat({segs}[1:len({segs}) - 1], ['seite:' || CAST({n} AS VARCHAR)], [{segs}[-1]]) "
             f"ELSE list_append({segs}, 'seite:' || CAST({n} AS VARCHAR)) END")
    final = f"CASE WHEN {n} > 1 THEN {paged} ELSE {segs} END"
    return (f"regexp_extract({u}, {_URL_PARTS}, 1) || '/' || array_to_string({final}, '/') || "
            f"regexp_extract({u}, {_URL_PARTS}, 3)")


def _radius_sql(u: str, km: str) -> str:
    segs = f"string_split(regexp_extract({u}, {_URL_PARTS}, 2), '/')"
    hit = f"coalesce(list_position(list_transform({segs}, lambda s: regexp_matches(s, 'c\\d')), true), 0)"
    k = f"CAST(trunc({km}) AS BIGINT)"
    suffix = f"CASE WHEN {k} > 0 THEN 'r' || CAST({k} AS VARCHAR) ELSE '' END"
    new = (f"list_transform({segs}, lambda s, i: CASE WHEN i = {hit} THEN regexp_replace(s, 'r\\d+$', '') || {suffix} "
           f"ELSE s END)")
    rebuilt = (f"regexp_extract({u}, {_URL_PARTS}, 1) || array_to_string({new}, '/') || "
               f"regexp_extract({u}, {_URL_PARTS}, 3)")
    return f"CASE WHEN {km} IS NULL OR {hit} = 0 THEN {u} ELSE {rebuilt} END"


@register("with_radius", sql=with_ctes("searches") + f"""
SELECT search_id, {_radius_sql('url', 'radius_km')} AS radius_url FROM searches""")
def q_with_radius(t):
    """Each search URL with its radius applied."""
    return clean_searches(t).select("search_id", with_radius("url", "radius_km").alias("radius_url"))


@register("page_url", sql=with_ctes("searches") + f"""
SELECT search_id, {_page_url_sql('url', '1')} AS page1, {_page_url_sql('url', '2')} AS page2,
       {_page_url_sql('url', '3')} AS page3 FROM searches""")
def q_page_url(t):
    """Page 1, 2 and 3 URLs of every search."""
    s = clean_searches(t)
    return s.select("search_id", *[page_url("url", F.lit(n)).alias(f"page{n}") for n in (1, 2, 3)])


@register("page_plan", sql=with_ctes("searches", extra={"r": f"SELECT search_id, {_radius_sql('url', 'radius_km')} AS base FROM searches WHERE enabled AND source_type = 'kleinanzeigen'"}) + f"""
SELECT search_id, CAST(n AS INTEGER) AS page_no, {_page_url_sql('base', 'n')} AS page_url
FROM r, generate_series(1, 3) g(n)""")
def q_page_plan(t):
    """Pages 1..3 of every active portal search."""
    s = clean_searches(t).filter(F.col("enabled") & (F.col("source_type") == "kleinanzeigen"))
    return P.plan_pages(s, 3)


@register("format_attrs", sql=with_ctes("listings") + f"""
SELECT listing_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, {format_attrs_sql('listings')} AS attrs FROM listings""")
def q_format_attrs(t):
    """The attribute line of every listing row."""
    return A.listings(t).select("listing_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                format_attrs("price", "rooms", "sqm", "location").alias("attrs"))


def _walk_inputs(t):
    li = t.lineitem
    sid = F.col("l_suppkey") % A.N_SEARCHES
    cards = li.select(sid.alias("search_id"), F.col("l_linenumber").alias("page_no"),
                      (F.col("l_partkey") % (F.lit(40) + sid * 60)).cast("string").alias("listing_id"),
                      "l_orderkey", "l_partkey", "l_suppkey")
    pages_ = (cards.select("search_id", "page_no").distinct()
              .withColumn("failed", (F.col("search_id") + F.col("page_no")) % 9 == 0))
    ok = cards.join(pages_.filter(~F.col("failed")), ["search_id", "page_no"], "left_semi")
    return ok, pages_


@register("page_walk_cut", sql="""
WITH cards AS (SELECT l_suppkey % 25 AS search_id, l_linenumber AS page_no,
                      CAST(l_partkey % (40 + 60 * (l_suppkey % 25)) AS VARCHAR) AS listing_id, l_orderkey, l_partkey, l_suppkey
               FROM lineitem),
pages_ AS (SELECT DISTINCT search_id, page_no, (search_id + page_no) % 9 = 0 AS failed FROM cards),
ok AS (SELECT c.* FROM cards c JOIN pages_ p ON c.search_id = p.search_id AND c.page_no = p.page_no WHERE NOT p.failed),
firsts AS (SELECT search_id, listing_id, min(page_no) AS fp FROM ok GROUP BY 1, 2),
fresh AS (SELECT search_id, fp AS page_no, count(*) AS n FROM firsts GROUP BY 1, 2),
pg AS (SELECT p.*, coalesce(f.n, 0) AS fresh FROM pages_ p LEFT JOIN fresh f ON f.search_id = p.search_id AND f.page_no = p.page_no),
walk AS (SELECT s.search_id, g.p, pg.page_no IS NULL OR pg.failed OR pg.fresh = 0 AS stops
         FROM (SELECT DISTINCT search_id FROM pages_) s CROSS JOIN generate_series(1, 20) g(p)
         LEFT JOIN pg ON pg.search_id = s.search_id AND pg.page_no = g.p),
cuts AS (SELECT search_id, coalesce(min(p) FILTER (WHERE stops), 21) AS cut FROM walk GROUP BY 1),
p1 AS (SELECT search_id, bool_or(failed) FILTER (WHERE page_no = 1) AS f1 FROM pages_ GROUP BY 1)
SELECT o.search_id, o.page_no, o.listing_id, o.l_orderkey, o.l_partkey, o.l_suppkey
FROM ok o JOIN firsts f ON f.search_id = o.search_id AND f.listing_id = o.listing_id AND f.fp = o.page_no
JOIN cuts c ON c.search_id = o.search_id JOIN p1 ON p1.search_id = o.search_id
WHERE o.page_no < c.cut AND NOT coalesce(p1.f1, false)""")
def q_page_walk_cut(t):
    """The page walk cut over the W adapter (cuts fall on pages 2 to 8)."""
    cards, pages_ = _walk_inputs(t)
    return P.cut_page_walk(cards, pages_, MAX_PAGES).select(
        "search_id", "page_no", "listing_id", "l_orderkey", "l_partkey", "l_suppkey")


@register("tag_numbers", sql=with_ctes("listings", extra={"tg": """
SELECT listing_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  [CASE WHEN l_linenumber % 3 = 0 THEN 'Zimmer frei' ELSE replace(CAST(l_linenumber / 2.0::DOUBLE AS VARCHAR), '.', ',') || ' Zimmer' END,
   CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' m²',
   CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_linenumber AS VARCHAR) || ' Zimmer, 70 m2' ELSE 'Balkon' END] AS tags
FROM listings"""}) + """
SELECT listing_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, rooms, sqm FROM (
SELECT *, CASE WHEN rh > 0 THEN TRY_CAST(replace(replace(regexp_extract(tags[rh], '\\d{1,3}(?:\\.\\d{3})+(?:,\\d+)?|\\d+(?:,\\d+)?', 0), '.', ''), ',', '.') AS DOUBLE) END AS rooms,
  list_filter(list_transform(tags, lambda t, i: CASE WHEN (contains(lower(t), 'm²') OR contains(lower(t), 'm2'))
      AND (NOT contains(lower(t), 'zimmer') OR (rh > 0 AND i > rh))
      THEN TRY_CAST(replace(replace(nullif(regexp_extract(t, '\\d{1,3}(?:\\.\\d{3})+(?:,\\d+)?|\\d+(?:,\\d+)?', 0), ''), '.', ''), ',', '.') AS DOUBLE) END),
      lambda x: x IS NOT NULL)[1] AS sqm
FROM (SELECT *, coalesce(list_position(list_transform(tags, lambda t: contains(lower(t), 'zimmer')
        AND regexp_extract(t, '\\d{1,3}(?:\\.\\d{3})+(?:,\\d+)?|\\d+(?:,\\d+)?', 0) <> ''), true), 0) AS rh FROM tg) a) b""")
def q_tag_numbers(t):
    """A3: rooms and sqm from card tags built from each listing row."""
    li = A.listings(t)
    rooms_txt = F.when(F.col("l_linenumber") % 3 == 0, F.lit("Zimmer frei")).otherwise(
        F.concat(F.regexp_replace((F.col("l_linenumber") / 2.0).cast("string"), r"\.", ","), F.lit(" Zimmer")))
    tags = F.array(rooms_txt, F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(" m²")),
                   F.when(F.col("l_linenumber") % 2 == 0,
                          F.concat(F.col("l_linenumber").cast("string"), F.lit(" Zimmer, 70 m2"))).otherwise(F.lit("Balkon")))
    x = X.with_tag_numbers(li.withColumn("_tags", tags), "_tags")
    return x.select("listing_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rooms", "sqm")
