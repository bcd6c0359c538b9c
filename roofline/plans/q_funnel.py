"""Registered queries: the whole cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery as V
from ..operators import dedup as D
from ..operators import enrich as E
from . import adapters as A
from ._common import clean_searches, cut_once, flat_arrays
from .cycle import cycle_stats, run_cycle
from .oracle_adapters import cycle_ctes, format_attrs_sql, html_escape_sql, with_ctes
from .registry import register

NOW = "2024-02-01 00:00:00"
PORTAL = "board"
CAP = 15
_BASE = ("listings", "searches", "seen_all", "details")


def cycle(t, cut: bool = True, prime: bool = False):
    """The cycle of the L adapter.  Queries that read its outputs (kept, outbox,
    results) cut the lineage before and after repost dedup; queries on earlier stages don't.  Two cycles
    of a query share what is equal in both plans up to a cut."""
    def build():
        seen = D.seen_union(*A.seen_stores(t))
        return run_cycle(A.listings(t), clean_searches(t), seen, A.detail_rows(t), A.LISTING_ORDER, NOW,
                         cap=CAP, prime=prime, enrich_source=PORTAL,
                         materialize=cut_once(t) if cut else None)
    return t.memo(f"cycle-{cut}-{prime}", build)


def _sql(body, **extra):
    return with_ctes(*_BASE, extra={**cycle_ctes(PORTAL, CAP), **extra}) + body


@register("cycle_funnel", sql=_sql("""
SELECT (SELECT count(*) FROM fetched) AS fetched, (SELECT count(*) FROM firsts) AS filtered,
       (SELECT count(*) FROM kept) AS new, (SELECT count(*) FROM individual) AS notified"""))
def q_cycle_funnel(t):
    """Fetched, filtered, new and notified of one cycle, in one job."""
    return cycle_stats(cycle(t))


@register("prime_vs_steady", sql=_sql("""
SELECT 'steady' AS mode, (SELECT count(*) FROM kept) AS stored, (SELECT count(*) FROM individual) AS notified
UNION ALL SELECT 'prime', (SELECT count(*) FROM kept), 0"""))
def q_prime_vs_steady(t):
    """A steady cycle notifies up to the cap; the prime cycle stores the same rows and notifies none."""
    def row(mode, c):
        sent = c.individual.agg(F.count(F.lit(1)).alias("notified"))
        return c.results.agg(F.count(F.lit(1)).alias("stored")).crossJoin(sent).select(
            F.lit(mode).alias("mode"), "stored", "notified")
    return row("steady", cycle(t)).unionByName(row("prime", cycle(t, prime=True)))


@register("enrich_coalesce", sql=_sql("""
SELECT listing_id, price, rooms, sqm, description, bedrooms, bathrooms, floor, apartment_type, available_from,
       additional_costs, warm_rent, deposit, array_to_string(features, '|') AS features,
       array_to_string(list_filter([CASE WHEN price IS NULL THEN 'price' END, CASE WHEN rooms IS NULL THEN 'rooms' END,
                                    CASE WHEN sqm IS NULL THEN 'sqm' END], lambda x: x IS NOT NULL), '|') AS missing
FROM enr"""))
def q_enrich_coalesce(t):
    """New listings filled from their detail pages (portal listings only)."""
    c = cycle(t, cut=False)
    e = E.enrich(c.new, A.detail_rows(t), source=PORTAL)
    return flat_arrays(e.select("listing_id", "price", "rooms", "sqm", "description", *E.DETAIL_KEYS,
                                "features", "missing"))


@register("enrich_outcomes", sql=_sql("""
SELECT CASE WHEN d.listing_id IS NULL THEN 'fetcherror' WHEN d.price > 70 THEN 'error' WHEN d.price > 60 THEN 'noop'
            ELSE 'enriched' END AS outcome, count(*) AS listings
FROM new1 n LEFT JOIN details d ON d.listing_id = n.listing_id
WHERE n.source = 'board' GROUP BY 1"""))
def q_enrich_outcomes(t):
    """Enrichment outcomes of the portal listings that are new this cycle."""
    c = cycle(t, cut=False)
    d = A.detail_rows(t)
    # Stand-ins: dear adverts are pages that could not be worked through, or gave nothing.
    bare = F.col("price") > 60
    fields = [F.when(~bare, F.col(x)).alias(x) if x not in ("listing_id", "features") else F.col(x) for x in d.columns]
    d = d.withColumns({"error": F.when(F.col("price") > 70, "parse"), "features": F.when(~bare, F.col("features"))})
    return E.enrich_outcomes(c.new.filter(F.col("source") == PORTAL), d.select(*fields, "error"))


@register("result_rows", sql=_sql(f"""
SELECT listing_id, title, url, source, CASE WHEN search_type <> '' THEN search_type END AS search_type,
       'new' AS status, price, rooms, sqm, location, description, bedrooms, bathrooms, floor, apartment_type,
       available_from, additional_costs, warm_rent, deposit,
       CASE WHEN len(features) > 0 THEN array_to_string(features, ', ') END AS features,
       true AS available, TIMESTAMP '{NOW}' AS last_checked, TIMESTAMP '{NOW}' AS first_seen
FROM kept"""))
def q_result_rows(t):
    """The results rows a cycle writes."""
    return cycle(t).results


@register("notify_cap", sql=_sql("SELECT listing_id, position FROM individual"))
def q_notify_cap(t):
    """F8: the first 15 new listings of the cycle in fetch order, with positions."""
    return cycle(t).individual.select("listing_id", F.col("position").cast("bigint").alias("position"))


@register("notify_summary", sql=_sql(f"""
SELECT 0 AS line_no, '➕ ' || CAST(count(*) AS VARCHAR) || ' weitere neue Inserate:' AS line, {', '.join(f'NULL AS {c}' for c in A.LISTING_ORDER)}
FROM overflow HAVING count(*) > 0
UNION ALL SELECT 1, '• ' || {html_escape_sql('title')} || ' — ' || {html_escape_sql('url')}, {', '.join(A.LISTING_ORDER)} FROM overflow"""))
def q_notify_summary(t):
    """The overflow beyond the cap as one summary: header and bullet lines, with the columns that order them."""
    c = cycle(t)
    return V.summary_lines(c.overflow, A.LISTING_ORDER).select("line_no", "line", *A.LISTING_ORDER)


@register("outbox_chat", sql=_sql(f"""
SELECT listing_id, CASE WHEN coalesce(thumbnail, '') <> '' THEN 'photo' ELSE 'message' END AS kind,
       CASE WHEN coalesce(thumbnail, '') <> '' THEN thumbnail END AS photo,
       '<b>' || {html_escape_sql('title')} || '</b>' || chr(10) || {html_escape_sql(format_attrs_sql('i'))} || chr(10) ||
       '<a href="' || {html_escape_sql('url')} || '">' || {html_escape_sql('url')} || '</a>' AS text
FROM individual i"""))
def q_outbox_chat(t):
    """Chat messages for the individually notified listings."""
    return V.outbox_chat(cycle(t).individual)


@register("outbox_mail", sql=_sql(f"""
SELECT listing_id, '[roofline] ' || title AS subject,
       title || chr(10) || {format_attrs_sql('i')} || chr(10) || url AS plain,
       '<html><body><h3>' || {html_escape_sql('title')} || '</h3><p>' || {html_escape_sql(format_attrs_sql('i'))} || '</p>' ||
       CASE WHEN coalesce(thumbnail, '') <> '' THEN '<img src="' || {html_escape_sql('thumbnail')} || '" alt=""><br>' ELSE '' END ||
       '<p><a href="' || {html_escape_sql('url')} || '">' || {html_escape_sql('url')} || '</a></p></body></html>' AS html
FROM individual i"""))
def q_outbox_mail(t):
    """Mail subject, plain text and HTML for the individually notified listings."""
    return V.outbox_mail(cycle(t).individual)


@register("outbox_webhook", sql=_sql("""
SELECT listing_id, listing_id AS id, title, url, price, rooms, sqm, location, source, 8 AS n_fields FROM individual"""))
def q_outbox_webhook(t):
    """Webhook JSON bodies, their fields read back (the text differs between engines)."""
    j = V.outbox_webhook(cycle(t).individual)
    get = lambda name: F.get_json_object("json", f"$.{name}")
    return j.select("listing_id", get("listing_id").alias("id"), get("title").alias("title"), get("url").alias("url"),
                    *[get(c).cast("double").alias(c) for c in ("price", "rooms", "sqm")], get("location").alias("location"),
                    get("source").alias("source"), F.size(F.json_object_keys("json")).alias("n_fields"))
