"""Registered queries: the minimum slice and dedup (A13, B1-B6, C1-C3, D1-D4, E2, E10,
F1, F2, H1-H5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import haystack, missing_attrs, normalize_location, parse_number, within
from ..operators import dedup as D
from ..operators import matching as M
from ..operators.seen_store import SeenStore
from ..sources.searches import active_searches
from . import adapters as A
from ._common import active_dim, clean_searches, fetched, flat_arrays, scratch
from .oracle_adapters import (ORDER_SQL, criteria_sql, haystack_sql, norm_location_sql, signature_sql,
                              with_ctes)
from .registry import register

ORDER = A.LISTING_ORDER
STORE_BUCKETS = 8
KEY_OUT = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

_MATCHED = {"fetched": """
SELECT l.* FROM listings l WHERE l.search_id IN (SELECT search_id FROM searches WHERE enabled AND url <> '')""",
            "matched": f"""
SELECT l.*, s.search_type FROM fetched l JOIN searches s ON l.search_id = s.search_id
WHERE {criteria_sql('l', 's')}""",
            "firsts": f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY {ORDER_SQL}) AS rn
FROM matched) x WHERE rn = 1"""}


def matched(t):
    return t.memo("matched", lambda: M.match_per_search(fetched(t), dim=active_dim(t)))


def firsts(t):
    return t.memo("firsts", lambda: M.first_match_wins(matched(t), ORDER))


@register("match_per_search", sql=with_ctes("listings", "searches", extra=_MATCHED) + """
SELECT listing_id, search_id, search_type, price, rooms, sqm, l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM matched""")
def q_match_per_search(t):
    """D1 + C3: each listing against the criteria of its own search."""
    return matched(t).select("listing_id", "search_id", "search_type", "price", "rooms", "sqm", *KEY_OUT)


@register("first_match_wins", sql=with_ctes("listings", "searches", extra=_MATCHED) + """
SELECT listing_id, search_id, search_type, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM firsts""")
def q_first_match_wins(t):
    """the first matching search in fetch order keeps each listing id."""
    return firsts(t).select("listing_id", "search_id", "search_type", *KEY_OUT)


@register("new_listings", sql=with_ctes("listings", "searches", "seen_all", extra=_MATCHED) + """
SELECT listing_id, search_id, search_type FROM firsts f
WHERE NOT EXISTS (SELECT 1 FROM seen_all s WHERE s.key = f.listing_id)""")
def q_new_listings(t):
    """D3: matched, cycle-deduplicated listings that no seen store holds."""
    one, two = A.seen_stores(t)
    return D.only_new(firsts(t), D.seen_union(one, two)).select("listing_id", "search_id", "search_type")


@register("seen_scan", sql=with_ctes("seen1", "seen2") + """
SELECT key, 1 AS store FROM seen1 UNION ALL SELECT key, 2 FROM seen2""")
def q_seen_scan(t):
    """Both stores read back as the files they are kept in: Parquet, and JSON as a bare list; a third is absent."""
    one, two = A.seen_stores(t)
    base = scratch(t, "seen_scan")
    one.write.parquet(f"{base}/one")
    # A JSON list per file; the reader takes any number of files.
    two.groupBy(F.spark_partition_id().alias("p")).agg(F.to_json(F.collect_list("key")).alias("value")) \
        .select("value").write.text(f"{base}/two")
    read = lambda name, fmt: D.read_seen(t.spark, f"{base}/{name}", f"{base}/absent", fmt=fmt).select("key")
    return (read("one", "parquet").withColumn("store", F.lit(1))
            .unionByName(read("two", "json").withColumn("store", F.lit(2))))


@register("seen_union", sql=with_ctes("listings", "seen1", "seen2", extra={
    "u": "SELECT key, 0 AS st FROM seen1 UNION ALL SELECT key, 1 FROM seen2",
    "titles": "SELECT listing_id, any_value(title) AS title, any_value(source) AS source FROM listings GROUP BY listing_id"}) + """
SELECT u.key, t.title, t.source FROM (SELECT DISTINCT key FROM u) u JOIN titles t ON t.listing_id = u.key""")
def q_seen_union(t):
    """H1: one row per key across both stores."""
    one, two = A.seen_stores(t)
    return D.seen_union(one, two).select("key", "title", "source")


@register("store_drift", sql=with_ctes("seen1", "seen2") + """
SELECT key, 'a' AS only_in FROM seen1 WHERE key NOT IN (SELECT key FROM seen2)
UNION ALL SELECT key, 'b' FROM seen2 WHERE key NOT IN (SELECT key FROM seen1)""")
def q_store_drift(t):
    """H5: ids held by one store only."""
    one, two = A.seen_stores(t)
    return D.store_drift(one, two)


_SIG = {"sigs": f"SELECT f.*, {signature_sql('f')} AS signature FROM firsts f"}


@register("content_signature", sql=with_ctes("listings", extra={"x": f"SELECT l.*, {signature_sql('l')} AS signature FROM listings l"}) + """
SELECT listing_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, signature FROM x""")
def q_content_signature(t):
    """B4 over every listing row."""
    return D.with_signature(A.listings(t)).select("listing_id", *KEY_OUT, "signature")


@register("new_signatures", sql=with_ctes("listings", "searches", "seen_all", extra={**_MATCHED, **_SIG,
    "kept_sigs": "SELECT DISTINCT signature AS key FROM sigs WHERE signature IS NOT NULL AND search_id % 5 = 0"}) + """
SELECT listing_id, signature FROM sigs s
WHERE search_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM kept_sigs k WHERE k.key = s.signature)""")
def q_new_signatures(t):
    """Signatures stored by the searches with id % 5 = 0 hide reposts found by the
    others; a null signature always passes."""
    s = D.with_signature(firsts(t))
    store = s.filter(F.col("search_id") % 5 == 0).filter(F.col("signature").isNotNull()) \
        .select(F.col("signature").alias("key")).distinct()
    rest = s.filter(F.col("search_id") % 5 != 0)
    return D.only_new_signatures(rest, store).select("listing_id", "signature")


@register("new_signatures_all", sql=with_ctes("listings", "searches", extra={**_MATCHED, **_SIG,
    "old": f"SELECT DISTINCT {signature_sql('l')} AS key FROM listings l WHERE l_shipdate < TIMESTAMP '{A.SEEN_CUTOFF}'"}) + """
SELECT listing_id, search_id, signature FROM sigs s WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.key = s.signature)""")
def q_new_signatures_all(t):
    """D4 over the listings of all searches: the store holds the signatures of the rows
    shipped before 1996; a null signature always passes."""
    old = A.listings(t).filter(F.col("_shipdate") < F.lit(A.SEEN_CUTOFF).cast("timestamp_ntz"))
    store = D.with_signature(old).filter(F.col("signature").isNotNull()).select(F.col("signature").alias("key")).distinct()
    return D.only_new_signatures(D.with_signature(firsts(t)), store).select("listing_id", "search_id", "signature")


@register("split_reposts", sql=with_ctes("listings", "searches", extra={**_MATCHED, **_SIG,
    "ranked": f"""SELECT *, first_value(listing_id) OVER (PARTITION BY signature ORDER BY {ORDER_SQL}) AS first_id
FROM sigs WHERE signature IS NOT NULL"""}) + """
SELECT listing_id, signature, listing_id <> first_id AS dropped, first_id AS kept_id FROM ranked
UNION ALL SELECT listing_id, signature, false, listing_id FROM sigs WHERE signature IS NULL""")
def q_split_reposts(t):
    """first listing per signature in fetch order kept, later ones dropped."""
    return D.split_reposts(D.with_signature(firsts(t)), ORDER).select("listing_id", "signature", "dropped", "kept_id")


@register("repost_groups", sql=with_ctes("listings", "searches", extra={**_MATCHED, **_SIG}) + f"""
SELECT signature, CAST(count(*) AS BIGINT) AS members,
       arg_min(listing_id, ({ORDER_SQL})) AS first_id
FROM sigs WHERE signature IS NOT NULL GROUP BY signature""")
def q_repost_groups(t):
    """Members per signature."""
    return D.repost_groups(D.with_signature(firsts(t)), ORDER)


@register("seen_rows", sql=with_ctes("listings", "searches", extra={**_MATCHED, **_SIG,
    "ranked": f"""SELECT *, first_value(listing_id) OVER (PARTITION BY signature ORDER BY {ORDER_SQL}) AS first_id
FROM sigs WHERE signature IS NOT NULL""",
    "kept": "SELECT * FROM ranked WHERE listing_id = first_id UNION ALL SELECT *, listing_id FROM sigs WHERE signature IS NULL",
    "dropped": "SELECT * FROM ranked WHERE listing_id <> first_id"}) + """
SELECT listing_id AS key, title, url, source FROM kept
UNION ALL SELECT signature, NULL, NULL, NULL FROM kept WHERE signature IS NOT NULL
UNION ALL SELECT listing_id, NULL, NULL, NULL FROM dropped""")
def q_seen_rows(t):
    """H2: the seen-store rows a cycle writes for its kept and dropped listings."""
    s = D.split_reposts(D.with_signature(firsts(t)), ORDER)
    kept = s.filter(~F.col("dropped"))
    dropped = s.filter(F.col("dropped"))
    return D.seen_rows(kept, dropped)


@register("seen_append", sql=with_ctes("listings", "searches", "seen_all", extra={**_MATCHED}) + """
SELECT DISTINCT listing_id AS key FROM firsts WHERE listing_id NOT IN (SELECT key FROM seen_all)""")
def q_seen_append(t):
    """H3: appending the cycle's ids to the store adds only unknown keys, once."""
    one, two = A.seen_stores(t)
    adds = firsts(t).select(F.col("listing_id").alias("key"), "title", "url", "source")
    return D.seen_append(D.seen_union(one, two), adds).select("key")


@register("seen_store_new", sql=with_ctes("listings", "searches", "seen_all", extra={**_MATCHED, **_SIG,
    "old": f"SELECT DISTINCT {signature_sql('l')} AS key FROM listings l WHERE l_shipdate < TIMESTAMP '{A.SEEN_CUTOFF}'"}) + """
SELECT listing_id, search_id, signature FROM sigs s
WHERE NOT EXISTS (SELECT 1 FROM seen_all a WHERE a.key = s.listing_id)
  AND NOT EXISTS (SELECT 1 FROM old o WHERE o.key = s.signature)""")
def q_seen_store_new(t):
    """D3 and D4 against a bucketed store of both kinds of keys: the two seen stores and the signatures of the rows
    shipped before 1996, appended as three batches and merged."""
    store = SeenStore(t.spark, scratch(t, "seen_store_new"), buckets=STORE_BUCKETS, fanout=2)
    old = A.listings(t).filter(F.col("_shipdate") < F.lit(A.SEEN_CUTOFF).cast("timestamp_ntz"))
    sigs = D.with_signature(old).select(F.col("signature").alias("key"))
    for batch, rows in enumerate((*A.seen_stores(t), sigs)):
        store.append(rows, batch)
    store.compact()
    new = store.only_new(D.with_signature(firsts(t)), "listing_id")
    return store.only_new(new, "signature").select("listing_id", "search_id", "signature")


@register("seen_store_compact", sql=with_ctes("listings", "searches", "seen_all", extra={**_MATCHED}) + """
SELECT key, CAST(1 AS BIGINT) AS stored FROM (SELECT key FROM seen_all UNION SELECT listing_id FROM firsts) u""")
def q_seen_store_compact(t):
    """H3 on the bucketed store: six batches that share keys, one of them handed out again, and the merges after
    each; every key is stored once."""
    store = SeenStore(t.spark, scratch(t, "seen_store_compact"), buckets=STORE_BUCKETS, fanout=2)
    one, two = A.seen_stores(t)
    adds = firsts(t).select(F.col("listing_id").alias("key"), "title", "url", "source", "search_id")
    thirds = [adds.filter(F.col("search_id") % 3 == i) for i in range(3)]
    for batch, rows in enumerate((one, two, thirds[0], thirds[1], one.unionByName(two), thirds[2])):
        store.append(rows, batch)
        store.append(rows, batch)
        store.compact()
    return store.rows().groupBy("key").agg(F.count(F.lit(1)).alias("stored"))


@register("fetch_counts", sql=with_ctes("listings", "searches") + """
SELECT s.search_id, s.label, CAST(count(l.listing_id) AS BIGINT) AS fetched
FROM searches s LEFT JOIN listings l ON l.search_id = s.search_id
WHERE s.enabled GROUP BY s.search_id, s.label""")
def q_fetch_counts(t):
    """Listings per search, zero for a search that returned none."""
    return M.fetch_counts(A.listings(t), clean_searches(t))


@register("match_all_searches", sql=with_ctes("listings", "searches", extra={
    "a": "SELECT * FROM searches WHERE enabled AND url <> ''"}) + f"""
SELECT l.listing_id, l.search_id, s.search_id AS match_search_id, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
FROM listings l JOIN a s ON {criteria_sql('l', 's')}""")
def q_match_all_searches(t):
    """All listings against the criteria of every active search."""
    return M.match_all(A.listings(t), active_searches(clean_searches(t))).select(
        "listing_id", "search_id", "match_search_id", *KEY_OUT)


@register("criteria_match", sql=with_ctes("listings", "searches", extra={"f": "SELECT l.*, s.min_rent, s.max_rent, s.min_rooms, s.max_rooms, s.min_sqm, s.max_sqm, s.required_keywords, s.excluded_keywords FROM listings l JOIN searches s ON l.search_id = s.search_id"}) + f"""
SELECT listing_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, {criteria_sql('f', 'f')} AS matches FROM f""")
def q_criteria_match(t):
    """C3 as a flag on every listing row (joined to its search)."""
    from ..functions import matches_criteria
    j = M.attach_criteria(A.listings(t), clean_searches(t))
    return j.select("listing_id", *KEY_OUT, matches_criteria().alias("matches"))


@register("bounds_filter", sql=with_ctes("listings") + """
SELECT listing_id, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM listings
WHERE (price IS NULL OR (price >= 10.0 AND price <= 60.0)) AND (rooms IS NULL OR rooms >= 2.0)
  AND (sqm IS NULL OR sqm <= 30.0)""")
def q_bounds_filter(t):
    """C1 with literal bounds: stays a pushed-down scan filter."""
    li = A.listings(t)
    return li.filter(within("price", 10.0, 60.0) & within("rooms", 2.0, None) & within("sqm", None, 30.0)) \
        .select("listing_id", *KEY_OUT)


@register("keyword_filter", sql="""
SELECT doc_id FROM documents
WHERE len(list_filter(CASE lang WHEN 'de' THEN ['der', 'sch'] WHEN 'fr' THEN ['eau'] ELSE ['the'] END, lambda k: NOT contains(lower(text), k))) = 0
  AND NOT contains(lower(text), 'zzz')""")
def q_keyword_filter(t):
    """C2 on documents: per-language required keywords, one excluded keyword."""
    from ..functions import excludes_keywords, requires_keywords
    d = t.documents
    req = (F.when(F.col("lang") == "de", F.array(F.lit("der"), F.lit("sch")))
           .when(F.col("lang") == "fr", F.array(F.lit("eau"))).otherwise(F.array(F.lit("the"))))
    hay = F.lower("text")
    return d.filter(requires_keywords(hay, req) & excludes_keywords(hay, F.array(F.lit("zzz")))).select("doc_id")


@register("haystack", sql=with_ctes("listings") + f"""
SELECT listing_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, {haystack_sql('listings')} AS haystack FROM listings""")
def q_haystack(t):
    """B5 over every listing row."""
    return A.listings(t).select("listing_id", *KEY_OUT, haystack("title", "location", "description").alias("haystack"))


@register("normalize_location", sql=with_ctes("listings") + f"""
SELECT DISTINCT location, {norm_location_sql('location')} AS norm FROM listings""")
def q_normalize_location(t):
    """B3 over the distinct locations."""
    return A.listings(t).select("location").distinct().select("location", normalize_location("location").alias("norm"))


@register("missing_attrs", sql=with_ctes("listings") + """
SELECT listing_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  array_to_string(list_filter([CASE WHEN price IS NULL THEN 'price' END, CASE WHEN rooms IS NULL THEN 'rooms' END,
                               CASE WHEN sqm IS NULL THEN 'sqm' END], lambda x: x IS NOT NULL), '|') AS missing
FROM listings""")
def q_missing_attrs(t):
    """B6 over every listing row."""
    return flat_arrays(A.listings(t).select("listing_id", *KEY_OUT, missing_attrs().alias("missing")))


@register("parse_number", sql="""
SELECT doc_id, CASE WHEN r <> '' THEN TRY_CAST(replace(replace(r, '.', ''), ',', '.') AS DOUBLE) END AS number
FROM (SELECT doc_id, regexp_extract(text, '\\d{1,3}(?:\\.\\d{3})+(?:,\\d+)?|\\d+(?:,\\d+)?', 0) AS r FROM documents) d""")
def q_parse_number(t):
    """B1 over whole documents: the first German-formatted number of each text."""
    return t.documents.select("doc_id", parse_number("text").alias("number"))
