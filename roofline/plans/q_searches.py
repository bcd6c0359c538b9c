"""Registered queries: searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import to_double_setting, keywords_cell
from ..sources import searches as S
from . import adapters as A
from ._common import clean_searches, flat_arrays
from .oracle_adapters import with_ctes
from .registry import register

_SEARCH_OUT = ("search_id, enabled, label, source_type, search_type, url, radius_km, min_rent, max_rent, "
               "min_rooms, max_rooms, min_sqm, max_sqm, array_to_string(required_keywords, '|') AS required_keywords, "
               "array_to_string(excluded_keywords, '|') AS excluded_keywords")


@register("searches_clean", sql=with_ctes("searches_raw", extra={"c": """
SELECT search_id,
  CASE WHEN enabled IS NULL OR enabled = '' THEN TRUE
       ELSE lower(regexp_replace(regexp_replace(enabled, '^\\s+', ''), '\\s+$', '')) IN ('1','true','yes','on','checked') END AS enabled,
  trim(coalesce(label, '')) AS label,
  CASE WHEN lower(trim(source_type)) IN ('kleinanzeigen','rss') THEN lower(trim(source_type))
       WHEN contains(lower(url), 'kleinanzeigen') THEN 'kleinanzeigen' ELSE 'rss' END AS source_type,
  lower(trim(coalesce(search_type, ''))) AS search_type,
  trim(url) AS url,
  radius_km AS radius_raw, min_rent AS min_rent_raw, max_sqm AS max_sqm_raw,
  required_keywords AS req_raw
FROM searches_raw WHERE trim(coalesce(url, '')) <> ''"""}) + """
SELECT search_id, enabled, label, source_type, search_type, url,
  CASE WHEN radius_raw IS NULL OR radius_raw = '' THEN NULL
       ELSE TRY_CAST(replace(replace(nullif(regexp_extract(radius_raw, '\\d{1,3}(?:\\.\\d{3})+(?:,\\d+)?|\\d+(?:,\\d+)?', 0), ''), '.', ''), ',', '.') AS DOUBLE) END AS radius_km,
  CASE WHEN min_rent_raw IS NULL OR min_rent_raw = '' THEN NULL
       ELSE TRY_CAST(replace(replace(nullif(regexp_extract(min_rent_raw, '\\d{1,3}(?:\\.\\d{3})+(?:,\\d+)?|\\d+(?:,\\d+)?', 0), ''), '.', ''), ',', '.') AS DOUBLE) END AS min_rent,
  CASE WHEN max_sqm_raw IS NULL OR max_sqm_raw = '' THEN NULL
       ELSE TRY_CAST(replace(replace(nullif(regexp_extract(max_sqm_raw, '\\d{1,3}(?:\\.\\d{3})+(?:,\\d+)?|\\d+(?:,\\d+)?', 0), ''), '.', ''), ',', '.') AS DOUBLE) END AS max_sqm,
  array_to_string(CASE WHEN req_raw IS NULL OR req_raw = '' THEN NULL
       ELSE nullif(list_filter(list_transform(string_split(req_raw, ','), lambda k: lower(trim(k))), lambda k: k <> ''), []) END, '|') AS required_keywords
FROM c""")
def q_searches_clean(t):
    """Coerced searches (criteria not yet inherited)."""
    s = S.coerce_searches(A.searches_raw(t))
    return flat_arrays(s.select("search_id", "enabled", "label", "source_type", "search_type", "url",
                                "radius_km", "min_rent", "max_sqm", "required_keywords"))


@register("inherit_criteria", sql=with_ctes("searches") + f"SELECT {_SEARCH_OUT} FROM searches")
def q_inherit_criteria(t):
    """Blank criteria cells take the global defaults."""
    return flat_arrays(clean_searches(t))


@register("searches_active", sql=with_ctes("searches") + "SELECT search_id, url FROM searches WHERE enabled AND url <> ''")
def q_searches_active(t):
    return S.active_searches(clean_searches(t)).select("search_id", "url")


@register("criteria_lint", sql=with_ctes("searches") + """
SELECT search_id, label, bound, 'inverted ' || bound || ' bounds: min > max rejects every known value' AS message
FROM (SELECT search_id, label, 'rent' AS bound FROM searches WHERE min_rent > max_rent
      UNION ALL SELECT search_id, label, 'rooms' FROM searches WHERE min_rooms > max_rooms
      UNION ALL SELECT search_id, label, 'sqm' FROM searches WHERE min_sqm > max_sqm) x""")
def q_criteria_lint(t):
    return S.lint_searches(clean_searches(t))


@register("source_type_counts", sql=with_ctes("searches") + """
SELECT CAST(count(*) FILTER (WHERE source_type = 'kleinanzeigen') AS BIGINT) AS portal_searches,
       CAST(count(*) FILTER (WHERE source_type = 'rss') AS BIGINT) AS feed_searches
FROM searches WHERE enabled AND url <> ''""")
def q_source_type_counts(t):
    return S.source_type_counts(clean_searches(t))


@register("list_searches", sql=with_ctes("searches") + """
SELECT search_id, label, url, source_type, enabled, radius_km, search_type FROM searches WHERE enabled AND url <> ''""")
def q_list_searches(t):
    return S.list_searches(clean_searches(t))


def _url_lists(t):
    # One text cell per region: the portal URLs of its nations (newline separated)
    # and their feed URLs (comma separated), as a settings table would hold them.
    s = clean_searches(t).join(t.nation.select(F.col("n_nationkey").alias("search_id"), "n_regionkey"), "search_id")
    portal = (s.filter(F.col("source_type") == "kleinanzeigen").groupBy("n_regionkey")
              .agg(F.array_join(F.array_sort(F.collect_list(F.struct("search_id", "url"))).url, "\n").alias("urls")))
    feed = (s.filter(F.col("source_type") == "rss").groupBy("n_regionkey")
            .agg(F.array_join(F.array_sort(F.collect_list(F.struct("search_id", "url"))).url, " , ").alias("urls")))
    return portal, feed


@register("searches_from_lists", sql=with_ctes("searches", extra={
    "s": "SELECT s.*, n.n_regionkey FROM searches s JOIN nation n ON s.search_id = n.n_nationkey",
    "items": """
SELECT n_regionkey, 0 AS list_rank, url, row_number() OVER (PARTITION BY n_regionkey ORDER BY search_id) - 1 AS item_pos
FROM s WHERE source_type = 'kleinanzeigen'
UNION ALL
SELECT n_regionkey, 1, url, row_number() OVER (PARTITION BY n_regionkey ORDER BY search_id) - 1
FROM s WHERE source_type = 'rss'"""}) + """
SELECT n_regionkey, list_rank, CAST(item_pos AS INTEGER) AS item_pos, url, source_type_out AS source_type,
       80.0::DOUBLE AS max_rent, 2.0::DOUBLE AS min_sqm, 'promo' AS excluded_keywords
FROM (SELECT *, CASE list_rank WHEN 0 THEN 'kleinanzeigen' ELSE 'rss' END AS source_type_out FROM items) x""")
def q_searches_from_lists(t):
    """Searches built from per-region URL list cells, portal lists first."""
    portal, feed = _url_lists(t)
    out = S.searches_from_lists(portal, feed, A.DEFAULT_CRITERIA)
    return flat_arrays(out.select("n_regionkey", "list_rank", "item_pos", "url", "source_type",
                                  "max_rent", "min_sqm", "excluded_keywords"))


@register("searches_fallback", sql=with_ctes("searches", extra={
    "primary_rows": "SELECT search_id, url, enabled FROM searches WHERE search_id % 2 = 0 AND NOT enabled",
    "static_rows": "SELECT search_id, url FROM searches WHERE search_id % 2 = 1"}) + """
SELECT search_id, url FROM primary_rows
UNION ALL
SELECT search_id, url FROM static_rows
WHERE NOT EXISTS (SELECT 1 FROM primary_rows p WHERE p.enabled AND p.url <> '')""")
def q_searches_fallback(t):
    """An all-disabled primary table falls back to the static list."""
    s = clean_searches(t)
    primary = s.filter((F.col("search_id") % 2 == 0) & ~F.col("enabled"))
    static = s.filter(F.col("search_id") % 2 == 1)
    return S.searches_or_fallback(primary, None, static).select("search_id", "url")


@register("setting_numbers", sql=with_ctes("searches_raw") + """
SELECT search_id, TRY_CAST(replace(trim(min_rent), ',', '.') AS DOUBLE) AS min_rent_setting,
       TRY_CAST(replace(trim(max_rent), ',', '.') AS DOUBLE) AS max_rent_setting,
       array_to_string(CASE WHEN excluded_keywords IS NULL OR excluded_keywords = '' THEN NULL
         ELSE nullif(list_filter(list_transform(string_split(excluded_keywords, ','), lambda k: lower(trim(k))), lambda k: k <> ''), []) END, '|') AS excluded_setting
FROM searches_raw""")
def q_setting_numbers(t):
    """B16 (and the setting keyword list): settings parse ``,`` as the decimal point."""
    r = A.searches_raw(t)
    return flat_arrays(r.select("search_id", to_double_setting("min_rent").alias("min_rent_setting"),
                                to_double_setting("max_rent").alias("max_rent_setting"),
                                keywords_cell("excluded_keywords").alias("excluded_setting")))
