"""Registered queries: the searches queries over one search per supplier, so that the search side grows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import searches as S
from . import adapters as A
from . import q_extract, q_matching, q_searches  # noqa: F401
from ._common import clean_searches
from .oracle_adapters import per_supplier_sql, with_ctes
from .registry import ORACLE, QUERIES, register

PER_SUPPLIER = ("searches_clean", "inherit_criteria", "searches_active", "criteria_lint", "source_type_counts",
                "list_searches", "searches_from_lists", "searches_fallback", "setting_numbers", "with_radius",
                "page_url", "page_plan", "match_all_searches")


def _over_suppliers(fn):
    return lambda t: fn(A.supplier_tables(t))


for _name in PER_SUPPLIER:
    register(f"{_name}_supplier", sql=per_supplier_sql(ORACLE[_name]))(_over_suppliers(QUERIES[_name]))


@register("searches_fallback_active", sql=per_supplier_sql(with_ctes("searches", extra={
    "primary_rows": "SELECT search_id, url, enabled FROM searches WHERE search_id % 2 = 0",
    "static_rows": "SELECT search_id, url FROM searches WHERE search_id % 2 = 1"}) + """
SELECT search_id, url FROM primary_rows
UNION ALL
SELECT search_id, url FROM static_rows
WHERE NOT EXISTS (SELECT 1 FROM primary_rows p WHERE p.enabled AND p.url <> '')"""))
def q_searches_fallback_active(t):
    """A primary table with an active search keeps the static list out."""
    s = clean_searches(A.supplier_tables(t))
    return S.searches_or_fallback(s.filter(F.col("search_id") % 2 == 0), None,
                                  s.filter(F.col("search_id") % 2 == 1)).select("search_id", "url")
