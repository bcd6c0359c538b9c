"""Searches: scan and coercion of the searches table.

The searches table is a dimension (tens to thousands of rows).  Everything here is
a projection or a filter over it; the global defaults are settings and enter the
plan as literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (infer_source_type, keywords_cell, strip_text, to_bool_cell,
                         to_double_cell)
from ..functions.predicates import CRITERIA_COLS

NUMERIC_CRITERIA = CRITERIA_COLS[:6]
KEYWORD_CRITERIA = CRITERIA_COLS[6:]
SEARCH_COLS = ["search_id", "enabled", "label", "source_type", "search_type", "url", "radius_km",
               *CRITERIA_COLS]


def coerce_searches(raw: DataFrame) -> DataFrame:
    """A10 (first half): every raw text cell to its type; rows without a URL dropped.

    Criteria stay null where the cell is blank, so that D6 can inherit them."""
    url = strip_text(F.coalesce(F.col("url"), F.lit("")))
    out = raw.select(
        F.col("search_id"),
        to_bool_cell("enabled", default=True).alias("enabled"),
        strip_text(F.coalesce(F.col("label"), F.lit(""))).alias("label"),
        infer_source_type("source_type", url).alias("source_type"),
        F.lower(strip_text(F.coalesce(F.col("search_type"), F.lit("")))).alias("search_type"),
        url.alias("url"),
        to_double_cell("radius_km").alias("radius_km"),
        *[to_double_cell(c).alias(c) for c in NUMERIC_CRITERIA],
        *[keywords_cell(c).alias(c) for c in KEYWORD_CRITERIA],
    )
    return out.filter(F.col("url") != "")


def default_literals(defaults) -> dict:
    """Global criteria as literal Columns.  ``defaults`` is a settings dict, or a
    one-row DataFrame (its single row is read; settings are one row, not data)."""
    if isinstance(defaults, DataFrame):
        row = defaults.select(*CRITERIA_COLS).limit(1).collect()
        defaults = row[0].asDict() if row else {}
    out = {}
    for c in NUMERIC_CRITERIA:
        out[c] = F.lit(defaults.get(c)).cast("double")
    for c in KEYWORD_CRITERIA:
        kws = defaults.get(c)
        out[c] = (F.array(*[F.lit(k) for k in kws]) if kws else F.array()).cast("array<string>") \
            if kws is not None else F.lit(None).cast("array<string>")
    return out


def inherit_criteria(searches: DataFrame, defaults) -> DataFrame:
    """A blank criteria cell takes the global default, column by column (the
    defaults are literals, so this is a projection, not a join)."""
    lit = default_literals(defaults)
    return searches.select(*[F.coalesce(F.col(c), lit[c]).alias(c) if c in CRITERIA_COLS
                             else F.col(c) for c in searches.columns])


def read_searches(raw: DataFrame, defaults) -> DataFrame:
    """A10: coercion + inheritance; keyword lists are never null afterwards."""
    s = inherit_criteria(coerce_searches(raw), defaults)
    empty = F.array().cast("array<string>")
    return s.withColumns({c: F.coalesce(F.col(c), empty) for c in KEYWORD_CRITERIA})


def active_searches(searches: DataFrame) -> DataFrame:
    """C4: URL non-empty and enabled."""
    return searches.filter((F.col("url") != "") & F.col("enabled"))


def searches_from_lists(portal_urls: DataFrame, feed_urls: DataFrame, defaults,
                        text_col: str = "urls") -> DataFrame:
    """One search per URL in comma/newline separated text cells, with the
    global criteria; portal URLs before feed URLs, list order kept."""
    def explode(df, kind, rank):
        items = F.split(F.regexp_replace(F.col(text_col), "\n", ","), ",")
        return (df.select(*[c for c in df.columns if c != text_col],
                          F.posexplode(items).alias("item_pos", "url"))
                .withColumn("url", strip_text("url"))
                .filter(F.col("url") != "")
                .withColumn("source_type", F.lit(kind))
                .withColumn("list_rank", F.lit(rank)))
    both = explode(portal_urls, "kleinanzeigen", 0).unionByName(explode(feed_urls, "rss", 1),
                                                                allowMissingColumns=True)
    lit = default_literals(defaults)
    return both.select(*both.columns, *[lit[c].alias(c) for c in CRITERIA_COLS])


def searches_or_fallback(primary: DataFrame, cached: DataFrame | None, static: DataFrame,
                         primary_failed: bool = False) -> DataFrame:
    """A failed read falls back to the cache, else the static list; an empty or
    all-disabled primary falls back to the static list (not the cache).

    Expressed without a driver-side branch on the data: the static rows are added
    only when no active primary row exists (an anti join on a one-row flag)."""
    if primary_failed:
        return cached if cached is not None else static
    flag = active_searches(primary).select(F.lit(1).alias("_any")).limit(1)
    fallback = static.withColumn("_any", F.lit(1)).join(F.broadcast(flag), "_any", "left_anti").drop("_any")
    return primary.unionByName(fallback, allowMissingColumns=True)


def lint_searches(searches: DataFrame) -> DataFrame:
    """One warning row per inverted bound of a search."""
    pairs = [("rent", "min_rent", "max_rent"), ("rooms", "min_rooms", "max_rooms"),
             ("sqm", "min_sqm", "max_sqm")]
    warn = F.array(*[F.when(F.col(lo) > F.col(hi), F.lit(name)) for name, lo, hi in pairs])
    return (searches.select("search_id", "label", F.explode(F.filter(warn, lambda x: x.isNotNull()))
                            .alias("bound"))
            .withColumn("message", F.concat(F.lit("inverted "), F.col("bound"),
                                            F.lit(" bounds: min > max rejects every known value"))))


def lint_no_sources(searches: DataFrame) -> DataFrame:
    """The fatal case, one row when no active search exists at all."""
    n = active_searches(searches).agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") == 0).select(F.lit("fatal").alias("level"),
                                            F.lit("no sources configured").alias("message"))


def source_type_counts(searches: DataFrame) -> DataFrame:
    """Portal vs feed searches among the active ones."""
    a = active_searches(searches)
    return a.agg(F.count_if(F.col("source_type") == "kleinanzeigen").alias("portal_searches"),
                 F.count_if(F.col("source_type") == "rss").alias("feed_searches"))


def list_searches(searches: DataFrame) -> DataFrame:
    """The active-search listing."""
    return active_searches(searches).select("search_id", "label", "url", "source_type", "enabled",
                                            "radius_km", "search_type")
