"""Detail enrichment (D5, E12): a left join of listings to parsed detail pages with
coalescing column rules.  Listings without a detail row keep their values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import missing_attrs

DETAIL_KEYS = ["bedrooms", "bathrooms", "floor", "apartment_type", "available_from",
               "additional_costs", "warm_rent", "deposit"]
CORE = ["price", "rooms", "sqm"]


def _nonempty_text(c):
    return F.when(F.length(c) > 0, c)


def enrich(listings: DataFrame, details: DataFrame, key: str = "listing_id", source: str | None = None) -> DataFrame:
    """price/rooms/sqm only filled when missing; a non-empty description
    replaces; each detail key replaces when present; non-empty features replace the
    list; ``missing`` recomputed.  Location is never enriched.

    ``details`` has one row per listing id with the columns it found (any subset of
    price, rooms, sqm, description, features and the detail keys).  ``source`` limits
    enrichment to the listings of one source."""
    d = details.select(key, *[F.col(c).alias("_d_" + c) for c in details.columns if c != key],
                       F.lit(True).alias("_has_detail"))
    if source is None:
        j = listings.join(d, key, "left")
    else:
        on = (listings[key] == d[key]) & (listings["source"] == source)
        j = listings.join(d, on, "left").drop(d[key])
    dc = set(details.columns)
    out = {}
    for c in CORE:
        if "" + c in dc:
            out[c] = F.coalesce(F.col(c), F.col("_d_" + c))
    if "description" in dc:
        out["description"] = F.coalesce(_nonempty_text(F.col("_d_description")), F.col("description"))
    for k in DETAIL_KEYS:
        if k in dc:
            cur = F.col(k) if k in listings.columns else F.lit(None).cast(details.schema[k].dataType)
            out[k] = F.coalesce(F.col("_d_" + k), cur)
    if "features" in dc:
        cur = F.col("features") if "features" in listings.columns else F.array().cast("array<string>")
        out["features"] = F.when(F.size(F.col("_d_features")) > 0, F.col("_d_features")).otherwise(cur)
    j = j.withColumns(out)
    j = j.withColumn("missing", missing_attrs())
    return j.drop(*[c for c in j.columns if c.startswith("_d_")])


def enrich_outcome(details: DataFrame, key: str = "listing_id") -> F.Column:
    """E12 helper: ``enriched`` when the detail page gave any field, ``noop`` when it
    gave none, ``fetcherror`` when there is no detail row (fetch failed), ``error`` when the
    row says so in an ``error`` column (the page could not be worked through)."""
    found = [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in details.columns
             if c not in (key, "_has_detail", "features", "error")]
    any_found = found[0]
    for f in found[1:]:
        any_found = any_found | f
    return any_found


def enrich_outcomes(listings: DataFrame, details: DataFrame, key: str = "listing_id") -> DataFrame:
    """Enrichment outcome counts over the listings sent to enrichment."""
    flag = details.select(key, (enrich_outcome(details, key)
                                | (F.size(F.coalesce(F.col("features"), F.array())) > 0)).alias("_any"),
                          (F.col("error").isNotNull() if "error" in details.columns else F.lit(False)).alias("_error"))
    j = listings.select(key).join(flag, key, "left")
    outcome = (F.when(F.col("_any").isNull(), "fetcherror").when(F.col("_error"), "error")
               .when(F.col("_any"), "enriched").otherwise("noop"))
    return j.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("listings"))
