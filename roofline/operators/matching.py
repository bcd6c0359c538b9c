"""Matching listings against searches.

D1 is an equi-join on ``search_id`` with the criteria test as the join residual.  D2
(every search against every listing) tests each distinct pair of keyword lists once per
listing, then is an equi-join on those lists and price buckets: a listing is in the bucket
of its price, a search in every bucket that its rent bounds meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import excludes_keywords, haystack, matches_criteria, requires_keywords, within
from ..functions.predicates import CRITERIA_COLS
from ._joins import first_per_key

CRITERIA_SIDE = ["search_id", "search_type", *CRITERIA_COLS]


def criteria_dim(searches: DataFrame) -> DataFrame:
    """The search side of D1: id, type and criteria."""
    return searches.select(*CRITERIA_SIDE)


def attach_criteria(listings: DataFrame, searches: DataFrame | None = None,
                    dim: DataFrame | None = None) -> DataFrame:
    """Every listing carries the criteria and ``search_type`` of its own search."""
    dim = dim if dim is not None else criteria_dim(searches)
    return listings.join(dim, "search_id")


def match_per_search(listings: DataFrame, searches: DataFrame | None = None,
                     dim: DataFrame | None = None) -> DataFrame:
    """D1 + C3: listings that satisfy the criteria of their own search (the
    criteria test is the residual of the equi-join)."""
    dim = dim if dim is not None else criteria_dim(searches)
    return listings.join(dim, "search_id").filter(matches_criteria()).drop(*CRITERIA_COLS)


PRICE_BUCKETS = 64
KEYWORD_COLS = ("required_keywords", "excluded_keywords")


def price_bucket(price: F.Column) -> F.Column:
    """A bucket of prices, four to an octave: never smaller for a larger price."""
    return F.least(F.floor(4 * F.log2(F.greatest(price, F.lit(0.0)) + 1)), F.lit(PRICE_BUCKETS - 1)).cast("int")


def match_all(listings: DataFrame, searches: DataFrame) -> DataFrame:
    """Every (search, listing) pair whose criteria match, whatever search fetched
    the listing.  A listing without a price meets every search: it has a bucket of its
    own (-1) that all searches are in.  The keyword tests, which cost most, are not made
    per pair: a listing meets the distinct keyword lists, and the bounds are the residual."""
    s = searches.select(F.col("search_id").alias("match_search_id"),
                        F.col("search_type").alias("match_search_type"), *CRITERIA_COLS)
    none = F.array().cast("array<string>")
    s = s.withColumns({c: F.coalesce(c, none) for c in KEYWORD_COLS})
    s = s.withColumn("_words", F.sha1(F.to_json(F.struct(*KEYWORD_COLS))))
    lo = F.when(F.col("min_rent").isNull(), 0).otherwise(price_bucket(F.col("min_rent")))
    hi = F.when(F.col("max_rent").isNull(), PRICE_BUCKETS - 1).otherwise(price_bucket(F.col("max_rent")))
    spread = F.array_append(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")), F.lit(-1))
    lists = s.select("_words", *KEYWORD_COLS).dropDuplicates(["_words"])
    s = s.drop(*KEYWORD_COLS).withColumn("_bucket", F.explode(spread))
    own = listings.withColumns({"_bucket": F.when(F.col("price").isNull(), -1).otherwise(price_bucket(F.col("price"))),
                                "_hay": haystack("title", "location", "description")})
    # Dealt out: a listing is small, its pairs are many, and a file may be one task.
    own = own.repartition("title", "price", "rooms", "sqm")
    told = own.join(lists, excludes_keywords("_hay", "excluded_keywords") & requires_keywords("_hay", "required_keywords"))
    bounds = (within("price", "min_rent", "max_rent") & within("rooms", "min_rooms", "max_rooms")
              & within("sqm", "min_sqm", "max_sqm"))
    pairs = told.drop("_hay", *KEYWORD_COLS).join(s, ["_words", "_bucket"]).where(bounds)
    return pairs.drop(*[c for c in CRITERIA_COLS if c not in KEYWORD_COLS], "_bucket", "_words")


def first_match_wins(matched: DataFrame, order: list[str]) -> DataFrame:
    """one row per listing id: the first *matching* search in fetch order keeps
    it, with its criteria and ``search_type``."""
    return first_per_key(matched, ["listing_id"], order)


def fetch_counts(listings: DataFrame, searches: DataFrame) -> DataFrame:
    """Listings fetched per active search, 0 for a search that returned none."""
    per = listings.groupBy("search_id").agg(F.count(F.lit(1)).alias("fetched"))
    s = searches.filter(F.col("enabled")).select("search_id", "label")
    return s.join(per, "search_id", "left").select(
        "search_id", "label", F.coalesce(F.col("fetched"), F.lit(0)).cast("bigint").alias("fetched"))
