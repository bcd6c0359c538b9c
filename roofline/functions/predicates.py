"""Null-tolerant criteria.

An unknown attribute or an unset bound never disqualifies.  The bounds are written
as ``v IS NULL OR (...)`` so that, with literal bounds, Catalyst still pushes the
predicate into the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col
from .text import haystack as _haystack

CRITERIA_COLS = ("min_rent", "max_rent", "min_rooms", "max_rooms", "min_sqm", "max_sqm",
                 "required_keywords", "excluded_keywords")


def _bound(b) -> Column:
    return F.lit(b) if b is None or isinstance(b, (int, float)) else col(b)


def within(value, lo=None, hi=None) -> Column:
    """True if the value is null; inclusive bounds; a null bound is not applied."""
    v, lo, hi = col(value), _bound(lo), _bound(hi)
    return v.isNull() | ((lo.isNull() | (v >= lo)) & (hi.isNull() | (v <= hi)))


def excludes_keywords(hay, keywords) -> Column:
    """No excluded keyword occurs as a substring of the haystack."""
    kws = F.coalesce(col(keywords), F.array().cast("array<string>"))
    return ~F.exists(kws, lambda k: F.contains(col(hay), k))


def requires_keywords(hay, keywords) -> Column:
    """Every required keyword occurs as a substring of the haystack."""
    kws = F.coalesce(col(keywords), F.array().cast("array<string>"))
    return F.forall(kws, lambda k: F.contains(col(hay), k))


def matches_criteria(listing_prefix: str = "", criteria_prefix: str = "", hay=None) -> Column:
    """Price, rooms and sqm within their bounds, then the keyword tests.

    Column names are the listing's (``price``...) and the search's (``min_rent``...),
    optionally qualified by prefixes when both sides carry the same names; ``hay`` is
    the listing's haystack where it is a column already."""
    L = lambda c: F.col(listing_prefix + c)
    C = lambda c: F.col(criteria_prefix + c)
    hay = col(hay) if hay is not None else _haystack(L("title"), L("location"), L("description"))
    return (within(L("price"), C("min_rent"), C("max_rent"))
            & within(L("rooms"), C("min_rooms"), C("max_rooms"))
            & within(L("sqm"), C("min_sqm"), C("max_sqm"))
            & excludes_keywords(hay, C("excluded_keywords"))
            & requires_keywords(hay, C("required_keywords")))
