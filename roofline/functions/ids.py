"""Identity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col
from .text import normalize_location

CORE_ATTRS = ("price", "rooms", "sqm")


def stable_id(source, native_id, url) -> Column:
    """B2: ``source:native_id``; without a native id (null or empty) ``source:`` plus
    the first 16 hex digits of sha1(url)."""
    native = F.nullif(col(native_id).cast("string"), F.lit(""))
    digest = F.substring(F.sha1(col(url).cast("binary")), 1, 16)
    return F.concat(col(source), F.lit(":"), F.coalesce(native, digest))


def content_signature(price, sqm, rooms, location) -> Column:
    """``sig:`` + 16 hex of sha1 over rounded price, sqm, rooms (``?`` if null)
    and the normalized location, joined by a pipe.  Null unless price and sqm are
    known.  Rounding is half-even (``rint``), like Python's ``round``."""
    price, sqm, rooms = col(price), col(sqm), col(rooms)
    as_int = lambda x: F.rint(x).cast("bigint").cast("string")
    key = F.concat_ws("|", as_int(price), as_int(sqm), F.coalesce(as_int(rooms), F.lit("?")),
                      normalize_location(location))
    sig = F.concat(F.lit("sig:"), F.substring(F.sha1(key.cast("binary")), 1, 16))
    return F.when(price.isNotNull() & sqm.isNotNull(), sig)


def missing_attrs(price="price", rooms="rooms", sqm="sqm") -> Column:
    """Names of the null core attributes, in fixed order."""
    flags = [F.when(col(c).isNull(), F.lit(name)) for c, name in zip((price, rooms, sqm), CORE_ATTRS)]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())
