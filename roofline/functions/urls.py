"""URL expressions.

A URL is split once by a regular expression into ``prefix`` (scheme and
authority), ``path`` and ``rest`` (query and fragment); path edits work on the
segment array with higher-order functions, so everything stays JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

_URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)(.*)$"
_CODE_SEGMENT = r"c\d"          # fixed value: the category/location code segment
_RADIUS_SUFFIX = r"r\d+$"       # fixed value: radius suffix on that segment
_PAGE_SEGMENT = r"^seite:\d+$"  # fixed value: page segment
PAGE_SEGMENT_FMT = "seite:"

# The portal base and the valid source types.
PORTAL_BASE_URL = "https://www.kleinanzeigen.de"
PORTAL_SOURCE = "kleinanzeigen"
FEED_SOURCE = "rss"
VALID_SOURCE_TYPES = [PORTAL_SOURCE, FEED_SOURCE]


def _parts(url: Column):
    return (F.regexp_extract(url, _URL_PARTS, 1), F.regexp_extract(url, _URL_PARTS, 2),
            F.regexp_extract(url, _URL_PARTS, 3))


def url_origin(c, default: str = PORTAL_BASE_URL) -> Column:
    """``scheme://authority`` of a URL, else ``default``."""
    c = col(c)
    scheme = F.try_parse_url(c, F.lit("PROTOCOL"))
    authority = F.try_parse_url(c, F.lit("AUTHORITY"))
    ok = scheme.isNotNull() & (scheme != "") & authority.isNotNull() & (authority != "")
    return F.when(ok, F.concat(scheme, F.lit("://"), authority)).otherwise(F.lit(default))


def resolve_url(base, href) -> Column:
    """Join an href to a base origin: absolute and protocol-relative links pass,
    root-relative ones are appended to the origin, bare ones get a ``/``."""
    return join_origin(url_origin(base), href)


def join_origin(origin, href) -> Column:
    """``resolve_url`` with the base's origin, where it is a column made once for many links."""
    origin, href = col(origin), col(href)
    scheme = F.regexp_extract(origin, r"^([^:]*):", 1)
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("/") | href.startswith("?") | href.startswith("#"),
                  F.concat(origin, href))
            .otherwise(F.concat(origin, F.lit("/"), href)))


def with_radius(url, km) -> Column:
    """Set, replace or strip the ``r<km>`` suffix of the first code segment.

    Null km leaves the URL alone; km is truncated to an int; <= 0 strips; a URL
    without a code segment is unchanged."""
    url, km = col(url), col(km)
    prefix, path, rest = _parts(url)
    segs = F.split(path, "/")
    hit = F.array_position(F.transform(segs, lambda s: s.rlike(_CODE_SEGMENT)), F.lit(True))
    k = km.cast("bigint")
    suffix = F.when(k > 0, F.concat(F.lit("r"), k.cast("string"))).otherwise(F.lit(""))
    new_segs = F.transform(segs, lambda s, i: F.when(
        i + 1 == hit, F.concat(F.regexp_replace(s, _RADIUS_SUFFIX, ""), suffix)).otherwise(s))
    rebuilt = F.concat(prefix, F.array_join(new_segs, "/"), rest)
    return F.when(km.isNull() | (hit == 0), url).otherwise(rebuilt)


def page_url(url, n) -> Column:
    """URL of page ``n``: old ``seite:k`` and empty segments dropped; for n > 1 a
    ``seite:n`` segment goes before a last code segment, else at the end."""
    url, n = col(url), col(n)
    prefix, path, rest = _parts(url)
    segs = F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(_PAGE_SEGMENT))
    page_seg = F.array(F.concat(F.lit(PAGE_SEGMENT_FMT), n.cast("string")))
    n_segs = F.size(segs)
    last_is_code = (n_segs > 0) & F.coalesce(F.try_element_at(segs, F.lit(-1)).rlike(_CODE_SEGMENT), F.lit(False))
    paged = F.when(last_is_code, F.concat(F.slice(segs, 1, n_segs - 1), page_seg, F.slice(segs, -1, 1))) \
        .otherwise(F.concat(segs, page_seg))
    final = F.when(n > 1, paged).otherwise(segs)
    return F.concat(prefix, F.lit("/"), F.array_join(final, "/"), rest)


def infer_source_type(source_type, url) -> Column:
    """A valid trimmed lower-case type, else the portal when the URL names it,
    else the feed type."""
    st = F.lower(F.trim(col(source_type)))
    return (F.when(st.isin(*VALID_SOURCE_TYPES), st)
            .when(F.contains(F.lower(col(url)), F.lit(PORTAL_SOURCE)), F.lit(PORTAL_SOURCE))
            .otherwise(F.lit(FEED_SOURCE)))
