"""Text expressions.

Python's ``str.strip``, ``\\s``, ``\\d`` and ``\\b`` are Unicode-aware; Spark's
``trim`` only removes spaces, so the Unicode forms are spelled with ``(?U)``.
"""

from __future__ import annotations

import json
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

# Lower-cased markers a portal shows on a page whose ad is gone.
REMOVED_MARKERS = [
    "ist nicht mehr verfügbar",
    "wurde gelöscht",
    "nicht mehr verfügbar",
    "anzeige wurde nicht gefunden",
]

# Keyword lists used to cut a number window out of feed text.
PRICE_KEYWORDS = ["€", "eur", "miete"]
ROOMS_KEYWORDS = ["zimmer"]
SQM_KEYWORDS = ["m²", "m2"]

# The named character references of HTML, from the standard library: with ``;`` all of
# them, without it only the old ones, of which the longest that fits is meant.
_NAMED = json.dumps({k[:-1]: v for k, v in entities.html5.items() if k.endswith(";")})
_OLD = "|".join(sorted((k for k in entities.html5 if not k.endswith(";")), key=len, reverse=True))
_REFERENCE = r"^(?:#[0-9]{1,7};?|#[xX][0-9A-Fa-f]{1,6};?|[A-Za-z][A-Za-z0-9]*;|(?:" + _OLD + "))"


def _windows(byte: int) -> str:
    try:
        return bytes([byte]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(byte)


_WINDOWS = "".join(map(_windows, range(128, 160)))


def strip_text(c) -> Column:
    """Python ``str.strip()``: Unicode white space off both ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def normalize_location(c) -> Column:
    """Lower, 5-digit postal codes out, runs of white space/``-``/``,`` to one space."""
    low = F.lower(col(c))
    no_zip = F.regexp_replace(low, r"(?U)\b\d{5}\b", " ")
    squeezed = F.regexp_replace(no_zip, r"(?U)[\s\-,]+", " ")
    return F.coalesce(F.trim(squeezed), F.lit(""))


def haystack(title, location, description) -> Column:
    """Title, location and description (null as empty) joined by spaces, lower-cased."""
    parts = [F.coalesce(col(x), F.lit("")) for x in (title, location, description)]
    return F.lower(F.concat_ws(" ", *parts))


def html_escape(c) -> Column:
    """``html.escape(s, quote=True)``; ``&`` first."""
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def bounded_text(c, limit: int = 2000) -> Column:
    """Keep the first ``limit`` characters."""
    c = col(c)
    return F.when(c.isNotNull(), F.substring(c, 1, limit))


def is_removed_text(c, markers=REMOVED_MARKERS) -> Column:
    """Lower-cased body contains any removal marker."""
    low = F.lower(col(c))
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m))
    return out


def keywords_cell(c) -> Column:
    """Split on ``,``, strip, lower, drop blanks; nothing left is null (inherit)."""
    c = col(c)
    items = F.filter(F.transform(F.split(c.cast("string"), ","), lambda k: F.lower(strip_text(k))),
                     lambda k: k != "")
    return F.when(c.isNotNull() & (F.size(items) > 0), items)


def keyword_window(c, keywords) -> Column:
    """For the first keyword in list order that occurs (case-insensitive), the text
    from 12 characters before it through its end; null when none occurs."""
    c = col(c)
    low = F.lower(c)
    out = F.lit(None).cast("string")
    for kw in reversed(list(keywords)):
        pos = F.locate(kw, low)  # 1-based, 0 = absent
        start = F.greatest(F.lit(1), pos - 12)
        window = F.substring(c, start, pos + F.lit(len(kw)) - start)
        out = F.when(pos > 0, window).otherwise(out)
    return out


def format_g(c) -> Column:
    """Python ``format(x, 'g')``: integral values without decimals, others with six
    significant digits and trailing zeros removed (exact for |x| < 1e6)."""
    x = col(c)
    sig6 = F.format_string("%.6g", x)
    mantissa = F.regexp_extract(sig6, r"^([^e]*)(e.*)?$", 1)
    exponent = F.regexp_extract(sig6, r"^([^e]*)(e.*)?$", 2)
    trimmed = F.concat(F.regexp_replace(mantissa, r"\.?0+$", ""), exponent)
    trimmed = F.when(F.contains(mantissa, F.lit(".")), trimmed).otherwise(sig6)
    integral = (x == F.rint(x)) & (F.abs(x) < 1e6)
    return F.when(x.isNull(), None).when(integral, F.rint(x).cast("bigint").cast("string")) \
        .otherwise(trimmed)


def format_attrs(price, rooms, sqm, location) -> Column:
    """``"{price:.0f} €"``, ``"{rooms:g} Zi"``, ``"{sqm:g} m²"``, location; nulls
    skipped, joined by `` · ``.  ``.0f`` rounds half-even, hence ``rint``."""
    price, rooms, sqm, location = (col(x) for x in (price, rooms, sqm, location))
    p = F.when(price.isNotNull(), F.concat(F.rint(price).cast("bigint").cast("string"), F.lit(" €")))
    r = F.when(rooms.isNotNull(), F.concat(format_g(rooms), F.lit(" Zi")))
    s = F.when(sqm.isNotNull(), F.concat(format_g(sqm), F.lit(" m²")))
    loc = F.when(location != "", location)
    return F.concat_ws(" · ", p, r, s, loc)


def _code_point(n: Column) -> Column:
    """The character of a number; U+FFFD for none.  Numbers 128-159 mean Windows-1252."""
    char = lambda x: F.decode(F.unhex(F.lpad(F.hex(x), 8, "0")), "UTF-32")
    old = F.substr(F.lit(_WINDOWS), (n - 127).cast("int"), F.lit(1))
    bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(bad, F.lit("\ufffd")).when(n.between(128, 159), old).otherwise(char(n))


def _decode_one(part: Column) -> Column:
    """A piece of text that followed an ``&``, its reference decoded if it begins with one."""
    ref = F.regexp_extract(part, _REFERENCE, 0)
    name = F.regexp_replace(ref, ";$", "")
    number = F.when(F.substring(name, 2, 1).isin("x", "X"), F.conv(F.substring(name, 3, 6), 16, 10)) \
        .otherwise(F.substring(name, 2, 7)).cast("bigint")
    named = F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), name)
    # A name that is none, with ``;``, may still begin with one of the old names.
    old = F.regexp_extract(part, "^(?:" + _OLD + ")", 0)
    old_char = F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), old)
    return (F.when(name.startswith("#"), F.concat(_code_point(number), F.substr(part, F.length(ref) + 1)))
            .when((ref != "") & named.isNotNull(), F.concat(named, F.substr(part, F.length(ref) + 1)))
            .when((old != "") & old_char.isNotNull(), F.concat(old_char, F.substr(part, F.length(old) + 1)))
            .otherwise(F.concat(F.lit("&"), part)))


def decode_entities(c) -> Column:
    """Every named and numeric character reference of a text decoded, once."""
    c = col(c)
    parts = F.split(c, "&")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), _decode_one)
    return F.when(F.contains(c, F.lit("&")), F.concat(F.element_at(parts, 1), F.array_join(rest, ""))).otherwise(c)


# A tag: its quoted attribute values may hold ">".  Possessive throughout: a tag of any length is read once,
# without recursion.
TAG = r"""<(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>"""


def node_text(html) -> Column:
    """Text pieces of a fragment, each stripped, joined by one space, entities
    decoded; empty is null.  Script/style bodies and comments are not text."""
    h = F.regexp_replace(col(html), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*+>", "<x>")
    pieces = F.transform(F.split(h, TAG), lambda p: strip_text(decode_entities(p)))
    joined = F.array_join(F.filter(pieces, lambda p: p != ""), " ")
    return F.when(joined != "", joined)
