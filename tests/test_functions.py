"""Expression case tables (FIXTURES §2)."""
import hashlib

import pytest
from pyspark.sql import functions as F

from roofline import functions as rf


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], schema=", ".join(
        f"{k} {t}" for k, t in _types(cols).items())).select(expr.alias("v")).first()
    return row.v


def _types(cols):
    out = {}
    for k, v in cols.items():
        out[k] = {str: "string", float: "double", int: "bigint", type(None): "string"}[type(v)]
    return out


NUMBER_CASES = [
    ("ab 743,20 EUR kalt", 743.2), ("Größe: 118 qm", 118.0), ("3.450", 3450.0), ("17.300,05 €", 17300.05),
    ("2.345.678", 2345678.0), ("4,75", 4.75), ("nach Vereinbarung", None), ("   ", None), (None, None),
    ("9,500.25", 9.5), ("6.25", 6.0), ("-81", 81.0), ("7.6543", 7654.0), ("4321.876", 4321.0), ("00042", 42.0),
    ("12,", 12.0), (",5", 5.0), ("Etage 4 von 9", 4.0), ("1.2.3", 1.0),
]


@pytest.mark.parametrize("text,expected", NUMBER_CASES)
def test_parse_number(spark, text, expected):
    assert one(spark, rf.parse_number("t"), t=text) == expected


def test_stable_id(spark):
    assert one(spark, rf.stable_id(F.lit("board"), "n", "u"), n="77-a", u="x") == "board:77-a"
    url = "https://homes.example/flat/31"
    expect = "rss:" + hashlib.sha1(url.encode()).hexdigest()[:16]
    assert one(spark, rf.stable_id(F.lit("rss"), "n", "u"), n=None, u=url) == expect
    assert one(spark, rf.stable_id(F.lit("rss"), "n", "u"), n="", u=url) == expect


# (price, sqm, rooms, location) and the text that is hashed; None: no signature.
SIGNATURE_CASES = [
    ((1340.0, 71.0, 3.0, "04109 Leipzig"), "1340|71|3|leipzig"),
    ((1339.6, 71.3, 3.0, "Leipzig"), "1340|71|3|leipzig"),
    ((1340.0, 71.0, None, None), "1340|71|?|"),
    ((1340.0, 71.0, 2.5, "Bad - Elster,  08645 "), "1340|71|2|bad elster"),
    ((6.5, 7.5, 3.5, ""), "6|8|4|"),
    ((None, 71.0, 3.0, "Leipzig"), None),
    ((1340.0, None, 3.0, "Leipzig"), None),
]


@pytest.mark.parametrize("cells,key", SIGNATURE_CASES)
def test_content_signature(spark, cells, key):
    df = spark.createDataFrame([cells], "p double, s double, r double, l string")
    got = df.select(rf.content_signature("p", "s", "r", "l").alias("v")).first().v
    assert got == (None if key is None else "sig:" + hashlib.sha1(key.encode()).hexdigest()[:16])


def test_haystack_and_strip(spark):
    assert one(spark, rf.strip_text("t"), t="  Schöne Wohnung \n") == "Schöne Wohnung"
    h = one(spark, rf.haystack("a", "b", "c"), a="Balkon", b=None, c="Berlin")
    assert h == "balkon  berlin"


def test_within_and_keywords(spark):
    df = spark.createDataFrame([(1200.0, 1.0, "2-Zimmer Tauschangebot")], "p double, r double, t string")
    r = df.select(
        rf.within("p", None, 1000.0).alias("a"), rf.within("r", 3.0, None).alias("b"),
        rf.within(F.lit(None).cast("double"), 1.0, 2.0).alias("c"),
        rf.excludes_keywords(F.lower("t"), F.array(F.lit("tausch"))).alias("d"),
        rf.requires_keywords(F.lower("t"), F.array(F.lit("balkon"))).alias("e"),
        rf.requires_keywords(F.lower("t"), F.lit(None).cast("array<string>")).alias("f"),
        rf.within("p", 2000.0, 1000.0).alias("g"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g) == (False, False, True, False, False, True, False)


TOWN = "https://portal.example/mieten/jena/c88l512"


@pytest.mark.parametrize("url,n,expected", [
    (TOWN, 1, TOWN), (TOWN, 7, "https://portal.example/mieten/jena/seite:7/c88l512"),
    ("https://portal.example/mieten/jena/seite:12/c88l512", 1, TOWN),
    ("https://portal.example/mieten/seite:3/c88", 9, "https://portal.example/mieten/seite:9/c88"),
    ("https://feeds.example/all?sort=new#top", 4, "https://feeds.example/all/seite:4?sort=new#top"),
])
def test_page_url(spark, url, n, expected):
    assert one(spark, rf.page_url("u", "n"), u=url, n=n) == expected


@pytest.mark.parametrize("url,km,expected", [
    (TOWN, 15.0, TOWN + "r15"), (TOWN, None, TOWN), (TOWN + "r30", None, TOWN + "r30"), (TOWN + "r30", 5.0, TOWN + "r5"),
    (TOWN + "r30", 0.0, TOWN), (TOWN, 7.8, TOWN + "r7"), ("https://feeds.example/all.xml", 15.0, "https://feeds.example/all.xml"),
])
def test_with_radius(spark, url, km, expected):
    df = spark.createDataFrame([(url, km)], "u string, k double")
    assert df.select(rf.with_radius("u", "k").alias("v")).first().v == expected


def test_format_attrs(spark):
    df = spark.createDataFrame([(2.5, 2.0, 65.5, "Berlin"), (1250.0, None, 82.0, None),
                                (None, None, None, "")], "p double, r double, s double, l string")
    got = [r.v for r in df.select(rf.format_attrs("p", "r", "s", "l").alias("v")).collect()]
    assert got == ["2 € · 2 Zi · 65.5 m² · Berlin", "1250 € · 82 m²", ""]


def test_html_escape_and_node_text(spark):
    assert one(spark, rf.html_escape("t"), t="<a href=\"x\">Tom & 'Jerry'</a>") == \
        "&lt;a href=&quot;x&quot;&gt;Tom &amp; &#x27;Jerry&#x27;&lt;/a&gt;"
    assert one(spark, rf.node_text("t"), t="<p> Hello <b>World</b>&amp; co </p>") == "Hello World & co"
    assert one(spark, rf.node_text("t"), t="<p>  </p>") is None


def test_settings_and_keywords(spark):
    assert one(spark, rf.to_double_setting("t"), t="2,5") == 2.5
    assert one(spark, rf.to_double_setting("t"), t="1.250") == 1.25
    assert one(spark, rf.to_double_cell("t"), t="1.250") == 1250.0
    assert one(spark, rf.keywords_cell("t"), t="Tausch, WG") == ["tausch", "wg"]
    assert one(spark, rf.keywords_cell("t"), t=" , ") is None
    assert one(spark, rf.to_bool_cell("t"), t=" Checked ") is True
    assert one(spark, rf.to_bool_cell("t"), t="") is True
    assert one(spark, rf.to_bool_cell("t"), t="nope") is False


def test_keyword_window(spark):
    assert one(spark, rf.keyword_window("t", ["€", "eur"]), t="Nice flat for 1.250 € warm") == "t for 1.250 €"
    assert one(spark, rf.keyword_window("t", ["zimmer"]), t="3 Zimmer") == "3 Zimmer"
    assert one(spark, rf.keyword_window("t", ["zimmer"]), t="none") is None


def test_retry_delay(spark):
    df = spark.createDataFrame([(0, None), (1, None), (2, None), (0, "7"), (0, "-3")], "a int, h string")
    got = [r.v for r in df.select(rf.retry_delay_seconds("a", "h").alias("v")).collect()]
    assert got == [2.0, 4.0, 8.0, 7.0, 0.0]
