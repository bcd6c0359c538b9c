"""Extraction from landed page bodies.

``markup.scan_elements`` cuts a page into cards, and takes from each card the texts and
attributes that a declarative *spec* of elements (``Node``) names; the position in the page
is kept, as it is part of the fetch order.  What is made of them (numbers, links, identity)
is built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import join_origin, keyword_window, missing_attrs, parse_number, stable_id, strip_text, url_origin
from ..functions.text import PRICE_KEYWORDS, ROOMS_KEYWORDS, SQM_KEYWORDS
from .markup import Field, Node, scan_elements, scan_pages


@dataclass
class CardSpec:
    """Where a card and its fields are in a search page: the first such element counts."""
    source: str
    card: Node
    link: Node
    native_id: str | None = None  # attribute of the card
    price: Node | None = None
    location: Node | None = None
    description: Node | None = None
    tags: Node | None = None  # every one is a tag
    image: Node | None = None  # the first img inside it
    image_attributes: tuple[str, ...] = ("src", "data-imgsrc", "srcset")  # first non-empty wins


# The portal's search-result markup.
PORTAL_SPEC = CardSpec(
    source="kleinanzeigen",
    card=Node("article", "aditem"),
    native_id="data-adid",
    link=Node("a", "ellipsis"),
    price=Node("p", "aditem-main--middle--price-shipping--price"),
    location=Node("div", "aditem-main--top--left"),
    description=Node("p", "aditem-main--middle--description"),
    tags=Node("span", "simpletag"),
    image=Node("div", "aditem-image"),
)

# The test-data pages: every list item is a card, its link the title.
LINK_SPEC = CardSpec(source="board", card=Node("li"), link=Node("a"))


def parse_tags(tags) -> Column:
    """A3, first step: each tag once: has ``zimmer``, has ``m²``/``m2``, its number."""
    tags = F.col(tags) if isinstance(tags, str) else tags
    return F.transform(tags, lambda t: F.struct(
        F.contains(F.lower(t), F.lit("zimmer")).alias("z"),
        (F.contains(F.lower(t), F.lit("m²")) | F.contains(F.lower(t), F.lit("m2"))).alias("m"),
        parse_number(t).alias("num")))


def tag_numbers(parsed) -> tuple[Column, Column]:
    """A3: (rooms, sqm) from parsed tags (``parse_tags``).  The first tag containing
    ``zimmer`` with a number gives rooms; a tag reaches the ``m²``/``m2`` branch
    when it has no ``zimmer`` or comes after the tag that set rooms; the first such
    tag with a number gives sqm.  Project ``parse_tags`` into a column first: the
    parsed array is read three times here and Spark does not share a higher-order
    function's result between uses."""
    parsed = F.col(parsed) if isinstance(parsed, str) else parsed
    room_hit = F.array_position(F.transform(parsed, lambda s: s["z"] & s["num"].isNotNull()), F.lit(True))
    rooms = F.when(room_hit > 0, F.try_element_at(parsed, room_hit.cast("int"))["num"])
    sqm_vals = F.transform(parsed, lambda s, i: F.when(
        s["m"] & (~s["z"] | ((room_hit > 0) & (i + 1 > room_hit))), s["num"]))
    sqm = F.try_element_at(F.filter(sqm_vals, lambda x: x.isNotNull()), F.lit(1))
    return rooms, sqm


def with_tag_numbers(df: DataFrame, tags: str, rooms: str = "rooms", sqm: str = "sqm") -> DataFrame:
    """A3 as a DataFrame step: parse the tags once, then derive rooms and sqm."""
    x = df.withColumn("_tags_parsed", parse_tags(tags))
    r, s = tag_numbers("_tags_parsed")
    return x.withColumns({rooms: r, sqm: s}).drop("_tags_parsed")


def extract_cards(pages: DataFrame, spec: CardSpec = PORTAL_SPEC, body: str = "body", url: str = "url",
                  keep: list[str] | None = None) -> DataFrame:
    """A2: one listing row per card, in page order (``pos``).  A card without a
    title or a link is skipped; every other field degrades to null."""
    keep = keep if keep is not None else [c for c in pages.columns if c not in (body, url)]
    keep = [c for c in keep if c != url]
    named = {"link": spec.link, "price": spec.price, "location": spec.location, "description": spec.description,
             "image": spec.image}
    fields = {f"_{k}": Field(n, attributes=("href",) if k == "link" else ()) for k, n in named.items() if n}
    if spec.tags:
        fields["_tag"] = Field(spec.tags, every=True)
    if spec.image:
        fields["_img"] = Field(Node("img"), inside="_image", attributes=spec.image_attributes)
    # The origin is made once a page, below the scan: a URL takes longer to split than a card to find.
    landed = pages.withColumn("_origin", url_origin(url_origin(F.col(url))))
    cards = scan_elements(landed, body, spec.card, fields, [*keep, "_origin"],
                          root_attributes=(spec.native_id,) if spec.native_id else (), text=False)
    null = F.lit(None).cast("string")
    text = lambda k: F.col(f"_{k}_text") if named[k] else null
    title = text("link")
    href = F.col("_link_href")
    link = F.col("_link_url")
    native = F.col(f"root_{spec.native_id}") if spec.native_id else null
    thumb = F.coalesce(*[F.col(f"_img_{name}") for name in spec.image_attributes]) if spec.image else null
    tags = (F.transform("_tag_text", lambda t: F.coalesce(t, F.lit("")))
            if spec.tags else F.array().cast("array<string>"))
    cards = cards.withColumns({"_tags": parse_tags(tags), "_link_url": join_origin("_origin", href)})
    rooms, sqm = tag_numbers("_tags")
    out = cards.select(
        *keep, "pos",
        stable_id(F.lit(spec.source), native, link).alias("listing_id"),
        F.lit(spec.source).alias("source"),
        strip_text(title).alias("title"), link.alias("url"),
        parse_number(text("price")).alias("price"),
        rooms.alias("rooms"), sqm.alias("sqm"),
        text("location").alias("location"),
        text("description").alias("description"),
        thumb.alias("thumbnail"),
        title.isNotNull().alias("_has_title"), href.isNotNull().alias("_has_href"))
    out = out.filter(F.col("_has_title") & F.col("_has_href")).drop("_has_title", "_has_href")
    return out.withColumn("missing", missing_attrs())


@dataclass
class DetailSpec:
    """Where label/value pairs and extra fields are in a detail page."""
    item: Node
    value: Node
    price: Node
    description: Node
    checklist: Node


# The portal's detail-page markup.
PORTAL_DETAIL_SPEC = DetailSpec(
    item=Node("li", "addetailslist--detail"),
    value=Node("span", "addetailslist--detail--value"),
    price=Node(id="viewad-price"),
    description=Node(id="viewad-description-text"),
    checklist=Node(cls="checklisttag"),
)

# Detail labels (exact, lower-cased) -> (key, numeric?).
DETAIL_FIELD_MAP = {
    "wohnfläche": ("sqm", True),
    "zimmer": ("rooms", True),
    "schlafzimmer": ("bedrooms", True),
    "badezimmer": ("bathrooms", True),
    "etage": ("floor", False),
    "wohnungstyp": ("apartment_type", False),
    "nebenkosten": ("additional_costs", True),
    "warmmiete": ("warm_rent", True),
}
# Label prefixes for the two free-text keys.
DETAIL_PREFIXES = {"verfügbar": "available_from", "kaution": "deposit"}
DETAIL_OUT = ["price", "sqm", "rooms", "bedrooms", "bathrooms", "floor", "apartment_type", "available_from",
              "additional_costs", "warm_rent", "deposit", "description", "features"]


def detail_label(text, value) -> Column:
    """The label of a list item: its text minus the value text, colon-stripped, lower-cased."""
    rest = F.replace(F.coalesce(text, F.lit("")), F.coalesce(value, F.lit("\u0000")), F.lit(""))
    return F.lower(strip_text(F.regexp_replace(strip_text(rest), ":+$", "")))


def detail_pairs(pages: DataFrame, spec: DetailSpec = PORTAL_DETAIL_SPEC, key: str = "page_id",
                 body: str = "body") -> DataFrame:
    """A4 (first half): (key, pos, label, value) for each list item with a value."""
    items = scan_elements(pages, body, spec.item, {"_value": Field(spec.value)}, [key])
    value = F.col("_value_text")
    label = detail_label(F.col("root_text"), value)
    return items.select(key, "pos", label.alias("label"), value.alias("value")).filter(F.col("value").isNotNull())


def extract_details(pages: DataFrame, spec: DetailSpec = PORTAL_DETAIL_SPEC, key: str = "page_id",
                    body: str = "body", field_map: dict = DETAIL_FIELD_MAP,
                    prefixes: dict = DETAIL_PREFIXES) -> DataFrame:
    """A4: one row per page with the detail fields found.  Labels map exactly
    through ``field_map``; ``prefixes`` catch the free-text keys; the first
    occurrence of a key wins even when its number does not parse."""
    names = F.create_map(*[F.lit(x) for lbl, (name, _num) in field_map.items() for x in (lbl, name)])
    starts = F.create_map(*[F.lit(x) for prefix, name in prefixes.items() for x in (prefix, name)])

    def name_of(label):
        begun = F.filter(F.map_keys(starts), lambda p: label.startswith(p))
        return F.coalesce(F.try_element_at(names, label), F.try_element_at(starts, F.get(begun, 0)))
    whole = scan_pages(pages, body, spec.item, {"_value": Field(spec.value)},
                       {"_price": Field(spec.price), "_description": Field(spec.description),
                        "_check": Field(spec.checklist, every=True)}, [key])
    # The label is a long expression: made once, then looked up.
    valued = F.filter("elements", lambda e: e["_value_text"].isNotNull())
    pairs = F.transform(valued, lambda e: F.struct(detail_label(e["root_text"], e["_value_text"]).alias("label"),
                                                   e["_value_text"].alias("value")))
    found = whole.withColumn("_found", F.transform(pairs, lambda p: F.struct(name_of(p["label"]).alias("name"), p["value"])))
    wanted = sorted({n for n, _ in field_map.values()} | set(prefixes.values()))
    numeric = {name for name, num in field_map.values() if num}
    first = lambda n: F.get(F.filter("_found", lambda p: p["name"] == n), 0)["value"]
    wide = found.withColumns({f"_{n}_value": first(n) for n in wanted})
    return wide.select(
        key, parse_number("_price_text").alias("price"), F.col("_description_text").alias("description"),
        F.filter("_check_text", lambda t: t.isNotNull()).alias("features"),
        *[(parse_number(f"_{n}_value") if n in numeric else F.col(f"_{n}_value")).alias(n) for n in wanted])


def feed_item_xml(title, link, guid, description) -> Column:
    """Render an RSS ``<item>`` from columns (text escaped for XML)."""
    from ..functions import html_escape
    def el(tag, c):
        return F.when(c.isNotNull(), F.concat(F.lit(f"<{tag}>"), html_escape(c), F.lit(f"</{tag}>"))).otherwise(F.lit(""))
    return F.concat(F.lit("<item>"), el("title", title), el("link", link), el("guid", guid),
                    el("description", description), F.lit("</item>"))


# ``link`` is text in RSS and an attribute in Atom, where there may be several.
FEED_ITEM_SCHEMA = ("title string, link array<struct<_VALUE string, _href string, _rel string>>, id string, guid string, "
                    "summary string, description string, content string")


def _feed_listings(rows: DataFrame, keep: list[str], source: str) -> DataFrame:
    """The listing of each parsed feed item; one without a title or a link is skipped."""
    title = strip_text(F.coalesce(F.col("title"), F.lit("")))
    atom = F.filter("link", lambda x: x["_href"].isNotNull() & F.coalesce(x["_rel"], F.lit("alternate")).isin("alternate"))
    texts = F.filter("link", lambda x: F.coalesce(x["_VALUE"], F.lit("")) != "")
    link = F.coalesce(F.get(texts, 0)["_VALUE"], F.get(atom, 0)["_href"], F.lit(""))
    desc = F.coalesce(F.col("summary"), F.col("description"), F.col("content"))
    blob = F.concat(title, F.lit(" "), F.coalesce(desc, F.lit("")))
    native = F.coalesce(F.nullif(F.col("id"), F.lit("")), F.col("guid"))
    out = rows.select(*keep, stable_id(F.lit(source), native, link).alias("listing_id"), F.lit(source).alias("source"),
                      title.alias("title"), link.alias("url"),
                      parse_number(keyword_window(blob, PRICE_KEYWORDS)).alias("price"),
                      parse_number(keyword_window(blob, ROOMS_KEYWORDS)).alias("rooms"),
                      parse_number(keyword_window(blob, SQM_KEYWORDS)).alias("sqm"),
                      desc.alias("description"))
    return out.filter((F.col("title") != "") & (F.col("url") != ""))


def split_feed(feeds: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """A5, first step: a landed feed body as its RSS items or Atom entries, in order (``pos``, ``item_xml``)."""
    keep = keep if keep is not None else [c for c in feeds.columns if c != body]
    items = scan_elements(feeds, body, (Node("item"), Node("entry")), {}, keep, outer=True, xml=True)
    return items.select(*keep, "pos", F.col("root_outer").alias("item_xml"))


def extract_feed_items(items: DataFrame, xml: str = "item_xml", keep: list[str] | None = None,
                       source: str = "rss") -> DataFrame:
    """A5: RSS items and Atom entries to listings.  The native id is ``id`` then ``guid``;
    price/rooms/sqm come from keyword windows over ``title + " " + description``."""
    keep = keep if keep is not None else [c for c in items.columns if c != xml]
    parsed = items.select(*keep, F.from_xml(F.col(xml), FEED_ITEM_SCHEMA).alias("_i")).select(*keep, "_i.*")
    return _feed_listings(parsed, keep, source)


def read_feed_items(spark, path: str, row_tag: str = "item", source: str = "rss") -> DataFrame:
    """A5 over landed feed files: Spark's XML source with one row per ``row_tag`` (``entry`` for Atom)."""
    return _feed_listings(spark.read.format("xml").option("rowTag", row_tag).schema(FEED_ITEM_SCHEMA).load(path), [], source)
