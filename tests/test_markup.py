"""The tag scan against a small character-by-character stack parser, and on hard markup."""

import random
import time

from roofline.functions import node_text
from roofline.sources import extract as X
from roofline.sources.markup import VOID, Field, Node, attributes, scan

LETTER = "abcdefghijklmnopqrstuvwxyz"


def slow_elements(text):
    """(name, attributes, start, content start, content end) of every element, by reading characters."""
    out, stack, i = [], [], 0
    while i < len(text):
        if text.startswith("<!--", i):
            end = text.find("-->", i + 4)
            i = len(text) if end < 0 else end + 3
            continue
        closing = text.startswith("</", i)
        j = i + (2 if closing else 1)
        if text[i] != "<" or j >= len(text) or text[j].lower() not in LETTER:
            i += 1
            continue
        k = j
        while k < len(text) and text[k] not in " \t\n\r\f/>":
            k += 1
        name, attrs = text[j:k].lower(), {}
        # attributes: name, or name = value in either quote or none
        while k < len(text) and text[k] != ">":
            if text[k] in " \t\n\r\f/":
                k += 1
                continue
            m = k
            while k < len(text) and text[k] not in " \t\n\r\f/>=":
                k += 1
            key, value, n = text[m:k].lower(), "", k
            while n < len(text) and text[n] in " \t\n\r\f":
                n += 1
            if n < len(text) and text[n] == "=":
                n += 1
                while n < len(text) and text[n] in " \t\n\r\f":
                    n += 1
                if n < len(text) and text[n] in "\"'":
                    k = text.index(text[n], n + 1)
                    value, k = text[n + 1:k], k + 1
                else:
                    k = n
                    while k < len(text) and text[k] not in " \t\n\r\f>":
                        k += 1
                    value = text[n:k]
            if key:
                attrs.setdefault(key, value)
            else:
                k += 1
        if k >= len(text):
            i += 1
            continue
        own = text[k - 1] == "/"
        if closing:
            if name in [x[0] for x in stack]:
                while True:
                    top = stack.pop()
                    out.append((*top, i))
                    if top[0] == name:
                        break
        elif name in VOID or own:
            out.append((name, attrs, i, k + 1, k + 1))
        else:
            stack.append((name, attrs, i, k + 1))
            if name in ("script", "style"):
                end = text.lower().find(f"</{name}", k)
                stack.pop()
                out.append((name, attrs, i, k + 1, len(text) if end < 0 else end))
                k = len(text) - 1 if end < 0 else text.index(">", end)
        i = k + 1
    return sorted(out + [(*x, len(text)) for x in reversed(stack)], key=lambda x: x[2])


def random_markup(rng):
    words = ["one", "zwei", "&amp;", "<", "a > b", "=", "\n"]
    names = ["div", "p", "span", "li", "br", "img", "article"]
    out = []
    for _ in range(rng.randrange(60)):
        kind = rng.random()
        name = rng.choice(names)
        if kind < 0.35:
            value = rng.choice(["card", "card on", "x card", "x", ""])
            cls = rng.choice([f'class="{value}"', f"class='{value}'", "class=card", "CLASS = card", "class", "", f"data-c='class=card' class=\"{value}\"",
                              f'title="a > b" class="{value}"', "id=here", "id='here' class=x"])
            out.append(f"<{name.upper() if rng.random() < .2 else name} {cls}{' /' if rng.random() < .1 else ''}>")
        elif kind < 0.7:
            out.append(f"</{name}{' ' if rng.random() < .2 else ''}>")
        elif kind < 0.75:
            out.append(rng.choice(["<!-- <div class=card> -->", "<script>if (a<b) '<p class=card>'</script>", "<style>p > a {}</style>"]))
        else:
            out.append(rng.choice(words))
    return "".join(out)


def test_scan_equals_a_stack_parser():
    rng = random.Random(3)
    nodes = [Node("div", "card"), Node("p"), Node(None, "card"), Node(None, None, "here"), Node("span", "on"), Node("img")]
    seen = 0
    for _ in range(3000):
        text = random_markup(rng)
        slow = slow_elements(text)
        for node in nodes:
            want = [(s, text[a:b]) for name, attrs, s, a, b in slow if node.tag in (None, name)
                    and (node.cls is None or node.cls in attrs.get("class", "").split()) and (node.id is None or attrs.get("id") == node.id)]
            got = [(x.start, x.html) for x in scan(text, (node,), {})]
            assert got == want, (node, text)
            seen += len(want)
        # fields of cards: the first p and all spans inside
        inner = lambda c, n: [text[a:b] for name, _, s, a, b in slow if name == n and c[3] <= s < c[4]]
        cards = [x for x in slow if x[0] == "div" and "card" in x[1].get("class", "").split()]
        got = scan(text, (Node("div", "card"),), {"p": Field(Node("p")), "s": Field(Node("span"), every=True)})
        assert [([s[2] for s in x.fields.get("p", [])], [s[2] for s in x.fields.get("s", [])]) for x in got] == [
            (inner(c, "p")[:1], inner(c, "span")) for c in cards], text
    assert seen > 5000


def test_attributes_in_any_quote():
    assert attributes(""" a=1 B = 'x > y' c="d='e'" f g=/h/i?j=k&amp;l b=2 =""") == {
        "a": "1", "b": "x > y", "c": "d='e'", "f": "", "g": "/h/i?j=k&amp;l"}


def cards(spark, *bodies):
    pages = spark.createDataFrame([(i, "https://p.example/x", b) for i, b in enumerate(bodies)], "page_id long, url string, body string")
    return {(r.page_id, r.pos): r for r in X.extract_cards(pages, X.PORTAL_SPEC).collect()}


def card(inside, start="<article class=aditem data-adid=7>", link="<a class=ellipsis href=/s-7>Hell &amp; ruhig</a>"):
    return f"{start}{link}{inside}</article>"


def test_unquoted_attributes_make_a_card(spark):
    r = cards(spark, card('<p class=aditem-main--middle--price-shipping--price>1.250 &euro;</p>'))[0, 0]
    assert (r.listing_id, r.url, r.title, r.price) == ("kleinanzeigen:7", "https://p.example/s-7", "Hell & ruhig", 1250.0)


def test_fields_at_any_depth(spark):
    deep = lambda n: "<div>" * n + "10115 Berlin" + "</div>" * n + " Mitte"
    body = [card(f'<div class="aditem-main--top--left">{deep(n)}</div><div>other</div>') for n in (0, 3, 4, 50, 400)]
    got = cards(spark, *body)
    assert [got[i, 0].location for i in range(5)] == ["10115 Berlin Mitte"] * 5


def test_long_start_tags_and_many_quotes(spark):
    """A million bare characters, or a hundred thousand attributes, are read once; nothing recurses."""
    bare = f'<article class="aditem" data-adid="8" {"x" * 1_000_000}>'
    many = '<article class="aditem" data-adid="9" ' + " ".join(f'a{i}="{i}>"' for i in range(100_000)) + ">"
    price = f'<p class="aditem-main--middle--price-shipping--price"><b {"y" * 500_000}>7 &euro;</b><i {"z=1 " * 50_000}></i></p>'
    began = time.time()
    got = cards(spark, card(price, bare), card(price, many), card(price, "<article class='aditem' title='open>"))
    assert [(k, r.listing_id, r.price) for k, r in got.items()][:2] == [((0, 0), "kleinanzeigen:8", 7.0), ((1, 0), "kleinanzeigen:9", 7.0)]
    assert got[2, 0].listing_id.startswith("kleinanzeigen:") and got[2, 0].price == 7.0  # a quote that never ends is none
    assert time.time() - began < 60
    text = spark.createDataFrame([(f"<b {'q' * 300_000}>x</b><a title='" + "\"'" * 50_000 + "y",)], "h string").select(node_text("h")).first()[0]
    assert text.startswith("x")


def test_unclosed_and_stray_tags(spark):
    open_p = '<p class="aditem-main--middle--price-shipping--price">900 &euro;<div class="aditem-main--top--left">Jena'
    got = cards(spark, f"<div>{card('</b></em>' + open_p)}<article class=aditem><a class=ellipsis href=/2>Zwei</a>")
    assert [(k, r.title, r.location) for k, r in got.items()] == [((0, 0), "Hell & ruhig", "Jena"), ((0, 1), "Zwei", None)]
    ended = cards(spark, f"<div>{card('</div>' + open_p)}")  # the end of what is around it ends a card
    assert [(r.title, r.price) for r in ended.values()] == [("Hell & ruhig", None)]
    nested = card(card("<p class=aditem-main--middle--description>in</p>", link="<a class=ellipsis href=/in>Innen</a>"))
    got = cards(spark, nested)
    assert [(r.title, r.description) for r in got.values()] == [("Hell & ruhig", "in"), ("Innen", "in")]


def test_image_attributes_and_detail_elements_by_id(spark):
    got = cards(spark, card("<div class=aditem-image><span><img src='' data-imgsrc=/a.jpg></span></div><img src=/no.jpg>"), card("<img src=/no.jpg>"))
    assert [r.thumbnail for r in got.values()] == ["/a.jpg", None]
    page = "<h2 id=viewad-price><span><h2>1.100</h2> &euro;</span> VB</h2><p id='viewad-description-text'>A<div><p>B</p>C</div></p>"
    r = X.extract_details(spark.createDataFrame([(1, page)], "page_id long, body string")).first()
    assert r.price == 1100.0 and r.description == "A B C"


def test_feed_bodies_split_at_their_own_end_tags(spark):
    body = ("<rss><channel><link>https://f</link><item><title>A</title><link>https://f/1</link>"
            "<description><![CDATA[</item><b>70 m2</b>]]></description></item><ITEM/>"
            "<entry><title>B</title><link href='https://f/2'/><summary>x</summary></entry></channel></rss>")
    feeds = spark.createDataFrame([(1, body), (2, None), (3, "")], "feed long, body string")
    rows = X.extract_feed_items(X.split_feed(feeds), keep=["feed", "pos"]).orderBy("pos").collect()
    assert [(r.feed, r.pos, r.title, r.url) for r in rows] == [(1, 0, "A", "https://f/1"), (1, 1, "B", "https://f/2")]
    assert rows[0].sqm == 70.0
