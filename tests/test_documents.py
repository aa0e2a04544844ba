from datetime import datetime

import pytest

from loomwork.functions import css, structure, urls, values
from loomwork.functions.document import Document, dig, json_leaves, json_skeleton, records_path, region, sniff_charset, sniff_kind
from loomwork.functions.dom import parse_html, parse_xml
from loomwork.functions.signals import flags, is_block, signals, transport_remedy

PAGE = """<!DOCTYPE html><html lang="en"><head><title> A  page </title><meta name=description content="about"><meta property="og:title" content="OG">
<link rel="canonical" href="/c"><link rel="alternate" type="application/rss+xml" href="/feed">
<script type="application/ld+json">{"@type": "Product"}</script><script type="application/ld+json">{broken</script><script>var t="</p>";</script></head>
<body><nav><a href="/n">N</a></nav><main><h1>Head</h1><p>One <b>two</b> three<p>Four &amp; five<br>six
<ul class="items"><li class="x a1">1<li class=x>2<li class=x>3</ul>
<table><tr><th>Cat<th>Item<th></tr><tr><td rowspan=2>Fruit<td>Apple<td>1<tr><td>Pear<td>2</table></main></body></html>"""


def test_tree_and_selectors():
    root = parse_html(PAGE)
    sel = lambda s: [n.text for n in css.select_all(root, s)]
    assert sel("main > p") == ["One two three", "Four & fivesix"]
    assert sel("ul.items li") == ["1", "2", "3"]
    assert sel("li:first-child, li:last-child") == ["1", "3"]
    assert sel("li:nth-child(2n+1)") == ["1", "3"] and sel("li:nth-child(even)") == ["2"]
    assert sel("h1 + p") == ["One two three"] and len(sel("h1 ~ p")) == 2
    assert sel("li[class~=a1]") == ["1"] and sel("[class^=x]") == ["1", "2", "3"] and sel('a[href="/n"]') == ["N"]
    assert sel("li:not(.a1)") == ["2", "3"]
    assert root.at(css.select(root, "td").path()).text == "Fruit"
    li = css.select(root, "li")
    assert css.select(li, "li") is li
    for bad in ("", "a >", "> a", "a,", "[x", "a:unknown", "a::before(", "!"):
        with pytest.raises(css.SelectorError):
            css.compiled(bad)


def test_malformed_markup():
    doc = Document("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", url="http://h/")
    assert [n.text for n in doc.select_all("li")] == ["a", "bc", "c", "d"]
    assert [n.text for n in Document("<dl><dt>a<dd>b<dt>c</dl>").select_all("dt")] == ["a", "c"]
    assert Document("<p>a<div>b</div>", "text/html").select("div").parent.tag == "body"
    assert parse_html("<b>x</b>").tag == "b"
    assert parse_html("").tag == "html"
    assert parse_xml("<r xmlns='u'><pubDate>1</pubDate></r>").elements[0].tag == "pubDate"


def test_page_functions():
    doc = Document(PAGE, "text/html", "http://h.com/d/")
    meta = doc.metadata()
    assert (meta["title"], meta["description"], meta["canonical"], meta["og"], meta["ld_json"], meta["feeds"]) == ("A page", "about", "http://h.com/c", {"title": "OG"}, [{"@type": "Product"}], ["http://h.com/feed"])
    assert doc.tables() == [{"Cat": "Fruit", "Item": "Apple", "col2": "1"}, {"Cat": "Fruit", "Item": "Pear", "col2": "2"}]
    assert doc.tables(transpose=True)[0] == {"Cat": "Item", "Fruit": "Pear"}
    assert doc.outline() == [(1, "Head")]
    assert doc.readable().startswith("Head One two three Four & five") and "N" not in doc.readable(False).split()[:1]
    md = doc.markdown()
    assert "# Head" in md and "One **two** three" in md and "- 1\n- 2" in md and "| Fruit | Apple | 1 |" in md
    assert "six" not in doc.markdown(tails=False) and "six" in md
    assert region(doc.select("li")) == "main" and region(doc.select("nav a")) == "nav"
    assert doc.links() == ["http://h.com/n"] and doc.regex(r"lang=\"(\w+)", 1) == "en" and doc.regex("x", 4) is None
    listed = Document('<main><ul class="items">' + "".join(f'<li class="card e1d6xluq5"><a href="/{k}">x</a> y' for k in range(4)) + "</ul></main>", "text/html")
    top = structure.records(listed)[0]
    assert (top.item_selector, top.count, top.container_selector) == ("li.card", 4, "ul.items")
    assert "ul.items *4" in structure.skeleton(listed)
    wrapped = Document("<div>" + '<div class="mt-6"><div><article class="card"><p>a<p>b</article></div></div>' * 3 + "</div>", "text/html")
    assert structure.records(wrapped)[0].item_selector == "article.card"


def test_kinds():
    assert [sniff_kind(*x) for x in (("", b'{"a":1}'), ("", b"<!doctype html>"), ("", b"<rss/>"), ("", b"plain"), ("", b"\xff\xfe\x00"), ("application/octet-stream", b"[1]"), ("text/plain", b"<html>"), ("application/ld+json", b""))] == ["json", "html", "xml", "text", "binary", "json", "text", "json"]
    assert sniff_charset("text/html; charset=latin-1", b"") == "iso8859-1" and sniff_charset("", b'<meta charset="nope">') == "utf-8"
    value = {"data": {"results": [{"name": "Ann", "n": 1}, {"name": "", "ok": True}]}}
    assert dig(value, "data.results[0].name") == "Ann" and dig(value, "data.results[-1].ok") is True and dig(value, "data.results[9]") is None and dig(value, "") is value
    assert records_path(value) == "data.results" and json_leaves(value) == ["Ann", "1", "", "true"]
    assert "[2]" in json_skeleton(value)


def test_values():
    assert [values.number(x) for x in ("£1,251.77", "Three", "-4 x", True, None, "none", ".5")] == [1251.77, 3, -4, 1, None, None, 0.5]
    now = datetime(2026, 9, 30, 12, 0)
    when = lambda s, **k: values.date_time(s, now=now, **k)
    assert when("17:09 BST") == "2026-09-30T17:09:00+01:00"
    assert when("2 hours ago") == "2026-09-30T10:00:00"
    assert [values.date(s, now=now) for s in ("18 Sep 2026", "Sep 18th, 2026", "2026/09/18", "09/18/2026", "18/09/26", "on 2026-09-18T10:00Z", "yesterday", "no digits here", "31 Feb 2026")] == ["2026-09-18"] * 6 + ["2026-09-29", None, None]
    assert values.date("01/02/2026", dayfirst=True) == "2026-02-01" and values.date("x", format="%Y") is None
    assert values.split("a, b,, c", ",") == ["a", "b", "c"] and values.split(None) == [] and values.split("a1b2c", r"\d", regex=True) == ["a", "b", "c"]
    assert values.lookup(" THREE ", {"three": 3}) == 3 and values.lookup("x", {}, 0) == 0
    assert values.equal(None, None) and not values.equal(None, "") and not values.equal(3, "3") and not values.less("a", 1) and values.less(1, 2.5)
    assert values.row_identity({"b": 1, "a": "x", "_c": 2}) == values.row_identity({"a": "x", "b": 1})


def test_classes_and_selectors():
    noise = structure.is_noise_class
    assert all(map(noise, ("e1d6xluq5", "css-1a2b3c", "mt-6", "flex", "text-center", "aB3xY"))) and not any(map(noise, ("col-xs-6x"[:4], "product_pod", "title", "card")))
    assert structure.class_hook("ssrcss-evdvfk-StyledListItem") == '[class*="StyledListItem"]' and structure.stable_stem("Button_a1B2c") == "Button"
    assert structure.normalise('ul > li.Button_a1B2c[title="a > b"]') == 'ul li[class*="Button"][title="a > b"]' and structure.normalise("//a/b") == "//a/b"
    assert structure.problems("div", "records") and structure.problems("", "field") == ["empty"] and not structure.problems("li.product", "records")


def test_signals():
    spa = Document('<html><body><div id="root"></div><script>x</script></body></html>', "text/html")
    assert {f.name: f.confidence for f in flags(spa)}["needs_browser"] == 0.94 and transport_remedy(spa) == "escalate:browser"
    wall = Document("<html><body>Just a moment...</body></html>", "text/html")
    assert is_block(wall) and signals(wall)["js_challenge"].confidence == 0.85
    assert "ip_blocked" not in {f.name for f in flags(wall, 403)} and flags(Document("<p>" + "x " * 300, "text/html"), 403)[0].name == "ip_blocked"
    assert transport_remedy(Document("<p>" + "x " * 300, "text/html"), 429) == "retry:backoff"
    assert flags(Document("{}", ""), 503)[0].remedy == "retry" and not is_block(wall, 503)


def test_urls():
    assert urls.canonical("HTTP://Ex.com:80/a/?utm_source=x&b=2&a=1#f") == "http://ex.com/a?a=1&b=2" and urls.canonical("http://ex.com") == "http://ex.com/"
    assert urls.registrable("http://a.b.co.uk/x") == "b.co.uk" and urls.registrable("http://www.x.com") == "x.com"
    rules, maps = urls.parse_robots("User-agent: a\nUser-agent: b\nDisallow: /x\nAllow: /x/y\n\nUser-agent: *\nDisallow: /*.pdf$\nSitemap: http://s/m.xml", "b")
    assert maps == ["http://s/m.xml"] and not urls.robots_allows(rules, "http://h/x/z") and urls.robots_allows(rules, "http://h/x/y1")
    star, _ = urls.parse_robots("User-agent: *\nDisallow: /*.pdf$", "zz")
    assert not urls.robots_allows(star, "http://h/a.pdf") and urls.robots_allows(star, "http://h/a.pdf?x")
    assert urls.set_param("http://h/?a=1&page=2", "page", 3) == "http://h/?a=1&page=3"


def test_open_references():
    """A named reference without its semicolon stays in titles, headings and links; the reading views show it as browsers do."""
    page = '<html><head><title>a &amp;&amp</title><script>x = "&amp b"</script></head><body><!-- &amp c --><article><h1>a &amp;&amp</h1><p title="&lt">b &copy; &unknown; &ampx; 3 < 4 &lt</p><a href="/x">&quot</a></article></body></html>'
    d = Document(page, "text/html", "http://a.example/")
    assert d.select("title").text == d.select("h1").text == d.metadata()["title"] == "a &&amp"
    assert d.select("p").text == "b © &unknown; &ampx; 3 < 4 &lt" and d.select("p").attrs["title"] == "<"
    assert d.select("script").text == 'x = "&amp b"' and d.select("a").text == "&quot"
    assert "<!-- &amp c -->" in d.root.html()
    assert d.readable() == 'a && b © &unknown; &x; 3 < 4 < "'
    assert "a &&\n" in d.markdown()
