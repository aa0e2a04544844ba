from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomwork.functions import columns as N
from loomwork.functions import values
from loomwork.operators import pages as P
from loomwork.operators import policies, reports
from loomwork.operators.engine import Engine, Query, union
from loomwork.plans import author
from loomwork.plans.ir import Plan, PlanError
from loomwork.plans.record import from_source, wq
from loomwork.sources.snapshots import snapshots
from loomwork.streaming import stream

SHOP = """<html><body><ul id="l"><li class="p"><a href="/d1">One</a><i>£1,200.50</i><time>18 Sep 2026</time></li><li class=p><a href="/d2">Two</a><i>Three</i></li>
<li class="p"><a href="/d2">Two</a><i></i></li></ul><p class=t>T1<p class=d>D1<p class=t>T2</body></html>"""
PAGES = [("http://s/x", SHOP), ("http://s/d1", "<p class=s>SKU-1 <b>z</b></p>"), ("http://s/d2", "<p class=s>SKU-2</p>"), ("http://s/j", '{"data":{"items":[{"n":1,"t":{"v":"a"}},{"n":2}]}}')]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, snapshots(spark.createDataFrame([(*p, "") for p in PAGES], "url string, html string, content_type string")), datetime(2026, 9, 30))


def rows(engine, chain):
    return [r.asDict(True) for r in engine.rows(Query.of(chain)).orderBy("_url", "_pos").collect()]


def shop():
    return wq.reference("http://s/x").resolve().select_all("li.p")


def test_extract_filter_when(engine):
    got = rows(engine, shop().extract(t=wq.doc.select("a").text(), p=wq.doc.select("i").number(), big=wq.when(wq.field("p") > 100).then("yes").otherwise("no"), w=wq.doc.select("time", optional=True).text().date(), const="c").filter(wq.is_ok(wq.field("p"))))
    assert [(r["t"], r["p"], r["big"], r["w"], r["const"]) for r in got] == [("One", 1200.5, "yes", "2026-09-18", "c"), ("Two", 3.0, "no", None, "c")]
    assert got[0]["_identity"] == values.row_identity({"t": "One", "p": 1200.5, "big": "yes", "w": "2026-09-18", "const": "c"})


def test_predicates(engine):
    text = lambda p: [r["t"] for r in rows(engine, shop().extract(t=wq.doc.select("a").text(), i=wq.doc.select("i").text()).filter(p))]
    assert text((wq.field("t") == "Two") & ~wq.is_empty(wq.field("i"))) == ["Two"]
    assert text((wq.field("t") == "One") | wq.is_empty(wq.field("i"))) == ["One", "Two"]
    assert text(wq.field("t") < 5) == [] and text(wq.field("nothing") != "") == ["One", "Two", "Two"]
    assert text(wq.doc.select("time", optional=True).is_ok()) == ["One"]


def test_nested_and_chained_resolve(engine):
    got = rows(engine, shop().extract(t=wq.doc.select("a").text(), d=wq.doc.select("a").attr("href").resolve().extract(sku=wq.doc.select(".s").text().regex(r"\w+-\d+"))).filter(wq.field("t") == "Two"))
    assert [r["d"]["sku"] for r in got] == ["SKU-2", "SKU-2"] and got[0]["_identity"] == got[1]["_identity"]
    assert [r["value"] for r in rows(engine, shop().select("a").attr("href").resolve().select(".s").text())] == ["SKU-1 z", "SKU-2"]
    flat = rows(engine, shop().extract(d=wq.doc.select("a").attr("href").resolve().extract(sku=wq.doc.select(".s").text())).project(flatten=True, distinct=True))
    assert sorted(r["d.sku"] for r in flat) == ["SKU-1 z", "SKU-2"]


def test_misses_are_loud_unless_optional(engine):
    with pytest.raises(Exception, match="select.miss"):
        rows(engine, wq.reference("http://s/x").resolve().select("h9").text())
    assert rows(engine, wq.reference("http://s/x").resolve().select("h9", optional=True).text()) == []
    with pytest.raises(Exception, match="resolve.miss"):
        rows(engine, wq.reference("http://s/gone").resolve().text())
    assert rows(engine, wq.reference("http://s/gone").resolve(optional=True).text()) == []
    loose = Query.of(shop().extract(w=wq.doc.select("time").text())).lenient()
    assert [r.w for r in engine.rows(loose).orderBy("_pos").collect()] == ["18 Sep 2026", None, None]


def test_collections(engine):
    names = shop().extract(t=wq.doc.select("a").text())
    assert [r["t"] for r in rows(engine, names.skip(1).limit(1))] == ["Two"] and [r["t"] for r in rows(engine, names.limit(-1))] == ["One", "Two"]
    assert [r["t"] for r in rows(engine, names.project(distinct=True))] == ["One", "Two"] == [r["t"] for r in rows(engine, names.distinct())]
    assert rows(engine, shop().select("a").text().first())[0]["value"] == "One"
    tags = rows(engine, wq.reference("http://s/x").resolve().extract(all=wq.doc.select_all("li a").text(), parts=wq.doc.select("i").split(",")))
    assert tags[0]["all"] == ["One", "Two", "Two"] and tags[0]["parts"] == ["£1", "200.50"] and tags[0]["_url"] == "http://s/x"


def test_siblings(engine):
    got = rows(engine, wq.reference("http://s/x").resolve().select_all("p.t").extract(t=wq.doc.text(), d=wq.doc.next("p.d", stop="p.t", optional=True).text(), b=wq.doc.prev("", optional=True).tag()))
    assert [(r["t"], r["d"], r["b"]) for r in got] == [("T1", "D1", "ul"), ("T2", None, "p")]


def test_json(engine):
    got = rows(engine, wq.reference("http://s/j").resolve().select_all("data.items").extract(n=wq.doc.select("n").number(), v=wq.doc.select("t.v")))
    assert [(r["n"], r["v"]) for r in got] == [(1.0, "a"), (2.0, None)]


def test_union_and_documents(engine):
    a = Query.of(shop().extract(t=wq.doc.select("a").text(), u=wq.doc.select("a").attr("href")))
    b = Query.of(wq.reference("http://s/x").resolve().select_all("p.t").extract(x=wq.doc.text()))
    assert union(engine, [a, b]).count() == 5
    assert engine.documents(engine.rows(a), "u").select("url").distinct().count() == 2


def test_plans_round_trip():
    chain = shop().extract(a=wq.doc.select("a").map({"x": 1}).get(2), w=wq.when(~wq.is_ok(wq.field("a")) & (wq.field("b") >= 2)).then(wq.doc.text()).otherwise(None)).filter(wq.field("a") != "x").identity("a")
    plan = chain.plan
    assert from_source(plan.to_source()) == plan
    assert Plan.from_blob(plan.to_blob()).to_source() == plan.to_source()
    assert "select_all" in plan.describe()
    for bad in ("wq.doc.__class__", "os.system('x')", "wq.doc.select(*[1])", "wq.doc.nope()", "wq.doc.select(", "(lambda: 1)()", "wq.doc if 1 else 2", "wq.doc.select({'a': 1})", "__import__('os')", "1 < wq.doc < 2"):
        with pytest.raises(PlanError):
            from_source(bad)
    for blob in ("[]", "{", '{"root":"x"}', '{"root":"doc","steps":[{"kind":"call","name":"_x"}]}', '{"root":"doc","steps":[{"kind":"op","name":"%"}]}'):
        with pytest.raises(PlanError):
            Plan.from_blob(blob)
    with pytest.raises(PlanError):
        bool(wq.doc.text())
    with pytest.raises(PlanError):
        Query.of(wq.doc.explode())


def test_authoring():
    plan = author.compile_reply("Sure:\n```python\nwq.doc.select_all(“ul > li.Button_a1B2c”)\\\n.extract(t=wq.doc.text())\n```".replace("\\\n", "\n"))
    assert plan.steps[0].args == ('ul li[class*="Button"]',)
    source = author.compile_source("http://h/", "li.p", [author.FieldSpec("t", "a"), author.FieldSpec("p", "i", verb="number", required=False), author.FieldSpec("u", "a", "href", required=False)])
    assert from_source(source).url == "http://h/" and "optional=True" in source
    assert author.reroot(wq.doc.select("a").plan, "http://h/", "basic").to_source() == "wq.reference('http://h/').resolve(profile='basic').select('a')"
    brief = author.Brief.load("---\nfields:\n  - {name: when, type: date}\n  - {name: pdf, type: file, required: false}\nexpect_rows: 5+\narguments: {city: Rome}\n---\nEvents in {city}")
    assert brief.render() == "Events in Rome" and brief.required() == ["when"] and brief.dated() == ["when"] and brief.documents() == ["pdf"]
    replies = iter(["nonsense", 'ok: {"a": 1}'])
    assert author.ask_json(lambda _: next(replies), "?") == {"a": 1}
    calls = []
    stages = {s: (lambda st, s=s: calls.append(s) or ({"repair": "x"} if s == "author_review" and "repair" not in st.brief else {})) for s in author.STAGES}
    state = author.run_stages(author.Onboarding({}), stages, until="expand")
    state = author.run_stages(author.Onboarding.loads(state.dumps()), stages)
    assert calls.count("search") == 1 and calls.count("author_extract") == 2 and state.next_stage() is None


def test_native_leaves_agree_with_python(spark):
    texts = ["£1,251.77", "Three", "-4 x", "", "none", ".5 a", "18 Sep 2026", "Sep 18th, 2026", "2026/09/18", "09/18/2026", "18/09/26", "on 2026-09-18", "31 Feb 2026", "13/13/2026", " a , b,,c ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, n, d, s, e in df.select("t", N.number(F.col("t")), N.date(F.col("t")), N.split(F.col("t"), ","), N.identity(["t"])).collect():
        want = values.number(t)
        assert n == (None if want is None else float(want))
        if t is None or not any(c.isdigit() for c in t) or "-4" in t or t[0] in "£." or d is not None:
            assert d is None or d == values.date(t)
        assert s == values.split(t, ",")
        assert e == values.row_identity({"t": t})
    odd = ['q"\\/\u0001\t\n', "é ☃ 𝄞", "</x>"]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select(N.identity(["t"])).collect()
    assert [x[0] for x in got] == [values.row_identity({"t": t}) for t in odd]


def test_reports(spark):
    df = spark.createDataFrame([("a", "2026-01-02", "i1"), ("", None, "i1"), ("b", "2026-01-05", "i2"), (None, None, None)], "name string, day string, _identity string")
    r = reports.report(df, ["name", "day", "absent"], ["day"], "2-3", "2026-01-06").first().asDict()
    assert (r["rows"], r["fill_name"], r["fill_day"], r["fill_absent"], r["duplicates"], r["newest"], r["age_days"], r["note"], r["ok"]) == (4, 0.5, 0.5, 0.0, 1, "2026-01-05", 1.0, "ABOVE", False)
    assert [reports.parse_range(s) for s in ("10-50", "~20", ">=5", "5+", "<200", "<=200", "40", "x")] == [(10, 50), (10, 40), (5, 10**9), (5, 10**9), (0, 199), (0, 200), (30, 51), None]
    both = reports.merge_reports(spark.createDataFrame([(3, 1.0), (1, 0.0)], "rows long, fill_a double")).first()
    assert (both.rows, both.fill_a) == (4, 0.75)
    assert [x._issues for x in reports.issues(df, ["name", "day"]).collect()] == [[], ["missing name", "missing day"], [], ["missing name", "missing day"]]
    assert reports.append_new(df, None, ["name"]).count() == 3


def corpus(spark, pages):
    return snapshots(spark.createDataFrame(pages, "url string, html string"))


def test_pagination(spark):
    links = corpus(spark, [(f"http://h/{k}", f'<a rel="next" href="/{(k + 1) % 3}">n</a>') for k in range(3)])
    start = spark.createDataFrame([("http://h/0",)], "url string")
    assert [(x.page, x.url) for x in P.paginate_links(start, links).orderBy("page").collect()] == [(k, f"http://h/{k}") for k in range(3)]
    params = corpus(spark, [(f"http://h/?page={k}", "x") for k in (2, 3, 5)] + [("http://h/", "x")])
    got = P.paginate_param(spark.createDataFrame([("http://h/",)], "url string"), params, "page").orderBy("page").collect()
    assert [x.url for x in got] == ["http://h/", "http://h/?page=2", "http://h/?page=3"]
    api = corpus(spark, [("http://a/", '{"items":[1,2],"next":"c1"}'), ("http://a/?after=c1", '{"items":[3],"next":null}')])
    pages = P.paginate_cursor(spark.createDataFrame([("http://a/",)], "url string"), api, "next", "after", "items")
    assert P.merge_items(pages).first()["items"] == ["1", "2", "3"]


def test_crawl_and_sitemaps(spark):
    site = corpus(spark, [("http://h/", '<a href="/a">a</a><a href="/b?utm_source=x">b</a><a href="http://other/">o</a>'), ("http://h/a", '<a href="/c">c</a><a href="/">up</a>'), ("http://h/b?utm_source=x", '<a href="/secret/1">s</a>'), ("http://h/c", ""), ("http://h/secret/1", ""), ("http://other/", "")])
    seeds = spark.createDataFrame([("http://h/",)], "url string")
    got = P.crawl(seeds, site, rules=[(False, "/secret")]).collect()
    assert sorted((x.depth, x.url) for x in got) == [(0, "http://h/"), (1, "http://h/a"), (1, "http://h/b?utm_source=x"), (2, "http://h/c")]
    assert P.crawl(seeds, site, max_pages=2).count() == 2
    import gzip

    files = spark.createDataFrame([("http://h/i.xml", bytearray(b"<sitemapindex xmlns='u'><sitemap><loc>http://h/m.gz</loc></sitemap></sitemapindex>")), ("http://h/m.gz", bytearray(gzip.compress(b"<urlset><url><loc>http://h/1</loc></url><url><loc>http://h/2</loc></url></urlset>")))], "url string, content binary")
    assert sorted(x.url for x in P.sitemap_urls(spark.createDataFrame([("http://h/i.xml",)], "url string"), files).collect()) == ["http://h/1", "http://h/2"]


def test_policies(spark):
    tries = spark.createDataFrame([("u", 1, 503, None), ("u", 2, 200, None), ("v", 1, 0, "dns"), ("v", 2, 500, None), ("v", 3, 429, None), ("v", 4, 200, None)], "url string, attempt int, status int, error string")
    assert {x.url: (x.attempt, round(x.waited, 3)) for x in policies.retry(tries).collect()} == {"u": (2, 0.2), "v": (3, 0.6)}
    asked = spark.createDataFrame([("h", 1, 0.0), ("h", 2, 0.1), ("h", 3, 5.0), ("h", 4, 5.1)], "host string, seq int, at double")
    assert [round(x.slot, 3) for x in policies.spaced(asked).orderBy("seq").collect()] == [0.0, 0.5, 5.0, 5.5]
    climbs = [("h", s, f"u{s}", t, t < need) for s, need in ((1, 0), (2, 2), (3, 0), (4, 9)) for t in range(3)]
    got = policies.sticky_tiers(spark.createDataFrame(climbs, "host string, seq long, url string, tier int, climb boolean"))
    assert [x.tier for x in got.orderBy("seq").collect()] == [0, 2, 2, 2]


def test_stream_equals_batch(spark, engine, tmp_path):
    spark.createDataFrame(PAGES[1:3], "url string, content string").withColumn("content_type", F.lit("text/html")).write.parquet(str(tmp_path / "in"))
    query = Query.of(wq.doc.select_all(".s").extract(sku=wq.doc.text()))
    live = stream.query_stream(engine, query, stream.snapshot_stream(spark, str(tmp_path / "in")))
    stream.write_new(live, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    want = sorted(x.sku for x in engine.rows(query, spark.read.parquet(str(tmp_path / "in"))).collect())
    assert sorted(x.sku for x in spark.read.parquet(str(tmp_path / "out")).collect()) == want == ["SKU-1 z", "SKU-2"]
    stream.write_new(stream.query_stream(engine, query, stream.snapshot_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp2")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
