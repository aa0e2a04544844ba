"""Walks over a corpus: pagination with stop conditions, sitemaps and the bounded crawl."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as N
from ..functions import css
from ..functions.document import Document, dig
from ..functions.dom import join_url, parse_xml
from ..functions.urls import set_param

# stop conditions: a boolean column per page, true on the page that ends the walk


def until_empty(count: Column) -> Column:
    return F.coalesce(count, F.lit(0)) == 0


def until_match(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def first_n(count: Column, n: int, walk: Sequence[str], page: str) -> Column:
    """The page on which the items so far reach ``n``."""
    return F.sum(count).over(Window.partitionBy(*walk).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)) >= n


def until_repeat(key: Column, walk: Sequence[str], page: str) -> Column:
    """A page whose key was seen before in its walk."""
    return F.row_number().over(Window.partitionBy(*walk, key).orderBy(page)) > 1


def any_of(*stops: Column) -> Column:
    out = stops[0]
    for s in stops[1:]:
        out = out | s
    return out


def cut(pages: DataFrame, stop: Column, walk: Sequence[str], page: str, keep_last: bool = True) -> DataFrame:
    """The pages of each walk up to the first stop, that one included (unless told otherwise)."""
    marked = pages.withColumn("_stop", stop)
    before = Window.partitionBy(*walk).orderBy(page).rowsBetween(Window.unboundedPreceding, -1 if keep_last else 0)
    seen = F.coalesce(F.max(F.col("_stop").cast("int")).over(before), F.lit(0))
    return marked.withColumn("_seen", seen).where("_seen = 0").drop("_stop", "_seen")


def paginate_param(starts: DataFrame, corpus: DataFrame, name: str, step: int = 1, max_pages: int = 20) -> DataFrame:
    """(start, page, url, ...): pages by a counted parameter, until one isn't there. A missing or odd number counts as 1."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..functions.urls import knobs

        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                now = knobs(url).get(name, "1")
                first = int(now) if now.isdigit() else 1
                rows += [(url, k, url if k == 0 else set_param(url, name, first + k * step)) for k in range(max_pages)]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.int32()), pa.array(list(cols[2]), pa.string())], ["start", "page", "url"])

    wanted = starts.select("url").mapInArrow(pages, "start string, page int, url string")
    got = wanted.join(corpus, "url", "left")
    there = F.col("content").isNotNull() & F.col("status").between(200, 299)
    return cut(got, ~there, ["start"], "page", keep_last=False)


def _next_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for url, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            hit = Document(content or "", "text/html", url).select("a[rel~=next][href], link[rel~=next][href]")
            out.append(join_url(url, hit.attrs["href"]) if hit is not None else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["start", "next"])


def _kept(df: DataFrame) -> DataFrame:
    """Cut the lineage of a level: in the shared checkpoint folder where there is one, else kept in two places."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist(StorageLevel.MEMORY_AND_DISK_2)


def paginate_links(starts: DataFrame, corpus: DataFrame, max_pages: int = 20) -> DataFrame:
    """(start, page, url, status, content): each start and the pages that rel=next leads to; a page met twice ends the walk."""
    now = starts.select(F.col("url").alias("start"), F.lit(0).alias("page"), "url")
    out = None
    for level in range(max_pages):
        level_pages = _kept(now.join(corpus.select("url", "status", "content"), "url").where("status between 200 and 299").select("start", "page", "url", "status", "content"))
        out = level_pages if out is None else out.unionByName(level_pages)
        links = level_pages.select("start", "url", "content").mapInArrow(_next_links, "start string, next string").where("next is not null")
        seen = out.select("start", F.col("url").alias("next"))
        now = _kept(links.join(seen, ["start", "next"], "left_anti").select("start", F.lit(level + 1).alias("page"), F.col("next").alias("url")))
        if now.isEmpty():
            break
    return out


def paginate_cursor(starts: DataFrame, corpus: DataFrame, cursor_path: str, param: str, items_path: str, max_pages: int = 50) -> DataFrame:
    """(start, page, url, items): JSON pages by cursor, items as JSON text; ends where there is no cursor, page or JSON."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            rows = []
            for start, page, url, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                value = Document(content or "", "application/json", url).value
                items = dig(value, items_path)
                cursor = dig(value, cursor_path)
                rows.append((start, page, url, json.dumps(items if isinstance(items, list) else []), set_param(url, param, cursor) if cursor not in (None, "", False) else None))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["start", "page", "url", "items", "next"])

    now, out = starts.select(F.col("url").alias("start"), F.lit(0).alias("page"), "url"), None
    for level in range(max_pages):
        got = now.join(corpus.select("url", "status", "content"), "url").where("status between 200 and 299")
        pages = _kept(got.select("start", "page", "url", "content").mapInArrow(read, "start string, page int, url string, items string, next string"))
        out = pages if out is None else out.unionByName(pages)
        now = pages.where("next is not null").select("start", F.lit(level + 1).alias("page"), F.col("next").alias("url"))
        if now.isEmpty():
            break
    return out.drop("next")


def merge_items(pages: DataFrame) -> DataFrame:
    """(start, items): all items of each walk in one array, in page order."""
    packed = pages.select("start", "page", F.from_json("items", "array<string>").alias("items"))
    return packed.groupBy("start").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "items"))), lambda x: x["items"])).alias("items"))


def sitemap_locations(content: bytes) -> tuple[list[str], list[str]]:
    """(pages, sitemaps) of one sitemap or index, gzipped or not."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    root = parse_xml(content.decode("utf-8", "replace"))
    found = [n.text for n in css.select_all(root, "loc")]
    return ([], found) if root.tag == "sitemapindex" else (found, [])


def sitemap_urls(starts: DataFrame, files: DataFrame, max_maps: int = 20) -> DataFrame:
    """(url): pages listed by the starting sitemaps and the indexes under them. ``files`` has (url, content binary)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, kinds = [], []
            for content in batch.column(0).to_pylist():
                pages, maps = sitemap_locations(content or b"")
                urls += pages + maps
                kinds += [False] * len(pages) + [True] * len(maps)
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(kinds, pa.bool_())], ["url", "is_map"])

    now, seen, out, left = starts.select("url").distinct(), None, None, max_maps
    while left > 0:
        now = _kept(now.orderBy("url").limit(left))
        left -= now.count()
        found = _kept(files.join(now, "url").select("content").mapInArrow(read, "url string, is_map boolean"))
        out = found.where("not is_map").select("url") if out is None else out.union(found.where("not is_map").select("url"))
        seen = now if seen is None else seen.union(now)
        now = found.where("is_map").select("url").distinct().join(seen, "url", "left_anti")
        if now.isEmpty():
            break
    return out.distinct()


def link_graph(corpus: DataFrame) -> DataFrame:
    """(url, pos, link): anchors of every page, made absolute."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Document(c or "", "text/html", u).links() for u, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["url", "links"])

    return corpus.select("url", "content").mapInArrow(read, "url string, links array<string>").select("url", F.posexplode("links").alias("pos", "link"))


def crawl(
    seeds: DataFrame,
    corpus: DataFrame,
    max_pages: int = 15,
    scope: Callable[[Column, Column], Column] = N.same_origin,
    rules: Sequence[tuple[bool, str]] = (),
    collect: Column | None = None,
    frontier: Callable[[DataFrame], DataFrame] | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """(url, depth, ord): pages reached from the seeds, breadth first, each canonical URL once, ``max_pages`` at most.

    A level is one join of the frontier with the corpus; what was seen leaves by an anti-join. ``links`` is a
    (url, pos, link) table where the graph is known already. ``frontier`` may reorder or prune a level (columns key,
    url, at); an empty one ends the crawl. Only counts reach the driver.
    """
    graph = links if links is not None else link_graph(corpus)
    allowed = N.robots_allowed(F.col("url"), list(rules))
    now = seeds.select("url", N.canonical(F.col("url")).alias("key"), F.struct(F.monotonically_increasing_id().alias("o"), F.lit(0).alias("pos")).alias("at")).where(allowed)
    now = now.groupBy("key").agg(F.min_by("url", "at").alias("url"), F.min("at").alias("at"))
    seen, out, left, depth = None, None, max_pages, 0
    while left > 0:
        now = frontier(now) if frontier else now
        # ``left`` rows at most, so numbering them takes one task
        now = now.orderBy("at", "key").limit(left).withColumn("ord", F.row_number().over(Window.orderBy("at", "key")).cast("long"))
        now = _kept(now.select("key", "url", "ord"))
        took = now.count()
        if not took:
            break
        left -= took
        seen = now.select("key") if seen is None else seen.union(now.select("key"))
        pages = _kept(now.join(corpus.where("status between 200 and 299"), "url").withColumn("depth", F.lit(depth)))
        out = pages if out is None else out.unionByName(pages)
        onward = pages.select("url", F.col("ord").alias("o")).join(graph, "url").where(scope(F.col("url"), F.col("link")))
        onward = onward.select(F.col("link").alias("url"), N.canonical(F.col("link")).alias("key"), F.struct("o", "pos").alias("at")).where(allowed)
        now = onward.groupBy("key").agg(F.min_by("url", "at").alias("url"), F.min("at").alias("at")).join(seen, "key", "left_anti")
        depth += 1
    if out is None:
        return seeds.limit(0).select("url", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ord"))
    kept = out.where(collect) if collect is not None else out
    return kept.select("url", "depth", "ord")
