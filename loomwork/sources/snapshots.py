"""Corpora of fetched pages: one row a snapshot, whatever file format they lie in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("url", "status", "content_type", "content", "tier", "error")
EVENT_TYPE = "array<struct<topic:string,method:string,url:string,status:int,resource_type:string,body:string>>"


def snapshots(pages: DataFrame, url: str = "url", content: str = "html") -> DataFrame:
    """A table of pages in the snapshot shape; what it lacks is filled in: status 200, text/html, tier http, no error."""
    have = set(pages.columns)
    pick = lambda name, default, kind: (F.col(name) if name in have else F.lit(default)).cast(kind).alias(name)
    body = F.col("content" if "content" in have else content).cast("string").alias("content")
    return pages.select(F.col(url).alias("url"), pick("status", 200, "int"), pick("content_type", "text/html", "string"), body, pick("tier", "http", "string"), pick("error", None, "string"))


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Pages from parquet, json, orc, csv or delimited files, or from a folder of files (binaryFile: the path is the URL)."""
    if kind == "binaryFile":
        files = spark.read.format("binaryFile").options(**options).load(path)
        return files.select(F.col("path").alias("url"), F.lit(200).alias("status"), content_type_of(F.col("path")).alias("content_type"), F.decode("content", "utf-8").alias("content"), F.lit("file").alias("tier"), F.lit(None).cast("string").alias("error"))
    return snapshots(spark.read.format(kind).options(**options).load(path))


def content_type_of(url: Column) -> Column:
    """By the suffix of a URL, its query left out."""
    known = {"pdf": "application/pdf", "html": "text/html", "htm": "text/html", "json": "application/json", "xml": "application/xml", "csv": "text/csv", "txt": "text/plain", "zip": "application/zip", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "gz": "application/gzip"}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    suffix = F.lower(F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "\\.(\\w+)$", 1))
    return F.coalesce(F.try_element_at(table, suffix), F.lit("application/octet-stream"))


def ok(status: Column, error: Column) -> Column:
    return error.isNull() & status.between(200, 299)


def error_code(kind: Column) -> Column:
    """One of the transport codes for an error class's name."""
    low, out = F.lower(kind), None
    for code in ("timeout", "dns", "connect", "tls", "proxy", "redirects", "url", "protocol", "aborted", "browser"):
        out = F.when(F.contains(low, F.lit(code.rstrip("s"))), F.lit(f"fetch.{code}")) if out is None else out.when(F.contains(low, F.lit(code.rstrip("s"))), F.lit(f"fetch.{code}"))
    return F.when(kind.isNotNull(), out.otherwise(F.lit("fetch.transport")))


def events_of(events: Column, most: int = 60, longest: int = 512_000) -> Column:
    """A snapshot's network events with bodies, within the capture's caps."""
    return F.slice(F.filter(events, lambda e: e["body"].isNotNull() & (F.length(e["body"]) <= longest)), 1, most)
