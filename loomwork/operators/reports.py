"""Run reports, stored identities and sinks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as N

UNBOUNDED = 10**9


def parse_range(spec: str) -> tuple[int, int] | None:
    """Bounds of an expected number of rows: ``10-50``, ``~20``, ``>=5``, ``5+``, ``>5``, ``<200``, ``<=200``, ``40``."""
    s = spec.replace(" ", "").replace(",", "")
    if m := re.fullmatch(r"(\d+)-(\d+)", s):
        return int(m[1]), int(m[2])
    if m := re.fullmatch(r"~(\d+)", s):
        return int(m[1]) // 2, int(m[1]) * 2
    if m := re.fullmatch(r">=(\d+)|(\d+)\+", s):
        return int(m[1] or m[2]), UNBOUNDED
    if m := re.fullmatch(r">(\d+)", s):
        return int(m[1]) + 1, UNBOUNDED
    if m := re.fullmatch(r"<(=?)(\d+)", s):
        return 0, int(m[2]) - (not m[1])
    if m := re.fullmatch(r"\d+", s):
        return int(s) * 3 // 4, int(s) * 5 // 4 + 1
    return None


def in_range(count: int, bounds: tuple[int, int] | None) -> bool:
    return bounds is None or bounds[0] <= count <= bounds[1]


def report(rows: DataFrame, fields: Sequence[str] | None = None, dated: Sequence[str] = (), expected: str = "", now: str | None = None) -> DataFrame:
    """One row: rows, fill_<field> (share that isn't empty), duplicates (identities met before), newest, age_days, note, ok.

    One aggregate over all rows. Dates are compared as ISO texts; ``now`` is an ISO text, so that a report can be
    repeated. ok asks for rows, and for every reported field to be filled somewhere.
    """
    kinds = dict(rows.dtypes)
    fields = list(fields) if fields is not None else sorted(c for c in rows.columns if not c.startswith("_"))
    have = [f for f in fields if f in kinds]
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.avg((~N.is_empty(F.col(f), kinds[f])).cast("double")).alias(f"fill_{f}") for f in have]
    if "_identity" in kinds:
        aggs.append((F.count("_identity") - F.count_distinct("_identity")).alias("duplicates"))
    if dated:
        aggs.append(F.greatest(*(F.max(d) for d in dated), F.lit(None)).alias("newest") if len(dated) > 1 else F.max(dated[0]).alias("newest"))
    out = rows.agg(*aggs)
    for f in fields:
        if f not in have:
            out = out.withColumn(f"fill_{f}", F.lit(0.0))
    if dated and now:
        age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("newest").try_cast("timestamp"))) / 86400
        out = out.withColumn("age_days", F.round(F.greatest(F.lit(0.0), age), 1))
    bounds = parse_range(expected) if expected else None
    note = F.when(F.col("rows") < bounds[0], "BELOW").when(F.col("rows") > bounds[1], "ABOVE").otherwise("") if bounds else F.lit("")
    ok = F.col("rows") > 0
    for f in fields:
        ok = ok & (F.coalesce(F.col(f"fill_{f}"), F.lit(0.0)) > 0)
    return out.withColumn("note", note).withColumn("ok", ok)


def merge_reports(reports: DataFrame) -> DataFrame:
    """Reports of several runs as one: counts added, fill rates weighed by rows, the newest date."""
    aggs = [F.sum("rows").alias("rows")]
    for c in reports.columns:
        if c.startswith("fill_"):
            aggs.append((F.sum(F.col(c) * F.col("rows")) / F.sum("rows")).alias(c))
        elif c in ("duplicates",):
            aggs.append(F.sum(c).alias(c))
        elif c == "newest":
            aggs.append(F.max(c).alias(c))
        elif c == "age_days":
            aggs.append(F.min(c).alias(c))
    return reports.agg(*aggs)


def issues(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """``_issues``: what each row of a lenient run lacks."""
    kinds = dict(rows.dtypes)
    missing = [F.when(N.is_empty(F.col(c), kinds[c]), F.lit(f"missing {c}")) for c in required]
    return rows.withColumn("_issues", F.array_compact(F.array(*missing)) if missing else F.array().cast("array<string>"))


def summary(row: Mapping) -> str:
    fills = ", ".join(f"{k[5:]} {v:.0%}" for k, v in row.items() if k.startswith("fill_") and v is not None)
    return f"{row['rows']} rows {row.get('note') or 'as expected'}; {fills}; {row.get('duplicates') or 0} duplicates; newest {row.get('newest') or '-'}"


# sinks


def with_key(rows: DataFrame) -> DataFrame:
    own = F.struct(*[c for c in rows.columns if not c.startswith("_")])
    return rows.withColumn("_key", N.identity_key(F.col("_identity") if "_identity" in rows.columns else F.lit(None).cast("string"), own))


def first_of_each(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Of rows of one key the first in order."""
    w = Window.partitionBy("_key").orderBy(*order)
    return with_key(rows).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def append_new(rows: DataFrame, stored: DataFrame | None, order: Sequence[str] = ("_url", "_pos")) -> DataFrame:
    """Rows whose key isn't stored, each key once: what an append-only sink writes."""
    fresh = first_of_each(rows, [c for c in order if c in rows.columns] or ["_key"])
    return fresh if stored is None else fresh.join(stored.select("_key"), "_key", "left_anti")


def append_to(rows: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """Append the new rows to a stored table, and return them."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    new = append_new(rows, spark.read.format(kind).load(path) if there else None)
    new.write.mode("append").format(kind).save(path)
    return new


def fetch_ledger(events: DataFrame) -> DataFrame:
    """(url, status, elapsed, tier) of a bus log (seq, topic, url, status, elapsed, tier): each fetch with the url's last escalation."""
    climbs = events.where("topic = 'resolve.escalate'").groupBy("url").agg(F.max_by("tier", "seq").alias("tier"))
    return events.where("topic = 'fetch.done'").select("url", "status", "elapsed").join(climbs, "url", "left")


def topic_is(topic: Column, prefix: str) -> Column:
    return (topic == prefix) | topic.startswith(prefix + ".") if prefix else F.lit(True)
