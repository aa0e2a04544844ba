"""Plans compiled to DataFrames.

Everything that reads one document is one Arrow function: a URL that many rows refer to is parsed once, and only its
small results are joined to those rows. Resolving is an equi-join on the URL; types come from the plan, so no pass over
the data is needed to know them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.document import Document
from ..plans import ir
from ..plans.ir import Plan, PlanError, Step
from . import evaluate as E

BOOLEAN = frozenset({"is_ok", "is_empty", "ok"})


def type_of(plan: Plan) -> str:
    """The Spark type of a plan's value."""
    if not plan.steps:
        return "string"
    s = plan.steps[-1]
    if s.kind in ("op", "fn") or s.name in BOOLEAN:
        return "boolean"
    if s.kind == "when":
        branches = {type_of(a) if isinstance(a, Plan) else "boolean" if isinstance(a, bool) else "double" if isinstance(a, int | float) else "string" for a in s.args[1:] if a is not None}
        return branches.pop() if len(branches) == 1 else "string"
    if s.name == "number":
        return "double"
    if s.name in ("split", "links"):
        return "array<string>"
    if s.name == "tables":
        return "array<map<string,string>>"
    if s.name == "attrs":
        return "map<string,string>"
    if s.name == "get":
        return type_of(replace(plan, steps=plan.steps[:-1]))
    if s.name in ("text", "attr") and any(x.name == "select_all" for x in plan.steps):
        return "array<string>"
    if s.name == "extract":
        own = f"struct<{','.join(f'`{k}`:{type_of(v) if isinstance(v, Plan) else _plain_type(v)}' for k, v in s.kwargs)},_identity:string>"
        return f"array<{own}>" if any(x.name in ("select_all", "records", "tables") for x in plan.steps) else own
    return "string"


def _plain_type(v) -> str:
    return "boolean" if isinstance(v, bool) else "double" if isinstance(v, int | float) else "string"


def columns_of(plan: Plan) -> list[tuple[str, str]]:
    """Names and types of the rows that a plan gives."""
    out: dict[str, str] = {}
    for s in plan.steps:
        if s.name == "resolve":
            out = {}
        elif s.name == "extract":
            out |= {k: type_of(v) if isinstance(v, Plan) else _plain_type(v) for k, v in s.kwargs} | {"_identity": "string"}
        elif s.name == "anchors":
            out = {"url": "string", "text": "string"}
        elif s.name == "outline":
            out = {"level": "int", "text": "string"}
        elif s.name == "records":
            out = {"item_selector": "string", "container_selector": "string", "count": "int", "container_tag": "string", "container_id": "string", "score": "double"}
        elif s.name == "identity" and out:
            out["_identity"] = "string"
        elif s.name == "project" and dict(s.kwargs).get("flatten"):
            sep, flat = dict(s.kwargs).get("sep", "."), {}
            for k, t in out.items():
                if t.startswith("struct<"):
                    flat |= {f"{k}{sep}{n}": x for n, x in _fields(t)}
                else:
                    flat[k] = t
            out = flat
    return list(out.items()) or [("value", type_of(plan).removeprefix("array<").removesuffix(">") if type_of(plan).startswith("array<") and not type_of(plan).startswith("array<struct") else type_of(plan))]


def _fields(struct: str) -> list[tuple[str, str]]:
    out, depth, now = [], 0, ""
    for c in struct[len("struct<") : -1]:
        depth += {"<": 1, ">": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [(n.strip("`"), t) for n, _, t in (x.partition(":") for x in [*out, now])]


def _documents(spec: str, now: str | None, wants_rows: bool):
    """The fused function: (url, content, content_type) to (url, JSON of the value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, at = Plan.from_blob(spec), datetime.fromisoformat(now) if now else None
        for batch in batches:
            urls, found = batch.column(0).to_pylist(), []
            for url, content, kind in zip(urls, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                doc = Document(content or "", kind or "", url or "")
                value = E.run(plan, doc, E.Context(doc, now=at))
                if wants_rows:
                    value = value if isinstance(value, E.Items) else E.Items([value], [value] if isinstance(value, dict) else None) if value is not None else E.Items([])
                    found.append(json.dumps(value.rows if value.rows is not None else [{"value": E.raw(x)} for x in value.items], default=str))
                else:
                    found.append(json.dumps(E.raw(value), default=str))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["url", "found"])

    return run


def _tail(spec: str):
    """Steps that follow a nested resolve: they see the rows of one document, as the rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan.from_blob(spec)
        for batch in batches:
            out = []
            for found in batch.column(1).to_pylist():
                rows = json.loads(found)
                doc = Document("")
                value = E.run(plan, E.Items(list(rows), rows), E.Context(doc))
                out.append(json.dumps(value.rows if isinstance(value, E.Items) else [value], default=str))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["key", "found"])

    return run


def _no_pages(step: Step) -> None:
    """Walks over further pages of a step aren't carried out: better no rows than page 1 alone."""
    if dict(step.kwargs).get("paginate") is not None:
        raise PlanError("resolve.paginate", "resolve(paginate=...) isn't carried out")


@dataclass(frozen=True)
class Query:
    """A plan bound to nothing yet."""

    plan: Plan

    @staticmethod
    def of(chain) -> Query:
        plan = chain.plan if hasattr(chain, "plan") else chain
        ir.validate(plan)
        if bad := ir.unknown_verbs(plan):
            raise PlanError("verb.unknown", ", ".join(bad))
        return Query(plan)

    @staticmethod
    def from_blob(blob: str) -> Query:
        return Query.of(Plan.from_blob(blob))

    @staticmethod
    def from_source(source: str) -> Query:
        from ..plans.record import from_source

        return Query(from_source(source))

    def with_schema(self, schema: dict) -> Query:
        return Query(replace(self.plan, schema=schema))

    def lenient(self) -> Query:
        return Query(ir.lenient(self.plan))


class Engine:
    """Plans over one corpus of snapshots (url, content, content_type, ...)."""

    def __init__(self, spark: SparkSession, corpus: DataFrame, now: datetime | None = None):
        self.spark, self.now = spark, now.isoformat() if now else None
        self.corpus = corpus.select("url", "content", "content_type")

    def rows(self, query: Query, docs: DataFrame | None = None) -> DataFrame:
        """Rows of a query, with ``_url`` (the page they were read from) and ``_pos`` (their order there).

        A plan that begins at ``doc`` runs on every page of ``docs`` (the corpus, unless given); one that begins at a
        reference, or at ``ref`` with ``docs`` as a table of urls, resolves first.
        """
        plan = query.plan
        if plan.root in ("reference", "ref"):
            head, step, rest = ir.split_at_resolve(plan)
            if step is None:
                raise PlanError("plan.shape", "a reference has to be resolved")
            start = self.spark.createDataFrame([(plan.url,)], "url string") if plan.root == "reference" else docs.select("url")
            head = replace(head, root="doc", url="")
            if head.steps:
                raise PlanError("plan.shape", "a reference is resolved before it is read")
            return self._from_refs(start, step, rest)
        found = self._walk(docs.select("url", "content", "content_type") if docs is not None else self.corpus, plan)
        return self._typed(found, plan)

    def _typed(self, found: DataFrame, plan: Plan) -> DataFrame:
        names = columns_of(Plan("doc", "", ir.split_at_resolve(plan)[2].steps) if ir.resolves(plan) else plan)
        kind = f"array<struct<{','.join(f'`{n}`:{t}' for n, t in names)}>>"
        rows = found.select("url", F.posexplode(F.from_json("found", kind)).alias("_pos", "_r"))
        return rows.select(*(F.col(f"_r.`{n}`").alias(n) for n, _ in names), F.col("url").alias("_url"), "_pos")

    def _from_refs(self, refs: DataFrame, step: Step, rest: Plan) -> DataFrame:
        """Resolve a table of urls and run ``rest`` on each document; an url met twice is read once."""
        _no_pages(step)
        wanted = refs.select("url").distinct()
        docs = self.corpus.join(wanted, "url")
        if not dict(step.kwargs).get("optional"):
            known = self.corpus.select("url", F.lit(True).alias("_there")).dropDuplicates(["url"])
            lost = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("resolve.miss: no page at "), F.col("url")))).otherwise(F.col("url"))
            docs = self.corpus.join(wanted.join(known, "url", "left").select(lost.cast("string").alias("url")), "url")
        if ir.resolves(rest):
            before, nxt, after = ir.split_at_resolve(rest)
            links = self._eval(docs, before).select(F.explode(F.from_json("found", "array<struct<value:string>>")).alias("v")).select(F.col("v.value").alias("url")).where("url is not null and url <> ''")
            return self._from_refs(links, nxt, after)
        return self._typed(self._walk(docs, rest), rest)

    def _eval(self, docs: DataFrame, plan: Plan, rows: bool = True) -> DataFrame:
        return docs.select("url", "content", "content_type").mapInArrow(_documents(plan.to_blob(), self.now, rows), "url string, found string")

    def _walk(self, docs: DataFrame, plan: Plan) -> DataFrame:
        """(url, found): the rows of each document, nested resolves included."""
        for i, s in enumerate(plan.steps):
            nested = {k: v for k, v in s.kwargs if isinstance(v, Plan) and ir.resolves(v)} if s.name == "extract" else {}
            if nested:
                return self._nested(docs, plan, i, nested)
        return self._eval(docs, plan)

    def _nested(self, docs: DataFrame, plan: Plan, at: int, nested: dict[str, Plan]) -> DataFrame:
        step = plan.steps[at]
        cut = {k: ir.split_at_resolve(v) for k, v in nested.items()}
        own = tuple((f"_ref_{k}" if k in nested else k, cut[k][0] if k in nested else v) for k, v in step.kwargs)
        first = replace(plan, steps=(*plan.steps[:at], replace(step, kwargs=own)))
        base = self._eval(docs, first)
        # a row's values as JSON texts, so that types outlive the round trip
        rows = base.select("url", F.posexplode(F.from_json("found", "array<string>")).alias("_pos", "_row"))
        for k, (_, res, rest) in cut.items():
            _no_pages(res)
            link = F.get_json_object("_row", f"$._ref_{k}")
            linked = rows.withColumn("_link", link)
            pages = self.corpus.join(linked.select(F.col("_link").alias("url")).where("url is not null").distinct(), "url")
            value = self._eval(pages, rest, rows=False).select(F.col("url").alias("_link"), F.col("found").alias(f"_v_{k}"))
            rows = linked.join(value, "_link", "left")
            if not dict(res.kwargs).get("optional"):
                miss = F.col("_link").isNotNull() & F.col(f"_v_{k}").isNull()
                rows = rows.withColumn(f"_v_{k}", F.when(miss, F.raise_error(F.concat(F.lit("resolve.miss: no page at "), F.col("_link")))).otherwise(F.col(f"_v_{k}")))
            rows = rows.drop("_link")
        # put the nested values in: {"a": ...} with its last brace replaced
        parts = [F.concat(F.lit(f', "{k}": '), F.coalesce(F.col(f"_v_{k}"), F.lit("null"))) for k in cut]
        merged = F.concat(F.expr("left(_row, length(_row) - 1)"), *parts, F.lit("}"))
        grouped = rows.select("url", "_pos", merged.alias("_row")).groupBy("url").agg(F.array_sort(F.collect_list(F.struct("_pos", "_row"))).alias("l"))
        found = grouped.select("url", F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["_row"]), ","), F.lit("]")).alias("found"))
        rest = (Step("call", "identity"), *plan.steps[at + 1 :])
        done = found.select(F.col("url").alias("key"), "found").mapInArrow(_tail(Plan("doc", "", rest).to_blob()), "key string, found string")
        return done.select(F.col("key").alias("url"), "found")

    def documents(self, rows: DataFrame, column: str) -> DataFrame:
        """The corpus pages that a column of http(s) URLs points to, each with the row's identity."""
        refs = rows.where(F.col(column).rlike("^https?://")).select(F.col(column).alias("url"), *[c for c in ("_identity",) if c in rows.columns])
        return refs.join(self.corpus, "url")


def union(engine: Engine, queries: list[Query]) -> DataFrame:
    """Rows of several queries one after the other, with ``_query`` as their order."""
    out = None
    for i, q in enumerate(queries):
        rows = engine.rows(q).withColumn("_query", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
