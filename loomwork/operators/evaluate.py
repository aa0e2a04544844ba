"""One plan on one document, in plain Python: what the fused function runs inside a worker."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions import css, structure, values
from ..functions.document import Document, dig, region
from ..functions.dom import Node, join_url
from ..plans.ir import Plan, PlanError, Step


@dataclass(frozen=True)
class Ref:
    url: str


@dataclass(frozen=True)
class Json:
    value: Any


@dataclass
class Items:
    """A collection: items in order, and the row extracted for each so far."""

    items: list[Any]
    rows: list[dict] | None = None
    projected: bool = False


@dataclass
class Context:
    doc: Document
    row: dict = field(default_factory=dict)
    now: Any = None
    scope: Any = None


class Miss(PlanError):
    def __init__(self, url: str, selector: str):
        super().__init__("select.miss", f"{selector!r} has no match on {url!r}")


def raw(v: Any) -> Any:
    """A value as JSON: references as URLs, elements as text."""
    if isinstance(v, Ref):
        return v.url
    if isinstance(v, Json):
        return v.value
    if isinstance(v, Node):
        return v.text
    if isinstance(v, Document):
        return {"url": v.url, "kind": v.kind}
    if isinstance(v, Items):
        return v.rows if v.rows is not None else [raw(x) for x in v.items]
    if isinstance(v, dict):
        return {k: raw(x) for k, x in v.items()}
    return [raw(x) for x in v] if isinstance(v, list | tuple) else v


def run(plan: Plan, value: Any, ctx: Context) -> Any:
    if plan.root == "reference":
        value = Ref(plan.url)
    elif plan.root == "field":
        value = ctx.row.get(plan.url)
    for step in plan.steps:
        value = _step(step, value, ctx)
    return value


def _value(v: Any, scope: Any, ctx: Context) -> Any:
    return run(v, scope, ctx) if isinstance(v, Plan) else v


def _step(s: Step, v: Any, ctx: Context) -> Any:
    scope = ctx.doc if v is None else v
    if s.kind == "op":
        return _operator(s, v, ctx)
    if s.kind == "fn":
        return (raw(v) is not None) if s.name == "is_ok" else values.is_empty(raw(v))
    if s.kind == "when":
        cond, then, *other = s.args
        branch = then if values.truthy(raw(_value(cond, scope, ctx))) else (other[0] if other else None)
        return _value(branch, scope, ctx)
    return _verb(s.name, v, s.args, dict(s.kwargs), ctx)


def _scope(ctx: Context) -> Any:
    return ctx.doc if ctx.scope is None else ctx.scope


def _operator(s: Step, v: Any, ctx: Context) -> bool:
    if s.name == "not":
        return not values.truthy(raw(v))
    if s.name in ("and", "or"):
        left = values.truthy(raw(v))
        if left == (s.name == "or"):
            return left
        return values.truthy(raw(_value(s.args[0], _scope(ctx), ctx)))
    a, b = raw(v), raw(_value(s.args[0], _scope(ctx), ctx))
    if s.name in ("==", "!="):
        return values.equal(a, b) == (s.name == "==")
    if s.name in ("<", "<="):
        return values.less(a, b, s.name == "<")
    return values.less(b, a, s.name == ">")


_FANNED = frozenset("select select_all next prev attr text links at number date datetime regex map split link get region tag html inner_html attrs".split())


def _verb(name: str, v: Any, args: tuple, kw: dict, ctx: Context) -> Any:
    if name == "is_ok":
        return raw(v) is not None
    if name == "is_empty":
        return values.is_empty(raw(v))
    if name == "doc":
        return v
    if name == "field":
        return ctx.row.get(args[0])
    if name == "reference":
        url = ctx.row.get(args[0])
        return None if url is None else Ref(join_url(ctx.doc.url, str(url)))
    if isinstance(v, Items):
        if name in _FANNED and v.rows is None:
            return _fan(name, v, args, kw, ctx)
        return _collection(name, v, args, kw, ctx)
    if v is None:
        return [] if name == "split" else kw.get("default", args[0] if name == "get" and args else None)
    if name in ("extract", "filter", "identity"):
        return _single(name, v, args, kw, ctx)
    if isinstance(v, Document):
        return _document(name, v, args, kw)
    if isinstance(v, Node):
        return _element(name, v, args, kw, ctx)
    if isinstance(v, Json) and name in ("select", "select_all", "at", "attr"):
        found = dig(v.value, args[0])
        if name == "select_all":
            return Items([Json(x) for x in (found if isinstance(found, list) else [] if found is None else [found])])
        return None if found is None else Json(found) if isinstance(found, dict | list) else found
    return _leaf(name, raw(v), args, kw, ctx)


def _fan(name: str, v: Items, args: tuple, kw: dict, ctx: Context) -> Items:
    out: list[Any] = []
    for item in v.items:
        got = _verb(name, item, args, {**kw, "optional": True} if name in ("select", "next", "prev") else kw, ctx)
        if name in ("select", "select_all", "links"):
            out.extend(got.items if isinstance(got, Items) else [] if got is None else [got])
        else:
            out.append(got)
    return Items(out)


def _scoped(plan: Any, item: Any, row: dict, ctx: Context) -> Any:
    if not isinstance(plan, Plan):
        return plan
    own = Context(item if isinstance(item, Document) else ctx.doc, row, ctx.now)
    own.scope = item
    return run(plan, item, own)


def _extracted(item: Any, row: dict, kw: dict, ctx: Context) -> dict:
    out = dict(row)
    for name, plan in kw.items():
        out[name] = raw(_scoped(plan, item, out, ctx))
    return out


def _identified(row: dict, parts: tuple, item: Any) -> str | None:
    if not parts:
        data = values.plain(row)
        return values.row_identity(row) if data else values.digest(item.readable() if isinstance(item, Document) else raw(item))
    out = []
    for part in parts:
        if part in row:
            out.append(["field", part, values.plain(row[part])])
        elif isinstance(item, Node | Document):
            hit = css.select(item, part) if isinstance(item, Node) else item.select(part)
            out.append(["css", part, hit.text if hit is not None else None])
        else:
            return None
    return values.digest(out)


def _single(name: str, v: Any, args: tuple, kw: dict, ctx: Context) -> Any:
    if name == "filter":
        return v if all(values.truthy(raw(_scoped(p, v, ctx.row, ctx))) for p in args) else None
    if name == "identity":
        return _identified(v if isinstance(v, dict) else {}, args, v)
    row = _extracted(v, {}, kw, ctx)
    row["_identity"] = _identified(row, (), v)
    if isinstance(v, Document):
        row["_url"] = v.url
    return row


def _collection(name: str, v: Items, args: tuple, kw: dict, ctx: Context) -> Any:
    rows = v.rows
    if name == "extract":
        made = [_extracted(i, r, kw, ctx) for i, r in zip(v.items, rows or [{}] * len(v.items))]
        for i, r in zip(v.items, made):
            r["_identity"] = _identified({k: x for k, x in r.items() if not k.startswith("_")}, (), i)
        return Items(v.items, made)
    if name == "filter":
        keep = [all(values.truthy(raw(_scoped(p, i, r, ctx))) for p in args) for i, r in zip(v.items, rows or [{}] * len(v.items))]
        return Items([i for i, k in zip(v.items, keep) if k], None if rows is None else [r for r, k in zip(rows, keep) if k])
    if name in ("limit", "skip"):
        cut = slice(None, args[0]) if name == "limit" else slice(args[0], None)
        return Items(v.items[cut], None if rows is None else rows[cut])
    if name in ("first", "last"):
        own = rows if rows is not None else v.items
        return raw(own[0 if name == "first" else -1]) if own else kw.get("default", args[0] if args else None)
    if name == "identity":
        made = [{**r, "_identity": _identified(r, args, i)} for i, r in zip(v.items, rows or [{}] * len(v.items))]
        return Items(v.items, made)
    if name in ("project", "distinct"):
        made = rows if rows is not None else [{"value": raw(i)} for i in v.items]
        if kw.get("flatten"):
            sep = kw.get("sep", ".")
            made = [{k2: x2 for k, x in r.items() for k2, x2 in ([(f"{k}{sep}{n}", y) for n, y in x.items()] if isinstance(x, dict) else [(k, x)])} for r in made]
        if name == "distinct" or kw.get("distinct"):
            seen: set[str] = set()
            made = [r for r in made if not ((d := values.digest(values.plain(r))) in seen or seen.add(d))]
        return Items(list(made), list(made), True)
    if name == "merge":
        out: dict = {}
        for r in rows or []:
            out.update(r)
        return out
    if name == "documents":
        return Items([x for r in rows or [] for x in (r.get(args[0]) if isinstance(r.get(args[0]), list) else [r.get(args[0])]) if x is not None])
    raise PlanError("verb.unknown", f"{name} on a collection")


def _document(name: str, v: Document, args: tuple, kw: dict) -> Any:
    if v.kind == "json" and name in ("select", "select_all", "at", "attr"):
        found = dig(v.value, args[0] if args else "")
        if name == "select_all":
            return Items([Json(x) if isinstance(x, dict | list) else x for x in (found if isinstance(found, list) else [] if found is None else [found])])
        return None if found is None else Json(found) if isinstance(found, dict | list) else found
    if name == "select":
        hit = v.select(args[0])
        if hit is None and not kw.get("optional"):
            raise Miss(v.url, args[0])
        return hit
    if name == "select_all":
        return Items(list(v.select_all(args[0])))
    if name == "text" or (name == "attr" and args and args[0] in ("text", "value")):
        return v.text
    if name == "attr":
        return None
    if name == "links":
        return Items([Ref(u) for u in v.links()])
    if name == "anchors":
        return Items([{"url": u, "text": t} for u, t in v.anchors()], [{"url": u, "text": t} for u, t in v.anchors()])
    if name == "tables":
        made = v.tables(*args, **kw)
        return Items(list(made), made)
    if name == "records":
        made = [r.row() for r in structure.records(v, **kw)]
        return Items(list(made), made)
    if name == "outline":
        made = [{"level": a, "text": b} for a, b in v.outline()]
        return Items(list(made), made)
    if name == "skeleton":
        return structure.skeleton(v, **kw)
    if name in ("markdown", "readable"):
        return getattr(v, name)(*args, **kw)
    if name == "metadata":
        return v.metadata()
    if name == "regex":
        return v.regex(*args, **{k: x for k, x in kw.items() if k != "default"}) or kw.get("default")
    if name == "at":
        return None
    return _leaf(name, v.text, args, kw, Context(v))


def _element(name: str, v: Node, args: tuple, kw: dict, ctx: Context) -> Any:
    if name == "select":
        hit = css.select(v, args[0])
        if hit is None and not kw.get("optional"):
            raise Miss(ctx.doc.url, args[0])
        return hit
    if name == "select_all":
        return Items(list(css.select_all(v, args[0])))
    if name in ("next", "prev"):
        want, stop = (args[0] if args else kw.get("css", "")), kw.get("stop", "")
        for n in v.siblings(1 if name == "next" else -1):
            if stop and css.compiled(stop).matches(n):
                break
            if not want or css.compiled(want).matches(n):
                return n
        if kw.get("optional"):
            return None
        raise Miss(ctx.doc.url, f"{name} {want}")
    if name == "attr":
        if args[0] in ("text", "value") and args[0] not in v.attrs:
            return v.text
        if args[0] in ("href", "src"):
            return Ref(join_url(ctx.doc.url, v.attrs[args[0]]) if args[0] in v.attrs else "")
        return v.attrs.get(args[0])
    if name == "links":
        return Items([Ref(join_url(ctx.doc.url, a.attrs["href"])) for a in css.select_all(v, "a[href]")])
    if name == "text":
        return v.text
    if name in ("html", "inner_html"):
        return getattr(v, name)()
    if name in ("tag", "attrs"):
        return getattr(v, name)
    if name == "region":
        return region(v)
    return _leaf(name, v.text, args, kw, ctx)


def _leaf(name: str, x: Any, args: tuple, kw: dict, ctx: Context) -> Any:
    if name == "number":
        return values.number(x, *args, **kw)
    if name in ("date", "datetime"):
        default = kw.pop("default", None)
        got = (values.date if name == "date" else values.date_time)(x, now=ctx.now, **({"format": args[0]} if args else {}), **kw)
        return default if got is None else got
    if name == "regex":
        return values.regex(x, *args, **kw)
    if name == "map":
        return values.lookup(x, *args, **kw)
    if name == "split":
        return Items(values.split(x, *args, **kw))
    if name == "link":
        return join_url((args[0] if args else kw.get("base")) or ctx.doc.url, str(x))
    if name == "get":
        return x
    if name in ("text", "value"):
        return x
    if name == "ok":
        return x is not None
    if name == "attr" and isinstance(x, dict):
        return x.get(args[0])
    raise PlanError("verb.unknown", f"{name} on {type(x).__name__}")
