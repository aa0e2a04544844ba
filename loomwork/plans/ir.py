"""Plans: an immutable list of steps over a root, with a JSON form that travels."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

ROOTS = ("reference", "doc", "ref", "field")
KINDS = ("get", "call", "op", "fn", "when")
OPERATORS = ("==", "!=", "<", "<=", ">", ">=", "and", "or", "not")
FUNCTIONS = ("is_ok", "is_empty")
VERBS = frozenset(
    "resolve select select_all next prev attr text links anchors at doc extract field reference filter project merge documents limit skip first last distinct "
    "number date datetime regex map split link get is_ok is_empty identity tables markdown readable outline skeleton records metadata region tag html inner_html attrs value ok".split()
)


class PlanError(ValueError):
    """A plan that can't be read or run; ``code`` tells why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Plan:
    root: str = "doc"
    url: str = ""
    steps: tuple[Step, ...] = ()
    schema: dict | None = None

    def then(self, step: Step) -> Plan:
        return replace(self, steps=(*self.steps, step))

    # JSON

    def to_dict(self) -> dict:
        out: dict[str, Any] = {"root": self.root}
        if self.url:
            out["url"] = self.url
        if self.steps:
            out["steps"] = [s.to_dict() for s in self.steps]
        if self.schema:
            out["schema"] = self.schema
        return out

    def to_blob(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    @staticmethod
    def from_dict(d: dict) -> Plan:
        try:
            plan = Plan(d.get("root", "doc"), d.get("url", ""), tuple(Step.from_dict(s) for s in d.get("steps", [])), d.get("schema"))
        except (AttributeError, TypeError, KeyError) as e:
            raise PlanError("plan.malformed", str(e)) from e
        validate(plan)
        return plan

    @staticmethod
    def from_blob(blob: str) -> Plan:
        try:
            value = json.loads(blob)
        except ValueError as e:
            raise PlanError("plan.malformed", "not JSON") from e
        if not isinstance(value, dict):
            raise PlanError("plan.malformed", "not an object")
        return Plan.from_dict(value)

    def to_source(self) -> str:
        return _source(self)

    def describe(self) -> str:
        head = f"reference({self.url})" if self.root == "reference" else f"field({self.url})" if self.root == "field" else self.root
        return " -> ".join([head, *(s.name + (f"({len(s.args) + len(s.kwargs)})" if s.kind == "call" else "") for s in self.steps)])


@dataclass(frozen=True)
class Step:
    """``args`` and ``kwargs`` hold plain JSON values or plans."""

    kind: str
    name: str
    args: tuple[Any, ...] = ()
    kwargs: tuple[tuple[str, Any], ...] = field(default=())

    def to_dict(self) -> dict:
        pack = lambda v: {"plan": v.to_dict()} if isinstance(v, Plan) else {"value": v}
        out: dict[str, Any] = {"kind": self.kind, "name": self.name}
        if self.args:
            out["args"] = [pack(v) for v in self.args]
        if self.kwargs:
            out["kwargs"] = [[k, pack(v)] for k, v in self.kwargs]
        return out

    @staticmethod
    def from_dict(d: dict) -> Step:
        unpack = lambda v: Plan.from_dict(v["plan"]) if "plan" in v else v["value"]
        return Step(d["kind"], d["name"], tuple(unpack(v) for v in d.get("args", [])), tuple((k, unpack(v)) for k, v in d.get("kwargs", [])))

    def values(self) -> Iterator[Any]:
        yield from self.args
        for _, v in self.kwargs:
            yield v


def inner(plan: Plan) -> Iterator[Plan]:
    """The plan and every plan in its arguments."""
    yield plan
    for step in plan.steps:
        for v in step.values():
            if isinstance(v, Plan):
                yield from inner(v)


def validate(plan: Plan) -> None:
    for p in inner(plan):
        if p.root not in ROOTS:
            raise PlanError("plan.root", f"unknown root {p.root!r}")
        for s in p.steps:
            if s.kind not in KINDS:
                raise PlanError("plan.step", f"unknown kind {s.kind!r}")
            if s.kind == "op" and s.name not in OPERATORS:
                raise PlanError("plan.operator", s.name)
            if s.kind == "fn" and s.name not in FUNCTIONS:
                raise PlanError("plan.function", s.name)
            if s.kind in ("get", "call") and s.name.startswith("_"):
                raise PlanError("plan.private", s.name)


def verbs_of(plan: Plan) -> Counter[str]:
    return Counter(s.name for p in inner(plan) for s in p.steps if s.kind in ("get", "call"))


def unknown_verbs(plan: Plan) -> list[str]:
    return sorted(set(verbs_of(plan)) - VERBS)


def rewrite(plan: Plan, change: Callable[[Step], Step]) -> Plan:
    """Apply ``change`` to every step, arguments first."""
    deep = lambda v: rewrite(v, change) if isinstance(v, Plan) else v
    steps = (change(replace(s, args=tuple(deep(v) for v in s.args), kwargs=tuple((k, deep(v)) for k, v in s.kwargs))) for s in plan.steps)
    return replace(plan, steps=tuple(steps))


def lenient(plan: Plan) -> Plan:
    """Every select, next and prev made optional."""

    def relax(s: Step) -> Step:
        if s.kind == "call" and s.name in ("select", "next", "prev"):
            return replace(s, kwargs=(*((k, v) for k, v in s.kwargs if k != "optional"), ("optional", True)))
        return s

    return rewrite(plan, relax)


def resolves(plan: Plan) -> bool:
    return any(s.kind == "call" and s.name == "resolve" for s in plan.steps)


def split_at_resolve(plan: Plan) -> tuple[Plan, Step | None, Plan]:
    """What comes before the first resolve, the resolve, and what comes after it on the resolved document."""
    for i, s in enumerate(plan.steps):
        if s.kind == "call" and s.name == "resolve":
            return replace(plan, steps=plan.steps[:i]), s, Plan("doc", "", plan.steps[i + 1 :], None)
    return plan, None, Plan()


_BINARY = {"and": "&", "or": "|"}


def _literal(v: Any) -> str:
    return _source(v) if isinstance(v, Plan) else repr(v)


def _source(plan: Plan) -> str:
    if plan.root == "reference":
        out = f"wq.reference({plan.url!r})"
    elif plan.root == "field":
        out = f"wq.field({plan.url!r})"
    else:
        out = f"wq.{plan.root}"
    for s in plan.steps:
        if s.kind == "get":
            out += f".{s.name}"
        elif s.kind == "call":
            out += f".{s.name}({', '.join([*map(_literal, s.args), *(f'{k}={_literal(v)}' for k, v in s.kwargs)])})"
        elif s.kind == "fn":
            out = f"wq.{s.name}({out})"
        elif s.kind == "when":
            cond, then, *other = s.args
            out = f"wq.when({_literal(cond)}).then({_literal(then)})" + (f".otherwise({_literal(other[0])})" if other else "")
        elif s.name == "not":
            out = f"(~{out})"
        else:
            out = f"({out} {_BINARY.get(s.name, s.name)} {_literal(s.args[0])})"
    return out
