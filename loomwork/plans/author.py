"""Authoring: replies compiled to safe plans, selector hygiene, briefs, and the resumable stage runner. Models are injected callables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from ..functions import css
from ..functions.document import Document
from ..functions.structure import normalise, problems
from .ir import Plan, PlanError, Step, rewrite
from .record import from_source

_QUOTES = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'"})


def clean_reply(text: str) -> str:
    """The code of a reply: out of its fence, plain quotes, from ``wq.`` on."""
    if m := re.search(r"```[a-z]*\n(.*?)```", text, re.S):
        text = m.group(1)
    text = text.translate(_QUOTES).strip()
    at = text.find("wq.")
    return text[at:].strip() if at >= 0 else text


def compile_reply(text: str) -> Plan:
    return hygienic(from_source(clean_reply(text)))


def hygienic(plan: Plan) -> Plan:
    """The plan with every selector made durable."""

    def clean(s: Step) -> Step:
        if s.kind == "call" and s.name in ("select", "select_all", "next", "prev") and s.args and isinstance(s.args[0], str):
            return replace(s, args=(normalise(s.args[0]), *s.args[1:]))
        return s

    return rewrite(plan, clean)


def selector_problems(plan: Plan) -> list[tuple[str, str]]:
    """(selector, problem) over a plan, by what each selector is for."""
    out = []
    for at, s in enumerate(plan.steps):
        if s.kind == "call" and s.name in ("select", "select_all") and s.args and isinstance(s.args[0], str):
            role = "records" if s.name == "select_all" else "field"
            out += [(s.args[0], p) for p in problems(s.args[0], role)]
        for v in s.values():
            if isinstance(v, Plan):
                out += selector_problems(v)
    return out


def reroot(plan: Plan, url: str, profile: str | None = None) -> Plan:
    """A page's chain, begun at a URL."""
    kw = (("profile", profile),) if profile else ()
    return Plan("reference", url, (Step("call", "resolve", (), kw), *plan.steps), plan.schema)


@dataclass(frozen=True)
class FieldSpec:
    """How one column is read: a selector within the record, an attribute, a verb for the value, whether it may miss."""

    name: str
    selector: str = ""
    attr: str = "text"
    verb: str = ""
    required: bool = True
    follow: bool = False


def field_source(f: FieldSpec) -> str:
    chain = "wq.doc"
    if f.selector:
        chain += f".select({normalise(f.selector)!r}" + ("" if f.required else ", optional=True") + ")"
    chain += ".text()" if f.attr == "text" else f".attr({f.attr!r})"
    if f.follow:
        chain += ".resolve(optional=True).readable()"
    return chain + (f".{f.verb}()" if f.verb else "")


def compile_source(url: str, records: str, fields: Sequence[FieldSpec]) -> str:
    """Source of a record query: rows that lack a required field are left out."""
    columns = ", ".join(f"{f.name}={field_source(f)}" for f in fields)
    keep = [f"wq.field({f.name!r}).is_ok()" for f in fields if f.required]
    tail = f".filter({', '.join(keep)})" if keep else ""
    return f"wq.reference({url!r}).resolve().select_all({normalise(records)!r}).extract({columns}){tail}"


@dataclass
class Brief:
    """What dataset is asked for."""

    goal: str
    fields: list[dict] = field(default_factory=list)
    expect_rows: str = ""
    arguments: dict = field(default_factory=dict)
    guides: list[dict] = field(default_factory=list)

    @staticmethod
    def load(text: str) -> Brief:
        import yaml

        m = re.match(r"---\n(.*?)\n---\n?(.*)", text, re.S)
        head = (yaml.safe_load(m.group(1)) or {}) if m else {}
        names = ("fields", "expect_rows", "arguments", "guides")
        return Brief((m.group(2) if m else text).strip(), **{k: head[k] for k in names if k in head})

    def render(self, **arguments: str) -> str:
        known = {**self.arguments, **arguments}
        return re.sub(r"\{(\w+)\}", lambda m: str(known.get(m.group(1), m.group(0))), self.goal)

    def schema(self) -> dict:
        return {"fields": self.fields, "expect_rows": self.expect_rows}

    def required(self) -> list[str]:
        return [f["name"] for f in self.fields if f.get("required", True)]

    def dated(self) -> list[str]:
        return [f["name"] for f in self.fields if f.get("type") in ("date", "datetime", "time")]

    def documents(self) -> list[str]:
        return [f["name"] for f in self.fields if f.get("type") in ("document", "file", "pdf", "url")]


def parse_json(text: str) -> Any:
    m = re.search(r"```(?:json)?\n(.*?)```", text, re.S)
    body = m.group(1) if m else text
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        raise ValueError("no JSON in the reply")
    return json.JSONDecoder().raw_decode(body[start:])[0]


@dataclass
class Budget:
    """Stops calls once the money is spent."""

    limit: float = 0.10
    spent: float = 0.0
    calls: int = 0

    def charge(self, tokens_in: int, tokens_out: int, price_in: float = 1e-6, price_out: float = 5e-6) -> None:
        self.spent += tokens_in * price_in + tokens_out * price_out
        self.calls += 1
        if self.spent > self.limit:
            raise PlanError("budget.spent", f"{self.spent:.4f} of {self.limit}")


def estimate_tokens(chars: int, calls: int) -> int:
    return chars // 4 + 60 * calls


def ask_json(model: Callable[[str], str], prompt: str, budget: Budget | None = None) -> Any:
    """A JSON reply; one that can't be read is asked for once more with the error quoted."""
    for attempt in (0, 1):
        reply = model(prompt)
        if budget:
            budget.charge(estimate_tokens(len(prompt), 1), estimate_tokens(len(reply), 0))
        try:
            return parse_json(reply)
        except ValueError as e:
            if attempt:
                raise PlanError("reply.invalid", str(e)) from e
            prompt = f"{prompt}\n\nYour last reply could not be read ({e}). Reply with JSON alone."


STAGES = ("search", "review_search", "crawl", "review_candidate", "expand", "review_location", "author_resolve", "author_extract", "author_review")


@dataclass
class Onboarding:
    """State of one dataset's making; a slot a stage, so a run resumes at the first empty one."""

    brief: dict
    slots: dict[str, Any] = field(default_factory=dict)
    stopped: str = ""

    def next_stage(self) -> str | None:
        return next((s for s in STAGES if s not in self.slots), None)

    def reset_from(self, stage: str) -> None:
        for s in STAGES[STAGES.index(stage) :]:
            self.slots.pop(s, None)
        self.stopped = ""

    def dumps(self) -> str:
        return json.dumps({"brief": self.brief, "slots": self.slots, "stopped": self.stopped}, ensure_ascii=False)

    @staticmethod
    def loads(text: str) -> Onboarding:
        return Onboarding(**json.loads(text))


def run_stages(state: Onboarding, stages: dict[str, Callable[[Onboarding], Any]], until: str | None = None, save: Callable[[Onboarding], None] | None = None) -> Onboarding:
    """Run the stages that are due. A review that asks for repair sends the run back to author_extract once."""
    repaired = False
    while (name := state.next_stage()) and not state.stopped:
        try:
            state.slots[name] = stages[name](state)
        except (PlanError, ValueError) as e:
            state.stopped = f"{name}: {e}"
        if name == "author_review" and isinstance(state.slots.get(name), dict) and state.slots[name].get("repair") and not repaired:
            repaired = True
            hint = state.slots[name]["repair"]
            state.reset_from("author_extract")
            state.brief = {**state.brief, "repair": hint}
        if save:
            save(state)
        if name == until:
            break
    return state


def hints(doc: Document, selectors: Sequence[str], limit: int = 6) -> dict[str, dict]:
    """For selectors that miss, the page's nearest ones by shared words; for all, their counts."""
    tokens = lambda s: set(re.findall(r"[a-z0-9]{3,}", s.lower()))
    have: dict[str, None] = {}
    for n in doc.root.walk() if doc.root is not None else ():
        for c in n.classes():
            have[f"{n.tag}.{c}"] = None
        if n.attrs.get("id"):
            have[f"#{n.attrs['id']}"] = None
    out = {}
    for s in selectors:
        try:
            count = len(doc.select_all(s))
        except css.SelectorError as e:
            out[s] = {"count": 0, "error": str(e)}
            continue
        near = sorted(have, key=lambda h: (-len(tokens(h) & tokens(s)), h))
        out[s] = {"count": count} | ({} if count else {"closest": [h for h in near if tokens(h) & tokens(s)][:limit]})
    return out


def consistent(page_text: str, leaves: Sequence[str]) -> bool:
    """Whether a feed backs a page: enough of its first leaves stand in the text."""
    own = [x for x in leaves if len(x) >= 3][:40]
    return sum(x in page_text for x in own) >= max(2, len(own) / 4)
