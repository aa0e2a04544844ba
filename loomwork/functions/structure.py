"""Repeating regions, outlines and durable selectors of a page."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from .document import Document
from .dom import Node

_GENERATED = ("css-", "sc-", "emotion-", "jss", "makestyles", "mui", "chakra-", "svelte-", "styled-", "_")
_BARE = frozenset("flex grid hidden relative absolute fixed sticky inline-flex inline-block truncate italic uppercase lowercase capitalize underline antialiased transform transition".split())
_PROPS = (
    "[mp][trblxyse]? w h min-[wh] max-[wh] size gap gap-[xy] space-[xy] inset top right bottom left z grid-cols grid-rows col-(?:span|start|end) row-(?:span|start|end) order basis grow shrink flex justify items self "
    "content place text font leading tracking indent align whitespace break bg from via to border divide rounded ring outline shadow opacity overflow object aspect columns float clear cursor select resize scroll snap "
    "transition duration ease delay animate scale rotate translate skew origin fill stroke sr"
)
_UTILITY = re.compile(rf"-?(?:{'|'.join(_PROPS.split())})-\S+")
_LABEL = re.compile(r"[a-z]{2,8}-[a-z0-9]{5,10}-([A-Z][A-Za-z0-9]{2,})")
_MODULE = re.compile(r"([A-Za-z][A-Za-z0-9-]*?)_(?=[A-Za-z0-9]*\d)[A-Za-z0-9]+")
_MIXED = re.compile(r"[a-z]+\d+[a-z]+[a-z0-9]*")
_SKIP = frozenset("script style noscript template br hr".split())
_WRAPPERS = frozenset({"div", "span"})
_NO_RECORDS = frozenset("svg head select datalist math".split())
_CHROME_TAGS = frozenset("nav header footer aside".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo menu menubar complementary".split())


def stable_stem(token: str) -> str:
    """The lasting part of a generated class; "" where there is none."""
    m = _LABEL.fullmatch(token) or _MODULE.fullmatch(token)
    return m.group(1) if m and len(m.group(1)) > 2 else ""


def is_utility_class(token: str) -> bool:
    return token in _BARE or _UTILITY.fullmatch(token) is not None


def is_noise_class(token: str) -> bool:
    if is_utility_class(token):
        return True
    if len(token) < 5:
        return False
    if token.lower().startswith(_GENERATED[:-1]):
        return True
    kinds = [any(map(f, token)) for f in (str.isupper, str.islower, str.isdigit)]
    if all(kinds) or (len(token) >= 7 and _MIXED.fullmatch(token)):
        return True
    return any(len(p) >= 8 and re.fullmatch("[0-9a-f]*[0-9][0-9a-f]*", p) for p in re.split("[-_]", token))


def class_hook(token: str) -> str:
    """A selector fragment that outlives a rebuild; "" for noise."""
    if stem := stable_stem(token):
        return f'[class*="{stem}"]'
    return "" if is_noise_class(token) else "." + token


def semantic_classes(tokens: list[str]) -> list[str]:
    return [t for t in tokens if not is_noise_class(t)]


@dataclass(frozen=True)
class RecordRegion:
    item_selector: str
    container_selector: str
    count: int
    container_tag: str
    container_id: str
    score: float

    def row(self) -> dict:
        return asdict(self)


def _hooks(n: Node) -> list[str]:
    return [h for t in n.classes() if (h := class_hook(t))]


def _parts(n: Node) -> list[Node]:
    return [k for k in n.elements if k.tag not in _SKIP]


def _inner(n: Node) -> Node:
    for _ in range(4):
        kids = _parts(n)
        if n.tag not in _WRAPPERS or _hooks(n) or len(kids) != 1:
            break
        n = kids[0]
    return n


def regions(doc: Document, min_items: int = 3) -> list[tuple[Node, RecordRegion]]:
    """Containers whose children repeat one shape, best first."""
    if doc.root is None:
        return []
    found, banned, chrome = [], set(), set()
    for box in doc.root.walk():
        if id(box.parent) in banned or box.tag in _NO_RECORDS:
            banned.add(id(box))
            continue
        if id(box.parent) in chrome or box.tag in _CHROME_TAGS or box.attrs.get("role", "").lower() in _CHROME_ROLES:
            chrome.add(id(box))
        kids = _parts(box)
        if len(kids) < min_items:
            continue
        groups: dict[tuple, list[Node]] = {}
        for kid in kids:
            own = _inner(kid)
            groups.setdefault((own.tag, frozenset(_hooks(own)), tuple(k.tag for k in _parts(own))), []).append(own)
        for members in groups.values():
            if len(members) < min_items:
                continue
            sample = members[:20]
            rich = min(sum(min(12, sum(1 for _ in m.walk())) for m in sample) / len(sample), 10) / 10
            shared = [h for h in _hooks(members[0]) if all(h in _hooks(m) for m in members[1:])]
            where = "#" + box.attrs["id"] if box.attrs.get("id") else box.tag + "".join(_hooks(box)[:2])
            score = len(members) * (1 + rich) * (0.25 if id(box) in chrome else 1)
            found.append((box, RecordRegion(members[0].tag + (shared[0] if shared else ""), where, len(members), box.tag, box.attrs.get("id", ""), round(score, 3))))
    return sorted(found, key=lambda x: -x[1].score)


def records(doc: Document, min_items: int = 3, top_k: int = 3) -> list[RecordRegion]:
    return [r for _, r in regions(doc, min_items)[:top_k]]


_CLICK_ROLES = frozenset("button link tab menuitem menuitemcheckbox menuitemradio checkbox radio switch option combobox slider spinbutton".split())


def clickable(n: Node) -> bool:
    return (
        (n.tag == "a" and "href" in n.attrs)
        or n.tag in ("button", "summary", "label", "option", "input", "select", "textarea")
        or n.attrs.get("role", "").strip().lower() in _CLICK_ROLES
        or any(k in n.attrs for k in ("onclick", "tabindex", "contenteditable"))
    )


def skeleton(doc: Document, max_lines: int = 400, text_chars: int = 40, drop_chrome: bool = False) -> str:
    """An indented outline of open tags; ``*n`` marks a container of n records, ``!`` something to click."""
    if doc.root is None:
        return ""
    marks = {}
    for box, r in regions(doc):
        marks.setdefault(id(box), r.count)
    lines: list[str] = []

    def add(n: Node, depth: int) -> None:
        if len(lines) >= max_lines or n.tag in _SKIP or (drop_chrome and n.tag in _CHROME_TAGS):
            return
        name = n.tag + ("#" + n.attrs["id"] if n.attrs.get("id") else "") + "".join("." + c for c in semantic_classes(n.classes())[:2])
        own = " ".join("".join(k for k in n.kids if type(k) is str).split())[:text_chars]
        lines.append("  " * depth + name + (f" *{marks[id(n)]}" if id(n) in marks else "") + (" !" if clickable(n) else "") + (f" {own!r}" if own else ""))
        for kid in n.elements:
            add(kid, depth + 1)

    add(doc.root, 0)
    return "\n".join(lines)


# selectors

_CLASS_IN = re.compile(r"\.([A-Za-z_][\w-]*)")
_QUOTED = re.compile(r"(\"[^\"]*\"|'[^']*')")


def normalise(selector: str) -> str:
    """Child combinators relaxed to descent, generated classes to their stems; quoted text and XPath as they are."""
    if selector.lstrip().startswith("/"):
        return selector
    parts = _QUOTED.split(selector)
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"\s*>\s*", " ", parts[i])
        parts[i] = _CLASS_IN.sub(lambda m: f'[class*="{s}"]' if (s := stable_stem(m.group(1))) else m.group(0), parts[i])
    return "".join(parts).strip()


def problems(selector: str, role: str = "field") -> list[str]:
    """What makes a selector fragile, by what it is for: records, field, detail or anchor."""
    out = []
    if not selector.strip():
        return ["empty"]
    if selector.lstrip().startswith("/"):
        return ["xpath"]
    plain = _QUOTED.sub("", selector)
    noise = [c for c in _CLASS_IN.findall(plain) if is_noise_class(c) and not stable_stem(c)]
    if noise:
        out.append("generated class: " + ", ".join(noise))
    if ":nth" in plain:
        out.append("depends on a position")
    if role == "records" and re.fullmatch(r"\s*(div|span|a|p|\*)\s*", plain):
        out.append("too broad for records")
    if role == "records" and "#" in plain.split()[-1]:
        out.append("an id names one element")
    if role == "detail" and re.search(r"#\w*\d{2,}", plain):
        out.append("an id of one record")
    return out


def pager_of(doc: Document) -> dict | None:
    """How a page leads to the next one: its link, or the parameter that counts pages."""
    nxt = doc.select("a[rel~=next][href], link[rel~=next][href], .pagination a.next, nav.pager a.next, [aria-label=Next][href]")
    if nxt is not None and nxt.attrs.get("href"):
        return {"kind": "link", "href": nxt.attrs["href"]}
    names: dict[str, int] = {}
    for link in doc.links():
        for name in re.findall(r"[?&](p|pg|page|page_num|paged|offset|start)=\d+", link):
            names[name] = names.get(name, 0) + 1
    if names:
        return {"kind": "param", "name": max(names, key=names.get)}
    return None


def filters_of(doc: Document) -> list[dict]:
    """Choices that change what a page lists: year selects and tabs."""
    out = []
    for box in doc.select_all("select"):
        options = [o.text for o in box.walk() if o.tag == "option"]
        years = [o for o in options if re.fullmatch(r"(19|20)\d\d", o)]
        if years:
            out.append({"kind": "select", "name": box.attrs.get("name", ""), "options": years})
    tabs = [t.text for t in doc.select_all("[role=tab], [data-tab]")]
    if tabs:
        out.append({"kind": "tabs", "name": "", "options": tabs})
    return out
