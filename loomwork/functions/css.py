"""CSS selectors: type, #id, .class, attributes, the four combinators, lists, :not and the child pseudo-classes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from .dom import Node


class SelectorError(ValueError):
    """A selector outside the grammar."""


_NAME = r"(?:[-\w -￿]|\\.)+"
_TOKEN = re.compile(
    rf"""(?P<id>\#{_NAME})|(?P<class>\.{_NAME})|(?P<attr>\[\s*(?P<an>{_NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*(?P<ci>[iI])?\s*)?\])
    |(?P<pseudo>::?{_NAME})(?P<open>\()?|(?P<type>\*|{_NAME})""",
    re.X,
)
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*([+-]\s*\d+)?|([+-]?\d+))\s*$")


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def _nth(arg: str):
    m = _NTH.match(arg.lower())
    if not m:
        raise SelectorError(f"bad position {arg!r}")
    word, a, b, only = m.groups()
    if word:
        step, shift = 2, int(word == "odd")
    elif only:
        step, shift = 0, int(only)
    else:
        step, shift = int(a + "1" if a in ("", "+", "-") else a), int((b or "0").replace(" ", ""))
    return lambda i: i == shift if step == 0 else (i - shift) % step == 0 and (i - shift) // step >= 0


def _attr(name: str, op: str | None, value: str, fold: bool):
    def test(n: Node) -> bool:
        have = n.attrs.get(name)
        if have is None or op is None:
            return have is not None
        a, b = (have.lower(), value.lower()) if fold else (have, value)
        if op == "=":
            return a == b
        if op == "~=":
            return b in a.split()
        if op == "|=":
            return a == b or a.startswith(b + "-")
        return bool(b) and (a.startswith(b) if op == "^=" else a.endswith(b) if op == "$=" else b in a)

    return test


def _place(n: Node, same: bool, last: bool) -> int:
    own = n.parent.elements if n.parent is not None else [n]
    own = [k for k in own if not same or k.tag == n.tag]
    own = own[::-1] if last else own
    return next(i for i, k in enumerate(own, 1) if k is n)


def _pseudo(name: str, arg: str | None):
    name = name.lstrip(":").lower()
    if name == "not" and arg:
        inner = compiled(arg)
        return lambda n: not inner.matches(n)
    if name in ("nth-child", "nth-of-type", "nth-last-child", "nth-last-of-type") and arg:
        fits, same, last = _nth(arg), name.endswith("type"), "last" in name
        return lambda n: fits(_place(n, same, last))
    simple = {
        "first-child": lambda n: _place(n, False, False) == 1,
        "last-child": lambda n: _place(n, False, True) == 1,
        "first-of-type": lambda n: _place(n, True, False) == 1,
        "last-of-type": lambda n: _place(n, True, True) == 1,
        "only-child": lambda n: _place(n, False, False) == 1 == _place(n, False, True),
        "empty": lambda n: not n.elements and not "".join(n.strings()),
        "root": lambda n: n.parent is None,
        "checked": lambda n: "checked" in n.attrs or "selected" in n.attrs,
    }
    if name in simple and arg is None:
        return simple[name]
    if name == "contains" and arg:
        said = arg.strip().strip("\"'")
        return lambda n: said in n.text
    raise SelectorError(f"unsupported :{name}")


class _Compound:
    def __init__(self):
        self.tag: str | None = None
        self.tests: list = []

    def fits(self, n: Node) -> bool:
        return (self.tag is None or n.tag == self.tag) and all(t(n) for t in self.tests)


class Selector:
    """A selector list; each alternative is compounds joined by combinators, matched from the right."""

    def __init__(self, source: str):
        self.alternatives: list[list[tuple[str, _Compound]]] = []
        if not source.strip():
            raise SelectorError("empty selector")
        i, now, combinator = 0, [], ""
        fresh = True
        while i <= len(source):
            space = re.compile(r"\s*([>+~,])?\s*").match(source, i)
            if space and (space.end() > i or i == len(source)):
                mark, i = space.group(1), space.end()
                if mark == "," or (i == len(source) and mark is None):
                    if not now or combinator in (">", "+", "~"):
                        raise SelectorError(f"dangling combinator in {source!r}")
                    self.alternatives.append(now)
                    now, combinator, fresh = [], "", True
                    if i == len(source):
                        if mark == ",":
                            raise SelectorError("a list ends with a comma")
                        break
                    continue
                if i == len(source):
                    raise SelectorError(f"dangling combinator in {source!r}")
                if mark and fresh and not now:
                    raise SelectorError(f"{source!r} begins with a combinator")
                combinator = mark or (" " if now else "")
            compound, i = self._compound(source, i)
            now.append((combinator, compound))
            combinator, fresh = "", False

    def _compound(self, source: str, i: int) -> tuple[_Compound, int]:
        out, begin = _Compound(), i
        while i < len(source) and (m := _TOKEN.match(source, i)):
            if m["type"] is not None:
                if i != begin:
                    break
                out.tag = None if m["type"] == "*" else _unescape(m["type"])
            elif m["id"]:
                out.tests.append(_attr("id", "=", _unescape(m["id"][1:]), False))
            elif m["class"]:
                out.tests.append(lambda n, c=_unescape(m["class"][1:]): c in n.classes())
            elif m["attr"]:
                value = next((v for v in (m["dq"], m["sq"], m["bare"]) if v is not None), "")
                out.tests.append(_attr(m["an"], m["op"], value, bool(m["ci"])))
            else:
                end, arg = m.end(), None
                if m["open"]:
                    depth = 1
                    while end < len(source) and depth:
                        depth += {"(": 1, ")": -1}.get(source[end], 0)
                        end += 1
                    if depth:
                        raise SelectorError(f"open bracket in {source!r}")
                    arg = source[m.end() : end - 1]
                out.tests.append(_pseudo(m["pseudo"], arg))
                i = end
                continue
            i = m.end()
        if i == begin:
            raise SelectorError(f"can't read {source[i:]!r}")
        return out, i

    def matches(self, n: Node, scope: Node | None = None) -> bool:
        return any(self._from(chain, len(chain) - 1, n) for chain in self.alternatives)

    def _from(self, chain: list[tuple[str, _Compound]], k: int, n: Node) -> bool:
        combinator, compound = chain[k]
        if not compound.fits(n):
            return False
        if k == 0:
            return True
        if combinator == " ":
            return any(self._from(chain, k - 1, a) for a in n.ancestors())
        if combinator == ">":
            return n.parent is not None and self._from(chain, k - 1, n.parent)
        near = n.siblings(-1)
        return any(self._from(chain, k - 1, s) for s in near) if combinator == "~" else (first := next(near, None)) is not None and self._from(chain, k - 1, first)


@lru_cache(4096)
def compiled(source: str) -> Selector:
    return Selector(source)


def select_all(node: Node, source: str) -> Iterator[Node]:
    """Matches at or below ``node`` in document order."""
    selector = compiled(source)
    return (n for n in node.walk() if selector.matches(n))


def select(node: Node, source: str) -> Node | None:
    return next(select_all(node, source), None)
