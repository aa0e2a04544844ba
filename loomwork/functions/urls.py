"""URLs: canonical keys, registrable domains, scores and robots rules."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

TRACKING = frozenset("utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid fbclid msclkid mc_cid mc_eid ref igshid dclid yclid".split())
_PORTS = {"http": ":80", "https": ":443"}
_SECOND = frozenset("co com org net ac gov edu".split())


def canonical(url: str) -> str:
    """One spelling for the same page: folded scheme and host, no default port, tracking or fragment, sorted query."""
    try:
        p = urlsplit(url.strip())
        scheme, host = p.scheme.lower(), p.netloc.lower()
        query = sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in TRACKING)
    except ValueError:
        return url
    host = host.removesuffix(_PORTS.get(scheme, "\0"))
    return urlunsplit((scheme, host, p.path.rstrip("/") or "/", urlencode(query), ""))


def host_of(url: str) -> str:
    try:
        return (urlsplit(url).hostname or "").lower()
    except ValueError:
        return ""


def registrable(url: str) -> str:
    parts = host_of(url).split(".")
    keep = 3 if len(parts) > 2 and len(parts[-1]) == 2 and parts[-2] in _SECOND else 2
    return ".".join(parts[-keep:])


def same_origin(a: str, b: str) -> bool:
    return host_of(a) == host_of(b)


def detail_shaped(url: str) -> bool:
    """Whether a URL looks like one record's page: its last part holds a long number, a long slug or a file name."""
    last = urlsplit(url).path.rstrip("/").rpartition("/")[2]
    return bool(re.search(r"\d{4,}|(?:[a-z0-9]+-){3,}", last, re.I) or re.search(r"\.html?$", last))


def score_url(url: str, domain: list[str], path: list[str]) -> int:
    host, rest = host_of(url), urlsplit(url).path.lower()
    return 2 * sum(d.lower() in host for d in domain) + sum(p.lower() in rest for p in path)


def knobs(url: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in parse_qsl(urlsplit(url).query, keep_blank_values=True):
        out.setdefault(k, v)
    return out


def set_param(url: str, name: str, value: object) -> str:
    p = urlsplit(url)
    query = [(k, v) for k, v in parse_qsl(p.query) if k != name] + [(name, str(value))]
    return urlunsplit(p._replace(query=urlencode(query)))


def parse_robots(text: str, agent: str = "*") -> tuple[list[tuple[bool, str]], list[str]]:
    """(allow, pattern) rules of the agent's group, else of *; and the sitemaps. Neighbouring agents share a group."""
    groups: dict[str, list[tuple[bool, str]]] = {}
    maps, now, open_ = [], [], False
    for line in text.splitlines():
        key, _, value = line.split("#")[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            now = [*now, value.lower()] if open_ else [value.lower()]
            groups.setdefault(value.lower(), [])
            open_ = True
        elif key in ("allow", "disallow"):
            open_ = False
            if value:
                for name in now:
                    groups[name].append((key == "allow", value))
        elif key == "sitemap":
            maps.append(value)
    own = next((rules for name, rules in groups.items() if name != "*" and name in agent.lower()), groups.get("*", []))
    return own, maps


def robots_pattern(pattern: str) -> str:
    """A robots path pattern as a regular expression (for Java as well)."""
    end = pattern.endswith("$")
    body = "".join(".*" if c == "*" else "\\" + c if c in r"\.[]{}()+?^$|" else c for c in pattern.rstrip("$"))
    return "^" + body + ("$" if end else "")


def robots_allows(rules: list[tuple[bool, str]], url: str) -> bool:
    p = urlsplit(url)
    path = (p.path or "/") + ("?" + p.query if p.query else "")
    fits = [(len(pattern), allow) for allow, pattern in rules if re.search(robots_pattern(pattern), path)]
    return max(fits)[1] if fits else True
