"""Value functions as native columns: no Python runs for them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import TRACKING, robots_pattern
from .values import WORDS


def _lit_map(table: Mapping) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def number(text: Column) -> Column:
    """The first number in a text, commas dropped; else the first number word up to twenty."""
    digits = F.regexp_extract(text, "(-?\\d[\\d,]*(?:\\.\\d+)?|-?\\.\\d+)", 1)
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.lower(w))
    table = _lit_map({w: float(i) for i, w in enumerate(WORDS)})
    said = F.try_element_at(F.filter(F.transform(words, lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull()), F.lit(1))
    return F.when(digits != "", F.regexp_replace(digits, ",", "").try_cast("double")).otherwise(said)


def regex(text: Column, pattern: str, group: int = 0, default: str | None = None) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group)).otherwise(F.lit(default))


def lookup(text: Column, table: Mapping[str, object], default: object = None) -> Column:
    """The entry of a text as it stands, else trimmed and without case."""
    folded = {str(k).strip().lower(): v for k, v in table.items()}
    return F.coalesce(F.try_element_at(_lit_map(table), text), F.try_element_at(_lit_map(folded), F.lower(F.trim(text))), F.lit(default))


def split(text: Column, sep: str | None = None, maxsplit: int = -1, regex: bool = False, keep_empty: bool = False) -> Column:
    import re

    pattern = (sep if regex else re.escape(sep)) if sep else "\\s+"
    limit = -1 if maxsplit < 0 or (regex and maxsplit == 0) else maxsplit + 1
    parts = F.transform(F.split(F.trim(text) if sep is None else text, pattern, limit), lambda x: F.trim(x))
    parts = parts if keep_empty else F.filter(parts, lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


_MONTH = "(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\.?"


def date(text: Column, dayfirst: bool = False) -> Column:
    """YYYY-MM-DD for the plain forms: ISO, named months, year first, and numeric ones; else null (see values.date)."""
    month = lambda s: F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(s)) + 2) / 3).cast("int")
    # named elements of an array of one value keep the text, and each match, from being computed for every group anew
    named = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)

    def make(y: Column, m: Column, d: Column) -> Column:
        text_ = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        return text_.try_cast("date")

    def first(text_: Column, pattern: str, read) -> Column:
        """``read(group, number)`` of the first match; null where there is none."""

        def groups(found: Column) -> Column:
            get = lambda g: F.regexp_extract(found, pattern, g)
            return F.when(found != "", read(get, lambda g: get(g).try_cast("int")))

        return named(F.regexp_extract(text_, pattern, 0), groups)

    def numeric(get, num) -> Column:
        a, b, y = num(1), num(2), num(3)
        y = F.when(y < 100, y + 2000).otherwise(y)
        day = F.lit(dayfirst) | (a > 12)
        return make(y, F.when(day, b).otherwise(a), F.when(day, a).otherwise(b))

    p1 = f"(\\d{{1,2}})(?:st|nd|rd|th)?\\s+{_MONTH},?\\s+(\\d{{4}})"
    p2 = f"{_MONTH}\\s+(\\d{{1,2}})(?:st|nd|rd|th)?,?\\s+(\\d{{4}})"
    p3 = "(?<!\\d)(\\d{4})[/.](\\d{1,2})[/.](\\d{1,2})(?!\\d)"
    p4 = "(?<!\\d)(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{4}|\\d{2})(?!\\d)"
    found = named(
        text,
        lambda t: F.coalesce(
            first(t, "(\\d{4})-(\\d{2})-(\\d{2})", lambda get, num: make(num(1), num(2), num(3))),
            first(t, p1, lambda get, num: make(num(3), month(get(2)), num(1))),
            first(t, p2, lambda get, num: make(num(3), month(get(1)), num(2))),
            first(t, p3, lambda get, num: make(num(1), num(2), num(3))),
            first(t, p4, numeric),
        ),
    )
    return F.date_format(found, "yyyy-MM-dd")


def truthy(value: Column, kind: str) -> Column:
    """Python's truth of a column of a Spark type."""
    if kind == "boolean":
        known = value
    elif kind == "string":
        known = value != ""
    elif kind.startswith(("array", "map")):
        known = F.size(value) > 0
    else:
        known = value != 0 if not kind.startswith("struct") else value.isNotNull()
    return F.coalesce(known, F.lit(False))


def is_empty(value: Column, kind: str = "string") -> Column:
    if kind == "string":
        return value.isNull() | (F.trim(value) == "")
    return value.isNull() | (F.size(value) == 0) if kind.startswith(("array", "map")) else value.isNull()


def equal(a: Column, b: Column, kind_a: str = "string", kind_b: str = "string") -> Column:
    """A miss equals a miss; unlike types never do."""
    numbers = {"int", "bigint", "double", "float"}
    if kind_a != kind_b and not {kind_a, kind_b} <= numbers:
        return F.coalesce(a.isNull() & b.isNull(), F.lit(False))
    return a.eqNullSafe(b)


def less(a: Column, b: Column) -> Column:
    return F.coalesce(a < b, F.lit(False))


def json_path(text: Column, path: str) -> Column:
    return F.try_variant_get(F.try_parse_json(text), "$." + path if not path.startswith("[") else "$" + path, "string")


def words(*texts: Column) -> Column:
    """Distinct words of identifiers, camel case parted, longer than two letters."""
    spaced = F.regexp_replace(F.concat_ws(" ", *texts), "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2))


def schema_fit(api: Column, brief: Column) -> Column:
    return F.size(F.array_intersect(api, brief))


def clip(text: Column, most: int, kind: str = "text") -> Column:
    """A long text cut to ``most`` characters: the head; of HTML the middle; of JSON both ends."""
    n = F.length(text)
    if kind == "html":
        short = F.substr(text, F.floor((n - most) / 2).cast("int") + 1, F.lit(most))
    elif kind == "json":
        short = F.concat(F.substr(text, F.lit(1), F.lit(most // 2)), F.lit("..."), F.substr(text, n - most // 2 + 1))
    else:
        short = F.substr(text, F.lit(1), F.lit(most))
    return F.when(n <= most, text).otherwise(short)


# URLs


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The key of :func:`loomwork.functions.urls.canonical` for URLs that need no percent-encoding anew."""
    scheme = F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    place = F.lower(F.regexp_extract(url, "^[^:]+://([^/?#]*)", 1))
    place = F.when(scheme == "http", F.regexp_replace(place, ":80$", "")).when(scheme == "https", F.regexp_replace(place, ":443$", "")).otherwise(place)
    trail = F.regexp_replace(path(url), "/+$", "")
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    own = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING)))
    own = F.transform(own, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    tail = F.array_join(own, "&")
    return F.concat(scheme, F.lit("://"), place, F.when(trail == "", "/").otherwise(trail), F.when(tail == "", "").otherwise(F.concat(F.lit("?"), tail)))


def registrable(url: Column) -> Column:
    parts = F.split(host(url), "\\.")
    n = F.size(parts)
    three = (n > 2) & (F.length(F.element_at(parts, -1)) == 2) & F.get(parts, n - 2).isin("co", "com", "org", "net", "ac", "gov", "edu")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), n - F.when(three, 2).otherwise(1)), F.lit(3)), ".")


def same_origin(a: Column, b: Column) -> Column:
    return host(a).eqNullSafe(host(b))


def detail_shaped(url: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(path(url), "/+$", ""), "/"), -1)
    return last.rlike("(?i)\\d{4,}|(?:[a-z0-9]+-){3,}") | last.rlike("\\.html?$")


def score_url(url: Column, domain: Sequence[str], parts: Sequence[str]) -> Column:
    hits = lambda where, hints: sum((F.contains(where, F.lit(h.lower())).cast("int") for h in hints), F.lit(0))
    return 2 * hits(host(url), domain) + hits(F.lower(path(url)), parts)


def knobs(url: Column) -> Column:
    """Query parameters; of repeated ones the first."""
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(F.try_url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.try_url_decode(F.substr(p, F.length(F.split_part(p, F.lit("="), F.lit(1))) + 2)).alias("v")))
    firsts = F.filter(pairs, lambda x, i: F.array_position(F.transform(pairs, lambda y: y["k"]), x["k"]) == i + 1)
    return F.map_from_entries(firsts)


def robots_allowed(url: Column, rules: Sequence[tuple[bool, str]]) -> Column:
    """The longest fitting rule decides, allow before disallow; none allows."""
    where = F.concat(F.when(path(url) == "", "/").otherwise(path(url)), F.regexp_extract(url, "(\\?[^#]*)", 1))
    fits = [F.when(where.rlike(robots_pattern(p)), F.struct(F.lit(len(p)).alias("n"), F.lit(a).alias("allow"))) for a, p in rules]
    return F.coalesce(F.array_max(F.array_compact(F.array(*fits)))["allow"], F.lit(True)) if fits else F.lit(True)


# identities


def json_text(text: Column) -> Column:
    """A string as JSON text, as Python writes it without escaping non-ASCII."""
    inner = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substr(inner, F.lit(2), F.length(inner) - 2))


def identity(columns: Mapping[str, Column] | Sequence[str]) -> Column:
    """The digest of a row's string fields: 24 hex digits of the sha256 of its sorted [name, value] pairs."""
    own = dict(columns) if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    parts = [F.concat(F.lit(f'["{k}", '), json_text(own[k].cast("string")), F.lit("]")) for k in sorted(own) if not k.startswith("_")]
    return F.substr(F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")), 256), F.lit(1), F.lit(24))


def identity_key(identity_: Column, row: Column) -> Column:
    return F.coalesce(F.when(identity_ != "", identity_), F.substr(F.sha2(F.to_json(row), 256), F.lit(1), F.lit(24)))


def noisy_or(confidences: Column) -> Column:
    """1 - prod(1 - c) over an array, to four places."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.round(1 - F.aggregate(confidences, F.lit(1.0), lambda a, c: a * (1 - clamp(c))), 4)
