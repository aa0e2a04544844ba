"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions alone.

Two lines are linked when at most ``errors`` edits part them. A line is cut into errors + 1 segments, of which so many
edits leave one whole; segments are cut at places that lines of about one length share, counted from the nearer end, so
that each line has a few keys and lines to be linked have one of them in common. Of lines that share a key, those are
verified whose counts of frequent characters are near enough, by a banded bit-parallel edit distance. Lines shorter
than ``shortest`` characters are compared exactly only: so short, edits make other lines.

A line is dropped where the same or a linked line comes earlier: lines are ordered by their first document, then by
hash. Within a document the first of equal lines stays. Empty lines part paragraphs: one stays in each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ERRORS, SHORTEST = 2, 24
_BLOCK = 16
#: Characters of the ends that are compared before the banded pass.
_ENDS = (32, 160)
#: Lines of one key that are compared with one another in one group.
BLOCK_LINES = 1000
#: Characters that are counted in a line before it is compared with others; any would do, frequent ones turn most away.
COUNTED = " eaotin."
#: Hashes that may be sent to every executor (some 24 bytes each); beyond, tables are joined.
BROADCAST_HASHES = 1_000_000


def _cut(length: Column, errors: int) -> Column:
    """The least length of the lines that are cut as one of ``length`` characters is; steps between such lengths are an eighth of it or so, and more than ``errors``."""
    least = max(8, 1 << (2 * errors).bit_length())
    step = F.greatest(F.lit(least), F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), F.length(F.bin(length)) - 4)))
    return (length - length % step).cast("int")


def _places(errors: int) -> tuple[int, list[tuple[int, bool, int, int]]]:
    """Characters of a line that are kept for shifts, and (k, right, segments, shift) of each key: it starts so many segments and characters from the left or the right end.

    Of the segments that edits leave whole there is one, k, with k edits to its left at most and errors - k to its
    right. So it is moved by no more than that as seen from the nearer end, by ``t`` at most; if it is ``t`` characters
    longer than a key, two lines' keys at shifts 0 to ``t`` meet whichever way and however far it was moved.
    """
    slack = [min(k, errors - k) for k in range(errors + 1)]
    places = []
    for k, t in enumerate(slack):
        right = k > errors - k
        for i in range(t + 1):
            places.append((k, right, errors + 1 - k, sum(slack[k:]) - i) if right else (k, right, k, sum(slack[:k]) + i))
    return sum(slack), places


def line_keys(lines: DataFrame, errors: int) -> DataFrame:
    """(h, key) of ``lines`` (h, line, size): lines that ``errors`` edits part at most have a key in common.

    A line that is up to ``errors`` characters short of the next way to cut is cut both ways. One row a place, so that
    the code for a key is small enough to be compiled.
    """
    slack, places = _places(errors)
    rows = [F.struct(F.lit(k).alias("k"), F.lit(r).alias("right"), F.lit(n).alias("n"), F.lit(s).alias("shift"), F.lit(up).alias("up")) for up in (False, True) for k, r, n, s in places]
    own = lines.withColumns({"own": _cut(F.col("size"), errors), "next": _cut(F.col("size") + errors, errors)})
    own = own.select("h", "line", "size", "own", "next", F.explode(F.array(*rows)).alias("_p")).select("h", "line", "size", "own", "next", "_p.*")
    own = own.where(~F.col("up") | (F.col("own") != F.col("next"))).withColumn("cut", F.when(F.col("up"), F.col("next")).otherwise(F.col("own")))
    part = F.greatest(F.lit(0), F.floor((F.col("cut") - errors - slack) / (errors + 1))).cast("int")
    own = own.select("h", "line", "size", "k", "right", "n", "shift", "cut", part.alias("part"))
    off = F.col("n") * F.col("part") + F.col("shift")
    own = own.select("h", "line", "k", "cut", "part", F.when(F.col("right"), F.col("size") - off).otherwise(off).alias("at"))
    return own.select("h", F.xxhash64("k", "cut", F.substring("line", F.col("at") + 1, F.col("part"))).alias("key"))


def banded_distance(a: Column, b: Column, errors: int) -> Column:
    """Edits between two strings whose lengths differ by ``errors`` at most; more than ``errors`` comes out as some larger number.

    Equal blocks at both ends are cut off. Then one pass over the shorter rest, with the vertical differences of a
    band of 2 errors + 2 diagonals in the bits of one number (Myers' recurrence, as Hyyro banded it).
    """
    width = 2 * errors + 1
    full = (1 << (width + 1)) - 1
    top = 1 << width

    def ends(x: Column) -> Column:
        """Cut off the blocks that both sides share, from the left and then from the right."""
        p, t = x["p"], x["t"]
        blocks = F.floor(F.length(t) / _BLOCK).cast("int")
        same = F.transform(F.sequence(F.lit(0), blocks), lambda i: F.substr(p, i * _BLOCK + 1, F.lit(_BLOCK)) == F.substr(t, i * _BLOCK + 1, F.lit(_BLOCK)))
        first = F.array_position(same, False)
        cut = F.when(first > 0, (first - 1) * _BLOCK).otherwise(F.length(t)).cast("int")
        return F.struct(F.substr(p, cut + 1).alias("p"), F.substr(t, cut + 1).alias("t"))

    def let(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def distance(x: Column) -> Column:
        p, t = F.split(x["p"], ""), F.split(x["t"], "")
        m, n = F.length(x["p"]), F.length(x["t"])
        chars = F.struct(p.alias("p"), t.alias("t"), m.alias("m"), n.alias("n"))
        start = F.struct(F.lit(((1 << (errors + 1)) - 1) << (width - errors)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(errors).alias("d"), F.lit(top >> 1).cast("long").alias("h"))

        def run(c: Column) -> Column:
            def step(s: Column, j: Column) -> Column:
                # bit width - k of the match word: pattern place j + errors - k
                match = None
                for k in range(width + 1):
                    bit = F.when(F.get(c["p"], j + (errors - k)) == F.get(c["t"], j), F.lit(1 << (width - k)).cast("long")).otherwise(F.lit(0).cast("long"))
                    match = bit if match is None else match.bitwiseOR(bit)

                def inner(e: Column) -> Column:
                    x_, vp, vn = e["x"], e["vp"], e["vn"]
                    d0 = (x_.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x_).bitwiseOR(vn).bitwiseAND(F.lit(full).cast("long"))
                    return F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), e["d"].alias("d"), e["h"].alias("h"))

                def outer(e: Column) -> Column:
                    d0, vp, vn = e["d0"], e["vp"], e["vn"]
                    mask = F.lit(full).cast("long")
                    hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(mask))
                    hn = d0.bitwiseAND(vp)
                    half = F.shiftrightunsigned(d0, 1)
                    down = j < c["m"] - errors
                    d = F.when(down, e["d"] + F.when(d0.bitwiseAND(F.lit(top).cast("long")) == 0, 1).otherwise(0)).otherwise(
                        e["d"] + F.when(hp.bitwiseAND(e["h"]) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(e["h"]) != 0, 1).otherwise(0)
                    )
                    return F.struct(
                        hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(mask)).alias("vp"),
                        half.bitwiseAND(hp).alias("vn"),
                        d.cast("int").alias("d"),
                        F.when(down, e["h"]).otherwise(F.shiftrightunsigned(e["h"], 1)).alias("h"),
                    )

                first = let(F.struct(match.alias("x"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), s["h"].alias("h")), inner)
                return let(first, outer)

            return F.aggregate(F.sequence(F.lit(0), c["n"] - 1), start, step)["d"]

        # a rest shorter than the band: all of the longer rest may be edits
        return F.when((n == 0) | (m <= errors), F.levenshtein(x["p"], x["t"])).otherwise(let(chars, run))

    longer = F.length(a) >= F.length(b)
    pair = F.struct(F.when(longer, a).otherwise(b).alias("p"), F.when(longer, b).otherwise(a).alias("t"))
    back = lambda x: F.struct(F.reverse(x["p"]).alias("p"), F.reverse(x["t"]).alias("t"))
    # equally long ends of two strings at most e apart are at most 2 e apart themselves: most strangers leave here, in compiled code
    near = None
    for n in _ENDS:
        for cut in (lambda x: F.substring(x, 1, n), lambda x: F.right(x, F.lit(n))):
            own = F.levenshtein(cut(a), cut(b), 2 * errors) >= 0
            near = own if near is None else near & own
    return F.when(near, let(let(let(let(pair, ends), back), ends), distance)).otherwise(errors + 1)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line): each line of each text; row is the text's hash, which tells rows of one doc_id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("_t")).where("_t <> ''")
    return own.select("doc_id", "row", F.explode(F.split("_t", "\n")).alias("line"))


def hashed_lines(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, row, line, h): the lines of ``shortest`` characters or more, with the hash that they are known by."""
    return lines_of(docs).where(F.length("line") >= shortest).withColumn("h", F.xxhash64("line"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, h, lead): each line of each document that isn't empty, once; written without texts. One line of each row leads, so that equal rows can be counted."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("_t")).where("_t <> ''")
    own = own.select("doc_id", "row", F.posexplode(F.array_remove(F.array_distinct(F.split("_t", "\n")), "")).alias("_at", "line"))
    return C.materialise(own.select("doc_id", "row", F.xxhash64("line").alias("h"), (F.col("_at") == 0).alias("lead")), "lines")


def _few(hashes: DataFrame, most: int) -> bool:
    """Whether a table of hashes is small enough, by count, to be sent to every executor."""
    return hashes.count() <= most


def _sent(table: DataFrame, most: int) -> DataFrame:
    return F.broadcast(table) if _few(table, most) else table


def distinct_lines(docs: DataFrame, repeated: DataFrame, shortest: int, most: int) -> DataFrame:
    """(h, line): each distinct line, from its first document alone (and as often as it stands there) where the ``repeated`` ones (h, first) are few enough to be known everywhere."""
    lines = hashed_lines(docs, shortest)
    if _few(repeated, most):
        known = lines.join(F.broadcast(repeated.withColumn("_again", F.lit(True))), "h", "left")
        return known.where(F.col("_again").isNull() | F.col("first").eqNullSafe(F.col("doc_id"))).select("h", "line")
    return lines.select("h", "line").distinct()


def _in_blocks(members: DataFrame, block: int = BLOCK_LINES) -> tuple[DataFrame, DataFrame]:
    """``members`` (key, m, h, ...) twice, to be joined on key, i and j. Of a key that more than ``block`` lines have, ``block`` lines on one side meet as many on the other in one group."""
    blocks = F.ceil(F.col("m") / block).cast("int")
    placed = members.withColumns({"_own": F.pmod(F.xxhash64("h"), blocks).cast("int"), "_all": F.explode(F.sequence(F.lit(0), blocks - 1))}).drop("m")
    return placed.withColumnsRenamed({"_own": "i", "_all": "j"}), placed.withColumnsRenamed({"_own": "j", "_all": "i"})


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with a column of ``table`` (h, ...) for either side; a line of very many pairs meets them in many places."""
    for side, other in (("a", "b"), ("b", "a")):
        pairs = C.lookup(pairs.withColumn("_spread", C.spread_of(F.col(other))), [side], table.select(F.col("h").alias(side), F.col(column).alias(column + side)), "_spread").drop("_spread")
    return pairs


def candidates(members: DataFrame, errors: int) -> DataFrame:
    """(a, b), a < b: lines of ``members`` (key, m, h, size, counts) that share a key and may be as near as ``errors`` edits by their lengths and counts.

    An edit takes one character and puts in one at most, so counts differ by two an edit in all; by one, if it changes the length.
    """
    one, two = _in_blocks(members)
    one, two = one.withColumnsRenamed({"h": "a", "size": "sizea", "counts": "countsa"}), two.withColumnsRenamed({"h": "b", "size": "sizeb", "counts": "countsb"})
    apart = F.lit(0)
    for k in range(len(COUNTED)):
        apart = apart + F.abs(F.col("countsa")[f"n{k}"] - F.col("countsb")[f"n{k}"])
    longer = F.abs(F.col("sizea") - F.col("sizeb"))
    met = one.join(two, ["key", "i", "j"]).where((F.col("a") < F.col("b")) & (longer <= errors) & (apart + longer <= 2 * errors))
    return met.select("a", "b").distinct()


def linked_lines(docs: DataFrame, repeated: DataFrame, errors: int, shortest: int, most: int) -> DataFrame:
    """(a, b, firsta, firstb): hashes of linked distinct lines, both ways, and the first documents of the lines."""
    # a column of its own: counting characters reads the line
    lines = distinct_lines(docs, repeated, shortest, most).withColumn("size", F.length("line"))
    keys = C.materialise(line_keys(lines, errors), "keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("h").alias("_l"), F.max("h").alias("_g"))
    shared = C.materialise(shared.where("_l < _g").select("key", "m"), "shared")
    members = C.materialise(keys.join(_sent(shared, most), "key").distinct(), "members")
    met = C.materialise(members.select("h").distinct(), "met")
    texts = hashed_lines(docs, shortest).join(_sent(met, most), "h", "left_semi").groupBy("h", "line").agg(F.min("doc_id").alias("first"))
    counts = [(F.octet_length("line") - F.octet_length(F.replace("line", F.lit(c), F.lit("")))).alias(f"n{k}") for k, c in enumerate(COUNTED)]
    texts = C.materialise(texts.select("h", "line", "first", F.length("line").alias("size"), F.struct(*counts).alias("counts")), "texts")
    pairs = C.materialise(candidates(members.join(texts.select("h", "size", "counts"), "h"), errors), "pairs")
    both = _both(pairs, texts, "line")
    good = both.where(banded_distance(F.col("linea"), F.col("lineb"), errors) <= errors).select("a", "b")
    good = _both(C.materialise(good, "near"), texts, "first")
    good = C.materialise(good.select("a", "b", "firsta", "firstb"), "links")
    return good.union(good.select("b", "a", "firstb", "firsta"))


def line_report(docs: DataFrame, errors: int = ERRORS, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, n_lines, n_kept, n_links) for each row of ``docs`` (doc_id, text; further columns are ignored).

    n_lines counts the lines of the text (none for null and empty), n_kept those that stay, n_links the links of
    its distinct lines to other lines. Lines below ``shortest`` have no links. Rows that repeat a doc_id count as one
    document where lines come first. An empty table gives an empty one.
    """
    return _report(docs, decisions(docs, errors, shortest))


def decisions(docs: DataFrame, errors: int, shortest: int, most: int = BROADCAST_HASHES) -> DataFrame:
    """The occurrences (doc_id, row, h, lead) with the first document of the line, whether a linked line comes before it (late), and its number of links; nulls for a line that is met once and has none."""
    held = occurrences(docs)
    repeated = held.groupBy("h").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = C.materialise(repeated.select("h", "first"), "repeated")
    links = linked_lines(docs, repeated, errors, shortest, most)
    order = lambda x, y: F.struct(F.col(x), F.col(y))
    near = links.groupBy(F.col("a").alias("h")).agg(F.count(F.lit(1)).alias("links"), F.max(order("firstb", "b") < order("firsta", "a")).alias("late"), F.min("firsta").alias("_first"))
    decided = repeated.join(near, "h", "full").select("h", F.coalesce("first", "_first").alias("first"), F.coalesce("late", F.lit(False)).alias("late"), F.coalesce("links", F.lit(0)).alias("links"))
    decided = C.materialise(decided, "decided")
    if _few(decided, most):
        return held.join(F.broadcast(decided), "h", "left")
    return C.lookup(held.withColumn("_spread", C.spread_of(F.col("doc_id"), F.lit(2))), ["h"], decided, "_spread")


def _report(docs: DataFrame, met: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = F.split(text, "\n")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("row"),
        F.when(text == "", 0).otherwise(F.size(cut)).cast("long").alias("n_lines"),
        ((text != "") & F.array_contains(cut, "")).cast("long").alias("_empty"),
    )
    stays = F.col("late").isNull() | (F.col("first").eqNullSafe(F.col("doc_id")) & ~F.col("late"))
    # equal rows of one doc_id count once
    once = lambda n: F.floor(F.sum(n) / F.sum(F.col("lead").cast("long"))).cast("long")
    per = met.groupBy("doc_id", "row").agg(once(stays.cast("long")).alias("_stay"), once(F.coalesce("links", F.lit(0))).alias("n_links"))
    per = per.select(F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_dn"), "row", "_stay", "n_links")
    rows = rows.withColumns({"_d": F.coalesce("doc_id", F.lit(0)), "_dn": F.col("doc_id").isNull()})
    out = rows.join(per, ["_d", "_dn", "row"], "left")
    return out.select("doc_id", "n_lines", (F.col("_empty") + F.coalesce("_stay", F.lit(0))).cast("long").alias("n_kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def dedup_lines(docs: DataFrame, errors: int = ERRORS, shortest: int = SHORTEST) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; every other column and row as it was.

    Null texts stay null; a text whose lines all go is empty. Repeated rows of one doc_id count as one document. An
    empty table gives an empty one.
    """
    d, dn, row, gone_ = C.fresh(docs, "_d", "_dn", "_row", "_gone")
    key = F.coalesce(F.col("text").cast("string"), F.lit(""))
    met = decisions(docs, errors, shortest).where(F.col("late").isNotNull())
    gone = met.where(~F.col("first").eqNullSafe(F.col("doc_id")) | F.col("late"))
    gone = gone.groupBy(F.coalesce("doc_id", F.lit(0)).alias(d), F.col("doc_id").isNull().alias(dn), F.col("row").alias(row)).agg(F.collect_set("h").alias(gone_))
    rows = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), dn: F.col("doc_id").isNull(), row: F.xxhash64(key)})
    kept = F.filter(
        F.split("text", "\n"),
        lambda x, i: (F.array_position(F.split("text", "\n"), x) == i + 1) & ~F.coalesce(F.array_contains(gone_, F.xxhash64(x)) & (x != ""), F.lit(False)),
    )
    out = rows.join(gone, [d, dn, row], "left").withColumn("text", F.array_join(kept, "\n"))
    return out.select(*C.named(docs))
