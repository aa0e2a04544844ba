"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and queued; a document's virtual finish time is the source's words up to
and including it, divided by the source's target. The queue of a source may be run through ``EPOCHS`` times. All
copies are range-sorted by finish time, and the mix ends where the budget is spent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
SHARE, EPOCHS = 1.5, 2
#: Blocks of 64 row numbers that may be sent to every executor (some 50 bytes each), so that no text moves; beyond, tables are joined.
BROADCAST_ROWS = 500_000
_SPACE = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; null has none."""
    solid = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.regexp_replace(solid, _SPACE, "")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Add weight and target to ``sizes`` (source, source_size): ``share`` of all sizes by weight, no target above ``epochs`` times its source's size.

    Sources by code point take the weights in turn, null last. Capped sources leave the sharing until none is above;
    each round is one small aggregate over the sources, and only its two sums reach the driver. Null is a source like
    any other; a source without words has target zero; an empty table gives an empty one.
    """
    placed = sizes.withColumn("_null", F.col("source").isNull().cast("int"))
    placed = C.global_order(placed, ["_null", "source"])
    turn = F.pmod("_rank", F.lit(len(weights))).cast("int")
    table = placed.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1)).drop("_null", "_rank")
    table = C.materialise(table.withColumn("_cap", F.col("source_size") * F.lit(float(epochs))), "sources")
    budget = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = F.col("_cap") <= F.col("weight") * F.lit(level)
        taken, open_weight = table.agg(F.sum(F.when(capped, F.col("_cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not open_weight:
            break
        higher = (budget - (taken or 0.0)) / open_weight
        if higher <= level:
            break
        level = higher
    return table.withColumn("target", F.least("_cap", F.col("weight") * F.lit(level))).drop("_cap")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, *keep) for each row of ``docs`` (doc_id, text, source).

    copies is how often the mix takes the document, 0 to ``epochs``; taken is copies times size. Null is a source of
    its own. Documents without words take nothing and are taken once, as they cost nothing. Repeated rows are
    documents of their own. An empty table gives an empty one.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text).alias("_key"), *keep)
    rows = C.materialise(rows, "sizes")
    sizes = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    sizes = C.materialise(sizes, "targets")

    queued = C.global_order(rows, ["source", "_key", "doc_id"], "size")
    # the sum before a source is that before its first document
    begin = queued.groupBy("source").agg(F.min("_before").alias("_begin"))
    table = sizes.join(begin, sizes.source.eqNullSafe(begin.source)).select(F.coalesce(sizes.source, F.lit("")).alias("_s"), sizes.source.isNull().alias("_n"), "source_size", "target", "_begin")
    queued = queued.withColumns({"_s": F.coalesce("source", F.lit("")), "_n": F.col("source").isNull(), "_spread": C.spread_of(F.col("_key"))})
    queued = C.lookup(queued, ["_s", "_n"], table, "_spread")
    finish = lambda e: F.when(F.col("target") > 0, (F.col("_before") - F.col("_begin") + F.col("size") + F.col("source_size") * F.lit(e)) / F.col("target")).otherwise(0.0)
    queued = C.materialise(queued.withColumn("_finish", F.array(*(finish(e) for e in range(epochs)))), "queued")

    copies = queued.where("size > 0").select("size", "_key", "doc_id", F.explode("_finish").alias("_time"))
    served = C.global_order(copies, ["_time", "_key", "doc_id"], "size")
    budget = sizes.agg(F.sum("target")).first()[0] or 0.0
    # the first copy that the budget doesn't cover by half or more ends the mix
    end = served.where(F.col("_before") + F.col("size") / 2 > F.lit(budget)).agg(F.min(F.struct("_time", "_key", "doc_id")).alias("x")).first()["x"]
    if end is None:
        inside = lambda t: F.lit(True)
    else:
        stop = F.struct(F.lit(end["_time"]).alias("t"), F.lit(end["_key"]).alias("k"), F.lit(end["doc_id"]).cast("long").alias("d"))
        inside = lambda t: F.struct(t.alias("t"), F.col("_key").alias("k"), F.col("doc_id").alias("d")) < stop
    taken = F.size(F.filter("_finish", inside))
    out = queued.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(1).cast("int"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), *keep)


def _marked(taken: DataFrame, row: str, times: str, block: str, bits: Sequence[str]) -> DataFrame:
    """``taken`` (row, times) by blocks of 64 neighbouring row numbers: for each epoch a column of ``bits``, whose bit k says whether row k is taken once more."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(row).bitwiseAND(F.lit(63)).cast("int"))
    return taken.groupBy(F.shiftright(row, 6).alias(block)).agg(*(F.bit_or(F.when(F.col(times) > e, bit).otherwise(F.lit(0).cast("long"))).alias(b) for e, b in enumerate(bits)))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it, with all its columns, whatever their names.

    Row numbers are written once, so the narrow rows of the mix find their documents again: as bits, 64 rows a
    block, which every executor gets. Repeated rows, nulls and an empty table: as in :func:`mix`.
    """
    epochs = options.get("epochs", EPOCHS)
    row, block, copy, times, *bits = C.fresh(docs, "_row", "_block", "_copy", "_times", *(f"_times{e}" for e in range(epochs)))
    numbered = C.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered.select("doc_id", "text", "source", row), keep=(row,), **options).where("copies > 0")
    taken = C.materialise(taken.select(row, F.col("copies").alias(times)), "taken")
    blocks = C.materialise(_marked(taken, row, times, block, bits), "blocks")
    if blocks.count() <= BROADCAST_ROWS:
        met = numbered.withColumn(block, F.shiftright(row, 6)).join(F.broadcast(blocks), block)
        own = F.col(row).bitwiseAND(F.lit(63)).cast("int")
        found = met.withColumn(times, sum(F.call_function("shiftrightunsigned", F.col(b), own).bitwiseAND(F.lit(1)).cast("int") for b in bits)).where(F.col(times) > 0)
    else:
        found = numbered.join(taken, row)
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*C.named(docs))
