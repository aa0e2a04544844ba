"""Preference formatting of conversations, in DataFrame functions alone.

For a chosen and a rejected conversation, the longest common prefix of turns is rendered once as the prompt; what is
left of each is its completion. Of a completion only assistant text is trained on: the mask lists the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSE = "<|end|>\n"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the conversation's turns (role, text) in order.

    Rows without conv_id belong to no conversation. Of rows that repeat a turn, the smallest by role and text stays;
    null turn numbers come first, null roles are user, null texts are empty. A conversation is one row by nature, so
    it is gathered whole.
    """
    own = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.struct(F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said")
    )
    own = own.groupBy("conv_id", "turn").agg(F.min("said").alias("said"))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("turn"), F.col("said").alias("said"))))
    return own.groupBy("conv_id").agg(F.transform(ordered, lambda x: x["said"]).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns the two arrays share from the start."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _open(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def render(said: Column) -> Column:
    return F.array_join(F.transform(said, lambda x: F.concat(_open(x["role"]), x["text"], F.lit(CLOSE))), "")


def mask(said: Column) -> Column:
    """Spans (start, end) in characters of the rendering that are trained on: assistant texts with their end marks."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(_open(x["role"]))
        end = begin + F.length(x["text"]) + len(CLOSE)
        own = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end")))
        return F.struct(end.cast("int").alias("at"), F.when(x["role"] == "assistant", F.concat(s["spans"], own)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(said, zero, add)["spans"]


def preferences(pairs: DataFrame) -> DataFrame:
    """(pair_id, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) of ``pairs`` (pair_id, chosen, rejected).

    chosen and rejected are arrays of (role, text); null counts as an empty conversation, a null role as user, a null
    text as empty. Two equal conversations
    have empty completions. Repeated rows come back as often as they came; further columns are ignored.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    plain = lambda c: F.transform(F.coalesce(c, none), lambda x: F.struct(F.coalesce(x["role"], F.lit("user")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))
    own = pairs.select("pair_id", plain("chosen").alias("c"), plain("rejected").alias("r")).withColumn("prefix_turns", common_prefix(F.col("c"), F.col("r")))
    rest = lambda x: F.slice(x, F.col("prefix_turns") + 1, F.greatest(F.size(x), F.lit(1)))
    cut = own.select("pair_id", "prefix_turns", F.slice("c", 1, F.col("prefix_turns")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select("pair_id", "prefix_turns", render(F.col("p")).alias("prompt"), render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"), mask(F.col("c")).alias("chosen_mask"), mask(F.col("r")).alias("rejected_mask"))


def shortened_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected) from plain conversations: the whole one is chosen; rejected breaks off early.

    Of its A assistant turns, number 1 + crc32(conv_id) mod A is cut to its first sentence and ends the rejected
    conversation. Conversations without assistant turns give no pair.
    """
    own = turns(conversations)
    places = F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull())
    own = own.withColumn("_places", places).where(F.size("_places") > 0)
    number = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")), F.size("_places")).cast("int")
    own = own.withColumn("_at", F.get("_places", number))
    said = F.get("turns", F.col("_at"))
    cut = F.array(F.struct(said["role"].alias("role"), F.regexp_extract(said["text"], "^[^.]*\\.?", 0).alias("text")))
    return own.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(F.slice("turns", 1, F.col("_at")), cut).alias("rejected"))
