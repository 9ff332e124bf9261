"""Chat formatting of logged conversations after cumulative-snapshot collapse.

A log that records a conversation after every turn holds it many times, each
snapshot a prefix of the next.  A rolling hash over the turns gives every prefix
of every conversation a key; a conversation whose own key is a proper prefix of
a longer one, or equals that of a conversation with a smaller id, is dropped by
an anti-join.  What is left, the maximal conversations, is rendered.

* The rolling hash of the first k turns is the sum of 128-bit hashes of (position,
  role, text), kept in four 32-bit lanes, so it is a running sum.  Running sums
  go by chunks of turn numbers: inside a chunk, then over the chunks' totals, so
  one endless conversation is spread over many tasks.
* Prefix keys are grouped before the anti-join: a first turn that a third of all
  conversations share is one row on either side.

Rows: rows without a conv_id belong to no conversation and are left out; a null
role is ``unknown``, a null text empty; a null turn comes first; turns with the
same number go by their hash; exact repetitions of a row count once; extra
columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored

#: Turn numbers of a chunk.
CHUNK = 1024
LANES = 4


def segment(role: Column, text: Column) -> Column:
    """The rendered form of one turn."""
    return F.concat(F.lit("<"), role, F.lit(">\n"), text, F.lit("\n"))


def turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with their content hash: conv_id, turn, role, text, h."""
    role, text = F.coalesce(F.col("role"), F.lit("unknown")), F.coalesce(F.col("text"), F.lit(""))
    return (conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
            .withColumn("h", F.md5(F.concat_ws("\x1f", "role", "text"))).dropDuplicates(["conv_id", "turn", "h"]))


def _running(df: DataFrame, values: list[str]) -> DataFrame:
    """Add the inclusive running sum <v>_run and the total <v>_all of every value over a conversation's turns."""
    totals = df.groupBy("conv_id", "chunk").agg(*[F.sum(v).alias(f"{v}_sum") for v in values])
    over = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv_id")
    offsets = totals.select("conv_id", "chunk", *[(F.sum(f"{v}_sum").over(over) - F.col(f"{v}_sum")).alias(f"{v}_off") for v in values],
                            *[F.sum(f"{v}_sum").over(whole).alias(f"{v}_all") for v in values])
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.select("*", *[F.sum(v).over(inside).alias(f"{v}_in") for v in values])
    out = local.join(offsets, ["conv_id", "chunk"])
    return out.select(*df.columns, *[(F.col(f"{v}_in") + F.col(f"{v}_off")).alias(f"{v}_run") for v in values], *[f"{v}_all" for v in values])


def prefixes(conversations: DataFrame) -> DataFrame:
    """Every turn's position, its conversation's length and the rolling hash up to it: conv_id, turn, h, pos, n_turns, k0..k3."""
    # a null turn sorts first and has a chunk of its own before all others
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 60)))
    thin = turns(conversations).select("conv_id", "turn", "h", chunk.alias("chunk"), F.lit(1).cast("long").alias("one"))
    placed = _running(thin, ["one"])
    mixed = F.md5(F.concat_ws("\x1f", F.col("one_run").cast("string"), "h"))
    lanes = [F.conv(F.substring(mixed, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"l{i}") for i in range(LANES)]
    placed = placed.select("conv_id", "turn", "h", "chunk", F.col("one_run").alias("pos"), F.col("one_all").alias("n_turns"), *lanes)
    rolled = _running(placed, [f"l{i}" for i in range(LANES)])
    return rolled.select("conv_id", "turn", "h", "pos", "n_turns", *[F.col(f"l{i}_run").alias(f"k{i}") for i in range(LANES)])


def maximal(prefix: DataFrame) -> DataFrame:
    """The conversations that prefix no other: conv_id (smallest of its equals), n_turns, n_copies."""
    keys = [f"k{i}" for i in range(LANES)]
    whole = prefix.where("pos = n_turns").groupBy("n_turns", *keys).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    shorter = prefix.where("pos < n_turns").select(F.col("pos").alias("n_turns"), *keys).distinct()
    return whole.join(shorter, ["n_turns", *keys], "left_anti").select("conv_id", "n_turns", "n_copies")


def rendered(conversations: DataFrame) -> DataFrame:
    """The maximal conversations, rendered turn by turn: conv_id, n_turns, n_copies, pos, segment."""
    prefix = stored(prefixes(conversations), "prefixes")
    kept = maximal(prefix)
    places = prefix.join(kept.select("conv_id", "n_copies"), "conv_id").select("conv_id", "turn", "h", "pos", "n_turns", "n_copies")
    text = turns(conversations).select("conv_id", "turn", "h", segment(F.col("role"), F.col("text")).alias("segment"))
    same = [text["conv_id"] == places["conv_id"], text["h"] == places["h"], text["turn"].eqNullSafe(places["turn"])]
    return places.join(text, same).select(places["conv_id"], "n_turns", "n_copies", "pos", "segment")


def texts(conversations: DataFrame) -> DataFrame:
    """One training text per maximal conversation: conv_id, n_turns, n_copies, text.

    A text is one value, so its conversation must fit in memory; ``rendered``
    has no such limit.
    """
    return (rendered(conversations).groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("pos", "segment"))).alias("s"))
            .select("conv_id", "n_turns", "n_copies", F.array_join(F.col("s.segment"), "").alias("text")))


def digest(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation, without assembling its text: conv_id, n_turns, n_copies, n_chars, text_sum."""
    part = F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.col("pos").cast("string"), "segment")), 1, 8), 16, 10).cast("long")
    return rendered(conversations).groupBy("conv_id", "n_turns", "n_copies").agg(
        F.sum(F.char_length("segment")).cast("long").alias("n_chars"), F.sum(part).alias("text_sum"))
