"""Chat formatting: cumulative snapshots collapse to the maximal conversation, then render. DataFrame functions only.

Logs often hold a conversation once per turn, each time with all turns before. Turn i of a conversation gets a rolling hash of turns
1 to i: running sums, over a window by turn, of four 32-bit parts of SHA-256 of (place, role, text). A conversation whose whole hash
is another one's prefix hash at the same place is a snapshot of it and leaves by an anti-join; of equal conversations the least id stays.

The prefix side is made distinct by a partial aggregate before the join, so a first turn that a third of all conversations share is one row.

Rows: a null role counts as '', a null text as ''. Rows without conv_id are left out; turns are ordered by (turn, role, text), null turns
first, and exact repeats of a row count once. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = ("h0", "h1", "h2", "h3")


def rolling(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), last, role, text, and the rolling hash of the turns up to this one in PARTS."""
    t = turns.filter("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = t.withColumn("place", F.row_number().over(by_turn))
    own = F.sha2(F.to_json(F.struct("place", "role", "text")), 256)
    upto = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("own", own)
    for k, name in enumerate(PARTS):
        t = t.withColumn(name, F.sum(F.conv(F.substring("own", 8 * k + 1, 8), 16, 10).cast("long")).over(upto))
    return t.withColumn("last", F.lead("place").over(by_turn).isNull()).drop("own", "turn")


def maximal(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, place, role, text) of conversations that no other one continues, each once."""
    t = rolling(turns)
    whole = t.filter("last").groupBy("place", *PARTS).agg(F.min("conv_id").alias("conv_id"))
    prefix = t.filter("not last").select("place", *PARTS).distinct()
    keep = whole.join(prefix, ["place", *PARTS], "left_anti").select("conv_id")
    return t.select("conv_id", "place", "role", "text").join(keep, "conv_id", "left_semi")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and the chat text of each maximal conversation."""
    kept = maximal(turns).select("conv_id", F.struct("place", rendered(F.col("role"), F.col("text")).alias("said")).alias("t"))
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["said"]), "").alias("chat"))
