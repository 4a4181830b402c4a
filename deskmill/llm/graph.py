"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

Each step is a group-by with a partial minimum and a join, so a vertex with very many neighbours is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.llm.store import cut, drop


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if large:  # larger neighbours hang on the least one
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    out = both.join(least, "u")  # u > v: smaller neighbours and u itself hang on the least one
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) pairs to (id, component), component the least id reachable; ids without an edge are not in the result."""
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        after = cut(_stars(_stars(now, True), False), "edges")
        row = after.agg(F.count("*"), F.sum(F.crc32(F.concat_ws(",", "u", "v").cast("binary")))).first()
        drop(now)
        now = after
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
