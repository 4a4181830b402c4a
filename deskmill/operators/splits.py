"""Leakage-safe splits: equal texts are one group, groups are stratified and dealt by a seeded hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskmill.functions.text import clean, fold_clean, join_clean, row_id, word_count_clean
from deskmill.sources.store import cut

SEED = 20261005
VALIDATION, TEST = 0.15, 0.15
DIGITS = 3  # of a hash, by which a stratum is counted


def prepare(tickets: DataFrame) -> DataFrame:
    """doc_id, ticket id, group id (fingerprint), text, lengths and labels."""
    t = tickets.select("*", clean(F.col("subject")).alias("_subject"), clean(F.col("body")).alias("_body"))  # cleaned once; the rest needs no pattern
    t = t.select("*", join_clean(F.col("_subject"), F.col("_body")).alias("classifier_text"), join_clean(F.col("_subject"), F.col("_body"), " ").alias("_line"))
    return t.select("doc_id", row_id(F.col("doc_id")).alias("ticket_row_id"), F.sha2(fold_clean(F.col("_line")), 256).alias("group_id"), "subject", "body", "classifier_text", "queue", "priority", F.length("classifier_text").cast("long").alias("char_length"), word_count_clean(F.col("_line")).alias("word_count"))


def group_labels(prepared: DataFrame) -> DataFrame:
    """Per group: size, and the most frequent queue and priority, the least on a tie."""
    return prepared.groupBy("group_id").agg(F.count("*").alias("size"), F.mode("queue", True).alias("queue"), F.mode("priority", True).alias("priority"))


def strata(groups: DataFrame, least: int = 3) -> DataFrame:
    """Groups with a stratum: queue and priority if every such stratum has ``least`` groups, else queue, else one stratum."""
    both = F.concat_ws(" | ", "queue", F.coalesce("priority", F.lit("none")))
    fine = groups.groupBy(both.alias("s")).count().agg(F.min("count").alias("fine"))
    coarse = groups.groupBy("queue").count().agg(F.min("count").alias("coarse"))
    one = F.broadcast(fine.crossJoin(coarse))  # one row
    return groups.crossJoin(one).select("group_id", "size", "queue", "priority", F.when(F.col("fine") >= least, both).when(F.col("coarse") >= least, F.col("queue")).otherwise("all").alias("stratum"))


def deal(groups: DataFrame, seed: int = SEED) -> DataFrame:
    """group_id, stratum, split. Train first, then validation, then test, in the order of sha256('seed:group').

    Groups are counted by the first digits of their hash; sums over those counts say where each split ends. Only the groups of the (at most
    two) counts of a stratum that a split ends in are ordered, so no stratum is sorted in one task.
    """
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), "group_id"), 256)
    g = cut(groups.select("group_id", "stratum", order.alias("o"), F.substring(order, 1, DIGITS).alias("digits")), "group-order")
    each = Window.partitionBy("stratum")
    sizes = g.groupBy("stratum", "digits").agg(F.count("*").alias("n"))  # at most 16 ** DIGITS rows a stratum
    sizes = sizes.withColumns({"m": F.sum("n").over(each), "before": F.coalesce(F.sum("n").over(each.orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    share = lambda f: F.greatest(F.lit(1), F.bround(F.col("m") * f, 0).cast("int"))
    test = F.when(F.col("m") >= 3, share(TEST)).otherwise(0)
    validation = F.when(F.col("m") >= 3, share(VALIDATION)).when(F.col("m") == 2, 1).otherwise(0)
    sizes = sizes.select("stratum", "digits", "n", "before", (F.col("m") - test - validation).alias("train"), (F.col("m") - test).alias("seen"))
    placed = g.join(sizes, ["stratum", "digits"])
    ends_inside = lambda c: (F.col("before") < F.col(c)) & (F.col(c) < F.col("before") + F.col("n"))
    divided = ends_inside("train") | ends_inside("seen")
    k = F.row_number().over(Window.partitionBy("stratum", "digits").orderBy("o", "group_id"))
    both = placed.filter(~divided).withColumn("k", F.lit(1)).unionByName(placed.filter(divided).withColumn("k", k))
    place = F.col("before") + F.col("k")
    return both.select("group_id", "stratum", F.when(place <= F.col("train"), "train").when(place <= F.col("seen"), "validation").otherwise("test").alias("split"))


def manifest(tickets: DataFrame) -> DataFrame:
    p = cut(prepare(tickets), "prepared")  # texts are derived once
    groups = cut(group_labels(p), "text-groups")
    return p.join(deal(strata(groups)), "group_id").select("doc_id", "ticket_row_id", "group_id", "split", "stratum", "subject", "body", "classifier_text", "queue", "priority", "char_length", "word_count")


def check_fractions(train: float, validation: float, test: float) -> None:
    """Split shares are positive and sum to one."""
    if min(train, validation, test) <= 0:
        raise ValueError("split fractions must be positive")
    if abs(train + validation + test - 1.0) > 1e-9:
        raise ValueError("split fractions must sum to 1")


check_fractions(1 - VALIDATION - TEST, VALIDATION, TEST)
