"""Contracts of derived tables: prepared data, its alignment with the raw rows, retrieval corpora, aligned corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskmill.functions.text import SPLITS
from deskmill.operators.profile import blank, violations

#: Columns of prepared data.
PREPARED = ("ticket_row_id", "ticket_text_group_id", "split", "subject", "body", "classifier_text", "queue", "priority")


def check_prepared_columns(columns: list[str], wanted: tuple[str, ...] = PREPARED) -> None:
    if missing := [c for c in wanted if c not in columns]:
        raise ValueError(f"prepared data lacks columns: {missing}")


def prepared_violations(prepared: DataFrame) -> DataFrame:
    """(check_name, violations): unknown splits, blank texts, null labels, ids that occur twice, text groups in two splits."""
    rows = violations(prepared, {"split": ~F.coalesce("split", F.lit("")).isin(*SPLITS), "blank_text": blank(F.col("classifier_text")), "null_queue": F.col("queue").isNull()})
    count = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
    twice = prepared.groupBy("doc_id").count().filter("count > 1")
    spread = prepared.groupBy("group_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b")
    return reduce(DataFrame.unionByName, (rows, count(twice, "repeated_id"), count(spread, "divided_group")))


def alignment(raw: DataFrame, prepared: DataFrame, key: str = "doc_id") -> DataFrame:
    """(check_name, violations): rows of one side only, and rows whose subject or body differ."""
    a = raw.select(F.col(key).alias("a"), F.struct("subject", "body").alias("x"))
    b = prepared.select(F.col(key).alias("b"), F.struct("subject", "body").alias("y"))
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return violations(both, {"raw_only": F.col("b").isNull(), "prepared_only": F.col("a").isNull(), "differs": F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("x").eqNullSafe(F.col("y"))})


def corpus_violations(corpus: DataFrame) -> DataFrame:
    """(check_name, violations) of a retrieval corpus (split, text, answer): held-out rows, blank texts, blank answers."""
    return violations(corpus, {"held_out": ~F.col("split").eqNullSafe("train"), "blank_text": blank(F.col("text")), "blank_answer": blank(F.col("answer"))})


def aligned(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """(check_name, violations): ids that one of two corpora has more often than the other."""
    times = lambda df, n: df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias(n))
    both = times(a, "x").join(times(b, "y"), "k", "full_outer").fillna(0, ["x", "y"])
    return violations(both, {"first_only": F.col("x") > F.col("y"), "second_only": F.col("y") > F.col("x")})


def require(found: DataFrame) -> None:
    """Raises with every check that has violations."""
    if bad := [f"{r['check_name']}: {r['violations']}" for r in found.orderBy("check_name").collect() if r["violations"]]:  # a row per check
        raise ValueError("; ".join(bad))
