"""Contracts and data-quality profiles. One pass of conditional sums where a check has no key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskmill.functions.text import preview, safe_rate
from deskmill.operators import quantiles

#: The contract's closed domains.
PRIORITIES = ("low", "medium", "high")
LANGUAGES = ("de", "en")
TYPES = ("Change", "Incident", "Problem", "Request")
REQUIRED = ("body", "type", "queue", "priority", "language", "version")
FEATURES, PROHIBITED = ("subject", "body"), ("answer", "queue", "priority", "type")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and rate per label; null labels are no group but count in the total."""
    total = df.agg(F.count("*").alias("total"))
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total"), 6).alias("rate"))


def null_counts(df: DataFrame) -> DataFrame:
    one = df.agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns))
    return one.unpivot([], list(df.columns), "column_name", "nulls")


def duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first of each distinct combination; null equals null."""
    return df.groupBy(*columns).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("extra_rows"), F.coalesce(F.sum((F.col("c") > 1).cast("long")), F.lit(0)).alias("repeated"))


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations): rows that fail each condition."""
    one = df.agg(*(F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0)).alias(k) for k, c in checks.items()))
    return one.unpivot([], list(checks), "check_name", "violations")


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def require(df: DataFrame, *, minimum_rows: int = 1, english_only: bool = False, queues: tuple[str, ...] | None = None) -> DataFrame:
    """The ticket contract, checked in one aggregate; raises on the first failure, in the contract's order. ``queues``: the closed domain of
    queues, where there is one."""
    checks = {"null_" + c: F.col(c).isNull() for c in REQUIRED}
    checks |= {"empty_text": blank(F.col("subject")) & blank(F.col("body")), "language": ~F.col("language").isin("en") if english_only else ~F.col("language").isin(*LANGUAGES), **({"queue": ~F.col("queue").isin(*queues)} if queues else {}), "priority": ~F.col("priority").isin(*PRIORITIES), "type": ~F.col("type").isin(*TYPES)}
    rows = df.count()
    if rows < max(1, minimum_rows):
        raise ValueError(f"{rows} rows, at least {max(1, minimum_rows)} are needed")
    for r in violations(df, checks).collect():
        if r["violations"]:
            raise ValueError(f"{r['check_name']}: {r['violations']} rows")
    return df


def contract_summary(df: DataFrame) -> dict:
    """Counts of a table that meets the contract: rows, labels, nulls, blank texts, repeated rows and texts."""
    from deskmill.operators.reports import nested

    counts = lambda c: nested(value_counts(df, c).withColumnRenamed("value", c), c)
    return {
        "rows": df.count(), **{c: counts(c) for c in ("language", "queue", "priority", "type")}, "nulls": nested(null_counts(df), "column_name"), "blank": nested(missing(df, ["subject", "body"]), "column_name"),
        "repeated_rows": nested(duplicates(df, df.columns)), "repeated_texts": nested(duplicates(df, ["subject", "body"])),
    }


def summary_text(summary: dict) -> str:
    """The summary as one line a field."""
    line = lambda v: ", ".join(f"{k}={line(x) if isinstance(x, dict) else x}" for k, x in v.items()) or "none"
    return "\n".join(f"{k}: {line(v) if isinstance(v, dict) else v}" for k, v in summary.items())


def check_features(columns: list[str]) -> None:
    """Only subject and body may be features."""
    if bad := [c for c in columns if c in PROHIBITED]:
        raise ValueError(f"not allowed as features: {bad}")
    if bad := [c for c in columns if c not in FEATURES]:
        raise ValueError(f"unknown features: {bad}")


def mentions(df: DataFrame) -> DataFrame:
    """df with flags: the row's own label occurs in its text."""
    hit = lambda text, label: F.coalesce(F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(label)), F.lit(False))
    flags = {f"{t}_{k}": hit(F.col(t), F.col(k)) for t in ("subject", "body") for k in ("queue", "priority")}
    df = df.withColumns(flags)
    return df.withColumns({"queue_any": F.col("subject_queue") | F.col("body_queue"), "priority_any": F.col("subject_priority") | F.col("body_priority")}).withColumn("any_label", F.col("queue_any") | F.col("priority_any"))


def mention_report(df: DataFrame) -> DataFrame:
    names = ["subject_queue", "subject_priority", "body_queue", "body_priority", "queue_any", "priority_any", "any_label"]
    one = mentions(df).agg(F.count("*").alias("total"), *(F.sum(F.col(c).cast("long")).alias(c) for c in names))
    return one.unpivot(["total"], names, "field", "n").select("field", "n", F.round(safe_rate(F.col("n"), F.col("total")), 6).alias("rate"))


def mention_examples(df: DataFrame, n: int = 5) -> DataFrame:
    return mentions(df).filter("any_label").orderBy("doc_id").limit(n).select("doc_id", "queue", preview(F.col("subject"), 180).alias("subject_preview"), "queue_any", "priority_any")


QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p98": 0.98, "p99": 0.99}


def describe(df: DataFrame, keys: list[str], column: str, names: tuple[str, ...], *, digits: int = 6) -> DataFrame:
    """keys, n and the named figures (min, max, mean, QUANTILES), exact with linear interpolation, rounded; null on no rows."""
    found = quantiles.describe(df, keys, column, {k: QUANTILES[k] for k in names if k in QUANTILES})
    return found.select(*keys, "n", *(F.round(k, digits).alias(k) for k in names))


def missing(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*(F.sum(blank(F.col(c)).cast("long")).alias(c) for c in columns))
    return one.unpivot([], columns, "column_name", "blank")
