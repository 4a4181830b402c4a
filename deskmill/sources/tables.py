"""Sources and sinks: Parquet tables, contract-checked CSV, JSON reports, checksums."""

from __future__ import annotations

import os
import shutil
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The ticket CSV's columns, in order.
TICKET_COLUMNS = ("subject", "body", "answer", "type", "queue", "priority", "language", "version", "tag_1", "tag_2", "tag_3", "tag_4", "tag_5", "tag_6", "tag_7", "tag_8")
TICKET_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in TICKET_COLUMNS])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as tickets: subject is the first line, body the rest, queue the source, priority from the label codes."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    at = F.instr("text", "\n")
    code = F.when(F.col("quality") == 0, "high").when(F.col("toxic") == 1, "medium").when(F.col("quality") == 1, "low")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.when(at > 0, F.substring_index("text", "\n", 1)).otherwise(F.col("text")).alias("subject"), F.when(at > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("").alias("body"),
        F.col("lang").alias("language"), F.col("source").alias("queue"), code.alias("priority"),
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType = TICKET_SCHEMA) -> DataFrame:
    """All columns as text; quoted fields may hold newlines. Missing, extra and reordered columns are errors."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    check_columns(header, tuple(schema.fieldNames()))
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def check_columns(found: list[str], wanted: tuple[str, ...]) -> None:
    if missing := [c for c in wanted if c not in found]:
        raise ValueError(f"missing columns: {missing}")
    if extra := [c for c in found if c not in wanted]:
        raise ValueError(f"unexpected columns: {extra}")
    if list(found) != list(wanted):
        raise ValueError("columns are not in the contract's order")


def download(url: str, path: str) -> None:
    """One GET into a local file, a minute at most between bytes."""
    with urllib.request.urlopen(url, timeout=60) as source, open(path, "wb") as out:  # noqa: S310  the caller names the address
        shutil.copyfileobj(source, out)


def acquire(spark: SparkSession, path: str, out: str, sha256: str | None = None, minimum_rows: int = 1, url: str | None = None, overwrite: bool = False, get: Callable[[str, str], None] = download) -> DataFrame:
    """A CSV, its checksum and contract checked; its English rows written as CSV. With ``url`` a file that is not there yet, or that is to
    be overwritten, is fetched first by ``get``."""
    from deskmill.operators.profile import require

    if url and (overwrite or not os.path.exists(path)):
        get(url, path)
    if sha256:
        check_sha256(spark, path, sha256)
    frame = require(read_csv(spark, path), minimum_rows=minimum_rows)
    english = require(frame.filter("language = 'en'"), minimum_rows=minimum_rows, english_only=True)
    write_csv(english, out)
    return english


def check_sha256(spark: SparkSession, path: str, expected: str) -> None:
    """``sha256`` of one file of any size, streamed by the driver's JVM."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        found = jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()
    if found != expected.lower():
        raise ValueError(f"sha256 is {found}, not {expected}")


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Prepared rows that meet their contract."""
    from deskmill.operators import contracts

    df = spark.read.parquet(path)
    contracts.check_prepared_columns(df.columns, ("doc_id", "group_id", "split", "classifier_text", "queue"))
    contracts.require(contracts.prepared_violations(df))
    return df


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label CSV: all columns as text but the rank, in the contract's order."""
    from deskmill.operators import gold

    options = {"header": True, "multiLine": True, "escape": '"'}
    gold.check_columns(spark.read.options(**options).csv(path).columns)
    return spark.read.options(**options).schema(", ".join(f"{c} {'int' if c == 'candidate_rank' else 'string'}" for c in gold.LABEL_COLUMNS)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object with fields in alphabetical order, from a one-row frame."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false", "pretty": "true"})).coalesce(1).write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.json(path, multiLine=True)
    if df.columns == ["_corrupt_record"]:
        raise ValueError(f"{path} holds no JSON object")
    return df
