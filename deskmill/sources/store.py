"""Tables that cut lineage, in the folder the cluster shares.

``cut`` writes a DataFrame as Parquet under ``spark.checkpoint.dir`` and returns a scan of it, so a lost
executor costs a re-read, not a recomputation. The files go when the JVM ends, or with ``drop``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset (tests, local runs) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/deskmill-shared"
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/deskmill/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, name: str, by: str | None = None, **options: str | int) -> DataFrame:
    """``by``: a column whose values get folders of their own, so a filter on it reads those only. ``options``: the writer's."""
    path = new_path(df.sparkSession, name)
    made = df.write.options(**({"compression": "zstd"} | options))
    (made.partitionBy(by) if by else made).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*(f"`{c}`" for c in df.columns))
    out._deskmill_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._deskmill_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
