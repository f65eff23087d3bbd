"""Written tables in the cluster's shared folder: the way every job here cuts lineage.

A landed table survives the loss of any executor, is read back with column pruning and row-group
statistics, and fixes the outcome of a range partitioning, which Spark may sample differently each
time a plan is run.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`; a temporary one only where a local session has none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="tallyrisk-")
    return _LOCAL_ROOTS[context.applicationId]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used before."""
    return f"{shared_root(spark)}/tallyrisk/{label}-{uuid.uuid4().hex}"


# Row groups of tables whose readers aggregate: a task reads whole ones, and holds what it has met of their distinct values.
SMALL_GROUPS = 16 << 20


def land(df: DataFrame, label: str, partition_by: Sequence[str] = (), group_bytes: int | None = None) -> DataFrame:
    """Write `df` once and return the written table, in row groups of `group_bytes` (Parquet's own size by default)."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if group_bytes is not None:
        writer = writer.option("parquet.block.size", group_bytes)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def land_at(df: DataFrame, label: str) -> tuple[str, DataFrame]:
    """As `land`, with the path, for a table that its writer discards itself."""
    path = fresh_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete one written table; frames over it become unreadable."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables this application landed after the first `since`; frames over them become unreadable."""
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    doomed, written[since:] = written[since:], []
    for path in doomed:
        discard(spark, path)
    return len(doomed)
