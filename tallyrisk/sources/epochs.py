"""Several tables that grow together: one published file an epoch makes its rows visible in all of them at once.

An epoch's rows are written first, each table's under a folder of this attempt. Then one small file under `epochs`, made in full
under a hidden name and renamed only if the epoch has none, names the attempt. Readers take the attempts that such files name, so a
writer that stops between two tables shows neither, and a repeated epoch changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyrisk.sources.sinks import triggered

_EPOCHS = "epoch long, attempt string"


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def is_published(spark: SparkSession, root: str, epoch: int) -> bool:
    path, system = _path(spark, f"{root}/epochs/{epoch}.json")
    return bool(system.exists(path))


def _publish(spark: SparkSession, root: str, epoch: int, attempt: str) -> bool:
    """Name the epoch's attempt; False if another one has been named."""
    from py4j.protocol import Py4JJavaError

    jvm = spark._jvm
    hidden, system = _path(spark, f"{root}/epochs/.{epoch}.{attempt}")
    target, _ = _path(spark, f"{root}/epochs/{epoch}.json")
    stream = system.create(hidden, False)
    try:
        stream.write(json.dumps({"epoch": epoch, "attempt": attempt}).encode())
    finally:
        stream.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    never_replace = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(files.makeQualified(hidden), files.makeQualified(target), never_replace)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        system.delete(hidden, False)
        return False
    return True


def commit_epoch(spark: SparkSession, root: str, epoch: int, tables: Mapping[str, DataFrame]) -> bool:
    """Append the epoch's rows to all tables at once; False, without a change, if the epoch is there already."""
    if "epochs" in tables:
        raise ValueError("`epochs` is the folder of published epochs and no table's name")
    if is_published(spark, root, epoch):
        return False
    attempt = f"a{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.mode("errorifexists").parquet(f"{root}/{name}/attempt={attempt}")
    return _publish(spark, root, epoch, attempt)


def read_tables(spark: SparkSession, root: str, schemas: Mapping[str, T.StructType | str], upto: int | None = None) -> dict[str, DataFrame]:
    """Every table's published rows, all tables as of the same epoch: the newest, or `upto`. Without an epoch they are empty."""
    types = {n: T.StructType.fromDDL(s) if isinstance(s, str) else s for n, s in schemas.items()}
    folder, system = _path(spark, f"{root}/epochs")
    if not system.exists(folder):
        return {n: spark.createDataFrame([], s) for n, s in types.items()}
    known = spark.read.schema(_EPOCHS).json(f"{root}/epochs")
    newest = known.agg(F.max("epoch")).first()[0] if upto is None else upto
    if newest is None:
        return {n: spark.createDataFrame([], s) for n, s in types.items()}
    attempts = known.filter(F.col("epoch") <= newest).select("attempt")
    stored = {n: spark.read.schema(T.StructType([*s, T.StructField("attempt", T.StringType())])).parquet(f"{root}/{n}")
              for n, s in types.items()}
    return {n: df.join(attempts, "attempt", "left_semi").drop("attempt") for n, df in stored.items()}


def sink_append_tables(stream: DataFrame, root: str, checkpoint: str, tables: Callable[[DataFrame], Mapping[str, DataFrame]],
                       every: str | None = None) -> StreamingQuery:
    """Append what `tables` makes of each batch as one epoch; a batch that Spark runs again after a stop is not added twice."""

    def write(batch: DataFrame, epoch: int) -> None:
        if is_published(batch.sparkSession, root, epoch):
            return
        held = batch.persist()
        try:
            commit_epoch(batch.sparkSession, root, epoch, tables(held))
        finally:
            held.unpersist()

    return triggered(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), every).start()
