"""Session settings the operators rely on."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

# Shuffle sizing: bytes a partition should hold, growth of packed files in a shuffle, and the most
# partitions a driver should track. AQE merges what turns out smaller.
PARTITION_BYTES = 256 << 20
SHUFFLE_GROWTH = 2
MAX_PARTITIONS = 40_000

_BYTES: dict[str, int] = {}

RUNTIME_SETTINGS = {
    # ISO stamps carry a literal Z, and the driver tables hold zone-less UTC times.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession, path: str | None = None, most_partitions: int = MAX_PARTITIONS) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built, sized for the data at `path`.

    `most_partitions` bounds the shuffle partitions; beyond PARTITION_BYTES x most_partitions of data they grow instead.
    """
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if path is not None:
        needed = partitions_for(path_bytes(spark, path), most_partitions)
        if needed > int(spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set("spark.sql.shuffle.partitions", str(needed))
    return spark


def partitions_for(size: int, most: int = MAX_PARTITIONS) -> int:
    """Shuffle partitions for a whole-table exchange of `size` stored bytes."""
    return min(most, max(1, math.ceil(size * SHUFFLE_GROWTH / PARTITION_BYTES)))


def path_bytes(spark: SparkSession, path: str) -> int:
    """Stored bytes under a path, asked once from its file system."""
    if path not in _BYTES:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        _BYTES[path] = files.getContentSummary(target).getLength()
    return _BYTES[path]


def build_session(app: str = "tallyrisk", master: str | None = None, **settings: str) -> SparkSession:
    """Build a session; `settings` override anything set here (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (builder.config("spark.ui.enabled", "false")
                       .config("spark.driver.host", "127.0.0.1")
                       .config("spark.ui.showConsoleProgress", "false"))
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
