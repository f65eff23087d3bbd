"""Input checks, the promotion gate and the append-only registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyrisk.functions.scalars import null_or_nan

# Accepted positive rate, promotion floor and tolerated loss against the champion.
RATE_LOW, RATE_HIGH = 0.0005, 0.05
PR_AUC_FLOOR = 0.75
CHAMPION_TOLERANCE = 0.005

REGISTRY_SCHEMA = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("model", T.StringType()),
    T.StructField("strategy", T.StringType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("val_pr_auc", T.DoubleType()), T.StructField("test_pr_auc", T.DoubleType()),
    T.StructField("metric_label", T.StringType()), T.StructField("is_default", T.BooleanType()),
    T.StructField("created_at", T.TimestampType())])
# Which version is the default follows from the versions there are, so it is not stored.
_STORED = T.StructType([f for f in REGISTRY_SCHEMA.fields if f.name != "is_default"])


class ValidationError(RuntimeError):
    """The table failed a check; the message lists every problem."""


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in required if c not in present]


def label_domain(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Label values outside {0, 1}; an empty result means the target is binary."""
    return df.select(*by, F.col(label).alias("label")).distinct().filter(
        F.col("label").isNull() | ~F.col("label").isin(0, 1))


def validate_table(df: DataFrame, features: Sequence[str], label: str = "label", amount: str | None = None) -> DataFrame:
    """Rows (check, value, ok) from one aggregation pass."""
    missing = missing_columns(df, [*features, label])
    present = [c for c in features if c in df.columns]
    zero = F.lit(0.0)
    nulls = sum((F.count_if(null_or_nan(c)) for c in present), F.lit(0)).cast("double")
    if label in df.columns:
        odd = F.count_if(F.col(label).isNull() | ~F.col(label).isin(0, 1)).cast("double")
        rate = F.avg(F.col(label)).cast("double")
    else:
        odd, rate = zero, F.lit(None).cast("double")
    negative = F.count_if(F.col(amount) < 0).cast("double") if amount in df.columns else zero
    row = df.agg(F.count(F.lit(1)).alias("rows"), nulls.alias("nulls"), odd.alias("odd"), rate.alias("rate"),
                 negative.alias("negative"))
    in_band = F.coalesce(F.col("rate").between(RATE_LOW, RATE_HIGH), F.lit(False))
    checks = [("missing_columns", F.lit(float(len(missing))), F.lit(not missing)),
              ("null_features", F.col("nulls"), F.col("nulls") == 0),
              ("binary_target", F.col("odd"), F.col("odd") == 0),
              ("positive_rate", F.round("rate", 6), in_band),
              ("negative_amounts", F.col("negative"), F.col("negative") == 0)]
    packed = F.array(*[F.struct(F.lit(n).alias("check"), v.alias("value"), ok.alias("ok")) for n, v, ok in checks])
    return row.select(F.explode(packed).alias("c")).select("c.*")


def require_valid(report: DataFrame) -> DataFrame:
    """Raise with every failed check, else return the report."""
    failed = report.filter(~F.col("ok")).collect()
    if failed:
        raise ValidationError("validation failed: " + "; ".join(f"{r['check']} = {r['value']}" for r in failed))
    return report


def champion(registry: DataFrame) -> DataFrame:
    """One row: the newest version's test PR-AUC, 0.0 when nothing is registered."""
    newest = F.max_by("test_pr_auc", F.struct("created_at", "version"))
    return registry.agg(F.coalesce(newest, F.lit(0.0)).alias("champion_pr_auc"))


def gate_expr(pr_auc: Column, best: Column, floor: float = PR_AUC_FLOOR) -> Column:
    return (pr_auc >= F.lit(floor)) & (pr_auc >= best - F.lit(CHAMPION_TOLERANCE))


def promotion_gate(registry: DataFrame, test_pr_auc: float, floor: float = PR_AUC_FLOOR) -> DataFrame:
    measured = F.lit(float(test_pr_auc))
    return champion(registry).select(
        measured.alias("test_pr_auc"), "champion_pr_auc",
        gate_expr(measured, F.col("champion_pr_auc"), floor).alias("passed"))


def next_version(registry: DataFrame, candidate: DataFrame) -> DataFrame:
    """The candidate row(s) with the version after the registry's newest, marked default.

    Candidates carry model, strategy, threshold, val_pr_auc, test_pr_auc and created_at.
    """
    newest = registry.agg(F.coalesce(F.max("version"), F.lit(0)).alias("newest")).first()["newest"]
    return _numbered(candidate, newest).withColumn("is_default", F.lit(True)).select(*REGISTRY_SCHEMA.names)


def _numbered(candidate: DataFrame, newest: int) -> DataFrame:
    from tallyrisk.functions.scalars import encode_label_text

    order = Window.orderBy("created_at", "model", "strategy")  # a registry entry or a few, never table rows
    return candidate.select(
        (F.lit(newest) + F.row_number().over(order)).cast("long").alias("version"), "model", "strategy", "threshold",
        "val_pr_auc", "test_pr_auc", encode_label_text(F.col("test_pr_auc")).alias("metric_label"), "created_at")


def read_registry(spark, path: str) -> DataFrame:
    """Registered versions; an absent registry reads as empty."""
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.schema(_STORED).option("recursiveFileLookup", "true").parquet(path)
        newest = stored.agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    return stored.withColumn("is_default", F.col("version") == newest).select(*REGISTRY_SCHEMA.names)


def _claimed(spark, path: str, version: int) -> bool:
    """Create the version's claim; False if another writer has it."""
    from py4j.protocol import Py4JJavaError

    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_claims/{version}")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target.getParent())
    try:
        if system.getScheme() == "file":  # whose Hadoop class looks first and creates then
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(target.toUri().getPath()).toPath(), spark._sc._gateway.new_array(
                jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            system.create(target, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _newest_claim(spark, path: str) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_claims")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return 0
    names = [status.getPath().getName() for status in system.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def claim_versions(spark, path: str, count: int) -> int:
    """Take `count` versions in a row that no other writer has or will get; returns the one before them.

    A claim is a file created only if absent, so of two writers that want a version one loses and goes on from the newest claim. A
    writer that lost in the middle, or ended before its entry was written, leaves versions that never have an entry.
    """
    before = _newest_claim(spark, path)
    taken = 0
    while taken < count:
        if _claimed(spark, path, before + taken + 1):
            taken += 1
        else:
            before, taken = max(_newest_claim(spark, path), before + taken + 1), 0
    return before


def registry_append(path: str, candidate: DataFrame) -> DataFrame:
    """Append the candidate row(s), each a version, and return the registry, newest version as the default.

    Several writers may append at once: each claims its versions first. Entries of a registry without claims count as claimed.
    """
    spark = candidate.sparkSession
    stored = read_registry(spark, path).agg(F.coalesce(F.max("version"), F.lit(0)).alias("newest")).first()["newest"]
    if stored > _newest_claim(spark, path):
        _claimed(spark, path, stored)
    newest = claim_versions(spark, path, candidate.count())
    # A folder of its own: two appends to one folder would clear each other's unfinished files.
    _numbered(candidate, newest).write.mode("errorifexists").parquet(f"{path}/first_version={newest + 1}")
    return read_registry(spark, path)
