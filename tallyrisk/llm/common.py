"""What the operators of this folder share: the query list, table access, labelled samples, small fits."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrisk.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# Texts handed to Python at once; with Spark's 10,000 a worker holds tens of MB of text several times over.
BATCH_ROWS = 1000


def with_small_batches(spark: SparkSession) -> SparkSession:
    """The session, with at most BATCH_ROWS rows in a batch for Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this folder; `sql` is left out where no SQL text can express the result."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            path = sf_dir.rstrip("/")
            return function(with_small_batches(prepare(spark, path)), path)

        run.__doc__, run.__name__ = function.__doc__, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo `modulus`; NULL for a NULL id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def is_held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Rows whose labels may not be learnt from; a row without an id is not one of them."""
    return F.coalesce(id_remainder(id_col, modulus) == remainder, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, held_out: Callable[[str], Column],
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text binary, label 0/1) of at most `rows` labelled documents, chosen by a hash of the id.

    Every labelled row has the same chance, so the classes keep their shares. An id that repeats in
    `labels` takes its largest label; one that repeats in `docs` gives one row, its largest text.
    Only ids are ordered; texts are met in a join with the at most `rows` ids, which is broadcast.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
             .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
             .filter(~held_out("id"))
             .groupBy("id").agg(F.max("label").alias("label")))
    chosen = known.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max(F.struct("text", "label")).alias("r")).select(
        "id", "r.text", "r.label")


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the intercept last) of a ridge logistic fit by Newton steps.

    With one class or no rows the weights are zero but for the intercept, the log-odds of the smoothed share.
    """
    n, k = x.shape
    mean = x.mean(0) if n else np.zeros(k)
    scale = (x.std(0) if n else np.ones(k)) + 1e-9
    weights = np.zeros(k + 1)
    share = (y.sum() + 0.5) / (n + 1.0)
    weights[-1] = np.log(share / (1 - share))
    if n == 0 or y.min() == y.max():
        return mean, scale, weights
    z = np.c_[(x - mean) / scale, np.ones(n)]
    ridge = np.diag(np.r_[np.full(k, l2), 1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / n + ridge, z.T @ (p - y) / n + ridge @ weights)
        weights = weights - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, weights


def logistic_score(x: np.ndarray, fit: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, weights = fit
    z = (x - mean) / scale @ weights[:-1] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def ship(spark: SparkSession, value):
    """Broadcast an object of this package by value, so that workers need not have the package installed."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shipped):
    """The object of a `ship`; opened once per worker process."""
    if not hasattr(shipped, "opened"):
        shipped.opened = pickle.loads(shipped.value)
    return shipped.opened


def quoted(name: str) -> str:
    """A column's name as Spark takes it literally, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def free_name(taken: list[str], wanted: str) -> str:
    """`wanted`, with underscores behind it until no column is called so in either case."""
    folded = {t.lower() for t in taken}
    while wanted.lower() in folded:
        wanted += "_"
    return wanted
