"""The training-data pipeline: stages applied in order to `documents`, each on all that its predecessor kept.

Every stage but the last returns the columns of `documents`, the last adds how often a document is taken. Columns of any other
name pass through; a table of the same columns without rows gives one. What a stage does with NULL or empty texts, repeated rows
and ties is its operator's: an empty text scores as the classifier puts it, is a duplicate of nothing, matches no benchmark item
and holds no secret.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrisk.landing import land
from tallyrisk.llm import decontaminate, mixing, neardup, quality, secrets
from tallyrisk.llm.common import free_name, quoted, table, with_small_batches
from tallyrisk.session import prepare

# Classifiers, sketches and BM25 scores have no SQL; the tests compare stages and whole runs with plain versions.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of the documents at hand."""
    model = quality.fit(docs, table(with_small_batches(spark), sf_dir, "labels"))
    return docs.filter(quality.score_column(model, docs) >= F.lit(quality.REJECT_BELOW))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id. Equal rows (same id and text) are one document."""
    with_small_batches(spark)
    told = neardup.near_duplicates(docs)
    row_key = neardup.row_digest(docs["doc_id"], docs["text"])
    held = docs.select(F.struct(*map(quoted, docs.columns)).alias("held"), row_key.alias("row_key"))
    kept = held.join(told.filter("stays").select("row_key").distinct(), "row_key", "left_semi")
    once = Window.partitionBy("row_key").orderBy(F.lit(1))
    return kept.withColumn("copy", F.row_number().over(once)).filter("copy = 1").select("held.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is confirmed go."""
    return docs.filter(decontaminate.is_clean(docs, table(with_small_batches(spark), sf_dir, "benchmark")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts and `n_chars` is counted anew; no document goes."""
    return secrets.redacted(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of their copies in `copies` (with underscores behind it where there is one)."""
    taken = F.col(mixing.added_names(docs)[-1])
    return mixing.mixed(docs).filter(taken > 0).select(*map(quoted, docs.columns), taken.alias(free_name(docs.columns, "copies")))


STAGES = [("quality classifier", quality_classifier), ("MinHash near-dedup", near_duplicates),
          ("benchmark decontamination", benchmark_decontamination), ("secret scans", secret_scans),
          ("mixing sources to target weights", mixing_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on `documents`, each written and read again before the next."""
    path = sf_dir.rstrip("/")
    docs = table(prepare(spark), path, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, path)
        if at < len(STAGES) - 1:
            docs = land(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
