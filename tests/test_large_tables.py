"""What must not grow faster than the input: work a row, files, passes and what a task reads."""

from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyrisk.learn import anomaly as A
from tallyrisk.learn import clusters as CL
from tallyrisk.plans import registry
from tallyrisk.sources import topic_log as T_LOG


def test_raw_files_grow_with_the_table(spark, monkeypatch):
    from tallyrisk import session as S

    registry.load_all()
    monkeypatch.setattr(S, "PARTITION_BYTES", 1 << 14)
    before = set(_folders(spark))
    out = registry.QUERIES["scan_transactions"](spark, "/root/testdata/sf0.001")
    found = sorted(set(_folders(spark)) - before)
    assert out.count() == out.select("seq").distinct().count() > 0
    assert len(list(found[0].glob("*.parquet"))) > 3


def test_tasks_read_small_parts_of_the_transactions(spark):
    """A task of a score curve holds a cell for each distinct score of what it reads."""
    import pyarrow.parquet as pq

    from tallyrisk import landing

    registry.load_all()
    registry.QUERIES["flag_threshold"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes")) <= 32 << 20
    landing.land(spark.range(2_000_000, numPartitions=1).select(F.rand(1).alias("score")), "groups-test", group_bytes=2 << 20)
    file, = Path(spark.conf.get("spark.checkpoint.dir")).glob("tallyrisk/groups-test-*/*.parquet")
    held = pq.ParquetFile(file).metadata
    assert held.num_row_groups > 4 and sum(held.row_group(g).num_rows for g in range(held.num_row_groups)) == 2_000_000


def _folders(spark):
    return list(Path(spark.conf.get("spark.checkpoint.dir")).glob("tallyrisk/raw-*"))


def test_a_slice_reads_its_row_groups_only(spark, tmp_path, monkeypatch):
    rows = spark.range(50_000, numPartitions=1).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("value"))
    T_LOG.append_topic(rows, str(tmp_path / "topic"), 1)
    topic = T_LOG.Topic(str(tmp_path / "topic"))
    read, whole = [], T_LOG.pq.ParquetFile.iter_batches

    def counted(self, *args, **named):
        for batch in whole(self, *args, **named):
            read.append(batch.num_rows)
            yield batch

    monkeypatch.setattr(T_LOG.pq.ParquetFile, "iter_batches", counted)
    reader = T_LOG.TopicReader({"path": topic.root})
    for low, high in ((0, 5), (9_999, 10_001), (31_000, 39_500), (49_999, 50_000), (0, 50_000)):
        read.clear()
        got = [(o, v) for s in topic.segments({"0": low}, {"0": high}) for b in reader.read(T_LOG._Slice(*s))
               for o, v in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
        assert [o for o, _ in got] == list(range(low, high)) and len({v for _, v in got}) == high - low
        assert sum(read) <= high - low + 2 * T_LOG.FLUSH_ROWS


def test_isolation_trees_step_as_prepared():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9000, 3))
    trees = [A.grow_tree(x[:300], np.random.default_rng(i), 9) for i in range(5)]
    steps = A.stepping(trees)
    whole = A.walked(steps, x)
    assert np.array_equal(whole, np.concatenate([A.walked(steps, x[i:i + 700]) for i in range(0, 9000, 700)]))
    high = A.walked(steps, np.array([[np.nan] * 3, [np.inf] * 3, [1e300] * 3]))
    assert high[0] == high[1] == high[2]


def test_starts_of_segments_share_passes_and_are_as_good(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.4, size=(300, 3)) for c in rng.normal(scale=4, size=(8, 3))])
    embedded = spark.createDataFrame(pd.DataFrame({"x": x.tolist()})).select(array_to_vector("x").alias("embedding")).repartition(5)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("segments", "segments")
    model = CL.kmeans_segments(embedded, 8, 10)
    many = len(jobs.getJobIdsForGroup("segments"))
    spark.sparkContext.setJobGroup("other", "other")
    plain = min(KMeans(k=8, seed=i, featuresCol="embedding").fit(embedded).summary.trainingCost for i in range(5))
    assert model.cost <= plain * 1.01 and many < 70
    told = model.transform(embedded.repartition(2)).select("cluster", "embedding").toPandas()
    gap = ((np.stack(told["embedding"].map(lambda v: v.toArray()))[:, None] - model.centers) ** 2).sum(-1)
    assert (gap.argmin(1) == told["cluster"]).all() and np.isclose(gap.min(1).sum(), model.cost)
    same = spark.createDataFrame(pd.DataFrame({"x": [[1.0, 2.0]] * 40})).select(array_to_vector("x").alias("embedding"))
    assert CL.kmeans_segments(same, 3, 2).cost == 0


def test_curves_do_not_order_the_whole_table(spark, tmp_path):
    from tallyrisk.plans import workload as W

    registry.load_all()
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    folder = Path(spark.conf.get("spark.checkpoint.dir")) / "tallyrisk"
    before = set(folder.glob("index-*"))
    lean = registry.QUERIES["roc_auc"](spark, str(tmp_path)).collect()
    ordered = sum(spark.read.parquet(str(p)).count() for p in set(folder.glob("index-*")) - before)
    rows = W.split_rows(spark, str(tmp_path))
    whole = W.transactions(spark, str(tmp_path)).drop("seq")
    assert ordered < whole.count() / 50
    assert rows.exceptAll(whole).count() == 0 and whole.exceptAll(rows).count() == 0
    assert sorted(lean) == sorted(registry.QUERIES["roc_auc"](spark, "/root/testdata/sf0.001").collect())
