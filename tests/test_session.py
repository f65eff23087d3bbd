from pyspark.sql import functions as F

from tallyrisk import landing, session


def test_partitions_follow_the_data():
    assert session.partitions_for(0) == 1
    assert session.partitions_for(1 << 40) == 8192
    assert session.partitions_for(100 << 40) == session.MAX_PARTITIONS


def test_prepare_only_raises_the_partition_count(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    session.prepare(spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    monkeypatch.setattr(session, "path_bytes", lambda *_: 10 << 30)
    session.prepare(spark, "any")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "80"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_landed_tables_live_in_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    mark = len(landing._WRITTEN.get(spark.sparkContext.applicationId, []))
    table = landing.land(spark.range(10).withColumn("p", F.col("id") % 2), "t", ["p"])
    assert table.count() == 10 and table.columns == ["id", "p"]
    assert all(f.removeprefix("file://").startswith(root) for f in table.inputFiles())
    assert landing.release(spark, mark) == 1
    assert len(landing._WRITTEN[spark.sparkContext.applicationId]) == mark
