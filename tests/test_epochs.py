import json

import pytest
from pyspark.sql import functions as F

from tallyrisk.sources import epochs as EP
from tallyrisk.sources import sinks

SCHEMAS = {"rows": "i long", "sums": "n long, total long"}


def parts(df):
    return {"rows": df, "sums": df.agg(F.count("i").alias("n"), F.sum("i").alias("total"))}


def state(spark, root, upto=None):
    tables = EP.read_tables(spark, root, SCHEMAS, upto)
    return sorted(r[0] for r in tables["rows"].collect()), sorted(map(tuple, tables["sums"].collect()))


def test_both_or_neither_and_a_repeat_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "t")
    assert state(spark, root) == ([], [])
    assert EP.commit_epoch(spark, root, 0, parts(spark.range(3).toDF("i")))
    assert not EP.commit_epoch(spark, root, 0, parts(spark.range(9).toDF("i")))
    assert state(spark, root) == ([0, 1, 2], [(3, 3)])
    broken = parts(spark.range(5, 7).toDF("i"))
    broken["sums"] = broken["sums"].withColumn("total", F.raise_error(F.lit("stopped between the writes")).cast("long"))
    with pytest.raises(Exception, match="stopped between"):
        EP.commit_epoch(spark, root, 1, broken)
    assert state(spark, root) == ([0, 1, 2], [(3, 3)])  # the first table's rows are written and not shown
    assert EP.commit_epoch(spark, root, 1, parts(spark.range(5, 7).toDF("i")))
    assert state(spark, root) == ([0, 1, 2, 5, 6], [(2, 11), (3, 3)])
    assert state(spark, root, upto=0) == ([0, 1, 2], [(3, 3)])
    assert not EP._publish(spark, root, 1, "another")  # a second writer of the epoch loses
    assert state(spark, root)[0] == [0, 1, 2, 5, 6]
    assert not [p for p in (tmp_path / "t" / "epochs").iterdir() if "another" in p.name]
    with pytest.raises(ValueError):
        EP.commit_epoch(spark, root, 2, {"epochs": spark.range(1)})


def test_empty_epochs_and_empty_tables(spark, tmp_path):
    root = str(tmp_path / "t")
    assert EP.commit_epoch(spark, root, 0, parts(spark.range(0).toDF("i")))
    assert state(spark, root) == ([], [(0, None)])


def test_stream_stopped_between_the_writes_goes_on(spark, tmp_path):
    """A batch fails after its first table is written; the restarted query repeats it, and each row is there once."""
    root, source = str(tmp_path / "t"), tmp_path / "in"
    source.mkdir()
    stop = tmp_path / "stop"

    def run():
        lines = spark.readStream.schema("i long").option("maxFilesPerTrigger", 1).json(str(source))

        def tables(batch):
            made = parts(batch)
            if stop.exists():
                made["sums"] = made["sums"].withColumn("total", F.raise_error(F.lit("stopped")).cast("long"))
            return made

        sinks.drain(EP.sink_append_tables(lines, root, str(tmp_path / "cp"), tables))

    (source / "a.json").write_text("\n".join(json.dumps({"i": i}) for i in range(4)))
    run()
    (source / "b.json").write_text("\n".join(json.dumps({"i": i}) for i in range(4, 9)))
    stop.touch()
    with pytest.raises(Exception, match="stopped"):
        run()
    assert state(spark, root) == ([0, 1, 2, 3], [(4, 6)])
    stop.unlink()
    run()
    assert state(spark, root) == (list(range(9)), [(4, 6), (5, 30)])
