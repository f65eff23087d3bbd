import numpy as np
import pandas as pd
import pytest

from tallyrisk.plans import stages as ST
from tallyrisk.operators.quality import ValidationError

NAMES = ["V1", "V2", "V3", "Amount"]


@pytest.fixture(scope="module")
def source(spark):
    rng = np.random.default_rng(5)
    n = 3000
    y = (rng.random(n) < 0.03).astype(int)
    data = pd.DataFrame(rng.normal(size=(n, 4)) + 2.2 * y[:, None] * [1, 1, 0, 0], columns=NAMES)
    data["Amount"] = np.abs(data["Amount"])
    return spark.createDataFrame(data.assign(Class=y, seq=np.arange(n))).repartition(3)


def make_run(spark, out):
    return ST.Run(spark, str(out), NAMES, models=["logreg"], strategies=["none", "weights"],
                  overrides={"logreg": {"maxIter": 10}},
                  clusters=3, starts=1, forest={"trees": 5, "rows": 64}, bottleneck=2, dp_steps=2, seeds=(0, 1))


def test_all_stages(spark, source, tmp_path):
    run = make_run(spark, tmp_path / "run")
    assert {r["split"]: r["rows"] for r in ST.stage_data(run, source).collect()} == {"train": 2100, "val": 300, "test": 600}
    assert ST.stage_train(run).count() == 2
    out = ST.stage_evaluate(run)
    assert set(out) == {"anomaly", "clusters", "cluster_as_feature", "calibration", "reliability", "cost_curve", "cost",
                        "attribution", "stability"}
    assert out["clusters"].count() == 6 and out["cluster_as_feature"].count() == 4 and out["attribution"].count() == 4
    assert out["stability"].first()["seeds"] == 2
    cost = out["cost"].first()
    assert cost["cost_per_10k"] <= cost["flag_everything_cost_per_10k"] and 0 <= cost["raw_threshold"] <= 1
    assert ST.stage_privacy(run).count() == 5
    assert ST.stage_drift(run).count() == 3 * 5


def test_lifecycle_promotes_once_and_gates(spark, source, tmp_path):
    run = make_run(spark, tmp_path / "run")
    ST.stage_data(run, source, sample=0.9)
    registry = str(tmp_path / "registry")
    first = ST.lifecycle(run, registry, [("logreg", "weights"), ("logreg", "none")], floor=0.3)
    assert first.passed and first.champion_pr_auc == 0.0
    assert spark.read.parquet(f"{run.out}/predictions").count() == run.table().filter("split = 'test'").count()
    again = make_run(spark, tmp_path / "again")
    ST.stage_data(again, source, sample=0.9)
    second = ST.lifecycle(again, registry, [("logreg", "none")], floor=0.9999)
    assert not second.passed and second.champion_pr_auc == first.test_pr_auc
    assert spark.read.parquet(registry).count() == 1


def test_lifecycle_stops_on_bad_input(spark, source, tmp_path):
    run = make_run(spark, tmp_path / "run")
    ST.stage_data(run, source.withColumn("Amount", -source["Amount"]))
    with pytest.raises(ValidationError, match="negative_amounts"):
        ST.lifecycle(run, str(tmp_path / "registry"))
