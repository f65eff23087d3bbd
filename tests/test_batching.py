import json
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyrisk.streaming import score as SC


def batch(first, n):
    return pa.RecordBatch.from_pydict({"i": list(range(first, first + n))})


def test_calls_are_put_together_cut_and_never_late():
    def trickle():
        for k in range(12):
            yield batch(10 * k, 10)  # 120 rows at once
        time.sleep(0.8)
        yield batch(120, 5)  # waits for others, in vain
        time.sleep(0.8)
        yield batch(125, 450)
        yield batch(575, 0)
        yield batch(575, 3)

    calls = list(SC.coalesced(trickle(), least=64, most=200, wait_s=0.3))
    assert [v for c, _, _ in calls for v in c.column(0).to_pylist()] == list(range(578))
    sizes = [c.num_rows for c, _, _ in calls]
    assert max(sizes) <= 200 and 5 in sizes
    for rows, waited, last in ((c.num_rows, w, e) for c, w, e in calls):
        assert rows >= 64 or last or waited >= 0.29
        assert waited < 0.3 + 0.4  # with some room for a busy machine
    assert [e for _, _, e in calls] == [False] * (len(calls) - 1) + [True]


def test_no_rows_and_failing_input():
    assert list(SC.coalesced(iter([]))) == [] and list(SC.coalesced(iter([batch(0, 0)]))) == []

    def broken():
        yield batch(0, 3)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        list(SC.coalesced(broken()))


def test_scores_of_batched_calls(spark):
    model = json.dumps({"weights": [1.0, -2.0], "bias": 0.5}).encode()
    df = spark.range(3000, numPartitions=3).select("id", F.array(F.col("id") / 3000.0, F.lit(0.25)).alias("features"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    SC.set_event_batching(spark, 16)
    try:
        out = SC.score_batched(df, model, SC.open_linear, most=300).toPandas().sort_values("id")
        assert SC.score_batched(df.limit(0), model, SC.open_linear).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert np.allclose(out["score"], 1 / (1 + np.exp(-(np.arange(3000) / 3000 - 0.5 + 0.5))))
    assert out["call_rows"].max() <= 300 and (out["call_rows"].ge(64) | out["call_last"] | out["call_waited_s"].ge(0.5)).all()
