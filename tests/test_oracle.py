"""Registered queries against their SQL on the smallest tables; the whole set runs in scripts/compare.py."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "scripts"))

import compare  # noqa: E402
import __spark_entry__ as entry  # noqa: E402
from tallyrisk.operators.report import REPORT_COLUMNS  # noqa: E402
from tallyrisk.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"
CHECKED = ["scan_transactions", "time_split", "split_summary", "global_index", "score_curve", "report_by_model",
           "cost_curve", "curve_downsample", "cost_threshold_select", "window_drift", "drift_flagged", "validate_table",
           "quantile_edges", "registry_append", "parse_events", "join_scores_by_id", "score_agreement", "latency_percentiles",
           "scalar_projection", "tumbling_score_psi", "late_drop", "stream_batch_parity", "knn_self_join", "cluster_report"]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def oracle():
    return compare.oracle_connection(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, oracle, name):
    _, problem = compare.compare(spark, oracle, name, SF, tolerance=2e-6)
    assert problem is None, problem


def test_every_core_query_has_an_oracle_and_is_listed():
    registry.load_all()
    assert set(registry.ORACLES) == set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert tuple(df.columns) == ("split", "model", *REPORT_COLUMNS) and df.count() == 6
