import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "scripts"))
import compare as CMP  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_pareto_mix", "op3_setsketch", "op9_trigram_index", "op12_permuterm", "op13_max_sketch"])
def test_query_equals_its_sql(spark, name):
    got, problem = CMP.compare(spark, CMP.oracle_connection(SMALL), name, SMALL)
    assert problem is None and len(got[1]) >= 200
