"""Every registered query next to its SQL at the smallest scale, and plan checks."""

import pytest
from check import compare, duck

from daygrid.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, _, _, notes = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert not notes


@pytest.mark.parametrize("name", ["a03_day_stats", "i10_day_matrix", "w05_window_table", "j01_nearest_label"])
def test_core_plans_stay_in_the_engine(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_cluster_split_is_complete_and_disjoint(spark):
    from daygrid.operators import splits
    from daygrid.plans import stages
    from daygrid.sources import adapter

    flat, info = stages.flat(spark, SF), adapter.participant_info(spark, SF)
    assignment = splits.split_by_cluster(flat, adapter.demographics(spark, SF), info, k=3)
    checks = splits.split_checks(assignment, splits.open_sharing(flat, info)).first()
    assert tuple(checks) == (0, 0, 0)
