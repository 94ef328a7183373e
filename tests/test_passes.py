"""The measurement view is made once a query, of numbers; what follows reads what was written."""

import pytest

from gaugeworks.plans import views
from gaugeworks.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["arm_overlap", "tercile_contrast", "gap_by_region", "benign_corner", "factor_signatures", "simulated_rows", "remapped_rows", "matched_arms"])
def test_no_pass_goes_back_to_the_log(spark, name):
    assert not [f for f in QUERIES[name](spark, SF).inputFiles() if "lineitem" in f]


def test_names_are_not_shuffled(spark):
    plan = views.measurements(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "clip_" not in plan[plan.index("Window") :] and "babble" not in plan[plan.index("Window") :]
