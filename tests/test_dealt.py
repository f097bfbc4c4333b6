"""What must be dealt to tasks instead of being sent whole to each."""

import pytest
from chronomesh.plans.registry import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["j3_radius_join", "j5_transfers", "u2_all_transfers", "j15_mesh_candidates"])
def test_a_side_that_is_repeated_for_its_neighbour_cells_is_not_sent_to_every_task(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    spread = [line for line in plan.splitlines() if "Join" in line and "_cy" in line]
    assert spread and all("ShuffledHashJoin" in line for line in spread)
