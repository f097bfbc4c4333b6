"""What plans must not do at size: move the pairs of a matrix, or work through lambdas that are not compiled."""

import pytest
from chronomesh.plans.registry import queries

SF = "/root/testdata/sf0.001"
MATRIX = ("a10_anchor_stress", "a14_geo_scale", "a6_double_centre", "g15_block_product", "x7_geographic_seed", "j17_transpose", "a8_symmetrize", "a7_impute", "a9_stress", "g16_smacof_step", "x6_stress_weight", "mean_travel_time")


def plan_of(spark, name):
    return queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", MATRIX)
def test_a_matrix_of_anchors_moves_no_pair(spark, name):
    plan = plan_of(spark, name)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "Window" not in plan


@pytest.mark.parametrize("name", ["j16_nearest_bridge", "t3_two_crossings", "p20_segment_distance", "p18_lake_midpoint"])
def test_pairs_of_anchors_are_dealt_to_tasks_and_compiled(spark, name):
    plan = plan_of(spark, name)
    assert "REPARTITION_BY_NUM" in plan and "lambdafunction" not in plan


@pytest.mark.parametrize("name", ["j3_radius_join", "j5_transfers", "u2_all_transfers", "j15_mesh_candidates", "j14_all_pairs", "j21_access_lookup"])
def test_pairs_are_dealt_to_tasks_by_their_number_and_not_moved(spark, name):
    plan = plan_of(spark, name)
    assert "REPARTITION_BY_NUM" in plan
    assert "Exchange" not in plan.split("Join")[0]  # nothing after the last join


def test_a_route_report_makes_the_times_of_its_routes_alone(spark):
    from chronomesh.plans import layouts, scalar

    got = {(r.i, r.j): r.seconds for r in layouts.neighbour_times(spark, SF).collect()}
    assert got == {(r.i, r.j): r.seconds for r in scalar.synthetic(spark, SF).collect() if abs(r.i - r.j) == 1}


def test_a_drive_matrix_moves_no_pair(spark):
    plan = plan_of(spark, "g7_masked_matrix")
    assert "Join" not in plan and "Cartesian" not in plan


def test_a_drive_matrix_with_holes_equals_rounds_of_joins(spark):
    from chronomesh.operators import graph

    edges = spark.createDataFrame([(1, 2, 1.4), (2, 3, 1.2), (3, 1, 0.3), (2, 1, None), (3, 4, 5.0)], "src long, dst long, w double")
    snapped = spark.createDataFrame([(10, 1), (11, 1), (12, 3), (13, 4), (14, 9), (15, 9)], "id long, node long")
    rows = lambda **how: {(r.i, r.j): r.seconds for r in graph.drive_matrix(edges, snapped, **how).collect()}
    whole, known = rows(holes=True), rows()
    assert len(whole) == 36 and whole == rows(holes=True, kernel=False) and known == rows(kernel=False) == {k: v for k, v in whole.items() if v is not None}
    assert (whole[10, 12], whole[10, 13], whole[13, 10], whole[14, 15], whole[14, 10]) == (3, 8, None, 0, None)


def test_a_matrix_is_written_in_lines_where_its_rows_are_made(spark, monkeypatch):
    from chronomesh.sources import files

    made, write = [], files.write_json_lines
    monkeypatch.setattr(files, "write_json_lines", lambda df, path: made.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, path))
    plan_of(spark, "s3_json_sink")
    own = made[0].split("Union")[-1].split("BroadcastNestedLoopJoin")[0]
    assert len(made) == 1 and "BroadcastNestedLoopJoin" in made[0] and "Exchange" not in own and "collect_list" not in made[0]
