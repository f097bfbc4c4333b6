from chronomesh.operators import polygons
from chronomesh.plans import layouts

SF = "/root/testdata/sf0.001"


def test_points_meet_no_edges_one_by_one(spark):
    """The join of points with edges was quadratic; now places meet a ring's edges sorted."""
    points = layouts.probes(spark, SF)
    plan = polygons.in_rings(points, layouts.rings(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_probes_are_the_sums_of_the_sql(spark):
    """A second addition gave other last bits than the SQL's constant, for probes that lie on an edge."""
    for r in layouts.probes(spark, SF).collect():
        assert r.lat == 47.50005 + (r.id * 7919 % 2340) / 1e4 and r.lng == -122.42995 + (r.id * 104729 % 1900) / 1e4


def test_places_on_an_edge_and_copies_of_points(spark):
    """A place on an edge has no crossing there; every copy of a point is in a ring."""
    square = spark.createDataFrame([(7, 1, 0.0, 0.0), (7, 2, 0.0, 1.0), (7, 3, 1.0, 1.0), (7, 4, 1.0, 0.0)], "ring int, k int, lat double, lng double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 0.5), (3, 0.5, 1.0), (4, 0.5, 0.0), (5, 1.0, 0.5), (6, 0.5, None)], "id int, lat double, lng double")
    assert sorted(map(tuple, polygons.in_rings(points, square).collect())) == [(1, 7), (2, 7), (4, 7)]
