"""Boarding: each time at a stop is looked up once, among the departures it can meet, however many sources and departures there are."""

import random
from collections import defaultdict

from chronomesh.operators import transit


def test_times_are_looked_up_once_and_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(p, t, pos, (p * 3 + pos * 2) % 9, 100 * t % 700 + 40 * pos + rng.randrange(90)) for p in range(4) for t in range(40) for pos in range(4)]  # trips overtake
    trips = spark.createDataFrame([(*r, r[-1] + 5) for r in rows], "pattern long, trip long, pos long, stop long, arr long, dep long")
    labels = [(s, stop, 50 * (s % 3) + 300) for s in range(200) for stop in range(0, 9, 2)]
    df = spark.createDataFrame(labels, "source long, stop long, arr long")
    best = defaultdict(list)
    for source, stop, arr in labels:
        for p, t, pos, at, a in rows:
            if at == stop and a + 5 >= arr:
                best[source, p, pos].append(t)
    want = {k: min(v) for k, v in best.items()}
    caught = transit.catches(df, trips)
    assert {(r.source, r.pattern, r.pos): r.trip for r in transit.board(df, trips).collect()} == want
    assert caught.count() == len({(stop, arr, p, pos) for source, stop, arr in labels for (s, p, pos) in want if s == source and (p * 3 + pos * 2) % 9 == stop})
    assert caught.count() * 50 < len(want)  # not a row a source
    plan = transit.board(df, trips)._jdf.queryExecution().executedPlan().toString()
    assert "source" not in plan[plan.index("Window") :]  # labels are not sorted among departures
    on = {(s, p): {pos: t for (s2, p2, pos), t in want.items() if (s2, p2) == (s, p)} for s in (0, 1, 2) for p in range(4)}
    arrive = {(p, t, pos): (at, a) for p, t, pos, at, a in rows}
    rode = defaultdict(list)
    for (s, p), boarded in on.items():
        for to in range(4):
            if earlier := [t for pos, t in boarded.items() if pos < to]:
                stop, a = arrive[p, min(earlier), to]
                rode[s, stop].append(a)
    got = {(r.source, r.stop): r.arr for r in transit.ridden(df, trips).where("source < 3").collect()}
    assert got == {k: min(v) for k, v in rode.items()}
