"""Greedy suppression and change-list walks against plain loops."""

import random

from trackloom.operators import suppression


def test_kept_marks_equal_the_greedy_loop(spark):
    r = random.Random(3)
    rows = [(f, r.uniform(0, 60), r.choice((0.0, 5.0, 11.0)), float(r.randrange(12)), f * 1000 + i) for f in range(4) for i in range(90)]
    rows += [(9, float(2 * i), 0.0, float(i), 9000 + i) for i in range(9)]  # a chain, each better than the last
    got = {x.id for x in suppression.suppressed(spark.createDataFrame(rows, "f int, x double, y double, s double, id long"), ["f"], ["x", "y"], "s", "id", 3.0).collect()}
    want = set()
    for frame in {x[0] for x in rows}:
        kept = []
        for _, x, y, _, i in sorted((x for x in rows if x[0] == frame), key=lambda x: (-x[3], x[4])):
            if all(abs(x - a) >= 3 or abs(y - b) >= 3 for a, b in kept):
                kept.append((x, y))
                want.add(i)
    assert got == want


def test_marks_that_share_places_meet_only_the_first_of_cells(spark):
    many = spark.range(60_000).selectExpr("id % 2 AS f", "id % 7 AS x", "id % 5 AS y", "id % 11 AS s", "id")
    rows = [tuple(r) for r in many.collect()]
    got = {x.id for x in suppression.suppressed(many, ["f"], ["x", "y"], "s", "id", 3.0).collect()}
    want = set()
    for frame in (0, 1):
        kept = []
        for _, x, y, _, i in sorted((r for r in rows if r[0] == frame), key=lambda r: (-r[3], r[4])):
            if all(abs(x - a) >= 3 or abs(y - b) >= 3 for a, b in kept):
                kept.append((x, y))
                want.add(i)
    assert got == want


def test_marks_of_unknown_place_meet_none(spark):
    rows = [(1, 0.0, 0.0, 1.0, 1), (1, 1.0, 0.0, 2.0, 2), (1, None, 0.0, 0.0, 3), (1, float("nan"), 0.0, 9.0, 4), (None, 0.0, 0.0, 0.0, 5)]
    got = suppression.suppressed(spark.createDataFrame(rows, "f int, x double, y double, s double, id long"), ["f"], ["x", "y"], "s", "id", 3.0)
    assert {r.id for r in got.collect()} == {2, 3, 4, 5}


def test_builds_between(spark):
    chain = spark.createDataFrame([(100 + i, 100 + i - 1) for i in range(1, 90)] + [(300, 189), (302, 300)], "build long, before long")
    walk = lambda ours, latest, most=60: suppression.builds_between(chain, ours, latest, most)
    assert {r.build for r in walk(150, 302).collect()} == {302, 300, *range(151, 190)}
    assert walk(302, 302).count() == 0 and walk(310, 302).count() == 0
    assert {r.build for r in walk(299, 302).collect()} == {302, 300}
    assert walk(101, 302) is None  # too many lists
    assert walk(90, 140) is None  # the chain breaks off before it leads back
    assert walk(100, 301) is None  # no list of that build
    assert walk(130, 302, 61) is not None and walk(130, 302, 60) is None
