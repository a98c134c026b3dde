"""Settlement of exits from the observers' plane on flights of known truth."""

import math

import compare
import duckdb
import pytest
from pyspark.sql import functions as F

from trackloom.operators import exits, geometry
from trackloom.plans import exit_queries, motion_queries

KM = 1000.0
#: Planes by observers, in km: y = z through the centre (+n towards z > y), x + y + z = 100, and z = 0.
PLANES = {
    "central": ((0, 0, 0), (100, 0, 0), (0, 100, 100)),
    "tilted": ((100, 0, 0), (0, 100, 0), (0, 0, 100)),
    "floor": ((0, 0, 0), (100, 0, 0), (0, 100, 0)),
}


def flight(points, seconds):
    """A place a second along straight legs between points in km."""
    out = []
    for a, b, n in zip(points, points[1:], seconds):
        out += [tuple(KM * (x + (y - x) * i / n) for x, y in zip(a, b)) for i in range(n)]
    return [*out, tuple(KM * x for x in points[-1])]


def normal(plane):
    a, b, c = PLANES[plane]
    u, v = [y - x for x, y in zip(a, b)], [y - x for x, y in zip(a, c)]
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    size = math.sqrt(sum(x * x for x in n))
    return tuple(x / size for x in n), tuple(KM * x for x in a)


def mirrored(plane, path, after=-1):
    n, at = normal(plane)
    off = [sum(k * (x - o) for k, x, o in zip(n, p, at)) for p in path]
    return [tuple(x - 2 * o * k for x, k in zip(p, n)) if t > after else p for t, (p, o) in enumerate(zip(path, off))]


def run(spark, plane, flights, points=(), start=0, pods=()):
    rows = [(name, t * 1_000_000, *p, name in pods and t > 40) for name, path in flights.items() for t, p in enumerate(path)]
    fixes = spark.createDataFrame(rows, "pilot string, us long, x double, y double, z double, capsule boolean")
    asked = spark.createDataFrame([(i, t * 1_000_000, *rest) for i, (t, *rest) in enumerate(points)], "id long, us long, source string, target string, disruption boolean, ship string")
    flat = geometry.plane(*(geometry.vec(*(KM * x for x in p)) for p in PLANES[plane]))
    settled, put = exits.settle(fixes, asked, start * 1_000_000, flat)
    found = {}
    for r in settled.orderBy("pilot", "exit_id").collect():
        found.setdefault(r.pilot, []).append(r)
    placed = {}
    for r in put.orderBy("pilot", "us").collect():
        placed.setdefault(r.pilot, []).append((r.x, r.y, r.z))
    return found, placed


def apart(a, b):
    return max(math.dist(p, q) for p, q in zip(a, b, strict=True))


IN_PLANE = [(12, 10, 10), (50, 52, 52)]


def test_central_plane(spark):
    up = flight([*IN_PLANE, (80, 47, 72)], [60, 40])  # along the plane, then towards +n
    late = [*up[:-1], up[-1]]
    end = up[-1]
    brisk = flight([(50, 70, 30), (50, 30, 70)], [80])
    twice = flight([(10, 20, 20), (30, 30, 30), (40, 20, 40), (50, 35, 35), (70, 35, 35), (80, 60, 35)], [40, 30, 30, 40, 40])
    parked = [(end[0] + 5000.0, end[1], end[2])] * len(up)
    flights = {"plain": up, "brisk": brisk, "twice": twice, "held": late, "tackler": parked, "far": up, "near": up}
    last = len(up) - 3
    points = [(last, "tackler", "held", False, "Stiletto"), (last, "tackler", "near", False, "arazu "), (last, "far", "far", False, "Stiletto"), (last, "tackler", "brisk", True, None)]
    found, placed = run(spark, "central", flights, points)
    assert "brisk" not in found and apart(placed["brisk"], brisk) < 1e-6  # a crossing is no exit
    (r,) = found["plain"]
    assert r.turn == "cw" and r.cw_points - r.ccw_points < 1  # nothing against clockwise
    assert apart(placed["plain"], mirrored("central", up, r.exit_us // 1_000_000)) < 1
    (r,) = found["held"]  # clockwise would put it out of the scrambler's range
    assert r.turn == "ccw" and r.range == 5.0 and apart(placed["held"], up) < 1
    assert [r.turn for r in found["near"]] == ["cw"]  # a long point reaches either side
    assert [r.turn for r in found["far"]] == ["cw"]  # a point on itself says nothing
    assert len(found["twice"]) >= 2
    first, second = found["twice"][0], found["twice"][-1]
    n, at = normal("central")
    off = [sum(k * (x - o) for k, x, o in zip(n, p, at)) for p in placed["twice"]]
    assert first.turn == "cw" and min(off[first.exit_us // 1_000_000 : second.exit_us // 1_000_000]) < -3000
    assert all(abs(abs(a) - abs(sum(k * (x - o) for k, x, o in zip(n, p, at)))) < 1e-6 for a, p in zip(off, twice))


def test_arena_boundary(spark):
    n, _ = normal("tilted")
    foot, u = (100 / 3,) * 3, (math.sqrt(0.5), -math.sqrt(0.5), 0.0)
    at = lambda along, up: tuple(f + along * a + up * b for f, a, b in zip(foot, u, n))
    back = flight([at(0, 0), at(30, 0), at(110, 60), at(40, 40)], [30, 60, 60])  # clockwise would leave the arena and return
    out = flight([at(0, 0), at(30, 0), at(110, 60)], [30, 60])
    found, placed = run(spark, "tilted", {"back": mirrored("tilted", back, 30), "out": out, "pod": mirrored("tilted", back, 30)}, pods=("pod",))
    assert [(r.turn, r.boundary) for r in found["back"]] == [("ccw", 10.0)] and apart(placed["back"], back) < 1
    assert [(r.turn, r.boundary) for r in found["out"]] == [("cw", 0.0)]  # leaving and staying out proves nothing
    assert [(r.turn, r.boundary) for r in found["pod"]] == [("cw", 0.0)]  # nor does a capsule's way


def test_before_the_start_ships_are_in_the_cube(spark):
    up = flight([(40, 40, 0), (45, 40, 0), (50, 40, 20)], [10, 20])
    found, placed = run(spark, "floor", {"up": up}, start=100)
    assert [(r.turn, r.start) for r in found["up"]] == [("ccw", 10.0)] and apart(placed["up"], up) < 1
    found, _ = run(spark, "floor", {"up": up[:8]}, start=100)
    assert found == {}  # a stretch that the track ends in has no tail


def test_points_reach(spark):
    rows = spark.createDataFrame([(False, "Stiletto"), (True, None), (False, " ONYX"), (True, "keres")], "disruption boolean, ship string")
    got = [r[0] for r in rows.select(exits.point_range(rows.disruption, rows.ship)).collect()]
    assert got == pytest.approx([15_000, 40_000, 45_000, 90_000])


def test_an_exit_flipped_twice_is_as_before(spark):
    from pyspark.sql import functions as F

    from trackloom.operators import contacts

    schema = "i int, pilot string, x_m double, y_m double, z_m double, dir_x double, dir_y double, dir_z double, plane_exit string, plane_exit_id int, plane string"
    rows = [(1, "A", 1000.0, 2000.0, 3000.0, 0.6, 0.0, 0.8, "cw", 1, "0 0 1 500"), (2, "A", 1.0, 2.0, 3.0, None, None, None, "ccw", 1, "0 0 1 500")]
    rows += [(3, "A", 1.0, 2.0, 3.0, 0.0, 1.0, 0.0, "cw", 2, "0 0 1 500"), (4, "B", 1.0, 2.0, 3.0, 0.0, 1.0, 0.0, "cw", 1, "0 0 1 500"), (5, "A", 1.0, 2.0, 3.0, 0.0, 1.0, 0.0, "cw", 1, None), (6, None, None, None, None, None, None, None, None, None, "")]
    df = spark.createDataFrame(rows, schema)
    once = contacts.exit_flipped(df, F.lit("A"), F.lit(1))
    got = {r.i: tuple(r)[1:] for r in once.collect()}
    assert got[1] == ("A", 1000.0, 2000.0, -2000.0, 0.6, 0.0, -0.8, "ccw", 1, "0 0 1 500") and got[2][3:8] == (997.0, None, None, None, "cw")
    assert all(got[i] == tuple(r)[1:] for i, r in enumerate(rows, 1) if i > 2)
    assert sorted(map(tuple, contacts.exit_flipped(once, F.lit("A"), F.lit(1)).collect())) == rows


def test_places_as_far_from_the_plane_tie(spark):
    rows = [(0, float(x), float(y), float(20 - x - y)) for x in range(-9, 10) for y in range(-9, 10)]
    at = spark.createDataFrame(rows, "k int, x double, y double, z double")
    off = geometry.offset(tuple(F.col(c) for c in "xyz"), motion_queries.diagonal())
    assert at.select(off.alias("off")).distinct().count() == 1
    back = geometry.reflect(geometry.reflect(tuple(F.col(c) for c in "xyz"), motion_queries.diagonal()), motion_queries.diagonal())
    gap = at.select(F.max(geometry.norm(geometry.sub(back, tuple(F.col(c) for c in "xyz"))))).first()[0]
    assert gap < 1e-9


def test_points_at_half_a_digit_round_as_in_the_sql(spark, tmp_path):
    """A user's points sum up to 1.1845, a last digit short, where their event numbers are shifted by nine tables'."""
    c = duckdb.connect()
    moved = "CASE WHEN user_id = 150 THEN 9 ELSE 0 END"
    c.execute(f"COPY (SELECT event_id + 100000 * {moved} AS event_id, ts, user_id + 1500 * {moved} AS user_id, event_type, value, props FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id IN (3, 150) ORDER BY 1) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = compare.spark_rows(exit_queries.exit_settlement(spark, str(tmp_path)))
    assert got == compare.duck_rows(c, exit_queries.SQL["exit_settlement"])
    assert any(1.185 in r for r in got[1])
