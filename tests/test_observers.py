"""Observers found again from ranges that they read."""

import itertools
import math

import numpy as np

from trackloom.operators import observers

SIDE = 250_000.0
SCHEMA = "match string, pilot string, t double, d_a double, d_b double, d_c double, speed double"


def _places(triple, distance):
    return np.array([[SIDE / 2 + (1 if c >> axis & 1 else -1) * distance / math.sqrt(3) for axis in range(3)] for c in triple])


def test_each_shape_stands_once():
    known = observers.shapes()
    sides = {tuple((a ^ b).bit_count() for a, b in itertools.combinations(t, 2)) for t in itertools.permutations(range(8), 3)}
    assert len(known) == len(sides) == 10 and len({tuple((a ^ b).bit_count() for a, b in itertools.combinations(t, 2)) for t in known}) == 10


def test_observers_are_found_again(spark):
    r, rows = np.random.default_rng(2), []
    truth = {"m1": (0, 190_000.0), "m2": (5, 260_000.0)}
    for match, (shape, distance) in truth.items():
        at = _places(observers.shapes()[shape], distance)
        for pilot in range(8):
            p, v = r.uniform(40_000, 210_000, 3), r.uniform(-1500, 1500, 3)
            for t in range(25):
                d = np.round(np.linalg.norm(p + t * v - at, axis=1) / 100) * 100
                rows.append((match, str(pilot), float(t), *map(float, d), float(np.linalg.norm(v))))
    rows.append(("m1", "0", 25.0, None, 1.0, 1.0, None))
    got = {x.match: x for x in observers.infer(spark.createDataFrame(rows, SCHEMA), SIDE, 100_000.0, 500_000.0).collect()}
    for match, (shape, distance) in truth.items():
        assert got[match].shape == shape and abs(got[match].distance - distance) < 3_000 and got[match].cost < got[match].runner_up


def test_starts_equal_a_plain_version_and_are_spread(spark, monkeypatch):
    """Sums of blocks equal a plain version, and a match's readings go to many tasks (F13)."""
    d = np.random.default_rng(4).uniform(60_000, 300_000, (40, 3))
    rows = spark.createDataFrame([("m", *map(float, x)) for x in d], "match string, d_a double, d_b double, d_c double").coalesce(1)
    spread, repartition = [], type(rows).repartition
    monkeypatch.setattr(observers, "TASK_READINGS", 1)
    monkeypatch.setattr(type(rows), "repartition", lambda self, n, *c: spread.append(n) or repartition(self, n, *c))
    ratio = math.log(5.0) / (observers.DISTANCES - 1)
    got = {(r.shape, r.distance): r.start for r in observers._starts(rows, None, ratio, 100_000.0, SIDE).collect()}
    assert spread == [40] and len(got) == 10 * observers.DISTANCES
    for (shape, distance), start in list(got.items())[::97]:
        at = _places(observers.shapes()[shape], distance)
        u, w, n = at[1] - at[0], at[2] - at[0], np.cross(at[1] - at[0], at[2] - at[0])
        a, b = (d[:, 0] ** 2 - d[:, 1] ** 2 + u @ u) / 2, (d[:, 0] ** 2 - d[:, 2] ** 2 + w @ w) / 2
        foot = np.linalg.solve(np.array([[u @ u, u @ w], [u @ w, w @ w]]), np.stack([a, b])).T @ np.stack([u, w])
        lift = np.sqrt(np.maximum(d[:, 0] ** 2 - (foot**2).sum(1), 0))[:, None] * n / np.linalg.norm(n)
        out = [np.linalg.norm(np.maximum(np.maximum(-x, x - SIDE), 0), axis=1) for x in (at[0] + foot + lift, at[0] + foot - lift)]
        miss = np.sqrt(np.mean([(np.linalg.norm(at[0] + foot + lift - q, axis=1) - d[:, i]) ** 2 for i, q in enumerate(at)], 0))
        assert math.isclose(start, np.mean(miss + np.minimum(*out)), rel_tol=1e-9)
