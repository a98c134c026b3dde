"""Speeds told against the ways of tracks."""

import functools
import math
import operator

from trackloom.operators import motion

SPEEDS = [72.77, 36.45, 42.23, 46.41, 2.14]  # 200 in all, 199.99999999999997 added in this order


def test_a_mean_equal_to_the_slowest_counts_in_any_order(spark):
    assert functools.reduce(operator.add, SPEEDS) < 200 == math.fsum(SPEEDS)
    rows = [(key, t, 30.0 * t, 0.0, 0.0, v) for key, told in (("a", SPEEDS), ("b", SPEEDS[::-1]), ("c", [*SPEEDS[:-1], 2.13])) for t, v in enumerate(told)]
    samples = spark.createDataFrame(rows, "key string, us long, x double, y double, z double, told double")
    got = motion.speed_errors(samples, "key", "us", ["x", "y", "z"], "told", 4, 4, 1, slowest=40.0).collect()
    assert sorted((r.key, r.n_windows, round(r.error, 6)) for r in got) == [("a", 1, 0.25), ("b", 1, 0.25)]
