"""Windows cut at ranks and buckets give what whole windows give."""

import compare
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trackloom.operators import intervals, motion, windows


@pytest.fixture(scope="module")
def series(spark):
    r = np.random.default_rng(3)
    rows = [(int(k), int(t), None if v > 95 else float(v), i) for i, (k, t, v) in enumerate(zip(r.integers(0, 3, 400), r.integers(0, 5_000, 400), r.uniform(0, 100, 400)))]
    return spark.createDataFrame([*rows, (9, 5, 1.0, 400), (None, 7, 2.0, 401), (None, 9, None, 402)], "k long, us long, v double, id long")


def _rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_row_frames_do_not_depend_on_ranks(series, monkeypatch):
    made = lambda: [_rows(windows.hampel(series.fillna(0.0), "k", "us", "v", tie="id")), _rows(windows.running_median3(series.fillna(0.0), "k", "us", "v", tie="id")), _rows(windows.neighbours(series, "k", "us", ["v", "us"], "id"))]
    whole = made()
    monkeypatch.setattr(windows, "RANKS", 7)
    assert made() == whole
    w = Window.partitionBy("k").orderBy("us", "id")
    plain = series.withColumns({"prev_v": F.lag("v").over(w), "prev_us": F.lag("us").over(w), "next_v": F.lead("v").over(w), "next_us": F.lead("us").over(w)})
    assert whole[2] == _rows(plain)


@pytest.mark.parametrize("size", (1, 37, 1_000, 10**9))
def test_carried_runs_equal_whole_windows(series, size):
    for ahead in (False, True):
        order = [F.col("us").desc() if ahead else F.col("us"), F.col("id")]
        for exclusive in (False, True):
            w = Window.partitionBy("k").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
            got = windows.carried(series, ["k"], "us", [F.col("id")], {"s": ("sum", F.lit(1).cast("long")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}, ahead, exclusive, size)
            want = series.withColumns({"s": F.sum(F.lit(1).cast("long")).over(w), "m": F.max("v").over(w), "l": F.last("v", ignorenulls=True).over(w)})
            assert _rows(got) == _rows(want)


def test_folds_and_runs_do_not_depend_on_buckets(series, monkeypatch):
    spans = intervals.hold(series.filter("k IS NOT NULL"), "us", 12).select("k", "t0", "t1")
    known = series.filter("v IS NOT NULL")
    made = lambda: [_rows(intervals.fold(spans, ["k"])), _rows(intervals.runs(known, "k", ["us", "id"], "v > 40")), _rows(windows.segments(series, "k", "us", 20, "id"))]
    whole = made()
    monkeypatch.setattr(windows.carried, "__defaults__", (False, False, 50))
    assert made() == whole


def test_running_sums_and_medians_of_a_hot_key(spark):
    r = np.random.default_rng(4)
    rows = [("hot" if i % 3 else f"k{i % 7}" if i % 5 else None, i, int(r.integers(0, 9)), float(r.integers(0, 40)) if i % 11 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, w int, v double").repartition(6)
    got = {x.i: x.to for x in windows.accumulated(df, ["k"], [F.col("i").desc()], F.col("w").cast("long"), "to").collect()}
    want, sums = {}, {}
    for k, i, w, _ in sorted(rows, key=lambda x: -x[1]):
        sums[k] = want[i] = sums.get(k, 0) + w
    assert got == want
    values = {}
    for k, _, _, v in rows:
        if k is not None and v is not None:
            values.setdefault(k, []).append(v)
    made = {x.k: (x.n, x.middle, x.upper) for x in windows.medians(df.filter("k IS NOT NULL"), ["k"], "v").collect()}
    assert made == {k: (len(v), float(np.median(v)), sorted(v)[len(v) // 2]) for k, v in values.items()}
    assert windows.medians(df.filter("i < 0"), ["k"], "v").count() == 0


def test_re_entries_keep_between_limits_and_end_at_a_capsule(spark):
    rows = [("a", 0, False, False), ("a", 5, True, False), ("a", 7, None, False), ("a", 9, True, False), ("a", 15, False, False), ("a", 20, True, False), ("a", 24, False, False)]
    rows += [("b", t, o, p) for _, t, o, p in rows[:4]] + [("b", 10, True, True), ("b", 15, False, False)]  # the capsule comes first
    rows += [("c", 0, True, None), ("c", 30, None, None)]  # never back
    df = spark.createDataFrame(rows, "k string, us long, out boolean, pod boolean")
    assert sorted(map(tuple, motion.re_entries(df, "k", "us", "out", 6, "pod").collect())) == [("a", 5, 15)]
    assert sorted(map(tuple, motion.re_entries(df, "k", "us", "out", 4).collect())) == [("a", 5, 15), ("a", 20, 24), ("b", 5, 15)]


def test_tasks_of_whole_keys_grow_with_the_rows(spark, monkeypatch):
    """No task of `velocity_at` or `smooth_interp` gets more than a bounded number of rows (F10, F11)."""
    monkeypatch.setattr(windows, "TASK_ROWS", 8)
    samples = spark.range(400).selectExpr("id % 50 AS k", "id * 1000 AS us", "id AS tie", "CAST(id AS DOUBLE) AS v")
    grid = spark.range(100).selectExpr("id % 50 AS k", "id * 4000 AS us")
    assert motion.sampled(grid, samples, "k", "us", ["v"], "tie", 10**6).rdd.getNumPartitions() >= 500 // 8
    assert motion.velocity(grid, samples, "k", "us", "v", "tie", 10**6, 1000).rdd.getNumPartitions() >= 700 // 8


@pytest.mark.parametrize("name", ["velocity_at", "smooth_interp"])
def test_keys_too_long_to_run_whole(spark, sf, monkeypatch, name):
    """Keys above the limit run in buckets beside the whole ones, with the same result as the SQL."""
    n = compare.connection(sf).execute("SELECT median(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id)").fetchone()[0]
    monkeypatch.setattr(windows, "RANKS", int(n) + (120 if name == "smooth_interp" else 360))
    parts = []
    found = windows.by_length
    monkeypatch.setattr(windows, "by_length", lambda *a: parts.append(found(*a)) or parts[-1])
    got = compare.spark_rows(entry.queries()[name](spark, sf))
    assert [tasks > 0 for _, tasks in parts[0]] == [True, False]
    assert got == compare.duck_rows(compare.connection(sf), entry.oracle_sql()[name])
