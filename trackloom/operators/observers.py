"""Where three observers stood, from the ranges that they read.

Observers stand on diagonals of a cube at one distance from its centre. A candidate is a triple of
corners, one for each shape that a cube's symmetries leave apart, and a distance. Wrong candidates
make spheres that do not meet, places outside the cube and wrong speeds. Candidates are a fixed
list: a task tries blocks of early readings with all of them and hands on sums, and windows of speed
meet only those that can still be the best.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import geometry, motion, windows
from trackloom.session import cut, ship_package

#: Early readings of each pilot, distances of the first list, metres that a relative
#: error of speed costs, seconds of a speed window, and when a second candidate is too near.
EARLY, DISTANCES, SPEED_COST = 10, 48, 10_000.0
WINDOW_S, WINDOW_MOST_S, LEAST_SPEED = 10.0, 14.0, 300.0
NEAR_RATIO, NEAR_METRES = 1.5, 500.0
#: Distances between two neighbours of the first list that the second list tries.
FINER = 32
#: Early readings that a task is dealt, and pairs of a reading and a candidate that numpy takes at once.
TASK_READINGS, AT_ONCE = 1 << 15, 1 << 13


def shapes() -> list[tuple[int, int, int]]:
    """The first ordered triple of corners for each triple of side lengths."""
    apart = lambda a, b: (a ^ b).bit_count()  # corners are bits of x, y and z
    first: dict[tuple, tuple[int, int, int]] = {}
    for t in itertools.permutations(range(8), 3):
        first.setdefault((apart(t[0], t[1]), apart(t[0], t[2]), apart(t[1], t[2])), t)
    return list(first.values())


def places(shape: Column, distance: Column, side: float) -> tuple[geometry.Vec, ...]:
    """The three observers of a shape's number at a distance from the centre."""
    known = shapes()
    out = []
    for i in range(3):
        corner = F.element_at(F.array(*[F.lit(t[i]) for t in known]), shape + 1)
        signs = [F.when(corner.bitwiseAND(1 << axis) > 0, 1.0).otherwise(-1.0) for axis in range(3)]
        out.append(tuple(F.lit(side / 2) + s * distance / math.sqrt(3.0) for s in signs))
    return tuple(out)


def _ranges(before: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{before}d_{x}") for x in "abc")


def _named(rows: DataFrame, name: str, points: tuple[geometry.Vec, ...]) -> tuple[DataFrame, tuple[geometry.Vec, ...]]:
    """``rows`` with the points' numbers as columns, worked out once, and the points of these."""
    made = {f"__{name}{i}{a}": c for i, p in enumerate(points) for a, c in zip("xyz", p)}
    return rows.withColumns(made), tuple(tuple(F.col(f"__{name}{i}{a}") for a in "xyz") for i in range(len(points)))


def _off(d: np.ndarray, shape: np.ndarray, distance: np.ndarray, side: float) -> np.ndarray:
    """(readings, candidates): the residual of ranges ``d`` and how far the nearer root is outside the
    cube. What only depends on the candidate is worked out once; see geometry.trilaterate."""
    corner = np.array(shapes())[shape]
    at = side / 2 + np.where(corner[..., None] >> np.arange(3) & 1, 1.0, -1.0) * distance[:, None, None] / math.sqrt(3.0)
    first, u, w = at[:, 0].T, (at[:, 1] - at[:, 0]).T, (at[:, 2] - at[:, 0]).T
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    uu, uw, ww = dot(u, u), dot(u, w), dot(w, w)
    det, normal = uu * ww - uw * uw, np.cross(u, w, axis=0)
    normal, squared = normal / np.sqrt(dot(normal, normal)), d * d
    a, b = ((squared[:, :1] - squared[:, i : i + 1] + x) / 2 for i, x in ((1, uu), (2, ww)))
    on_u, on_w = (a * ww - b * uw) / det, (b * uu - a * uw) / det
    foot = [p * on_u + q * on_w for p, q in zip(u, w)]
    height = np.sqrt(np.maximum(squared[:, :1] - dot(foot, foot), 0.0))
    up, down = ([p + (x + s * n * height) for p, x, n in zip(first, foot, normal)] for s in (1.0, -1.0))
    miss = [np.sqrt(sum((x - p) ** 2 for x, p in zip(up, at[:, i].T))) - d[:, i : i + 1] for i in range(3)]
    over = [np.sqrt(sum(np.maximum(np.maximum(-x, x - side), 0.0) ** 2 for x in root)) for root in (up, down)]
    return np.sqrt(sum(x * x for x in miss) / 3) + np.minimum(*over)


def _starts(early: DataFrame, best: DataFrame | None, ratio: float, least: float, side: float) -> DataFrame:
    """match, shape, distance, start of each match's candidates, which are those of the first list, or
    around its ``best`` ones: the mean over ``early`` readings of the residual and of how far the nearer
    root is outside the cube. A batch's readings of a match are summed up where they are tried."""
    ship_package(early.sparkSession)
    cores, n = early.sparkSession.sparkContext.defaultParallelism, len(shapes())
    tasks = cores * max(1, -(-early.count() // (cores * TASK_READINGS)))
    # both fixed lists are Spark's own numbers
    listed = lambda x, first, last: np.array([r[0] for r in early.sparkSession.range(first, last).orderBy("id").select(x).collect()])
    fixed = np.repeat(np.arange(n), DISTANCES), np.tile(listed(least * F.exp(ratio * F.col("id")), 0, DISTANCES), n)
    finer, again = listed(F.exp(ratio * F.col("id") / FINER), -FINER, FINER + 1), best is not None
    if again:
        early = early.join(best.groupBy("match").agg(F.sort_array(F.collect_list(F.struct("shape", "__from"))).alias("__best")), "match")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(float) for c in ("d_a", "d_b", "d_c")], 1)
            codes = pc.dictionary_encode(batch["match"], null_encoding="encode").indices.to_numpy()
            for code in np.unique(codes):
                at = np.flatnonzero(codes == code)
                shape, distance = fixed
                if again:
                    known = batch["__best"][at[0]].as_py()
                    shape = np.repeat([x["shape"] for x in known], len(finer))
                    distance = (np.array([x["__from"] for x in known])[:, None] * finer).ravel()
                step = max(1, AT_ONCE // len(shape))
                total = sum(_off(d[at[i : i + step]], shape, distance, side).sum(0) for i in range(0, len(at), step))
                match = batch["match"].take(pa.array(np.repeat(at[:1], len(shape))))
                yield pa.RecordBatch.from_arrays([match, pa.array(shape.astype(np.int32)), pa.array(distance), pa.array(total), pa.array(np.full(len(shape), len(at)))], names=["match", "shape", "distance", "total", "n"])

    schema = f"match {early.schema['match'].dataType.simpleString()}, shape int, distance double, total double, n long"
    sums = early.repartition(tasks).mapInArrow(work, schema)
    return sums.groupBy("match", "shape", "distance").agg((F.sum("total") / F.sum("n")).alias("start"))


def _totals(candidates: DataFrame, paced: DataFrame, side: float) -> DataFrame:
    """``candidates`` with cost: start and SPEED_COST times the upper median over windows of how far the
    pace is from the mean of the speeds read, as a share of it. A window's ends are on one side of the
    observers' plane."""
    by = ["match", "shape", "distance"]
    rows, at = _named(paced.join(candidates.select(*by), "match"), "at", places(F.col("shape"), F.col("distance"), side))
    rows, (here, there) = _named(rows, "end", (geometry.trilaterate(at, _ranges())[0], geometry.trilaterate(at, _ranges("__"))[0]))
    error = F.abs(geometry.norm(geometry.sub(there, here)) / F.col("__s") - F.col("__told")) / F.col("__told")
    # cut, so that no filter of the medians is worked out below the places
    speeds = windows.medians(cut(rows.select(*by, error.alias("error"))), by, "error").select(*by, F.col("upper").alias("error"))
    return candidates.join(speeds, by, "left").withColumn("cost", F.col("start") + SPEED_COST * F.coalesce("error", F.lit(0.0))).drop("error")


def _cheapest(starts: DataFrame, paced: DataFrame, side: float) -> DataFrame:
    """match, shape, cost, distance: each shape's best of the candidates of ``starts``. Speeds
    only add to a cost, so after the candidate of least start only those that start no dearer than
    its whole cost are timed: the result is that of timing all."""
    starts = cut(starts)
    least = starts.groupBy("match", "shape").agg(F.min(F.struct("start", "distance")).alias("m")).select("match", "shape", "m.distance", "m.start")
    first = cut(_totals(least, paced, side))
    bound = first.select("match", "shape", F.col("cost").alias("__most"), F.col("distance").alias("__done"))
    open_ = starts.join(bound, ["match", "shape"]).filter((F.col("start") <= F.col("__most")) & (F.col("distance") != F.col("__done"))).select(*starts.columns)
    both = first.unionByName(_totals(open_, paced, side))
    return both.groupBy("match", "shape").agg(F.min(F.struct("cost", "distance")).alias("m")).select("match", "shape", "m.cost", "m.distance")


def _windows(whole: DataFrame) -> DataFrame:
    """match, the ranges of a reading and of the first one WINDOW_S later, the seconds between them
    and the mean of the speeds read from one to the other."""
    keyed = whole.withColumn("__key", F.to_json(F.struct("match", "pilot"))).select("__key", "match", "us", "d_a", "d_b", "d_c", "speed")
    pairs = motion.speed_windows(keyed, "__key", "us", ["d_a", "d_b", "d_c"], "speed", int(WINDOW_S * 1e6), int(WINDOW_MOST_S * 1e6))
    seconds = ((F.col("to.us") - F.col("us")) / 1e6).alias("__s")
    return pairs.filter(F.col("mean") >= LEAST_SPEED).select("match", "d_a", "d_b", "d_c", *[F.col(f"to.d_{x}").alias(f"__d_{x}") for x in "abc"], seconds, F.col("mean").alias("__told"))


def infer(readings: DataFrame, side: float, least: float, most: float) -> DataFrame:
    """match, shape, distance, cost, runner_up, ambiguous from readings (match, pilot, t, d_a, d_b,
    d_c, speed), of which only complete ones count. Each shape's distance is the best of a list of
    DISTANCES between ``least`` and ``most``, then of a finer one around it. ambiguous: the second
    shape's cost is within NEAR_RATIO or NEAR_METRES of the first's."""
    whole = readings.filter(F.col("d_a").isNotNull() & F.col("d_b").isNotNull() & F.col("d_c").isNotNull()).withColumn("us", F.round(F.col("t") * 1e6).cast("long"))
    early = windows.top_per_group(whole, ["match", "pilot"], [F.col("us"), *_ranges()], EARLY).select("match", "d_a", "d_b", "d_c").transform(cut)
    paced = cut(_windows(whole))
    ratio = math.log(most / least) / (DISTANCES - 1)
    best = cut(_cheapest(_starts(early, None, ratio, least, side), paced, side)).select("match", "shape", F.col("distance").alias("__from"))
    total = _cheapest(_starts(early, best, ratio, least, side), paced, side)
    ranked = total.withColumn("k", F.row_number().over(Window.partitionBy("match").orderBy("cost", "shape"))).filter("k <= 2")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    out = ranked.groupBy("match").agg(pick(1, "shape").alias("shape"), pick(1, "distance").alias("distance"), pick(1, "cost").alias("cost"), pick(2, "cost").alias("runner_up"))
    near = (F.col("runner_up") < NEAR_RATIO * F.col("cost")) | (F.col("runner_up") - F.col("cost") < NEAR_METRES)
    return out.withColumn("ambiguous", F.coalesce(near, F.lit(False)))
