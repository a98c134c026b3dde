"""Positions between samples, hops, starts and losses of tracks.

Samples are rows (keys, us, value columns); times are integer microseconds. Each sample's segment to
the next one carries the neighbours that a spline needs, so a point in time meets one segment by an
as-of join. Tracks of few rows run whole, longer ones in buckets (``windows.by_length``).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators import geometry, intervals, windows


def hops(samples: DataFrame, key: str, us: str, at: list[str], tie: str, length: float, tolerance: float, gap: int) -> DataFrame:
    """hop: whether a sample lies ``length`` (within ``tolerance``) from the one before it, not
    across a pause longer than ``gap``; and the distance as step."""
    rows = windows.row_framed(samples, key, us, tie, 1, {f"__{c}": lambda w, c=c: F.lag(c).over(w) for c in (*at, us)})
    rows = rows.withColumn("step", geometry.norm(geometry.sub(tuple(F.col(c) for c in at), tuple(F.col(f"__{c}") for c in at))))
    near = (F.abs(F.col("step") - length) <= tolerance) & (F.col(us) - F.col(f"__{us}") <= gap)
    return rows.withColumn("hop", F.coalesce(near, F.lit(False))).drop(*[f"__{c}" for c in (*at, us)])


def cubic(pre: Column, start: Column, end: Column, post: Column, share: Column, pre_t: Column, end_t: Column, post_t: Column) -> Column:
    """The cubic through four values at times pre_t, 0, end_t and post_t, by pyramids of lines
    (Barry and Goldman), at ``share`` of the way from start to end."""
    lerp = lambda a, b, w: a + (b - a) * w
    safe = lambda num, den, other: F.when(den == 0, F.lit(other)).otherwise(num / den)
    t = end_t * share
    a1 = lerp(pre, start, safe(t - pre_t, -pre_t, 0.0))
    a2 = lerp(start, end, safe(t, end_t, 0.5))
    a3 = lerp(end, post, safe(t - end_t, post_t - end_t, 1.0))
    b1, b2 = lerp(a1, a2, safe(t - pre_t, end_t - pre_t, 0.0)), lerp(a2, a3, safe(t, post_t, 1.0))
    return lerp(b1, b2, safe(t, end_t, 0.5))


def segments(samples: DataFrame, key: str, us: str, columns: list[str], tie: str, hop: str | None = None, whole: bool = False) -> DataFrame:
    """Each sample with its neighbours: key, us, columns, and a struct seg of the next sample's time
    and values (t1, v1), those two back and two on (t0, v0, t2, v2), and whether the next, this one
    and the one after are hops. Keys are not dealt by rank if ``whole``."""
    flag = F.col(hop) if hop else F.lit(False)
    near = {f"t{n}": lambda w, i=i: F.lag(us, -i).over(w) for n, i in enumerate((-1, 1, 2))}
    values = {f"v{n}": lambda w, i=i: F.lag(F.struct(*columns), -i).over(w) for n, i in enumerate((-1, 1, 2))}
    jumps = {f"j{i + 1}": lambda w, i=i: F.coalesce(F.lag(flag, -i).over(w), F.lit(False)) for i in (0, 1, 2)}
    made = near | values | jumps
    rows = windows.row_framed(samples, key, us, tie, 2, {f"__{n}": c for n, c in made.items()}, whole)
    return rows.select(key, us, *columns, F.struct(*[F.col(f"__{n}").alias(n) for n in made]).alias("seg"))


def sampled(grid: DataFrame, samples: DataFrame, key: str, us: str, columns: list[str], tie: str, gap: int, smooth: bool = False, hop: str | None = None) -> DataFrame:
    """``grid`` with the columns at its times: a sample's own values where the grid hits one, else
    on the line, or the cubic if ``smooth``, to the next sample; null beyond the track's ends and in
    pauses longer than ``gap``. Before a hop the place of take-off holds. A cubic's missing
    neighbours (none, across a pause or a hop) are mirrored through the segment's end."""
    samples = samples.select(*dict.fromkeys([key, us, *columns, tie, *([hop] if hop else [])]))
    parts = [_sampled(g, s, key, us, columns, tie, gap, smooth, hop, tasks) for (s, g), tasks in windows.by_length(samples, [key], grid)]
    return functools.reduce(DataFrame.unionByName, parts)


def _sampled(grid: DataFrame, samples: DataFrame, key: str, us: str, columns: list[str], tie: str, gap: int, smooth: bool, hop: str | None, tasks: int) -> DataFrame:
    """``sampled``; with ``tasks`` keys are dealt to so many and run whole."""
    dealt = samples.repartition(tasks, key) if tasks else samples
    last = segments(dealt, key, us, columns, tie, hop, tasks > 0)
    both = windows.asof(grid, last, key, us, [*columns, "seg"], tasks=tasks)
    t, t0, t1, t2 = (x.cast("double") for x in (F.col("right_us"), F.col("seg.t0"), F.col("seg.t1"), F.col("seg.t2")))
    hit = F.col("right_us") == F.col(us)
    inside = t1.isNotNull() & (t1 - t <= gap)
    share = (F.col(us) - t) / (t1 - t)
    back = t0.isNotNull() & (t - t0 <= gap) & ~F.col("seg.j1")
    on = t2.isNotNull() & (t2 - t1 <= gap) & ~F.col("seg.j3")
    out = {}
    for c in columns:
        v, v0, v1, v2 = F.col(c), F.col(f"seg.v0.{c}"), F.col(f"seg.v1.{c}"), F.col(f"seg.v2.{c}")
        way = v + (v1 - v) * share
        if smooth:
            pre, post = F.when(back, v0).otherwise(v * 2 - v1), F.when(on, v2).otherwise(v1 * 2 - v)
            pre_t, post_t = F.when(back, t0 - t).otherwise(t - t1), F.when(on, t2 - t).otherwise((t1 - t) * 2)
            way = cubic(pre, v, v1, post, share, pre_t, t1 - t, post_t)
        out[c] = F.when(hit, v).when(inside, F.when(F.col("seg.j2"), v).otherwise(way))
    made = both.withColumns({f"__{c}": x for c, x in out.items()})
    return made.select(*grid.columns, *[F.col(f"__{c}").alias(c) for c in columns])


def velocity(grid: DataFrame, samples: DataFrame, key: str, us: str, value: str, tie: str, gap: int, half: int) -> DataFrame:
    """``grid`` with velocity: the change of ``value`` a second between ``half`` before and after,
    or from the instant itself on the side where there is no sample."""
    spread = grid.withColumn("__at", F.explode(F.array(*[F.lit(x) for x in (-half, 0, half)])))
    asked = spread.withColumn(us, F.col(us) + F.col("__at"))
    found = sampled(asked, samples, key, us, [value], tie, gap).withColumn(us, F.col(us) - F.col("__at"))
    at = lambda x: F.max(F.when(F.col("__at") == x, F.col(value)))
    rows = found.groupBy(*grid.columns).agg(at(-half).alias("__a"), at(0).alias("__b"), at(half).alias("__c"))
    first, last = F.coalesce("__a", "__b"), F.coalesce("__c", "__b")
    span = (F.when(F.col("__a").isNotNull(), half).otherwise(0) + F.when(F.col("__c").isNotNull(), half).otherwise(0)) / 1e6
    return rows.select(*grid.columns, F.when(span > 0, (last - first) / span).alias("velocity"))


def starts(samples: DataFrame, match: str, key: str, us: str, moving: Column, tie: str) -> DataFrame:
    """Each match's start: the time of the sample before any ship's first move (moving, of samples
    with one before them)."""
    rows = windows.carried(samples.withColumn("__moving", moving), [match, key], us, [F.col(tie)], {"__before": ("last", F.col(us))}, exclusive=True)
    return rows.filter(F.col("__moving") & F.col("__before").isNotNull()).groupBy(match).agg(F.min("__before").alias("start_us"))


def first_leaving(samples: DataFrame, key: str, us: str, at: list[str], tie: str, radius: float) -> DataFrame:
    """Each key's first way out of the sphere about the origin: key, left_us (at the crossing, or the
    sample's own time where the track begins outside), x, y, z. The sample outside and the one before
    it are a minimum and a maximum, so no key is sorted."""
    here = tuple(F.col(c) for c in at)
    sample = F.struct(us, tie, *at)
    first = samples.filter(geometry.norm(here) > radius).groupBy(key).agg(F.min(sample).alias("__out"))
    earlier = samples.join(first, key).filter(sample < F.col("__out")).groupBy(key).agg(F.max(sample).alias("__in"))
    rows = first.join(earlier, key, "left")
    before, after = (tuple(F.col(f"{s}.{c}") for c in at) for s in ("__in", "__out"))
    begins = F.col("__in").isNull()
    rows = rows.withColumn("__share", F.when(begins, F.lit(1.0)).otherwise(F.coalesce(geometry.crossing(before, after, radius), F.lit(1.0))))
    way = lambda a, b: F.when(begins, b).otherwise(a + (b - a) * F.col("__share"))
    place = [way(a, b).alias(n) for a, b, n in zip(before, after, "xyz")]
    return rows.select(key, way(F.col(f"__in.{us}"), F.col(f"__out.{us}")).alias("left_us"), *place)


def frozen_pods(samples: DataFrame, key: str, us: str, tie: str, kind: str, capsule: str, blank: list[str]) -> DataFrame:
    """Samples with pod: a track ends at its first capsule after another ship, and that sample, the
    only one with pod true, keeps none of the ``blank`` columns. Tracks of capsules alone stay whole."""
    rows = windows.carried(samples, [key], us, [F.col(tie)], {"__kind": ("last", F.col(kind))}, exclusive=True)
    at = F.struct(us, tie)
    first = rows.filter((F.col(kind) == capsule) & (F.col("__kind") != capsule)).groupBy(key).agg(F.min(at).alias("__end"))
    kept = samples.join(first, key, "left").filter(F.col("__end").isNull() | (at <= F.col("__end"))).withColumn("pod", F.coalesce(at == F.col("__end"), F.lit(False)))
    return kept.withColumns({c: F.when(~F.col("pod"), F.col(c)) for c in blank}).select(*samples.columns, "pod")


def first_loss(events: DataFrame, key: str, us: str, kind: str, losses: list[str]) -> DataFrame:
    """The earliest of each key's events of the kinds that end a ship."""
    return events.filter(F.col(kind).isin(*losses)).groupBy(key).agg(F.min(us).alias("lost_us"), F.min_by(kind, F.struct(us, kind)).alias("by"))


def match_seconds(us: Column, origin: Column) -> Column:
    """Seconds of the match at a time of day."""
    return (us - origin) / 1e6


def clock_us(seconds: Column, origin: Column) -> Column:
    return origin + F.round(seconds * 1e6).cast("long")


def speed_windows(samples: DataFrame, key: str, us: str, take: list[str], told: str, least: int, most: int, readings: int = 5) -> DataFrame:
    """Samples with to (a struct of ``us`` and the ``take`` columns of the first sample ``least`` or more
    later, ``most`` at the most) and mean (of the speeds read from one to the other, ``readings`` of
    them at least). Of samples at one time a window ends at the least by its columns."""
    there = lambda w: F.min(F.struct(us, *take)).over(w.rangeBetween(least, most))
    speeds = lambda w: F.collect_list(F.when(F.col(told).isNotNull(), F.struct(F.col(us).alias("t"), F.col(told).alias("v")))).over(w.rangeBetween(0, most))
    rows = windows.framed(samples, key, us, 0, most, {"to": there, "__all": speeds}).filter(F.col("to").isNotNull())
    within = F.transform(F.filter("__all", lambda x: x["t"] <= F.col(f"to.{us}")), lambda x: x["v"])
    rows = rows.withColumn("__v", within).filter(F.size("__v") >= readings)
    mean = F.try_divide(F.aggregate("__v", F.lit(0.0), lambda a, x: a + x), F.size("__v"))
    return rows.withColumn("mean", mean).drop("__all", "__v")


def speed_errors(samples: DataFrame, key: str, us: str, at: list[str], told: str, least: int, most: int, unit: int, readings: int = 5, slowest: float = 300.0) -> DataFrame:
    """key, n_windows, error: how far the pace over each window (see ``speed_windows``) whose speeds
    have a mean of ``slowest`` or more is from that mean, as a share of it; the upper median. Means meet
    ``slowest`` to nine decimals, so that one equal to it counts in whatever order its speeds are added."""
    rows = speed_windows(samples.select(key, us, *at, told), key, us, at, told, least, most, readings).filter(F.round("mean", 9) >= slowest)
    way = geometry.norm(geometry.sub(tuple(F.col(f"to.{c}") for c in at), tuple(F.col(c) for c in at)))
    pace = way / ((F.col(f"to.{us}") - F.col(us)) / unit)
    errors = rows.select(key, F.try_divide(F.abs(pace - F.col("mean")), F.col("mean")).alias("error"))
    return windows.medians(errors, [key], "error").select(key, F.col("n").alias("n_windows"), F.col("upper").alias("error"))


def re_entries(samples: DataFrame, key: str, us: str, outside: str, least: int, capsule: str | None = None) -> DataFrame:
    """key, out_us, back_us: runs of samples outside (``outside`` true; null, between the limits,
    leaves a run as it is) and the sample back inside after them, ``least`` or more after the first; a
    run that the track ends in has none. What follows a key's first ``capsule`` (true) counts no more."""
    rows = samples.select(key, us, F.col(outside).alias("__out"), *([F.col(capsule).alias("__pod")] if capsule else []))
    if capsule:
        lost = rows.filter("__pod").groupBy(key).agg(F.min(us).alias("__lost"))
        rows = rows.join(lost, key, "left").filter(F.col("__lost").isNull() | (F.col(us) < F.col("__lost")))
    rows = rows.filter(F.col("__out").isNotNull()).select(key, us, "__out")
    runs = intervals.runs(rows, key, [us], "__out")
    inside = rows.filter(~F.col("__out")).select(key, F.col(us).alias("__at"))
    after = windows.asof(runs.withColumnRenamed("last_at", "__at"), inside, key, "__at", [], ahead=True)
    return after.filter(F.col("right_us") - F.col("first_at") >= least).select(key, F.col("first_at").alias("out_us"), F.col("right_us").alias("back_us"))
