"""Rates and activity at given instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import intervals, windows

#: Parts that asked instants are dealt to.
PARTS = 16


def by_source(points: DataFrame, instants: DataFrame, target: str, source: str, value: str, width: int, unit: int, least: float) -> DataFrame:
    """At each instant (instant), each target's rate of ``value`` by source over (instant - width, instant], per
    ``unit``, from ``least`` on, with its place and the target's total. A point counts while an
    instant lies in [t, t + width), so points meet instants by time buckets."""
    spans = intervals.hold(points.select(target, source, value, "us"), "us", width)
    hits = intervals.stab(instants, spans, "instant", width)
    rates = hits.groupBy("instant", target, source).agg((F.sum(value) / (width / unit)).alias("__rate")).filter(F.col("__rate") >= least)
    rate = F.round("__rate", 4)
    w = Window.partitionBy("instant", target)
    ranked = rates.withColumn("place", F.row_number().over(w.orderBy(rate.desc(), source)).cast("long")).withColumn("total", F.round(F.sum("__rate").over(w), 4))
    return ranked.select("instant", target, source, rate.alias("rate"), "place", "total")


def active_with_count(points: DataFrame, instants: DataFrame, keys: list[str], length: int, tie: str) -> DataFrame:
    """At each instant (instant), each key's spans [t, t + length) that hold it, and how many began so far."""
    counted = windows.running(points, keys, "us", tie, {"__n": ("count", None)})
    spans = intervals.hold(counted, "us", length)
    hits = intervals.stab(instants, spans, "instant", length)
    return hits.groupBy("instant", *keys).agg(F.count(F.lit(1)).alias("active"), F.max("__n").alias("so_far"))


def live_view(points: DataFrame, instants: DataFrame, key: str, kind: str, value: str, width: int, unit: int) -> DataFrame:
    """Each key at each instant: hp and last_kind (of its latest point), rate per ``unit`` and kinds
    over (instant - width, instant]."""
    # the instants asked for are dealt to parts, and every key meets each part
    users = points.select(key).distinct().withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    asked = instants.select(F.col("instant").alias("us"), F.pmod(F.xxhash64("instant"), F.lit(PARTS)).cast("int").alias("__part"))
    grid = users.join(asked, "__part").select(key, "us")
    last = windows.asof(grid, points.select(key, "us", F.col(value).alias("hp"), F.col(kind).alias("last_kind")), key, "us", ["hp", "last_kind"]).withColumnRenamed("us", "instant")
    hits = intervals.stab(instants, intervals.hold(points.select(key, kind, value, "us"), "us", width), "instant", width)
    rate = hits.groupBy("instant", key, kind).agg(F.sum(value).alias("__s")).groupBy("instant", key).agg((F.sum("__s") / (width / unit)).alias("rate"), F.count(F.lit(1)).alias("kinds"))
    out = last.join(rate, ["instant", key], "left")
    return out.select(key, "instant", "hp", "last_kind", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("kinds", F.lit(0)).cast("long").alias("kinds"))
