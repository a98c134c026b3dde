"""Pairs of points in space, stretches near a plane, and matches of files and teams."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import geometry, intervals
from trackloom.session import cut


def within(points: DataFrame, id_: str, at: list[str], radius: float, on: list[str] | None = None) -> DataFrame:
    """Pairs a < b of points (of equal ``on``) at most ``radius`` apart, with their distance. Points
    are dealt to cubic cells of that edge and meet those of the 27 cells around."""
    on = on or []
    cell = [F.floor(F.col(c) / radius).cast("long") for c in at]
    own = points.select(*on, F.col(id_).alias("a"), *at, *[c.alias(f"__c{i}") for i, c in enumerate(cell)])
    near = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    other = points.select(*on, F.col(id_).alias("b"), *[F.col(c).alias(f"__{c}") for c in at], *[c.alias(f"__c{i}") for i, c in enumerate(cell)])
    for i in range(len(at)):
        other = other.withColumn("__d", F.explode(near)).withColumn(f"__c{i}", F.col(f"__c{i}") + F.col("__d")).drop("__d")
    d = geometry.norm(geometry.sub(tuple(F.col(c) for c in at), tuple(F.col(f"__{c}") for c in at)))
    pairs = own.join(other, [*on, *[f"__c{i}" for i in range(len(at))]]).filter(F.col("a") < F.col("b")).withColumn("distance", d)
    return pairs.filter(F.col("distance") <= radius).select(*on, "a", "b", "distance")


def nearest(pairs: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Of pairs (a, b, distance): each point's nearest other one, of equals the least."""
    on = on or []
    both = pairs.select(*on, "a", "b", "distance").union(pairs.select(*on, F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    best = both.groupBy(*on, "a").agg(F.min(F.struct("distance", "b")).alias("__m"))
    return best.select(*on, "a", F.col("__m.b").alias("nearest"), F.col("__m.distance").alias("distance"))


def plane_exits(fixes: DataFrame, key: str, us: str, offset: str, slope: str, band: float, steep: float) -> DataFrame:
    """Where a track may have left along the observers' plane: of each maximal stretch within
    ``band`` of it, the fix of least |offset| / band + |slope| / steep, if its slope is less than
    ``steep``. A stretch that the track ends in is left out."""
    rows = fixes.withColumn("__inside", F.abs(offset) < band)
    runs = intervals.runs(rows, key, [us], "__inside")
    ends = fixes.groupBy(key).agg(F.max(us).alias("__end"))
    closed = runs.join(ends, key).filter(F.col("last_at") < F.col("__end")).select(key, F.col("first_at").alias("t0"), (F.col("last_at") + 1).alias("t1"))
    inside = rows.filter("__inside").select(key, us, offset, slope)
    hits = intervals.stab(inside, closed, us, 86_400_000_000, [key])
    cost = F.abs(offset) / band + F.abs(slope) / steep
    best = hits.groupBy(key, "t0").agg(F.min(F.struct(cost.alias("cost"), F.col(us).alias("us"), F.col(slope).alias("slope"))).alias("__m"))
    kept = best.filter(F.abs("__m.slope") < steep)
    n = F.row_number().over(Window.partitionBy(key).orderBy("t0"))
    return kept.select(key, "t0", F.col("__m.us").alias("exit_us"), F.col("__m.cost").alias("cost"), n.cast("long").alias("exit_id"))


def flipped(fixes: DataFrame, chosen: Column, at: list[str], flat: tuple) -> DataFrame:
    """Fixes after ``chosen`` ones were mirrored in a plane."""
    mirrored = geometry.reflect(tuple(F.col(c) for c in at), flat)
    return fixes.withColumns({c: F.when(chosen, m).otherwise(F.col(c)) for c, m in zip(at, mirrored)})


def plane_of(text: Column) -> tuple:
    """The plane that a text such as "0.6 0.8 0 1500" names: its normal and how far along it it lies."""
    part = F.split(F.trim(text), " +")
    normal = tuple(F.get(part, F.lit(i)).try_cast("double") for i in range(3))
    return tuple(c * F.get(part, F.lit(3)).try_cast("double") for c in normal), normal


def exit_flipped(rows: DataFrame, pilot: Column, exit_id: Column) -> DataFrame:
    """Positions (pilot, x_m, y_m, z_m, dir_x, dir_y, dir_z, plane_exit, plane_exit_id, plane) after one
    exit of a pilot was flipped: its rows' places, to whole metres, and directions, to four decimals,
    are mirrored in their own plane, and cw becomes ccw, anything else cw. Other rows, and rows that
    name no plane, stay as they are; a row without a direction gets none."""
    chosen = F.coalesce((F.col("pilot") == pilot) & (F.col("plane_exit_id") == exit_id) & (F.trim("plane") != ""), F.lit(False))
    point, normal = plane_of(F.col("plane"))
    place = geometry.reflect(tuple(F.col(c) for c in ("x_m", "y_m", "z_m")), (point, normal))
    way = geometry.reflect(tuple(F.col(c) for c in ("dir_x", "dir_y", "dir_z")), (geometry.vec(0, 0, 0), normal))
    new = {c: F.round(v) for c, v in zip(("x_m", "y_m", "z_m"), place)} | {c: F.round(v, 4) for c, v in zip(("dir_x", "dir_y", "dir_z"), way)}
    new["plane_exit"] = F.when(F.col("plane_exit") == "cw", "ccw").otherwise("cw")
    return rows.withColumns({c: F.when(chosen, v).otherwise(F.col(c)) for c, v in new.items()})


def paired(files: DataFrame, audio: DataFrame, name: str) -> DataFrame:
    """Each file's audio: of the same name, else the only one left with the same trailing number,
    where no other file left has that number."""
    number = lambda c: F.nullif(F.regexp_extract(c, "([0-9]+)$", 1), F.lit("")).try_cast("long")
    sound = audio.select(F.col(name).alias("audio"))
    same = files.join(sound, F.col(name) == F.col("audio"), "left")
    left = same.filter(F.col("audio").isNull()).select(name)
    rest = sound.join(files.select(F.col(name).alias("audio")), "audio", "left_anti")
    single = lambda df, c: df.withColumn("__n", number(F.col(c))).filter("__n IS NOT NULL").groupBy("__n").agg(F.count(F.lit(1)).alias("__k"), F.max(c).alias(c)).filter("__k = 1").drop("__k")
    second = single(left, name).join(single(rest, "audio"), "__n").select(name, F.col("audio").alias("__second"))
    return same.join(second, name, "left").select(*files.columns, F.coalesce("audio", "__second").alias("audio"))


def greedy_pairs(overlaps: DataFrame, group: str, old: str, new: str, weight: str) -> DataFrame:
    """One-to-one pairs of each group in order of weight (of equals the lower old, then new): a pair
    is taken if neither side is yet. In rounds, pairs that come first for both of their sides are
    taken and the others of these sides dropped; what is left has the same order."""
    rank = F.struct((-F.col(weight)).alias("w"), F.col(old).alias("o"), F.col(new).alias("n"))
    left, taken = cut(overlaps.select(group, old, new, weight)), []
    while not left.isEmpty():
        firsts = left.withColumn("__r", rank)
        for side in (old, new):
            firsts = firsts.withColumn(f"__{side}", F.min("__r").over(Window.partitionBy(group, side)))
        won = cut(firsts.filter((F.col("__r") == F.col(f"__{old}")) & (F.col("__r") == F.col(f"__{new}"))).select(group, old, new, weight))
        taken.append(won)
        left = cut(left.join(won.select(group, old), [group, old], "left_anti").join(won.select(group, new), [group, new], "left_anti"))
    return functools.reduce(DataFrame.unionByName, taken) if taken else left
