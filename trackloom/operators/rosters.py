"""Rosters from names as they were read: spellings of one name, pilots across observers, types that
only change once."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import fuzzy, windows
from trackloom.session import cut


def _led(rows: DataFrame, near: DataFrame) -> DataFrame:
    """m, r, leader (a name or null) of rows (m, r, f) in the order of r, a struct with a name. A row
    goes to the nearest leader before it (of equals the earlier one) among ``near`` names (a, of the
    row; b, of the leader; d); with none, it leads itself if it may (f).

    Leaders come in rounds: of the rows that may lead, those with no undecided earlier one near do;
    those near a leader do not."""
    later = rows.select("m", F.col("r").alias("t"), F.col("f").alias("t_may"), F.col("r.name").alias("a"))
    earlier = rows.filter("f").select("m", F.col("r").alias("p"), F.col("r.name").alias("b"))
    edges = cut(later.join(near, "a").join(earlier, ["m", "b"]).filter(F.col("p") < F.col("t")).select("m", "t", "t_may", "p", "d"))
    # rows that nothing earlier is near lead from the start and take no part in the rounds
    met = edges.filter("t_may").select("m", "t").distinct()
    alone = rows.filter("f").select("m", F.col("r").alias("t")).join(met, ["m", "t"], "left_anti")
    new, left, leaders = cut(alone), edges.filter("t_may").select("m", "t", "p"), []
    open_ = cut(met)
    while True:
        leaders.append(new)
        lost = left.join(new.select("m", F.col("t").alias("p")), ["m", "p"], "left_semi").select("m", "t").distinct()
        open_ = cut(open_.join(new, ["m", "t"], "left_anti").join(lost, ["m", "t"], "left_anti"))
        if open_.isEmpty():
            break
        left = cut(left.join(open_, ["m", "t"], "left_semi").join(open_.select("m", F.col("t").alias("p")), ["m", "p"], "left_semi"))
        new = cut(open_.join(left.select("m", "t"), ["m", "t"], "left_anti"))
    found = functools.reduce(DataFrame.unionByName, leaders)
    joined = edges.join(found.select("m", F.col("t").alias("p")), ["m", "p"], "left_semi").groupBy("m", "t").agg(F.min(F.struct("d", "p")).alias("best"))
    own = found.select("m", "t", F.lit(True).alias("leads"))
    out = rows.select("m", F.col("r").alias("t")).join(joined, ["m", "t"], "left").join(own, ["m", "t"], "left")
    return out.select("m", F.col("t").alias("r"), F.when(F.col("leads"), F.col("t.name")).otherwise(F.col("best.p.name")).alias("leader"))


def cluster_names(readings: DataFrame, keys: list[str], name: str, time: str) -> DataFrame:
    """keys, name, leader: names in the order in which they appear; one goes to the leader equal to
    it, else to the nearest within one edit (of equals the earlier one), else leads itself."""
    first = readings.groupBy(*keys, name).agg(F.min(time).alias("t"))
    rows = cut(first.select(F.struct(*keys).alias("m"), F.struct("t", F.col(name).alias("name")).alias("r"), F.lit(True).alias("f")))
    names = rows.select("r.name").distinct()
    near = fuzzy.within_edits(names.withColumnRenamed("name", "a"), names.withColumnRenamed("name", "b"), "a", "b", 1).filter("a <> b")
    return _led(rows, near.select("a", "b", F.col("edits").alias("d"))).select("m.*", F.col("r.name").alias(name), "leader")


def founds(name: Column, samples: Column, frames: Column, hulls: Column) -> Column:
    """Whether a track may found a pilot: 3 characters or more, distances in 5 % of the frames and 3
    at least, and not the name of a hull (``hulls``: whether it is one)."""
    return (F.length(name) >= 3) & (samples >= F.greatest(F.lit(3), F.floor(frames * 0.05))) & ~hulls


def merge_rosters(tracks: DataFrame, match: str, observer: str, name: str, samples: str, may_found: str) -> DataFrame:
    """match, observer, name, pilot of each track (one an observer and name), longest first (of
    equals by observer and name). A track goes to the nearest pilot founded before it within 2 edits,
    1 for pilots' names under 6 characters (of equals to the earlier one); else it founds one if it
    may, else it has none.

    Names meet by shared parts."""
    rank = F.struct((-F.col(samples)).alias("n"), F.col(observer).alias("o"), F.col(name).alias("name"))
    rows = cut(tracks.select(F.col(match).alias("m"), rank.alias("r"), F.col(may_found).alias("f")))
    names = rows.select("r.name").distinct()
    near = fuzzy.within_edits(names.withColumnRenamed("name", "a"), names.withColumnRenamed("name", "b"), "a", "b", 2).select("a", "b").distinct()
    near = near.withColumn("d", F.levenshtein("a", "b")).filter(F.col("d") <= F.when(F.length("b") >= 6, 2).otherwise(1))
    return _led(rows, near).select(F.col("m").alias(match), F.col("r.o").alias(observer), F.col("r.name").alias(name), F.col("leader").alias("pilot"))


def locked_types(readings: DataFrame, track: str, time: str, kind: str, tie: str, last: str, start: int = 3) -> DataFrame:
    """track, locked (the type seen most in its first ``start`` readings, of equals the greatest),
    lost_at (the first later reading of ``last``), conflicts (later readings of any other type
    before that). Only the first readings are ranked; the later ones are those after the last of them."""
    at = F.struct(time, tie)
    first = windows.top_per_group(readings.select(track, time, tie, kind), track, [F.col(time), F.col(tie)], start)
    votes = first.groupBy(track, kind).agg(F.count(F.lit(1)).alias("__n"), F.max(at).alias("__to"))
    locked = votes.groupBy(track).agg(F.max_by(kind, F.struct("__n", kind)).alias("locked"), F.max("__to").alias("__to"))
    later = readings.select(track, time, tie, kind).join(locked, track).filter(at > F.col("__to"))
    lost = later.filter((F.col(kind) == last) & (F.col("locked") != last)).groupBy(track).agg(F.min(time).alias("lost_at"))
    odd = later.join(lost, track, "left").filter((F.col(kind) != F.col("locked")) & (F.col("lost_at").isNull() | (F.col(time) < F.col("lost_at"))))
    counts = odd.groupBy(track).agg(F.count(F.lit(1)).alias("conflicts"))
    return locked.join(lost, track, "left").join(counts, track, "left").select(track, "locked", "lost_at", F.coalesce("conflicts", F.lit(0)).cast("long").alias("conflicts"))


def hidden_names(rows: DataFrame, frame: str, slot: str, pilot: str) -> DataFrame:
    """Rows of a frame without a name, with the slots of the named ones around them (from_slot,
    to_slot; null at an end) and their number, run by run."""
    w = Window.partitionBy(frame).orderBy(slot)
    before = F.last(F.when(F.col(pilot).isNotNull(), F.col(slot)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(F.when(F.col(pilot).isNotNull(), F.col(slot)), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    marked = rows.withColumns({"from_slot": before, "to_slot": after}).filter(F.col(pilot).isNull())
    return marked.groupBy(frame, "from_slot", "to_slot").agg(F.min(slot).alias("first_slot"), F.count(F.lit(1)).alias("n_hidden"))


def recovered(rows: DataFrame, expected: DataFrame, frame: str, slot: str, pilot: str, kind: str) -> DataFrame:
    """frame, slot, pilot of hidden rows between two named ones, where as many expected pilots (rank,
    pilot, kind in the list's order) lie between these names as rows are hidden, and each row's type
    is the expected one or unread. A frame whose named rows are out of the list's order gives none."""
    rank = expected.select(F.col(pilot).alias("__p"), F.col("rank").alias("__rank"), F.col(kind).alias("__kind"))
    named = rows.filter(F.col(pilot).isNotNull()).join(rank, F.col(pilot) == F.col("__p")).select(frame, slot, "__rank")
    order = Window.partitionBy(frame).orderBy(slot)
    bad = named.withColumn("__l", F.lag("__rank").over(order)).filter(F.col("__l") >= F.col("__rank")).select(frame).distinct()
    runs = hidden_names(rows, frame, slot, pilot).filter("from_slot IS NOT NULL AND to_slot IS NOT NULL").join(bad, frame, "left_anti")
    low = named.select(frame, F.col(slot).alias("from_slot"), F.col("__rank").alias("__lo"))
    high = named.select(frame, F.col(slot).alias("to_slot"), F.col("__rank").alias("__hi"))
    full = runs.join(low, [frame, "from_slot"]).join(high, [frame, "to_slot"]).filter(F.col("__hi") - F.col("__lo") - 1 == F.col("n_hidden"))
    spread = full.select(frame, F.posexplode(F.sequence(F.col("__lo") + 1, F.col("__hi") - 1)).alias("__i", "__rank"), (F.col("from_slot") + 1 + F.col("__i")).alias(slot), "from_slot")
    filled = spread.join(rank, "__rank").join(rows.select(frame, slot, F.col(kind).alias("__seen")), [frame, slot])
    agrees = F.min((F.col("__seen").isNull() | (F.col("__seen") == F.col("__kind"))).cast("int")).over(Window.partitionBy(frame, "from_slot"))
    return filled.withColumn("__ok", agrees).filter("__ok = 1").select(frame, slot, F.col("__p").alias(pilot))
