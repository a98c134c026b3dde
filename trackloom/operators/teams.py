"""Teams of a match's pilots from where they start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLUE, RED = 0, 1


def _filled(rows: DataFrame, match: str, pilot: str, cap: int, pinned: Column | None = None) -> DataFrame:
    """Pilots without a team (not ``pinned``) join, by name, the team that has room once the other
    is full."""
    w = Window.partitionBy(match)
    free = F.col("team").isNull() & ~(pinned if pinned is not None else F.lit(False))
    n = {t: F.count_if(F.col("team") == t).over(w) for t in (BLUE, RED)}
    rows = rows.withColumns({"__b": n[BLUE], "__r": n[RED], "__free": free})
    rows = rows.withColumn("__n", F.when(F.col("__free"), F.row_number().over(Window.partitionBy(match, "__free").orderBy(pilot))))
    to_red = (F.col("__b") >= cap) & (F.col("__n") <= cap - F.col("__r"))
    to_blue = (F.col("__b") < cap) & (F.col("__r") >= cap) & (F.col("__n") <= cap - F.col("__b"))
    return rows.withColumn("team", F.when(to_red, RED).when(to_blue, BLUE).otherwise(F.col("team"))).drop("__b", "__r", "__free", "__n")


def assign(pilots: DataFrame, match: str, pilot: str, corner: str, distance: str, cap: int) -> DataFrame:
    """``pilots`` with team: the two corners with most pilots (of equals the lower) are BLUE and RED
    in their order, other pilots have none. A team's pilots over ``cap`` that are furthest from
    their line move to the other while it has room; then pilots without a team fill it up."""
    sizes = pilots.filter(F.col(corner).isNotNull()).groupBy(match, corner).agg(F.count(F.lit(1)).alias("__n"))
    first = sizes.withColumn("__k", F.row_number().over(Window.partitionBy(match).orderBy(F.desc("__n"), corner))).filter("__k <= 2")
    named = first.withColumn("team", F.row_number().over(Window.partitionBy(match).orderBy(corner)) - 1).select(match, corner, "team")
    rows = pilots.join(named, [match, corner], "left")
    w = Window.partitionBy(match)
    rows = rows.withColumns({f"__{t}": F.count_if(F.col("team") == t).over(w) for t in (BLUE, RED)})
    far = F.row_number().over(Window.partitionBy(match, "team").orderBy(F.desc(distance), F.desc(pilot)))
    rows = rows.withColumn("__far", far)
    over = lambda a, b: F.least(F.col(f"__{a}") - cap, cap - F.col(f"__{b}"))
    moved = F.when((F.col("team") == BLUE) & (F.col("__far") <= over(BLUE, RED)), RED).when((F.col("team") == RED) & (F.col("__far") <= over(RED, BLUE)), BLUE)
    rows = rows.withColumn("team", F.coalesce(moved, "team")).select(*pilots.columns, "team")
    return _filled(rows, match, pilot, cap)


def settle(assigned: DataFrame, match: str, pilot: str, known: Column, override: Column, pinned: Column, cap: int) -> DataFrame:
    """The final team: by hand, else the season's, else the assigned one; then room is filled up.
    Pilots pinned to no team stay without one."""
    rows = assigned.withColumn("team", F.when(pinned, F.lit(None).cast("int")).otherwise(F.coalesce(override, known, F.col("team"))))
    return _filled(rows, match, pilot, cap, pinned)


def sides(teams: DataFrame, match: str, side: str, team: str) -> DataFrame:
    """Each side's season team: the one most of its known pilots are on (of equals the lower). Where
    both sides vote for one team, the side with fewer votes (of equals the second) takes its next
    best, or none. votes are those for the team taken."""
    votes = teams.filter(F.col(team).isNotNull()).groupBy(match, side, team).agg(F.count(F.lit(1)).alias("votes"))
    places = votes.withColumn("__k", F.row_number().over(Window.partitionBy(match, side).orderBy(F.desc("votes"), team))).filter("__k <= 2")
    at = lambda k: F.max(F.when(F.col("__k") == k, F.struct(F.col(team).alias("team"), "votes")))
    both = places.groupBy(match, side).agg(at(1).alias("__first"), at(2).alias("__second"))
    clash = F.row_number().over(Window.partitionBy(match, F.col("__first.team")).orderBy(F.desc("__first.votes"), side))
    taken = F.when(clash == 1, F.col("__first")).otherwise(F.col("__second"))
    return both.withColumn("__t", taken).select(match, side, F.col("__t.team").alias("team"), F.col("__t.votes").alias("votes"))
