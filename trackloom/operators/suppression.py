"""Greedy choice of the best of overlapping marks, and walks along chains of builds."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.session import cut


def suppressed(marks: DataFrame, keys: list[str], at: list[str], score: str, tie: str, reach: float) -> DataFrame:
    """The marks that a greedy choice keeps: by score, highest first (of equals the least ``tie``), a
    mark is kept if none kept before lies less than ``reach`` from it along every axis of ``at``. ``tie``
    is a mark's own.

    Of marks at one place only the first in that order counts: what drops it drops the others. Then
    in rounds: of what is left, marks that come first among all within reach are kept and those within
    reach of them drop out, which keeps the order's choice. Marks lie in cells of ``reach``, all of one
    cell within reach of each other, so only each cell's first may be kept and a mark meets at most
    those of the cells around, however many share its cell. A row of marks each just better than the
    next takes a round for every two, so rows that would chain far are cut by ``keys``. Marks with an
    unknown key or place meet none and are kept."""
    names, cells = [*keys, *at, score, tie], [f"__c{i}" for i in range(len(at))]
    rank = F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))
    unknown = functools.reduce(lambda a, b: a | b, [*[F.col(c).isNull() for c in (*keys, *at)], *[F.isnan(F.col(c).cast("double")) for c in at]])
    marks = marks.select(*names)
    placed = marks.filter(~unknown).groupBy(*keys, *at).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"), F.col(score).alias("score"))).alias("__m"))
    placed = placed.select(*keys, *at, F.col("__m.score").alias(score), F.col("__m.t").alias(tie))
    left, kept = cut(placed.withColumns({c: F.floor(F.col(a) / reach).cast("long") for c, a in zip(cells, at)})), [cut(marks.filter(unknown))]

    def around(chosen: DataFrame) -> DataFrame:
        """What is left with each of the ``chosen`` marks (as __ columns) within reach of it."""
        near = chosen.select(*keys, *cells, *[F.col(c).alias(f"__{c}") for c in at], F.col(tie).alias("__tie"), rank.alias("__rank"))
        for c in cells:
            near = near.withColumn("__d", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(c, F.col(c) + F.col("__d")).drop("__d")
        within = functools.reduce(lambda a, b: a & b, [F.abs(F.col(c) - F.col(f"__{c}")) < reach for c in at])
        return left.join(near, [*keys, *cells]).filter(within)

    while not left.isEmpty():
        fields = [c for c in names if c not in keys]
        firsts = left.groupBy(*keys, *cells).agg(F.min(F.struct(rank.alias("rank"), *[F.col(c).alias(f"f{i}") for i, c in enumerate(fields)])).alias("__m"))
        firsts = cut(firsts.select(*keys, *cells, *[F.col(f"__m.f{i}").alias(c) for i, c in enumerate(fields)]))
        beaten = around(firsts).filter(rank < F.col("__rank")).select(F.col("__tie").alias(tie)).distinct()
        won = cut(firsts.join(beaten, tie, "left_anti"))
        kept.append(won.select(*names))
        left = cut(left.join(around(won).select(tie).distinct(), tie, "left_anti"))
    return functools.reduce(DataFrame.unionByName, kept)


def builds_between(lists: DataFrame, ours: int, latest: int, most: int = 60) -> DataFrame | None:
    """Builds whose change lists lead from ``latest`` back to ``ours`` (the first at or before it),
    ``latest`` included; none if ours is not older. None if a list is missing, does not lead back, or
    more than ``most`` are needed, as then the whole catalogue has to be read.

    ``lists``: build, before. Jumps double each round, so 2^k lists take k rounds: each build knows
    how far its jump leads and the set of builds is what the jumps from ``latest`` touch."""
    if latest <= ours:
        return lists.select("build").limit(0)
    jump = cut(lists.filter((F.col("build") > ours) & (F.col("build") <= latest)).groupBy("build").agg(F.max("before").alias("to")))
    reached = jump.filter(F.col("build") == latest).select("build")
    if reached.isEmpty():
        return None
    for _ in range(most.bit_length()):
        ahead = reached.join(jump, "build").select(F.col("to").alias("build")).filter((F.col("build") > ours) & (F.col("build") > 0))
        reached = cut(reached.union(ahead).distinct())
        further = jump.select(F.col("build").alias("to"), F.col("to").alias("further"))
        jump = cut(jump.join(further, "to", "left").select("build", F.coalesce("further", "to").alias("to")))
    seen = reached.join(lists.select("build", "before"), "build", "left")
    bad = seen.filter(F.col("before").isNull() | (F.col("before") <= 0) | (F.col("before") >= F.col("build")))
    if not bad.isEmpty() or reached.count() > most:
        return None
    return reached


def changed_since(changes: DataFrame, ours: int, latest: int, most: int = 60) -> DataFrame | None:
    """Distinct keys (kind, key, how) that changed in the builds between; None as in builds_between.
    ``changes``: build, before, kind, key, how; a list without keys has one row with null ones."""
    builds = builds_between(changes.select("build", "before").distinct(), ours, latest, most)
    if builds is None:
        return None
    return changes.join(builds, "build", "left_semi").filter(F.col("key").isNotNull()).select("kind", "key", "how").distinct()
