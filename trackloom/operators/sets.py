"""Manifest algebra: differences of three versions, moves, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def three_way(base: DataFrame, local: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """What a sync has to do for each key: same, push, pull or conflict, by null-safe comparison
    (null: the side lacks it). One full join of each pair on the key."""
    named = [d.select(key, F.col(value).alias(n)) for d, n in ((base, "base"), (local, "local"), (remote, "remote"))]
    rows = named[0].join(named[1], key, "full").join(named[2], key, "full")
    here, there = ~F.col("local").eqNullSafe(F.col("base")), ~F.col("remote").eqNullSafe(F.col("base"))
    same = F.col("local").eqNullSafe(F.col("remote"))
    return rows.withColumn("action", F.when(same, "same").when(here & there, "conflict").when(here, "push").otherwise("pull"))


def moves(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """Content that left one key and came under another: content, from, to."""
    gone = before.join(after, [key, content], "left_anti").select(content, F.col(key).alias("from_key"))
    came = after.join(before, [key, content], "left_anti").select(content, F.col(key).alias("to_key"))
    return gone.join(came, content)
