"""Interval algebra over rows with a start and an end (half-open, integer microseconds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import windows


def hold(points: DataFrame, us: str, length: int) -> DataFrame:
    """Each point as a span [t, t + length)."""
    return points.withColumn("t0", F.col(us)).withColumn("t1", F.col(us) + length)


def fold(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and touching spans of a key as one, with their number."""
    rows = windows.carried(spans, keys, "t0", [F.col("t1")], {"__reach": ("max", F.col("t1"))}, exclusive=True)
    new = F.when(F.col("__reach").isNull() | (F.col("t0") > F.col("__reach")), 1).otherwise(0)
    # only a span's first row begins a group, so each group has the number of those so far
    numbered = windows.carried(rows, keys, "t0", [F.col("t1"), F.coalesce("__reach", F.lit(-(1 << 62)))], {"__group": ("sum", new)})
    return numbered.groupBy(*keys, "__group").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count(F.lit(1)).alias("n_points")).drop("__group")


def clip(spans: DataFrame, low: int, high: int) -> DataFrame:
    """The spans' parts inside [low, high)."""
    return spans.withColumn("t0", F.greatest("t0", F.lit(low))).withColumn("t1", F.least("t1", F.lit(high))).filter("t0 < t1")


def stab(instants: DataFrame, spans: DataFrame, at: str, bucket: int, on: list[str] | None = None) -> DataFrame:
    """Pairs of an instant and each span that holds it (t0 <= t < t1): spans are dealt to the time
    buckets that they touch, and the join is an equi-join on bucket (and ``on``)."""
    on = on or []
    a = instants.withColumn("__bucket", F.floor(F.col(at) / bucket).cast("long"))
    b = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("t0") / bucket).cast("long"), F.floor((F.col("t1") - 1) / bucket).cast("long"))))
    return a.join(b, [*on, "__bucket"]).filter((F.col("t0") <= F.col(at)) & (F.col(at) < F.col("t1"))).drop("__bucket")


def overlaps(spans: DataFrame, key: str, id_: str, bucket: int, slack: int = 0) -> DataFrame:
    """Pairs a < b of a key's spans that overlap (or lie within ``slack``), with the shared length.
    A pair is made only in the first bucket that both touch."""
    wide = spans.select(key, F.col(id_).alias("id"), "t0", "t1").withColumn("__first", F.floor((F.col("t0") - slack) / bucket).cast("long"))
    dealt = wide.withColumn("__bucket", F.explode(F.sequence(F.col("__first"), F.floor((F.col("t1") + slack) / bucket).cast("long"))))
    a = dealt.select(key, "__bucket", F.col("id").alias("a"), F.col("t0").alias("a0"), F.col("t1").alias("a1"), F.col("__first").alias("fa"))
    b = dealt.select(key, "__bucket", F.col("id").alias("b"), F.col("t0").alias("b0"), F.col("t1").alias("b1"), F.col("__first").alias("fb"))
    joined = a.join(b, [key, "__bucket"]).filter((F.col("a") < F.col("b")) & (F.col("__bucket") == F.greatest("fa", "fb")) & (F.col("a0") < F.col("b1") + slack) & (F.col("b0") < F.col("a1") + slack))
    return joined.select(key, "a", "b", (F.least("a1", "b1") - F.greatest("a0", "b0")).alias("shared"))


def runs(df: DataFrame, key: str, order: list[str], holds: str) -> DataFrame:
    """Maximal runs of successive rows for which ``holds`` is true: key, first, last, length. The
    first of ``order`` is the time."""
    rows = df.withColumn("__j", F.when(F.expr(holds), 0).otherwise(1))
    rows = windows.carried(rows, [key], order[0], [F.col(c) for c in order[1:]], {"__g": ("sum", F.col("__j"))}).filter("__j = 0")
    return rows.groupBy(key, "__g").agg(F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"), F.count(F.lit(1)).alias("length")).drop("__g")


def picked(asked: DataFrame, pairs: DataFrame, key: str, which: str, nth: str) -> DataFrame:
    """Of each key the pairs that it asks for: the ``which``-th (by ``nth``, from 1), all for 0, the only
    one for null. A key that can't have them has one row with reason (none: it has no pairs, several:
    it must say which, no such: it has fewer); reason is null otherwise."""
    counts = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    told = asked.select(key, F.col(which).alias("__which")).distinct().join(counts, key, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    w = F.col("__which")
    reason = F.when(F.col("__n") == 0, "none").when(w.isNull() & (F.col("__n") > 1), "several").when((w < 0) | (w > F.col("__n")), "no such")
    told = told.withColumn("reason", reason)
    rows = told.filter("reason IS NULL").join(pairs, key).filter(w.isNull() | (w == 0) | (w == F.col(nth)))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in pairs.schema if f.name != key]
    return rows.select(*pairs.columns, "reason").unionByName(told.filter("reason IS NOT NULL").select(key, *missing, "reason"))
