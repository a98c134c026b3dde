"""Votes, counters, multiset merges and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators import windows


def mode(df: DataFrame, key: str, value: str, weight: Column | None = None) -> DataFrame:
    """The value with most votes (or weight) of each key; ties go to the greatest value. Votes are
    counted by (key, value) first, so a large key is spread."""
    votes = df.groupBy(key, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("votes"))
    best = votes.groupBy(key).agg(F.max(F.struct("votes", value)).alias("b"))
    return best.select(key, F.col(f"b.{value}").alias(value), F.col("b.votes").alias("votes"))


def multiset_union(df: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """Rows that several sources report, each as often as the source that reports it most."""
    each = df.groupBy(source, *keys).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*keys).agg(F.max("n").alias("multiplicity"))


def unambiguous(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once: clashing readings are left out. One aggregation, one scan."""
    rest = [c for c in df.columns if c not in keys]
    once = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest)).alias("__row")).filter("__n = 1")
    return once.select(*keys, "__row.*").select(*df.columns)


def prefix_rollup(df: DataFrame, path: str, measures: dict[str, Column], separator: str = "/") -> DataFrame:
    """Measures of every ancestor folder of the paths; '' is the grand total."""
    parts = F.split(path, separator)
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
    return df.withColumn("folder", F.explode(prefixes)).groupBy("folder").agg(*[c.alias(n) for n, c in measures.items()])


def covered_share(df: DataFrame, key: str, us: str, most: int) -> DataFrame:
    """Of each key: span, the sum of gaps between rows (those longer than ``most`` count as missing),
    and their ratio."""
    rows = windows.carried(df.select(key, us), [key], us, [], {"__before": ("last", F.col(us))}, exclusive=True)
    gap = F.col(us) - F.col("__before")
    out = rows.groupBy(key).agg((F.max(us) - F.min(us)).alias("span_us"), F.coalesce(F.sum(F.when(gap <= most, gap)), F.lit(0)).alias("covered_us"))
    return out.withColumn("coverage", F.when(F.col("span_us") > 0, F.col("covered_us") / F.col("span_us")))


def data_issues(samples: DataFrame, ends: DataFrame, most: int, ships: int, share: float = 0.5) -> DataFrame:
    """match, pilot, ship, issue, figure of samples (match, pilot, us, ship, hp, pod) and of the times at
    which pilots were out (match, pilot, end_us). Of a match (pilot null): "ships", fewer pilots than
    ``ships``, and "no hp", none known. Of a pilot, from the match's first sample to the end, in per
    cent: "positions", time covered below ``share`` (gaps over ``most`` are missing), and "hp", samples
    of a ship whose hit points are known below it (only where the match knows any). Pilots that were
    out at the first sample have none; ship is the one of the first sample."""
    by = ["match", "pilot"]
    rows = windows.carried(samples.select(*by, "us", "ship", "hp", "pod"), by, "us", [], {"__before": ("last", F.col("us"))}, exclusive=True)
    each = samples.groupBy(*by).agg(F.min("us").alias("__first"), F.max("us").alias("__last"), F.count("hp").alias("__hp"))
    whole = each.groupBy("match").agg(F.min("__first").alias("__from"), F.max("__last").alias("__to"), F.count(F.lit(1)).alias("__ships"), (F.sum("__hp") > 0).alias("__known"))
    out = ends.groupBy(*by).agg(F.min("end_us").alias("__end"))
    rows = rows.join(whole, "match").join(out, by, "left").withColumn("__end", F.least("__to", F.coalesce("__end", "__to"))).filter(F.col("__end") > F.col("__from"))
    gap = F.greatest(F.least("us", "__end") - F.greatest("__before", "__from"), F.lit(0))
    counted = (F.col("us") <= F.col("__end")) & ~F.coalesce("pod", F.lit(False))
    found = rows.groupBy(*by, "__from", "__end", "__known").agg(
        F.min_by("ship", F.struct("us", "ship")).alias("ship"),
        F.coalesce(F.sum(F.when(F.col("us") - F.col("__before") <= most, gap)), F.lit(0)).alias("__covered"),
        F.count_if(counted).alias("__n"),
        F.count_if(counted & F.col("hp").isNotNull()).alias("__n_hp"),
    )
    placed, known = F.col("__covered") / (F.col("__end") - F.col("__from")), F.try_divide("__n_hp", "__n")
    issue = lambda name, bad, figure: F.when(bad, F.struct(F.lit(name).alias("issue"), figure.cast("long").alias("figure")))
    listed = lambda *x: F.explode(F.filter(F.array(*x), lambda y: y.isNotNull())).alias("__i")
    pilots = found.select(*by, "ship", listed(issue("positions", placed < share, F.round(placed * 100)), issue("hp", F.col("__known") & (known < share), F.round(known * 100))))
    matches = whole.select("match", listed(issue("ships", F.col("__ships") < ships, F.col("__ships")), issue("no hp", ~F.col("__known"), F.lit(0))))
    matches = matches.select("match", F.lit(None).cast(samples.schema["pilot"].dataType).alias("pilot"), F.lit(None).cast("string").alias("ship"), "__i")
    return pilots.unionByName(matches).select(*by, "ship", "__i.issue", "__i.figure")


def valued_copies(df: DataFrame, group: str, item: str, base: Column, step: Column) -> DataFrame:
    """Points of a group's items where each further copy of an item costs ``step`` more: an item
    with c copies has c * base + step * c * (c - 1) / 2."""
    copies = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("copies"), F.first(base).alias("base"), F.first(step).alias("step"))
    points = F.col("copies") * F.col("base") + F.col("step") * F.col("copies") * (F.col("copies") - 1) / 2
    return copies.groupBy(group).agg(F.sum("copies").alias("n_items"), F.sum(points).alias("points"))
