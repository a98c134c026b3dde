"""Fuzzy resolution of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bigrams(s: Column) -> Column:
    n = F.length(s)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Twice the bigrams of ``a`` that ``b`` has over all bigrams, in lower case; equal strings have 1."""
    x, y = bigrams(F.lower(a)), bigrams(F.lower(b))
    shared = F.size(F.filter(x, lambda g: F.array_contains(y, g)))
    total = F.size(x) + F.size(y)
    return F.when(F.lower(a) == F.lower(b), F.lit(1.0)).when(total == 0, F.lit(0.0)).otherwise(2.0 * shared / total)


def within_edits(left: DataFrame, right: DataFrame, a: str, b: str, most: int = 1) -> DataFrame:
    """Pairs with at most ``most`` edits. A string cut into most + 1 parts shares one of them, at a
    shift of at most ``most``, with any partner, so parts are equi-join keys and no side is crossed."""
    parts = most + 1

    def cut(s: Column) -> Column:
        n = F.length(s)
        return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.struct(i.alias("i"), F.substring(s, F.floor(i * n / parts).cast("int") + 1, F.floor((i + 1) * n / parts).cast("int") - F.floor(i * n / parts).cast("int")).alias("p"), n.alias("n")))

    def windows(s: Column) -> Column:
        """Parts that a partner of each possible length would share, at each shift."""
        n = F.length(s)
        lengths = F.filter(F.sequence(n - most, n + most), lambda m: m >= 0)
        one = lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda d: F.struct(i.alias("i"), F.substring(s, F.greatest(F.floor(i * m / parts).cast("int") + 1 + d, F.lit(1)), F.floor((i + 1) * m / parts).cast("int") - F.floor(i * m / parts).cast("int")).alias("p"), m.alias("n")))))
        return F.array_distinct(F.flatten(F.transform(lengths, one)))

    x = left.select(F.col(a)).distinct().withColumn("__k", F.explode(cut(F.col(a))))
    y = right.select(F.col(b)).distinct().withColumn("__k", F.explode(windows(F.col(b))))
    pairs = x.join(y, "__k").select(a, b).distinct()
    return pairs.withColumn("edits", F.levenshtein(F.col(a), F.col(b), most)).filter(F.col("edits") >= 0)


def _candidates(asked: DataFrame, roster: DataFrame, name: str, known: str) -> DataFrame:
    """Pairs that may be equal, begin alike, or reach 0.8 by Dice's measure. For the last, at least
    two thirds of a name's bigrams must be the entry's, so one of its rarest third and one more is:
    frequent bigrams bring no pairs."""
    a, b = F.lower(name), F.lower(known)
    key = lambda kind, c: F.concat(F.lit(kind), c)
    grams = roster.select(known, F.explode(F.array_distinct(bigrams(b))).alias("__g"))
    frequent = grams.groupBy("__g").agg(F.count(F.lit(1)).alias("__f"))
    own = asked.select(name, F.size(bigrams(a)).alias("__n"), F.explode(F.array_distinct(bigrams(a))).alias("__g")).join(frequent, "__g", "left")
    rarest = own.groupBy(name, "__n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("__f", F.lit(0)).alias("f"), F.col("__g").alias("g")))).alias("__r"))
    rare = rarest.select(name, F.explode(F.slice("__r", F.lit(1), F.floor(F.col("__n") / 3).cast("int") + 1)).alias("__x"))
    left = rare.select(name, key("g", F.col("__x.g")).alias("__t"))
    for kind, c in (("=", a), ("^", F.when(F.length(name) >= 3, F.substring(a, 1, 3)))):
        left = left.union(asked.select(name, key(kind, c).alias("__t")))
    right = grams.select(known, key("g", F.col("__g")).alias("__t"))
    for kind, c in (("=", b), ("^", F.substring(b, 1, 3))):
        right = right.union(roster.select(known, key(kind, c).alias("__t")))
    return left.join(right, "__t").select(name, known).distinct()


def resolve(names: DataFrame, roster: DataFrame, name: str, known: str) -> DataFrame:
    """Each distinct name's roster entry: equal but for case, else the only one that it begins (3
    characters at least), else the best by Dice's measure from 0.8 on, the greatest of equals; null
    if none. No name meets the whole roster."""
    asked, entries = names.select(name).distinct(), roster.select(known).distinct()
    pairs = _candidates(asked, entries, name, known)
    a, b = F.lower(name), F.lower(known)
    scored = pairs.withColumn("__same", a == b).withColumn("__begins", (F.length(name) >= 3) & F.startswith(b, a)).withColumn("__dice", dice(F.col(name), F.col(known)))
    best = scored.groupBy(name).agg(
        F.max(F.when(F.col("__same"), F.col(known))).alias("exact"),
        F.sum(F.col("__begins").cast("int")).alias("n_begins"),
        F.max(F.when(F.col("__begins"), F.col(known))).alias("begins"),
        F.max(F.when(F.col("__dice") >= 0.8, F.struct("__dice", known))).alias("near"),
    )
    found = best.select(name, F.coalesce("exact", F.when(F.col("n_begins") == 1, F.col("begins")), F.col(f"near.{known}")).alias("resolved"))
    return asked.join(found, name, "left")


def resolve_types(readings: DataFrame, known: DataFrame, reading: str, name: str) -> DataFrame:
    """Each distinct reading with status (exact, corrected, ambiguous, unknown), resolved and edits.

    A reading is compared with each name and with the name's beginnings of about its length, since
    readings are cut off; one edit is allowed, two from ten characters on, none under four. Several
    names at the least distance are ambiguous. Names and beginnings meet readings by shared parts.
    """
    asked, names = readings.select(reading).distinct(), known.select(name).distinct()
    n = F.length(name)
    starts = F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.substring(F.col(name), F.lit(1), i))).otherwise(F.array().cast("array<string>"))
    forms = names.withColumn("__form", F.explode(F.array_distinct(F.concat(F.array(F.col(name)), starts))))
    fuzzy = asked.filter(F.length(reading) >= 4)
    near = within_edits(fuzzy, forms, reading, "__form", 2).filter(F.col("edits") <= F.when(F.length(reading) >= 10, 2).otherwise(1))
    scored = near.join(forms, "__form").groupBy(reading, name).agg(F.min("edits").alias("edits"))
    best = scored.groupBy(reading, "edits").agg(F.count(F.lit(1)).alias("n"), F.max(name).alias("other")).groupBy(reading).agg(F.min(F.struct("edits", "n", "other")).alias("b"))
    exact = names.select(F.col(name).alias(reading), F.lit(True).alias("__exact"))
    rows = asked.join(exact, reading, "left").join(best, reading, "left")
    same, one = F.col("__exact").isNotNull(), F.col("b.n") == 1
    status = F.when(same, "exact").when(one, "corrected").when(F.col("b.n") > 1, "ambiguous").otherwise("unknown")
    return rows.select(reading, status.alias("status"), F.when(same, F.col(reading)).when(one, F.col("b.other")).alias("resolved"), F.when(same, F.lit(0)).when(one, F.col("b.edits")).alias("edits"))


def infix_edits(needle: Column, hay: Column, skipped: int = 2) -> Column:
    """Fewest edits from ``needle`` to a part of ``hay`` that begins within its first ``skipped``
    characters; what follows the part is free."""
    parts = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.length(hay) - s, F.lit(0))), lambda n: F.levenshtein(needle, F.substring(hay, s + 1, n)))
    return F.array_min(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(skipped)), parts)))
