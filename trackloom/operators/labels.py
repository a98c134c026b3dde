"""Which of a roster's pilots a label on the screen belongs to, by name, type and range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators import fuzzy
from trackloom.session import cut

#: The share of a range and the metres that two readings of it may differ by, the
#: characters an edit is allowed for, and what another type and another range cost.
RANGE_SHARE, RANGE_METRES, PER_EDIT, OTHER_TYPE, OTHER_RANGE = 0.1, 3_000.0, 5, 2, 1


def name_edits(label: Column, name: Column) -> Column:
    """Edits between a label and a name, either of which may be cut off, in lower case; up to two
    characters before the name in the label are free, and any number after it."""
    a, b = F.lower(label), F.lower(name)
    n = F.least(F.length(a), F.length(b))
    return F.least(F.levenshtein(a, b), F.levenshtein(F.substring(a, F.lit(1), n), F.substring(b, F.lit(1), n)), fuzzy.infix_edits(b, a))


def allowed(label: Column, name: Column, per_edit: int = PER_EDIT) -> Column:
    return F.floor(F.least(F.length(label), F.length(name)) / per_edit)


def types_agree(a: Column, b: Column) -> Column:
    """Whether two types, either of which may be cut off, are one; unread types agree with none."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.coalesce((x != "") & (y != "") & (F.startswith(x, y) | F.startswith(y, x)), F.lit(False))


def ranges_agree(m: Column, ranges: Column) -> Column:
    """Whether a label's range is near one of a pilot's ranges; null if it or all of them are unread."""
    near = F.exists(ranges, lambda r: F.abs(m - r) <= F.greatest(RANGE_SHARE * r, F.lit(RANGE_METRES)))
    return F.when(m.isNotNull() & (F.size(ranges) > 0), near)


def _step(m: Column) -> Column:
    """Steps of a range: ranges that agree are two steps apart at most."""
    turn = RANGE_METRES / RANGE_SHARE
    far = 1 / RANGE_SHARE + F.log(F.greatest(m, F.lit(turn)) / turn) / F.log(F.lit(1 / (1 - RANGE_SHARE)))
    return F.floor(F.when(m < turn, m / RANGE_METRES).otherwise(far)).cast("int")


def _shared(n: Column) -> Column:
    """Characters in a row that names share if they are near and the shorter one has ``n``: of the
    parts that its edits leave, one stays whole."""
    return F.when(n >= 6, 3).when(n >= 4, 2).otherwise(1)


def _grams(name: Column, own: bool, more: bool) -> Column:
    """Keys of a name: its runs of as many characters as ``_shared`` says (``own``), and of fewer for
    shorter partners (``more``)."""
    s, n = F.lower(name), F.length(name)
    sizes = F.filter(F.sequence(F.lit(1), F.lit(3)), lambda q: ((q == _shared(n)) & F.lit(own)) | ((q < _shared(n)) & F.lit(more)))
    cuts = lambda q: F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.concat(q.cast("string"), F.substring(s, i, q)))
    return F.array_distinct(F.flatten(F.transform(sizes, cuts)))


def near_names(labels: DataFrame, pilots: DataFrame, match: str) -> DataFrame:
    """match, label, pilot, edits of names within their tolerance: an edit for five characters of the
    shorter one, one at least. Names meet by runs of characters that such pairs share, never all."""
    a, b = labels.select(match, "label").distinct().filter(F.length("label") >= 3), pilots.select(match, "pilot").distinct().filter(F.length("pilot") >= 2)

    def meet(own: bool, more: bool, theirs_own: bool, theirs_more: bool) -> DataFrame:
        left = a.withColumn("__g", F.explode(_grams(F.col("label"), own, more)))
        return left.join(b.withColumn("__g", F.explode(_grams(F.col("pilot"), theirs_own, theirs_more))), [match, "__g"]).select(match, "label", "pilot")

    pairs = meet(True, False, True, True).union(meet(False, True, True, False)).distinct()
    pairs = pairs.withColumn("edits", name_edits(F.col("label"), F.col("pilot")))
    return pairs.filter(F.col("edits") <= F.greatest(F.lit(1), allowed(F.col("label"), F.col("pilot"))))


def snapped_types(rows: DataFrame, kind: str, known: DataFrame, name: str) -> DataFrame:
    """``rows`` with types replaced by the known ones that they are misread or cut from."""
    found = fuzzy.resolve_types(rows.filter(F.col(kind).isNotNull()), known, kind, name).select(kind, F.col("resolved").alias("__to"))
    return rows.join(found, kind, "left").withColumn(kind, F.coalesce("__to", kind)).select(*rows.columns)


def match_labels(labels: DataFrame, seen: DataFrame, keys: list[str], slot: str) -> DataFrame:
    """keys, slot, label, pilot (null if none or more than one fits) of labels (keys, slot, label,
    kind, range_m) and of what was seen of pilots in the same frame (keys, pilot, kind, range_m: one
    row an observer; of several types the greatest counts). ``keys`` begin with the match.

    A label belongs to the pilot at the least cost, if only one has it: edits of near names (see
    ``near_names``), and more for another type or range. Where no name is near, the only pilot within
    half the shorter name's length whose type and range agree; labels of two characters, the only one
    that begins with them and agrees so. Shorter labels, null ones and pilots of one character match
    nothing; repeated rows count once."""
    match, by = keys[0], [*keys, slot]
    asked = labels.select(*by, "label", F.col("kind").alias("__kind"), F.col("range_m").cast("double").alias("__m")).dropDuplicates(by)
    known = seen.filter(F.length("pilot") >= 2).groupBy(*keys, "pilot").agg(F.max("kind").alias("kind"), F.collect_set(F.col("range_m").cast("double")).alias("ranges"))
    same = types_agree(F.col("__kind"), F.col("kind"))
    cost = F.col("edits") + OTHER_TYPE * (~same).cast("int") + OTHER_RANGE * F.coalesce(~ranges_agree(F.col("__m"), F.col("ranges")), F.lit(False)).cast("int")
    scored = asked.join(near_names(labels, seen, match), [match, "label"]).join(known, [*keys, "pilot"]).select(*by, F.struct(cost.alias("cost"), "pilot").alias("c"))
    first = scored.groupBy(*by).agg(F.array_sort(F.collect_list("c")).alias("__c"))  # a frame's near pilots
    top, next_ = F.get("__c", F.lit(0)), F.get("__c", F.lit(1))
    only = F.when(F.coalesce(next_["cost"] > top["cost"], F.lit(True)), top["pilot"])
    rows = cut(asked.join(first.select(*by, only.alias("__near"), F.lit(True).alias("__any")), by, "left"))
    left = rows.filter(F.col("__any").isNull() & (F.length("label") >= 2) & F.col("__m").isNotNull()).withColumn("__s", F.explode(F.sequence(_step(F.col("__m")) - 2, _step(F.col("__m")) + 2)))
    right = known.withColumn("__r", F.explode("ranges")).withColumn("__s", _step(F.col("__r")))
    fits = same & (F.abs(F.col("__m") - F.col("__r")) <= F.greatest(RANGE_SHARE * F.col("__r"), F.lit(RANGE_METRES)))
    begins = F.startswith(F.lower("pilot"), F.lower("label"))
    half = name_edits(F.col("label"), F.col("pilot")) <= allowed(F.col("label"), F.col("pilot"), 2)
    loose = left.join(right, [*keys, "__s"]).filter(fits).filter(F.when(F.length("label") == 2, begins).otherwise(half)).select(*by, "pilot").distinct()
    loose = loose.groupBy(*by).agg(F.min("pilot").alias("__loose"), F.count(F.lit(1)).alias("__n")).filter("__n = 1")
    return rows.join(loose, by, "left").select(*by, "label", F.coalesce("__near", "__loose").alias("pilot"))
