"""Windows over per-key time series.

Bounded frames are cut at time buckets: a row also goes, as context, to the neighbouring buckets
that its frame's reach can touch, so one key's series is spread over many tasks however long it is.
Unbounded frames run within time buckets, and each bucket's result, one row, is carried on to the
later ones. Frames of rows are cut at ranks. Where ``by_length`` has parted keys of few rows from the
others, those need no cuts: they run whole. Times are integer microseconds.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.session import cut

#: Buckets are this many times as long as a frame's reach, so that few rows are context.
BUCKET_OF_REACH = 16
#: Microseconds of a bucket of unbounded frames, and rows of one of frames of rows.
CARRY_US, RANKS = 86_400_000_000, 1 << 16
#: Rows that a task is dealt where keys run whole.
TASK_ROWS = 1 << 18


def by_length(df: DataFrame, keys: list[str], *others: DataFrame) -> list[tuple[list[DataFrame], int]]:
    """``df`` and ``others`` (with the same keys) in parts, each with a number of tasks: keys with up to
    RANKS rows in all, which can run whole when dealt to so many tasks, and, with 0, the longer ones, if
    there are any. Keys are told apart by a hash; where two meet, both count as one, maybe a longer one."""
    of, all_ = F.xxhash64(*keys).alias("__h"), [df, *others]
    hashes = functools.reduce(DataFrame.unionAll, (d.select(of) for d in all_))
    counts = hashes.groupBy("__h").agg(F.count(F.lit(1)).alias("__n"))
    long = F.col("__n") > RANKS
    rows, some = counts.agg(F.sum("__n"), F.count_if(long)).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, -(-(rows or 0) // (cores * TASK_ROWS)))
    if not some:
        return [(all_, tasks)]
    found = F.broadcast(cut(counts.filter(long).select(F.col("__h").alias("__long"))))
    part = lambda how: [d.join(found, F.xxhash64(*[d[k] for k in keys]) == F.col("__long"), how) for d in all_]
    return [(part("left_anti"), tasks), (part("left_semi"), 0)]


def bucketed(df: DataFrame, key: str, us: str, before: int, after: int = 0) -> DataFrame:
    """Rows with __bucket and __own; copies with __own false serve frames that reach ``before``
    microseconds back and ``after`` ahead."""
    size = max(1, BUCKET_OF_REACH * max(before, after))
    at = lambda c: F.floor(c / F.lit(size)).cast("long")
    own = at(F.col(us))
    spread = F.explode(F.sequence(at(F.col(us) - after), at(F.col(us) + before)))
    return df.withColumn("__home", own).withColumn("__bucket", spread).withColumn("__own", F.col("__home") == F.col("__bucket")).drop("__home")


def framed(df: DataFrame, key: str, us: str, before: int, after: int, columns: dict[str, object]) -> DataFrame:
    """Columns over the frame of ``us`` from ``before`` back to ``after`` ahead (negative: it ends
    before the row); each of ``columns`` maps a window to a column."""
    rows = bucketed(df, key, us, before, max(0, after))
    w = Window.partitionBy(key, "__bucket").orderBy(us).rangeBetween(-before, after)
    return rows.withColumns({n: make(w) for n, make in columns.items()}).filter("__own").drop("__bucket", "__own")


def trailing_sum(df: DataFrame, key: str, us: str, value: str, width: int, name: str = "total") -> DataFrame:
    """Sum over the half-open window (t - width, t]; its rate is the sum over the width."""
    return framed(df, key, us, width - 1, 0, {name: lambda w: F.sum(value).over(w)})


def taking_hits(df: DataFrame, key: str, us: str, value: str, width: int) -> DataFrame:
    """trailing_max and last_known of ``value`` over [t - width, t)."""
    return framed(df, key, us, width, -1, {"trailing_max": lambda w: F.max(value).over(w), "last_known": lambda w: F.last(value, ignorenulls=True).over(w)})


def centred_slope(df: DataFrame, key: str, us: str, value: str, half: int, least: int = 3) -> DataFrame:
    """Least-squares slope of ``value`` a day over t - half .. t + half, null under ``least`` points."""
    day = 86_400_000_000.0
    return framed(df, key, us, half, half, {"n_points": lambda w: F.count(value).over(w), "__s": lambda w: F.regr_slope(F.col(value), F.col(us) / day).over(w)}).withColumn("slope", F.when(F.col("n_points") >= least, F.col("__s"))).drop("__s")


def carried(df: DataFrame, keys: list[str], us: str, order: list[Column], columns: dict[str, tuple[str, Column]], ahead: bool = False, exclusive: bool = False, size: int = CARRY_US, *, whole: bool = False) -> DataFrame:
    """Running sums, maxima or last known values (kinds sum, max, last) of each key's rows up to the
    row (without it if ``exclusive``), in time order; from the end on if ``ahead``. ``order`` breaks
    ties of ``us`` and reads upwards in the direction of the run. Keys run without buckets if ``whole``."""
    time = -F.col(us) if ahead else F.col(us)
    if whole:
        w = Window.partitionBy(*keys).orderBy(time, *order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        kinds = {"last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "max": F.max}
        return df.select("*", *[kinds[kind](c).over(w).alias(n) for n, (kind, c) in columns.items()])
    rows = df.withColumn("__bucket", F.floor(F.col(us) / F.lit(size)).cast("long")).withColumns({f"__in_{n}": c for n, (_, c) in columns.items()})
    scan = [time, *order]
    last_row = -1 if exclusive else 0
    local = Window.partitionBy(*keys, "__bucket").orderBy(*scan).rowsBetween(Window.unboundedPreceding, last_row)
    made, totals, before = {}, [], {}
    earlier = Window.partitionBy(*keys).orderBy(F.col("__bucket").desc() if ahead else F.col("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    for n, (kind, _) in columns.items():
        c = F.col(f"__in_{n}")
        if kind == "last":
            made[f"__at_{n}"] = F.last(c, ignorenulls=True).over(local)
            totals.append(F.max_by(c, F.when(c.isNotNull(), F.struct(*[x.alias(f"o{i}") for i, x in enumerate(scan)]))).alias(f"__of_{n}"))
            before[f"__to_{n}"] = F.last(f"__of_{n}", ignorenulls=True).over(earlier)
        else:
            f = {"sum": F.sum, "max": F.max}[kind]
            made[f"__at_{n}"] = f(c).over(local)
            totals.append(f(c).alias(f"__of_{n}"))
            before[f"__to_{n}"] = f(f"__of_{n}").over(earlier)
    carry = rows.groupBy(*keys, "__bucket").agg(*totals).withColumns(before).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__b"), *before)
    same = functools.reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys), F.col("__bucket") == F.col("__b"))
    both = rows.withColumns(made).join(carry, same, "left")
    out = {}
    for n, (kind, _) in columns.items():
        own, past = F.col(f"__at_{n}"), F.col(f"__to_{n}")
        if kind == "last":
            out[n] = F.coalesce(own, past)
        elif kind == "max":
            out[n] = F.greatest(own, past)
        else:
            out[n] = F.when(own.isNull(), past).when(past.isNull(), own).otherwise(own + past)
    return both.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def running(df: DataFrame, keys: list[str], us: str, tie: str, columns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """Running counts, sums and maxima of each key, the row included."""
    made = {n: ("sum", F.lit(1).cast("long")) if kind == "count" else (kind, c) for n, (kind, c) in columns.items()}
    return carried(df, keys, us, [F.col(tie)], made)


def row_framed(df: DataFrame, key: str, us: str, tie: str, half: int, columns: dict[str, object], whole: bool = False) -> DataFrame:
    """Columns over up to ``half`` rows on either side; each of ``columns`` maps a window in time
    order to a column. A key's rows are dealt by rank, with the rows that such a frame reaches, or
    not dealt if ``whole``."""
    if whole:
        w = Window.partitionBy(key).orderBy(us, tie)
        return df.withColumns({n: make(w) for n, make in columns.items()})
    rows = running(df, [key], us, tie, {"__rank": ("count", None)})
    at = lambda c: F.floor(c / F.lit(RANKS)).cast("long")
    dealt = rows.withColumn("__part", F.explode(F.array_distinct(F.array(at(F.col("__rank") - half), at(F.col("__rank")), at(F.col("__rank") + half)))))
    w = Window.partitionBy(key, "__part").orderBy("__rank")
    made = dealt.withColumns({n: make(w) for n, make in columns.items()})
    return made.filter(F.col("__part") == at(F.col("__rank"))).drop("__part", "__rank")


def hampel(df: DataFrame, key: str, us: str, value: str, half: int = 5, sigmas: float = 3.0, tie: str = "event_id") -> DataFrame:
    """Spike flags against the median of ``half`` rows on either side: more than ``sigmas`` times
    1.4826 MAD away; frames under 3 values and zero deviations flag nothing."""
    rows = row_framed(df, key, us, tie, half, {"__m": lambda w: F.percentile(value, F.lit(0.5)).over(w.rowsBetween(-half, half)), "__v": lambda w: F.collect_list(value).over(w.rowsBetween(-half, half))})
    d = F.array_sort(F.transform("__v", lambda x: F.abs(x - F.col("__m"))))
    n = F.size("__v")
    mad = (F.get(d, F.floor((n - 1) / 2).cast("int")) + F.get(d, F.floor(n / 2).cast("int"))) / 2
    sigma = 1.4826 * mad
    return rows.withColumn("spike", (n >= 3) & (sigma > 0) & (F.abs(F.col(value) - F.col("__m")) > sigmas * sigma)).drop("__m", "__v")


def running_median3(df: DataFrame, key: str, us: str, value: str, tie: str = "event_id", name: str = "smooth") -> DataFrame:
    """Upper median of the row and its neighbours; at the ends the larger of two."""
    rows = row_framed(df, key, us, tie, 1, {"__g": lambda w: F.array_sort(F.collect_list(value).over(w.rowsBetween(-1, 1)))})
    return rows.withColumn(name, F.get("__g", F.floor(F.size("__g") / 2).cast("int"))).drop("__g")


def asof(left: DataFrame, right: DataFrame, key: str, us: str, take: list[str], ahead: bool = False, tasks: int = 0) -> DataFrame:
    """Each left row with ``take`` (and right_us) of the latest right row at or before it, or of the
    next at or after it: one union and one run instead of a theta join. With ``tasks`` keys are dealt
    to so many and run whole."""
    missing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take]
    a = left.select("*", F.lit(None).cast("long").alias("right_us"), *missing, F.lit(1).alias("__side"))
    b = right.select(F.col(key), F.col(us), F.col(us).alias("right_us"), *take, F.lit(0).alias("__side"))
    b = b.select(*[F.col(c) if c in b.columns else F.lit(None).cast(a.schema[c].dataType).alias(c) for c in a.columns])
    known = F.when(F.col("__side") == 0, F.struct("right_us", *take))
    both = a.unionByName(b).repartition(tasks, key) if tasks else a.unionByName(b)
    rows = carried(both, [key], us, [F.col("__side"), *[F.col(c) for c in take]], {"__r": ("last", known)}, ahead=ahead, whole=tasks > 0).filter("__side = 1")
    return rows.select(*left.columns, F.col("__r.right_us").alias("right_us"), *[F.col(f"__r.{c}").alias(c) for c in take])


def neighbours(df: DataFrame, key: str, us: str, columns: list[str], tie: str) -> DataFrame:
    """prev_ and next_ of the columns in time order."""
    back = {f"prev_{c}": lambda w, c=c: F.lag(c).over(w) for c in columns}
    return row_framed(df, key, us, tie, 1, back | {f"next_{c}": lambda w, c=c: F.lead(c).over(w) for c in columns})


def interpolated(grid: DataFrame, series: DataFrame, key: str, us: str, value: str, gap: int) -> DataFrame:
    """``grid`` with ``value`` on the line between the points around it; null where these are more
    than ``gap`` apart or one is missing, and the point's own value where the grid hits it."""
    back = asof(grid, series, key, us, [value]).withColumnsRenamed({"right_us": "__t0", value: "__v0"})
    both = asof(back, series, key, us, [value], ahead=True).withColumnsRenamed({"right_us": "__t1", value: "__v1"})
    share = (F.col(us) - F.col("__t0")) / (F.col("__t1") - F.col("__t0"))
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * share
    inside = F.col("__t0").isNotNull() & F.col("__t1").isNotNull() & (F.col("__t1") - F.col("__t0") <= gap)
    return both.withColumn(value, F.when(F.col("__t0") == F.col(us), F.col("__v0")).when(inside, line)).drop("__t0", "__t1", "__v0", "__v1")


def segments(df: DataFrame, key: str, us: str, gap: int, tie: str) -> DataFrame:
    """segment: a number that grows at each pause longer than ``gap``, from 0."""
    rows = carried(df, [key], us, [F.col(tie)], {"__before": ("last", F.col(us))}, exclusive=True)
    new = F.coalesce((F.col(us) - F.col("__before") > gap).cast("long"), F.lit(0))
    return carried(rows, [key], us, [F.col(tie)], {"segment": ("sum", new)}).drop("__before")


def top_per_group(df: DataFrame, key: str | list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group with place 1..n; Spark limits groups before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def accumulated(df: DataFrame, keys: list[str], order: list[Column], weight: Column, name: str) -> DataFrame:
    """Running sum of ``weight`` in each key's ``order`` (no ties), the row included. Rows are dealt to
    tasks by ranges of keys and order, so a large key is spread; what a key's earlier ranges sum up to
    is carried on. Each range has at most one such key, so the carry is as small as their number."""
    dealt = df.withColumn("__w", weight).repartitionByRange(*[F.col(k) for k in keys], *order)
    rows = cut(dealt.withColumn("__part", F.spark_partition_id()))
    local = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__part", *keys).agg(F.sum("__w").alias("__s")).withColumn("__before", F.sum("__s").over(earlier)).filter("__before IS NOT NULL")
    carry = sums.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k_{k}") for k in keys], "__before")
    same = functools.reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys), F.col("__part") == F.col("__p"))
    both = rows.withColumn("__local", F.sum("__w").over(local)).join(F.broadcast(carry), same, "left")
    return both.select(*df.columns, (F.col("__local") + F.coalesce("__before", F.lit(0))).alias(name))


def medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, middle (mean of the two in the middle) and upper (the greater of them) of a value's
    known readings; keys without any have no row. Equal values are counted first."""
    each = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    rows = accumulated(each, keys, [F.col(value)], F.col("__n"), "__to")
    total = rows.groupBy(*keys).agg(F.max("__to").alias("n"))
    holds = lambda i: (F.col("__to") - F.col("__n") <= i) & (i < F.col("__to"))
    low, high = holds(F.floor((F.col("n") - 1) / 2)), holds(F.floor(F.col("n") / 2))
    found = rows.join(total, keys).filter(low | high).groupBy(*keys, "n").agg(F.max(F.when(low, F.col(value))).alias("__low"), F.max(F.when(high, F.col(value))).alias("upper"))
    return found.select(*keys, "n", ((F.col("__low") + F.col("upper")) / 2).alias("middle"), "upper")
