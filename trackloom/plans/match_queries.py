"""The operators' queries over the driver's tables, each with the same query in DuckDB's SQL.

Users stand for pilots, event types for kinds of log entries, parts for ships; vectors' first
numbers, in kilometres, for positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import parsing
from trackloom.operators import aggregates, fuzzy, geometry, hierarchy, intervals, sets, windows

HOUR = 3_600_000_000
DAY = 24 * HOUR
EVENTS = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us FROM events)"

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def rounded(c: Column | str, digits: int = 4) -> Column:
    return F.round(c, digits)


@query("""SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n_days, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS visits,
CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS opens, max(CAST(ts AS DATE)) AS last_day FROM events GROUP BY user_id""")
def activity_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    daily = e.groupBy("user_id", "day").agg(F.sum((F.col("event_type") == "view").cast("long")).alias("v"), F.sum((F.col("event_type") == "click").cast("long")).alias("o"))
    return daily.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_days"), F.sum("v").alias("visits"), F.sum("o").alias("opens"), F.max("day").alias("last_day"))


@query("""SELECT l_partkey, count(DISTINCT l_suppkey) AS viewers, CAST(sum(l_quantity) AS DOUBLE) AS opens FROM lineitem GROUP BY l_partkey ORDER BY viewers DESC, opens DESC, l_partkey LIMIT 50""")
def top_watched(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    g = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("viewers"), F.sum("q").cast("double").alias("opens"))
    return g.orderBy(F.desc("viewers"), F.desc("opens"), "l_partkey").limit(50)


@query("""SELECT CAST(ts AS DATE) AS day, user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL""")
def daily_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return e.groupBy(F.col("ts").cast("date").alias("day"), "user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


PATHS = "p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path, strlen(html) AS bytes FROM pages)"


def paths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.octet_length("html").cast("long").alias("bytes"))


@query(f"""WITH {PATHS}, x AS (SELECT bytes, unnest(list_transform(range(0, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))) AS folder FROM p)
SELECT folder, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM x GROUP BY folder""")
def folder_rollup(spark, sf_dir):
    return aggregates.prefix_rollup(paths(spark, sf_dir), "path", {"files": F.count(F.lit(1)), "bytes": F.sum("bytes")})


@query(f"""WITH {PATHS}, f AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], '/') AS folder FROM p WHERE page_id % 7 = 0)
SELECT page_id, path FROM p WHERE page_id % 7 = 0 OR EXISTS (SELECT 1 FROM f WHERE p.path = f.folder OR starts_with(p.path, f.folder || '/'))""")
def viewable_closure(spark, sf_dir):
    p = paths(spark, sf_dir)
    public = p.filter("page_id % 7 = 0").select(hierarchy.parent("path").alias("folder"))
    return hierarchy.visible(p, public, F.col("page_id") % 7 == 0, "path").select("page_id", "path")


@query("""SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 OR n_nationkey % 5 = 0)""")
def member_filter(spark, sf_dir):
    allowed = table(spark, sf_dir, "nation").filter("n_regionkey = 1 OR n_nationkey % 5 = 0")
    return table(spark, sf_dir, "customer").join(allowed, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)""")
def missing_keys(spark, sf_dir):
    there = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(there, "p_partkey", "left_anti")


@query("""WITH b AS (SELECT o_orderkey AS k, o_custkey AS v FROM orders WHERE o_orderkey % 3 < 2), l AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS v FROM orders WHERE o_orderkey % 4 > 0),
r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 2 ELSE o_custkey END AS v FROM orders WHERE o_orderkey % 6 > 0),
j AS (SELECT k, b.v AS base, l.v AS local, r.v AS remote FROM b FULL JOIN l USING (k) FULL JOIN r USING (k))
SELECT k, base, local, remote, CASE WHEN local IS NOT DISTINCT FROM remote THEN 'same' WHEN local IS DISTINCT FROM base AND remote IS DISTINCT FROM base THEN 'conflict' WHEN local IS DISTINCT FROM base THEN 'push' ELSE 'pull' END AS action FROM j""")
def three_way_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))
    base = o.filter("k % 3 < 2")
    local = o.filter("k % 4 > 0").withColumn("v", F.when(F.col("k") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    remote = o.filter("k % 6 > 0").withColumn("v", F.when(F.col("k") % 10 == 0, F.col("v") + 2).otherwise(F.col("v")))
    return sets.three_way(base, local, remote, "k", "v")


@query("""WITH a AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), b AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN -o_orderkey ELSE o_orderkey END AS k, o_custkey AS c FROM orders)
SELECT g.c, g.k AS from_key, n.k AS to_key FROM (SELECT * FROM a EXCEPT SELECT * FROM b) g JOIN (SELECT * FROM b EXCEPT SELECT * FROM a) n USING (c)""")
def move_detect(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))
    after = o.withColumn("k", F.when(F.col("k") % 50 == 0, -F.col("k")).otherwise(F.col("k")))
    return sets.moves(o, after, "k", "c")


MERGE_KEY = ["day", "user_id", "event_type"]


@query("""WITH s AS (SELECT event_id % 3 AS source, CAST(ts AS DATE) AS day, user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT day, user_id, event_type, max(n) AS multiplicity FROM s GROUP BY day, user_id, event_type""")
def multiset_merge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("source"), F.col("ts").cast("date").alias("day"), "user_id", "event_type")
    return aggregates.multiset_union(e, "source", MERGE_KEY)


@query("""SELECT DISTINCT CAST(ts AS DATE) AS day, user_id, event_type FROM events""")
def dedupe_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "user_id", "event_type").dropDuplicates(MERGE_KEY)


@query(f"""WITH {EVENTS} SELECT event_id, user_id, us, round(sum(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {6 * HOUR - 1} PRECEDING AND CURRENT ROW) / 6.0, 4) AS rate FROM e""")
def trailing_rate(spark, sf_dir):
    out = windows.trailing_sum(events(spark, sf_dir), "user_id", "us", "value", 6 * HOUR)
    return out.select("event_id", "user_id", "us", rounded(F.col("total") / 6.0).alias("rate"))


@query(f"""WITH {EVENTS}, m AS (SELECT *, list(value) OVER w AS vs, quantile_cont(value, 0.5) OVER w AS med FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)),
d AS (SELECT event_id, user_id, value, med, vs, list_sort(list_transform(vs, lambda x: abs(x - med))) AS ds FROM m),
s AS (SELECT event_id, user_id, value, med, len(vs) AS n, 1.4826 * (ds[(len(ds) - 1) // 2 + 1] + ds[len(ds) // 2 + 1]) / 2 AS sigma FROM d)
SELECT event_id, user_id, n >= 3 AND sigma > 0 AND abs(value - med) > 3 * sigma AS spike FROM s""")
def hampel_flags(spark, sf_dir):
    return windows.hampel(events(spark, sf_dir), "user_id", "us", "value").select("event_id", "user_id", "spike")


@query(f"""WITH {EVENTS}, w AS (SELECT event_id, value, max(value) OVER f AS trailing_max FROM e WINDOW f AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {12 * HOUR} PRECEDING AND 1 PRECEDING))
SELECT event_id, round(trailing_max, 4) AS trailing_max, coalesce(value < trailing_max, false) AS hit FROM w""")
def taking_damage(spark, sf_dir):
    out = windows.taking_hits(events(spark, sf_dir), "user_id", "us", "value", 12 * HOUR)
    return out.select("event_id", rounded("trailing_max").alias("trailing_max"), F.coalesce(F.col("value") < F.col("trailing_max"), F.lit(False)).alias("hit"))


@query(f"""WITH {EVENTS}, w AS (SELECT event_id, us, max(CASE WHEN event_type = 'error' THEN us END) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {24 * HOUR - 1} PRECEDING AND CURRENT ROW) AS last_hit FROM e) SELECT event_id, last_hit IS NOT NULL AS held FROM w""")
def damage_hold(spark, sf_dir):
    out = windows.framed(events(spark, sf_dir), "user_id", "us", 24 * HOUR - 1, 0, {"last_hit": lambda w: F.max(F.when(F.col("event_type") == "error", F.col("us"))).over(w)})
    return out.select("event_id", F.col("last_hit").isNotNull().alias("held"))


@query(f"""WITH {EVENTS}, w AS (SELECT event_id, count(value) OVER f AS n_points, regr_slope(value, us / 86400000000.0) OVER f AS s FROM e WINDOW f AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND {DAY} FOLLOWING))
SELECT event_id, n_points, CASE WHEN n_points >= 3 THEN round(s, 2) END AS slope FROM w""")
def direction_slope(spark, sf_dir):
    return windows.centred_slope(events(spark, sf_dir), "user_id", "us", "value", DAY).select("event_id", "n_points", rounded("slope", 2).alias("slope"))


def split(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = events(spark, sf_dir)
    return e.filter("event_type = 'error'").select("event_id", "user_id", "us"), e.filter("event_type <> 'error'").select("user_id", "us", "value")


@query(f"""WITH {EVENTS}, l AS (SELECT * FROM e WHERE event_type = 'error'), r AS (SELECT * FROM e WHERE event_type <> 'error')
SELECT l.event_id, r.us AS right_us, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us >= r.us""")
def locf_asof(spark, sf_dir):
    left, right = split(spark, sf_dir)
    return windows.asof(left, right, "user_id", "us", ["value"]).select("event_id", "right_us", "value")


@query(f"""WITH {EVENTS}, l AS (SELECT * FROM e WHERE event_type = 'error'), r AS (SELECT * FROM e WHERE event_type <> 'error'),
b AS (SELECT l.event_id, l.user_id, l.us, r.us AS back FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.us >= r.us),
f AS (SELECT b.event_id, b.us, back, r.us AS ahead FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.us <= r.us),
n AS (SELECT event_id, us, CASE WHEN back IS NULL THEN ahead WHEN ahead IS NULL OR us - back <= ahead - us THEN back ELSE ahead END AS nearest FROM f)
SELECT event_id, CASE WHEN abs(nearest - us) <= {2 * HOUR} THEN nearest END AS nearest_us FROM n""")
def nearest_asof(spark, sf_dir):
    left, right = split(spark, sf_dir)
    right = right.select("user_id", "us").withColumn("one", F.lit(1))
    back = windows.asof(left, right, "user_id", "us", ["one"]).withColumnRenamed("right_us", "back").drop("one")
    both = windows.asof(back, right, "user_id", "us", ["one"], ahead=True)
    at = F.when(F.col("back").isNull(), F.col("right_us")).when(F.col("right_us").isNull() | (F.col("us") - F.col("back") <= F.col("right_us") - F.col("us")), F.col("back")).otherwise(F.col("right_us"))
    return both.withColumn("at", at).select("event_id", F.when(F.abs(F.col("at") - F.col("us")) <= 2 * HOUR, F.col("at")).alias("nearest_us"))


START = 1_704_067_200_000_000  # 2024-01-01


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, {START} + d * {DAY} AS us FROM (SELECT DISTINCT user_id FROM e), range(0, 30) t(d)), s AS (SELECT user_id, us, value FROM e),
b AS (SELECT g.user_id, g.us, s.us AS t0, s.value AS v0 FROM g ASOF LEFT JOIN s ON g.user_id = s.user_id AND g.us >= s.us),
f AS (SELECT b.*, s.us AS t1, s.value AS v1 FROM b ASOF LEFT JOIN s ON b.user_id = s.user_id AND b.us <= s.us)
SELECT user_id, us, round(CASE WHEN t0 = us THEN v0 WHEN t1 - t0 <= {12 * HOUR} THEN v0 + (v1 - v0) * ((us - t0) / CAST(t1 - t0 AS DOUBLE)) END, 4) AS value FROM f""")
def interpolate(spark, sf_dir):
    e = events(spark, sf_dir)
    grid = e.select("user_id").distinct().withColumn("us", F.explode(F.sequence(F.lit(START), F.lit(START + 29 * DAY), F.lit(DAY))))
    return windows.interpolated(grid, e.select("user_id", "us", "value"), "user_id", "us", "value", 12 * HOUR).select("user_id", "us", rounded("value").alias("value"))


@query(f"""WITH {EVENTS}, w AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS g FROM e) SELECT event_id, g[len(g) // 2 + 1] AS smooth FROM w""")
def running_median3(spark, sf_dir):
    return windows.running_median3(events(spark, sf_dir), "user_id", "us", "value").select("event_id", "smooth")


@query(f"""WITH {EVENTS}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > {12 * HOUR} THEN 1 ELSE 0 END AS new FROM e),
s AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g) SELECT user_id, CAST(segment AS BIGINT) AS segment, min(us) AS t0, max(us) AS t1, count(*) AS n FROM s GROUP BY user_id, segment""")
def gap_segments(spark, sf_dir):
    s = windows.segments(events(spark, sf_dir), "user_id", "us", 12 * HOUR, "event_id")
    return s.groupBy("user_id", "segment").agg(F.min("us").alias("t0"), F.max("us").alias("t1"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVENTS}, w AS (SELECT event_id, us, lead(us) OVER f AS next_us, lag(event_type) OVER f AS prev_type FROM e WINDOW f AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, next_us, prev_type, CASE WHEN next_us - us < {12 * HOUR} THEN round(1 - (next_us - us) / {12 * HOUR}.0, 4) END AS spool FROM w""")
def next_event(spark, sf_dir):
    n = windows.neighbours(events(spark, sf_dir), "user_id", "us", ["us", "event_type"], "event_id")
    wait = F.col("next_us") - F.col("us")
    return n.select("event_id", "next_us", F.col("prev_event_type").alias("prev_type"), F.when(wait < 12 * HOUR, rounded(1 - wait / float(12 * HOUR))).alias("spool"))


FOLDED = f"""{EVENTS}, s AS (SELECT user_id, event_type, us AS t0, us + {6 * HOUR} AS t1 FROM e), n AS (SELECT *, CASE WHEN max(t1) OVER (PARTITION BY user_id, event_type ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= t0 THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS grp FROM n), f AS (SELECT user_id, event_type, min(t0) AS t0, max(t1) AS t1, count(*) AS n_points FROM g GROUP BY user_id, event_type, grp)"""


def folded(spark, sf_dir) -> DataFrame:
    return intervals.fold(intervals.hold(events(spark, sf_dir), "us", 6 * HOUR).select("user_id", "event_type", "t0", "t1"), ["user_id", "event_type"])


@query(f"WITH {FOLDED} SELECT * FROM f")
def fold_spans(spark, sf_dir):
    return folded(spark, sf_dir)


@query(f"""WITH {FOLDED} SELECT user_id, event_type, greatest(t0, {START + 5 * DAY}) AS t0, least(t1, {START + 20 * DAY}) AS t1 FROM f WHERE greatest(t0, {START + 5 * DAY}) < least(t1, {START + 20 * DAY})""")
def clip_spans(spark, sf_dir):
    return intervals.clip(folded(spark, sf_dir), START + 5 * DAY, START + 20 * DAY).select("user_id", "event_type", "t0", "t1")


@query(f"""WITH {FOLDED}, i AS (SELECT {START} + d * {DAY} AS instant FROM range(0, 30) t(d)) SELECT instant, event_type, count(*) AS n_active FROM i JOIN f ON t0 <= instant AND instant < t1 GROUP BY instant, event_type""")
def active_links(spark, sf_dir):
    instants = spark.range(30).select((F.lit(START) + F.col("id") * DAY).alias("instant"))
    return intervals.stab(instants, folded(spark, sf_dir), "instant", DAY).groupBy("instant", "event_type").agg(F.count(F.lit(1)).alias("n_active"))


@query(f"""WITH s AS (SELECT o_custkey, o_orderkey AS id, epoch_us(o_orderdate) AS t0, epoch_us(o_orderdate) + {10 * DAY} AS t1 FROM orders)
SELECT x.o_custkey, x.id AS a, y.id AS b, least(x.t1, y.t1) - greatest(x.t0, y.t0) AS shared FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.id < y.id AND x.t0 < y.t1 AND y.t0 < x.t1""")
def span_overlap(spark, sf_dir):
    t0 = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    s = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", t0.alias("t0"), (t0 + 10 * DAY).alias("t1"))
    return intervals.overlaps(s, "o_custkey", "o_orderkey", 30 * DAY)


@query(f"""WITH {EVENTS}, r AS (SELECT *, sum(CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(us) AS first_at, max(us) AS last_at, count(*) AS length FROM r WHERE event_type IN ('view', 'click') GROUP BY user_id, g""")
def hidden_runs(spark, sf_dir):
    return intervals.runs(events(spark, sf_dir), "user_id", ["us", "event_id"], "event_type IN ('view', 'click')")


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL) SELECT user_id, event_type, votes FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type DESC) = 1""")
def mode_vote(spark, sf_dir):
    return aggregates.mode(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""WITH v AS (SELECT l_suppkey, l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS votes FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag, votes FROM v QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, l_returnflag DESC) = 1""")
def weighted_vote(spark, sf_dir):
    return aggregates.mode(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", F.col("l_quantity").cast("long"))


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, event_type, us - lag(us) OVER (PARTITION BY user_id, event_type ORDER BY us) AS gap FROM e)
SELECT user_id, event_type, coalesce(quantile_cont(CASE WHEN gap BETWEEN {12 * HOUR} AND {22 * HOUR} THEN CAST(gap AS DOUBLE) END, 0.5), {20 * HOUR}.0) AS cycle_us FROM g GROUP BY ALL""")
def cycle_estimate(spark, sf_dir):
    e, by = events(spark, sf_dir).select("user_id", "event_type", "us"), ["user_id", "event_type"]
    gap = F.col("us") - F.col("before")
    near = windows.carried(e, by, "us", [], {"before": ("last", F.col("us"))}, exclusive=True).filter(gap.between(12 * HOUR, 22 * HOUR))
    middle = windows.medians(near.select(*by, gap.cast("double").alias("gap")), by, "gap")
    return e.select(*by).distinct().join(middle, by, "left").select(*by, F.coalesce("middle", F.lit(float(20 * HOUR))).alias("cycle_us"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, round(avg(value) FILTER (event_id % 3 = 0), 4) AS d_a, round(avg(value) FILTER (event_id % 3 = 1), 4) AS d_b, round(avg(value) FILTER (event_id % 3 = 2), 4) AS d_c FROM events GROUP BY user_id, day)
SELECT * FROM d WHERE (d_a IS NOT NULL)::INT + (d_b IS NOT NULL)::INT + (d_c IS NOT NULL)::INT >= 2""")
def pivot_observers(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    names = ["d_a", "d_b", "d_c"]
    d = e.groupBy("user_id", "day").agg(*[rounded(F.avg(F.when(F.col("event_id") % 3 == i, F.col("value")))).alias(n) for i, n in enumerate(names)])
    return d.filter(sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)) >= 2)


@query("""SELECT event_id FROM events QUALIFY count(*) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) = 1""")
def clash_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("day"))
    return aggregates.unambiguous(e, ["user_id", "event_type", "day"]).select("event_id")


@query("""WITH c AS (SELECT l_orderkey, l_partkey, count(*) AS copies FROM lineitem GROUP BY ALL)
SELECT l_orderkey, CAST(sum(copies) AS BIGINT) AS n_items, CAST(sum(copies * (l_partkey % 20 + 1) + (l_partkey % 4) * copies * (copies - 1) / 2) AS DOUBLE) AS points FROM c GROUP BY l_orderkey""")
def fleet_points(spark, sf_dir):
    return aggregates.valued_copies(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", F.col("l_partkey") % 20 + 1, F.col("l_partkey") % 4)


@query("""WITH t AS (SELECT o_custkey, o_orderkey % 2 AS team, sum(CAST(o_totalprice AS DOUBLE)) AS total FROM orders GROUP BY ALL), p AS (SELECT o_custkey, coalesce(max(total) FILTER (team = 0), 0) AS red, coalesce(max(total) FILTER (team = 1), 0) AS blue FROM t GROUP BY o_custkey)
SELECT o_custkey, round(greatest(500000 - blue, 0), 2) AS red_start, round(greatest(500000 - red, 0), 2) AS blue_start FROM p""")
def head_start(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    total = lambda t: F.coalesce(F.sum(F.when(F.col("o_orderkey") % 2 == t, F.col("o_totalprice").cast("double"))), F.lit(0.0))
    p = o.groupBy("o_custkey").agg(total(0).alias("red"), total(1).alias("blue"))
    return p.select("o_custkey", rounded(F.greatest(500000 - F.col("blue"), F.lit(0.0)), 2).alias("red_start"), rounded(F.greatest(500000 - F.col("red"), F.lit(0.0)), 2).alias("blue_start"))


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, us, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM e), c AS (SELECT user_id, max(us) - min(us) AS span_us, CAST(coalesce(sum(gap) FILTER (gap <= {12 * HOUR}), 0) AS BIGINT) AS covered_us FROM g GROUP BY user_id)
SELECT user_id, span_us, covered_us, CASE WHEN span_us > 0 THEN round(covered_us / CAST(span_us AS DOUBLE), 4) END AS coverage, CASE WHEN span_us > 0 THEN covered_us / CAST(span_us AS DOUBLE) < 0.5 END AS thin FROM c""")
def coverage_report(spark, sf_dir):
    c = aggregates.covered_share(events(spark, sf_dir), "user_id", "us", 12 * HOUR)
    return c.withColumn("thin", F.col("coverage") < 0.5).withColumn("coverage", rounded("coverage"))


@query(f"""WITH {EVENTS}, s AS (SELECT us // {10 * DAY} AS match, user_id AS pilot, us, event_id, event_type AS ship, CASE WHEN us // {10 * DAY} % 3 > 0 AND event_id % (2 + user_id % 3) = 0 THEN value END AS hp, event_id % 13 = 4 AS pod FROM e),
w AS (SELECT match, min(us) AS t0, max(us) AS t1, count(DISTINCT pilot) AS ships, count(hp) > 0 AS known FROM s GROUP BY match), o AS (SELECT match, pilot, min(us) AS out FROM s WHERE event_id % 37 = 5 GROUP BY ALL),
g AS (SELECT s.*, lag(us) OVER (PARTITION BY match, pilot ORDER BY us) AS before FROM s), j AS (SELECT g.*, t0, known, least(t1, coalesce(out, t1)) AS t_end FROM g JOIN w USING (match) LEFT JOIN o USING (match, pilot)),
p AS (SELECT match, pilot, known, arg_min(ship, (us, ship)) AS ship, coalesce(sum(greatest(least(us, t_end) - greatest(before, t0), 0)) FILTER (us - before <= {24 * HOUR}), 0) / CAST(any_value(t_end - t0) AS DOUBLE) AS placed, count(*) FILTER (us <= t_end AND NOT pod) AS n, count(hp) FILTER (us <= t_end AND NOT pod) AS n_hp FROM j WHERE t_end > t0 GROUP BY ALL)
SELECT match, pilot, ship, 'positions' AS issue, CAST(round(placed * 100) AS BIGINT) AS figure FROM p WHERE placed < 0.5 UNION ALL SELECT match, pilot, ship, 'hp', CAST(round(n_hp / CAST(n AS DOUBLE) * 100) AS BIGINT) FROM p WHERE known AND n > 0 AND n_hp / CAST(n AS DOUBLE) < 0.5
UNION ALL SELECT match, NULL, NULL, 'ships', ships FROM w WHERE ships < 20 UNION ALL SELECT match, NULL, NULL, 'no hp', 0 FROM w WHERE NOT known""")
def match_issues(spark, sf_dir):
    """What is wrong with a match's data: events of ten days, some of them capsules, with hit points in
    two of three matches."""
    id_ = F.col("event_id")
    s = events(spark, sf_dir).withColumn("match", F.floor(F.col("us") / (10 * DAY)).cast("long")).withColumn("pilot", F.col("user_id"))
    hp = F.when((F.col("match") % 3 > 0) & (id_ % (2 + F.col("user_id") % 3) == 0), F.col("value"))
    s = s.select("match", "pilot", "us", "event_id", F.col("event_type").alias("ship"), hp.alias("hp"), (id_ % 13 == 4).alias("pod"))
    return aggregates.data_issues(s, s.filter(id_ % 37 == 5).select("match", "pilot", F.col("us").alias("end_us")), 24 * HOUR, 20)


CELL = "CASE event_id % 8 WHEN 0 THEN user_id || ' km' WHEN 1 THEN '4,' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') || ' m' WHEN 2 THEN '1.' || (user_id % 10) || ' AU' WHEN 3 THEN '-' WHEN 4 THEN user_id || ',25' WHEN 5 THEN user_id || 'km .' WHEN 6 THEN user_id || ' m/s' ELSE CAST(user_id AS VARCHAR) END"
NUM = parsing.NUMBER


@query(f"""WITH c AS (SELECT event_id, {CELL} AS cell FROM events), d AS (SELECT event_id, cell, regexp_matches(cell, '^{NUM} ?(m|km|k|AU)([^A-Za-z].*)?$') AS ok FROM c)
SELECT event_id, cell, CASE WHEN cell = '-' THEN 'none' WHEN ok THEN 'value' ELSE 'unreadable' END AS status,
CASE WHEN ok THEN CAST(replace(regexp_extract(cell, '^{NUM}', 1), ',', '') || regexp_extract(cell, '^{NUM}', 2) AS DOUBLE) * CASE regexp_extract(cell, '^{NUM} ?(m|km|k|AU)([^A-Za-z].*)?$', 3) WHEN 'm' THEN 1.0 WHEN 'AU' THEN {parsing.AU_M} ELSE 1000.0 END END AS metres,
CASE WHEN regexp_matches(cell, '^{NUM}( ?m/s)?$') THEN CAST(replace(regexp_extract(cell, '^{NUM}', 1), ',', '') || regexp_extract(cell, '^{NUM}', 2) AS DOUBLE) END AS speed FROM d""")
def parse_cells(spark, sf_dir):
    c = table(spark, sf_dir, "events").selectExpr("event_id", f"{CELL.replace('VARCHAR', 'STRING')} AS cell").withColumn("d", parsing.parse_distance(F.col("cell")))
    return c.select("event_id", "cell", "d.status", "d.metres", parsing.parse_scalar(F.col("cell")).alias("speed"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""")
def strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", parsing.strip_markup(F.col("html")).alias("text"))


LOG = "CASE event_id % 10 WHEN 0 THEN user_id || ' from Pilot ' || user_id || ' - Gun - Hits' WHEN 1 THEN user_id || ' to Pilot ' || user_id || ' - Gun' WHEN 2 THEN 'Your Gun misses Pilot ' || user_id WHEN 3 THEN 'Pilot ' || user_id || ' misses you completely' WHEN 4 THEN 'Warp scramble attempt from Pilot ' || user_id WHEN 5 THEN user_id || ' GJ energy neutralized Pilot ' || user_id WHEN 6 THEN '-' || user_id || ' GJ energy drained Pilot ' || user_id WHEN 7 THEN user_id || ' remote armor repaired by Pilot ' || user_id WHEN 8 THEN 'You are jammed by Pilot ' || user_id ELSE 'Docking' END"


def _line_sql() -> str:
    q = lambda p: p.replace("(?:", "(").replace("'", "''")
    g = [(k, p) for k, p in parsing.LINES]

    def part(i: int, p: str) -> str:
        n = i + p[: p.rindex("(")].count("(?:") if i == 2 else i + p[: p.index("([0-9]+)") if "([0-9]+)" in p else p.index("()")].count("(?:")
        return f"regexp_extract(line, '{q(p)}', {n})"

    kind = " ".join(f"WHEN regexp_matches(line, '{q(p)}') THEN '{k}'" for k, p in g)
    amount = " ".join(f"WHEN regexp_matches(line, '{q(p)}') THEN CAST(nullif({part(1, p)}, '') AS DOUBLE)" for k, p in g)
    name = " ".join(f"WHEN regexp_matches(line, '{q(p)}') THEN trim({part(2, p)})" for k, p in g)
    return f"WITH l AS (SELECT event_id, {LOG} AS line FROM events) SELECT event_id, CASE {kind} ELSE 'other' END AS kind, CASE {amount} END AS amount, CASE {name} END AS name FROM l"


@query(_line_sql())
def log_cascade(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{LOG} AS line").withColumn("p", parsing.parse_line(F.col("line"))).select("event_id", "p.kind", "p.amount", "p.name")


MUTATED = "substr(p_name, 1, length(p_name) - 1) || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END AS seen"


@query(f"""WITH s AS (SELECT DISTINCT {MUTATED} FROM part), p AS (SELECT DISTINCT p_name FROM part) SELECT seen, p_name, CAST(levenshtein(seen, p_name) AS INTEGER) AS edits FROM s, p WHERE levenshtein(seen, p_name) <= 1""")
def levenshtein_pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return fuzzy.within_edits(part.selectExpr(MUTATED).distinct(), part, "seen", "p_name", 1)


def _dice_sql(a: str, b: str) -> str:
    grams = lambda s: f"list_transform(range(1, greatest(length({s}), 1)), lambda i: substr(lower({s}), i, 2))"
    x, y = grams(a), grams(b)
    return f"CASE WHEN lower({a}) = lower({b}) THEN 1.0 WHEN len({x}) + len({y}) = 0 THEN 0.0 ELSE 2.0 * len(list_filter({x}, lambda g: list_contains({y}, g))) / (len({x}) + len({y})) END"


SEEN = "CASE n_nationkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN substr(n_name, 1, 4) WHEN 2 THEN substr(n_name, 1, greatest(length(n_name) - 1, 1)) || 'q' ELSE 'zz' || n_nationkey END AS seen"


@query(f"""WITH s AS (SELECT DISTINCT {SEEN} FROM nation), x AS (SELECT seen, n_name AS known, {_dice_sql('seen', 'n_name')} AS d FROM s, nation),
b AS (SELECT seen, max(CASE WHEN lower(seen) = lower(known) THEN known END) AS exact, count(*) FILTER (length(seen) >= 3 AND starts_with(lower(known), lower(seen))) AS nb, max(CASE WHEN length(seen) >= 3 AND starts_with(lower(known), lower(seen)) THEN known END) AS begins, max(CASE WHEN d >= 0.8 THEN {{'d': d, 'k': known}} END) AS near FROM x GROUP BY seen)
SELECT seen, coalesce(exact, CASE WHEN nb = 1 THEN begins END, near.k) AS resolved FROM b""")
def resolve_names(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return fuzzy.resolve(nation.selectExpr(SEEN).distinct(), nation.select(F.col("n_name").alias("known")), "seen", "known")


def points(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", *[(F.get("embedding", F.lit(i)).cast("double") * 100).alias(n) for i, n in enumerate("xyz")])


POINTS = "q AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z FROM embeddings)"


@query(f"""WITH {POINTS}, d AS (SELECT vec_id, sqrt(x * x + y * y + z * z) AS d0, sqrt((x - 150) * (x - 150) + y * y + z * z) AS d1, sqrt(x * x + (y - 150) * (y - 150) + z * z) AS d2 FROM q),
s AS (SELECT vec_id, (d0 * d0 - d1 * d1 + 22500) / 300 AS x, (d0 * d0 - d2 * d2 + 22500) / 300 AS y, d0 FROM d) SELECT vec_id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y, round(abs(sqrt(greatest(d0 * d0 - x * x - y * y, 0))), 2) + 0.0 AS z FROM s""")
def trilaterate(spark, sf_dir):
    p = points(spark, sf_dir)
    at = (geometry.vec(0, 0, 0), geometry.vec(150, 0, 0), geometry.vec(0, 150, 0))
    d = tuple(geometry.norm(geometry.sub((F.col("x"), F.col("y"), F.col("z")), o)) for o in at)
    up, _ = geometry.trilaterate(at, d)
    return p.select("vec_id", (rounded(up[0], 3) + 0.0).alias("x"), (rounded(up[1], 3) + 0.0).alias("y"), (rounded(F.abs(up[2]), 2) + 0.0).alias("z"))


@query(f"""WITH {POINTS}, o AS (SELECT *, (x + y + z - 30) / sqrt(3.0) AS s FROM q) SELECT vec_id, round(s, 3) + 0.0 AS plane_offset, round(x - 2 * s / sqrt(3.0), 3) + 0.0 AS mx, round(y - 2 * s / sqrt(3.0), 3) + 0.0 AS my, round(z - 2 * s / sqrt(3.0), 3) + 0.0 AS mz FROM o""")
def reflect_points(spark, sf_dir):
    flat = geometry.plane(geometry.vec(30, 0, 0), geometry.vec(0, 30, 0), geometry.vec(0, 0, 30))
    p = (F.col("x"), F.col("y"), F.col("z"))
    m = geometry.reflect(p, flat)
    return points(spark, sf_dir).select("vec_id", (rounded(geometry.offset(p, flat), 3) + 0.0).alias("plane_offset"), *[(rounded(c, 3) + 0.0).alias(n) for c, n in zip(m, ("mx", "my", "mz"))])


CORNERS = [(a, b, c) for a in (-100, 100) for b in (-100, 100) for c in (-100, 100)]


@query(f"""WITH {POINTS}, c(corner, cx, cy, cz) AS (VALUES {', '.join(str((i, *map(float, c))) for i, c in enumerate(CORNERS))}), t AS (SELECT vec_id, corner, x, y, z, cx, cy, cz, greatest(0, least(1, ((x - cx) * -cx + (y - cy) * -cy + (z - cz) * -cz) / 30000.0)) AS u FROM q, c),
d AS (SELECT vec_id, corner, round(sqrt(pow(x - cx + cx * u, 2) + pow(y - cy + cy * u, 2) + pow(z - cz + cz * u, 2)), 3) AS dist FROM t) SELECT vec_id, corner, dist FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, corner) = 1""")
def nearest_line(spark, sf_dir):
    p = (F.col("x"), F.col("y"), F.col("z"))
    lines = F.array(*[F.struct(rounded(geometry.line_distance(p, geometry.vec(*c), geometry.vec(0, 0, 0)), 3).alias("dist"), F.lit(i).alias("corner")) for i, c in enumerate(CORNERS)])
    return points(spark, sf_dir).withColumn("best", F.array_min(lines)).select("vec_id", "best.corner", "best.dist")


@query(f"""WITH {POINTS}, w AS (SELECT vec_id, 2 * (x * x + y * y + z * z) AS h, x, y, z FROM q), k AS (SELECT vec_id, 9 * (x * x + y * y + z * z) AS qa, 6 * (x * x + y * y + z * z) AS qb, x * x + y * y + z * z - 2500 AS qc FROM w),
t AS (SELECT vec_id, qa, qb * qb - 4 * qa * qc AS disc, (-qb + sqrt(greatest(qb * qb - 4 * qa * qc, 0))) / (2 * qa) AS t FROM k) SELECT vec_id, CASE WHEN qa > 0 AND disc >= 0 AND t BETWEEN 0 AND 1 THEN round(t, 4) END AS share FROM t""")
def boundary_crossing(spark, sf_dir):
    p = (F.col("x"), F.col("y"), F.col("z"))
    return points(spark, sf_dir).select("vec_id", rounded(geometry.crossing(p, geometry.scale(p, 4.0), 50.0)).alias("share"))


@query("""SELECT l_orderkey, l_partkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) AS BIGINT) AS place FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey) <= 2""")
def top_two(spark, sf_dir):
    t = windows.top_per_group(table(spark, sf_dir, "lineitem"), "l_orderkey", [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_partkey")], 2)
    return t.select("l_orderkey", "l_partkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query(f"""WITH {EVENTS} SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS cycles FROM e""")
def running_count(spark, sf_dir):
    return windows.running(events(spark, sf_dir), ["user_id", "event_type"], "us", "event_id", {"cycles": ("count", None)}).select("event_id", "cycles")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION SELECT s_suppkey FROM supplier EXCEPT SELECT n_nationkey FROM nation""")
def set_algebra(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    with_orders = c.intersect(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))
    return with_orders.union(table(spark, sf_dir, "supplier").select("s_suppkey")).distinct().subtract(table(spark, sf_dir, "nation").select("n_nationkey"))


@query("""WITH n AS (SELECT c_custkey, 'Log_' || (c_custkey % 100) || '_v' || c_nationkey AS name FROM customer), k AS (SELECT *, array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, 20, '0') ELSE p END), '') AS k FROM n)
SELECT c_custkey, name, k AS sort_key FROM k""")
def natural_sort(spark, sf_dir):
    n = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Log_"), F.col("c_custkey") % 100, F.lit("_v"), F.col("c_nationkey")).alias("name"))
    return n.withColumn("sort_key", parsing.natural_key(F.col("name"))).orderBy("sort_key", "c_custkey")
