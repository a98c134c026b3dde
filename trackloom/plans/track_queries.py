"""Queries on ticks, stretches and pairs of points, each with the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackloom.functions import naming
from trackloom.operators import contacts, geometry, intervals, motion, windows
from trackloom.plans.match_queries import DAY, EVENTS, HOUR, POINTS, events, points, rounded, table
from trackloom.plans.motion_queries import PLACED, diagonal, placed

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {EVENTS} SELECT user_id, us // {DAY} AS day, round(median(value), 4) AS middle, round(list_sort(list(value))[len(list(value)) // 2 + 1], 4) AS upper FROM e GROUP BY ALL""")
def tick_medians(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY).cast("long"))
    return windows.medians(e, ["user_id", "day"], "value").select("user_id", "day", F.round("middle", 4).alias("middle"), F.round("upper", 4).alias("upper"))


@query("""SELECT user_id, count(*) AS n, round(min(value), 4) AS least, round(max(value), 4) AS most, round(avg(value), 4) AS mean, round(median(value), 4) AS middle FROM events GROUP BY user_id""")
def pilot_summary(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), *[F.round(f, 4).alias(a) for f, a in ((F.min(v), "least"), (F.max(v), "most"), (F.avg(v), "mean"), (F.percentile(v, F.lit(0.5)), "middle"))])


@query(f"""WITH {EVENTS}, d AS (SELECT user_id, us // {6 * HOUR} AS tick, max(CASE WHEN event_id % 3 = 0 THEN floor(value / 20) END) AS a, max(CASE WHEN event_id % 3 = 1 THEN floor(value / 20) END) AS b, max(CASE WHEN event_id % 3 = 2 THEN floor(value / 20) END) AS c FROM e GROUP BY ALL),
p AS (SELECT user_id, 'ab' AS pair, a AS x, b AS y FROM d UNION ALL SELECT user_id, 'ac', a, c FROM d UNION ALL SELECT user_id, 'bc', b, c FROM d)
SELECT pair, count(*) AS n_both, round(avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END), 4) AS share, count(*) >= 30 AND avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END) >= 0.9 AS duplicate FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY pair""")
def duplicate_observers(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("tick", F.floor(F.col("us") / (6 * HOUR)).cast("long"))
    d = e.groupBy("user_id", "tick").agg(*[F.max(F.when(F.col("event_id") % 3 == i, F.floor(F.col("value") / 20))).alias(n) for i, n in enumerate("abc")])
    pairs = F.explode(F.array(*[F.struct(F.lit(x + y).alias("pair"), F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ("ab", "ac", "bc")]))
    rows = d.select(pairs.alias("p")).select("p.*").filter("x IS NOT NULL AND y IS NOT NULL")
    share = F.avg(F.when(F.col("x") == F.col("y"), 1.0).otherwise(0.0))
    return rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n_both"), F.round(share, 4).alias("share"), ((F.count(F.lit(1)) >= 30) & (share >= 0.9)).alias("duplicate"))


#: Ranges to three observers, with an error, from the placed events.
RANGES = f"{PLACED}, r AS (SELECT user_id, us, event_id, round(sqrt(x * x + y * y + z * z)) AS d0, round(sqrt((x - 60) * (x - 60) + y * y + z * z)) AS d1, round(sqrt(x * x + (y - 60) * (y - 60) + z * z)) AS d2 FROM q)"
AT = ((0, 0, 0), (60, 0, 0), (0, 60, 0))


@query(f"""WITH {RANGES}, f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) <= 10), s AS (SELECT *, (d0 * d0 - d1 * d1 + 3600) / 120 AS x, (d0 * d0 - d2 * d2 + 3600) / 120 AS y FROM f), h AS (SELECT *, sqrt(greatest(d0 * d0 - x * x - y * y, 0)) AS z FROM s),
c AS (SELECT user_id, sqrt((pow(sqrt(x * x + y * y + z * z) - d0, 2) + pow(sqrt((x - 60) * (x - 60) + y * y + z * z) - d1, 2) + pow(sqrt(x * x + (y - 60) * (y - 60) + z * z) - d2, 2)) / 3) AS residual,
least(sqrt(pow(greatest(-x, x - 40, 0), 2) + pow(greatest(-y, y - 40, 0), 2) + pow(greatest(-z, z - 40, 0), 2)), sqrt(pow(greatest(-x, x - 40, 0), 2) + pow(greatest(-y, y - 40, 0), 2) + pow(greatest(z, -z - 40, 0), 2))) AS away FROM h)
SELECT user_id, round(avg(residual + away), 3) + 0.0 AS cost FROM c GROUP BY user_id""")
def start_cost(spark, sf_dir):
    p, at = placed(spark, sf_dir), tuple(geometry.vec(*o) for o in AT)
    here = tuple(F.col(c) for c in "xyz")
    ranged = p.select("user_id", "us", "event_id", *[F.round(geometry.norm(geometry.sub(here, o))).alias(f"d{i}") for i, o in enumerate(at)])
    first = windows.top_per_group(ranged, "user_id", [F.col("us"), F.col("event_id")], 10)
    d = tuple(F.col(f"d{i}") for i in range(3))
    up, down = geometry.trilaterate(at, d)
    cost = geometry.range_residual(up, at, d) + F.least(geometry.outside(up, 40.0), geometry.outside(down, 40.0))
    return first.groupBy("user_id").agg((F.round(F.avg(cost), 3) + 0.0).alias("cost"))


@query(f"""WITH {PLACED}, o AS (SELECT user_id, us, (x + y + z) / sqrt(3.0) AS off FROM q), w AS (SELECT *, regr_slope(off, us / {DAY}.0) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND {DAY} FOLLOWING) AS slope, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND {DAY} FOLLOWING) AS n FROM o),
s AS (SELECT user_id, us, off, coalesce(CASE WHEN n >= 3 THEN slope END, 0) AS slope, abs(off) < 25 AS near FROM w), i AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g, max(us) OVER (PARTITION BY user_id) AS last FROM s),
r AS (SELECT user_id, g, min(us) AS t0, arg_min(us, (abs(off) / 25 + abs(slope) / 60, us)) AS exit_us, arg_min(slope, (abs(off) / 25 + abs(slope) / 60, us)) AS slope, min(abs(off) / 25 + abs(slope) / 60) AS cost FROM i WHERE near GROUP BY ALL HAVING max(us) < max(last))
SELECT user_id, t0, exit_us, round(cost, 4) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY t0) AS exit_id FROM r WHERE abs(slope) < 60""")
def plane_exits(spark, sf_dir):
    fixes = placed(spark, sf_dir).select("user_id", "us", geometry.offset(tuple(F.col(c) for c in "xyz"), diagonal()).alias("off"))
    sloped = windows.centred_slope(fixes, "user_id", "us", "off", DAY).withColumn("slope", F.coalesce("slope", F.lit(0.0)))
    return contacts.plane_exits(sloped, "user_id", "us", "off", "slope", 25.0, 60.0).withColumn("cost", F.round("cost", 4))


@query(f"""WITH {PLACED} SELECT event_id, round(CASE WHEN user_id % 5 = 0 AND event_id % 2 = 0 THEN x - 2 * (x + y + z) / 3 ELSE x END, 4) + 0.0 AS x, round(CASE WHEN user_id % 5 = 0 AND event_id % 2 = 0 THEN y - 2 * (x + y + z) / 3 ELSE y END, 4) + 0.0 AS y, round(CASE WHEN user_id % 5 = 0 AND event_id % 2 = 0 THEN z - 2 * (x + y + z) / 3 ELSE z END, 4) + 0.0 AS z FROM q""")
def flip_exit(spark, sf_dir):
    flat = (geometry.vec(0, 0, 0), geometry.unit(geometry.vec(1, 1, 1)))
    out = contacts.flipped(placed(spark, sf_dir), (F.col("user_id") % 5 == 0) & (F.col("event_id") % 2 == 0), ["x", "y", "z"], flat)
    return out.select("event_id", *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"])


FLIPS = f"""{PLACED}, r AS (SELECT event_id, CAST(user_id AS VARCHAR) AS pilot, event_id % 3 AS plane_exit_id, round(x * 1000) AS x_m, round(y * 1000) AS y_m, round(z * 1000) AS z_m, CASE WHEN event_id % 4 > 0 THEN event_id % 7 / 8.0 END AS dir_x, CASE WHEN event_id % 4 > 0 THEN event_id % 5 / 8.0 END AS dir_y, CASE WHEN event_id % 4 > 0 THEN 0.5 END AS dir_z,
CASE WHEN event_id % 2 = 0 THEN 'cw' ELSE 'ccw' END AS plane_exit, CASE WHEN event_id % 5 > 0 THEN '0.600000 0.000000 0.800000 1500' END AS plane FROM q)"""


@query(f"""WITH {FLIPS}, m AS (SELECT *, pilot IN ('3', '8') AND plane_exit_id = 1 AND plane IS NOT NULL AS c, 2 * (0.6 * x_m + 0.8 * z_m - 1500) AS o, 2 * (0.6 * dir_x + 0.8 * dir_z) AS w FROM r)
SELECT event_id, CASE WHEN c THEN round(x_m - 0.6 * o) ELSE x_m END AS x_m, y_m, CASE WHEN c THEN round(z_m - 0.8 * o) ELSE z_m END AS z_m, round(CASE WHEN c THEN dir_x - 0.6 * w ELSE dir_x END, 4) AS dir_x, dir_y, round(CASE WHEN c THEN dir_z - 0.8 * w ELSE dir_z END, 4) AS dir_z, CASE WHEN NOT c THEN plane_exit WHEN plane_exit = 'cw' THEN 'ccw' ELSE 'cw' END AS plane_exit FROM m""")
def flipped_exits(spark, sf_dir):
    """One exit of two pilots on the other side of the observers' plane."""
    id_ = F.col("event_id")
    way = [F.when(id_ % 4 > 0, v).alias(c) for c, v in (("dir_x", id_ % 7 / 8), ("dir_y", id_ % 5 / 8), ("dir_z", F.lit(0.5)))]
    rows = placed(spark, sf_dir).select("event_id", F.col("user_id").cast("string").alias("pilot"), (id_ % 3).alias("plane_exit_id"), *[F.round(F.col(c) * 1000).alias(f"{c}_m") for c in "xyz"], *way, F.when(id_ % 2 == 0, "cw").otherwise("ccw").alias("plane_exit"), F.when(id_ % 5 > 0, "0.600000 0.000000 0.800000 1500").alias("plane"))
    for pilot in ("3", "8"):
        rows = contacts.exit_flipped(rows, F.lit(pilot), F.lit(1))
    places = [(F.col(c) + 0.0).alias(c) for c in ("x_m", "y_m", "z_m")]
    return rows.select("event_id", *places, *[(F.round(c, 4) + 0.0).alias(c) for c in ("dir_x", "dir_y", "dir_z")], "plane_exit")


@query(f"""WITH {EVENTS}, l AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM e), f AS (SELECT user_id, min((us, event_id)) AS stop FROM l WHERE event_type = 'error' AND before <> 'error' GROUP BY user_id)
SELECT event_id, event_type, CASE WHEN stop IS NULL OR (us, event_id) < stop THEN value END AS value, stop IS NOT NULL AND (us, event_id) = stop AS pod FROM e LEFT JOIN f USING (user_id) WHERE stop IS NULL OR (us, event_id) <= stop""")
def frozen_pods(spark, sf_dir):
    return motion.frozen_pods(events(spark, sf_dir), "user_id", "us", "event_id", "event_type", "error", ["value"]).select("event_id", "event_type", "value", "pod")


@query(f"""WITH {EVENTS}, l AS (SELECT user_id, event_id, us, event_type, lead(event_type) OVER w AS after, lead(us) OVER w AS end_us FROM e WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
p AS (SELECT user_id, us AS start_us, end_us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS nth FROM l WHERE event_type = 'view' AND after = 'click'), n AS (SELECT user_id, count(*) AS n FROM p GROUP BY user_id),
a AS (SELECT DISTINCT user_id, CASE user_id % 4 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 9 END AS which, coalesce(n, 0) AS n FROM e LEFT JOIN n USING (user_id)), r AS (SELECT *, CASE WHEN n = 0 THEN 'none' WHEN which IS NULL AND n > 1 THEN 'several' WHEN which > n THEN 'no such' END AS reason FROM a)
SELECT user_id, start_us, end_us, nth, reason FROM r JOIN p USING (user_id) WHERE reason IS NULL AND (which IS NULL OR which = 0 OR which = nth) UNION ALL SELECT user_id, NULL, NULL, NULL, reason FROM r WHERE reason IS NOT NULL""")
def picked_pairs(spark, sf_dir):
    """Matches between a start and an end of each recording: all, the second, the ninth or the only one."""
    u = F.col("user_id")
    asked = events(spark, sf_dir).select("user_id", F.when(u % 4 == 1, 0).when(u % 4 == 2, 2).when(u % 4 == 3, 9).alias("which"))
    return intervals.picked(asked, start_end_pairs(spark, sf_dir), "user_id", "which", "nth")


ICONS = {3: "capsule", 7: "frigate", 11: "shuttle"}
WORDS = [("red", "titan"), ("ee", "carrier"), ("a", "cruiser")]


@query("""SELECT p_partkey, CASE p_partkey % 20 WHEN 3 THEN 'capsule' WHEN 7 THEN 'frigate' WHEN 11 THEN 'shuttle' ELSE CASE WHEN contains(lower(p_name), 'red') THEN 'titan' WHEN contains(lower(p_name), 'ee') THEN 'carrier' WHEN contains(lower(p_name), 'a') THEN 'cruiser' ELSE 'hull' END END AS icon FROM part""")
def hull_icons(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", naming.hull_icon((F.col("p_partkey") % 20).cast("int"), F.col("p_name"), ICONS, WORDS, "hull").alias("icon"))


@query(f"""WITH {POINTS} SELECT p.vec_id AS a, r.vec_id AS b, round(sqrt((p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y) + (p.z - r.z) * (p.z - r.z)), 4) AS distance FROM q p JOIN q r ON p.vec_id < r.vec_id
WHERE sqrt((p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y) + (p.z - r.z) * (p.z - r.z)) <= 2""")
def sphere_contacts(spark, sf_dir):
    return contacts.within(points(spark, sf_dir), "vec_id", ["x", "y", "z"], 2.0).select("a", "b", rounded("distance").alias("distance"))


@query(f"""WITH {POINTS}, d AS (SELECT p.vec_id AS a, r.vec_id AS b, sqrt((p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y) + (p.z - r.z) * (p.z - r.z)) AS distance FROM q p JOIN q r ON p.vec_id <> r.vec_id)
SELECT a, arg_min(b, (distance, b)) AS nearest, round(min(distance), 4) AS distance FROM d WHERE distance <= 2 GROUP BY a""")
def nearest_ship(spark, sf_dir):
    pairs = contacts.within(points(spark, sf_dir), "vec_id", ["x", "y", "z"], 2.0)
    return contacts.nearest(pairs).select("a", "nearest", rounded("distance").alias("distance"))


@query(f"""WITH {EVENTS}, l AS (SELECT user_id, event_id, us, event_type, lead(event_type) OVER w AS after, lead(us) OVER w AS end_us FROM e WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT user_id, us AS start_us, end_us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS nth FROM l WHERE event_type = 'view' AND after = 'click'""")
def start_end_pairs(spark, sf_dir):
    e = events(spark, sf_dir).filter(F.col("event_type").isin("view", "click"))
    n = windows.neighbours(e, "user_id", "us", ["us", "event_type"], "event_id").filter("event_type = 'view' AND next_event_type = 'click'")
    n = windows.running(n, ["user_id"], "us", "event_id", {"nth": ("count", None)})
    return n.select("user_id", F.col("us").alias("start_us"), F.col("next_us").alias("end_us"), "nth")


@query(f"""WITH {EVENTS}, c AS (SELECT event_id, us, (event_id * 7919) % 86400 AS clock FROM e) SELECT event_id, arg_min(d.day, (abs((us // {DAY} + d.day) * {DAY} + clock * 1000000 - us), d.day)) AS day_off, min(abs((us // {DAY} + d.day) * {DAY} + clock * 1000000 - us)) AS off_us FROM c, (VALUES (-1), (0), (1)) d(day) GROUP BY event_id""")
def nearest_day(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("clock", F.col("event_id") * 7919 % 86400)
    midnight = F.floor(F.col("us") / DAY).cast("long")
    choices = F.array(*[F.struct(F.abs((midnight + d) * DAY + F.col("clock") * 1_000_000 - F.col("us")).alias("off"), F.lit(d).alias("day")) for d in (-1, 0, 1)])
    return e.withColumn("best", F.array_min(choices)).select("event_id", F.col("best.day").alias("day_off"), F.col("best.off").alias("off_us"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 20 END, -1) DESC, lower(p_name), p_partkey DESC) AS place FROM part QUALIFY place <= 100""")
def roster_order(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    points_ = F.coalesce(F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 20), F.lit(-1))
    first = p.select("p_partkey", points_.alias("__p"), F.lower("p_name").alias("__n")).orderBy(F.desc("__p"), "__n", F.desc("p_partkey")).limit(100)
    w = Window.orderBy(F.desc("__p"), "__n", F.desc("p_partkey"))  # of a hundred rows
    return first.withColumn("place", F.row_number().over(w).cast("long")).select("p_partkey", "place")


TICKED = f"""f AS (SELECT event_id, user_id, us // {HOUR} AS tick, us FROM e WHERE event_id % 2 = 0), h AS (SELECT user_id, us // {HOUR} AS tick, max(value) AS hp FROM e WHERE event_id % 2 = 1 GROUP BY ALL),
x AS (SELECT user_id, event_id AS exit_id, us AS t0, us + {12 * HOUR} AS t1 FROM e WHERE event_type = 'error')"""


@query(f"""WITH {EVENTS}, {TICKED}, j AS (SELECT f.event_id, max(h.hp) AS hp, arg_max(x.exit_id, (x.t0, x.exit_id)) AS exit_id, max(p.p_retailprice) AS points FROM f LEFT JOIN h USING (user_id, tick) LEFT JOIN x ON x.user_id = f.user_id AND x.t0 < f.us AND f.us < x.t1 LEFT JOIN part p ON p.p_partkey = f.user_id GROUP BY f.event_id)
SELECT event_id, round(hp, 4) AS hp, exit_id, points FROM j""")
def tick_join(spark, sf_dir):
    from trackloom.operators import intervals

    e = events(spark, sf_dir).withColumn("tick", F.floor(F.col("us") / HOUR).cast("long"))
    fixes = e.filter("event_id % 2 = 0").select("event_id", "user_id", "tick", "us")
    hp = e.filter("event_id % 2 = 1").groupBy("user_id", "tick").agg(F.max("value").alias("hp"))
    spans = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("exit_id"), (F.col("us") + 1).alias("t0"), (F.col("us") + 12 * HOUR).alias("t1"))
    hit = intervals.stab(fixes.select("event_id", "user_id", "us"), spans, "us", 12 * HOUR, ["user_id"]).groupBy("event_id").agg(F.max_by("exit_id", F.struct("t0", "exit_id")).alias("exit_id"))
    value = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("user_id"), F.col("p_retailprice").alias("points"))
    out = fixes.join(hp, ["user_id", "tick"], "left").join(hit, "event_id", "left").join(value, "user_id", "left")
    return out.select("event_id", F.round("hp", 4).alias("hp"), "exit_id", "points")


@query("""WITH f AS (SELECT DISTINCT 'match ' || (p_partkey % 400) AS name FROM part WHERE p_partkey % 3 > 0), a AS (SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN 'match ' || (p_partkey % 400) ELSE 'rec' || (p_partkey % 9) || '_' || (p_partkey % 700) END AS name FROM part WHERE p_partkey % 4 > 0),
s AS (SELECT f.name, a.name AS audio FROM f LEFT JOIN a ON a.name = f.name), n AS (SELECT name, TRY_CAST(nullif(regexp_extract(name, '([0-9]+)$', 1), '') AS BIGINT) AS k FROM s WHERE audio IS NULL), r AS (SELECT name AS audio, TRY_CAST(nullif(regexp_extract(name, '([0-9]+)$', 1), '') AS BIGINT) AS k FROM a WHERE name NOT IN (SELECT name FROM f)),
n1 AS (SELECT k, max(name) AS name FROM n WHERE k IS NOT NULL GROUP BY k HAVING count(*) = 1), r1 AS (SELECT k, max(audio) AS audio FROM r WHERE k IS NOT NULL GROUP BY k HAVING count(*) = 1)
SELECT s.name, coalesce(s.audio, r1.audio) AS audio FROM s LEFT JOIN n1 USING (name) LEFT JOIN r1 USING (k)""")
def pair_audio(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    files = part.filter("p_partkey % 3 > 0").selectExpr("'match ' || (p_partkey % 400) AS name").distinct()
    audio = part.filter("p_partkey % 4 > 0").selectExpr("CASE WHEN p_partkey % 5 = 0 THEN 'match ' || (p_partkey % 400) ELSE 'rec' || (p_partkey % 9) || '_' || (p_partkey % 700) END AS name").distinct()
    return contacts.paired(files, audio, "name")
