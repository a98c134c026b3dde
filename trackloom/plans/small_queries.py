"""Queries on single values, instants and order, each with the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import geometry, motion, rates, windows
from trackloom.plans.combat_queries import INSTANTS, instants
from trackloom.plans.library_queries import FILES, files
from trackloom.plans.match_queries import DAY, EVENTS, HOUR, events, table
from trackloom.plans.motion_queries import PLACED, placed

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}
ORIGIN = 1_704_067_200_000_000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {EVENTS} SELECT event_id, round((us - {ORIGIN}) / 1e6, 6) AS match_s, {ORIGIN} + CAST(round((us - {ORIGIN}) / 1e6 * 1e6) AS BIGINT) AS back_us FROM e""")
def match_clock(spark, sf_dir):
    s = motion.match_seconds(F.col("us"), F.lit(ORIGIN))
    return events(spark, sf_dir).select("event_id", F.round(s, 6).alias("match_s"), motion.clock_us(s, F.lit(ORIGIN)).alias("back_us"))


@query(f"""WITH {EVENTS}, o AS (SELECT user_id, event_id % 3 AS observer, min(us) FILTER (event_type = 'error') AS first_us FROM e GROUP BY ALL) SELECT user_id, min(first_us) AS capsule_us, count(first_us) AS n_observers FROM o GROUP BY user_id""")
def first_capsule(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("observer", F.col("event_id") % 3)
    each = e.groupBy("user_id", "observer").agg(F.min(F.when(F.col("event_type") == "error", F.col("us"))).alias("first_us"))
    return each.groupBy("user_id").agg(F.min("first_us").alias("capsule_us"), F.count("first_us").alias("n_observers"))


@query(f"""WITH {PLACED}, v AS (SELECT q.*, CASE WHEN event_id % 9 > 0 THEN value END AS told FROM q JOIN e USING (event_id)),
k AS (SELECT a.user_id, a.us, a.x, a.y, a.z, min((b.us, b.x, b.y, b.z)) AS e FROM v a JOIN v b ON a.user_id = b.user_id AND b.us BETWEEN a.us + {60 * HOUR} AND a.us + {84 * HOUR} GROUP BY a.event_id, a.user_id, a.us, a.x, a.y, a.z),
p AS (SELECT k.user_id, k.us, k.x, k.y, k.z, k.e, avg(told) AS mean FROM k JOIN v ON k.user_id = v.user_id AND v.us BETWEEN k.us AND k.e[1] GROUP BY k.user_id, k.us, k.x, k.y, k.z, k.e HAVING count(told) >= 5 AND avg(told) >= 40),
r AS (SELECT user_id, abs(sqrt((x - e[2]) * (x - e[2]) + (y - e[3]) * (y - e[3]) + (z - e[4]) * (z - e[4])) / ((e[1] - us) / {HOUR}.0) - mean) / mean AS error FROM p)
SELECT user_id, count(*) AS n_windows, round(list_sort(list(error))[len(list(error)) // 2 + 1], 4) AS error FROM r GROUP BY user_id""")
def speed_error(spark, sf_dir):
    told = F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("told")
    v = placed(spark, sf_dir).join(events(spark, sf_dir).select("event_id", told), "event_id")
    out = motion.speed_errors(v, "user_id", "us", ["x", "y", "z"], "told", 60 * HOUR, 84 * HOUR, HOUR, slowest=40.0)
    return out.withColumn("error", F.round("error", 4))


@query(f"""WITH {PLACED}, d AS (SELECT user_id, us, sqrt(x * x + y * y + z * z) AS d, event_id % 101 = 7 AS pod FROM q), c AS (SELECT user_id, min(us) AS lost FROM d WHERE pod GROUP BY user_id),
o AS (SELECT user_id, us, d > 60 AS far FROM d LEFT JOIN c USING (user_id) WHERE (lost IS NULL OR us < lost) AND (d > 60 OR d <= 50)),
g AS (SELECT *, sum(CASE WHEN far THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g, lead(us) OVER (PARTITION BY user_id ORDER BY us) AS after FROM o)
SELECT user_id, min(us) AS out_us, max(after) AS back_us FROM g WHERE far GROUP BY user_id, g HAVING max(after) - min(us) >= {6 * HOUR} AND count(*) = count(after)""")
def re_entries(spark, sf_dir):
    """Ways back inside 50 after six hours or more beyond 60, before a key's first capsule."""
    d = geometry.norm(tuple(F.col(c) for c in "xyz"))
    p = placed(spark, sf_dir).select("user_id", "us", F.when(d > 60, True).when(d <= 50, False).alias("far"), (F.col("event_id") % 101 == 7).alias("pod"))
    return motion.re_entries(p, "user_id", "us", "far", 6 * HOUR, "pod")


@query(f"""WITH {PLACED}, n AS (SELECT *, sqrt(x * x + y * y + z * z) AS d FROM q) SELECT event_id, round(x + CASE WHEN d > 0 THEN x / d ELSE 0 END * 100, 4) + 0.0 AS x, round(y + CASE WHEN d > 0 THEN y / d ELSE 0 END * 100, 4) + 0.0 AS y, round(z + CASE WHEN d > 0 THEN z / d ELSE 0 END * 100, 4) + 0.0 AS z, round(d + event_id % 5, 4) AS padded,
round(greatest(d - event_id % 5 - 3, 0), 4) AS gap, d - event_id % 5 <= 40 AS reached FROM n""")
def projections(spark, sf_dir):
    here = tuple(F.col(c) for c in "xyz")
    d, radius = geometry.norm(here), F.col("event_id") % 5
    ahead = geometry.landing(here, here, 100.0)
    return placed(spark, sf_dir).select(
        "event_id", *[(F.round(c, 4) + 0.0).alias(n) for c, n in zip(ahead, "xyz")], F.round(d + radius, 4).alias("padded"),
        F.round(geometry.hull_gap(d, radius, F.lit(3.0)), 4).alias("gap"), geometry.in_reach(d, radius, F.lit(40.0)).alias("reached"),
    )


@query("""WITH w(word) AS (VALUES ('Name'), ('Type'), ('Distance'), ('Velocity')), p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'nAme' WHEN 1 THEN 'Distnce' WHEN 2 THEN 'Vel0c1ty' WHEN 3 THEN 'Typ' WHEN 4 THEN 'Shield' ELSE 'Distancexyz' END AS seen FROM part),
s AS (SELECT p_partkey, word, levenshtein(lower(seen), lower(word)) AS d FROM p, w) SELECT p_partkey, arg_min(word, (d, word)) FILTER (d <= 2) AS keyword FROM s GROUP BY p_partkey""")
def header_keywords(spark, sf_dir):
    k = F.col("p_partkey") % 6
    seen = F.element_at(F.array(*map(F.lit, ("nAme", "Distnce", "Vel0c1ty", "Typ", "Shield", "Distancexyz"))), k.cast("int") + 1)
    words = ("Name", "Type", "Distance", "Velocity")
    near = F.array(*[F.struct(F.levenshtein(F.lower(seen), F.lit(w.lower())).alias("d"), F.lit(w).alias("word")) for w in words])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_min(F.filter(near, lambda x: x["d"] <= 2))["word"].alias("keyword"))


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY abs(us - {ORIGIN + 14 * DAY}), event_id) AS k FROM e) SELECT user_id, arg_max(event_id, (value, -k)) AS chosen, count(*) AS tried FROM r WHERE k <= 5 GROUP BY user_id""")
def nearest_first(spark, sf_dir):
    first = windows.top_per_group(events(spark, sf_dir), "user_id", [F.abs(F.col("us") - F.lit(ORIGIN + 14 * DAY)), F.col("event_id")], 5)
    return first.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("place"))).alias("chosen"), F.count(F.lit(1)).alias("tried"))


@query(f"""WITH {FILES} SELECT path, CAST(row_number() OVER (ORDER BY len(string_split(path, '/')) DESC, path DESC) AS BIGINT) AS turn FROM files WHERE path LIKE '%/'""")
def folders_deepest_first(spark, sf_dir):
    folders = files(spark, sf_dir).filter("path LIKE '%/'").select("path")
    return windows.accumulated(folders, [], [F.size(F.split("path", "/")).desc(), F.desc("path")], F.lit(1).cast("long"), "turn")


@query(f"""WITH {FILES} SELECT path, sha, size FROM files WHERE path = 'S0/' OR owner = 3 ORDER BY path""")
def files_by_path(spark, sf_dir):
    return files(spark, sf_dir).filter((F.col("path") == "S0/") | (F.col("owner") == 3)).select("path", "sha", "size").orderBy("path")


@query(f"""WITH {EVENTS}, {INSTANTS}, u AS (SELECT DISTINCT user_id FROM e), g AS (SELECT user_id, instant FROM u, i), a AS (SELECT g.*, e.value AS hp, e.event_type AS last_kind FROM g ASOF LEFT JOIN e ON g.user_id = e.user_id AND g.instant >= e.us),
r AS (SELECT user_id, instant, sum(value) / 6.0 AS rate, count(DISTINCT event_type) AS kinds FROM e JOIN i ON us <= instant AND instant < us + {6 * HOUR} GROUP BY ALL)
SELECT a.user_id, a.instant, round(hp, 4) AS hp, last_kind, round(coalesce(rate, 0), 4) AS rate, coalesce(kinds, 0) AS kinds, coalesce(p_partkey % 20 + 1, 0) AS points FROM a LEFT JOIN r USING (user_id, instant) LEFT JOIN part ON p_partkey = a.user_id""")
def live_roster(spark, sf_dir):
    e = events(spark, sf_dir)
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("user_id"), (F.col("p_partkey") % 20 + 1).alias("points"))
    out = rates.live_view(e, instants(spark), "user_id", "event_type", "value", 6 * HOUR, HOUR).join(points, "user_id", "left")
    return out.select("user_id", "instant", F.round("hp", 4).alias("hp"), "last_kind", F.round("rate", 4).alias("rate"), "kinds", F.coalesce("points", F.lit(0)).alias("points"))
