"""Queries on tracks in time and on teams, each with the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import geometry, motion, teams
from trackloom.plans.match_queries import DAY, EVENTS, HOUR, events, rounded, table

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}
START = 1_704_067_200_000_000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


GRID = f"g AS (SELECT user_id, {START} + {6 * HOUR} * k AS us FROM (SELECT DISTINCT user_id FROM events), range(0, 120) r(k))"
SEGMENTS = f"""{EVENTS}, {GRID}, s AS (SELECT *, event_type = 'purchase' AS hop FROM e), n AS (SELECT user_id, us AS t, value AS v, lag(us) OVER w AS t0, lag(value) OVER w AS v0, lead(us) OVER w AS t1, lead(value) OVER w AS v1, lead(us, 2) OVER w AS t2,
lead(value, 2) OVER w AS v2, hop AS j1, coalesce(lead(hop) OVER w, false) AS j2, coalesce(lead(hop, 2) OVER w, false) AS j3 FROM s WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))"""


def grid(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(119)), lambda k: F.lit(START) + k.cast("long") * 6 * HOUR)).alias("us"))


@query(f"""WITH {SEGMENTS}, j AS (SELECT g.user_id, g.us, n.* EXCLUDE (user_id), (g.us - t) / (t1 - t) AS w FROM g ASOF LEFT JOIN n ON g.user_id = n.user_id AND g.us >= n.t),
b AS (SELECT *, t0 IS NOT NULL AND t - t0 <= {12 * HOUR} AND NOT j1 AS back, t2 IS NOT NULL AND t2 - t1 <= {12 * HOUR} AND NOT j3 AS fore FROM j),
p AS (SELECT *, CASE WHEN back THEN v0 ELSE v * 2 - v1 END AS a, CASE WHEN back THEN t0 - t ELSE t - t1 END::DOUBLE AS at0, CASE WHEN fore THEN v2 ELSE v1 * 2 - v END AS z, CASE WHEN fore THEN t2 - t ELSE (t1 - t) * 2 END::DOUBLE AS zt, (t1 - t)::DOUBLE AS et, ((t1 - t) * w)::DOUBLE AS x FROM b),
l AS (SELECT *, a + (v - a) * ((x - at0) / -at0) AS a1, v + (v1 - v) * (x / et) AS a2, v1 + (z - v1) * ((x - et) / (zt - et)) AS a3 FROM p),
c AS (SELECT *, a1 + (a2 - a1) * ((x - at0) / (et - at0)) AS b1, a2 + (a3 - a2) * (x / zt) AS b2 FROM l)
SELECT user_id, us, round(CASE WHEN t = us THEN v WHEN t1 IS NOT NULL AND t1 - t <= {12 * HOUR} THEN CASE WHEN j2 THEN v ELSE b1 + (b2 - b1) * (x / et) END END, 4) AS value FROM c""")
def smooth_interp(spark, sf_dir):
    s = events(spark, sf_dir).withColumn("hop", F.col("event_type") == "purchase")
    out = motion.sampled(grid(spark, sf_dir), s, "user_id", "us", ["value"], "event_id", 12 * HOUR, smooth=True, hop="hop")
    return out.select("user_id", "us", rounded("value").alias("value"))


@query(f"""WITH {SEGMENTS}, h AS (SELECT user_id, us, d, us + d AS ask FROM g, (VALUES ({-HOUR}), (0), ({HOUR})) x(d)), j AS (SELECT h.*, n.* EXCLUDE (user_id) FROM h ASOF LEFT JOIN n ON h.user_id = n.user_id AND h.ask >= n.t),
v AS (SELECT user_id, us, d, CASE WHEN t = ask THEN v WHEN t1 IS NOT NULL AND t1 - t <= {12 * HOUR} THEN v + (v1 - v) * ((ask - t) / (t1 - t)) END AS v FROM j),
p AS (SELECT user_id, us, max(v) FILTER (d < 0) AS a, max(v) FILTER (d = 0) AS b, max(v) FILTER (d > 0) AS c FROM v GROUP BY ALL)
SELECT user_id, us, round(CASE WHEN a IS NOT NULL OR c IS NOT NULL THEN (coalesce(c, b) - coalesce(a, b)) / (CASE WHEN a IS NULL THEN 0 ELSE 3600 END + CASE WHEN c IS NULL THEN 0 ELSE 3600 END) END, 6) + 0.0 AS velocity FROM p""")
def velocity_at(spark, sf_dir):
    out = motion.velocity(grid(spark, sf_dir), events(spark, sf_dir), "user_id", "us", "value", "event_id", 12 * HOUR, HOUR)
    return out.select("user_id", "us", (F.round("velocity", 6) + 0.0).alias("velocity"))


PLACED = f"{EVENTS}, q AS (SELECT event_id, user_id, event_type, us, value - 50 AS x, CAST(event_id % 97 - 48 AS DOUBLE) AS y, CAST(event_id % 89 - 44 AS DOUBLE) AS z FROM e)"


def diagonal() -> tuple:
    """The plane through the origin across the diagonal, its normal in whole numbers."""
    return geometry.vec(0, 0, 0), geometry.vec(1, 1, 1), F.sqrt(F.lit(3.0))


def placed(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", "user_id", "event_type", "us", (F.col("value") - 50).alias("x"), (F.col("event_id") % 97 - 48).cast("double").alias("y"), (F.col("event_id") % 89 - 44).cast("double").alias("z"))


@query(f"""WITH {PLACED}, l AS (SELECT *, us - lag(us) OVER w AS dt, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w)) AS step FROM q WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id, round(step, 4) AS step, coalesce(abs(step - 60) <= 10 AND dt <= {12 * HOUR}, false) AS hop FROM l""")
def hop_events(spark, sf_dir):
    return motion.hops(placed(spark, sf_dir), "user_id", "us", ["x", "y", "z"], "event_id", 60.0, 10.0, 12 * HOUR).select("event_id", rounded("step").alias("step"), "hop")


@query(f"""WITH {EVENTS}, b AS (SELECT us // {DAY} AS match, value, lag(us) OVER (PARTITION BY us // {DAY}, user_id ORDER BY us, event_id) AS before FROM e) SELECT match, min(before) AS start_us FROM b WHERE before IS NOT NULL AND value > 60 GROUP BY match""")
def match_starts(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("match", F.floor(F.col("us") / DAY).cast("long"))
    return motion.starts(e, "match", "user_id", "us", F.col("value") > 60, "event_id")


@query(f"""WITH {PLACED}, l AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lag(z) OVER w AS az, lag(us) OVER w AS aus FROM q WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
f AS (SELECT * FROM l WHERE sqrt(x * x + y * y + z * z) > 62 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) = 1),
k AS (SELECT *, (x - ax) * (x - ax) + (y - ay) * (y - ay) + (z - az) * (z - az) AS qa, 2 * (ax * (x - ax) + ay * (y - ay) + az * (z - az)) AS qb, ax * ax + ay * ay + az * az - 3844 AS qc FROM f),
s AS (SELECT *, CASE WHEN aus IS NULL THEN 1.0 WHEN qa > 0 AND qb * qb - 4 * qa * qc >= 0 AND (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) BETWEEN 0 AND 1 THEN (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) ELSE 1.0 END AS w FROM k)
SELECT user_id, round(CASE WHEN aus IS NULL THEN us ELSE aus + (us - aus) * w END / 1e6, 2) AS left_s, round(CASE WHEN aus IS NULL THEN x ELSE ax + (x - ax) * w END, 4) + 0.0 AS x, round(CASE WHEN aus IS NULL THEN y ELSE ay + (y - ay) * w END, 4) + 0.0 AS y, round(CASE WHEN aus IS NULL THEN z ELSE az + (z - az) * w END, 4) + 0.0 AS z FROM s""")
def first_crossings(spark, sf_dir):
    out = motion.first_leaving(placed(spark, sf_dir), "user_id", "us", ["x", "y", "z"], "event_id", 62.0)
    return out.select("user_id", F.round(F.col("left_us") / 1e6, 2).alias("left_s"), *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"])


@query(f"""WITH {EVENTS} SELECT user_id, min(us) AS lost_us, arg_min(event_type, (us, event_type)) AS lost_by FROM e WHERE event_type IN ('error', 'purchase') GROUP BY user_id""")
def loss_times(spark, sf_dir):
    return motion.first_loss(events(spark, sf_dir), "user_id", "us", "event_type", ["error", "purchase"]).withColumnRenamed("by", "lost_by")


PILOTS = "p AS (SELECT c_nationkey AS match, c_custkey AS pilot, CASE WHEN c_custkey % 11 < 4 THEN c_custkey % 3 WHEN c_custkey % 11 < 9 THEN c_custkey % 8 END AS corner, c_custkey * 37 % 1000 AS away FROM customer)"
CAP = 15
TEAMS = f"""{PILOTS}, n AS (SELECT match, corner, count(*) AS n FROM p WHERE corner IS NOT NULL GROUP BY ALL), k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY match ORDER BY n DESC, corner) <= 2),
c AS (SELECT match, corner, row_number() OVER (PARTITION BY match ORDER BY corner) - 1 AS team FROM k), a AS (SELECT p.*, c.team FROM p LEFT JOIN c USING (match, corner)),
b AS (SELECT *, count(*) FILTER (team = 0) OVER (PARTITION BY match) AS nb, count(*) FILTER (team = 1) OVER (PARTITION BY match) AS nr, row_number() OVER (PARTITION BY match, team ORDER BY away DESC, pilot DESC) AS far FROM a),
m AS (SELECT match, pilot, CASE WHEN team = 0 AND far <= least(nb - {CAP}, {CAP} - nr) THEN 1 WHEN team = 1 AND far <= least(nr - {CAP}, {CAP} - nb) THEN 0 ELSE team END AS team FROM b)"""
FILL = """SELECT match, pilot, CAST(CASE WHEN nb >= {cap} AND f <= {cap} - nr THEN 1 WHEN nb < {cap} AND nr >= {cap} AND f <= {cap} - nb THEN 0 ELSE team END AS INTEGER) AS team FROM
(SELECT *, CASE WHEN free THEN row_number() OVER (PARTITION BY match, free ORDER BY pilot) END AS f FROM (SELECT *, count(*) FILTER (team = 0) OVER (PARTITION BY match) AS nb, count(*) FILTER (team = 1) OVER (PARTITION BY match) AS nr, team IS NULL AND NOT {pinned} AS free FROM {source}))"""


def assigned(spark, sf_dir):
    c = F.col("c_custkey")
    corner = F.when(c % 11 < 4, c % 3).when(c % 11 < 9, c % 8)
    p = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("match"), c.alias("pilot"), corner.alias("corner"), (c * 37 % 1000).alias("away"))
    return teams.assign(p, "match", "pilot", "corner", "away", CAP)


@query(f"WITH {TEAMS} {FILL.format(cap=CAP, pinned='false', source='m')}")
def team_assignment(spark, sf_dir):
    return assigned(spark, sf_dir).select("match", "pilot", F.col("team").cast("int").alias("team"))


@query(f"""WITH {TEAMS}, t AS ({FILL.format(cap=CAP, pinned='false', source='m')}), o AS (SELECT match, pilot, CASE WHEN pilot % 13 = 2 THEN NULL ELSE coalesce(CASE WHEN pilot % 17 = 3 THEN 1 END, CASE WHEN pilot % 7 = 1 THEN 0 END, team) END AS team FROM t),
s AS ({FILL.format(cap=CAP, pinned='(pilot % 13 = 2)', source='o')}) SELECT match, pilot, team, team IS NULL AS unsettled FROM s""")
def team_settlement(spark, sf_dir):
    p = F.col("pilot")
    out = teams.settle(assigned(spark, sf_dir), "match", "pilot", F.when(p % 7 == 1, 0), F.when(p % 17 == 3, 1), p % 13 == 2, CAP)
    return out.select("match", "pilot", F.col("team").cast("int").alias("team"), F.col("team").isNull().alias("unsettled"))


@query("""WITH t AS (SELECT c_nationkey AS match, c_custkey % 2 AS side, CASE WHEN c_custkey % 5 < 4 THEN c_custkey % 7 // 2 END AS team FROM customer), v AS (SELECT match, side, team, count(*) AS votes FROM t WHERE team IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY match, side ORDER BY votes DESC, team) AS k FROM v), b AS (SELECT *, row_number() OVER (PARTITION BY match, team ORDER BY votes DESC, side) AS c FROM k WHERE k = 1)
SELECT match, side, CASE WHEN b.c = 1 THEN b.team ELSE n.team END AS team, CASE WHEN b.c = 1 THEN b.votes ELSE n.votes END AS votes FROM b LEFT JOIN (SELECT * FROM k WHERE k = 2) n USING (match, side)""")
def side_votes(spark, sf_dir):
    c = F.col("c_custkey")
    t = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("match"), (c % 2).alias("side"), F.when(c % 5 < 4, F.floor(c % 7 / 2)).alias("team"))
    return teams.sides(t, "match", "side", "team")
