"""Queries of names, paths, types, scores, windows and tracks, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import naming
from trackloom.operators import fuzzy, geometry, graph, hierarchy, scores, tracks
from trackloom.plans.match_queries import DAY, EVENTS, HOUR, PATHS, POINTS, events, paths, points, rounded, table
from trackloom.streaming import counters

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


ENDINGS = "path || CASE page_id % 4 WHEN 0 THEN '.positions.csv' WHEN 1 THEN '.positions.LOGS/x.txt' WHEN 2 THEN '/.hidden' ELSE '' END"


@query(f"""WITH {PATHS}, x AS (SELECT page_id, {ENDINGS} AS path FROM p) SELECT page_id, path, CASE WHEN regexp_matches(path, '{naming.IN_LOGS}') THEN regexp_extract(path, '{naming.IN_LOGS}', 1)
WHEN regexp_matches(path, '{naming.WITHOUT_EXTENSION}') THEN regexp_extract(path, '{naming.WITHOUT_EXTENSION}', 1) ELSE path END AS match_key, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '' END AS season FROM x""")
def match_keys(spark, sf_dir):
    p = paths(spark, sf_dir).withColumn("path", F.expr(ENDINGS))
    return p.select("page_id", "path", naming.match_key(F.col("path")).alias("match_key"), naming.season(F.col("path")).alias("season"))


NAME = "'Pilot  ' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN ' Nova' WHEN 1 THEN ' of Stars' ELSE '' END"


@query(f"""WITH n AS (SELECT c_custkey, {NAME} AS name FROM customer), w AS (SELECT *, string_split_regex(trim(name), ' +') AS w FROM n) SELECT c_custkey, array_to_string(list_concat([w[1]], list_transform(w[2:], lambda x: left(x, 1) || '.')), ' ') AS short FROM w""")
def short_names(spark, sf_dir):
    n = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{NAME} AS name")
    return n.select("c_custkey", naming.short_name(F.col("name")).alias("short"))


VERSION = "'v' || (o_orderkey % 3) || '.' || (o_orderkey % 11) || '.' || (o_custkey % 13)"


@query(f"""WITH v AS (SELECT o_orderkey, {VERSION} AS version FROM orders) SELECT o_orderkey, version, list_transform(regexp_extract_all(version, '[0-9]+'), lambda x: CAST(x AS INTEGER)) > [1, 5, 3] AS newer FROM v""")
def version_order(spark, sf_dir):
    v = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{VERSION} AS version")
    return v.withColumn("newer", naming.version_key(F.col("version")) > F.array(*map(F.lit, (1, 5, 3))))


ENTRY = "CASE event_id % 6 WHEN 0 THEN 'SCRAM' WHEN 1 THEN 'NEUT' WHEN 2 THEN 'NOS' WHEN 3 THEN 'JAM' WHEN 4 THEN 'DAMAGE' ELSE 'OTHER' END AS kind, CASE user_id % 7 WHEN 0 THEN 'Warp Disruptor II' WHEN 1 THEN 'Small Neutralizer' WHEN 2 THEN 'Heavy Nosferatu' WHEN 3 THEN 'Stasis Webifier' WHEN 4 THEN 'Target Painter' WHEN 5 THEN 'Remote Sensor Booster' ELSE 'Medium Gun' END AS module"


def _ewar_sql() -> str:
    kinds = " ".join(f"WHEN kind = '{k}' THEN '{n}'" for k, n in naming.EWAR_BY_KIND.items())
    words = " ".join(f"WHEN contains(lower(module), '{p}') THEN '{n}'" for p, n in naming.EWAR_KEYWORDS)
    sized = " ".join(f"WHEN ewar = '{k}' AND contains(lower(module), '{s}') THEN {v}" for k, sizes in naming.SIZED_CYCLES.items() for s, v in sizes.items())
    plain = " ".join(f"WHEN ewar = '{k}' THEN {v}" for k, v in naming.CYCLES.items())
    return f"""WITH e AS (SELECT event_id, {ENTRY} FROM events), t AS (SELECT *, CASE WHEN kind = 'SCRAM' AND contains(lower(module), 'disrupt') THEN 'disrupt' WHEN kind = 'SCRAM' THEN 'scram' {kinds} WHEN kind IN ('DAMAGE', 'MISS', 'REMOTE_REP') THEN '' {words} ELSE '' END AS ewar FROM e)
    SELECT event_id, ewar, CAST(CASE {sized} {plain} ELSE 5.0 END AS DOUBLE) AS cycle_s, CASE WHEN ewar IN ('scram', 'disrupt', 'web') THEN 'tackle' WHEN ewar IN ('neut', 'nos') THEN 'neut' ELSE 'ewar' END AS link FROM t"""


@query(_ewar_sql())
def ewar_kinds(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("event_id", *ENTRY.replace(", CASE user_id", "\x00CASE user_id").split("\x00"))
    e = e.withColumn("ewar", naming.ewar_type(F.col("kind"), F.col("module")))
    return e.select("event_id", "ewar", naming.default_cycle(F.col("ewar"), F.col("module")).alias("cycle_s"), naming.link_kind(F.col("ewar")).alias("link"))


READING = "SELECT DISTINCT CASE n_nationkey % 5 WHEN 0 THEN n_name WHEN 1 THEN substr(n_name, 1, length(n_name) - 2) WHEN 2 THEN substr(n_name, 1, 1) || substr(n_name, 3) WHEN 3 THEN 'zzzz' || n_nationkey ELSE substr(n_name, 1, 3) END AS reading FROM nation"


@query(f"""WITH s AS ({READING}), x AS (SELECT reading, n_name, least(levenshtein(reading, n_name), coalesce(list_min(list_transform(range(greatest(length(reading) - 2, 1), least(length(reading) + 2, length(n_name) - 1) + 1), lambda n: levenshtein(reading, substr(n_name, 1, n)))), 99)) AS d FROM s, nation),
ok AS (SELECT * FROM x WHERE reading = n_name OR (length(reading) >= 4 AND d <= CASE WHEN length(reading) >= 10 THEN 2 ELSE 1 END)), g AS (SELECT reading, min(d) AS d FROM ok GROUP BY reading),
w AS (SELECT ok.reading, count(*) AS n, max(n_name) AS other, max(ok.d) AS d, max(CASE WHEN ok.reading = n_name THEN n_name END) AS exact FROM ok JOIN g ON ok.reading = g.reading AND ok.d = g.d GROUP BY ok.reading)
SELECT s.reading, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'corrected' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS status, coalesce(exact, CASE WHEN n = 1 THEN other END) AS resolved, CAST(CASE WHEN exact IS NOT NULL OR n = 1 THEN d END AS INTEGER) AS edits FROM s LEFT JOIN w ON s.reading = w.reading""")
def type_resolve(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    readings = nation.selectExpr(READING.removeprefix("SELECT DISTINCT ").removesuffix(" FROM nation")).distinct()
    return fuzzy.resolve_types(readings, nation.select("n_name"), "reading", "n_name")


INFIX = "substr(n_name, 2, 4) || 'q' AS needle, 'x' || n_name || ' II' AS hay"


@query(f"""WITH n AS (SELECT n_nationkey, {INFIX} FROM nation) SELECT n_nationkey, CAST(list_min(flatten(list_transform([0, 1, 2], lambda s: list_transform(range(0, greatest(length(hay) - s, 0) + 1), lambda n: levenshtein(needle, substr(hay, s + 1, n)))))) AS INTEGER) AS edits FROM n""")
def infix_edits(spark, sf_dir):
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey", *INFIX.split(" AS needle, ")[0:1], INFIX.split(" AS needle, ")[1])
    n = n.toDF("n_nationkey", "needle", "hay")
    return n.select("n_nationkey", fuzzy.infix_edits(F.col("needle"), F.col("hay")).alias("edits"))


@query(f"""WITH {PATHS}, f AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:len(string_split(path, '/')) - 1], '/') AS folder FROM p WHERE page_id % 7 = 0)
SELECT page_id, path, arg_max(folder, length(folder)) AS via FROM p LEFT JOIN f ON p.path = f.folder OR starts_with(p.path, f.folder || '/') GROUP BY page_id, path""")
def nearest_public(spark, sf_dir):
    p = paths(spark, sf_dir)
    public = p.filter("page_id % 7 = 0").select(hierarchy.parent("path").alias("folder"))
    return hierarchy.public_via(p.select("page_id", "path"), public, "path")


@query("""WITH o AS (SELECT o_custkey AS match, o_orderkey AS loss, o_orderkey % 2 AS team, epoch_us(o_orderdate) AS us, CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders)
SELECT match, loss, CAST(1000 + coalesce(sum(CASE WHEN team = 1 THEN value END) OVER w, 0) AS BIGINT) AS score_0, CAST(1000 + coalesce(sum(CASE WHEN team = 0 THEN value END) OVER w, 0) AS BIGINT) AS score_1 FROM o WINDOW w AS (PARTITION BY match ORDER BY us RANGE UNBOUNDED PRECEDING)""")
def score_over_time(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("match"), F.col("o_orderkey").alias("loss"), (F.col("o_orderkey") % 2).alias("team"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), F.floor("o_totalprice").cast("long").alias("value"))
    return scores.running(o, "match", "us", "team", "value", 1000).select("match", "loss", "score_0", "score_1")


@query(f"""WITH {EVENTS} SELECT user_id, us - us % {6 * HOUR} AS t0, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL""")
def windowed_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return counters.windowed(e, "user_id", "ts", "value").select("user_id", F.unix_micros("t0").alias("t0"), "n", rounded("total").alias("total"))


@query(f"""WITH {EVENTS}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > {12 * HOUR} THEN 1 ELSE 0 END AS new FROM e), s AS (SELECT user_id, us, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(us) AS t0, max(us) + {12 * HOUR} AS t1, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return counters.sessions(e, "user_id", "ts").select("user_id", F.unix_micros("t0").alias("t0"), F.unix_micros("t1").alias("t1"), "n")


@query("""SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_custkey % 50) AS unit FROM customer QUALIFY count(*) OVER (PARTITION BY c_custkey % 50) > 1""")
def linked_units(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    links = c.join(c.select((F.col("c_custkey") + 50).alias("c_custkey")).hint("merge"), "c_custkey", "left_semi").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") - 50).alias("b"))
    return graph.components(links, "a", "b")


@query(f"""WITH {POINTS} SELECT vec_id, round(sqrt(pow(greatest(-x, x - 50, 0), 2) + pow(greatest(-y, y - 50, 0), 2) + pow(greatest(-z, z - 50, 0), 2)), 4) + 0.0 AS outside FROM q""")
def outside_cube(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.select("vec_id", (rounded(geometry.outside((F.col("x"), F.col("y"), F.col("z")), 50.0)) + 0.0).alias("outside"))


OBSERVERS = [(0.0, 0.0, 0.0), (500_000.0, 0.0, 0.0), (0.0, 500_000.0, 0.0)]


def synthetic_ranges(e):
    """Readings of ships that fly straight through the cube, from events' times: ranges in whole kilometres."""
    t = (F.col("us") % DAY) / 1_000_000.0 / 60
    place = geometry.vec(150_000 + 40 * t + F.col("user_id"), 250_000 + 20 * t, F.lit(120_000.0) + 30 * t)
    far = [F.round(geometry.norm(geometry.sub(place, geometry.vec(*o))) / 1000) * 1000 for o in OBSERVERS]
    named = [F.when((F.col("event_id") % 17 != 0) | (i != 2), d).alias(n) for i, (d, n) in enumerate(zip(far, ("d_a", "d_b", "d_c")))]
    return e.select(F.floor(F.col("us") / DAY).cast("string").alias("match"), F.col("user_id").cast("string").alias("pilot"), t.alias("t"), *named, F.lit(None).cast("double").alias("speed"))


@query()
def kalman_tracks(spark, sf_dir):
    return tracks.solve_tracks(synthetic_ranges(events(spark, sf_dir)), OBSERVERS, 500_000.0)


def flown_ranges(e):
    """Readings of ships that dive through the observers' plane and jump aside every fourth hour."""
    t = (F.col("us") % DAY) / 1_000_000.0 / 60
    aside = F.when(F.floor(F.col("us") / (4 * HOUR)) % 2 == 0, 0.0).otherwise(90_000.0)
    place = geometry.vec(150_000 + 40 * t + aside, 250_000 + 20 * t, 144_000 - 200 * t)
    far = [F.round(geometry.norm(geometry.sub(place, geometry.vec(*o))) / 1000) * 1000 for o in OBSERVERS]
    named = [F.when((F.col("event_id") % 7 != 0) | (i != 1), d).alias(n) for i, (d, n) in enumerate(zip(far, tracks.RANGES))]
    speed = F.when(F.col("event_id") % 3 == 0, 200.0).alias("speed")
    return e.select(F.floor(F.col("us") / DAY).cast("string").alias("match"), F.col("user_id").cast("string").alias("pilot"), t.alias("t"), *named, speed)


def _stretches_sql() -> str:
    """Last known values per range, jumps, stretch numbers, then each stretch from whole to whole."""
    far = lambda x, y: f"round(sqrt(pow(x - {x}, 2) + pow(y - {y}, 2) + z * z) / 1000) * 1000"
    order = "ORDER BY us, d_a NULLS FIRST, d_b NULLS FIRST, d_c NULLS FIRST, speed NULLS FIRST"
    past = f"OVER (PARTITION BY match, pilot {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    last = ", ".join(f"last_value(CASE WHEN {d} IS NOT NULL THEN {{'t': t, 'd': {d}, 's': speed}} END IGNORE NULLS) {past} AS p{d}" for d in tracks.RANGES)
    jump = " OR ".join(f"coalesce(abs({d} - p{d}.d) > {tracks.JUMP} + greatest(coalesce(speed, {tracks.UNKNOWN_SPEED}), coalesce(p{d}.s, {tracks.UNKNOWN_SPEED})) * (t - p{d}.t), false)" for d in tracks.RANGES)
    return f"""WITH {EVENTS}, f AS (SELECT event_id, us AS whole_us, user_id, (us % {DAY}) / 1000000.0::DOUBLE / 60 AS t FROM e),
        q AS (SELECT *, 150000 + 40 * t + CASE WHEN (whole_us // {4 * HOUR}) % 2 = 0 THEN 0.0 ELSE 90000.0 END AS x, 250000 + 20 * t AS y, 144000 - 200 * t AS z FROM f),
        r AS (SELECT (whole_us // {DAY})::VARCHAR AS match, user_id::VARCHAR AS pilot, t, round(t * 1e6)::BIGINT AS us, {far(0, 0)} AS d_a, CASE WHEN event_id % 7 <> 0 THEN {far(500_000, 0)} END AS d_b,
            {far(0, 500_000)} AS d_c, CASE WHEN event_id % 3 = 0 THEN 200.0 END AS speed FROM q),
        l AS (SELECT *, {last} FROM r),
        j AS (SELECT *, ({jump})::BIGINT AS new FROM l),
        s AS (SELECT *, (sum(new) OVER w)::BIGINT AS stretch, row_number() OVER w AS n, d_b IS NOT NULL AS whole FROM j WINDOW w AS (PARTITION BY match, pilot {order}, new DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        k AS (SELECT *, min(n) FILTER (whole) OVER g AS first, max(n) FILTER (whole) OVER g AS last FROM s WINDOW g AS (PARTITION BY match, pilot, stretch))
        SELECT match, pilot, stretch, count(*) AS n_readings, count(*) FILTER (whole) AS n_whole, round(min(t), 4) AS begins, round(max(t), 4) AS ends FROM k WHERE n BETWEEN first AND last GROUP BY ALL"""


@query(_stretches_sql())
def track_stretches(spark, sf_dir):
    rows = tracks.stretches(flown_ranges(events(spark, sf_dir)))
    return rows.groupBy("match", "pilot", "stretch").agg(F.count(F.lit(1)).alias("n_readings"), F.count_if("whole").alias("n_whole"), F.round(F.min("t"), 4).alias("begins"), F.round(F.max("t"), 4).alias("ends"))


@query()
def track_sides(spark, sf_dir):
    """How many whole readings each run of a stretch has, and on which side of the plane it is."""
    rows = tracks.placed(flown_ranges(events(spark, sf_dir)), OBSERVERS, 500_000.0)
    return rows.filter("whole").groupBy("match", "pilot", "stretch", "run", "sign").agg(F.count(F.lit(1)).alias("n_whole"), F.count_if("clear").alias("n_clear"))
