"""Exits from the observers' plane and their settlement, with the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.operators import exits
from trackloom.plans.match_queries import DAY, HOUR
from trackloom.plans.motion_queries import PLACED, START, diagonal, placed

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


#: The rules at the scale of the placed events: tens of units, days.
RULES = exits.Rules(
    per=DAY, band=25.0, steep=60.0, normal_us=DAY, incoming_us=2 * DAY, cube=40.0, start_slack=2.0, boundary=55.0, boundary_slack=3.0,
    boundary_us=12 * HOUR, scramble=15.0, disrupt=40.0, long_scramble=45.0, long_disrupt=90.0, range_slack=3.0, points_per_metre=0.05, near_us=6 * HOUR,
)
START_US = START + 6 * DAY

_MIRROR = ", ".join(f"CASE WHEN {{turn}} IS NOT DISTINCT FROM side THEN {c} ELSE {c} - 2 * off / sqrt(3.0) END AS {{p}}{c}" for c in "xyz")


def _fold(name: str, costs: str) -> str:
    """A recursive query over each pilot's exits in order; ``signs`` says which tails are mirrored."""
    settle = f"""SELECT b.user_id, b.k, b.exit_us, c.cw, c.ccw, c.start, c.boundary, c.range, {{signs}} AS signs, b.side,
        coalesce(list_sum(list_transform(parts, lambda p: p.slope * CASE WHEN p.tail = 0 THEN 1 ELSE {{signs}}[p.tail] END)), 0) AS incoming FROM base b JOIN {costs} c USING (user_id, k) {{join}}"""
    turned = """SELECT * EXCLUDE (signs), CASE WHEN round(cw - ccw + crossing, 6) >= 1 THEN 1 ELSE -1 END AS turn, list_append(signs, CASE WHEN CASE WHEN round(cw - ccw + crossing, 6) >= 1 THEN 1 ELSE -1 END = side THEN 1 ELSE -1 END) AS signs
        FROM (SELECT *, 2 * least(abs(incoming) / 60, 1) * sign(incoming) AS crossing FROM ({x}))"""
    first = turned.format(x=settle.format(signs="CAST([] AS INTEGER[])", join="WHERE b.k = 1"))
    later = turned.format(x=settle.format(signs="f.signs", join=f"JOIN {name} f ON f.user_id = b.user_id AND f.k + 1 = b.k"))
    return f"{name} AS ({first} UNION ALL {later})"


_SLOPED = f"(PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND {DAY} FOLLOWING)"
SETTLED = f"""{PLACED}, o AS (SELECT user_id, us, event_id, event_type, x, y, z, event_id % 29 = 0 AS capsule, (x + y + z) / sqrt(3.0) AS off FROM q),
w AS (SELECT *, coalesce(CASE WHEN count(*) OVER {_SLOPED} >= 2 THEN regr_slope(off, us / {DAY}.0) OVER {_SLOPED} END, 0) AS slope FROM o),
i AS (SELECT *, abs(off) < 25 AS near, sum(CASE WHEN abs(off) < 25 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS g, max(us) OVER (PARTITION BY user_id) AS last FROM w),
r AS (SELECT user_id, min(us) AS t0, arg_min(us, (abs(off) / 25 + abs(slope) / 60, us)) AS exit_us, arg_min(slope, (abs(off) / 25 + abs(slope) / 60, us)) AS slope FROM i WHERE near GROUP BY user_id, g HAVING max(us) < max(last)),
x AS (SELECT user_id, exit_us, row_number() OVER (PARTITION BY user_id ORDER BY t0) AS k FROM r WHERE abs(slope) < 60),
t AS (SELECT o.*, coalesce(x.k, 0) AS k FROM o ASOF LEFT JOIN x ON o.user_id = x.user_id AND o.us > x.exit_us),
sides AS (SELECT user_id, k, coalesce(arg_min(sign(off), us) FILTER (abs(off) >= 25), 1) AS side, min(us) AS t_first, max(us) AS t_last FROM t WHERE k > 0 GROUP BY ALL),
s AS (SELECT t.*, side, t_first, t_last FROM t LEFT JOIN sides USING (user_id, k)),
br AS (SELECT user_id, k, us, capsule, turn, {_MIRROR.format(turn='turn', p='m_')} FROM s, (VALUES (-1), (1)) v(turn) WHERE k > 0),
d AS (SELECT *, sqrt((m_x - 20) * (m_x - 20) + (m_y - 20) * (m_y - 20) + (m_z - 20) * (m_z - 20)) AS gone, us < {START_US} AND sqrt(pow(greatest(-m_x, m_x - 40, 0), 2) + pow(greatest(-m_y, m_y - 40, 0), 2) + pow(greatest(-m_z, m_z - 40, 0), 2)) > 2 AS early FROM br),
n AS (SELECT *, sum(CASE WHEN gone <= 55 THEN 1 ELSE 0 END) OVER u - CASE WHEN gone <= 55 THEN 1 ELSE 0 END AS back, sum(CASE WHEN capsule THEN 1 ELSE 0 END) OVER u AS pods FROM d WINDOW u AS (PARTITION BY user_id, k, turn ORDER BY us ROWS UNBOUNDED PRECEDING)),
e1 AS (SELECT user_id, k, turn, CASE WHEN bool_or(early) THEN 10.0 ELSE 0.0 END AS start FROM d GROUP BY ALL),
e2 AS (SELECT user_id, k, turn, bool_or(returned) AS returned FROM (SELECT user_id, k, turn, back, max(us) FILTER (gone <= 55) - min(us) FILTER (gone > 58) >= {12 * HOUR} AS returned FROM n WHERE pods = 0 GROUP BY ALL) GROUP BY ALL),
ev AS (SELECT e1.*, CASE WHEN returned THEN 10.0 ELSE 0.0 END AS boundary FROM e1 LEFT JOIN e2 USING (user_id, k, turn)),
nb AS (SELECT x.user_id, x.k, t.k AS tail, off, (us - exit_us) / {DAY}.0 AS tt FROM x JOIN t ON t.user_id = x.user_id AND us BETWEEN exit_us - {2 * DAY} AND exit_us),
mt AS (SELECT user_id, k, avg(tt) AS m, sum(tt * tt) - sum(tt) * avg(tt) AS spread, count(*) AS n FROM nb GROUP BY ALL),
pa AS (SELECT user_id, k, list({{'tail': tail, 'slope': slope}} ORDER BY tail) AS parts FROM (SELECT user_id, k, tail, sum((tt - m) * off) / any_value(spread) AS slope FROM nb JOIN mt USING (user_id, k) WHERE n > 1 AND spread > 0 GROUP BY ALL) GROUP BY ALL),
base AS (SELECT x.*, side, coalesce(parts, []) AS parts FROM x JOIN sides USING (user_id, k) LEFT JOIN pa USING (user_id, k)),
c1 AS (SELECT user_id, k, sum(start + boundary) FILTER (turn = -1) AS cw, sum(start + boundary) FILTER (turn = 1) AS ccw, sum(start) FILTER (turn = -1) AS start, sum(boundary) FILTER (turn = -1) AS boundary, 0.0::DOUBLE AS range FROM ev GROUP BY ALL),
{_fold('f1', 'c1')},
pl AS (SELECT s.*, {_MIRROR.format(turn='coalesce(f1.turn, s.side)', p='now_')} FROM s LEFT JOIN (SELECT user_id, k, turn FROM f1) f1 ON f1.user_id = s.user_id AND f1.k = s.k),
pt AS (SELECT event_id AS id, us AS seen, user_id AS source, (user_id * 7 + 3) % 150 AS target, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 90 ELSE 45 END ELSE CASE WHEN event_id % 2 = 0 THEN 40 ELSE 15 END END + 3 AS lim FROM o WHERE event_type = 'purchase'),
ro AS (SELECT id, seen, lim, source AS me, target AS other FROM pt WHERE source <> target UNION ALL SELECT id, seen, lim, target, source FROM pt WHERE source <> target),
ne AS (SELECT ro.*, pl.* FROM ro JOIN pl ON pl.user_id = ro.me AND us BETWEEN seen - {6 * HOUR} AND seen + {6 * HOUR} QUALIFY row_number() OVER (PARTITION BY id, me ORDER BY abs(us - seen), us) = 1),
gp AS (SELECT a.id, a.me, a.k, turn, a.lim, {_MIRROR.format(turn='turn', p='m_').replace('side', 'a.side').replace(' off', ' a.off').replace('THEN x', 'THEN a.x').replace('THEN y', 'THEN a.y').replace('THEN z', 'THEN a.z').replace('ELSE x', 'ELSE a.x').replace('ELSE y', 'ELSE a.y').replace('ELSE z', 'ELSE a.z')}, b.now_x, b.now_y, b.now_z
    FROM ne a JOIN ne b ON a.id = b.id AND a.other = b.me, (VALUES (-1), (1)) v(turn) WHERE a.k > 0 AND a.seen BETWEEN a.t_first AND a.t_last),
rg AS (SELECT me AS user_id, k, turn, sum(CASE WHEN gap > 0 THEN least(gap * 0.05, 5) ELSE 0 END) AS range FROM (SELECT *, sqrt(pow(m_x - now_x, 2) + pow(m_y - now_y, 2) + pow(m_z - now_z, 2)) - lim AS gap FROM gp) GROUP BY ALL),
e3 AS (SELECT ev.*, coalesce(range, 0.0) AS range FROM ev LEFT JOIN rg USING (user_id, k, turn)),
c2 AS (SELECT user_id, k, sum(start + boundary + range) FILTER (turn = -1) AS cw, sum(start + boundary + range) FILTER (turn = 1) AS ccw, sum(start) FILTER (turn = -1) AS start, sum(boundary) FILTER (turn = -1) AS boundary, sum(range) FILTER (turn = -1) AS range FROM e3 GROUP BY ALL),
{_fold('f2', 'c2')}"""


def _settled(spark, sf_dir):
    p = placed(spark, sf_dir)
    fixes = p.select(F.col("user_id").alias("pilot"), "us", "x", "y", "z", (F.col("event_id") % 29 == 0).alias("capsule"))
    ship = F.when(F.col("event_id") % 3 == 0, " onyx").otherwise("Rifter")
    points = p.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), "us", F.col("user_id").alias("source"), ((F.col("user_id") * 7 + 3) % 150).alias("target"), (F.col("event_id") % 2 == 0).alias("disruption"), ship.alias("ship"))
    return exits.settle(fixes, points, START_US, diagonal(), RULES)


def scaled(c: str, digits: int) -> Column:
    """Rounded as its SQL does, on the scaled number: 1.1845 whose sum came out a last digit short is
    1184.5 again there, and a half goes up."""
    return F.round(F.col(c) * 10.0**digits) / 10.0**digits


@query(f"""WITH RECURSIVE {SETTLED}
SELECT user_id, k AS exit_id, exit_us, CASE WHEN turn = 1 THEN 'ccw' ELSE 'cw' END AS turn, round(cw + greatest(crossing, 0), 3) AS cw_points, round(ccw + greatest(-crossing, 0), 3) AS ccw_points, start, boundary, round(range, 3) AS range, round(crossing, 3) + 0.0 AS crossing FROM f2""")
def exit_settlement(spark, sf_dir):
    settled, _ = _settled(spark, sf_dir)
    points = [scaled(c, 3).alias(c) for c in ("cw_points", "ccw_points", "range")]
    return settled.select(F.col("pilot").alias("user_id"), "exit_id", "exit_us", "turn", *points, "start", "boundary", (scaled("crossing", 3) + 0.0).alias("crossing"))


@query(f"""WITH RECURSIVE {SETTLED}
SELECT s.user_id, s.us, {', '.join(f"round(CASE WHEN coalesce(f2.turn, s.side) IS NOT DISTINCT FROM s.side THEN s.{c} ELSE s.{c} - 2 * off / sqrt(3.0) END, 4) + 0.0 AS {c}" for c in 'xyz')} FROM s LEFT JOIN (SELECT user_id, k, turn FROM f2) f2 ON f2.user_id = s.user_id AND f2.k = s.k""")
def exit_placement(spark, sf_dir):
    _, put = _settled(spark, sf_dir)
    return put.select(F.col("pilot").alias("user_id"), "us", *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"])
