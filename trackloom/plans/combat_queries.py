"""Queries on combat messages, rates and activity, each with the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import combat
from trackloom.operators import intervals, rates
from trackloom.plans.match_queries import DAY, EVENTS, HOUR, events, table

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}

#: Messages of all shapes, with an amount {n}, a pilot {p} and a ship {s}.
MESSAGES = (
    "<color=0xff00ffff><b>{n}</b> <font size=10>to</font> <b>{p}[TICK]({s})</b> - Test Railgun - Glances Off",
    "<color=0xffcc0000><b>{n}</b> <font size=10>from</font> <b>{p}</b> - Test Drone - Penetrates",
    "Your group of Test Railgun misses {p} completely - Test Railgun",
    "Test Drone belonging to {p} misses you completely - Test Drone",
    "<b>Warp scramble attempt</b> from <b>{s}</b> [TICK] [{p}] - to <b>Barge</b> [Kelto Ruvan] -",
    "<b>Warp disruption attempt</b> from <b>you</b> to <b>{s}</b> [{p}] -",
    "<color=0xff7fffff><b>{n} GJ</b> energy neutralized <b>{s}</b> [{p}] - - Heavy Neutralizer",
    "<color=0xffe57f7f><b>{n} GJ</b> energy neutralized <b>{s}</b> [{p}] - - Small Neutralizer",
    "<color=0xff7fffff><b>+{n} GJ</b> energy drained from <b>{s}</b> - Medium Nosferatu",
    "<b>{n}</b> remote armor repaired by <b>{s}</b> [{p}] - - Repair Drone",
    "You're jammed by <b>{s}</b> - Radar ECM",
    "<b>{s}</b> [{p}] -   jammed - Ladar ECM",
    "(notify) nothing to see",
)
_FIELDS = ("kind", "source", "target", "source_ship", "target_ship", "weapon", "quality")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _entries_sql() -> str:
    message = "CASE event_id % 13 " + " ".join(f"WHEN {i} THEN {_q(m)}" for i, m in enumerate(MESSAGES)) + " END"
    group = lambda k, i: f"trim(regexp_extract(text, {_q(combat.SHAPES[k])}, {i}))" if i else "''"
    by = lambda pick: "CASE shape " + " ".join(f"WHEN '{k}' THEN {pick(k, v)}" for k, v in combat.PARTS.items()) + " ELSE '' END"

    def outgoing(k, v):
        if v[5] == "colour":
            return f"lower(regexp_extract(html, {_q(combat.COLOUR)}, 1)) = '{combat.NEUT_OUT}'"
        return str(v[5]).lower() if isinstance(v[5], bool) else f"{group(k, v[5][0])} = '{v[5][1]}'"

    out = "CASE shape " + " ".join(f"WHEN '{k}' THEN {outgoing(k, v)}" for k, v in combat.PARTS.items()) + " ELSE false END"
    ship = lambda s: f"CASE WHEN trim({s}) IN ('you', 'you!') THEN '' ELSE trim(regexp_extract(trim({s}), {_q(combat.SHIP_NAME)}, 1)) END"
    pilots = lambda s: f"regexp_extract_all(regexp_extract(trim({s}), {_q(combat.SHIP_NAME)}, 2), '\\[([^\\]]*)\\]', 1)"
    name = lambda s: f"CASE WHEN trim({s}) IN ('you', 'you!') THEN '' WHEN len({pilots(s)}) > 0 THEN trim({pilots(s)}[-1]) ELSE {ship(s)} END"
    return f"""WITH {EVENTS}, m AS (SELECT event_id, replace(replace(replace({message}, '{{n}}', CAST(CAST(floor(abs(value)) AS BIGINT) AS VARCHAR)), '{{p}}', 'Pilot ' || user_id), '{{s}}', CASE user_id % 3 WHEN 0 THEN 'Hulk' WHEN 1 THEN 'Orca' ELSE 'Venture' END) AS html FROM e),
t AS (SELECT *, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM m),
s AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(text, {_q(p)}) THEN '{k}'" for k, p in combat.SHAPES.items())} ELSE 'other' END AS shape FROM t),
o AS (SELECT *, {by(lambda k, v: group(k, v[2]))} AS other, {out} AS o, CASE shape WHEN 'scram' THEN {group('scram', 3)} ELSE 'you' END AS second, {by(lambda k, v: group(k, v[1]))} AS n FROM s),
p AS (SELECT *, CASE WHEN shape = 'miss_in' THEN regexp_replace(other, '^.*? belonging to ', '') WHEN shape IN ('damage', 'miss_out') THEN other ELSE {name('other')} END AS name,
CASE WHEN shape = 'damage' THEN {group('damage', 5)} WHEN shape IN ('miss_in', 'miss_out') THEN '' ELSE {ship('other')} END AS ship FROM o)
SELECT event_id, text, CASE shape {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in combat.PARTS.items())} ELSE 'OTHER' END AS kind, abs(TRY_CAST(n AS DOUBLE)) AS amount, CASE WHEN o THEN '' ELSE name END AS source, CASE WHEN o THEN name WHEN shape = 'scram' THEN {name('second')} ELSE '' END AS target,
CASE WHEN o THEN '' ELSE ship END AS source_ship, CASE WHEN o THEN ship WHEN shape = 'scram' THEN {ship('second')} ELSE '' END AS target_ship, {by(lambda k, v: group(k, v[3]))} AS weapon, {by(lambda k, v: group(k, v[4]))} AS quality FROM p"""


@query(_entries_sql())
def combat_entries(spark, sf_dir):
    e = events(spark, sf_dir)
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % len(MESSAGES)).cast("int") + 1)
    ship = F.when(F.col("user_id") % 3 == 0, "Hulk").when(F.col("user_id") % 3 == 1, "Orca").otherwise("Venture")
    for mark, value in (("{n}", F.floor(F.abs("value")).cast("long").cast("string")), ("{p}", F.concat(F.lit("Pilot "), F.col("user_id"))), ("{s}", ship)):
        message = F.replace(message, F.lit(mark), value)
    return combat.typed(e.select("event_id", message.alias("html")), "html").select("event_id", "text", "entry.amount", *[f"entry.{c}" for c in _FIELDS])


INSTANTS = f"i AS (SELECT 1704067200000000 + {12 * HOUR} + k * {DAY} AS instant FROM range(1, 29) r(k))"


def instants(spark):
    return spark.range(1, 29).select((F.lit(1_704_067_200_000_000 + 12 * HOUR) + F.col("id") * DAY).alias("instant"))


@query(f"""WITH {EVENTS}, {INSTANTS}, w AS (SELECT instant, user_id, event_type, sum(value) / 6.0 AS rate FROM e JOIN i ON us <= instant AND instant < us + {6 * HOUR} GROUP BY ALL),
k AS (SELECT * FROM w WHERE rate >= 0.5) SELECT instant, user_id, event_type, round(rate, 4) AS rate, CAST(row_number() OVER (PARTITION BY instant, user_id ORDER BY round(rate, 4) DESC, event_type) AS BIGINT) AS place, round(sum(rate) OVER (PARTITION BY instant, user_id), 4) AS total FROM k""")
def damage_breakdown(spark, sf_dir):
    return rates.by_source(events(spark, sf_dir), instants(spark), "user_id", "event_type", "value", 6 * HOUR, HOUR, 0.5)


@query(f"""WITH {EVENTS}, {INSTANTS}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS n FROM e)
SELECT instant, user_id, event_type, count(*) AS active, max(n) AS so_far FROM c JOIN i ON us <= instant AND instant < us + {6 * HOUR} GROUP BY ALL""")
def ewar_active(spark, sf_dir):
    return rates.active_with_count(events(spark, sf_dir), instants(spark), ["user_id", "event_type"], 6 * HOUR, "event_id")


@query("""SELECT event_type AS kind, count(*) AS n, count(*) FILTER (WHERE user_id % 2 = 0 OR value > 50) AS n_some FROM events GROUP BY event_type""")
def kind_counts(spark, sf_dir):
    some = (F.col("user_id") % 2 == 0) | (F.col("value") > 50)
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(some).alias("n_some"))


@query("""WITH e AS (SELECT event_id, epoch_us(ts) AS us FROM events), x AS (SELECT event_id, us, strftime(make_timestamp(us), '%Y.%m.%d %H:%M:%S') AS a, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || '.250Z' AS b FROM e)
SELECT event_id, round(us // 1000000, 3) + 0.0 AS logged, round(us // 1000000 + 0.25, 3) AS shown, strftime(make_timestamp(us // 1000000 * 1000000 + 1250000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS later FROM x""")
def log_times(spark, sf_dir):
    e = events(spark, sf_dir)
    second = F.timestamp_micros("us")
    a, b = F.date_format(second, "yyyy.MM.dd HH:mm:ss"), F.concat(F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250Z"))
    later = combat.time_at(F.floor(F.col("us") / 1_000_000).cast("long") * 1_000_000, F.lit(1.2499999))
    return e.select("event_id", F.round(combat.log_seconds(a), 3).alias("logged"), F.round(combat.log_seconds(b), 3).alias("shown"), later.alias("later"))


@query("""SELECT event_id, CASE WHEN value * 30 >= 1000 THEN printf('%.1f', round(value * 30 / 1000, 1)) || ' km/s' ELSE CAST(CAST(round(value * 30) AS BIGINT) AS VARCHAR) || ' m/s' END AS speed,
CASE WHEN value * 300 < 10000 THEN CAST(CAST(round(value * 300) AS BIGINT) AS VARCHAR) || ' m' ELSE CAST(CAST(round(value * 300 / 1000) AS BIGINT) AS VARCHAR) || ' km' END AS distance,
CASE WHEN value - 60 < 0 THEN '-' ELSE '' END || CAST(CAST(ceil(abs(value - 60)) AS BIGINT) // 60 AS VARCHAR) || ':' || lpad(CAST(CAST(ceil(abs(value - 60)) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock,
CAST(floor(value + 0.001) + 1 AS BIGINT) AS next_tick, CAST(ceil(value - 0.001) - 1 AS BIGINT) AS last_tick, coalesce(regexp_matches(sha256(CAST(event_id AS VARCHAR)), '^[0-9a-f]{64}$'), false) AS valid FROM events""")
def shown_values(spark, sf_dir):
    v = F.col("value")
    valid = combat.is_digest(F.sha2(F.col("event_id").cast("string"), 256))
    return table(spark, sf_dir, "events").select(
        "event_id", combat.speed_text(v * 30).alias("speed"), combat.distance_text(v * 300).alias("distance"), combat.countdown(v - 60).alias("clock"),
        combat.snapped(v, True).alias("next_tick"), combat.snapped(v, False).alias("last_tick"), valid.alias("valid"),
    )
