"""Queries on rosters and seasons; those that fold in order have no SQL and are tested against
plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.functions import naming
from trackloom.operators import geometry, labels, observers, rosters, seasons
from trackloom.plans.match_queries import DAY, EVENTS, events, table

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM e), v AS (SELECT user_id, event_type, count(*) AS n FROM r WHERE i <= 3 GROUP BY ALL), k AS (SELECT user_id, arg_max(event_type, (n, event_type)) AS locked FROM v GROUP BY user_id),
l AS (SELECT user_id, min(us) AS lost_at FROM r JOIN k USING (user_id) WHERE i > 3 AND event_type = 'error' AND locked <> 'error' GROUP BY user_id)
SELECT k.user_id, locked, lost_at, count(*) FILTER (r.i > 3 AND r.event_type <> locked AND (lost_at IS NULL OR r.us < lost_at)) AS conflicts FROM k LEFT JOIN l USING (user_id) JOIN r USING (user_id) GROUP BY ALL""")
def type_locks(spark, sf_dir):
    return rosters.locked_types(events(spark, sf_dir), "user_id", "us", "event_type", "event_id", "error")


def _read_names(spark, sf_dir):
    e = events(spark, sf_dir)
    name = F.concat(F.lit("Pilot "), F.translate((F.col("user_id") % 40).cast("string"), "0123456789", "aeioubcdfg"), F.lit(" of the fleet"))
    at = (F.col("event_id") % 9 + 3).cast("int")
    spoiled = F.when(F.col("event_id") % 5 == 0, F.overlay(name, F.lit("x"), at)).otherwise(name)
    return e.select(F.floor(F.col("us") / (10 * DAY)).alias("match"), (F.col("event_id") % 3).alias("observer"), spoiled.alias("name"), "us")


@query()
def name_clusters(spark, sf_dir):
    return rosters.cluster_names(_read_names(spark, sf_dir), ["match", "observer"], "name", "us")


@query()
def roster_merge(spark, sf_dir):
    tracks = _read_names(spark, sf_dir).groupBy("match", "observer", "name").agg(F.count(F.lit(1)).alias("n"))
    may = rosters.founds(F.col("name"), F.col("n"), F.lit(60), F.lit(False))
    return rosters.merge_rosters(tracks.withColumn("may", may), "match", "observer", "name", "n", "may")


def _sides(spark, sf_dir):
    """Pilots by the side they were on in each match; a pilot on both is on the first."""
    o, match = table(spark, sf_dir, "orders"), F.floor(F.col("o_orderkey") / 60)
    rows = o.select((match % 4).cast("string").alias("season"), match.cast("string").alias("match"), match.cast("long").alias("us"), (F.col("o_orderkey") % 2).cast("int").alias("side"), ((F.col("o_custkey") + match) % 50).cast("string").alias("pilot"))
    once = rows.groupBy("season", "match", "us", "pilot").agg(F.min("side").alias("side"))
    return once.withColumn("folder", (F.col("us") % 3).cast("string")).withColumn("internal", F.col("us") % 11 == 0)


@query()
def season_teams(spark, sf_dir):
    return seasons.teams(seasons.matches_of(_sides(spark, sf_dir)))


@query()
def season_rebuild(spark, sf_dir):
    """A season after some of its matches were marked internal: names and pilots set by hand stay."""
    sides = _sides(spark, sf_dir)
    before = seasons.roster(seasons.teams(seasons.matches_of(sides)))
    after = seasons.roster(seasons.teams(seasons.matches_of(sides.withColumn("internal", F.col("us") % 3 == 0))))
    old = before.withColumn("manual", F.col("pilot").cast("int") % 17 == 5)
    names = before.select("season", "team").distinct().withColumn("name", F.when(F.col("team") % 2 == 1, F.concat(F.lit("Team "), F.chr(F.col("team") + 64))))
    pilots, teams = seasons.rebuilt(old, names, after)
    return pilots.join(teams, ["season", "team"])


CODED = "translate(substr(md5(CAST({k} AS VARCHAR)), 1, CAST(3 + {k} % 12 AS INTEGER)), '0123456789abcdef', 'aeiouklmnrstvdbp')"
KINDS = ("Rifter", "Punisher", "Moa Navy Issue")
LABELS = f"""WITH {EVENTS}, r AS (SELECT us // {10 * DAY} AS match, event_id % 5 AS frame, event_id AS slot, user_id % 40 AS k FROM e),
n AS (SELECT *, {CODED.format(k="k")} AS name, ['Rifter', 'Punisher', 'Moa Navy Issue'][k % 3 + 1] AS kind, 20000.0 + k * 997 * 7 % 200000 AS m FROM r),
l AS (SELECT match, frame, slot, CASE slot % 7 WHEN 0 THEN '. ' || name WHEN 1 THEN substr(name, 1, 2) WHEN 2 THEN substr(name, 1, 1) || 'x' || substr(name, 3) WHEN 3 THEN name || ' zz q' WHEN 4 THEN substr(name, 1, length(name) - 1) WHEN 5 THEN substr(name, 1, 1) || 'xzx' || substr(name, 5) ELSE upper(name) END AS label,
CASE WHEN slot % 4 = 0 THEN 'Rif' ELSE kind END AS kind, CASE WHEN slot % 11 > 0 THEN m + slot % 3 * 2500 END AS range_m FROM n),
c AS (SELECT DISTINCT match, frame, name AS pilot, kind, m FROM n),
p AS (SELECT DISTINCT label, pilot, lower(label) AS a, lower(pilot) AS b, least(length(label), length(pilot)) AS w FROM l JOIN c USING (match, frame)),
d AS (SELECT label, pilot, w, least(levenshtein(a, b), levenshtein(substr(a, 1, w), substr(b, 1, w)), (SELECT min(levenshtein(b, substr(a, CAST(s.s AS INTEGER) + 1, CAST(z.z AS INTEGER)))) FROM range(3) s(s), range(30) z(z))) AS edits FROM p),
f AS (SELECT l.*, c.pilot, d.edits, d.w, starts_with(lower(l.kind), lower(c.kind)) OR starts_with(lower(c.kind), lower(l.kind)) AS same, CASE WHEN range_m IS NOT NULL THEN abs(range_m - m) <= greatest(0.1 * m, 3000) OR abs(range_m - m - 15000) <= greatest(0.1 * (m + 15000), 3000) END AS near FROM l JOIN c USING (match, frame) JOIN d USING (label, pilot)),
s AS (SELECT slot, pilot, edits + CASE WHEN same THEN 0 ELSE 2 END + CASE WHEN near THEN 0 WHEN near IS NULL THEN 0 ELSE 1 END AS cost FROM f WHERE length(label) >= 3 AND edits <= greatest(1, w // 5)),
b AS (SELECT slot, min(cost) AS cost FROM s GROUP BY slot), o AS (SELECT slot, CASE WHEN count(*) = 1 THEN min(pilot) END AS pilot FROM s JOIN b USING (slot, cost) GROUP BY slot),
z AS (SELECT slot, CASE WHEN count(*) = 1 THEN min(pilot) END AS pilot FROM f WHERE same AND near AND slot NOT IN (SELECT slot FROM b) AND CASE WHEN length(label) = 2 THEN starts_with(lower(pilot), lower(label)) ELSE edits <= w // 2 END GROUP BY slot)
SELECT match, frame, slot, label, coalesce(o.pilot, z.pilot) AS pilot FROM l LEFT JOIN o USING (slot) LEFT JOIN z USING (slot)"""


@query(LABELS)
def label_matches(spark, sf_dir):
    """Labels with specks, cuts and misread letters against the pilots of their frame, whom two
    observers 15 km apart see."""
    k = F.col("k")
    name = F.translate(F.substring(F.md5(k.cast("string")), F.lit(1), (3 + k % 12).cast("int")), "0123456789abcdef", "aeiouklmnrstvdbp")
    rows = events(spark, sf_dir).select(F.floor(F.col("us") / (10 * DAY)).alias("match"), (F.col("event_id") % 5).alias("frame"), F.col("event_id").alias("slot"), (F.col("user_id") % 40).alias("k"))
    rows = rows.withColumn("name", name).withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), (k % 3 + 1).cast("int"))).withColumn("m", 20_000.0 + k * 997 * 7 % 200_000)
    s, n = F.col("slot"), F.col("name")
    part = lambda i, c=None: F.substring(n, F.lit(i), F.length(n) if c is None else c)
    spoiled = [F.concat(F.lit(". "), n), part(1, F.lit(2)), F.concat(part(1, F.lit(1)), F.lit("x"), part(3)), F.concat(n, F.lit(" zz q")), part(1, F.length(n) - 1), F.concat(part(1, F.lit(1)), F.lit("xzx"), part(5)), F.upper(n)]
    label = F.coalesce(*[F.when(s % 7 == i, c) for i, c in enumerate(spoiled)])
    asked = rows.select("match", "frame", "slot", label.alias("label"), F.when(s % 4 == 0, "Rif").otherwise(F.col("kind")).alias("kind"), F.when(s % 11 > 0, F.col("m") + s % 3 * 2500).alias("range_m"))
    seen = rows.select("match", "frame", n.alias("pilot"), "kind", F.explode(F.array(F.col("m"), F.col("m") + 15_000)).alias("range_m"))
    return labels.match_labels(asked, seen, ["match", "frame"], "slot")


@query("""WITH n AS (SELECT DISTINCT c_name AS name FROM customer) SELECT name, 'Pilot ' || lpad(CAST(row_number() OVER (ORDER BY sha256('seed' || name), name) AS VARCHAR), 6, '0') AS alias FROM n""")
def anonymised_names(spark, sf_dir):
    return naming.anonymised(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), "name", "seed", "Pilot ")


@query("""SELECT page_id, regexp_replace(regexp_replace('dir/2024-01-02 10-11-' || lpad(CAST(page_id % 60 AS VARCHAR), 2, '0') || ' Final.mkv', '^.*/', ''), '( [0-9]{2}-[0-9]{2}-[0-9]{2}|\\.[^.]*$)', '', 'g') AS stem, 'dir/m' || page_id || '.json' AS meta, 'dir/m' || page_id || '.logs' AS logs, 'm' || page_id AS shown, page_id % 5 = 0 OR page_id % 7 = 0 AS leaks FROM pages""")
def file_names(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id")
    video = F.concat(F.lit("dir/2024-01-02 10-11-"), F.lpad((F.col("page_id") % 60).cast("string"), 2, "0"), F.lit(" Final.mkv"))
    path = F.concat(F.lit("dir/m"), F.col("page_id").cast("string"), F.lit(".csv"))
    text = F.concat(F.when(F.col("page_id") % 5 == 0, "mail a@b.example").otherwise("-"), F.when(F.col("page_id") % 7 == 0, " 10.0.0.7").otherwise(""))
    return pages.select("page_id", naming.output_stem(video).alias("stem"), naming.beside(path, ".json").alias("meta"), naming.beside(path, ".logs").alias("logs"), naming.display_name(path).alias("shown"), naming.leaks(text).alias("leaks"))


@query()
def observer_fit(spark, sf_dir):
    """Observers of each ten days' readings, made for observers of one shape 200 km from the centre."""
    side, e = 250_000.0, events(spark, sf_dir)
    t = F.col("us") % (10 * DAY) / 1e6
    start = [F.col("user_id") * k % 170_000 + 40_000.0 for k in (7919, 6271, 4243)]
    way = [F.sin(t / 60 + i) * 20_000 for i in range(3)]
    here = tuple(a + b for a, b in zip(start, way))
    at = observers.places(F.lit(4), F.lit(200_000.0), side)
    ranges = [F.round(geometry.norm(geometry.sub(here, o)) / 100) * 100 for o in at]
    rows = e.select(F.floor(F.col("us") / (10 * DAY)).cast("string").alias("match"), F.col("user_id").cast("string").alias("pilot"), t.alias("t"), *[r.alias(n) for r, n in zip(ranges, ("d_a", "d_b", "d_c"))], (F.col("value") * 10).alias("speed"))
    return observers.infer(rows, side, 100_000.0, 500_000.0)
