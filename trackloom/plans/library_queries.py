"""Queries on a shared library of files, each with the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.naming import IN_LOGS, WITHOUT_EXTENSION
from trackloom.operators import library, snapshots, sync
from trackloom.plans.match_queries import table
from trackloom.session import shared_folder

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


#: Files and folders of a library, made from the pages' numbers.
_KINDS = "CASE page_id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '.logs/' || page_id || '.txt' WHEN 2 THEN '.json' WHEN 3 THEN '.mp3' ELSE '.csv' END"
FILE = f"'S' || (page_id % 6) || '/' || CASE WHEN page_id % 2 = 0 THEN 'Day' || (page_id % 4) || '/' ELSE '' END || 'M' || (page_id % 120) || {_KINDS}"
FOLDERS = [("S0/", True), ("S1/", False), ("S2/", False), ("S2/Day0/", True), ("S3/", False), ("S4/", False), ("S5/", False), ("S9/", False)]
_FOLDERS_SQL = ", ".join(f"('{p}', '', 0, 0, {str(o).lower()})" for p, o in FOLDERS)
FILES = f"""l AS (SELECT {FILE} AS path, page_id FROM pages), files AS (SELECT path, sha256(CAST(min(page_id) % 50 AS VARCHAR)) AS sha, CAST(min(page_id) AS BIGINT) AS size, CAST(min(page_id) % 7 AS BIGINT) AS owner, min(page_id) % 23 = 0 AS public FROM l GROUP BY path
UNION ALL SELECT * FROM (VALUES {_FOLDERS_SQL}) v(path, sha, size, owner, public))"""
_ABOVE = "list_transform(range(1, len(string_split(rtrim({p}, '/'), '/'))), lambda i: array_to_string(string_split({p}, '/')[1:i], '/') || '/')"


def above_sql(p: str) -> str:
    return _ABOVE.format(p=p)


def files(spark, sf_dir) -> DataFrame:
    made = table(spark, sf_dir, "pages").selectExpr(f"{FILE} AS path", "page_id").groupBy("path").agg(F.min("page_id").alias("n"))
    rows = made.select("path", F.sha2((F.col("n") % 50).cast("string"), 256).alias("sha"), F.col("n").cast("long").alias("size"), (F.col("n") % 7).cast("long").alias("owner"), (F.col("n") % 23 == 0).alias("public"))
    folders = spark.createDataFrame([(p, "", 0, 0, o) for p, o in FOLDERS], "path string, sha string, size long, owner long, public boolean")
    return rows.unionByName(folders)


def _key_sql(p: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE WHEN regexp_matches({p}, {q(IN_LOGS)}) THEN regexp_extract({p}, {q(IN_LOGS)}, 1) WHEN regexp_matches({p}, {q(WITHOUT_EXTENSION)}) THEN regexp_extract({p}, {q(WITHOUT_EXTENSION)}, 1) ELSE {p} END"


@query(f"""WITH {FILES}, o AS (SELECT path AS above FROM files WHERE path LIKE '%/' AND public), u AS (SELECT DISTINCT path FROM (SELECT path, unnest({above_sql('path')}) AS above FROM files) SEMI JOIN o USING (above)),
k AS (SELECT f.path, f.public, u.path IS NOT NULL AS inside FROM files f LEFT JOIN u USING (path)), j AS (SELECT k.*, c.path IS NOT NULL AS has, c.public OR c.inside AS opened FROM k LEFT JOIN k c ON c.path = {_key_sql('k.path')} || '.csv'),
s AS (SELECT path FROM j WHERE CASE WHEN path LIKE '%/' THEN public OR inside WHEN has THEN opened ELSE inside END), a AS (SELECT path FROM s UNION SELECT unnest({above_sql('path')}) FROM s WHERE path NOT LIKE '%/')
SELECT path, public FROM files SEMI JOIN a USING (path)""")
def library_view(spark, sf_dir):
    return library.viewable(files(spark, sf_dir)).select("path", "public")


@query(f"""WITH {FILES}, x AS (SELECT path, size, path NOT LIKE '%/' AS is_file, {above_sql('path')} AS above FROM files),
y AS (SELECT path, size, is_file, unnest(list_concat([''], list_filter(above, lambda f: NOT contains(lower(f), '.logs/')), CASE WHEN is_file THEN [] ELSE [path] END)) AS folder FROM x)
SELECT folder AS path, count(*) FILTER (is_file AND lower(path) LIKE '%.csv') AS matches, count(*) FILTER (is_file) AS files, CAST(sum(CASE WHEN is_file THEN size ELSE 0 END) AS BIGINT) AS bytes FROM y GROUP BY folder""")
def library_rollup(spark, sf_dir):
    return library.roll_up(files(spark, sf_dir))


#: A change set: deletions and puts against the current state, some of them stale.
OPS = """ops AS (SELECT CASE WHEN size % 4 = 1 THEN 'delete' ELSE 'put' END AS op, path, CASE WHEN size % 4 = 1 THEN NULL WHEN size % 4 = 3 THEN sha ELSE sha256('new' || (size % 40)) END AS sha, CASE WHEN size % 31 = 3 THEN 'stale' ELSE sha END AS prev FROM files WHERE path NOT LIKE '%/' AND size % 3 = 0
UNION ALL SELECT 'put', 'S8/new' || k || '.csv', sha256('new' || k), NULL FROM range(0, 30) r(k))"""


def ops(spark, sf_dir) -> DataFrame:
    now = files(spark, sf_dir).filter("path NOT LIKE '%/' AND size % 3 = 0")
    sha = F.when(F.col("size") % 4 == 1, F.lit(None)).when(F.col("size") % 4 == 3, F.col("sha")).otherwise(F.sha2(F.concat(F.lit("new"), F.col("size") % 40), 256))
    changes = now.select(F.when(F.col("size") % 4 == 1, "delete").otherwise("put").alias("op"), "path", sha.alias("sha"), F.when(F.col("size") % 31 == 3, "stale").otherwise(F.col("sha")).alias("prev"))
    k = F.col("id").cast("string")
    fresh = spark.range(30).select(F.lit("put").alias("op"), F.concat(F.lit("S8/new"), k, F.lit(".csv")).alias("path"), F.sha2(F.concat(F.lit("new"), k), 256).alias("sha"), F.lit(None).cast("string").alias("prev"))
    return changes.unionByName(fresh)


_STATUS = """CASE WHEN cur IS DISTINCT FROM prev THEN 'conflict' WHEN owner IS NOT NULL AND NOT path LIKE '%/' AND NOT coalesce(op = 'put' AND (sha = cur OR lower(path) LIKE '%.json'), false) AND coalesce(csv_owner, owner) <> 3 THEN 'rejected'
WHEN op = 'put' AND NOT path LIKE '%/' AND NOT coalesce(sha = cur, false) AND blob IS NULL THEN 'missing' ELSE 'ok' END"""
JUDGED = f"""b AS (SELECT sha256('new' || k) AS blob FROM range(0, 35) r(k)),
j AS (SELECT o.*, f.sha AS cur, f.owner, c.owner AS csv_owner, b.blob FROM ops o LEFT JOIN files f USING (path) LEFT JOIN files c ON c.path = {_key_sql('o.path')} || '.csv' LEFT JOIN b ON b.blob = o.sha),
judged AS (SELECT op, path, sha, {_STATUS} AS status FROM j)"""


def _blobs(spark) -> DataFrame:
    return spark.range(35).select(F.sha2(F.concat(F.lit("new"), F.col("id").cast("string")), 256).alias("sha"))


@query(f"WITH {FILES}, {OPS}, {JUDGED} SELECT op, path, status FROM judged")
def library_check(spark, sf_dir):
    return library.checked(files(spark, sf_dir), ops(spark, sf_dir), _blobs(spark), 3).select("op", "path", "status")


@query(f"""WITH {FILES}, {OPS}, {JUDGED}, g AS (SELECT * FROM judged WHERE status = 'ok')
SELECT path, sha, size, owner, public, 2 AS version FROM files ANTI JOIN g USING (path)
UNION ALL SELECT g.path, g.sha, 1, coalesce(f.owner, 3), coalesce(f.public, false), 2 FROM g LEFT JOIN files f USING (path) WHERE op = 'put'""")
def library_commit(spark, sf_dir):
    """The whole change set is refused, as part of it is stale; what is right of it then goes in."""
    shared = snapshots.Library(spark, shared_folder(spark, "library"), most_ops=None)  # one a file, and files grow
    shared.claim(1, files(spark, sf_dir))
    changes = ops(spark, sf_dir).withColumn("size", F.when(F.col("op") == "put", F.lit(1).cast("long")))
    whole = shared.commit(changes, _blobs(spark), 3)
    right = library.checked(shared.read(), changes, _blobs(spark), 3).filter("status = 'ok'").drop("status")
    part = shared.commit(right, _blobs(spark), 3)
    if (whole.status, part.status) != ("conflict", "ok"):
        raise ValueError(f"commits gave {whole.status} and {part.status}")
    return shared.read().withColumn("version", F.lit(part.version).cast("int"))


#: What a member's copy was at the last sync, and is now: changed, removed and moved files.
_BASE = "SELECT path, CASE WHEN size % 7 = 2 THEN concat('o', sha) ELSE sha END AS sha, size FROM files WHERE size % 11 <> 5"
_LOCAL = "SELECT CASE WHEN size % 17 = 3 THEN concat('S7/', path) ELSE path END AS path, CASE WHEN size % 9 = 4 THEN concat('n', sha) ELSE sha END AS sha, size FROM base WHERE size % 13 <> 1"
_SEND = "SELECT sha FROM files UNION SELECT sha FROM local WHERE size % 5 <> 3 OR sha NOT LIKE 'n%'"


@query(f"""WITH RECURSIVE {FILES}, base AS ({_BASE}), local AS ({_LOCAL}), send AS ({_SEND}),
w AS (SELECT path, b.sha AS base, l.sha AS local, f.sha AS remote FROM base b FULL JOIN local l USING (path) FULL JOIN files f USING (path)),
ops AS (SELECT CASE WHEN local IS NULL THEN 'delete' ELSE 'put' END AS op, path, local AS sha, remote AS prev, CASE WHEN path LIKE '%/' THEN path ELSE {_key_sql('path')} END AS k FROM w WHERE local IS DISTINCT FROM base AND local IS DISTINCT FROM remote),
gone AS (SELECT prev AS sha, arg_max(k, path) AS k0 FROM ops WHERE op = 'delete' AND coalesce(prev, '') <> '' GROUP BY prev),
e AS (SELECT DISTINCT k, k0 FROM ops JOIN gone USING (sha) WHERE op = 'put' AND k <> k0), e2 AS (SELECT k, k0 FROM e UNION SELECT k0, k FROM e),
reach AS (SELECT k, k AS other FROM e2 UNION SELECT r.k, e2.k0 FROM reach r JOIN e2 ON e2.k = r.other),
u AS (SELECT k, min(other) AS unit FROM reach GROUP BY k),
j AS (SELECT o.*, coalesce(u.unit, o.k) AS unit, f.sha AS cur, f.owner, c.owner AS csv_owner, s.sha AS blob FROM ops o LEFT JOIN u USING (k) LEFT JOIN files f ON f.path = o.path LEFT JOIN files c ON c.path = {_key_sql('o.path')} || '.csv' LEFT JOIN send s ON s.sha = o.sha),
s AS (SELECT path, unit, {_STATUS} AS status FROM j), undone AS (SELECT path FROM s WHERE unit IN (SELECT unit FROM s WHERE status <> 'ok')),
z AS (SELECT w.*, undone.path IS NOT NULL AS undone, undone.path IS NOT NULL OR (remote IS DISTINCT FROM base AND local IS NOT DISTINCT FROM base) AS theirs FROM w LEFT JOIN undone USING (path)),
r AS (SELECT path, CASE WHEN theirs THEN remote ELSE local END AS local, CASE WHEN theirs THEN remote WHEN local IS DISTINCT FROM base THEN local ELSE base END AS base, undone FROM z)
SELECT path, local, base, undone, status FROM r LEFT JOIN (SELECT path, status FROM s WHERE status <> 'ok') USING (path) WHERE local IS NOT NULL OR base IS NOT NULL""")
def library_sync(spark, sf_dir):
    remote = files(spark, sf_dir)
    base = spark.sql(_BASE.replace("FROM files", "FROM {files}"), files=remote)
    local = spark.sql(_LOCAL.replace("FROM base", "FROM {base}"), base=base)
    send = spark.sql(_SEND.replace("FROM files", "FROM {files}").replace("FROM local", "FROM {local}"), files=remote, local=local)
    got = sync.synced(base.select("path", "sha"), local, remote, send, 3)
    marked = got.state.join(got.undone.withColumn("undone", F.lit(True)), "path", "left").join(got.refused, "path", "left")
    return marked.select("path", "local", "base", F.coalesce("undone", F.lit(False)).alias("undone"), "status")


#: Moves: all files of S0/ and S2/Day0/ go to new folders, with the folders themselves.
MOVES = "m AS (SELECT path, sha, size, CASE WHEN starts_with(path, 'S0/') THEN 'T0/' || substr(path, 4) ELSE 'T2/Day0/' || substr(path, 9) END AS target FROM files WHERE starts_with(path, 'S0/') OR starts_with(path, 'S2/Day0/'))"


@query(f"""WITH {FILES}, {MOVES}, d AS (SELECT path FROM m), src AS (SELECT sha, path AS origin, owner, public FROM files SEMI JOIN d USING (path) WHERE path NOT LIKE '%/'),
f1 AS (SELECT sha, arg_min(owner, origin) AS owner, arg_min(public, origin) AS public FROM src GROUP BY sha),
w AS (SELECT sha, origin, unnest({above_sql('origin')}) AS folder FROM src), r AS (SELECT w.sha, substr(origin, length(folder) + 1) AS rest FROM w JOIN files g ON g.path = w.folder AND g.public SEMI JOIN d ON d.path = w.folder),
p AS (SELECT DISTINCT substr(m.target, 1, length(m.target) - length(rest)) AS folder FROM m JOIN r ON r.sha = m.sha AND ends_with(m.target, '/' || rest) WHERE m.target NOT LIKE '%/')
SELECT path, sha, size, owner, public FROM files ANTI JOIN d USING (path)
UNION ALL SELECT target, m.sha, m.size, CASE WHEN target LIKE '%/' THEN 99 ELSE coalesce(f1.owner, 99) END, CASE WHEN target LIKE '%/' THEN p.folder IS NOT NULL ELSE coalesce(f1.public, false) END FROM m LEFT JOIN f1 ON f1.sha = m.sha LEFT JOIN p ON p.folder = m.target""")
def library_moves(spark, sf_dir):
    now = files(spark, sf_dir)
    p = F.col("path")
    target = F.when(F.startswith(p, F.lit("S0/")), F.concat(F.lit("T0/"), F.expr("substr(path, 4)"))).otherwise(F.concat(F.lit("T2/Day0/"), F.expr("substr(path, 9)")))
    moved = now.filter(F.startswith(p, F.lit("S0/")) | F.startswith(p, F.lit("S2/Day0/"))).withColumn("target", target)
    puts = moved.select(F.lit("put").alias("op"), F.col("target").alias("path"), "sha", "size", F.lit(None).cast("string").alias("prev"))
    gone = moved.select(F.lit("delete").alias("op"), "path", F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("size"), F.col("sha").alias("prev"))
    return library.applied(now, puts.unionByName(gone), 99)


@query("""WITH w AS (SELECT page_id, 'f' || (page_id % 20) || '.csv' AS path FROM pages), t AS (SELECT DISTINCT 'f' || (page_id % 9) || CASE WHEN page_id % 2 = 0 THEN ' (' || (page_id % 5 + 2) || ')' ELSE '' END || '.csv' AS path FROM pages),
u AS (SELECT regexp_extract(path, '^(.*?)(?: \\((\\d+)\\))?(\\.[^./]*)?$', 1) || regexp_extract(path, '^(.*?)(?: \\((\\d+)\\))?(\\.[^./]*)?$', 3) AS path, max(coalesce(TRY_CAST(regexp_extract(path, '^(.*?)(?: \\((\\d+)\\))?(\\.[^./]*)?$', 2) AS BIGINT), 1)) AS top FROM t GROUP BY 1),
n AS (SELECT w.*, row_number() OVER (PARTITION BY path ORDER BY page_id) + coalesce(top, 0) AS n FROM w LEFT JOIN u USING (path))
SELECT page_id, path, CASE WHEN n = 1 THEN path ELSE replace(path, '.csv', '') || ' (' || n || ').csv' END AS name FROM n""")
def unique_names(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    wanted = pages.selectExpr("page_id", "'f' || (page_id % 20) || '.csv' AS path")
    taken = pages.selectExpr("'f' || (page_id % 9) || CASE WHEN page_id % 2 = 0 THEN ' (' || (page_id % 5 + 2) || ')' ELSE '' END || '.csv' AS path").distinct()
    return library.free_names(wanted, taken, "path")
