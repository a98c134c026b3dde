"""Greedy suppression and change-list walks, with the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import suppression
from trackloom.plans.match_queries import table

QUERIES: dict[str, object] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


#: Marks in frames: a part's place and score in the frame of a supplier.
_MARKS = "SELECT l_orderkey % 50 AS frame, min(l_partkey) % 40 AS x, min(l_suppkey) % 7 * 2 AS y, max(l_quantity) AS score, l_orderkey AS id FROM lineitem GROUP BY l_orderkey"


@query(f"""WITH RECURSIVE m AS ({_MARKS}), o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, id) AS i FROM m),
g AS (SELECT frame, 1 AS i, [id] AS kept, [{{'x': x, 'y': y}}] AS places FROM o WHERE i = 1
UNION ALL SELECT o.frame, o.i, CASE WHEN len(list_filter(places, lambda p: abs(p.x - o.x) < 3 AND abs(p.y - o.y) < 3)) = 0 THEN list_append(kept, id) ELSE kept END,
    CASE WHEN len(list_filter(places, lambda p: abs(p.x - o.x) < 3 AND abs(p.y - o.y) < 3)) = 0 THEN list_append(places, {{'x': x, 'y': y}}) ELSE places END FROM g JOIN o ON o.frame = g.frame AND o.i = g.i + 1)
SELECT frame, unnest(arg_max(kept, i)) AS id FROM g GROUP BY frame""")
def kept_marks(spark, sf_dir):
    marks = spark.sql(_MARKS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
    return suppression.suppressed(marks, ["frame"], ["x", "y"], "score", "id", 3.0).select("frame", "id")


#: Change lists: one a build, some of which lead back by two.
_LISTS = "SELECT p_partkey AS build, p_partkey - 1 - p_partkey % 3 AS before, CASE p_partkey % 2 WHEN 0 THEN 'types' ELSE 'groups' END AS kind, p_size AS \"key\", CASE p_partkey % 5 WHEN 0 THEN 'added' ELSE 'changed' END AS how FROM part"


@query(f"""WITH RECURSIVE c AS ({_LISTS}), top AS (SELECT max(build) AS b FROM c), w AS (SELECT b, 1 AS step FROM top UNION ALL SELECT before, step + 1 FROM w JOIN (SELECT DISTINCT build, before FROM c) l ON l.build = w.b WHERE before > (SELECT b FROM top) - 90)
SELECT DISTINCT kind, "key", how FROM c SEMI JOIN w ON c.build = w.b""")
def changed_keys(spark, sf_dir):
    lists = spark.sql(_LISTS.replace('"key"', "`key`").replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    latest = lists.agg(F.max("build")).first()[0]
    found = suppression.changed_since(lists, latest - 90, latest)
    if found is None:
        raise ValueError("the change lists do not lead back")
    return found
