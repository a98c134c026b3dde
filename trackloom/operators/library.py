"""A shared library of files: what is visible, what a change set may do, and its result.

Folders are paths that end in a slash. Everything is a join on a path, one of its prefixes, or a
digest; no file meets all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.naming import match_key
from trackloom.operators import windows


def folders_above(path: Column) -> Column:
    """Every folder that holds the path, each ending in a slash; not the path itself."""
    parts = F.split(path, "/")
    n = F.size(parts) - F.when(F.endswith(path, F.lit("/")), 2).otherwise(1)
    above = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.when(n >= 1, above).otherwise(F.array().cast("array<string>"))


def is_folder(path: Column) -> Column:
    return F.endswith(path, F.lit("/"))


def viewable(files: DataFrame) -> DataFrame:
    """The rows of ``files`` (path, public) that a viewer sees: files of a match whose CSV is public
    or under a public folder, other files under a public folder, public folders and those under
    them, and every folder that leads to a file shown."""
    rows = files.select("path", "public").distinct()
    open_folders = rows.filter(is_folder(F.col("path")) & F.col("public")).select(F.col("path").alias("above"))
    inside = rows.select("path", F.explode(folders_above(F.col("path"))).alias("above")).join(open_folders, "above", "left_semi").select("path").distinct()
    known = rows.join(inside.withColumn("__in", F.lit(True)), "path", "left").withColumn("__in", F.coalesce("__in", F.lit(False)))
    csv = known.select(F.col("path").alias("__csv"), (F.col("public") | F.col("__in")).alias("__open"))
    judged = known.withColumn("__csv", F.concat(match_key(F.col("path")), F.lit(".csv"))).join(csv, "__csv", "left")
    own = F.when(is_folder(F.col("path")), F.col("public") | F.col("__in")).otherwise(F.coalesce("__open", "__in"))
    shown = judged.filter(own).select("path")
    leading = shown.filter(~is_folder(F.col("path"))).select(F.explode(folders_above(F.col("path"))).alias("path"))
    return files.join(shown.union(leading).distinct(), "path", "left_semi")


def roll_up(files: DataFrame) -> DataFrame:
    """path, matches, files, bytes of every folder, empty ones too, and of '' for all. Folders of
    logs (.logs/) and those in them are left out; their files count for the folders above."""
    above = folders_above(F.col("path"))
    logs = F.filter(F.transform(above, lambda f, i: F.when(F.endswith(F.lower(f), F.lit(".logs/")), i)), lambda i: i.isNotNull())
    counted = F.when(F.size(logs) > 0, F.slice(above, F.lit(1), F.element_at(logs, 1))).otherwise(above)
    own = F.when(is_folder(F.col("path")) & ~F.contains(F.lower("path"), F.lit(".logs/")), F.array(F.col("path"))).otherwise(F.array().cast("array<string>"))
    rows = files.withColumn("__file", (~is_folder(F.col("path"))).cast("long"))
    rows = rows.withColumn("folder", F.explode(F.concat(F.array(F.lit("")), counted, own)))
    is_match = F.col("__file") * F.endswith(F.lower("path"), F.lit(".csv")).cast("long")
    return rows.groupBy(F.col("folder").alias("path")).agg(F.sum(is_match).alias("matches"), F.sum("__file").alias("files"), F.sum(F.col("__file") * F.col("size")).alias("bytes"))


def checked(files: DataFrame, ops: DataFrame, blobs: DataFrame, user: int, admin: bool = False) -> DataFrame:
    """``ops`` (op, path, sha, prev) with status, of the first rule that each breaks: conflict (the
    path's digest is no longer prev), rejected (another's file; a put of the same digest or of a
    .json file is free, the owner of a match's CSV owns its files), missing (no such blob), ok."""
    now = files.select("path", F.col("sha").alias("__sha"), F.col("owner").alias("__own"))
    csv = files.select(F.col("path").alias("__csv"), F.col("owner").alias("__csv_own"))
    rows = ops.join(now, "path", "left").withColumn("__csv", F.concat(match_key(F.col("path")), F.lit(".csv"))).join(csv, "__csv", "left")
    rows = rows.join(blobs.select(F.col("sha").alias("__blob")).distinct(), F.col("sha") == F.col("__blob"), "left")
    exists, folder = F.col("__own").isNotNull(), is_folder(F.col("path"))
    free = (F.col("op") == "put") & ((F.col("sha") == F.col("__sha")) | F.endswith(F.lower("path"), F.lit(".json")))
    foreign = exists & ~folder & ~F.lit(admin) & ~F.coalesce(free, F.lit(False)) & (F.coalesce("__csv_own", "__own") != user)
    lacking = (F.col("op") == "put") & ~folder & ~F.coalesce(F.col("sha") == F.col("__sha"), F.lit(False)) & F.col("__blob").isNull()
    status = F.when(~F.col("__sha").eqNullSafe(F.col("prev")), "conflict").when(foreign, "rejected").when(lacking, "missing").otherwise("ok")
    return rows.withColumn("status", status).select(*ops.columns, "status")


def applied(files: DataFrame, ops: DataFrame, user: int) -> DataFrame:
    """The library (path, sha, size, owner, public) after ``ops`` that are all ok. A put of content
    that is deleted elsewhere is a move: it keeps owner and flag (of several sources the first by
    path). A new folder that holds a moved file where a deleted public folder held it is public."""
    puts, gone = ops.filter("op = 'put'"), ops.filter("op = 'delete'").select("path")
    now = files.select("path", F.col("owner").alias("__own"), F.col("public").alias("__public"))
    sources = files.join(gone, "path", "left_semi").filter(~is_folder(F.col("path"))).select("sha", F.col("path").alias("__from"), F.col("owner").alias("__m_own"), F.col("public").alias("__m_public"))
    fresh = puts.join(now, "path", "left").withColumn("__new", F.col("__own").isNull())
    first = sources.groupBy("sha").agg(F.min(F.struct("__from", "__m_own", "__m_public")).alias("__m"))
    rows = fresh.join(first, "sha", "left")
    # a file moved from within a deleted public folder: the same rest of its path names the new folder
    lost = files.join(gone, "path", "left_semi").filter(is_folder(F.col("path")) & F.col("public")).select(F.col("path").alias("__d"))
    within = sources.select("sha", "__from", F.explode(folders_above(F.col("__from"))).alias("__d")).join(lost, "__d", "left_semi").select("sha", F.expr("substr(__from, length(__d) + 1)").alias("__rest"))
    moved = fresh.filter("__new").filter(~is_folder(F.col("path"))).join(within, "sha").filter(F.endswith("path", F.concat(F.lit("/"), F.col("__rest"))))
    opened = moved.select(F.expr("substr(path, 1, length(path) - length(__rest))").alias("path")).distinct().withColumn("__opened", F.lit(True))
    rows = rows.join(opened, "path", "left")
    folder = is_folder(F.col("path"))
    owner = F.when(F.col("__new"), F.when(folder, F.lit(user)).otherwise(F.coalesce("__m.__m_own", F.lit(user)))).otherwise(F.col("__own"))
    public = F.when(F.col("__new"), F.when(folder, F.coalesce("__opened", F.lit(False))).otherwise(F.coalesce("__m.__m_public", F.lit(False)))).otherwise(F.col("__public"))
    put = rows.select("path", "sha", "size", owner.cast(files.schema["owner"].dataType).alias("owner"), public.alias("public"))
    kept = files.select("path", "sha", "size", "owner", "public").join(ops.select("path"), "path", "left_anti")
    return kept.unionByName(put)


def free_names(wanted: DataFrame, taken: DataFrame, path: str) -> DataFrame:
    """``wanted`` with name: the path itself for the first that asks for a free one, else the stem
    with ' (n)', n from 2 on, past the numbers that ``taken`` has."""
    pattern = r"^(.*?)(?: \((\d+)\))?(\.[^./]*)?$"
    stem = F.concat(F.regexp_extract(path, r"^(.*?)(\.[^./]*)?$", 1))
    ext = F.regexp_extract(path, r"(\.[^./]*)?$", 1)
    used = taken.select(F.col(path).alias("__t"))
    base = F.concat(F.regexp_extract("__t", pattern, 1), F.regexp_extract("__t", pattern, 3))
    top = used.groupBy(base.alias(path)).agg(F.max(F.coalesce(F.regexp_extract("__t", pattern, 2).try_cast("long"), F.lit(1))).alias("__top"))
    placed = windows.accumulated(wanted, [path], [F.col(c) for c in wanted.columns if c != path], F.lit(1).cast("long"), "__n")
    rows = placed.join(top, path, "left").withColumn("__n", F.col("__n") + F.coalesce("__top", F.lit(0)))
    return rows.withColumn("name", F.when(F.col("__n") == 1, F.col(path)).otherwise(F.concat(stem, F.lit(" ("), F.col("__n").cast("string"), F.lit(")"), ext))).select(*wanted.columns, "name")
