"""Readers of a match library's side files, catalogues and folders, and writers of readings, tracks
and trimmed logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.sources import files

SIDECAR = "teams map<string,int>, team_names map<string,string>, log_pilots map<string,string>, ruleset string, internal boolean"
SEASON = "version int, build string, teams map<string,struct<name:string,temp:boolean>>, pilots map<string,string>, manual map<string,boolean>, matches map<string,string>, colors map<string,map<string,string>>"
SCENE = "panels array<struct<name:string,rect:struct<x:int,y:int,w:int,h:int>,scale:double>>, chat struct<x:int,y:int,w:int,h:int>, targets array<struct<x:int,y:int,w:int,h:int>>"
#: The category of ships, and names of log files with their start.
SHIPS = 6
LOG_NAME = r"([0-9]{8})_([0-9]{6})"


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """file, pilot, team, team_name, log, ruleset, internal: one row a pilot of each match's side
    file (teams re-keyed as numbers). Files that are no JSON are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", SIDECAR).alias("s")).filter("s.teams IS NOT NULL")
    rows = raw.select("file", F.explode("s.teams").alias("pilot", "team"), "s.team_names", "s.log_pilots", "s.ruleset", "s.internal")
    logs = F.map_keys(F.map_filter("log_pilots", lambda k, v: v == F.col("pilot")))
    return rows.select("file", "pilot", "team", F.try_element_at("team_names", F.col("team").cast("string")).alias("team_name"), F.array_min(logs).alias("log"), "ruleset", F.coalesce("internal", F.lit(False)).alias("internal"))


def write_sidecars(rows: DataFrame, path: str) -> None:
    """One line of JSON a match: file, teams and names, keys in order."""
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_set(c)))
    out = rows.groupBy("file", "ruleset", "internal").agg(entry(F.struct("pilot", "team")).alias("teams"), entry(F.struct(F.col("team").cast("string"), "team_name")).alias("team_names"))
    out.select("file", F.to_json(F.struct("teams", "team_names", "ruleset", "internal")).alias("json")).write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def read_seasons(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Teams (file, version, team, name, temp), pilots (file, pilot, team, manual) and matches (file,
    match, sha) of season files. Files that are no JSON are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", SEASON).alias("s")).filter("s.version IS NOT NULL")
    teams = raw.select("file", F.col("s.version").alias("version"), F.explode("s.teams").alias("team", "t")).select("file", "version", F.col("team").cast("int").alias("team"), "t.name", F.coalesce("t.temp", F.lit(False)).alias("temp"))
    pilots = raw.select("file", "s.manual", F.explode("s.pilots").alias("pilot", "team"))
    pilots = pilots.select("file", "pilot", F.col("team").cast("int").alias("team"), F.coalesce(F.try_element_at("manual", F.col("pilot")), F.lit(False)).alias("manual"))
    return teams, pilots, raw.select("file", F.explode("s.matches").alias("match", "sha"))


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """file, panel, x, y, w, h, scale (1 if not given) of scene files."""
    raw = spark.read.option("multiLine", True).schema(SCENE).json(path).select(F.col("_metadata.file_path").alias("file"), F.explode("panels").alias("p"))
    return raw.select("file", F.col("p.name").alias("panel"), "p.rect.*", F.coalesce("p.scale", F.lit(1.0)).alias("scale"))


def read_catalogue(spark: SparkSession, groups: str, types: str) -> DataFrame:
    """name (lower case), type_id, group_id, radius_m of published ships: lines of JSON, types
    filtered to the groups of ships by a semi-join."""
    ships = spark.read.schema("_key long, categoryID int").json(groups).filter(F.col("categoryID") == SHIPS).select(F.col("_key").alias("groupID"))
    rows = spark.read.schema("_key long, groupID long, published boolean, radius double, name struct<en:string>").json(types)
    return rows.filter("published").join(ships, "groupID", "left_semi").select(F.lower("name.en").alias("name"), F.col("_key").alias("type_id"), F.col("groupID").alias("group_id"), F.col("radius").alias("radius_m"))


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """build, before and key of change lists: lines of JSON with a build, the one before it, and the
    keys that changed."""
    return spark.read.schema("build long, before long, keys array<string>").json(path).select("build", "before", F.explode("keys").alias("key"))


def read_gallery(spark: SparkSession, path: str) -> DataFrame:
    """category, model, file of a gallery's index."""
    raw = spark.read.option("multiLine", True).schema("name string, models array<struct<name:string,file:string>>").json(path)
    return raw.select(F.col("name").alias("category"), F.explode("models").alias("m")).select("category", F.col("m.name").alias("model"), "m.file")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """Names, one a line; blank lines and comments (#) are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("name"))
    return lines.filter((F.col("name") != "") & ~F.startswith("name", F.lit("#")))


def scan(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """path, size, modified, sha of all files in a folder. Digests of ``known`` rows (path, size,
    modified, sha) that have not changed are taken over, so only new content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    facts = listed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if known is None:
        return listed.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha"))
    same = facts.join(known.select("path", "size", "modified", "sha"), ["path", "size", "modified"], "left")
    new = listed.join(same.filter("sha IS NULL").select("path"), "path", "left_semi").select("path", F.sha2("content", 256).alias("__sha"))
    return same.join(new, "path", "left").select("path", "size", "modified", F.coalesce("sha", "__sha").alias("sha"))


def nearest_in_time(listed: DataFrame, at: Column) -> DataFrame:
    """The file modified nearest to ``at``, of equals the first by path."""
    off = F.abs(F.unix_micros("modified") - F.unix_micros(at))
    return listed.select(F.struct(off, "path").alias("k")).agg(F.min("k").alias("k")).select("k.path").filter("path IS NOT NULL")


def newest(listed: DataFrame, endings: list[str]) -> DataFrame:
    """The file of one of the endings that was modified last, of equals the last by path."""
    of = listed.filter(F.lower(F.substring_index("path", ".", -1)).isin(*endings))
    return of.agg(F.max_by("path", F.struct("modified", "path")).alias("path")).filter("path IS NOT NULL")


def find_logs(listed: DataFrame, start: Column, end: Column) -> DataFrame:
    """Log files that may hold a window: named with a start not after its end, and modified not
    earlier than a minute before its start."""
    begun = F.try_to_timestamp(F.concat(F.regexp_extract("path", LOG_NAME, 1), F.regexp_extract("path", LOG_NAME, 2)), F.lit("yyyyMMddHHmmss"))
    return listed.filter((begun <= end) & (F.col("modified") >= start - F.expr("INTERVAL 1 MINUTE")))


def read_scrams(spark: SparkSession, path: str) -> DataFrame:
    """Of combat logs the attempts to hold a ship, each once: listener, at, line."""
    return files.read_combat_logs(spark, path).filter("kind = 'SCRAM'").select("listener", "at", "line").distinct()


def trimmed_logs(spark: SparkSession, path: str, first: Column, last: Column) -> DataFrame:
    """file, line_no, value of each log's header and its messages from ``first`` to ``last``. Lines
    without a time belong to the message before them; those before the first message are the header."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    told = lines.withColumn("__at", files.log_time(F.nullif(F.regexp_extract("value", files.TIMED, 1), F.lit(""))))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    said = told.withColumn("__at", F.last("__at", ignorenulls=True).over(w))
    return said.filter(F.col("__at").isNull() | F.col("__at").between(first, last)).select("file", "line_no", "value")


def write_readings(rows: DataFrame, path: str) -> None:
    """t, pilot, d_a, d_b, d_c, speed_mps as CSV, in order of time and pilot; nulls blank."""
    out = rows.select(F.format_string("%.3f", "t").alias("t"), "pilot", *[F.when(F.col(c).isNotNull(), F.round(c).cast("long")).alias(c) for c in ("d_a", "d_b", "d_c", "speed_mps")])
    out.orderBy(F.col("t").cast("double"), F.lower("pilot")).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_tracks(rows: DataFrame, path: str) -> None:
    """pilot, t, distance_m, speed_mps as CSV, in order of pilot and time; nulls blank."""
    out = rows.select("pilot", F.format_string("%.3f", "t").alias("t"), *[F.when(F.col(c).isNotNull(), F.round(c).cast("long")).alias(c) for c in ("distance_m", "speed_mps")])
    out.orderBy("pilot", F.col("t").cast("double")).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)

