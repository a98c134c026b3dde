"""Readers and writers of positions, readings, logs and rulesets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import combat

NEEDED = ("t", "pilot", "ship_type", "x_m", "y_m", "z_m")
_NUMBERS = ("t", "x_m", "y_m", "z_m", "speed_mps", "dir_x", "dir_y", "dir_z", "residual_m", "shield", "armor", "hull")
_HP = ("shield", "armor", "hull")
#: Columns that a file may have, with their types, and the fields of a line that are read.
OPTIONAL = {**{c: "double" for c in _NUMBERS if c not in NEEDED}, "eve_time": "timestamp", "plane_exit": "string", "plane_exit_id": "int", "plane": "string"}
WIDEST = 40


def _cells(line: Column) -> Column:
    """A line's fields, trimmed; quoted ones without their quotes."""
    wide = F.from_csv(line, F.lit(", ".join(f"c{i} string" for i in range(WIDEST))))
    return F.slice(F.array(*[F.trim(wide[f"c{i}"]) for i in range(WIDEST)]), F.lit(1), F.size(F.split(F.regexp_replace(line, '"[^"]*"', ""), ",")))


def positions_of(lines: DataFrame) -> DataFrame:
    """Positions of files' lines (file, value) by each file's own header, whatever the order of its
    columns: file, the six needed columns, and the optional ones, null where a file has none. Rows that
    are short or without x_m are left out, blanks are null, and shield, armor and hull are known all or
    not at all. A file without a header that has the needed columns ends the job with an error. Headers
    meet rows by an equi-join on the file; a line with a quoted line break counts as two."""
    rows = lines.filter(F.trim("value") != "").select("file", _cells(F.regexp_replace("value", "^\ufeff", "")).alias("cells"))
    is_head = F.size(F.array_except(F.array(*map(F.lit, NEEDED)), "cells")) == 0
    heads = rows.filter(is_head).groupBy("file").agg(F.min("cells").alias("head"))
    missing = F.raise_error(F.concat("file", F.lit(f": missing columns, needed are {', '.join(NEEDED)}")))
    known = rows.filter(~is_head).join(heads, "file", "left").withColumn("head", F.when(F.col("head").isNull(), missing.cast("array<string>")).otherwise(F.col("head")))
    known = known.filter(F.size("cells") >= F.size("head"))
    at = lambda c: F.get("cells", (F.array_position("head", c) - 1).cast("int"))
    text = {c: F.nullif(at(c), F.lit("")) for c in (*NEEDED, *OPTIONAL)}
    typed = {c: v.try_cast("double") if c in _NUMBERS else v.try_cast(OPTIONAL.get(c, "string")) for c, v in text.items()}
    found = known.select("file", text["x_m"].isNotNull().alias("__x"), *[v.alias(c) for c, v in typed.items()]).filter("__x").drop("__x")
    whole = F.col("shield").isNotNull() & F.col("armor").isNotNull() & F.col("hull").isNotNull()
    return found.withColumns({c: F.when(whole, F.col(c)) for c in _HP})


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Positions of all files under ``path`` (see ``positions_of``)."""
    return positions_of(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value"))


def write_positions(rows: DataFrame, path: str) -> None:
    """Positions as CSV in order of time and pilot: metres and residuals whole, times and hit points
    with three decimals, directions with four, speeds as they are; nulls blank."""
    digits = {"t": 3, "x_m": 0, "y_m": 0, "z_m": 0, "residual_m": 0, "dir_x": 4, "dir_y": 4, "dir_z": 4, "shield": 3, "armor": 3, "hull": 3}
    shown = {c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{n}f", F.col(c))) for c, n in digits.items() if c in rows.columns}
    if "speed_mps" in rows.columns:
        shown["speed_mps"] = F.regexp_replace(F.col("speed_mps").cast("decimal(20,6)").cast("string"), r"\.?0+$", "")
    ordered = rows.orderBy(*[c for c in ("t", "pilot") if c in rows.columns])
    ordered.withColumns(shown).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Readings t, pilot, d_a, d_b, d_c, speed_mps; blanks are null."""
    schema = "t double, pilot string, d_a double, d_b double, d_c double, speed_mps double"
    return spark.read.option("header", True).schema(schema).csv(path)


#: Times, headers and names of log files.
LOG_NAME = r"^([0-9]{8}_[0-9]{6})"
TIMED = r"^\[ ([0-9]{4}\.[0-9]{2}\.[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}) \] "
LISTENER = r"^\s*Listener: *(.+?)\s*$"
STARTED = r"^\s*Session Started: *([0-9]{4}\.[0-9]{2}\.[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})"


def log_time(s):
    """A time such as 2024.01.31 20:15:00; null if there is none."""
    return F.try_to_timestamp(s, F.lit("yyyy.MM.dd HH:mm:ss"))


def log_lines(spark: SparkSession, path: str, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """file, value of log files' lines. With a window, only files that may hold it are opened: those
    named with a start not after ``last`` and written not earlier than a minute before ``first``."""
    lines = spark.read.text(path, recursiveFileLookup=True)
    name = F.col("_metadata.file_name")
    if last is not None:
        begun = F.try_to_timestamp(F.regexp_extract(name, LOG_NAME, 1), F.lit("yyyyMMdd_HHmmss"))
        lines = lines.filter(F.coalesce(begun <= last, F.lit(True)))
    if first is not None:
        lines = lines.filter(F.col("_metadata.file_modification_time") >= first - F.expr("INTERVAL 1 MINUTE"))
    return lines.select(F.col("_metadata.file_path").alias("file"), "value")


def read_combat_logs(spark: SparkSession, path: str, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Combat lines of log files, from ``first`` to ``last`` if given: file, listener, started, at, line
    (without markup), and the entry's kind, amount, source, target, source_ship, target_ship, weapon
    and quality. Files without a listener are left out. Headers meet lines by an equi-join on the file."""
    lines = log_lines(spark, path, first, last)
    heads = lines.filter(F.rlike("value", F.lit(f"{LISTENER}|{STARTED}")))
    found = lambda p: F.max(F.nullif(F.regexp_extract("value", p, 1), F.lit("")))
    heads = heads.groupBy("file").agg(found(LISTENER).alias("listener"), log_time(found(STARTED)).alias("started")).filter("listener IS NOT NULL")
    said = lines.filter(F.rlike("value", F.lit(TIMED + r"\(combat\) "))).select("file", log_time(F.regexp_extract("value", TIMED, 1)).alias("at"), F.regexp_replace("value", TIMED + r"\(combat\) ", "").alias("html"))
    if first is not None:
        said = said.filter(F.col("at") >= first)
    if last is not None:
        said = said.filter(F.col("at") <= last)
    rows = combat.typed(said.join(heads, "file"), "html")
    return rows.select("file", "listener", "started", "at", F.col("text").alias("line"), "entry.*")


def read_chat_spans(spark: SparkSession, path: str) -> DataFrame:
    """The first and last time of each chat log, in UTF-16 with a mark or UTF-8: file, first_at, last_at."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    marked = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    text = F.when(marked, F.decode("content", "UTF-16")).otherwise(F.decode("content", "UTF-8"))
    times = F.regexp_extract_all(text, F.lit(r"([0-9]{4}\.[0-9]{2}\.[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})"), F.lit(1))
    return files.withColumn("times", F.transform(times, log_time)).select("file", F.array_min("times").alias("first_at"), F.array_max("times").alias("last_at"))


RULESET = "id string, name string, `order` int, source string, point_cap int, inflation map<string,int>, default_inflation int, ships map<string,struct<points:int,hull:string>>"


def read_rulesets(spark: SparkSession, path: str) -> DataFrame:
    """One row a ruleset and ship: id, name, point_cap, ship (lower case), points, hull, step (what
    a further copy of the hull costs more). Rulesets without id or ships are left out."""
    raw = spark.read.option("multiLine", True).schema(RULESET).json(path).filter("id IS NOT NULL AND size(ships) > 0")
    ships = raw.select("id", "name", "point_cap", "inflation", "default_inflation", F.explode("ships").alias("ship", "s"))
    step = F.coalesce(F.try_element_at("inflation", F.col("s.hull")), F.col("default_inflation"), F.lit(0))
    return ships.select("id", "name", "point_cap", F.lower("ship").alias("ship"), "s.points", "s.hull", step.alias("step"))
