"""Cells, markup and log lines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: metres of an astronomical unit, as distances are displayed with.
AU_M = 149_597_870_700.0
#: A number with thousands in groups of three (or none) and a decimal part.
NUMBER = r"([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(\.[0-9]+)?"


def number(s: Column, pattern: str) -> Column:
    whole = F.regexp_replace(F.regexp_extract(s, pattern, 1), ",", "")
    return F.concat(whole, F.regexp_extract(s, pattern, 2)).cast("double")


def parse_distance(s: Column) -> Column:
    """Struct (status, metres): none for '-', value, or unreadable; characters after the unit are noise."""
    t = F.trim(s)
    pattern = rf"^{NUMBER} ?(m|km|k|AU)(?:[^A-Za-z].*)?$"
    ok = F.rlike(t, F.lit(pattern))
    unit = F.regexp_extract(t, pattern, 3)
    metres = number(t, pattern) * F.when(unit == "m", 1.0).when(unit == "AU", AU_M).otherwise(1000.0)
    return F.struct(F.when(t == "-", "none").when(ok, "value").otherwise("unreadable").alias("status"), F.when(ok, metres).alias("metres"))


def parse_scalar(s: Column) -> Column:
    """A bare number or one in m/s; null if unreadable."""
    t = F.trim(s)
    pattern = rf"^{NUMBER}(?: ?m/s)?$"
    return F.when(F.rlike(t, F.lit(pattern)), number(t, pattern))


def strip_markup(s: Column) -> Column:
    """Text without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


#: Kinds of log lines and their patterns, the first that matches wins; groups are amount and name.
LINES = (
    ("damage_in", r"^([0-9]+) from ([^-]+)"),
    ("damage_out", r"^([0-9]+) to ([^-]+)"),
    ("miss_out", r"^Your .* misses ()([^-]+)"),
    ("miss_in", r"^()([^-]+) misses you"),
    ("scram", r"^Warp (?:scramble|disruption) attempt from ()(.+)"),
    ("neut", r"^([0-9]+) GJ energy neutralized (.+)"),
    ("nos", r"^[+-]([0-9]+) GJ energy drained (.+)"),
    ("remote_rep", r"^([0-9]+) remote .* repaired (.+)"),
    ("jam", r"^You(?:'re| are) jammed by ()(.+)"),
)


def parse_line(s: Column) -> Column:
    """Struct (kind, amount, name) of a log line without markup; other if no pattern matches. The
    kind is found first, and only its own pattern is taken apart."""
    kind = F.lit("other")
    for k, p in reversed(LINES):
        kind = F.when(F.rlike(s, F.lit(p)), k).otherwise(kind)

    def taken(k: Column) -> Column:
        own = F.coalesce(*[F.when(k == n, F.struct(F.regexp_extract(s, p, 1).alias("amount"), F.trim(F.regexp_extract(s, p, 2)).alias("name"))) for n, p in LINES])
        return F.transform(F.array(own), lambda x: F.struct(k.alias("kind"), F.nullif(x["amount"], F.lit("")).try_cast("double").alias("amount"), x["name"].alias("name")))

    # one element each, so that the kind and the parts are worked out once
    return F.element_at(F.flatten(F.transform(F.array(kind), taken)), 1)


def clock(seconds: Column) -> Column:
    """Minutes and seconds as mm:ss."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def natural_key(s: Column) -> Column:
    """A key that sorts numbers inside names by value and ignores case."""
    parts = F.regexp_extract_all(F.lower(s), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit("^[0-9]")), F.lpad(p, 20, "0")).otherwise(p)), "")
