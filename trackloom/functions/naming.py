"""Paths, names, versions and kinds of modules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of log entries that are electronic warfare by themselves.
EWAR_BY_KIND = {"NEUT": "neut", "NOS": "nos", "JAM": "ecm"}
#: Parts of lower-case module names and the kind they stand for, the first that is found wins.
EWAR_KEYWORDS = (
    ("tracking disrupt", "td"), ("guidance disrupt", "gd"), ("dampen", "damp"), ("painter", "tp"),
    ("sensor boost", "rsb"), ("tracking comp", "rtc"), ("webif", "web"), ("stasis", "web"),
)
#: Seconds of a module's cycle by kind (5 for others), and by size where it has sizes.
CYCLES = {"neut": 12.0, "nos": 6.0, "ecm": 20.0}
SIZED_CYCLES = {"neut": {"small": 6.0, "medium": 12.0, "heavy": 24.0}, "nos": {"small": 3.0, "medium": 6.0, "heavy": 12.0}}

IN_LOGS = r"(?i)^(.*?)\.logs/"
WITHOUT_EXTENSION = r"^(.*[^/])\.[^./]*$"


def match_key(path: Column) -> Column:
    """The match that a file belongs to: what stands before the first ``.logs`` folder's suffix,
    else the path without its last extension."""
    return F.when(F.rlike(path, F.lit(IN_LOGS)), F.regexp_extract(path, IN_LOGS, 1)).when(F.rlike(path, F.lit(WITHOUT_EXTENSION)), F.regexp_extract(path, WITHOUT_EXTENSION, 1)).otherwise(path)


def valid_path(path: Column, most: int = 512) -> Column:
    """Relative, without control characters, backslash or colon, and no segment empty, dotted or
    with white space at its ends; a folder ends in a slash."""
    segments = F.split(F.regexp_replace(path, "/$", ""), "/")
    fine = F.forall(segments, lambda s: (F.length(s) > 0) & ~s.isin(".", "..") & (F.trim(s) == s))
    return F.length(path).between(1, most) & ~F.rlike(path, F.lit(r"[\x00-\x1f\x7f\\:]")) & fine


def season(path: Column) -> Column:
    """The first folder of a path, '' at the top."""
    return F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("")


def short_name(name: Column) -> Column:
    """The first word and the initials of the others."""
    words = F.split(F.trim(name), " +")
    initials = F.transform(F.slice(words, F.lit(2), F.size(words)), lambda w: F.concat(F.left(w, F.lit(1)), F.lit(".")))
    return F.concat_ws(" ", F.get(words, F.lit(0)), initials)


def version_key(version: Column) -> Column:
    """The numbers of a version such as v1.2.10; arrays of them compare as versions do."""
    return F.transform(F.regexp_extract_all(version, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))


def ewar_type(kind: Column, module: Column) -> Column:
    """The kind of electronic warfare of a log entry, '' for none."""
    low = F.lower(module)
    out = F.lit("")
    for part, name in reversed(EWAR_KEYWORDS):
        out = F.when(F.contains(low, F.lit(part)), name).otherwise(out)
    out = F.when(kind.isin("DAMAGE", "MISS", "REMOTE_REP"), "").otherwise(out)
    for k, name in EWAR_BY_KIND.items():
        out = F.when(kind == k, name).otherwise(out)
    return F.when(kind == "SCRAM", F.when(F.contains(low, F.lit("disrupt")), "disrupt").otherwise("scram")).otherwise(out)


def default_cycle(ewar: Column, module: Column) -> Column:
    """Seconds of a module's usual cycle."""
    low, out = F.lower(module), F.lit(5.0)
    for kind, seconds in CYCLES.items():
        sized = F.lit(seconds)
        for size, s in reversed(SIZED_CYCLES.get(kind, {}).items()):
            sized = F.when(F.contains(low, F.lit(size)), s).otherwise(sized)
        out = F.when(ewar == kind, sized).otherwise(out)
    return out


def link_kind(ewar: Column) -> Column:
    """The kind of line that an ewar link is drawn as."""
    return F.when(ewar.isin("scram", "disrupt", "web"), "tackle").when(ewar.isin("neut", "nos"), "neut").otherwise("ewar")


def output_stem(path: Column) -> Column:
    """A recording's name without folder, extension and time of day."""
    name = F.regexp_replace(path, "^.*/", "")
    return F.regexp_replace(name, r"( [0-9]{2}-[0-9]{2}-[0-9]{2}|\.[^.]*$)", "")


def display_name(path: Column) -> Column:
    """A file's name without folder and extension."""
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "")


def beside(path: Column, ending: str) -> Column:
    """The path of a match's other file: its last extension replaced by ``ending``."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(ending))


#: Patterns that data for show must not hold: mail addresses, network addresses, home folders.
LEAKS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}", r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", r"/(home|Users)/[^/ ]+")


def leaks(text: Column) -> Column:
    """Whether a text holds one of LEAKS."""
    out = F.lit(False)
    for p in LEAKS:
        out = out | F.rlike(text, F.lit(p))
    return out


def anonymised(names: DataFrame, name: str, seed: str, prefix: str) -> DataFrame:
    """Each distinct name and its alias: a prefix and the name's place in the order of seeded digests,
    so that the same names and seed give the same aliases. Places are counted by the digests' first
    two digits and within these, not in one task."""
    rows = names.select(name).distinct().withColumn("__h", F.sha2(F.concat(F.lit(seed), F.col(name)), 256)).withColumn("__b", F.substring("__h", 1, 2))
    before = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")  # 256 rows
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", name)) + F.col("__before")
    return rows.join(F.broadcast(before), "__b").select(name, F.concat(F.lit(prefix), F.lpad(place.cast("string"), 6, "0")).alias("alias"))


def hull_icon(group: Column, name: Column, by_id: dict[int, str], words: list[tuple[str, str]], other: str) -> Column:
    """A hull group's icon: by its number, else by the first word that its name holds, else ``other``."""
    out = F.lit(other)
    for word, icon in reversed(words):
        out = F.when(F.contains(F.lower(name), F.lit(word)), icon).otherwise(out)
    known = F.create_map(*[F.lit(x) for pair in by_id.items() for x in pair]) if by_id else None
    return F.coalesce(F.try_element_at(known, group), out) if known is not None else out
