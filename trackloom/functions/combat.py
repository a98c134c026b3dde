"""Combat messages as typed entries, and times and figures as they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackloom.functions.parsing import strip_markup

#: The shapes of combat messages without markup, the first that matches wins.
SHAPES = {
    "damage": r"^(\d+) (to|from) (.+?)(?:\[([^\]]*)\])?(?:\(([^)]*)\))? - (.+?)(?: - ([^-]+))?$",
    "miss_out": r"^Your (?:group of )?(.+?) misses (.+) completely - (.+)$",
    "miss_in": r"^(.+?) misses you completely - (.+)$",
    "scram": r"^(Warp (?:scramble|disruption)) attempt from (.+?) to (.+)$",
    "neut": r"^(\d+) GJ energy neutralized (.+) - (.+)$",
    "nos": r"^([-+]\d+) GJ energy drained (to|from) (.+) - (.+)$",
    "remote_rep": r"^(\d+) remote (?:armor|shield|hull|structure) (?:repaired|boosted) (to|by) (.+) - (.+)$",
    "jam_in": r"^You're jammed by (.+?) - (.+)$",
    "jam_out": r"^(.+?)\s+jammed - (.+)$",
}
#: A ship with brackets, of which the last is the pilot; the leading colour of a
#: message, and that of a neutralizer which the log's owner uses.
SHIP_NAME = r"^(.*?)\s*((?:\[[^\]]*\]\s*)*)-?\s*$"
COLOUR, NEUT_OUT = r"^<color=0x([0-9a-fA-F]{8})>", "ff7fffff"

#: For each shape: kind, then the groups of amount, other side, weapon and quality (0: none), and the
#: word that makes the owner the source (a group and its text; none: by the shape itself).
PARTS = {
    "damage": ("DAMAGE", 1, 3, 6, 7, (2, "to")),
    "miss_out": ("MISS", 0, 2, 3, 0, True),
    "miss_in": ("MISS", 0, 1, 2, 0, False),
    "scram": ("SCRAM", 0, 2, 1, 0, False),
    "neut": ("NEUT", 1, 2, 3, 0, "colour"),
    "nos": ("NOS", 1, 3, 4, 0, (2, "from")),
    "remote_rep": ("REMOTE_REP", 1, 3, 4, 0, (2, "to")),
    "jam_in": ("JAM", 0, 1, 2, 0, False),
    "jam_out": ("JAM", 0, 1, 2, 0, True),
}


def ship_and_name(s: Column) -> Column:
    """Struct (ship, name) of one side: empty for the log's owner, the ship twice without a pilot."""
    t = F.trim(s)
    ship = F.trim(F.regexp_extract(t, SHIP_NAME, 1))
    pilots = F.regexp_extract_all(F.regexp_extract(t, SHIP_NAME, 2), F.lit(r"\[([^\]]*)\]"), F.lit(1))
    owner = t.isin("you", "you!")
    name = F.when(F.size(pilots) > 0, F.trim(F.try_element_at(pilots, F.lit(-1)))).otherwise(ship)
    return F.struct(F.when(owner, "").otherwise(ship).alias("ship"), F.when(owner, "").otherwise(name).alias("name"))


def shape_of(text: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(SHAPES.items()):
        out = F.when(F.rlike(text, F.lit(pattern)), name).otherwise(out)
    return out


def entry_parts(html: Column, text: Column, shape: Column) -> Column:
    """Struct of a message of known text and shape: kind, amount, source, target, source_ship,
    target_ship, weapon, quality. Each shape's groups are taken in its own branch only."""
    group = lambda k, i: F.trim(F.regexp_extract(text, SHAPES[k], i)) if i else F.lit("")
    plain = lambda k, i: F.when(shape == k, group(k, i))
    by = lambda pick: F.coalesce(*[F.when(shape == k, pick(k, v)) for k, v in PARTS.items()], F.lit(""))

    def outgoing(k: str, v: tuple) -> Column:
        if v[5] == "colour":
            return F.lower(F.regexp_extract(html, COLOUR, 1)) == NEUT_OUT
        return F.lit(v[5]) if isinstance(v[5], bool) else group(k, v[5][0]) == v[5][1]

    out = F.coalesce(*[F.when(shape == k, outgoing(k, v)) for k, v in PARTS.items()], F.lit(False))
    other = by(lambda k, v: group(k, v[2]))
    named = ship_and_name(other)
    bare = shape.isin("damage", "miss_out", "miss_in")  # a name alone; a drone's owner follows "belonging to"
    drone = F.regexp_replace(other, "^.*? belonging to ", "")
    name = F.when(shape == "miss_in", drone).when(bare, other).otherwise(named["name"])
    ship = F.when(shape == "damage", plain("damage", 5)).when(bare, "").otherwise(named["ship"])
    to = ship_and_name(F.coalesce(plain("scram", 3), F.lit("you")))
    amount = F.abs(by(lambda k, v: group(k, v[1])).try_cast("double"))
    return F.struct(
        F.coalesce(*[F.when(shape == k, v[0]) for k, v in PARTS.items()], F.lit("OTHER")).alias("kind"),
        amount.alias("amount"),
        F.when(out, "").otherwise(name).alias("source"),
        F.when(out, name).when(shape == "scram", to["name"]).otherwise("").alias("target"),
        F.when(out, "").otherwise(ship).alias("source_ship"),
        F.when(out, ship).when(shape == "scram", to["ship"]).otherwise("").alias("target_ship"),
        by(lambda k, v: group(k, v[3])).alias("weapon"),
        by(lambda k, v: group(k, v[4])).alias("quality"),
    )


def typed(df, html: str):
    """``df`` with text (without markup), shape and entry (see entry_parts) of the message ``html``."""
    rows = df.withColumn("text", strip_markup(F.col(html)))
    rows = rows.withColumn("shape", shape_of(F.col("text")))
    return rows.withColumn("entry", entry_parts(F.col(html), F.col("text"), F.col("shape")))


def log_seconds(s: Column) -> Column:
    """Seconds since 1970 of a time such as 2026.10.03 14:03:30 or 2026-10-03T14:03:30.250Z, with
    its fraction; null if it is none."""
    t = F.trim(s)
    whole = F.try_to_timestamp(F.concat(F.translate(F.substring(t, 1, 10), ".", "-"), F.lit(" "), F.substring(t, 12, 8)), F.lit("yyyy-MM-dd HH:mm:ss"))
    fraction = F.coalesce(F.regexp_extract(t, r"^.{19}(\.[0-9]+)Z?$", 1).try_cast("double"), F.lit(0.0))
    return F.when(F.length(t) >= 19, F.unix_micros(whole) / 1e6 + fraction)


def time_at(origin_us: Column, seconds: Column) -> Column:
    """The UTC time ``seconds`` (rounded to milliseconds) after an origin, such as
    2026-10-03T14:03:30.250Z."""
    us = origin_us + F.round(seconds * 1000).cast("long") * 1000
    return F.concat(F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def countdown(seconds: Column) -> Column:
    """Minutes and seconds that remain, with a sign before the start."""
    s = F.ceil(F.abs(seconds)).cast("long")
    return F.concat(F.when(seconds < 0, "-").otherwise(""), F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def speed_text(mps: Column) -> Column:
    """Whole m/s, from 1000 on km/s with one decimal."""
    return F.when(mps >= 1000, F.concat(F.format_string("%.1f", F.round(mps / 1000, 1)), F.lit(" km/s"))).otherwise(F.concat(F.round(mps).cast("long").cast("string"), F.lit(" m/s")))


def distance_text(metres: Column) -> Column:
    """Metres below 10 km, whole kilometres beyond."""
    return F.when(metres < 10_000, F.concat(F.round(metres).cast("long").cast("string"), F.lit(" m"))).otherwise(F.concat(F.round(metres / 1000).cast("long").cast("string"), F.lit(" km")))


def snapped(t: Column, up: bool, slack: float = 1e-3) -> Column:
    """The next (or previous) whole tick; a time within ``slack`` of a tick counts as on it."""
    return (F.floor(t + slack) + 1 if up else F.ceil(t - slack) - 1).cast("long")


def is_digest(s: Column) -> Column:
    """A SHA-256 in lower-case hexadecimal digits."""
    return F.coalesce(F.rlike(s, F.lit("^[0-9a-f]{64}$")), F.lit(False))
