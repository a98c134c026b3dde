"""On which side tracks leave the observers' plane.

Ranges to three observers leave a mirror image in their plane. Where a track grazes the plane, what
follows may be mirrored without changing a range; such an exit turns clockwise (towards the side that
the plane's normal points away from) unless evidence against that outweighs the evidence against the
other turn. Every (pilot, exit, turn) is a branch, evidence is rows of points against branches, and
its sum settles the exit. The evidence from warp points needs the other pilot's place, so exits are
settled without it first and then again, with all pilots where the first pass put them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators import contacts, geometry, intervals, windows
from trackloom.session import cut, ship_package

CW, CCW = -1, 1
_DAY = 86_400_000_000


@dataclass(frozen=True)
class Rules:
    """Lengths in metres, times in microseconds, slopes in metres per ``per``. The defaults are fixed values."""

    per: int = 1_000_000
    band: float = 3_000.0
    steep: float = 150.0
    normal_us: int = 3_000_000
    incoming_us: int = 5_000_000
    margin: float = 1.0
    cube: float = 100_000.0
    start_points: float = 10.0
    start_slack: float = 2_000.0
    boundary: float = 125_000.0
    boundary_slack: float = 5_000.0
    boundary_us: int = 5_000_000
    boundary_points: float = 10.0
    crossing_points: float = 2.0
    scramble: float = 15_000.0
    disrupt: float = 40_000.0
    long_scramble: float = 45_000.0
    long_disrupt: float = 90_000.0
    long_hulls: tuple[str, ...] = ("Onyx", "Broadsword", "Devoter", "Phobos", "Arazu", "Lachesis", "Keres")
    range_slack: float = 3_000.0
    points_per_metre: float = 0.001
    range_points: float = 5.0
    near_us: int = 2_000_000


def point_range(disruption: Column, ship: Column, rules: Rules = Rules()) -> Column:
    """How far a warp point of ``ship`` reaches."""
    long = F.lower(F.trim(F.coalesce(ship, F.lit("")))).isin([h.lower() for h in rules.long_hulls])
    return F.when(long, F.when(disruption, rules.long_disrupt).otherwise(rules.long_scramble)).otherwise(F.when(disruption, rules.disrupt).otherwise(rules.scramble))


def found(fixes: DataFrame, flat: tuple, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """The ambiguous exits (pilot, exit_id, exit_us) and the fixes with off, their distance to the
    plane, and tail: the number of the last exit before them, 0 before the first."""
    rows = fixes.select("pilot", "us", "x", "y", "z", "capsule").withColumn("off", geometry.offset(tuple(F.col(c) for c in "xyz"), flat))
    slope = F.coalesce(F.col("slope") * (rules.per / _DAY), F.lit(0.0))
    sloped = windows.centred_slope(rows, "pilot", "us", "off", rules.normal_us, least=2).withColumn("slope", slope)
    exits = cut(contacts.plane_exits(sloped, "pilot", "us", "off", "slope", rules.band, rules.steep).select("pilot", "exit_id", "exit_us"))
    later = exits.select("pilot", (F.col("exit_us") + 1).alias("us"), F.col("exit_id").alias("tail"))
    tails = windows.asof(rows, later, "pilot", "us", ["tail"]).drop("right_us")
    return exits, cut(tails.withColumn("tail", F.coalesce("tail", F.lit(0).cast("long"))))


def _turned(turn: Column, flat: tuple) -> dict[str, Column]:
    """Places of fixes whose tail is on ``side``, with the tail put on the side of ``turn``."""
    mirrored = geometry.reflect(tuple(F.col(c) for c in "xyz"), flat)
    return {c: F.when(turn.eqNullSafe(F.col("side")), F.col(c)).otherwise(m) for c, m in zip("xyz", mirrored)}


def _places(sided: DataFrame, start_us: int, flat: tuple, rules: Rules) -> DataFrame:
    """Points against branches from where they put the ship: pilot, tail, turn, start, boundary."""
    keys = ["pilot", "tail", "turn"]
    branch = sided.withColumn("turn", F.explode(F.array(F.lit(CW), F.lit(CCW))))
    at = tuple(_turned(F.col("turn"), flat).values())
    gone = geometry.norm(geometry.sub(at, geometry.vec(*[rules.cube / 2] * 3)))
    branch = branch.select(*keys, "us", "capsule", gone.alias("gone"), ((F.col("us") < start_us) & (geometry.outside(at, rules.cube) > rules.start_slack)).alias("early"))
    start = branch.groupBy(keys).agg(F.when(F.max("early"), rules.start_points).otherwise(0.0).alias("start"))
    inside = (F.col("gone") <= rules.boundary).cast("long")
    # fixes between two inside ones have one number, with the inside one that ends them
    parts = windows.carried(branch, keys, "us", [], {"back": ("sum", inside)}, exclusive=True)
    parts = windows.carried(parts, keys, "us", [], {"pods": ("sum", F.col("capsule").cast("long"))}).filter("pods = 0").withColumn("back", F.coalesce("back", F.lit(0).cast("long")))
    since = F.min(F.when(F.col("gone") > rules.boundary + rules.boundary_slack, F.col("us")))
    returns = parts.groupBy(*keys, "back").agg((F.max(F.when(inside == 1, F.col("us"))) - since >= rules.boundary_us).alias("returned"))
    boundary = returns.groupBy(keys).agg(F.when(F.max("returned"), rules.boundary_points).otherwise(0.0).alias("boundary"))
    return start.join(boundary, keys, "left").fillna(0.0, ["boundary"])


def _incoming(exits: DataFrame, tails: DataFrame, rules: Rules) -> DataFrame:
    """How fast a track nears the plane before each exit, as parts by the tail that the fixes are
    in: a least-squares slope is a sum over its points, and a mirrored tail's part changes sign."""
    spans = exits.select("pilot", "exit_id", "exit_us", (F.col("exit_us") - rules.incoming_us).alias("t0"), (F.col("exit_us") + 1).alias("t1"))
    near = intervals.stab(tails.select("pilot", "us", "off", "tail"), spans, "us", windows.BUCKET_OF_REACH * rules.incoming_us, ["pilot"])
    t = (F.col("us") - F.col("exit_us")) / rules.per
    sums = near.groupBy("pilot", "exit_id", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("t"), F.sum(t * t).alias("tt"), F.sum("off").alias("o"), F.sum(t * F.col("off")).alias("to"))
    all_ = sums.groupBy("pilot", "exit_id").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.sum("tt").alias("tt"), F.collect_list(F.struct("tail", "o", "to")).alias("parts"))
    mean = F.col("t") / F.col("n")
    spread = F.col("tt") - F.col("t") * mean
    part = lambda p: F.struct(p["tail"].alias("tail"), ((p["to"] - mean * p["o"]) / spread).alias("slope"))
    none = F.array().cast("array<struct<tail:bigint,slope:double>>")
    return all_.select("pilot", "exit_id", F.when((F.col("n") > 1) & (spread > 0), F.array_sort(F.transform("parts", part))).otherwise(none).alias("parts"))


def _settled(branches: DataFrame, rules: Rules) -> DataFrame:
    """``branches`` (pilot, exit_id, side, parts, cw, ccw) with turn and crossing. A pilot's exits are
    read in order, as whether an earlier tail is mirrored decides from which side the ship came."""
    ship_package(branches.sparkSession)
    kind = branches.schema["pilot"].dataType
    schema = f"pilot {kind.simpleString()}, exit_id bigint, turn int, crossing double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pilot, signs = None, {}
        for batch in batches:
            out = {"pilot": [], "exit_id": [], "turn": [], "crossing": []}
            for row in batch.to_pylist():
                if row["pilot"] != pilot:
                    pilot, signs = row["pilot"], {}
                signs = {k: s for k, s in signs.items() if k >= min((p["tail"] for p in row["parts"]), default=k)}
                incoming = sum(signs.get(p["tail"], 1) * p["slope"] for p in row["parts"])
                crossing = rules.crossing_points * min(abs(incoming) / rules.steep, 1.0) * ((incoming > 0) - (incoming < 0))
                turn = CCW if round(row["cw"] - row["ccw"] + crossing, 6) >= rules.margin else CW
                signs[row["exit_id"]] = 1 if turn == row["side"] else -1
                for column, v in zip(out.values(), (pilot, row["exit_id"], turn, crossing)):
                    column.append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("pilot", batch.schema.field("pilot").type), ("exit_id", pa.int64()), ("turn", pa.int32()), ("crossing", pa.float64())]))

    ordered = branches.select("pilot", "exit_id", "side", "parts", "cw", "ccw").repartition("pilot").sortWithinPartitions("pilot", "exit_id")
    return branches.join(ordered.mapInArrow(run, schema), ["pilot", "exit_id"])


def _ranges(points: DataFrame, sided: DataFrame, turns: DataFrame, flat: tuple, rules: Rules) -> DataFrame:
    """Points against branches that put a ship out of its warp point's range: pilot, tail, turn, range."""
    limit = point_range(F.col("disruption"), F.col("ship"), rules) + rules.range_slack
    both = F.explode(F.array(*[F.struct(F.col(a).alias("pilot"), F.col(b).alias("other")) for a, b in (("source", "target"), ("target", "source"))])).alias("r")
    asked = points.filter(F.col("source") != F.col("target")).select("id", F.col("us").alias("at"), limit.alias("limit"), both).select("id", "at", "limit", "r.*")
    spans = asked.withColumn("t0", F.col("at") - rules.near_us).withColumn("t1", F.col("at") + rules.near_us + 1)
    placed = sided.join(turns.select("pilot", F.col("exit_id").alias("tail"), F.col("turn").alias("first")), ["pilot", "tail"], "left")
    now = _turned(F.coalesce("first", "side"), flat)
    placed = placed.select("pilot", "us", "tail", "side", "t_first", "t_last", *"xyz", *[c.alias(f"now_{n}") for n, c in now.items()])
    hits = intervals.stab(placed, spans, "us", windows.BUCKET_OF_REACH * rules.near_us, ["pilot"])
    fields = [c for c in placed.columns if c not in ("pilot", "us")]
    nearest = hits.groupBy("id", "pilot", "other", "at", "limit").agg(F.min(F.struct(F.abs(F.col("us") - F.col("at")).alias("dt"), "us", *fields)).alias("m"))
    them = nearest.select("id", F.col("pilot").alias("other"), F.struct("m.now_x", "m.now_y", "m.now_z").alias("o"))
    me = nearest.select("id", "pilot", "other", "at", "limit", *[f"m.{c}" for c in fields]).filter("tail > 0 AND at BETWEEN t_first AND t_last")
    met = me.join(them, ["id", "other"]).withColumn("turn", F.explode(F.array(F.lit(CW), F.lit(CCW))))
    gap = geometry.norm(geometry.sub(tuple(_turned(F.col("turn"), flat).values()), tuple(F.col(f"o.now_{c}") for c in "xyz"))) - F.col("limit")
    given = F.when(gap > 0, F.least(gap * rules.points_per_metre, F.lit(rules.range_points))).otherwise(0.0)
    return met.groupBy("pilot", "tail", "turn").agg(F.sum(given).alias("range"))


def settle(fixes: DataFrame, points: DataFrame, start_us: int, flat: tuple, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """The exits and the placed fixes.

    ``fixes``: pilot, us (one fix a time and pilot), x, y, z, capsule. ``points``: id, us, source,
    target (pilots), disruption, ship. Exits: pilot, exit_id, exit_us, turn (cw or ccw), cw_points and
    ccw_points against either turn, and how start, boundary, range and crossing (positive: against
    clockwise) add to the former. Placed fixes are as given, with tails on the side of their turn.
    """
    exits, tails = found(fixes, flat, rules)
    side = F.min_by(F.signum("off"), F.when(F.abs("off") >= rules.band, F.col("us"))).cast("int")
    sides = tails.filter("tail > 0").groupBy("pilot", "tail").agg(F.coalesce(side, F.lit(CCW)).alias("side"), F.min("us").alias("t_first"), F.max("us").alias("t_last"))
    sided = cut(tails.join(sides, ["pilot", "tail"], "left"))
    by_turn = _places(sided.filter("tail > 0"), start_us, flat, rules)
    base = exits.join(sides.select("pilot", F.col("tail").alias("exit_id"), "side"), ["pilot", "exit_id"]).join(_incoming(exits, tails, rules), ["pilot", "exit_id"])

    def branches(evidence: DataFrame, kinds: list[str]) -> DataFrame:
        total = sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))
        of = lambda c, turn: F.sum(F.when(F.col("turn") == turn, c).otherwise(0.0))
        sums = evidence.groupBy("pilot", F.col("tail").alias("exit_id")).agg(of(total, CW).alias("cw"), of(total, CCW).alias("ccw"), *[of(F.col(k), CW).alias(k) for k in kinds])
        return base.join(sums, ["pilot", "exit_id"])

    first = cut(_settled(branches(by_turn, ["start", "boundary"]), rules))
    ranges = _ranges(points, sided, first, flat, rules)
    evidence = by_turn.join(ranges, ["pilot", "tail", "turn"], "left").fillna(0.0, ["range"])
    second = cut(_settled(branches(evidence, ["start", "boundary", "range"]), rules))
    turn = F.when(F.col("turn") == CCW, "ccw").otherwise("cw").alias("turn")
    against = [(F.col("cw") + F.greatest("crossing", F.lit(0.0))).alias("cw_points"), (F.col("ccw") + F.greatest(-F.col("crossing"), F.lit(0.0))).alias("ccw_points")]
    settled = second.select("pilot", "exit_id", "exit_us", turn, *against, "start", "boundary", "range", "crossing")
    put = sided.join(second.select("pilot", F.col("exit_id").alias("tail"), "turn"), ["pilot", "tail"], "left")
    return settled, put.select("pilot", "us", "capsule", "tail", *[c.alias(n) for n, c in _turned(F.coalesce("turn", "side"), flat).items()])
