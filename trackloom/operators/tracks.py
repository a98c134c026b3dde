"""Tracks from ranges to three observers.

A pilot's readings are cut into stretches wherever a range changes by more than its ship could have
moved. Ranges leave two places, mirrored in the observers' plane, and a track's mirror image reads
the same: so each step, a passage near the plane or a restart, only says whether the ship changes
sides, and the side of a reading is the parity of the changes so far. Cuts, places and sides are
columns and running sums. What is left, the least-squares problem of a stretch, is solved in chunks
of CHUNK readings with OVERLAP more on either side, after which a reading's pull has died down; no
group is larger, whatever a pilot's readings number. Pilots of few readings are dealt once and run
whole, up to the sides of their readings; longer ones run in buckets of time.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import geometry, windows
from trackloom.session import cut, ship_package

#: Fixed values, in metres and seconds: noise of acceleration, range and speed; noise of a ship at rest.
ACCELERATION, RANGE, SPEED = 300.0, 288.675, 50.0
REST_SPEED, REST_SIGMA, REST_ACCELERATION = 1.0, 1.0, 1.0
#: A range's jump that ends a stretch; the gate of speeds in deviations; how much
#: nearer one mirror root must be to be taken at once.
JUMP, GATE, NEARER = 8_000.0, 2.0, 20_000.0
#: Speed that a ship without a known speed may have between two readings.
UNKNOWN_SPEED = 1_000.0
#: Steps of the nonlinear least squares, and the place change that ends them.
STEPS, STILL = 12, 0.5
#: Squared heights over the observers' plane, in units of range noise times range, that are clear of
#: it for certain and that may well be in it.
CLEAR, AT_PLANE = 6.0, 2.0
#: Readings whose climb decides between two mirror roots, or on a passage through the plane.
AHEAD = 10
#: Readings solved at once, and those on either side that are solved with them.
CHUNK, OVERLAP = 256, 64
#: Microseconds of a bucket of running columns; readings, padding included, that numpy takes at once.
BUCKET_US, AT_ONCE = 600_000_000, 1 << 15

RANGES = ("d_a", "d_b", "d_c")
#: What a run hands on to the next one.
LEFT = ("stretch", "to", "last_climb", "last_t", "last_h")
SCHEMA = "match string, pilot string, t double, x double, y double, z double, residual double"


def _order() -> list[Column]:
    return [F.col(c) for c in (*RANGES, "speed")]


def _keyed(readings: DataFrame) -> DataFrame:
    """The readings with a time, unread values as nulls, with __key and us."""
    known = {c: F.when(~F.isnan(c), F.col(c)).alias(c) for c in (*RANGES, "speed")}
    rows = readings.filter(F.col("t").isNotNull() & ~F.isnan("t")).select("match", "pilot", "t", *known.values())
    return rows.withColumn("__key", F.to_json(F.struct("match", "pilot"))).withColumn("us", F.round(F.col("t") * 1e6).cast("long"))


def _parts(readings: DataFrame) -> tuple[list[tuple[DataFrame, bool]], int]:
    """The keyed readings in parts, with whether a part's keys run whole, as it is dealt to tasks by key;
    and the number of these tasks."""
    parts = windows.by_length(_keyed(readings), ["__key"])
    return [(rows.repartition(tasks, "__key") if tasks else rows, tasks > 0) for (rows,), tasks in parts], max(tasks for _, tasks in parts)


def stretches(readings: DataFrame) -> DataFrame:
    """Readings with __key, us, n (the reading's number in its match and pilot), stretch and whole
    (no range is unread). A stretch ends where some range is further from its last known value than
    JUMP and the ship's own way since then allow, and lasts from its first whole reading to its last
    one; readings outside are dropped, as are those without a time. Readings of one time are taken in
    the order of their ranges; NaN is an unread value."""
    return functools.reduce(DataFrame.unionByName, (_stretches(*part) for part in _parts(readings)[0]))


def _stretches(rows: DataFrame, alone: bool) -> DataFrame:
    """``stretches`` of keyed readings; with ``alone`` each key runs whole."""
    last = {f"__p{c}": ("last", F.when(F.col(c).isNotNull(), F.struct("t", F.col(c).alias("d"), "speed"))) for c in RANGES}
    rows = windows.carried(rows, ["__key"], "us", _order(), last, exclusive=True, size=BUCKET_US, whole=alone)

    def jumps(c: str) -> Column:
        before, pace = F.col(f"__p{c}"), lambda v: F.coalesce(v, F.lit(UNKNOWN_SPEED))
        way = F.greatest(pace(F.col("speed")), pace(before["speed"])) * (F.col("t") - before["t"])
        return F.coalesce(F.abs(F.col(c) - before["d"]) > JUMP + way, F.lit(False))

    rows = rows.withColumn("__new", functools.reduce(lambda a, b: a | b, map(jumps, RANGES)).cast("long")).drop(*last)
    # of rows that are equal otherwise, the one that begins a stretch comes first
    numbered = {"stretch": ("sum", F.col("__new")), "n": ("sum", F.lit(1).cast("long"))}
    rows = windows.carried(rows, ["__key"], "us", [*_order(), -F.col("__new")], numbered, size=BUCKET_US, whole=alone).drop("__new")
    rows = rows.withColumn("whole", functools.reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in RANGES)))
    ends = {"__first": F.min, "__last": F.max}
    if alone:
        w = Window.partitionBy("__key", "stretch").orderBy("us", "n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumns({c: f(F.when(F.col("whole"), F.col("n"))).over(w) for c, f in ends.items()})
    else:
        rows = cut(rows)
        rows = rows.join(rows.filter("whole").groupBy("__key", "stretch").agg(*[f("n").alias(c) for c, f in ends.items()]), ["__key", "stretch"])
    return rows.filter(F.col("n").between(F.col("__first"), F.col("__last"))).drop("__first", "__last")


def _on(rows: DataFrame, observers: list[tuple[float, float, float]]) -> DataFrame:
    """``rows`` with foot (a struct x, y, z) and height: the places of whole readings are height above
    and below the foot in the observers' plane."""
    at = tuple(geometry.vec(*o) for o in observers)
    up, down = geometry.trilaterate(at, tuple(F.col(c) for c in RANGES))
    rows = rows.withColumns({f"__u{a}": u for a, u in zip("xyz", up)} | {f"__d{a}": d for a, d in zip("xyz", down)})
    foot = F.struct(*[((F.col(f"__u{a}") + F.col(f"__d{a}")) / 2).alias(a) for a in "xyz"])
    gap = geometry.norm(tuple((F.col(f"__u{a}") - F.col(f"__d{a}")) / 2 for a in "xyz"))
    return rows.withColumn("foot", F.when(F.col("whole"), foot)).withColumn("height", F.when(F.col("whole"), gap)).drop(*[f"__{s}{a}" for s in "ud" for a in "xyz"])


def _runs(rows: DataFrame, alone: bool) -> DataFrame:
    """``rows`` with clear and run. A whole reading is clear of the plane if noise of its ranges cannot
    hide its side, and at the plane if noise can well have lifted it. A run ends where, since its last
    clear reading, one was at the plane or one step may have crossed it; readings that are not clear
    belong to the run before them, a stretch's first ones to its first. With ``alone`` each key runs whole."""
    by, noise = ["__key", "stretch"], RANGE * F.greatest(*RANGES)
    rows = rows.withColumn("clear", F.coalesce(F.col("height") ** 2 > CLEAR * noise, F.lit(False)))
    before = {"__p": ("last", F.when(F.col("whole"), F.struct("t", "height")))}
    rows = windows.carried(rows, by, "us", [F.col("n")], before, exclusive=True, size=BUCKET_US, whole=alone)
    crossed = F.col("height") + F.col("__p.height") <= UNKNOWN_SPEED * (F.col("t") - F.col("__p.t"))
    meets = F.coalesce(crossed | (F.col("height") ** 2 < AT_PLANE * noise), F.lit(False))
    rows = rows.withColumn("__meets", F.when(meets, F.col("n"))).drop("__p")
    before = {"__met": ("last", F.col("__meets")), "__was": ("last", F.when(F.col("clear"), F.col("n")))}
    rows = windows.carried(rows if alone else cut(rows), by, "us", [F.col("n")], before, exclusive=True, size=BUCKET_US, whole=alone)
    begins = F.col("clear") & (F.col("__was").isNull() | (F.greatest("__meets", "__met") > F.col("__was")))
    rows = rows.withColumn("__begins", F.coalesce(begins, F.lit(False)).cast("long")).drop("__met", "__was", "__meets")
    rows = windows.carried(rows, by, "us", [F.col("n")], {"run": ("sum", F.col("__begins"))}, size=BUCKET_US, whole=alone)
    return rows.withColumn("run", F.greatest("run", F.lit(1))).drop("__begins")


def _sides(rows: DataFrame, observers: list[tuple[float, float, float]], side: float) -> DataFrame:
    """__key, stretch, run, sign of each run: 1 for places above the plane (geometry.trilaterate's
    first root), -1 below."""
    by = ["__key", "stretch", "run"]
    whole = rows.filter("whole")
    seen = F.struct("foot", "height")
    ends = whole.groupBy(*by).agg(F.min("us").alias("us"), F.min_by(seen, "n").alias("from"), F.max_by(seen, "n").alias("to"))

    def climb(order: Column, edge, name: str) -> DataFrame:
        near = windows.top_per_group(whole.filter("clear").select(*by, "n", "t", "height"), by, [order], AHEAD)
        return near.groupBy(*by).agg(F.coalesce(F.regr_slope("height", "t"), F.lit(0.0)).alias(f"{name}_climb"), edge("t", "n").alias(f"{name}_t"), edge("height", "n").alias(f"{name}_h"))

    runs = ends.join(climb(F.col("n"), F.min_by, "first"), by, "left").join(climb(F.col("n").desc(), F.max_by, "last"), by, "left")
    runs = cut(runs.fillna(0.0, ["first_climb", "last_climb"]))
    before = {"__p": ("last", F.struct(*LEFT))}
    runs = windows.carried(runs, ["__key"], "us", [F.col("stretch"), F.col("run")], before, exclusive=True, size=BUCKET_US)
    runs = runs.withColumn("__changes", _changes(observers, side)).select(*by, "us", "__changes")
    runs = windows.carried(runs, ["__key"], "us", [F.col("stretch"), F.col("run")], {"__sum": ("sum", F.col("__changes"))}, size=BUCKET_US)
    return runs.select(*by, _sign().alias("sign"))


def _sign() -> Column:
    return F.when(F.col("__sum") % 2 == 0, 1.0).otherwise(-1.0)


def _changes(observers: list[tuple[float, float, float]], side: float) -> Column:
    """1 for a run on the other side than __p, the run before it, else 0. Between two runs of a stretch
    the ship has passed the plane or turned back, whichever changes its climb less. A restart takes the
    root clearly nearer to the last place, else the one whose climb is nearer to that before; a track
    starts at the root least outside the cube, of equals the one nearer its centre."""
    _, normal = geometry.plane(*(geometry.vec(*o) for o in observers))
    lifted = lambda s, sign: geometry.add(tuple(s["foot"][a] for a in "xyz"), geometry.scale(normal, sign * s["height"]))
    last, v, w = lifted(F.col("__p.to"), 1.0), F.col("__p.last_climb"), F.col("first_climb")
    between = lambda s: (s * F.col("first_h") - F.col("__p.last_h")) / F.greatest(F.col("first_t") - F.col("__p.last_t"), F.lit(1e-3))
    bend = lambda s: (between(s) - v) ** 2 + (s * w - between(s)) ** 2
    up, down = lifted(F.col("from"), 1.0), lifted(F.col("from"), -1.0)
    away, mirrored = geometry.norm(geometry.sub(up, last)), geometry.norm(geometry.sub(down, last))
    restart = F.when(F.abs(away - mirrored) > NEARER, mirrored < away).otherwise(F.abs(w + v) < F.abs(w - v))
    middle = geometry.vec(*[side / 2] * 3)
    start = F.struct(geometry.outside(down, side), geometry.norm(geometry.sub(down, middle))) < F.struct(geometry.outside(up, side), geometry.norm(geometry.sub(up, middle)))
    changes = F.when(F.col("__p").isNull(), start).when(F.col("__p.stretch") == F.col("stretch"), bend(-1.0) <= bend(1.0)).otherwise(restart)
    return F.coalesce(changes, F.lit(False)).cast("long")


def _with_sides(rows: DataFrame, observers: list[tuple[float, float, float]], side: float) -> DataFrame:
    """``rows`` of keys that run whole with the sign of ``_sides``: what tells a run from the one before
    it is worked out at the run's readings and told at its first one."""
    run = Window.partitionBy("__key", "stretch", "run").orderBy("n")
    every, so_far = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), run.rowsBetween(Window.unboundedPreceding, 0)
    clear = F.col("clear").cast("int")
    rows = rows.withColumns({"__nth": F.sum(clear).over(so_far), "__all": F.sum(clear).over(every), "__row": F.row_number().over(run)})
    of = lambda c, here: F.when(F.col("clear") & here, F.col(c))
    first, last = F.col("__nth") <= AHEAD, F.col("__nth") > F.col("__all") - AHEAD
    seen = F.when(F.col("whole"), F.struct("foot", "height"))
    made = {"from": F.first(seen, ignorenulls=True), "to": F.last(seen, ignorenulls=True)}
    for name, edge, here in (("first", F.first, first), ("last", F.last, last)):
        made |= {f"{name}_climb": F.regr_slope(of("height", here), of("t", here)), f"{name}_t": edge(of("t", here), ignorenulls=True), f"{name}_h": edge(of("height", here), ignorenulls=True)}
    rows = rows.withColumns({c: x.over(every) for c, x in made.items()}).fillna(0.0, ["first_climb", "last_climb"])
    begins = F.col("__row") == 1
    before = {"__p": ("last", F.when(begins, F.struct(*LEFT)))}
    rows = windows.carried(rows, ["__key"], "n", [], before, exclusive=True, whole=True)
    rows = rows.withColumn("__changes", F.when(begins, _changes(observers, side)).otherwise(0)).drop("__nth", "__all", "__row", "__p", *made)
    rows = windows.carried(rows, ["__key"], "n", [], {"__sum": ("sum", F.col("__changes"))}, whole=True)
    return rows.withColumn("sign", _sign()).drop("__changes", "__sum")


def placed(readings: DataFrame, observers: list[tuple[float, float, float]], side: float) -> DataFrame:
    """The readings of ``stretches`` with foot, height, clear, run and sign."""
    return functools.reduce(DataFrame.unionByName, (_placed(*part, observers, side) for part in _parts(readings)[0]))


def _placed(rows: DataFrame, alone: bool, observers: list[tuple[float, float, float]], side: float) -> DataFrame:
    """``placed`` of keyed readings; with ``alone`` each key runs whole."""
    rows = _runs(_on(_stretches(rows, alone), observers), alone)
    if alone:
        return _with_sides(rows, observers, side)
    rows = cut(rows)
    return rows.join(_sides(rows, observers, side), ["__key", "stretch", "run"])


def _guessed(rows: DataFrame, alone: bool, observers: list[tuple[float, float, float]]) -> DataFrame:
    """``rows`` of ``placed`` with gx, gy, gz: on the line between the feet of the whole readings
    around, lifted by the heights, each on its side, of the clear readings around; where a stretch has
    none, by those of its whole readings. With ``alone`` each key runs whole."""
    height = (F.col("sign") * F.col("height")).alias("h")
    seen = {"w": F.when(F.col("whole"), F.struct("t", *[F.col(f"foot.{a}").alias(a) for a in "xyz"], height)), "c": F.when(F.col("clear"), F.struct("t", height))}
    for end, ahead in ((0, False), (1, True)):
        found = {f"__{name}{end}": ("last", c) for name, c in seen.items()}
        rows = windows.carried(rows, ["__key", "stretch"], "us", [-F.col("n") if ahead else F.col("n")], found, ahead=ahead, size=BUCKET_US, whole=alone)

    def line(name: str, of: str) -> Column:
        a, b = F.coalesce(f"__{name}0", f"__{name}1"), F.coalesce(f"__{name}1", f"__{name}0")
        apart = b["t"] - a["t"]
        return F.when(apart > 0, a[of] + (b[of] - a[of]) * (F.col("t") - a["t"]) / apart).otherwise(a[of])

    _, normal = geometry.plane(*(geometry.vec(*o) for o in observers))
    lift = F.coalesce(line("c", "h"), line("w", "h"))
    return rows.withColumns({f"g{a}": line("w", a) + lift * n for a, n in zip("xyz", normal)})


def _solved(blocks: np.ndarray, ahead: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Block tridiagonal elimination of many systems at once: (systems, blocks, 6, 6) on the
    diagonal, ``ahead`` between k and k + 1."""
    left, y = blocks.copy(), right[..., None].copy()
    for k in range(1, left.shape[1]):
        f = np.linalg.solve(left[:, k - 1], ahead[:, k - 1]).transpose(0, 2, 1)
        left[:, k] -= f @ ahead[:, k - 1]
        y[:, k] -= f @ y[:, k - 1]
    x = np.empty_like(y)
    x[:, -1] = np.linalg.solve(left[:, -1], y[:, -1])
    for k in range(left.shape[1] - 2, -1, -1):
        x[:, k] = np.linalg.solve(left[:, k], y[:, k] - ahead[:, k] @ x[:, k + 1])
    return x[..., 0]


def _change(at: np.ndarray, t: np.ndarray, d: np.ndarray, speed: np.ndarray, p: np.ndarray) -> np.ndarray:
    """One Gauss-Newton step of (chunks, readings) places ``p``; readings with no time are padding."""
    real, known, eye = ~np.isnan(t), ~np.isnan(d), np.eye(3)
    two_real, three_real = real[:, 1:], real[:, 2:]
    h = np.where(two_real, np.maximum(np.diff(t), 1e-3), 1.0)
    resting = speed <= REST_SPEED
    still = resting[:, 1:] & resting[:, :-1]
    n = t.shape[1]
    # bands of 3 x 3 blocks: a reading with itself, the next one, the one after
    own, one, two = (np.zeros((*t.shape, 3, 3)) for _ in range(3))
    way = p[:, :, None] - at
    far = np.maximum(np.linalg.norm(way, axis=-1), 1.0)
    unit = way / far[..., None]
    own += np.einsum("bki,bkix,bkiy->bkxy", known / RANGE**2, unit, unit)
    g = np.einsum("bki,bkix->bkx", np.where(known, d - far, 0.0) / RANGE**2, unit)
    # between two readings at rest the ship does not move; else its way has the read length
    step = np.diff(p, axis=1) / h[..., None]
    pace = np.linalg.norm(step, axis=-1)
    told = np.where(np.isnan(speed[:, 1:]), speed[:, :-1], speed[:, 1:])
    off = np.where(np.isnan(told), 0.0, told - pace)
    weight = np.where(np.isnan(told) | (pace < 1.0), 0.0, np.minimum(1.0, GATE * SPEED / np.maximum(np.abs(off), 1e-9)) / SPEED**2)
    along = step / np.maximum(pace, 1e-9)[..., None]
    hess = np.where(still[..., None, None], eye / REST_SIGMA**2, weight[..., None, None] * along[..., :, None] * along[..., None, :]) / (h**2)[..., None, None]
    grad = np.where(still[..., None], -step / REST_SIGMA**2, (weight * off)[..., None] * along) / h[..., None]
    hess, grad = hess * two_real[..., None, None], grad * two_real[..., None]
    own[:, 1:] += hess
    own[:, :-1] += hess
    one[:, :-1] -= hess
    g[:, 1:] += grad
    g[:, :-1] -= grad
    # change of velocity between three readings
    c = np.stack([1 / h[:, :-1], -1 / h[:, :-1] - 1 / h[:, 1:], 1 / h[:, 1:]], -1)
    noise = np.where(still[:, 1:] & still[:, :-1], REST_ACCELERATION, ACCELERATION) ** 2 * (h[:, :-1] + h[:, 1:]) / 2
    sure = three_real / noise
    bend = c[..., :1] * p[:, :-2] + c[..., 1:2] * p[:, 1:-1] + c[..., 2:] * p[:, 2:]
    for i, band in enumerate((own, one, two)):
        for j in range(3 - i):
            band[:, j : j + n - 2] += (c[..., j] * c[..., j + i] * sure)[..., None, None] * eye
    for j in range(3):
        g[:, j : j + n - 2] -= (c[..., j] * sure)[..., None] * bend
    own += np.where(real, 1e-9, 1.0)[..., None, None] * eye
    # two readings a block make the band block tridiagonal
    blocks, ahead = np.zeros((len(t), n // 2, 6, 6)), np.zeros((len(t), n // 2, 6, 6))
    blocks[..., :3, :3], blocks[..., 3:, 3:], blocks[..., :3, 3:], blocks[..., 3:, :3] = own[:, ::2], own[:, 1::2], one[:, ::2], one[:, ::2]
    ahead[..., :3, :3], ahead[..., 3:, 3:], ahead[..., 3:, :3] = two[:, ::2], two[:, 1::2], one[:, 1::2]
    return _solved(blocks, ahead, g.reshape(len(t), n // 2, 6)).reshape(len(t), n, 3)


def smoothed(at: np.ndarray, t: np.ndarray, d: np.ndarray, speed: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Places of chunks (an even number of readings, four at least) from a first guess ``p``. Unknown
    ranges and speeds have no term; speeds beyond the gate weigh less. A chunk that is still is done,
    whatever the others need."""
    p, busy = p.copy(), np.arange(len(t))
    for _ in range(STEPS):
        change = _change(at, t[busy], d[busy], speed[busy], p[busy])
        size = np.linalg.norm(change, axis=-1)
        p[busy] += change * np.minimum(1.0, 20_000.0 / np.maximum(size, 1e-9))[..., None]
        busy = busy[size.max(1) >= STILL]
        if not len(busy):
            break
    return p


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole chunks of a sorted partition, and where each begins."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        if not rows.num_rows:
            continue
        new = np.zeros(rows.num_rows, bool)
        for c in ("__key", "stretch", "chunk"):
            new[1:] |= pc.not_equal(rows[c].slice(1), rows[c].slice(0, rows.num_rows - 1)).to_numpy()
        begins = np.concatenate([[0], np.flatnonzero(new)])
        if len(begins) > 1:
            yield rows.slice(0, begins[-1]), begins[:-1]
        held = rows.slice(begins[-1])
    if held is not None and held.num_rows:
        yield held, np.zeros(1, int)


def _padded(begins: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of like length together: (chunks, readings) row numbers, and which of them are padding."""
    order = np.argsort(lengths, kind="stable")
    while len(order):
        longest = max(4, int(lengths[order[-1]] + 1) // 2 * 2)
        take = order[-max(1, AT_ONCE // longest) :]
        take = take[lengths[take] * 2 >= min(longest, lengths[take].max())]
        order = order[: len(order) - len(take)]
        place = np.arange(longest)[None]
        yield begins[take][:, None] + np.minimum(place, lengths[take][:, None] - 1), place >= lengths[take][:, None]


def solve_tracks(readings: DataFrame, observers: list[tuple[float, float, float]], side: float) -> DataFrame:
    """Places (match, pilot, t, x, y, z) and residual (root mean square of how far known ranges are
    missed) from readings (match, pilot, t, d_a, d_b, d_c, speed; null where unread) of a cube with
    edge ``side``: the readings that ``stretches`` keeps. Null matches and pilots are keys of their
    own; other columns are not read."""
    ship_package(readings.sparkSession)
    places = np.array(observers, float)
    parts, tasks = _parts(readings)
    guessed = (_guessed(_placed(*part, observers, side), part[1], observers) for part in parts)
    rows = functools.reduce(DataFrame.unionByName, guessed).select("__key", "stretch", "n", "match", "pilot", "t", *RANGES, "speed", "gx", "gy", "gz")
    chunk = lambda c: F.floor(c / F.lit(CHUNK)).cast("long")
    rows = rows.withColumn("own", chunk(F.col("n")))
    rows = rows.withColumn("chunk", F.explode(F.array_distinct(F.array(chunk(F.col("n") - OVERLAP), F.col("own"), chunk(F.col("n") + OVERLAP)))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _groups(batches):
            lengths = np.diff(np.append(begins, table.num_rows))
            t, speed, *rest = (table[c].to_numpy().astype(float) for c in ("t", "speed", *RANGES, "gx", "gy", "gz"))
            d, guess = np.stack(rest[:3], 1), np.stack(rest[3:], 1)
            own = table["own"].to_numpy() == table["chunk"].to_numpy()
            out = np.zeros((len(t), 3))
            some = np.logical_or.reduceat(own, begins)
            for at, padding in _padded(begins[some], lengths[some]):
                hide = lambda x: np.where(padding.reshape(padding.shape + (1,) * (x.ndim - 2)), np.nan, x)
                found = smoothed(places, hide(t[at]), hide(d[at]), hide(speed[at]), guess[at])
                out[at[~padding]] = found[~padding]
            off = np.where(np.isnan(d), 0.0, np.linalg.norm(out[:, None] - places, axis=-1) - d)
            residual = np.sqrt((off**2).sum(1) / np.maximum((~np.isnan(d)).sum(1), 1))
            keep = np.flatnonzero(own)
            if len(keep):
                keys = [table[c].combine_chunks().take(pa.array(keep)) for c in ("match", "pilot")]
                yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, (t[keep], *out[keep].T, residual[keep]))], names=["match", "pilot", "t", "x", "y", "z", "residual"])

    dealt = rows.repartition(tasks, "__key", "stretch", "chunk").sortWithinPartitions("__key", "stretch", "chunk", "n")
    return dealt.mapInArrow(work, SCHEMA)
