"""Packing of token sequences into windows by non-negative least squares.

A document's ids (and the closing id) are cut into whole windows and one rest. The histogram of
piece lengths (at most one row a length) goes to the driver, which enumerates shallow combinations
of lengths that fill a window exactly, solves their repeat counts against the histogram as a
non-negative least-squares problem, rounds down, and packs what is left by best fit, again on the
histogram. The plan's size depends on the window alone. Pieces find their place by their rank among
the pieces of their length; ranks are dealt by salt, so no length meets in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm import bpe
from trackloom.llm.common import map_batches, stored, text_of

#: Parts among which the pieces of one length are ranked, at least, and pieces for which one is added.
SALTS, SALT_ROWS = 16, 1 << 16


def encode_pieces(docs: DataFrame, window: int = 1024, end_id: int = 0, text: str = "text", key: str = "doc_id", ranks_path: str | None = None) -> DataFrame:
    """The pieces of every document: key, start, length, doc_tokens, ids (little-endian unsigned
    32-bit). A null or empty text has its closing id only."""
    ranks_path = ranks_path or bpe.default_path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(key), text_of(text).alias("__text"))
    kind = rows.schema[key].dataType.simpleString()

    def make():
        encode, end = bpe.Ids(ranks_path), np.array([end_id], "<u4").tobytes()

        def work(b: dict[str, list]) -> dict[str, list]:
            out = {key: [], "start": [], "length": [], "doc_tokens": [], "ids": []}
            for k, t in zip(b[key], b["__text"]):
                ids = encode(t) + end
                n = len(ids) // 4
                for s in range(0, n, window):
                    part = ids[4 * s : 4 * (s + window)]
                    for name, v in zip(out, (k, s, len(part) // 4, n, part)):
                        out[name].append(v)
            return out

        return work

    return map_batches(rows, make, f"`{key}` {kind}, start bigint, length bigint, doc_tokens bigint, ids binary")


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to three of ``lengths`` (descending, 0 for none) whose sum is ``window``."""
    has = np.zeros(window + 1, bool)
    has[lengths] = True
    out = [[window, 0, 0]] if has[window] else []
    a = lengths[(lengths < window) & (2 * lengths >= window)]
    a = a[has[window - a]]
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1) if len(a) else np.zeros((0, 3), int)
    threes = []
    for x in lengths[(3 * lengths >= window) & (lengths < window)]:
        rest = window - x
        b = lengths[(lengths <= x) & (2 * lengths >= rest) & (lengths < rest)]
        b = b[has[rest - b]]
        threes.append(np.stack([np.full_like(b, x), b, rest - b], 1))
    return np.concatenate([np.array(out, int).reshape(-1, 3), pairs, *threes]).astype(int)


def nonnegative(combos: np.ndarray, wanted: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' lengths near the histogram ``wanted``
    (accelerated projected gradient on the least-squares error). Errors weigh as their length's
    square: what is left over should be short pieces, which fill gaps."""
    n, size = len(combos), len(wanted)
    if not n:
        return np.zeros(0)
    flat = combos.ravel()
    weight = np.repeat(1.0, flat.size) * (flat > 0)

    cost = (np.arange(size) / size) ** 2

    def forward(x):
        return np.bincount(flat, np.repeat(x, 3) * weight, minlength=size)

    def back(r):
        return (r[flat] * weight).reshape(n, 3).sum(1)

    v = np.ones(n)
    for _ in range(30):
        v = back(cost * forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(cost * (forward(y) - wanted)) / (1.02 * top))
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x


def plan(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how often each is used; together exactly the histogram."""
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    combos = combinations(np.flatnonzero(left), window)
    x = np.floor(nonnegative(combos, left.astype(float)) + 1e-6).astype(np.int64)
    out = []

    def use(lens, most: int | None = None) -> int:
        used = np.bincount(lens, minlength=window + 1)
        at = np.flatnonzero(used)
        n = int((left[at] // used[at]).min())
        n = n if most is None else min(n, most)
        if n > 0:
            left[at] -= n * used[at]
            out.append((tuple(int(v) for v in lens), n))
        return n

    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1:
            break
        use([v for v in combos[j] if v], int(x[j]))
    # the rest by best fit: the largest length, then ever the largest that still fits
    while (there := np.flatnonzero(left)).size:
        lens, room, free = [], window, left.copy()
        while (fit := there[(there <= room) & (free[there] > 0)]).size:
            lens.append(int(fit[-1]))
            free[fit[-1]] -= 1
            room -= int(fit[-1])
        use(lens)
    return out


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length the rows (first rank, first sequence, offset) of its places, by rank."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lens, n in planned:
        offset = 0
        for length in lens:
            rows.setdefault(length, []).append((taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + n
            offset += length
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def place(pieces: DataFrame, window: int = 1024, key: str = "doc_id") -> DataFrame:
    """``pieces`` (with key, start and length of 1 to ``window``) and each piece's sequence_id and
    offset. Pieces of equal key and start are told apart by their order alone. The order of equal
    rows is free, any choice is a valid packing; ``pieces`` must be stored, not recomputed."""
    spark = pieces.sparkSession
    # at most ``window`` lengths; a frequent one is dealt to as many tasks as its pieces need
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    salts = spark.createDataFrame([(k, SALTS + n // SALT_ROWS) for k, n in histogram.items()], "length int, __salts bigint")
    salts = salts.withColumn("length", F.col("length").cast(pieces.schema["length"].dataType))
    salted = pieces.join(F.broadcast(salts), "length").withColumn("__salt", F.pmod(F.xxhash64(key, "start"), F.col("__salts"))).drop("__salts")
    counts = stored(salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("__n")), "pack-counts")
    places = spark.sparkContext.broadcast(slots(plan(histogram, window)))
    upto = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "__salt", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__salt").orderBy(key, "start")
    ranked = salted.withColumn("__rank", F.row_number().over(within)).join(before, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__rank") - 1).select(*pieces.columns, "__rank")

    def make():
        table = places.value

        def work(b: dict[str, list]) -> dict[str, list]:
            ranks, lengths = np.array(b.pop("__rank"), np.int64), np.array(b["length"], np.int64)
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            for length in np.unique(lengths):
                at = lengths == length
                rows = table[int(length)]
                i = np.searchsorted(rows[:, 0], ranks[at], "right") - 1
                sequence[at], offset[at] = rows[i, 1] + ranks[at] - rows[i, 0], rows[i, 2]
            return b | {"sequence_id": sequence, "offset": offset}

        return work

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return map_batches(ranked, make, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, window: int = 1024, end_id: int = 0, carry: dict | None = None, text: str = "text", key: str = "doc_id", ranks_path: str | None = None) -> DataFrame:
    """Pieces of all documents with their places: key, start, length, doc_tokens, sequence_id,
    offset, and the ids or, instead, the columns of ``carry`` made from them.

    Null and empty texts have one piece, their closing id. Very long texts are cut into windows.
    Repeated rows are packed once each; a null key is a key like others. Other columns of ``docs``
    are left out. An empty table gives no rows.
    """
    pieces = encode_pieces(docs, window, end_id, text, key, ranks_path)
    if carry is not None:
        pieces = pieces.withColumns(carry).drop("ids")
    return place(stored(pieces, "pack-pieces"), window, key)
