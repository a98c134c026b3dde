"""Periodic runs of words: the array of a text's word ids against every shift of itself.

A run is a stretch of consecutive words with smallest period q, of at least LEAST words and EXPONENT
times q, that no neighbouring word extends. Where the array equals its shift by p in a stretch of L
words, L + p words have period p; so every lag up to n / EXPONENT is scanned and the true stretches
are measured. Short lags compare the whole array. At a long lag p a stretch that counts has at least
three places that are multiples of p, one after another; only those anchors are compared, for many
lags at once, and the arrays around three true ones are compared whole. That skips no stretch, and all
lags of n words cost n log n places instead of n * n.

A stretch at lag p may have a smaller period, which then divides p. Its smallest period is found once
and the stretch kept as known; anchors that lie in it are passed over at multiples of that period.

Texts of more than LAG_WORDS words are dealt to several tasks by ranges of lags of like cost.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import map_batches, text_of

#: The least words of a run, and its least length in periods.
LEAST, EXPONENT = 6, 4
#: Lags up to this one compare the whole array.
WHOLE = 16
#: Words of a text for each range of lags, and the ranges at most; more only make a range's task longer.
LAG_WORDS, MOST_RANGES = 1 << 14, 16
#: Places that are compared at once.
CELLS = 1 << 18

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _primes(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] * (n > 1)


def _agreement(ids: np.ndarray, lag: int, start: int, step: int) -> int:
    """How many places from ``start`` on, in direction ``step``, equal those ``lag`` further."""
    n, limit, size = 0, (len(ids) - lag - start) if step > 0 else start + 1, 64
    while n < limit:
        size = min(2 * size, limit - n)
        lo = start + n if step > 0 else start - n - size + 1
        differs = np.flatnonzero(ids[lo : lo + size] != ids[lo + lag : lo + lag + size])
        if len(differs):
            return n + int(differs[0] if step > 0 else size - 1 - differs[-1])
        n += size
    return n


class Stretches:
    """The runs found in one array, and the longer ones by period, so that multiples pass them over."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.runs: dict[tuple[int, int], int] = {}
        self.known: dict[int, tuple[list[int], list[int]]] = {}

    def keep(self, start: int, end: int, period: int) -> None:
        if (start, end) not in self.runs:
            self.runs[start, end] = period
            if end - start > 3 * WHOLE:
                starts, ends = self.known.setdefault(period, ([], []))
                at = bisect.bisect(starts, start)
                starts.insert(at, start)
                ends.insert(at, end)

    def covered(self, lag: int, at: np.ndarray) -> np.ndarray:
        """Which windows of 3 lags and a word, from ``at`` on, lie in a run whose period divides ``lag``."""
        out = np.zeros(len(at), bool)
        for period, (starts, ends) in self.known.items():
            if lag % period == 0:
                i = np.searchsorted(starts, at, "right") - 1
                out |= (i >= 0) & (np.asarray(ends)[i] > at + 3 * lag)
        return out

    def forget(self, lag: int) -> None:
        """Runs too short to hold a window of this lag or of longer ones."""
        for period in list(self.known):
            kept = [(s, e) for s, e in zip(*self.known[period]) if e - s > 3 * lag]
            if kept:
                self.known[period] = tuple(map(list, zip(*kept)))
            else:
                del self.known[period]

    def whole(self, lag: int) -> None:
        """All stretches at a lag, from the comparison of the whole array; shorter lags came before."""
        equal, least = self.ids[lag:] == self.ids[:-lag], max(LEAST, EXPONENT * lag)
        if np.count_nonzero(equal) < least - lag:
            return
        same = np.zeros(len(equal) + 2, bool)
        same[1:-1] = equal
        edge = np.flatnonzero(same[1:] != same[:-1])
        starts, ends = edge[::2], edge[1::2] + lag
        long = ends - starts >= least
        for start, end in zip(starts[long].tolist(), ends[long].tolist()):
            self.keep(start, end, lag)

    def around(self, lag: int, anchors: np.ndarray) -> None:
        """The stretches at a lag that hold one of ``anchors`` (ascending)."""
        done = -1
        for at in anchors[~self.covered(lag, anchors)].tolist():
            if at + 3 * lag < done:
                continue
            if not np.array_equal(self.ids[at : at + 2 * lag + 1], self.ids[at + lag : at + 3 * lag + 1]):
                continue
            start = at + 1 - _agreement(self.ids, lag, at, -1)
            end = done = at + lag + _agreement(self.ids, lag, at, 1)
            if end - start < max(LEAST, EXPONENT * lag):
                continue
            period = lag
            for prime in _primes(lag):
                while period % prime == 0:
                    less = period // prime
                    if not np.array_equal(self.ids[start : start + lag], self.ids[start + less : start + less + lag]):
                        break
                    period = less
            self.keep(start, end, period)


def runs_between(ids: np.ndarray, first: int, last: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs that some lag from ``first`` to before ``last`` shows."""
    n = len(ids)
    last = min(last, n // EXPONENT + 1)
    found = Stretches(ids)
    for lag in range(first, min(last, WHOLE + 1)):
        found.whole(lag)
    lag = max(first, WHOLE + 1)
    while lag < last:
        found.forget(lag)
        per_lag = (n - 1) // lag  # anchors k * lag with a place one lag further
        until = min(last, 2 * lag, lag + max(1, CELLS // per_lag))
        lags = np.arange(lag, until)
        at = lags[:, None] * np.arange(per_lag + 1)
        inside = at < n
        words = np.where(inside, ids[np.minimum(at, n - 1)], -1 - np.arange(per_lag + 1, dtype=ids.dtype))
        same = words[:, 1:] == words[:, :-1]
        row, k = np.nonzero(same[:, :-2] & same[:, 1:-1] & same[:, 2:])
        for share in (1 / 3, 2 / 3, 4 / 3, 5 / 3):  # places between true anchors must be true as well
            p = lags[row]
            x = k * p + (share * p).astype(np.int64)
            fits = ids[x] == ids[x + p]
            row, k = row[fits], k[fits]
        cut = np.flatnonzero(np.diff(row)) + 1  # rows ascend
        for r, anchors in zip(row[np.concatenate([[0], cut])].tolist() if len(row) else (), np.split(k, cut)):
            found.around(int(lags[r]), anchors * lags[r])
        lag = until
    return sorted(((s, e - s, q) for (s, e), q in found.runs.items()), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words less those that a run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def lag_ranges(n: int, lag_words: int = LAG_WORDS) -> list[int]:
    """Bounds of the ranges of lags of n words, each of like cost: a lag p costs about n / p places."""
    parts = max(1, min(MOST_RANGES, n // lag_words))
    bounds = [1, *(WHOLE + 1 + int((n // EXPONENT) ** (i / parts)) for i in range(1, parts)), n // EXPONENT + 1]
    return sorted({min(b, n // EXPONENT + 1) for b in bounds} | {1})


def _words(key, text: bytes, rewrite: Callable | None) -> list[bytes]:
    words = text.split()
    return words if rewrite is None else rewrite(key, words)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", rewrite: Callable | None = None, lag_words: int = LAG_WORDS) -> DataFrame:
    """key, n_words, runs (start, length, period; by start, then period), collapsed (the text's words
    but those that repeat a run's first period, joined by one space), one row per row of ``docs``.

    ``rewrite``, if given, takes a key and its words (bytes) and returns the words to use. Words are
    what ASCII white space parts; a null or empty text has none, and no runs. Null keys and repeated
    rows are kept, each with its own result. Texts are taken whole at any length; those of more than ``lag_words``
    words are dealt by ranges of lags and cost ``MOST_RANGES`` copies at most. Other columns are left
    out, so none can clash. An empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("key"), text_of(text).cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    result = f"key {kind}, n_words bigint, runs {RUNS}, collapsed binary"

    def shown(runs) -> list[dict]:
        return [dict(zip(("start", "length", "period"), r)) for r in runs]

    def finish(keys, texts, runs_of: Callable) -> dict[str, list]:
        out = {"key": [], "n_words": [], "runs": [], "collapsed": []}
        for i, (k, t) in enumerate(zip(keys, texts)):
            words = _words(k, t, rewrite)
            runs = runs_of(i, words)
            for column, v in zip(out.values(), (k, len(words), shown(runs), collapse(words, runs))):
                column.append(v)
        return out

    def at_once():
        return lambda b: finish(b["key"], b["text"], lambda i, words: runs_between(word_ids(words), 1, len(words)))

    def ranges():
        def work(b: dict[str, list]) -> dict[str, list]:
            out = {"key": [], "blob": [], "first": [], "last": [], "text": []}
            for k, t, blob in zip(b["key"], b["text"], b["blob"]):
                bounds = lag_ranges(len(_words(k, t, rewrite)), lag_words)
                for pair in zip(bounds[:-1], bounds[1:]):
                    for column, v in zip(out.values(), (k, blob, *pair, t)):
                        column.append(v)
            return out

        return work

    def in_range():
        def work(b: dict[str, list]) -> dict[str, list]:
            found = [runs_between(word_ids(_words(k, t, rewrite)), first, last) for k, t, first, last in zip(b["key"], b["text"], b["first"], b["last"])]
            return {"key": b["key"], "blob": b["blob"], "runs": [shown(r) for r in found]}

        return work

    def put_together():
        return lambda b: finish(b["key"], b["text"], lambda i, words: [(r["start"], r["length"], r["period"]) for r in b["runs"][i]])

    # n words take 2 n - 1 bytes at least
    long = F.length("text") >= 2 * (lag_words + 1) - 1
    short = map_batches(rows.filter(~long), at_once, result)
    named = rows.filter(long).withColumn("blob", F.sha2("text", 256))
    dealt = map_batches(named.dropDuplicates(["key", "blob"]), ranges, f"key {kind}, blob string, first bigint, last bigint, text binary")
    dealt = map_batches(dealt.repartition("key", "blob", "first"), in_range, f"key {kind}, blob string, runs {RUNS}")
    by_start = F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_list("runs"))), lambda r: F.struct(r["start"], r["period"], r["length"])))
    united = dealt.groupBy("key", "blob").agg(F.transform(by_start, lambda r: F.struct(r["start"], r["length"], r["period"])).cast(RUNS).alias("runs"))
    met = named.alias("n").join(united.alias("u"), F.col("n.blob").eqNullSafe(F.col("u.blob")) & F.col("n.key").eqNullSafe(F.col("u.key")), "left")
    none = F.array().cast(RUNS)
    whole = met.select("n.key", "n.text", F.coalesce("u.runs", none).alias("runs"))
    both = short.unionByName(map_batches(whole, put_together, result))
    return both.select(F.col("key").alias(key), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def greatest(runs: Column) -> Column:
    """The run of greatest exact length / period; of equals the one of smallest start, then period.
    Null without runs."""

    def better(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast(RUNS[6:-1]), better)


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the greatest run, and digests of all runs and of the collapsed text."""
    best = greatest(F.col("runs")).alias("best")
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    rows = found.select(key, F.size("runs").cast("long").alias("n_runs"), best, F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("best.length * 1000 div best.period")
    return rows.select(key, "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"), milli.cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
