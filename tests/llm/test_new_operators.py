"""The conversation trie, periodic runs and exact search against plain versions and SQL."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import compare
import numpy as np
import pytest

from trackloom.llm import conversation_trie, exact_search, periodic_runs, queries

# conversation trie


def plain_trie(rows):
    """The contract in words, over (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), parent, len(cs), children[p], sum(children[q] == 0 for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, b"x", 1, "z") for r in rows], "conv_id long, turn long, role string, text string, node binary, family int, ends string")
    return sorted(tuple(r) for r in conversation_trie.prefix_trie(df).select(COLUMNS).collect())


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_plain_version(spark, seed, monkeypatch):
    monkeypatch.setattr(conversation_trie, "FREQUENT", (1000, 3, 1)[seed])
    monkeypatch.setattr(conversation_trie, "FAMILIES", (1024, 1, 2)[seed])
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 45), *r.sample(range(60, 400), 20), -3, -20, -25, 2**40 + 7]:
        for turn in range(r.choice((1, 1, 2, 3, 5))):
            rows.append((c, turn, r.choice(("user", "assistant")), r.choice(("hi", "hi there", "a b\x0bc d", ""))))
    rows += [(3, None, None, None), (3, None, "user", "x" * 70_000 + " y"), (3, 1, "user", "tie"), (4, 0, "user", "hi"), (4, 0, "user", "hi"), (None, 0, "user", "hi")]
    rows += [(20, t, "user", "hi") for t in range(900)]  # a conversation with most of the rows
    r.shuffle(rows)
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_turnless_and_empty(spark):
    alone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(alone, 0, "user", "one"), (alone, 1, "user", "two")]
    assert trie_rows(spark, rows) == plain_trie(rows) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    assert trie_rows(spark, rows[:0]) == []


# periodic runs


def plain_runs(words):
    """Every maximal stretch of each smallest period, from the definition."""
    n, out = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i : i + length]
            if length >= max(6, 4 * q) and not any(all(stretch[k] == stretch[k + p] for k in range(length - p)) for p in range(1, q)):
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_digests(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None:
        words = queries.repeated(doc_id, words)
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *shown, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def odd_texts():
    r = random.Random(5)
    texts = [None, "", " \t\n", "x", "a " * 5, "a " * 6, "a a " * 300, "ab " * 40 + "c " * 7 + "ab " * 40]
    for k in range(120):
        words = [r.choice("abcdefgh"[: r.choice((1, 2, 3, 8))]) for _ in range(r.randrange(1, 60))]
        for _ in range(r.randrange(3)):
            block = [r.choice("abcdefghij") for _ in range(r.choice((1, 2, 3, 7, 18, 25, 40)))]
            words += (block * r.randrange(2, 8))[: r.randrange(1, 200)]
        words += [f"w{i}" for i in range(r.randrange(30))]
        texts.append(r.choice((" ", "\n", " \x0b\x0c\r\t")).join(words))
    return texts


@pytest.mark.parametrize("lag_words", [1 << 14, 20])
def test_runs_equal_plain_version(spark, lag_words):
    rows = [(i if i % 11 else None, t, "x", 1) for i, t in enumerate(odd_texts())]
    rows += [rows[20], rows[20], (None, *rows[30][1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, blob int").repartition(3)
    got = periodic_runs.digests(periodic_runs.periodic_runs(df, rewrite=lambda k, w: w if k is None else queries.repeated(k, w), lag_words=lag_words))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(names).collect()), key=key) == sorted((plain_digests(*r[:2]) for r in rows), key=key)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_ranges_of_lags_find_what_one_range_finds():
    r = np.random.default_rng(3)
    ids = r.integers(0, 3, 6000).astype(np.int32)
    ids[1000:3000] = np.tile(r.integers(0, 50, 250), 8)
    ids[3500:5500] = np.tile(r.integers(0, 9, 97), 21)[:2000]
    ids[5500:5900] = 1
    whole = periodic_runs.runs_between(ids, 1, len(ids))
    for size in (100, 700, 3000):
        bounds = periodic_runs.lag_ranges(len(ids), size)
        parts = {x for a, b in zip(bounds[:-1], bounds[1:]) for x in periodic_runs.runs_between(ids, a, b)}
        assert sorted(parts, key=lambda x: (x[0], x[2])) == whole
    plain = set()  # whole arrays at every lag, the smallest period of each stretch first
    for lag in range(1, len(ids) // 4 + 1):
        same = np.concatenate([[False], ids[lag:] == ids[:-lag], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), (edge[1::2] + lag).tolist()):
            if e - s >= max(6, 4 * lag) and not any((s, e - s) == x[:2] for x in plain):
                plain.add((s, e - s, lag))
    assert set(whole) == plain and any(p > 200 for _, _, p in whole)


def test_one_word_repeated_takes_no_square(spark):
    found = periodic_runs.runs_between(np.zeros(200_000, np.int32), 1, 200_000)
    assert found == [(0, 200_000, 1)]


# exact search


def plain_top(rows, scale, each, k):
    usable = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if i % each == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), j) for j, c in usable if j != i)
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def top(spark, rows, k):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, block int, g string").repartition(5)
    v = exact_search.quantised(df, 64)
    return sorted(tuple(r) for r in exact_search.top_k(v.filter("vec_id % 20 = 0"), v, k).collect())


@pytest.mark.parametrize("size", [1.0, 400.0, 1e6, 1e12])
def test_search_equals_plain_version(spark, size, monkeypatch):
    monkeypatch.setattr(exact_search, "QUERY_CELLS", 200)
    monkeypatch.setattr(exact_search, "CANDIDATE_CELLS", 3000)
    monkeypatch.setattr(exact_search, "AT_ONCE", 32)
    r = np.random.default_rng(7)
    rows = [(int(i), [float(np.float32(x)) for x in r.standard_normal(40) * size]) for i in r.permutation(400)]
    rows += [(i, rows[3][1]) for i in range(400, 440)]  # ties, among them queries
    rows += [(None, rows[0][1]), (500, None), (520, [1.0, None]), (540, [float("nan")] * 40), (560, [float("inf"), 1.0]), (580, []), (600, [size] * 3), (7, rows[5][1])]
    assert top(spark, rows, 20) == plain_top(rows, 64, 20, 20)


def test_search_edges(spark):
    rows = [(0, [1.0, 2.0]), (20, [0.5, -1.0]), (5, [0.0, 0.0])]
    assert top(spark, rows, 20) == plain_top(rows, 64, 20, 20)  # fewer candidates than k
    assert top(spark, rows[:1], 20) == [] and top(spark, rows[:0], 20) == []


def test_bounds_drop_candidates():
    r = np.random.default_rng(1)
    block = lambda v: exact_search.Block(np.arange(v.shape[1], dtype=np.int64).tobytes(), v.shape[1], v.shape[0], v.astype(np.int64).tobytes(), v.shape[0])
    q, c = block(r.integers(-64, 64, (64, 8))), block(r.integers(-64, 64, (64, 6000)))
    best, added = exact_search.Best(8, 20), []
    keep = best.add
    best.add = lambda *a: (added.append(len(a[0])), keep(*a))[1]
    exact_search.meet(q, c, best)
    assert len(best.query) == 160 and sum(added[1:]) < 0.1 * 8 * 5000


def test_queries_equal_sql_at_a_larger_scale(spark):
    sf = "/root/testdata/sf0.01"
    for name in ("op11_conversation_prefix_trie", "op13_exact_top_k"):
        assert compare.spark_rows(queries.queries()[name](spark, sf)) == compare.duck_rows(compare.connection(sf), queries.oracle_sql()[name])
