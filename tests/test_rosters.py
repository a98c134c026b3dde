"""Rosters, seasons and recovered names against plain versions on small inputs."""

import numpy as np

from trackloom.operators import contacts, rosters


def edits(a: str, b: str) -> int:
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
    return d[-1]


def names(seed: int, n: int) -> list[str]:
    r = np.random.default_rng(seed)
    base = ["Halvard", "Kelto", "Wenna Torb", "Narrow", "sorrel17", "Ivo"]
    out = []
    for _ in range(n):
        s = list(base[r.integers(len(base))])
        for _ in range(r.integers(0, 3)):
            s[r.integers(len(s))] = "abcxyz"[r.integers(6)]
        out.append("".join(s))
    return out


def test_clusters_equal_the_plain_fold(spark):
    rows = [(g, n, t) for g in ("A", "B") for t, n in enumerate(names(len(g) + ord(g), 60))]
    got = {(r.g, r.name): r.leader for r in rosters.cluster_names(spark.createDataFrame(rows, "g string, name string, t long"), ["g"], "name", "t").collect()}
    want = {}
    for g in ("A", "B"):
        leaders: list[str] = []
        for _, n, _ in sorted((r for r in rows if r[0] == g), key=lambda r: r[2]):
            if (g, n) in want:
                continue
            near = min(((edits(n, x), i) for i, x in enumerate(leaders) if edits(n, x) <= 1), default=None)
            want[g, n] = leaders[near[1]] if near else n
            if not near:
                leaders.append(n)
    assert got == want


def test_rosters_merge_as_the_plain_fold(spark):
    rows = sorted({(m, i % 3, n): (m, i % 3, n, 1 + i % 7, i % 4 > 0) for m in ("m", "k") for i, n in enumerate([*names(5 + len(m), 90), "Ivo", "Iva", "Ix", "abcde", "abcdeff"])}.values())
    frame = spark.createDataFrame(rows, "m string, o int, name string, n long, f boolean")
    got = {(r.m, r.o, r.name): r.pilot for r in rosters.merge_rosters(frame, "m", "o", "name", "n", "f").collect()}
    want, pilots = {}, {"m": [], "k": []}
    for m, o, n, _, may in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        near = min(((edits(n, p), i) for i, p in enumerate(pilots[m]) if edits(n, p) <= (2 if len(p) >= 6 else 1)), default=None)
        want[m, o, n] = pilots[m][near[1]] if near else n if may else None
        if not near and may:
            pilots[m].append(n)
    assert got == want and len(set(want.values())) > 5


def test_founders_have_a_name_and_enough_distances(spark):
    rows = spark.createDataFrame([("abc", 3, 70, False), ("abc", 2, 70, False), ("ab", 9, 70, False), ("abc", 9, 70, True), ("abc", 3, 10, False), ("abc", 4, 100, False)], "name string, n long, frames int, hull boolean")
    assert [r[0] for r in rows.select(rosters.founds(rows.name, rows.n, rows.frames, rows.hull)).collect()] == [True, False, False, False, True, False]


def test_greedy_pairs_take_the_heaviest_first(spark):
    rows = [("s", 1, 10, 5), ("s", 1, 11, 7), ("s", 2, 11, 6), ("s", 2, 10, 4), ("s", 3, 10, 4), ("t", 1, 10, 1)]
    got = contacts.greedy_pairs(spark.createDataFrame(rows, "season string, old long, new long, n long"), "season", "old", "new", "n").collect()
    assert sorted(map(tuple, got)) == [("s", 1, 11, 7), ("s", 2, 10, 4), ("t", 1, 10, 1)]


def test_hidden_names_come_back_between_anchors(spark):
    expected = spark.createDataFrame([(i, p, "Hulk" if i % 2 else "Orca") for i, p in enumerate("abcdef")], "rank int, pilot string, kind string")
    frames = [(1, 0, "a", "Orca"), (1, 1, None, None), (1, 2, None, "Orca"), (1, 3, "d", "Hulk"), (1, 4, None, "Hulk")]
    frames += [(2, 0, "a", "Orca"), (2, 1, None, "Orca"), (2, 2, "c", "Orca")]  # the type disagrees
    frames += [(3, 0, "c", "Orca"), (3, 1, None, None), (3, 2, "a", "Orca")]  # out of order
    frames += [(4, 0, "a", "Orca"), (4, 1, None, None), (4, 2, "d", "Hulk")]  # one row for two
    rows = spark.createDataFrame(frames, "frame int, slot int, pilot string, kind string")
    assert sorted(map(tuple, rosters.recovered(rows, expected, "frame", "slot", "pilot", "kind").collect())) == [(1, 1, "b"), (1, 2, "c")]
