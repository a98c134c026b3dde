"""Stretches, sides and places of tracks against plain loops and known truth."""

import numpy as np
import pytest

from trackloom.operators import tracks, windows

OBSERVERS = [(0.0, 0.0, 0.0), (500_000.0, 0.0, 0.0), (0.0, 500_000.0, 0.0)]
SIDE = 500_000.0
READING = "match string, pilot string, t double, d_a double, d_b double, d_c double, speed double"


def ranges(p):
    return [float(round(np.linalg.norm(np.asarray(p) - np.array(o)) / 1000) * 1000) for o in OBSERVERS]


def slope(t, h):
    t = np.array(t) - np.mean(t)
    return float(t @ np.array(h) / (t @ t)) if len(t) > 1 and t @ t > 0 else 0.0


def plain_sides(rows):
    """Sign of each whole reading of one track (t, d_a, d_b, d_c, speed), in order; stretches first."""
    stretch, last, of = 0, [None] * 3, []
    for t, *d, speed in rows:
        pace = lambda v: tracks.UNKNOWN_SPEED if v is None else v
        jump = any(x is not None and q is not None and abs(x - q[1]) > tracks.JUMP + max(pace(speed), pace(q[2])) * (t - q[0]) for x, q in zip(d, last))
        stretch += jump
        last = [q if x is None else (t, x, speed) for x, q in zip(d, last)]
        of.append(stretch)
    whole = [i for i, r in enumerate(rows) if None not in r[1:4]]
    out, end, sign = {}, None, None
    for s in sorted(set(of)):
        part = [i for i in whole if of[i] == s]
        if not part:
            continue
        foot, height = {}, {}
        for i in part:
            a, b, c = rows[i][1:4]
            x, y = (a * a - b * b + SIDE**2) / (2 * SIDE), (a * a - c * c + SIDE**2) / (2 * SIDE)
            foot[i], height[i] = (x, y), np.sqrt(max(a * a - x * x - y * y, 0.0))
        noise = lambda i: tracks.RANGE * max(rows[i][1:4])
        clear = [i for i in part if height[i] ** 2 > tracks.CLEAR * noise(i)]
        runs, met = [], True
        for k, i in enumerate(part):
            crossed = k and height[i] + height[part[k - 1]] <= tracks.UNKNOWN_SPEED * (rows[i][0] - rows[part[k - 1]][0])
            met = met or crossed or height[i] ** 2 < tracks.AT_PLANE * noise(i)
            if i in clear:
                if met:
                    runs.append([])
                runs[-1].append(i)
                met = False
        climb = lambda at: slope([rows[i][0] for i in at], [height[i] for i in at]) if at else 0.0
        place = lambda i, g: np.array([*foot[i], g * height[i]])
        w = climb(runs[0][: tracks.AHEAD]) if runs else 0.0
        if end is None:
            rank = lambda g: (np.linalg.norm(np.maximum(np.maximum(-place(part[0], g), place(part[0], g) - SIDE), 0)), np.linalg.norm(place(part[0], g) - SIDE / 2))
            sign = -1 if rank(-1) < rank(1) else 1
        else:
            p, v, was = end
            near, far = np.linalg.norm(place(part[0], 1) - p), np.linalg.norm(place(part[0], -1) - p)
            if abs(near - far) > tracks.NEARER:
                sign = 1 if near <= far else -1
            else:
                sign = was * (-1 if abs(w + v) < abs(w - v) else 1)
        signs = {0: sign}
        for k in range(1, len(runs)):
            one, two = runs[k - 1], runs[k]
            v, w = climb(one[-tracks.AHEAD :]), climb(two[: tracks.AHEAD])
            dt = max(rows[two[0]][0] - rows[one[-1]][0], 1e-3)
            bend = [((g * height[two[0]] - height[one[-1]]) / dt - v) ** 2 + (g * w - (g * height[two[0]] - height[one[-1]]) / dt) ** 2 for g in (1, -1)]
            sign = -sign if bend[1] <= bend[0] else sign
            signs[k] = sign
        run = 0
        for i in part:
            run = next((k for k, r in enumerate(runs) if i == r[0]), run)
            out[i] = (s, signs[run])
        end = (place(part[-1], sign), climb(runs[-1][-tracks.AHEAD :]) if runs else 0.0, sign)
    return out


def wandering(r):
    """A track that crosses the plane, turns near it and jumps; some ranges and speeds unread."""
    p, v, rows = r.uniform(100_000, 300_000, 3) * (1, 1, 0.4), r.normal(0, 1500, 3), []
    for t in range(150):
        if r.random() < 0.03:
            p = p + r.normal(0, 60_000, 3)
        if r.random() < 0.05:
            v = r.normal(0, 2500, 3)
        p = p + v
        p = np.clip(p, (-100_000, -100_000, -120_000), 500_000)
        d = [None if r.random() < 0.03 else x for x in ranges(p)]
        rows.append((float(t), *d, float(np.linalg.norm(v)) if r.random() < 0.6 else None))
    return rows


def test_sides_equal_a_plain_loop(spark):
    r = np.random.default_rng(5)
    made = {str(k): wandering(r) for k in range(20)}
    df = spark.createDataFrame([("m", k, *row) for k, rows in made.items() for row in rows], READING).repartition(7)
    got = {(x.pilot, int(x.t)): (x.stretch, int(x.sign)) for x in tracks.placed(df, OBSERVERS, SIDE).filter("whole").collect()}
    want = {(k, i): v for k, rows in made.items() for i, v in plain_sides(rows).items()}
    assert got == want and len({v for _, v in want.values()}) == 2 and max(s for s, _ in want.values()) > 3


def solve(spark, rows, schema=READING):
    return tracks.solve_tracks(spark.createDataFrame(rows, schema), OBSERVERS, SIDE)


def test_passage_and_turn_are_told_apart(spark):
    through = [(250_000 + 500.0 * t, 200_000.0, 150_000 - 2_000.0 * t) for t in range(150)]
    back = [(250_000 + 500.0 * t, 200_000.0, 45_000 + abs(150_000 - 2_000.0 * t)) for t in range(150)]
    rows = [("m", name, float(t), *ranges(p), None) for name, truth in (("through", through), ("back", back)) for t, p in enumerate(truth)]
    got = solve(spark, rows).collect()
    truth = {"through": through, "back": back}
    assert len(got) == 300
    for r in got:
        p = np.array(truth[r.pilot][int(r.t)])
        if abs(p[2]) > 45_000:
            assert np.linalg.norm(np.array([r.x, r.y, r.z]) - p) < 3_000, (r.pilot, r.t, p, r)


def test_chunks_equal_the_whole(spark, monkeypatch):
    r, p, v, rows = np.random.default_rng(8), np.array([200_000.0, 250_000.0, 150_000.0]), np.array([900.0, -300.0, 200.0]), []
    for t in range(900):
        v = v + r.normal(0, 60, 3) - (p - 200_000) * 1e-5
        p = p + v
        d = [x if r.random() > 0.05 else None for x in ranges(p)] if 0 < t < 899 else ranges(p)
        rows.append(("m", "p", float(t), *d, float(np.linalg.norm(v))))
    some = {x.t: (x.x, x.y, x.z, x.residual) for x in solve(spark, rows).collect()}
    monkeypatch.setattr(tracks, "CHUNK", 1 << 20)
    whole = {x.t: (x.x, x.y, x.z, x.residual) for x in solve(spark, rows).collect()}
    assert some.keys() == whole.keys() and len(some) == 900
    assert max(abs(a - b) for t in whole for a, b in zip(some[t], whole[t])) < 1.0


def test_nulls_ties_copies_and_extra_columns(spark):
    d = ranges((200_000.0, 250_000.0, 150_000.0))
    rows = [(None, "p", float(t), *d, 0.0, "x", 1) for t in range(6)] + [("m", None, 1.0, *d, 0.0, None, 2)] * 3
    rows += [("m", "q", None, *d, 0.0, "x", 3), ("m", "q", 2.0, None, None, None, None, "x", 4), ("m", "r", 1.0, float("nan"), d[1], d[2], 0.0, "x", 5), ("m", "s", 1.0, *d, None, "x", 6)]
    got = solve(spark, rows, READING + ", stretch string, own int").collect()
    found = [(r.match, r.pilot) for r in got]
    assert sorted(found, key=str) == sorted([(None, "p")] * 6 + [("m", None)] * 3 + [("m", "s")], key=str)
    for r in got:
        assert np.linalg.norm(np.array([r.x, r.y, r.z]) - (200_000, 250_000, 150_000)) < 3_000 and r.residual == pytest.approx(0, abs=900)


def test_short_tracks_are_dealt_once(spark, monkeypatch):
    """Short tracks keep nothing in between, and their tasks grow with the rows (F9, F12)."""
    r = np.random.default_rng(7)
    made = [("m", str(k), *row) for k in range(6) for row in wandering(r)]
    df = spark.createDataFrame(made, READING)
    want = sorted(map(tuple, tracks.placed(df, OBSERVERS, SIDE).select("pilot", "t", "sign").collect()))
    monkeypatch.setattr(tracks, "cut", None)
    monkeypatch.setattr(windows, "TASK_ROWS", 10)
    found = tracks.placed(df, OBSERVERS, SIDE)
    assert sorted(map(tuple, found.select("pilot", "t", "sign").collect())) == want
    assert found.rdd.getNumPartitions() >= len(made) / 10
    assert tracks.solve_tracks(df, OBSERVERS, SIDE).rdd.getNumPartitions() >= len(made) / 10


def test_long_tracks_beside_short_ones(spark, monkeypatch):
    """Tracks above the limit run in buckets and give what a plain loop and whole runs give."""
    r = np.random.default_rng(5)
    made = {str(k): wandering(r)[: 150 if k % 2 else 60] for k in range(8)}
    df = spark.createDataFrame([("m", k, *row) for k, rows in made.items() for row in rows], READING)
    solved = lambda: {(x.pilot, x.t): (x.x, x.y, x.z) for x in tracks.solve_tracks(df, OBSERVERS, SIDE).collect()}
    whole = solved()
    monkeypatch.setattr(windows, "RANKS", 100)
    assert [alone for _, alone in tracks._parts(df)[0]] == [True, False]
    got = {(x.pilot, int(x.t)): (x.stretch, int(x.sign)) for x in tracks.placed(df, OBSERVERS, SIDE).filter("whole").collect()}
    assert got == {(k, i): v for k, rows in made.items() for i, v in plain_sides(rows).items()}
    parted = solved()
    assert parted.keys() == whole.keys() and max(abs(a - b) for k in whole for a, b in zip(whole[k], parted[k])) < 1e-3
