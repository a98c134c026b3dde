"""A season's teams: the rules on small matches, a plain version, streams in any batching, rebuilding."""

import json

import pytest

import __spark_entry__ as entry
from trackloom.operators import seasons, teams

MATCH = "season string, match string, us long, folder string, internal boolean, sides map<string,int>, sha string"


def match(season, name, us, blue, red, folder="", internal=False, sha=None):
    sides = dict.fromkeys(blue, 0) | dict.fromkeys(red, 1)
    return (season, name, us, folder, internal, sides, sha or json.dumps(sorted(sides.items())))


def test_sides_that_pick_one_team():
    s = seasons.Season()
    s.pilots = {"a1": 1, "a2": 1, "a3": 1, "b1": 2}
    assert s.sides({"a1": 0, "a2": 0, "a3": 1, "b1": 1}) == {0: 1, 1: 2}  # fewer of the first on red: its next best
    assert s.sides({"a1": 0, "a2": 0, "a3": 1}) == {0: 1, 1: None}
    assert s.sides({"a1": 1, "a2": 1, "a3": 0, "x": 0}) == {0: None, 1: 1}
    assert s.sides({}) == {0: None, 1: None}


def test_votes_equal_the_rule(spark):
    rows = [("m", side, s) for side, picks in ((0, "1112"), (1, "1133")) for s in picks] + [("n", 0, "2"), ("n", 1, "2"), ("o", 1, None)]
    got = teams.sides(spark.createDataFrame(rows, "match string, side int, team string"), "match", "side", "team")
    assert sorted(map(tuple, got.collect())) == [("m", 0, "1", 3), ("m", 1, "3", 2), ("n", 0, "2", 1), ("n", 1, None, None)]


def test_rules_on_small_matches(spark):
    rows = [
        match("s", "m1", 1, "abc", "def"),
        match("s", "m2", 2, "abx", "cyz"),  # both sides know the first team
        match("s", "m3", 3, "yz", "dx"),
        match("s", "m4", 4, "ab", "c"),  # red knows the first team only and has no new pilot: no new team
        match("s", "m5", 5, "q", "r", internal=True),
        match("s", "m1", 6, "abc", "def"),  # the same content again
        match("t", "m1", 1, "a", "z"),  # another season
        match("s", "m6", 7, "de", "ab", folder="f"),
    ]
    got = {}
    for r in seasons.teams(spark.createDataFrame(rows, MATCH)).collect():
        got.setdefault((r.season, r.match), {})[r.side] = (r.side_team, r.color)
    assert got == {
        ("s", "m1"): {0: (1, 0), 1: (2, 1)},
        ("s", "m2"): {0: (1, 0), 1: (3, 1)},
        ("s", "m3"): {0: (3, 1), 1: (1, 0)},
        ("s", "m4"): {0: (1, 0), 1: (None, 1)},
        ("t", "m1"): {0: (1, 0), 1: (2, 1)},
        ("s", "m6"): {0: (2, 0), 1: (1, 1)},  # another folder has its own colours
    }


def plain(rows):
    """Rosters from the rules in words."""
    team, seen, made = {}, {}, {}
    for season, name, _, _, internal, sides, sha in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if internal or seen.get((season, name)) == sha:
            continue
        seen[season, name] = sha
        lists = []
        for side in (0, 1):
            own = [team[season, p] for p, s in sides.items() if s == side and (season, p) in team]
            lists.append(sorted(set(own), key=lambda t: (-own.count(t), t)))
            lists[-1] = [(t, own.count(t)) for t in lists[-1]]
        pick = [x[0][0] if x else None for x in lists]
        if pick[0] is not None and pick[0] == pick[1]:
            loser = 1 if lists[0][0][1] >= lists[1][0][1] else 0
            pick[loser] = lists[loser][1][0] if len(lists[loser]) > 1 else None
        for side in (0, 1):
            for p in [p for p, s in sides.items() if s == side and (season, p) not in team]:
                if pick[side] is None:
                    pick[side] = made[season] = made.get(season, 0) + 1
                team[season, p] = pick[side]
    return team


@pytest.fixture(scope="module")
def fixture_rows(spark):
    from trackloom.plans import roster_queries

    frame = seasons.matches_of(roster_queries._sides(spark, "/root/testdata/sf0.001")).select("season", "match", "us", "folder", "internal", "sides", "sha")
    return [tuple(r) for r in frame.collect()]


def test_query_equals_plain_version(spark, sf, fixture_rows):
    got = {(r.season, r.pilot): r.team for r in seasons.roster(entry.queries()["season_teams"](spark, sf)).collect()}
    assert got == plain(fixture_rows) and len(set(got.values())) > 2


@pytest.mark.parametrize("batches", [1, 3])
def test_any_batching_of_a_stream_is_one_batch(spark, tmp_path, fixture_rows, batches):
    rows = sorted(fixture_rows, key=lambda r: (r[2], r[1]))[:60]
    size = -(-len(rows) // batches)
    for i in range(batches):
        part = rows[i * size : (i + 1) * size] + rows[: 5 * (i > 0)]  # some come again
        spark.createDataFrame(part, MATCH).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        query = seasons.teams_stream(spark.readStream.schema(MATCH).parquet(f"file://{tmp_path}/in")).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()  # each start takes the state up again
    got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect()), key=str)
    assert got == sorted(map(tuple, seasons.teams(spark.createDataFrame(rows, MATCH)).collect()), key=str)


def test_rebuild_keeps_names_and_hands(spark):
    old = [("s", p, 1, False) for p in "abc"] + [("s", p, 2, False) for p in "def"] + [("s", "x", 2, True), ("s", "y", 3, True), ("s", "z", 9, True)]
    names = [("s", 1, None), ("s", 2, "Bravo"), ("s", 3, "Gone")]
    new = [("s", p, 2) for p in "abcd"] + [("s", p, 1) for p in "efxy"] + [("u", "a", 1)]
    pilots, named = seasons.rebuilt(spark.createDataFrame(old, "season string, pilot string, team int, manual boolean"), spark.createDataFrame(names, "season string, team int, name string"), spark.createDataFrame(new, "season string, pilot string, team int"))
    got = {(r.season, r.pilot): (r.team, r.manual) for r in pilots.collect()}
    # teams 1 and 2 become 2 and 1; the third met none and is made anew; z's team was unknown
    assert got == {("s", p): (2, False) for p in "abcd"} | {("s", p): (1, False) for p in "ef"} | {("s", "x"): (1, True), ("s", "y"): (3, True), ("u", "a"): (1, False)}
    assert {(r.season, r.team): r.name for r in named.collect()} == {("s", 1): "Bravo", ("s", 2): None, ("s", 3): "Gone", ("u", 1): None}
