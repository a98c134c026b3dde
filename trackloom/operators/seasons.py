"""A season's teams, match after match, in batch and as a stream.

Which team a side is depends on all matches before it, so a season is read in order; its state is the
roster, not its matches. A match that was added with the same content is passed over, so any batching
of a stream, and repeats, leave what one batch leaves.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.operators.contacts import greedy_pairs
from trackloom.session import cut, ship_package

BLUE, RED = 0, 1
#: One row a pilot of a match: the pilot's team, the team of the side, and the colour it is drawn in.
ROWS = "season string, match string, side int, pilot string, team int, side_team int, color int"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]


class Season:
    """Teams by number from 1, the team of each pilot, the colour of each team in a folder, and the
    digest of each match that was added."""

    def __init__(self, state: str | None = None):
        made = json.loads(state) if state else {"teams": 0, "pilots": {}, "colors": {}, "matches": {}}
        self.teams, self.pilots, self.colors, self.matches = made["teams"], made["pilots"], made["colors"], made["matches"]

    def dump(self) -> str:
        return json.dumps({"teams": self.teams, "pilots": self.pilots, "colors": self.colors, "matches": self.matches})

    def sides(self, sides: dict[str, int]) -> dict[int, int | None]:
        """Each side's team: the one most of its known pilots are on, of equals the lower. Where both
        sides name one team, the side with fewer of its pilots (of equals the second) takes its next best."""
        ranked = []
        for side in (BLUE, RED):
            votes = Counter(self.pilots[p] for p, s in sides.items() if s == side and p in self.pilots)
            ranked.append(sorted(votes.items(), key=lambda v: (-v[1], v[0])) + [(None, 0)] * 2)
        place = [0, 0]
        if ranked[BLUE][0][0] is not None and ranked[BLUE][0][0] == ranked[RED][0][0]:
            place[RED if ranked[BLUE][0][1] >= ranked[RED][0][1] else BLUE] = 1
        return {side: ranked[side][place[side]][0] for side in (BLUE, RED)}

    def add(self, match: dict) -> list[tuple]:
        """Adds a match (season, match, folder, sha, internal, sides: pairs of pilot and side); its
        rows, none if it is internal or was added with this content."""
        sides = dict(match["sides"] or [])
        if match["internal"] or self.matches.get(match["match"]) == match["sha"]:
            return []
        chosen = self.sides(sides)
        for side in (BLUE, RED):
            fresh = sorted(p for p, s in sides.items() if s == side and p not in self.pilots)
            if fresh and chosen[side] is None:  # a side without new pilots makes no team
                self.teams += 1
                chosen[side] = self.teams
            self.pilots |= dict.fromkeys(fresh, chosen[side])
        chosen = self.sides(sides)
        colors = self.colors.setdefault(match["folder"] or "", {})
        for side in (BLUE, RED):
            team, other = (str(chosen[s]) for s in (side, 1 - side))
            if chosen[side] is not None and team not in colors:
                colors[team] = 1 - colors[other] if other in colors else side
        drawn = {side: colors.get(str(chosen[side]), 1 - colors[str(chosen[1 - side])] if str(chosen[1 - side]) in colors else side) for side in (BLUE, RED)}
        if drawn[BLUE] == drawn[RED]:
            drawn = {BLUE: BLUE, RED: RED}
        self.matches[match["match"]] = match["sha"]
        return [(match["season"], match["match"], s, p, self.pilots[p], chosen[s], drawn[s]) for p, s in sorted(sides.items()) if s in drawn]


def matches_of(sides: DataFrame) -> DataFrame:
    """One row a match from rows (season, match, us, folder, internal, side, pilot)."""
    pilots = F.array_sort(F.collect_set(F.struct("pilot", "side")))
    rows = sides.groupBy("season", "match").agg(F.min("us").alias("us"), F.min("folder").alias("folder"), F.max("internal").alias("internal"), pilots.alias("sides"))
    return rows.select("season", "match", "us", "folder", "internal", F.map_from_entries("sides").alias("sides"), F.sha2(F.to_json("sides"), 256).alias("sha"))


def teams(matches: DataFrame) -> DataFrame:
    """ROWS of all matches (as from matches_of), added in the order of us, then name."""
    ship_package(matches.sparkSession)
    types = pa.schema([(n, pa.int32() if n in ("side", "team", "side_team", "color") else pa.string()) for n in _NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, season = None, Season()
        for batch in batches:
            out: list[tuple] = []
            for match in batch.to_pylist():
                if match["season"] != name:
                    name, season = match["season"], Season()
                out += season.add(match)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(types)], schema=types)

    return matches.repartition("season").sortWithinPartitions("season", "us", "match").mapInArrow(run, ROWS)


def teams_stream(matches: DataFrame) -> DataFrame:
    """The same of a stream of matches, each micro-batch's in the order of us, then name."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        season = Season(state.get[0] if state.exists else None)
        rows = pd.concat(list(parts)).sort_values(["us", "match"])
        out = [r for match in rows.to_dict("records") for r in season.add(match)]
        state.update((season.dump(),))
        yield pd.DataFrame(out, columns=_NAMES)

    ship_package(matches.sparkSession)
    return matches.groupBy("season").applyInPandasWithState(fold, ROWS, "state string", "append", GroupStateTimeout.NoTimeout)


def roster(rows: DataFrame) -> DataFrame:
    """season, pilot, team: once on a team, pilots stay on it."""
    return rows.groupBy("season", "pilot").agg(F.min("team").alias("team"))


def rebuilt(old: DataFrame, names: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was set by hand in a season comes back after its matches were added anew.

    ``old`` (season, pilot, team, manual) and ``names`` (season, team, name; null: not named) are as
    before, ``new`` (season, pilot, team) as added anew. Old teams meet new ones by the pilots they
    share but for those put there by hand, the largest overlap first. Named teams hand on their
    name; pilots put on a team by hand go to what it became, a new team if it met none. Results:
    season, pilot, team, manual, and season, team, name."""
    shared = old.filter("NOT manual").select("season", "pilot", F.col("team").alias("old")).join(new.withColumnRenamed("team", "new"), ["season", "pilot"])
    met = greedy_pairs(shared.groupBy("season", "old", "new").agg(F.count(F.lit(1)).alias("n")), "season", "old", "new", "n").select("season", "old", "new")
    known = names.select("season", F.col("team").alias("old"), "name")
    lost = old.filter("manual").select("season", F.col("team").alias("old")).distinct().join(known.select("season", "old"), ["season", "old"], "left_semi").join(met, ["season", "old"], "left_anti")
    size = new.groupBy("season").agg(F.max("team").alias("top"))
    made = lost.join(size, "season", "left").select("season", "old", (F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("season").orderBy("old"))).cast("int").alias("new"))
    became = cut(met.unionByName(made))
    by_hand = old.filter("manual").select("season", "pilot", F.col("team").alias("old")).join(became, ["season", "old"]).select("season", "pilot", F.col("new").alias("hand"))
    pilots = new.join(by_hand, ["season", "pilot"], "full").select("season", "pilot", F.coalesce("hand", "team").alias("team"), F.col("hand").isNotNull().alias("manual"))
    called = became.join(known.filter("name IS NOT NULL"), ["season", "old"]).select("season", F.col("new").alias("team"), "name")
    teams_ = new.select("season", "team").union(made.select("season", "new")).distinct()
    return pilots, teams_.join(called, ["season", "team"], "left")
