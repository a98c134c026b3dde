"""Scores of matches from the values of lost ships."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators import windows


def running(losses: DataFrame, match: str, time: str, team: str, value: str, head: int = 0) -> DataFrame:
    """``losses`` with score_0 and score_1: each team's head start and the values that the other
    team has lost up to the row's time, rows of the same time included."""
    lost = {f"score_{t}": F.sum(F.when(F.col(team) == 1 - t, F.col(value))) for t in (0, 1)}
    at = losses.groupBy(match, time).agg(*[c.alias(f"__{n}") for n, c in lost.items()])
    so_far = windows.carried(at, [match], time, [], {n: ("sum", F.col(f"__{n}")) for n in lost})
    scores = [(F.coalesce(n, F.lit(0)) + head).alias(n) for n in lost]
    return losses.join(so_far.select(match, time, *scores), [match, time], "left")
