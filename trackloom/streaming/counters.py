"""Structured Streaming forms of the windows, sessions, counters and label caches.

All of them take a batch table as well, which gives the same result at the stream's end. Times are
event times; rows later than the watermark are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late a row may be.
LATE = "10 minutes"


def watermarked(rows: DataFrame, time: str, late: str) -> DataFrame:
    return rows.withWatermark(time, late) if rows.isStreaming else rows


def windowed(rows: DataFrame, key: str, time: str, value: str, width: str = "6 hours", slide: str | None = None, late: str = LATE) -> DataFrame:
    """Count and sum of each key in tumbling (or, with ``slide``, sliding) windows: t0, t1, n, total."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = watermarked(rows, time, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return g.select(key, F.col("w.start").alias("t0"), F.col("w.end").alias("t1"), "n", "total")


def sessions(rows: DataFrame, key: str, time: str, pause: str = "12 hours", late: str = LATE) -> DataFrame:
    """Runs of a key's rows whose gaps are under ``pause``: t0, t1 (the last row's time and the pause), n."""
    g = watermarked(rows, time, late).groupBy(key, F.session_window(time, pause).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("t0"), F.col("w.end").alias("t1"), "n")


def keep_counters(rows: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Counts by ``keys``, batch by batch, under ``path``. A batch overwrites its own folder, so a
    repeated batch changes nothing; ``counters`` adds the batches up."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("n").alias("n"))


def last_labels(rows: DataFrame, key: str, time: str, label: str, timeout_ms: int = 3_600_000, late: str = LATE) -> DataFrame:
    """A stream's latest label of each key, kept over blanks: one row a key and batch with key,
    at (microseconds), label. A key's state ends ``timeout_ms`` of event time after its last row."""

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, last = state.get if state.exists else (None, None)
        for p in parts:
            known = p[p[label].notna()]
            if len(known):
                top = known.sort_values([time, label]).iloc[-1]
                us = top[time].value // 1000
                if at is None or us >= at:
                    at, last = us, top[label]
        if at is not None:
            state.update((at, last))
            state.setTimeoutTimestamp(max(at // 1000, state.getCurrentWatermarkMs()) + timeout_ms)
            yield pd.DataFrame({key: [k[0]], "at": [at], "label": [last]})

    kind = rows.schema[key].dataType.simpleString()
    grouped = rows.select(key, time, label).withWatermark(time, late).groupBy(key)
    return grouped.applyInPandasWithState(fold, f"{key} {kind}, at long, label string", "at long, label string", "update", GroupStateTimeout.EventTimeTimeout)
