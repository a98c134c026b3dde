"""Sources, streams, tracks and names on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import naming
from trackloom.operators import tracks
from trackloom.sources import files
from trackloom.streaming import counters

OBSERVERS = [(0.0, 0.0, 0.0), (500_000.0, 0.0, 0.0), (0.0, 500_000.0, 0.0)]


def readings(truth, speed, skip=()):
    rows = []
    for t, p in enumerate(truth):
        d = [float(round(np.linalg.norm(p - np.array(o)) / 1000) * 1000) for o in OBSERVERS]
        rows.append(("m", "p", float(t), d[0], d[1], None if t in skip else d[2], speed))
    return rows


READING = "match string, pilot string, t double, d_a double, d_b double, d_c double, speed double"


def test_moving_track_is_near_the_truth(spark):
    truth = [np.array([200_000 + 900.0 * t, 250_000 + 400.0 * t, 150_000 + 300.0 * t]) for t in range(80)]
    speed = float(np.linalg.norm([900, 400, 300]))
    got = tracks.solve_tracks(spark.createDataFrame(readings(truth, speed, {20, 21, 79}), READING), OBSERVERS, 500_000.0).orderBy("t").collect()
    assert [r.t for r in got] == list(range(79))  # a partial end is dropped
    off = [np.linalg.norm(np.array([r.x, r.y, r.z]) - truth[int(r.t)]) for r in got]
    assert max(off) < 1_500 and np.median([r.residual for r in got]) < 400


def test_parked_ship_stays_and_jump_restarts(spark):
    truth = [np.array([100_000.0, 120_000.0, 90_000.0])] * 20 + [np.array([200_000.0, 120_000.0, 90_000.0])] * 20
    got = tracks.solve_tracks(spark.createDataFrame(readings(truth, 0.0), READING), OBSERVERS, 500_000.0).orderBy("t").collect()
    x = np.array([[r.x, r.y, r.z] for r in got])
    assert len(x) == 40 and np.ptp(x[:20], 0).max() < 50 and np.ptp(x[20:], 0).max() < 50
    assert abs(x[25, 0] - 200_000) < 2_000 and abs(x[5, 0] - 100_000) < 2_000


def test_no_readings(spark):
    assert tracks.solve_tracks(spark.createDataFrame([], READING), OBSERVERS, 500_000.0).count() == 0


def test_positions_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("pilot, t ,ship_type,y_m,x_m,z_m,shield,armor,hull\nA,1.0,Frigate,2,1,3,0.5,,0.9\nB,0.5,Frigate,2,,3,1,1,1\nC,2,Frigate,2\n\"D, E\",0.1,Capsule,5,4,6,1,0.5,0.25\n")
    got = {r.pilot: r for r in files.read_positions(spark, str(tmp_path / "a.csv")).collect()}
    assert set(got) == {"A", "D, E"}
    assert (got["A"].x_m, got["A"].y_m, got["A"].shield, got["A"].hull) == (1.0, 2.0, None, None) and got["D, E"].hull == 0.25
    (tmp_path / "b.csv").write_text("t,pilot\n1,A\n")
    with pytest.raises(Exception, match="missing columns.*ship_type"):
        files.read_positions(spark, str(tmp_path / "b.csv")).collect()
    files.write_positions(spark.createDataFrame([(0.1234, "A", 1.6, None)], "t double, pilot string, x_m double, shield double"), str(tmp_path / "out"))
    lines = {x for f in (tmp_path / "out").glob("*.csv") for x in f.read_text().splitlines()}  # parts without rows have a header too
    assert lines == {"t,pilot,x_m,shield", "0.123,A,2,"}


def test_logs_and_rulesets(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.txt").write_text("  Listener: Ann\n  Session Started: 2024.01.31 20:00:00\n[ 2024.01.31 20:15:00 ] (combat) <b>120</b> from <i>Bob</i> - Gun - Hits\n[ 2024.01.31 20:15:01 ] (notify) no\n")
    (logs / "b.txt").write_text("[ 2024.01.31 20:15:00 ] (combat) 5 to Bob - Gun\n")
    (r,) = files.read_combat_logs(spark, str(logs)).collect()
    assert (r.listener, r.kind, r.amount, r.source, r.weapon, r.quality, r.at.second, r.started.hour) == ("Ann", "DAMAGE", 120.0, "Bob", "Gun", "Hits", 0, 20)
    chat = tmp_path / "chat.txt"
    chat.write_bytes("﻿Session started: 2024.01.31 20:00:00\n[ 2024.01.31 21:00:05 ] A > hi\n".encode("utf-16-le"))
    (c,) = files.read_chat_spans(spark, str(chat)).collect()
    assert (c.first_at.hour, c.last_at.hour, c.last_at.second) == (20, 21, 5)
    (tmp_path / "r.json").write_text('{"id": "x", "name": "X", "point_cap": 100, "inflation": {"cruiser": 2}, "default_inflation": 1, "ships": {"Moa": {"points": 9, "hull": "cruiser"}, "Rifter": {"points": 3, "hull": "frigate"}}}')
    assert sorted((r.ship, r.points, r.step) for r in files.read_rulesets(spark, str(tmp_path / "r.json")).collect()) == [("moa", 9, 2), ("rifter", 3, 1)]


def test_streams_equal_batches(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    counters.keep_counters(stream, ["user_id", "event_type"], str(tmp_path / "n"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(counters.counters(spark, str(tmp_path / "n"), ["user_id", "event_type"]).collect()) == sorted(e.groupBy("user_id", "event_type").count().collect())
    q = counters.windowed(stream, "user_id", "ts", "value").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("win").agg(F.sum("n")).first()[0] == e.count() and spark.table("win").count() == counters.windowed(e, "user_id", "ts", "value").count()
    q = counters.last_labels(stream, "user_id", "ts", "event_type").writeStream.format("memory").queryName("last").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.user_id: r.event_type for r in e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_type")).alias("event_type")).collect()}
    assert {r.user_id: r.label for r in spark.table("last").collect()} == want


def test_names(spark):
    r = spark.sql("SELECT 'a/m.logs/x.txt' AS a, 'a/.hidden' AS b, 'a/../b' AS c, 'Halvard Sol  Nox' AS d, 'v1.10.2' AS e")
    r = r.select(naming.match_key(F.col("a")), naming.match_key(F.col("b")), naming.valid_path(F.col("a")), naming.valid_path(F.col("c")), naming.short_name(F.col("d")), naming.version_key(F.col("e"))).first()
    assert tuple(r) == ("a/m", "a/.hidden", True, False, "Halvard S. N.", [1, 10, 2])
