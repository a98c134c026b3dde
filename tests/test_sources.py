"""Side files, catalogues, folders and trimmed logs on small inputs."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from trackloom.sources import library


def test_sidecars_and_seasons(spark, tmp_path):
    side = {"teams": {"Ann": 0, "Bo": 1}, "team_names": {"0": "Reds"}, "log_pilots": {"a.txt": "Ann"}, "ruleset": "r1", "internal": True}
    (tmp_path / "m.json").write_text(json.dumps(side))
    (tmp_path / "bad.json").write_text("no json")
    rows = library.read_sidecars(spark, str(tmp_path)).drop("file")
    assert sorted(map(tuple, rows.collect())) == [("Ann", 0, "Reds", "a.txt", "r1", True), ("Bo", 1, None, None, "r1", True)]
    library.write_sidecars(library.read_sidecars(spark, str(tmp_path)), str(tmp_path / "out"))
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("*.csv"))
    assert '"teams":{"Ann":0,"Bo":1}' in text
    season = {"version": 3, "build": "b", "teams": {"1": {"name": "Reds"}, "2": {"name": "T2", "temp": True}}, "pilots": {"Ann": "1"}, "manual": {"Ann": True}, "matches": {"x.csv": "ab"}, "colors": {}}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "db.json").write_text(json.dumps(season))
    teams, pilots, matches = library.read_seasons(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, teams.drop("file").collect())) == [(3, 1, "Reds", False), (3, 2, "T2", True)]
    assert [tuple(r) for r in pilots.drop("file").collect()] == [("Ann", 1, True)] and matches.first().sha == "ab"


def test_scenes_catalogue_gallery_names(spark, tmp_path):
    (tmp_path / "scene.json").write_text(json.dumps({"panels": [{"name": "left", "rect": {"x": 1, "y": 2, "w": 3, "h": 4}}], "targets": []}))
    assert tuple(library.read_scenes(spark, str(tmp_path / "scene.json")).drop("file").first()) == ("left", 1, 2, 3, 4, 1.0)
    (tmp_path / "groups.jsonl").write_text('{"_key": 25, "categoryID": 6}\n{"_key": 30, "categoryID": 7}\n')
    (tmp_path / "types.jsonl").write_text('{"_key": 1, "groupID": 25, "published": true, "radius": 40.5, "name": {"en": "Hulk"}}\n{"_key": 2, "groupID": 30, "published": true, "name": {"en": "Gun"}}\n{"_key": 3, "groupID": 25, "published": false, "name": {"en": "Old"}}\n')
    assert [tuple(r) for r in library.read_catalogue(spark, str(tmp_path / "groups.jsonl"), str(tmp_path / "types.jsonl")).collect()] == [("hulk", 1, 25, 40.5)]
    (tmp_path / "index.json").write_text(json.dumps([{"name": "barges", "models": [{"name": "hulk", "file": "h.glb"}]}]))
    assert tuple(library.read_gallery(spark, str(tmp_path / "index.json")).first()) == ("barges", "hulk", "h.glb")
    (tmp_path / "names.txt").write_text("# ships\nHulk\n\n  Orca \n")
    assert sorted(r.name for r in library.read_names(spark, str(tmp_path / "names.txt")).collect()) == ["Hulk", "Orca"]
    (tmp_path / "changes.jsonl").write_text('{"build": 5, "before": 4, "keys": ["a", "b"]}\n')
    assert library.read_changes(spark, str(tmp_path / "changes.jsonl")).count() == 2


def test_folders_by_content_and_time(spark, tmp_path):
    for name, text, at in (("20240101_120000.txt", "a", 1_704_110_600), ("20240103_120000.txt", "b", 1_704_290_000), ("v.mp4", "c", 1_704_100_000)):
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (at, at))
    found = library.scan(spark, str(tmp_path))
    assert {r.sha for r in found.collect()} == {hashlib.sha256(x).hexdigest() for x in (b"a", b"b", b"c")}
    known = found.withColumn("sha", F.lit("kept")).filter("path LIKE '%mp4'")
    again = {r.path.rsplit("/", 1)[1]: r.sha for r in library.scan(spark, str(tmp_path), known).collect()}
    assert again["v.mp4"] == "kept" and again["20240101_120000.txt"] == hashlib.sha256(b"a").hexdigest()
    at = F.lit("2024-01-01 12:00:00").cast("timestamp")
    assert library.nearest_in_time(found, at).first().path.endswith("20240101_120000.txt")
    assert library.newest(found, ["txt"]).first().path.endswith("20240103_120000.txt") and library.newest(found, ["avi"]).count() == 0
    hits = library.find_logs(found, at, F.lit("2024-01-02 00:00:00").cast("timestamp")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in hits] == ["20240101_120000.txt"]


def test_trimmed_logs_and_writers(spark, tmp_path):
    lines = ["  Listener: Ann", "  Session Started: 2024.01.01 10:00:00", "[ 2024.01.01 10:00:01 ] (combat) early", "[ 2024.01.01 10:05:00 ] (notify) kept", "its second line", "[ 2024.01.01 10:09:00 ] (combat) late"]
    (tmp_path / "log.txt").write_text("\n".join(lines))
    at = lambda s: F.lit(s).cast("timestamp")
    got = library.trimmed_logs(spark, str(tmp_path / "log.txt"), at("2024-01-01 10:04:00"), at("2024-01-01 10:06:00")).orderBy("line_no").collect()
    assert [r.value for r in got] == [lines[i] for i in (0, 1, 3, 4)]
    rows = spark.createDataFrame([(2.0, "B", 1500.4, None, 3.0, 10.0), (1.5, "a", None, 2.0, None, None)], "t double, pilot string, d_a double, d_b double, d_c double, speed_mps double")
    library.write_readings(rows.coalesce(1), str(tmp_path / "r"))
    text = [x for f in sorted((tmp_path / "r").glob("*.csv")) for x in f.read_text().splitlines() if not x.startswith("t,")]
    assert text == ["1.500,a,,2,,", "2.000,B,1500,,3,10"]
    library.write_tracks(rows.select("pilot", "t", F.col("d_a").alias("distance_m"), "speed_mps"), str(tmp_path / "k"))
    assert {x for f in (tmp_path / "k").glob("*.csv") for x in f.read_text().splitlines()} == {"pilot,t,distance_m,speed_mps", "B,2.000,1500,10", "a,1.500,,"}
