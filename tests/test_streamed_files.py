"""Folders of position files as streams: batches, repeats and restarts leave the same table."""

import pytest
from pyspark.sql import functions as F

from trackloom.sources import files
from trackloom.streaming import library

HEADS = (["t", "pilot", "ship_type", "x_m", "y_m", "z_m", "speed_mps"], ["pilot", "z_m", "y_m", "x_m", "t", "ship_type"], ["ship_type", "hull", "shield", "armor", "x_m", "y_m", "z_m", "pilot", "t"])


def put(folder, i, name=None):
    head = HEADS[i % 3]
    value = {"t": i, "pilot": f'"P, {i}"', "ship_type": "Moa", "x_m": 10 * i, "y_m": 2, "z_m": 3, "speed_mps": 7, "hull": 1, "shield": 0.5, "armor": 0.25}
    lines = [",".join(head), ",".join(str(value[c]) for c in head), ",".join(str(value[c]) for c in head[:-1])]  # the last one is short
    (folder / (name or f"f{i}.csv")).write_text("\n".join(lines) + "\n")


def shown(df):
    return sorted((r.pilot, r.t, r.x_m, r.speed_mps, r.shield) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(1, 6):
        put(tmp_path / "in", i)
    put(tmp_path / "in", 2, "again.csv")
    return tmp_path


def test_each_file_has_its_own_header(spark, folder):
    want = [(f"P, {i}", float(i), 10.0 * i, 7.0 if i % 3 == 0 else None, 0.5 if i % 3 == 2 else None) for i in (1, 2, 2, 3, 4, 5)]
    assert shown(files.read_positions(spark, str(folder / "in"))) == sorted(want)


def test_batches_and_restarts_equal_one_read(spark, folder):
    table, cp = str(folder / "table"), str(folder / "cp")
    library.keep_files(spark, str(folder / "in"), table, cp, at_once=2).awaitTermination()
    assert spark.read.parquet(f"{table}/seen").select("batch").distinct().count() >= 2
    assert [x[0] for x in shown(library.kept_rows(spark, table))] == [f"P, {i}" for i in range(1, 6)]
    put(folder / "in", 6)
    put(folder / "in", 1, "copy.csv")  # known content under another name
    library.keep_files(spark, str(folder / "in"), table, cp, at_once=2).awaitTermination()
    assert [x[0] for x in shown(library.kept_rows(spark, table))] == [f"P, {i}" for i in range(1, 7)]


def test_a_batch_that_breaks_off_is_repeated(spark, folder, monkeypatch):
    table, cp, note, calls = str(folder / "table"), str(folder / "cp"), library._note, []

    def broken(seen, path):
        calls.append(path)
        if len(calls) == 2:
            raise RuntimeError("lost")
        note(seen, path)

    monkeypatch.setattr(library, "_note", broken)
    with pytest.raises(Exception, match="lost"):
        library.keep_files(spark, str(folder / "in"), table, cp, at_once=2).awaitTermination()
    assert library.kept_rows(spark, table).count() < 5
    library.keep_files(spark, str(folder / "in"), table, cp, at_once=2).awaitTermination()
    assert shown(library.kept_rows(spark, table)) == shown(files.read_positions(spark, str(folder / "in")).distinct().dropDuplicates(["pilot"]))


def test_logs_of_a_window(spark, tmp_path):
    import os

    logs = {"20240131_200000.txt": ("Ann", "20:15:00", 1_706_739_300), "20240131_210000.txt": ("Bo", "21:15:00", 1_706_742_900), "20240131_190000.txt": ("Cy", "20:14:00", 1_706_700_000), "other.txt": ("Di", "20:40:00", 1_706_750_000)}
    for name, (who, at, wrote) in logs.items():
        (tmp_path / name).write_text(f"  Listener: {who}\n[ 2024.01.31 {at} ] (combat) <b>12</b> to Bob - Gun - Hits\n")
        os.utime(tmp_path / name, (wrote, wrote))
    at = lambda s: F.lit(f"2024-01-31 {s}").cast("timestamp")
    got = files.read_combat_logs(spark, str(tmp_path), at("20:10:00"), at("20:20:00"))
    # Cy's file was written before the window, Bo's begins after it, Di's has no line in it
    assert [(r.listener, r.kind, r.amount, r.target) for r in got.collect()] == [("Ann", "DAMAGE", 12.0, "Bob")]
    assert got.inputFiles() and files.log_lines(spark, str(tmp_path), at("20:10:00"), at("20:20:00")).select("file").distinct().count() == 2
