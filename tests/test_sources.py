"""Series text, encodings, tables and inventories."""

import hashlib
import json

import pytest

from dualcast.sources import series_text, tables

HEADER = "# note\n@relation x\n@attribute series_name string\n@attribute start_timestamp date\n@frequency hourly\n@horizon 24\n@missing false\n@data\n"


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_read_and_lengthen(spark, tmp_path):
    path = write(tmp_path, "a.txt", HEADER + "T1:2009-05-01 00-00-01:1,2.5,?\n\nT2:2010-01-01:4\n")
    rows, metadata = series_text.read_series_text(spark, path)
    settings = metadata.first()
    assert settings["settings"]["horizon"] == "24" and settings["settings"]["missing"] == "false" and settings["has_data"]
    assert [(d["name"], d["kind"]) for d in settings["declared"]] == [("series_name", "string"), ("start_timestamp", "date")]
    long = series_text.to_long(series_text.validate_series_rows(rows), "x").orderBy("series_id", "time_index").collect()
    assert [(r["series_id"], r["time_index"], str(r["timestamp"]), r["value"]) for r in long] == [
        ("T1", 0, "2009-05-01 00:00:01", 1.0), ("T1", 1, "2009-05-01 01:00:01", 2.5), ("T1", 2, "2009-05-01 02:00:01", None),
        ("T2", 0, "2010-01-01 00:00:00", 4.0)]


def test_numbered_ids_without_names(spark, tmp_path):
    path = write(tmp_path, "b.txt", "@attribute series_type string\n@data\nrain:1,2\nsnow:3\n")
    rows, _ = series_text.read_series_text(spark, path)
    long = series_text.to_long(rows, "x", None).orderBy("series_id", "time_index").collect()
    assert [(r["series_id"], r["series_type"], r["value"], r["timestamp"]) for r in long] == [
        ("series_000000", "rain", 1.0, None), ("series_000000", "rain", 2.0, None), ("series_000001", "snow", 3.0, None)]


@pytest.mark.parametrize("bad, problem", [("T1:x:y:1,2", "field count"), ("T1:2010-01-01:?,?", "empty or all missing")])
def test_malformed_rows(spark, tmp_path, bad, problem):
    path = write(tmp_path, "c.txt", HEADER + bad + "\nT2:2010-01-01:4\n")
    rows, _ = series_text.read_series_text(spark, path)
    good, wrong = series_text.validate_series_rows(rows, "quarantine")
    assert good.count() == 1 and wrong.first()["problem"] == problem
    with pytest.raises(Exception, match="malformed series row"):
        series_text.validate_series_rows(rows).collect()


def test_no_data_section(spark, tmp_path):
    path = write(tmp_path, "d.txt", "@relation x\n@attribute series_name string\n")
    with pytest.raises(ValueError):
        series_text.require_data(series_text.read_series_text(spark, path)[1])


def test_windows_1252(spark, tmp_path):
    text = "@attribute series_name string\n@data\ncafé €œ:1\n"
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder, "old.txt", text, "cp1252")
    write(folder, "new.txt", text)
    found = {r["file"].rsplit("/", 1)[1]: r["encoding"] for r in series_text.detect_encoding(spark, str(folder)).collect()}
    assert found == {"old.txt": "cp1252", "new.txt": "utf-8"}
    rows, _ = series_text.read_series_text(spark, str(folder))
    assert {r["attributes"]["series_name"] for r in rows.collect()} == {"café €œ"}


def test_panel_round_trip_and_split_check(spark, tmp_path):
    df = spark.createDataFrame([("d", "a", 0, 1.0, "base_train"), ("d", "a", 1, 2.0, "test")], "dataset_id string, series_id string, time_index long, value double, split string")
    tables.write_panel(df, str(tmp_path / "p"))
    panel = tables.read_panel(spark, str(tmp_path / "p"), ["test"], ["series_id", "value"])
    assert [tuple(r) for r in panel.collect()] == [("a", 2.0)]
    with pytest.raises(ValueError):
        tables.read_panel(spark, str(tmp_path / "p"), ["test", "calibration"], ["value"])


def test_csv_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("a", "core", "f", "m", "u"), ("b", "extended", "g", "n", "v")], "dataset_id string, tier string, filename string, md5 string, url string")
    tables.write_table_csv(df, str(tmp_path / "m"))
    schema = "dataset_id string, tier string, filename string, md5 string, url string"
    back = tables.read_table_csv(spark, str(tmp_path / "m"), schema, tables.MANIFEST_COLUMNS)
    assert [r["dataset_id"] for r in tables.select_manifest(back, tiers=["core"]).collect()] == ["a"]
    with pytest.raises(ValueError, match="unknown dataset_id values: z"):
        tables.select_manifest(back, names=["a", "z"])
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_table_csv(spark, str(tmp_path / "m"), "dataset_id string, tier string, filename string, md5 string, url string", ["license"])


def test_digests_and_snapshot(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    write(folder, "a.txt", "one")
    write(folder, 'b "q".txt', "two")
    now = tables.file_digests(spark, str(folder))
    records = [{"path": p, "size_bytes": 3, "sha256": hashlib.sha256(t.encode()).hexdigest()} for p, t in (("a.txt", "one"), ('b "q".txt', "two"))]
    assert {r["md5"] for r in now.collect()} == {hashlib.md5(t).hexdigest() for t in (b"one", b"two")}
    want = hashlib.sha256(json.dumps(records, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    fixed = spark.createDataFrame([(r["path"], r["size_bytes"], r["sha256"]) for r in records], "path string, size_bytes long, sha256 string")
    assert tables.snapshot_id(fixed).first()["snapshot_id"] == want
    old = spark.createDataFrame([("a.txt", 3, "0"), ("gone.txt", 1, "1")], "path string, size_bytes long, sha256 string")
    status = {r["path"]: r["status"] for r in tables.diff_digests(fixed, old).collect()}
    assert status == {"a.txt": "changed", "gone.txt": "missing", 'b "q".txt': "new"}
