"""Readers and sinks on files: changed bytes, bad headers, wrong columns, names that don't match, a stream, competing writers."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from gaugeworks.sources import readers, sinks


def test_changed_files_fail_the_hash_gate(spark, tmp_path):
    for name, data in (("a.txt", b"one"), ("b.txt", b"two"), ("c.txt", b"")):
        (tmp_path / name).write_bytes(data)
    found = readers.hashes(spark, f"file://{tmp_path}/*.txt")
    assert {r["path"].rsplit("/", 1)[1]: (r["sha256"], r["length"]) for r in found.collect()} == {n: (hashlib.sha256(d).hexdigest(), len(d)) for n, d in (("a.txt", b"one"), ("b.txt", b"two"))}
    expected = spark.createDataFrame([(r["path"], r["sha256"]) for r in found.collect()] + [("file:/gone", "0" * 64)], "path string, sha256 string")
    assert [r["path"] for r in readers.hash_gate(readers.hashes(spark, f"file://{tmp_path}/*.txt"), expected).collect()] == ["file:/gone"]
    (tmp_path / "b.txt").write_bytes(b"twO")
    wrong = readers.hash_gate(readers.hashes(spark, f"file://{tmp_path}/*.txt"), expected).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in wrong) == ["b.txt", "gone"] and {r["sha256"] is None for r in wrong} == {True, False}


def test_series_need_their_header_and_cells(spark, tmp_path):
    def read(text):
        at = tmp_path / hashlib.md5(text.encode()).hexdigest()
        at.write_text(text)
        return [tuple(r) for r in readers.series_csv(spark, str(at)).collect()]

    good = read("timestamp,value\n2026-01-01T00:00:00Z,1.5\n2026-01-01T00:01:00Z,\n")
    assert [v for _, v in good] == [1.5, None] and good[0][0] + datetime.timedelta(minutes=1) == good[1][0]
    for bad in ("time,value\n2026-01-01T00:00:00Z,1\n", "timestamp,value\n2026-01-01T00:00:00Z,high\n", "timestamp,value\nyesterday,1\n", "timestamp,value\n2026-01-01T00:00:00Z,1,2\n"):
        with pytest.raises(Exception, match="(?i)header|malformed|parse|schema"):
            read(bad)
    assert read("timestamp,value\n") == []


def test_sensor_files_need_exactly_their_columns(spark, tmp_path):
    df = spark.createDataFrame([(0.1, 1.0, 2.0)], "t double, x double, y double")
    for name in ("one", "two"):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    got = readers.sensor_parquet(spark, [f"{tmp_path}/one", f"{tmp_path}/two"], ["t", "y", "x"])
    assert got.count() == 2 and got.where(F.col("file_id").rlike("^part-.*parquet$")).select("file_id").distinct().count() == 2
    for columns in (["t", "x"], ["t", "x", "y", "z"], ["t", "x", "Y2"]):
        with pytest.raises(ValueError, match="expected"):
            readers.sensor_parquet(spark, [f"{tmp_path}/one"], columns)


def test_named_rows_need_a_name_for_each_cell(spark):
    rows = lambda *texts: readers.named_rows(spark.createDataFrame([(t,) for t in texts], "j string"), "j").collect()
    got = rows(json.dumps({"meta": ["a", "b"], "data": [["1", None], ["2", "x"]]}), json.dumps({"meta": [], "data": []}))
    assert [r["row"] for r in got] == [{"a": "1", "b": None}, {"a": "2", "b": "x"}]
    for meta, cells in ((["a", "b"], ["1"]), (["a"], ["1", "2"]), (["a", "a"], ["1", "2"])):
        with pytest.raises(Exception, match="names and cells"):
            rows(json.dumps({"meta": meta, "data": [cells]}))


def test_readings_stream_from_a_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = lambda asset, x: json.dumps({"asset_code": asset, "user_ts": "2026-01-01 00:00:00", "ts": None, "reading": {"p": x, "t": None}})

    def run():
        query = readers.reading_stream(spark, str(folder)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        return sorted((r["asset_code"], r["reading"]["p"], r["reading"]["t"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    (folder / "1.json").write_text(line("a", 1.0) + "\n" + line("b", 2.5) + "\n")
    assert run() == [("a", 1.0, None), ("b", 2.5, None)]
    (folder / "2.json").write_text(line("c", 3.0) + "\n")
    assert run() == [("a", 1.0, None), ("b", 2.5, None), ("c", 3.0, None)]  # files that were read are not read again


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_a_pointer_makes_the_result(spark, tmp_path, kind):
    path = f"file://{tmp_path}/result"
    left = lambda: sorted(p.name.split("-")[0] for p in (tmp_path / "result").glob("[!.]*"))
    a, b = spark.range(3), spark.range(2).withColumn("x", F.lit("y"))
    bad = spark.range(2).withColumn("x", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        sinks.publish_by_pointer({"a": a, "b": bad}, path, kind)
    assert left() == []
    version = sinks.publish_by_pointer({"a": a, "b": b}, path, kind)
    found = sinks.published(spark, path)
    assert sorted(int(r["id"]) for r in found["a"].collect()) == [0, 1, 2] and found["b"].count() == 2 and left() == ["current.json", "version"]
    with pytest.raises(ValueError, match="never overwritten"):
        sinks.publish_by_pointer({"a": b}, path, kind)
    assert left() == ["current.json", "version"] and sinks.published(spark, path)["a"].count() == 3 and version in json.loads((tmp_path / "result" / "current.json").read_text())["version"]


def test_of_two_writers_the_first_pointer_wins(spark, tmp_path):
    path, late = f"file://{tmp_path}/result", spark.range(5)

    class Slow(dict):
        """Another writer finishes while this one's tables are written."""

        def items(self):
            yield from super().items()
            sinks.publish_by_pointer({"a": spark.range(2)}, path)

    with pytest.raises(Exception, match="(?i)exist"):
        sinks.publish_by_pointer(Slow(a=late), path)
    assert sinks.published(spark, path)["a"].count() == 2 and len(list((tmp_path / "result").glob("version-*"))) == 1
