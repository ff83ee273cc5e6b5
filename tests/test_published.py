"""Raw files of many layouts, written by hand."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pitwall import schema
from pitwall.plans import jobs
from pitwall.sources import layers, published, raw

STAMP = dt.datetime(2001, 3, 4, 15, 0, 0, 123456)


def _file(folder, name, **columns):
    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(columns), folder / f"{name}.parquet")


def _one(**changes):
    row = {
        "DriverId": pa.array(["a"]), "Year": pa.array([2001], pa.int64()), "RoundNumber": pa.array([3], pa.int64()),
        "Date": pa.array([STAMP], pa.timestamp("us")), "Mode": pa.array(["Race"]), "Position": pa.array([1.0]),
        "GridPosition": pa.array([2.0]), "Points": pa.array([10.0]), "Status": pa.array(["Finished"]), "TeamId": pa.array(["t"]),
        "TeamName": pa.array(["T"]), "TeamColor": pa.array(["00FF00"]), "FullName": pa.array(["A"]), "Unused": pa.array([[1]]),
    }
    return {k: v for k, v in (row | changes).items() if v is not None}


def test_every_layout_is_read(spark, tmp_path):
    folder = tmp_path / "raw"
    _file(folder, "int64_us", **_one())
    _file(folder, "int32_ns", **_one(
        DriverId=pa.array(["b"]).dictionary_encode(), Year=pa.array([2001], pa.int32()),
        Date=pa.array([int(STAMP.replace(tzinfo=dt.timezone.utc).timestamp()) * 10**9 + 123456789], pa.timestamp("ns")),
        Position=pa.array([1], pa.int64()), Points=pa.array([10.0], pa.float32()),
    ))
    _file(folder, "doubles_zone_gaps", **_one(
        DriverId=pa.array(["c"]), Year=pa.array([2001.0]), Date=pa.array([STAMP], pa.timestamp("ms" if STAMP.microsecond % 1000 == 0 else "us", "UTC")),
        TeamId=None, TeamColor=pa.nulls(1), Position=pa.array([float("nan")]),
    ))
    good, rejected, counts = published.consolidate(spark, str(folder))
    rows = {r["DriverId"]: r for r in good.collect()}
    assert good.schema == schema.RESULTS and counts.get == {"rows": 3, "rejected": 0} and rejected.count() == 0
    assert {r["Year"] for r in rows.values()} == {2001} and {r["RoundNumber"] for r in rows.values()} == {3}
    assert good.selectExpr("count(DISTINCT Date)", "max(unix_micros(Date))").first()[:] == (
        1, int(STAMP.replace(tzinfo=dt.timezone.utc).timestamp()) * 10**6 + 123456
    )
    assert rows["b"]["Position"] == 1.0 and rows["b"]["Points"] == 10.0
    assert (rows["c"]["TeamId"], rows["c"]["TeamColor"], rows["c"]["Position"]) == (None, None, None)


def test_nanoseconds_before_1970_go_down(spark, tmp_path):
    _file(tmp_path / "raw", "old", **_one(Date=pa.array([-1], pa.timestamp("ns"))))
    good = published.consolidate(spark, str(tmp_path / "raw"))[0]
    assert good.selectExpr("unix_micros(Date)").first()[0] == -1


def test_rejects_say_why_and_bronze_keeps_the_rest(spark, tmp_path):
    folder = tmp_path / "raw"
    _file(folder, "good", **_one())
    _file(folder, "no_year", **_one(Year=None))
    _file(folder, "null_round", **_one(RoundNumber=pa.array([None], pa.int64())))
    _file(folder, "huge", **_one(Year=pa.array([1 << 40])))
    _file(folder, "half", **_one(Year=pa.array([2001.5])))
    _file(folder, "text", **_one(RoundNumber=pa.array(["third"])))
    _file(folder, "digits", **_one(RoundNumber=pa.array(["3"])))
    bronze = str(tmp_path / "bronze")
    assert jobs.run_bronze(spark, str(folder), bronze) == {"rows": 7, "rejected": 5}
    assert jobs.bronze_results(spark, bronze).count() == 2
    rejects = layers.read_table(spark, bronze, "rejects")
    assert sorted(r[0] for r in rejects.select("reason").collect()) == [
        "RoundNumber does not fit", "RoundNumber is missing", "Year does not fit", "Year does not fit", "Year is missing"
    ]


def test_folders_that_name_the_session_are_read_too(spark, tmp_path, make_results):
    rows = make_results([("a", "2001-01-01", 1, "Race", 1.0, 1.0, 5.0, "Finished"), ("b", "2001-01-01", 1, "Sprint", 2.0, 1.0, 3.0, "Finished")])
    raw.land_sessions(rows, str(tmp_path / "raw"))
    good = published.consolidate(spark, str(tmp_path / "raw"))[0]
    assert sorted(good.collect()) == sorted(rows.collect())


def test_a_type_without_meaning_stops_the_job_and_no_file_is_no_row(spark, tmp_path):
    (tmp_path / "none").mkdir()
    good, rejected, _ = published.consolidate(spark, str(tmp_path / "none"))
    assert good.count() == rejected.count() == 0 and good.columns == schema.RESULTS.fieldNames()
    _file(tmp_path / "raw", "list", **_one(Points=pa.array([[1.0]])))
    with pytest.raises(TypeError, match="Points"):
        published.consolidate(spark, str(tmp_path / "raw"))


def test_large_files_are_opened_by_spark(spark, tmp_path, monkeypatch):
    _file(tmp_path / "raw", "one", **_one())
    monkeypatch.setattr(published, "WHOLE_FILE", 10)
    assert published.consolidate(spark, str(tmp_path / "raw"))[0].count() == 1
