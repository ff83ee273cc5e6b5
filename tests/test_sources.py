"""Landing, consolidation, incremental loads, backfills, streams and publishing."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitwall import schema
from pitwall.functions import scalars
from pitwall.operators import features
from pitwall.session import stage
from pitwall.sources import layers, publish, raw
from pitwall.streaming import ingest as ingest_module
from pitwall.streaming import ledger
from pitwall.streaming.ingest import ingest, session_rows

ROWS = [
    ("a", "2019-03-01", 1, "Race", 1.0, 1.0, 25.0, "Finished"),
    ("b", "2019-03-01", 1, "Race", 2.0, 3.0, 18.0, "+1 Lap"),
    ("a", "2020-03-01", 1, "Race", 1.0, 1.0, 25.0, "Finished"),
    ("a", "2020-02-29", 1, "Sprint", 1.0, 1.0, 8.0, "Finished"),
    ("a", "2020-04-01", 2, "Race", float("nan"), 1.0, 25.0, "Finished"),
]


def keys(df):
    return sorted(tuple(r) for r in df.select(*schema.SESSION_KEY).distinct().collect())


def test_consolidate_reads_all_sessions_and_clears_nan(spark, make_results, tmp_path):
    folder = str(tmp_path / "raw")
    raw.land_sessions(make_results(ROWS), folder)
    back = raw.consolidate(spark, folder)
    assert back.schema == schema.RESULTS
    assert back.count() == 5
    assert back.where("isnan(Position)").count() == 0
    assert back.where("Position IS NULL").count() == 1


def test_incremental_load_takes_every_new_session_once(spark, make_results, tmp_path):
    folder = str(tmp_path / "raw")
    rows = make_results(ROWS)
    raw.load_sessions(rows.where("Year = 2019"), folder)
    changed = rows.withColumn("Status", F.lit("later"))
    raw.load_sessions(changed, folder)
    stored = raw.scan_raw(spark, folder)
    assert stored.count() == 5
    # The session already there is left as it was; the sprint is taken with the race.
    assert {r["Status"] for r in stored.where("Year = 2019").collect()} == {"Finished", "+1 Lap"}
    assert keys(stored) == keys(rows)


def test_reload_replaces_past_seasons_only(spark, make_results, tmp_path):
    folder = str(tmp_path / "raw")
    rows = make_results(ROWS)
    raw.load_sessions(rows, folder)
    raw.load_sessions(rows.withColumn("Status", F.lit("new")), folder, reload_data=True, current_year=2020)
    stored = raw.scan_raw(spark, folder)
    assert {r["Status"] for r in stored.where("Year = 2019").collect()} == {"new"}
    assert stored.where("Year = 2020 AND Status = 'new'").count() == 0
    with pytest.raises(ValueError):
        raw.load_sessions(rows, folder, reload_data=True)


def test_stream_takes_each_file_once(spark, make_results, tmp_path):
    folder, bronze, checkpoint = (str(tmp_path / n) for n in ("raw", "bronze", "checkpoint"))
    rows = make_results(ROWS)
    counts = []
    for part in (rows.where("Year = 2019"), rows.where("Year = 2019"), rows):
        raw.load_sessions(part, folder)
        ingest(spark, folder, bronze, checkpoint, max_files=1)
        counts.append(spark.read.parquet(bronze).count())
    assert counts == [2, 2, 5]


def test_a_batch_reads_the_folders_of_its_own_sessions(spark, make_results, tmp_path):
    folder = str(tmp_path / "raw")
    raw.land_sessions(make_results(ROWS).withColumn("Mode", F.nullif("Mode", F.lit("Sprint"))), folder)
    files = spark.read.parquet(folder).where("Year = 2020 AND Mode IS NULL").select("_metadata.file_path").distinct()
    rows = session_rows(spark, folder, [r[0] for r in files.collect()])
    assert rows.inputFiles() and all("Year=2020" in f and "HIVE_DEFAULT" in f for f in rows.inputFiles())
    assert {(r["Year"], r["Mode"]) for r in rows.collect()} == {(2020, None)}


def test_the_ledger_leaves_equal_sessions_alone_and_survives_a_fault(spark, make_results, tmp_path, monkeypatch):
    folder, bronze, checkpoint, root = (str(tmp_path / n) for n in ("raw", "bronze", "checkpoint", "ledger"))
    rows = make_results(ROWS).withColumn("Mode", F.nullif("Mode", F.lit("Sprint")))
    files = lambda: {p.name for p in (tmp_path / "bronze").rglob("*.parquet")}
    run = lambda: ingest(spark, folder, bronze, checkpoint, ledger=root)
    raw.land_sessions(rows, folder)
    run()
    before, entries = files(), {tuple(r) for r in ledger.read_ledger(spark, root).collect()}
    assert sum(e[3] for e in entries) == 5 and all(e[4] for e in entries)
    # The same rows again, in another order and in new files: nothing is written.
    raw.land_sessions(rows.orderBy(F.col("DriverId").desc()), folder)
    run()
    assert files() == before and {tuple(r) for r in ledger.read_ledger(spark, root).collect()} == entries
    # A fault after bronze is written, before the ledger is: the session counts as changed, also when the old rows come back.
    plain, calls = ingest_module.write_ledger, []

    def broken(*given):
        calls.append(given)
        if len(calls) == 2:
            raise RuntimeError("lost")
        plain(*given)

    monkeypatch.setattr(ingest_module, "write_ledger", broken)
    raw.land_sessions(rows.where("Year = 2019").withColumn("Points", F.lit(1.0)), folder)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.undo()
    assert ledger.read_ledger(spark, root).where("Year = 2019 AND digest IS NULL").count() > 0
    raw.land_sessions(rows.where("Year = 2019"), folder)
    run()
    assert {tuple(r) for r in ledger.read_ledger(spark, root).select(*schema.SESSION_KEY, "rows", "digest").collect()} == {
        e[:5] for e in entries
    }
    stored = spark.read.schema(schema.RESULTS).parquet(bronze).select(*rows.columns)
    assert stored.exceptAll(raw.normalise(rows)).count() == 0 and stored.count() == 5


def test_digests_follow_rows_and_how_often_they_occur(make_results):
    one = make_results(ROWS).where("Year = 2019").limit(1)
    digest = lambda df: [tuple(r) for r in ledger.session_digests(df).collect()]
    assert digest(one) != digest(one.unionByName(one)) and digest(one) == digest(one.repartition(3))
    moved = one.withColumns({"Position": F.lit(None).cast("double"), "GridPosition": F.lit(3.0)})
    other = one.withColumns({"Position": F.lit(3.0), "GridPosition": F.lit(None).cast("double")})
    assert digest(moved) != digest(other)


def test_layer_tables_names_and_replacement(spark, make_results, tmp_path):
    root = str(tmp_path / "silver")
    rows = make_results(ROWS)
    layers.write_table(rows, root, "results", partition_by=["Year"])
    layers.write_table(rows.limit(1), root, "nested/one")
    found = publish.layer_tables(spark, root)
    assert [publish.table_name(root, p) for p in found] == ["nested_one", "results"]
    assert publish.table_name(root, found[1], "lab") == "lab_results"
    stored = layers.read_table(spark, root, "results")
    assert stored.count() == 5 and "v" not in stored.columns
    # A plan may read the table it replaces, and a reader keeps the whole table it began with.
    layers.write_table(stored.where("Year = 2019"), root, "results", partition_by=["Year"])
    assert layers.read_table(spark, root, "results").count() == 2
    assert stored.count() == 5
    assert publish.layer_tables(spark, root) == found


def test_an_unfinished_version_does_not_count(spark, make_results, tmp_path):
    root, rows = str(tmp_path), make_results(ROWS)
    first = layers.write_table(rows, root, "results")
    (tmp_path / "results" / "v=2").mkdir()
    assert layers.newest(spark, f"{root}/results") == first
    for _ in range(3):
        layers.write_table(rows.limit(1), root, "results")
    assert sorted(p.name for p in (tmp_path / "results").iterdir()) == ["v=4", "v=5"]
    assert layers.read_table(spark, root, "results").count() == 1


def test_views_and_stored_statements(spark, make_results, tmp_path):
    root = str(tmp_path / "bronze")
    layers.write_table(make_results(ROWS), root, "results")
    assert layers.view_table(spark, root, "results").count() == 5
    totals = layers.run_query(spark, "season_totals", {"year_stop": 2019})
    assert {(r["DriverId"], r["total_points"]) for r in totals.collect()} == {("a", 25.0), ("b", 18.0)}
    layers.save_query(spark, "season_totals", root, {"year_stop": 2020}, table="totals")
    assert layers.read_table(spark, root, "totals").count() == 3


def test_jdbc_writer_settings(make_results, monkeypatch):
    # No database is started here: the settings given to Spark are looked at instead.
    from pyspark.sql.readwriter import DataFrameWriter

    seen = {}
    plain = DataFrameWriter.options

    def options(self, **given):
        seen.update(given)
        return plain(self, **given)

    monkeypatch.setattr(DataFrameWriter, "options", options)
    publish.jdbc_writer(make_results(ROWS), "jdbc:some:db", "lab_results", {"numPartitions": "4"})
    assert seen == {"url": "jdbc:some:db", "dbtable": "lab_results", "batchsize": "1000", "numPartitions": "4"}


def test_publish_raw_keeps_rows_and_layout(spark, make_results, tmp_path):
    folder, target = str(tmp_path / "raw"), str(tmp_path / "bucket")
    raw.land_sessions(make_results(ROWS), folder)
    publish.publish_raw(spark, folder, target)
    assert raw.scan_raw(spark, target).count() == 5
    assert (tmp_path / "bucket" / "Year=2020" / "RoundNumber=1" / "Mode=Sprint").is_dir()


def test_durations(spark):
    span = dt.timedelta(days=1, hours=2, minutes=3, seconds=4, microseconds=500000)
    df = spark.createDataFrame([(span, None), (-span, None)], "Q1 interval day to second, Q2 interval day to second")
    assert [tuple(r) for r in raw.durations_to_seconds(df).collect()] == [(93784.5, None), (-93784.5, None)]


def test_scalars(spark):
    df = spark.createDataFrame(
        [("#ABcdef", 2001, 3, "x"), ("00FF00", 2001, 12, None), (None, None, 1, "x")], "c string, y int, r int, t string"
    )
    out = df.select(
        scalars.format_color(F.col("c")), scalars.session_key(F.col("y"), F.col("r"), F.lit("R")),
        scalars.composite_id(F.col("y"), F.col("t")),
    ).collect()
    assert [tuple(r) for r in out] == [
        ("#abcdef", "2001_03_R", "2001_x"), ("#00ff00", "2001_12_R", None), ("#ffffff", None, None)
    ]


def test_what_a_staged_table_shuffled_goes_when_it_is_written(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        names = [files.apply(i).getName() for i in range(files.size())]
        return {n for n in names if n.startswith("shuffle_") and not n.endswith(".index")}

    grouped, before, key = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    staged = stage(grouped, "grouped")
    assert shuffled() <= before and spark.conf.get(key) == was
    assert sorted(staged.collect()) == sorted(grouped.collect())


def test_stage_goes_to_the_configured_folder(spark, make_results):
    staged = stage(make_results(ROWS), "probe")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in f for f in staged.inputFiles())
    assert staged.schema == schema.RESULTS


def test_enrichment_keeps_every_row_and_refuses_a_session_listed_twice(spark, make_results):
    rows = make_results(ROWS)
    texts = {"OfficialEventName": "o", "EventName": "e", "Country": "c", "Location": "l"}
    listed = rows.select(*schema.SESSION_KEY, "Date").distinct().withColumns({k: F.lit(v) for k, v in texts.items()})
    kept = raw.enrich_sessions(rows.drop("Date"), listed.where("Year <> 2019"))
    assert kept.count() == rows.count()
    assert kept.where("Year = 2019 AND EventName IS NOT NULL").count() == 0
    assert kept.where("Year <> 2019 AND EventName IS NULL").count() == 0
    with pytest.raises(Exception, match="listed twice"):
        raw.enrich_sessions(rows.drop("Date"), listed.unionByName(listed)).collect()


def test_sessions_with_a_null_key_part_are_known(make_results):
    rows = make_results(ROWS).withColumn("Mode", F.lit(None).cast("string"))
    assert raw.new_sessions(rows, rows).count() == 0


def test_streamed_tables_are_found_and_partition_folders_not_entered(spark, make_results, tmp_path):
    root = tmp_path / "layer"
    (root / "streamed" / "_spark_metadata").mkdir(parents=True)
    (root / "streamed" / "Year=2019").mkdir()
    (root / "Year=2020" / "x" / "_delta_log").mkdir(parents=True)
    assert publish.layer_tables(spark, str(root)) == [f"{root}/streamed"]


def test_tables_in_buckets_of_one_key_are_joined_without_a_shuffle(spark, tmp_path):
    key = ["dt_ref", "DriverId"]
    rows = spark.range(400).selectExpr("date_add(date'2000-01-01', int(id % 20)) AS dt_ref", "string(id DIV 20) AS DriverId", "id AS v")
    tables = {2: rows, 5: rows.where("v % 3 > 0").withColumn("v", F.col("v") * 2)}
    for n, table in tables.items():
        layers.save_bucketed(table, str(tmp_path), f"in_buckets_{n}", key, 4)
    rows.createOrReplaceTempView("in_buckets_view")
    names = layers.catalog_tables(spark, "in_buckets_")
    assert names == ["in_buckets_2", "in_buckets_5"]
    stored = {n: spark.table(f"in_buckets_{n}") for n in tables}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = features.side_by_side_buckets(stored)
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        grouped = wide.groupBy(*key).agg(F.sum("v_2"))
        assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
        stacked = features.side_by_side(tables)
        assert wide.columns == stacked.columns
        assert wide.exceptAll(stacked).isEmpty() and stacked.exceptAll(wide).isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.catalog.dropTempView("in_buckets_view")
        for name in names:
            spark.sql(f"DROP TABLE {name}")
