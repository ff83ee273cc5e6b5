"""The jobs from raw files to scored tables, on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from checks.compare import differences
from pyspark.sql import functions as F
from pitwall.operators import asof, features, forest, serving
from pitwall.plans import jobs
from pitwall.session import stage, staged_for_job, staging_root
from pitwall.sources import fixture, layers, publish, raw

from conftest import SF

WINDOWS = (2, 5)


def test_raw_to_scored(spark, tmp_path):
    raw_root, bronze, silver, models, gold = (str(tmp_path / n) for n in ("raw", "bronze", "silver", "models", "gold"))
    results = fixture.results(spark, SF)
    raw.land_sessions(results, raw_root)
    jobs.run_bronze(spark, raw_root, bronze)
    assert jobs.bronze_results(spark, bronze).count() == results.count()

    before = staged(spark)
    jobs.run_silver(spark, bronze, silver, windows=WINDOWS)
    assert staged(spark) == before
    names = [publish.table_name(silver, p) for p in publish.layer_tables(spark, silver)]
    assert names == ["champions", "driver_all_statistic", "driver_statistic_2", "driver_statistic_5", "tb_abt"]
    for n in WINDOWS:
        stored = layers.read_table(spark, silver, f"driver_statistic_{n}").toPandas()
        assert differences(stored, asof.driver_statistic(results, n).toPandas()) == ""
    abt = layers.read_table(spark, silver, "tb_abt")
    assert abt.columns[-1] == "flChampion" and len(abt.columns) == 3 + 45 * len(WINDOWS)

    assert forest.load_model(spark, models) is None
    before = staged(spark)
    auc, importance, _ = jobs.run_train(spark, silver, models, 2000, 2000, 2001, trees=5, max_depth=4)
    scores = {r["split"]: r["auc"] for r in auc.collect()}
    assert set(scores) == {"train", "test", "oot"} and scores["train"] > 0.5
    assert importance.count() == 45 * len(WINDOWS)
    jobs.run_train(spark, silver, models, 2000, 2000, 2001, trees=5, max_depth=4)
    assert forest.versions(spark, models) == [1, 2]

    root = jobs.results_root(models, 2)
    curve = layers.read_table(spark, root, "roc_curve")
    assert {r["split"] for r in curve.where("fpr = 1 AND tpr = 1").collect()} == {"train", "test", "oot"}
    assert layers.read_table(spark, root, "auc").count() == 3
    assert layers.read_table(spark, root, "importance").count() == 45 * len(WINDOWS)

    jobs.run_score(spark, bronze, silver, models, gold)
    assert staged(spark) == before
    scored = layers.read_table(spark, gold, "scored")
    assert scored.count() == abt.count()
    assert scored.where("abs(`0` + prob_win - 1) > 1e-9").count() == 0
    assert scored.where("id <> concat(dt_ref, '_', DriverId)").count() == 0

    jobs.run_serving(spark, gold)
    top = layers.read_table(spark, gold, "top_probability")
    ids = {r["driver_team_id"] for r in top.collect()} - {None}
    assert top.count() == 5 and ids
    assert set(layers.read_table(spark, gold, "pivot_probability").columns) == {"dt_ref", *ids}
    assert {r["driver_team_id"] for r in layers.read_table(spark, gold, "color_lookup").collect()} == ids
    assert layers.read_table(spark, gold, "season_domain").where("is_default").count() == 1
    assert layers.read_table(spark, gold, "first_team").count() > 0
    assert layers.read_table(spark, gold, "selected").columns == scored.columns


def staged(spark) -> set[str]:
    folder = Path(staging_root(spark)) / "pitwall"
    return {p.name for p in folder.iterdir()} if folder.exists() else set()


def test_staged_tables_go_with_their_job_also_after_an_error(spark):
    before = staged(spark)
    with pytest.raises(ValueError), staged_for_job(spark):
        assert stage(spark.range(3), "for_the_job").count() == 3
        raise ValueError
    assert staged(spark) == before


def test_the_session_zone_does_not_change_the_jobs(spark, tmp_path):
    rows = fixture.results(spark, SF)
    layers.write_table(rows, str(tmp_path / "bronze"), "results")
    try:
        for zone in ("UTC", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            jobs.run_silver(spark, str(tmp_path / "bronze"), str(tmp_path / zone.replace("/", "_")), windows=(2,))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    first, second = (
        layers.read_table(spark, str(tmp_path / z), "tb_abt").toPandas() for z in ("UTC", "America_Sao_Paulo")
    )
    assert differences(first, second) == ""


def test_same_rows_and_seed_give_the_same_forest(spark):
    results = fixture.results(spark, SF)
    abt = features.label(features.driver_all_statistic(results, (5,)), jobs.champions.champions(results)).cache()
    names = features.feature_columns(abt)
    first, second = (
        forest.predict(forest.fit(abt, names, trees=5, max_depth=4), abt).select("dt_ref", "DriverId", "prob_win").toPandas()
        for _ in range(2)
    )
    assert differences(first, second) == ""


def test_stored_scores_are_read_by_entity(spark, tmp_path):
    """Most files and row groups are skipped, also where one entity holds a third of the rows, and none without a team is lost."""
    entity = F.when(F.col("id") % 3 == 0, "hot_0").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("e_"), F.col("id") % 40))
    scored = spark.range(30_000).select(
        entity.alias("driver_team_id"), F.expr("date_add(DATE'2000-01-01', cast(id % 900 as int))").alias("dt_ref"), F.lit(2000).alias("Year"), "id"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        layers.write_table(serving.by_entity(scored), str(tmp_path), "scored", **serving.SERVING_OPTIONS)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = layers.read_table(spark, str(tmp_path), "scored")
    assert stored.exceptAll(scored).count() == 0 and stored.count() == 30_000
    sizes = [r["count"] for r in stored.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)
    chosen = serving.filter_entities_seasons(stored, ["e_7"], [2000])
    assert chosen.count() == scored.where("driver_team_id = 'e_7'").count() > 0
    plan = chosen._jdf.queryExecution().executedPlan()
    chosen._jdf.queryExecution().toRdd().count()
    read = plan.collectLeaves().head().metrics().get("numOutputRows").get().value()
    assert 0 < read < 15_000
