"""The pipeline jobs, from raw files to scored tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall import schema
from pitwall.operators import asof, champions, features, forest, ranking, serving
from pitwall.session import pin_utc, stage, staged_for_job
from pitwall.sources import layers, publish, published


def run_bronze(spark: SparkSession, raw_folder: str, bronze: str) -> dict[str, int]:
    """All raw session files as one clean results table, one folder per season.

    Rows without a season or round, or with one that fits no integer, go to the table
    `rejects` with their reason. Returns how many rows were read and rejected, which is
    counted in the same pass.
    """
    pin_utc(spark)
    with staged_for_job(spark):
        rows, rejected, counts = published.consolidate(spark, raw_folder)
        layers.write_table(rows.hint("rebalance", "Year"), bronze, "results", partition_by=["Year"])
        found = counts.get
        layers.write_table(rejected if found["rejected"] else rejected.limit(0), bronze, "rejects")
    return found


def bronze_results(spark: SparkSession, bronze: str) -> DataFrame:
    return layers.read_table(spark, bronze, "results", schema=schema.RESULTS)


def run_silver(
    spark: SparkSession,
    bronze: str,
    silver: str,
    year_stop: int | None = None,
    windows: Sequence[int] = schema.WINDOWS,
) -> None:
    """Champions, one statistics table per window, the wide table and its labelled form.

    All windows are computed in one pass and staged. The tables that follow are cuts of
    that one: no further scan of the results, and no join to set windows side by side.
    """
    pin_utc(spark)
    results = bronze_results(spark, bronze)
    layers.write_table(champions.champions(results), silver, "champions")

    with staged_for_job(spark):
        wide = stage(asof.all_windows(results, windows, year_stop), "windows")
        for n in windows:
            layers.write_table(asof.one_window(wide, n), silver, f"driver_statistic_{n}")
        layers.write_table(features.present_everywhere(wide, windows), silver, "driver_all_statistic")

    winners, everywhere = (layers.read_table(spark, silver, n) for n in ("champions", "driver_all_statistic"))
    layers.write_table(features.label(everywhere, winners), silver, "tb_abt")


def run_publish(
    spark: SparkSession, roots: Mapping[str, str], urls: Mapping[str, str], prefix: str = "", **options: str
) -> list[str]:
    """Copy each layer to its database."""
    return [n for layer, root in roots.items() for n in publish.publish_layer(spark, root, urls[layer], prefix, options=options)]


def run_train(
    spark: SparkSession,
    silver: str,
    models: str,
    train_before: int = 2024,  # fixed values: the published split years
    test_year: int = 2024,
    oot_year: int = 2025,
    trees: int = forest.TREES,
    max_depth: int = forest.MAX_DEPTH,
) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """Fit on the training split, measure every split, refit on all rows and store.

    The areas under the curve, the curves of the splits and the importances are stored
    with the model's version, before the model itself: a stored model has its results.
    Returns (split, auc), the importances, and the stored model.
    """
    pin_utc(spark)
    abt = layers.read_table(spark, silver, "tb_abt")
    names = features.feature_columns(abt)
    root = results_root(models, forest.next_version(spark, models))
    with staged_for_job(spark):
        split = features.temporal_split(abt, train_before, test_year, oot_year)
        model = forest.fit(split.where("split = 'train'"), names, trees, max_depth)
        scored = stage(forest.predict(model, split).select("split", schema.LABEL, "prob_win"), "split_scores")
        auc = ranking.roc_auc(scored, "prob_win", schema.LABEL, ["split"]).withColumn("auc", F.round("auc", 4))
        layers.write_table(auc, root, "auc")
        layers.write_table(ranking.roc_curve(scored, "prob_win", schema.LABEL, ["split"]), root, "roc_curve")
        layers.write_table(forest.feature_importance(model, spark), root, "importance")
        final = forest.fit(abt, names, trees, max_depth)
    forest.save_model(final, spark, models)
    importance = layers.read_table(spark, root, "importance").orderBy(F.col("importance").desc(), "feature")
    return layers.read_table(spark, root, "auc"), importance, final


def results_root(models: str, version: int) -> str:
    """Where the tables `auc`, `roc_curve` and `importance` of a model's version are."""
    return f"{models.rstrip('/')}/results/{version}"


def score(model: PipelineModel, abt: DataFrame, results: DataFrame) -> DataFrame:
    """The scored table: features with nulls filled, id, season, probabilities, team."""
    filled = serving.add_row_id(features.impute_sentinel(abt))
    scored = forest.predict(model, filled).drop("prediction")
    # Staged, so its size is known and the wide side is not shuffled for it.
    return serving.scored_with_team(scored, stage(serving.entity_dimension(results), "entities"))


def run_score(spark: SparkSession, bronze: str, silver: str, models: str, gold: str) -> None:
    """Score the whole labelled table with the newest model."""
    pin_utc(spark)
    model = forest.load_model(spark, models)
    if model is None:
        raise FileNotFoundError(f"no model under {models}")
    abt = layers.read_table(spark, silver, "tb_abt")
    with staged_for_job(spark):
        scored = stage(score(model, abt, bronze_results(spark, bronze)), "scored")
        # Staged, as the ranges take a sample, for which all rows would be scored once more.
        layers.write_table(serving.by_entity(scored), gold, "scored", **serving.SERVING_OPTIONS)


def run_serving(spark: SparkSession, gold: str) -> None:
    """The tables shown first, from the stored scores: the first team of every entity, the
    most probable rows, the seasons, and for the default selection its rows, their
    pivot and their colours."""
    scored = layers.read_table(spark, gold, "scored")
    ids, seasons = serving.default_selection(scored)
    chosen = serving.filter_entities_seasons(scored, ids, seasons)
    layers.write_table(serving.first_team(scored), gold, "first_team")
    layers.write_table(serving.top_probability(scored), gold, "top_probability")
    layers.write_table(serving.season_domain(scored), gold, "season_domain")
    layers.write_table(chosen, gold, "selected")
    layers.write_table(serving.pivot_probability(chosen, ids), gold, "pivot_probability")
    layers.write_table(serving.color_lookup(chosen, ids), gold, "color_lookup")
