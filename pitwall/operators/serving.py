"""Serving tables: scored rows with their entity, selections, pivots and colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwall.functions.scalars import composite_id, format_color

DIMENSION = ["TeamName", "TeamColor", "FullName", "TeamId"]


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in `order`. State a full order, or ties are arbitrary.
    The rank filter is taken per task before the shuffle, so a key with very many rows
    moves one row per task."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(first)).where("_row = 1").drop("_row")


def entity_dimension(results: DataFrame) -> DataFrame:
    """Team and name of each entity as of its latest session.

    Rows collapse to the few distinct combinations of an entity first, with the latest
    date of each; only those are ranked.
    """
    variants = (
        results.where(F.col("DriverId").isNotNull())
        .groupBy("DriverId", *DIMENSION)
        .agg(F.max("Date").alias("latest"))
    )
    order = [F.col("latest").desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in DIMENSION]]
    return (
        keep_first(variants, ["DriverId"], order)
        .withColumn("TeamColor", format_color(F.col("TeamColor")))
        .select("DriverId", *DIMENSION)
    )


def add_row_id(df: DataFrame) -> DataFrame:
    """`id` = date and entity, `Year` = season of the as-of date."""
    return df.withColumns(
        {
            "id": composite_id(F.date_format("dt_ref", "yyyy-MM-dd"), F.col("DriverId")),
            "Year": F.year("dt_ref"),
        }
    )


def scored_with_team(scored: DataFrame, dimension: DataFrame) -> DataFrame:
    """Scored rows with their entity's team, and `driver_team_id`; null without a team."""
    return scored.join(dimension, "DriverId").withColumn(
        "driver_team_id", composite_id(F.col("DriverId"), F.col("TeamId"))
    )


def first_team(scored: DataFrame) -> DataFrame:
    """The first date of each entity with its team then; entities without a team are
    left out. Dates collapse per entity and team before anything is ranked."""
    rows = scored.groupBy("DriverId", "driver_team_id").agg(F.min("dt_ref").alias("dt_ref"))
    return keep_first(rows, ["DriverId"], ["dt_ref", F.col("driver_team_id").asc_nulls_last()]).dropna()


def top_probability(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k most probable rows of the newest dates."""
    return scored.orderBy(F.col("dt_ref").desc(), F.col("prob_win").desc_nulls_last(), "DriverId").limit(k)


def default_selection(scored: DataFrame) -> tuple[list[str], list[int]]:
    """The teams of the five most probable rows of the newest dates, and the newest season.
    Five rows and one number come to the driver."""
    top = top_probability(scored.select("dt_ref", "DriverId", "Year", "prob_win", "driver_team_id")).collect()
    newest = scored.agg(F.max("Year")).first()[0]
    return sorted({r["driver_team_id"] for r in top if r["driver_team_id"] is not None}), [] if newest is None else [newest]


def season_domain(scored: DataFrame) -> DataFrame:
    """The seasons to choose from, the newest marked."""
    seasons = scored.select("Year").distinct()
    return seasons.select("Year", (F.col("Year") == F.max("Year").over(Window.partitionBy())).alias("is_default"))


#: Writer options of the stored scores: a reader skips row groups whose filter does not hold an entity.
SERVING_OPTIONS = {"parquet.bloom.filter.enabled#driver_team_id": "true"}


def by_entity(scored: DataFrame) -> DataFrame:
    """The scores as they are stored for reading by entity: cut into ranges of (entity, date), each sorted.

    The ranges come from a sample of the rows, and the date splits an entity with very many
    of them, so files are of like size. An entity is in few files, and their statistics
    keep readers out of the others.
    """
    order = [F.col("driver_team_id").asc_nulls_first(), F.col("dt_ref").asc_nulls_first()]
    return scored.repartitionByRange(*order).sortWithinPartitions(*order)


def filter_entities_seasons(scored: DataFrame, ids: Sequence[str], seasons: Sequence[int]) -> DataFrame:
    """Rows of the chosen entities in the chosen seasons."""
    return scored.where(F.col("driver_team_id").isin(list(ids)) & F.col("Year").isin(list(seasons)))


def pivot_probability(selected: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per date, one column per chosen entity, its mean probability."""
    return selected.groupBy("dt_ref").pivot("driver_team_id", sorted(ids)).agg(F.avg("prob_win"))


def color_lookup(selected: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(pos, driver_team_id, TeamColor) in the order of `ids`; null for an unknown id."""
    spark = selected.sparkSession
    order = spark.createDataFrame([(i, name) for i, name in enumerate(ids)], "pos int, driver_team_id string")
    colors = keep_first(
        selected.select("driver_team_id", "TeamColor").distinct(),
        ["driver_team_id"],
        [F.col("TeamColor").asc_nulls_last()],
    )
    return order.join(colors, "driver_team_id", "left").select("pos", "driver_team_id", "TeamColor").orderBy("pos")
