"""Season totals and champions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def season_points(results: DataFrame) -> DataFrame:
    """Points of each entity per season, all modes together."""
    return results.groupBy("Year", "DriverId").agg(F.sum("Points").alias("total_points"))


def champions(results: DataFrame) -> DataFrame:
    """The entity with most points per season; equal points go to the lower DriverId.

    A season that is still running yields its current leader. The rank filter is taken
    per task before the shuffle, so a season moves one row per task.
    """
    ranking = Window.partitionBy("Year").orderBy(F.col("total_points").desc_nulls_last(), "DriverId")
    return (
        season_points(results).withColumn("rank_driver", F.row_number().over(ranking)).where("rank_driver = 1")
    )
