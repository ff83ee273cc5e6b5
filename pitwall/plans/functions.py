"""Statistics as table functions of SQL, over the published interval table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitwall import schema
from pitwall.functions import metrics
from pitwall.operators.calendar import date_spine
from pitwall.session import stage
from pitwall.sources.layers import publish_view


def publish_statistics(spark: SparkSession, results: DataFrame, intervals: DataFrame) -> None:
    """Publish the views `results`, `state_intervals` and `date_spine`, and two table functions:

    `driver_statistic(last_rounds, year_stop)`: the statistics of every eligible entity
    over its last rounds on every session date of the seasons up to one;
    `driver_statistic_on(last_rounds, day)`: the same on any one date.

    `intervals` is the table of `state_intervals`, stored or staged. In the first function
    states and dates meet on equal months, so no date is compared with all states.
    """
    spine = date_spine(results)
    publish_view(results, "results")
    publish_view(intervals, "state_intervals")
    publish_view(stage(spine, "spine"), "date_spine")
    kinds = {f.name: f.dataType.simpleString() for f in intervals.schema}
    found = ", ".join(f"`{name}` {kinds[name]}" for name in metrics.names())
    names = ", ".join(f"s.`{name}`" for name in metrics.names())
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION driver_statistic(n INT, year_stop INT)
        RETURNS TABLE (dt_ref DATE, DriverId STRING, {found})
        RETURN
          WITH spans AS (
            SELECT *, explode(sequence(trunc(from_date, 'MM'), trunc(until_date - INTERVAL 1 DAY, 'MM'), INTERVAL 1 MONTH)) AS month
            FROM state_intervals WHERE last_rounds = driver_statistic.n
          ),
          dates AS (SELECT dt_ref, ref_year, trunc(dt_ref, 'MM') AS month FROM date_spine WHERE ref_year <= driver_statistic.year_stop)
          SELECT d.dt_ref, s.DriverId, {names}
          FROM spans s JOIN dates d
            ON s.month = d.month AND d.dt_ref >= s.from_date AND d.dt_ref < s.until_date
               AND d.ref_year - s.last_year <= {schema.SEASON_LAG}
        """
    )
    spark.sql(
        f"""
        CREATE OR REPLACE TEMPORARY FUNCTION driver_statistic_on(n INT, day DATE)
        RETURNS TABLE (DriverId STRING, {found})
        RETURN
          SELECT s.DriverId, {names}
          FROM state_intervals s
          WHERE s.last_rounds = driver_statistic_on.n
            AND s.from_date <= driver_statistic_on.day AND s.until_date > driver_statistic_on.day
            AND year(driver_statistic_on.day) - s.last_year <= {schema.SEASON_LAG}
        """
    )
