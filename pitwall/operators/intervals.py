"""Statistics as a table of intervals, and as-of lookups on any date.

The state of an entity and window changes on session dates only. Kept with the stretch of
dates it holds on, each state is one row, however many dates follow; no date spine is
spread over it. A probe of any date meets the states of its entity in a bucketed join:
states stand in every bucket of days that they reach into, a probe in one, so the join is
on equal (entity, bucket), and the dates are compared only among the few states there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall import schema
from pitwall.functions import metrics
from pitwall.operators.asof import window_states
from pitwall.operators.calendar import calendar

#: Days of a bucket: a month holds a few session dates.
BUCKET_DAYS = 32


def state_intervals(results: DataFrame, windows: Sequence[int] = schema.WINDOWS) -> DataFrame:
    """(DriverId, last_rounds, from_date, until_date, last_year, 45 statistics).

    A state holds from `from_date` up to, not including, `until_date`. The last one of an
    entity ends some time after the seasons in which it still is eligible.
    """
    cal = calendar(results)
    states = window_states(results, cal.session_windows(windows), windows)
    dates = cal.dates.select("pos", "date")
    opened = states.join(dates.withColumnRenamed("date", "from_date"), "pos")
    closed = dates.select(F.col("pos").alias("until"), F.col("date").alias("next_date"))
    last = F.make_date(F.col("last_year") + schema.SEASON_LAG + 2, F.lit(1), F.lit(1))
    return (
        opened.join(closed, "until", "left")
        .withColumn("until_date", F.least("next_date", last))
        .where("until_date > from_date")
        .select("DriverId", "last_rounds", "from_date", "until_date", "last_year", *metrics.names())
    )


def as_of(probes: DataFrame, intervals: DataFrame, last_rounds: int, entity: str = "DriverId", at: str = "at") -> DataFrame:
    """Every row of `probes` with the statistics its entity had on the date of `at`, a date
    or timestamp; null where it had none: before its first session, or when its newest season is more than
    SEASON_LAG before the year of the date.

    Repeated probes are repeated; columns of `probes` keep their names and must not be
    those of statistics.
    """
    day = F.to_date(F.col(at))
    number = F.unix_date(day)
    asked = probes.withColumns({"_day": day, "_bucket": F.floor(number / BUCKET_DAYS)})
    first, stop = F.unix_date("from_date"), F.unix_date("until_date") - 1
    buckets = F.sequence(F.floor(first / BUCKET_DAYS), F.floor(stop / BUCKET_DAYS))
    held = intervals.where(F.col("last_rounds") == last_rounds).select(
        F.col("DriverId").alias("_entity"), F.explode(buckets).alias("_in"), "from_date", "until_date", "last_year", *metrics.names()
    )
    match = (
        (F.col(entity) == F.col("_entity")) & (F.col("_bucket") == F.col("_in"))
        & (F.col("_day") >= F.col("from_date")) & (F.col("_day") < F.col("until_date"))
        & (F.year("_day") - F.col("last_year") <= schema.SEASON_LAG)
    )
    return asked.join(held, match, "left").select(*probes.columns, *metrics.names())
