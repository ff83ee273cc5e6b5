"""The calendar: which rounds count for which as-of date.

Everything here works on one row per session date, never on result rows, so its size
follows the number of rounds ever held. The windows without PARTITION BY below number
the dates and rounds of that calendar.

A round is known from its first session date on. At an as-of date the known rounds are
ranked newest first, and a window of N keeps ranks up to N. As later rounds only ever
push a round down, each round is inside a window of N for one stretch of dates. That
stretch is what facts need: a row enters a window on its own date and leaves it when
its round drops out. No fact row is ever paired with the dates it is visible on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwall import schema
from pitwall.session import stage


def session_dates(results: DataFrame) -> DataFrame:
    """One row per (season, round, date) that has result rows. Rows without a date are
    never known, so they are left out."""
    return (
        results.select("Year", "RoundNumber", F.to_date("Date").alias("date"))
        .where(F.col("date").isNotNull())
        .groupBy("Year", "RoundNumber", "date")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def date_spine(results: DataFrame, year_stop: int | None = None) -> DataFrame:
    """Distinct (dt_ref, ref_year) up to and including season `year_stop`."""
    spine = results.where(F.col("Year").isNotNull() & F.col("Date").isNotNull())
    if year_stop is not None:
        spine = spine.where(F.col("Year") <= year_stop)
    return spine.select(F.to_date("Date").alias("dt_ref"), F.col("Year").alias("ref_year")).distinct()


@dataclass(frozen=True)
class Calendar:
    """`dates`: date, pos (1..n), n_dates, ref_year, in_spine. `sessions`: as staged."""

    sessions: DataFrame
    dates: DataFrame

    def spine(self) -> DataFrame:
        return self.dates.where("in_spine").select(F.col("date").alias("dt_ref"), "ref_year", "pos")

    def ranked_rounds(self, last_rounds: int) -> DataFrame:
        """(pos, Year, RoundNumber, rn) for every date and its newest `last_rounds` rounds.

        A round can only be among them until each of the next `last_rounds` rounds in
        season order is known, which bounds the dates it is tried for. The row number
        then settles it, also where rounds were held out of order.
        """
        order = Window.orderBy(F.col("Year").asc_nulls_first(), F.col("RoundNumber").asc_nulls_first())
        following = order.rowsBetween(1, last_rounds)
        rounds = (
            self.sessions.join(self.dates.select("date", "pos", "n_dates"), "date")
            .groupBy("Year", "RoundNumber")
            .agg(F.min("pos").alias("first_pos"), F.max("n_dates").alias("n_dates"))
        )
        tried = rounds.select(
            "Year",
            "RoundNumber",
            "first_pos",
            F.when(F.count(F.lit(1)).over(following) == last_rounds, F.max("first_pos").over(following) - 1)
            .otherwise(F.col("n_dates"))
            .alias("last_pos"),
        ).where("last_pos >= first_pos")
        newest = Window.partitionBy("pos").orderBy(
            F.col("Year").desc_nulls_last(), F.col("RoundNumber").desc_nulls_last()
        )
        return (
            tried.select("Year", "RoundNumber", F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))
            .withColumn("rn", F.row_number().over(newest))
            .where(F.col("rn") <= last_rounds)
        )

    def session_windows(self, windows: Sequence[int]) -> DataFrame:
        """(Year, RoundNumber, date, rows, pos, ref_year, in_spine, leave_N...): rows of a session
        date enter every window at `pos` and leave the window of N at `leave_N`, which is
        null where the round is already out of the window by then.

        Staged: facts are joined to it, and a join of joins looks far larger to the
        optimizer than it is. Read from its files, the table is broadcast while it is
        small and shuffled otherwise.
        """
        stays = (
            self.ranked_rounds(max(windows))
            .groupBy("Year", "RoundNumber")
            .agg(*[(F.max(F.when(F.col("rn") <= n, F.col("pos"))) + 1).alias(f"leave_{n}") for n in windows])
        )
        table = (
            self.sessions.join(self.dates, "date")
            .join(stays, ["Year", "RoundNumber"], "left")
            .select(
                "Year",
                "RoundNumber",
                "date",
                "rows",
                "pos",
                "ref_year",
                "in_spine",
                *[F.when(F.col(f"leave_{n}") > F.col("pos"), F.col(f"leave_{n}")).alias(f"leave_{n}") for n in windows],
            )
        )
        return stage(table, "session_windows")

    def season_reach(self) -> DataFrame:
        """(Year, reach): last position whose season is at most SEASON_LAG after Year."""
        seasons = (
            self.dates.where("ref_year IS NOT NULL")
            .groupBy(F.col("ref_year").alias("Year"))
            .agg(F.max("pos").alias("last_pos"))
        )
        upto = Window.orderBy("Year").rangeBetween(Window.unboundedPreceding, schema.SEASON_LAG)
        return seasons.select("Year", F.max("last_pos").over(upto).alias("reach"))


def spine_of(session_windows: DataFrame) -> DataFrame:
    """The as-of dates of a session window table: (dt_ref, ref_year, pos)."""
    return session_windows.where("in_spine").select(F.col("date").alias("dt_ref"), "ref_year", "pos").distinct()


def calendar(results: DataFrame, year_stop: int | None = None) -> Calendar:
    """Scan the results once for their session dates, stage those, number the dates."""
    return calendar_of(stage(session_dates(results), "sessions"), year_stop)


def calendar_of(sessions: DataFrame, year_stop: int | None = None) -> Calendar:
    """The calendar of a stored table of `session_dates`."""
    in_order = Window.orderBy("date")
    one_season = F.min("Year").eqNullSafe(F.max("Year"))
    dates = (
        sessions.groupBy("date")
        .agg(
            F.when(one_season, F.max("Year"))
            .otherwise(F.raise_error(F.lit("a session date belongs to two seasons")).cast("int"))
            .alias("ref_year")
        )
        .select(
            "date",
            "ref_year",
            F.row_number().over(in_order).alias("pos"),
            F.count(F.lit(1)).over(Window.partitionBy()).cast("int").alias("n_dates"),
            F.coalesce(F.col("ref_year") <= F.lit(year_stop), F.lit(False)).alias("in_spine")
            if year_stop is not None
            else F.col("ref_year").isNotNull().alias("in_spine"),
        )
    )
    return Calendar(sessions, dates)


def last_n_rounds(results: DataFrame, last_rounds: int, year_stop: int | None = None) -> DataFrame:
    """(dt_ref, Year, RoundNumber, rn): the newest rounds known on each as-of date."""
    cal = calendar(results, year_stop)
    return (
        cal.ranked_rounds(last_rounds)
        .join(cal.spine(), "pos")
        .select("dt_ref", "Year", "RoundNumber", "rn")
    )


def min_season_filter(results: DataFrame, year_stop: int) -> DataFrame:
    """Rows from the first season on record up to `year_stop`. The lower bound never
    removes a row that has a season, so only the upper one is applied."""
    return results.where(F.col("Year") <= year_stop)
