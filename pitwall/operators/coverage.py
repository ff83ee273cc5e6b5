"""What is on record as of each date: rows, rounds, entities and who is eligible."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwall import schema
from pitwall.operators.calendar import calendar


def _first_seasons(results: DataFrame) -> DataFrame:
    """First date of each entity in each season."""
    return (
        results.where(F.col("DriverId").isNotNull() & F.col("Year").isNotNull() & F.col("Date").isNotNull())
        .groupBy("DriverId", "Year")
        .agg(F.to_date(F.min("Date")).alias("date"))
    )


def asof_sessions(results: DataFrame, year_stop: int | None = None) -> DataFrame:
    """(dt_ref, qty_rows, qty_rounds, qty_drivers) known by each as-of date.

    What becomes new on each date is counted and added up over the dates; no row is
    paired with the later dates that see it.
    """
    cal = calendar(results, year_stop)
    rows = cal.sessions.groupBy("date").agg(F.sum("rows").alias("new_rows"))
    rounds = (
        cal.sessions.where("Year IS NOT NULL AND RoundNumber IS NOT NULL")
        .groupBy("Year", "RoundNumber")
        .agg(F.min("date").alias("date"))
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("new_rounds"))
    )
    drivers = (
        results.where(F.col("DriverId").isNotNull() & F.col("Date").isNotNull())
        .groupBy("DriverId")
        .agg(F.to_date(F.min("Date")).alias("date"))
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("new_drivers"))
    )
    so_far = Window.orderBy("date")
    totals = (
        cal.dates.join(rows, "date", "left")
        .join(rounds, "date", "left")
        .join(drivers, "date", "left")
        .select(
            F.col("date").alias("dt_ref"),
            "in_spine",
            *[
                F.sum(F.coalesce(f"new_{what}", F.lit(0))).over(so_far).alias(f"qty_{what}")
                for what in ("rows", "rounds", "drivers")
            ],
        )
    )
    return totals.where("in_spine").drop("in_spine")


def eligible_drivers(results: DataFrame, year_stop: int | None = None) -> DataFrame:
    """(dt_ref, DriverId) of entities with a row known by then in one of the season's
    last SEASON_LAG + 1 seasons.

    An entity is eligible through its newest season so far. That changes at most once
    per season, and each stretch ends where the season grows too old, so the output is
    generated from a few stretches per entity.
    """
    cal = calendar(results, year_stop)
    firsts = (
        _first_seasons(results)
        .join(cal.dates.select("date", "pos"), "date")
        .join(cal.season_reach(), "Year")
        .select("DriverId", "Year", "pos", "reach")
    )
    order = Window.partitionBy("DriverId").orderBy("pos", "Year")
    stretches = firsts.select(
        "DriverId",
        F.max("Year").over(order).alias("last_year"),
        F.max("reach").over(order).alias("reach"),
        "pos",
        F.lead("pos").over(order).alias("next_pos"),
    ).select(
        "DriverId", "last_year", "pos", F.least("reach", F.coalesce(F.col("next_pos") - 1, F.col("reach"))).alias("last_pos")
    )
    return (
        stretches.where("last_pos >= pos")
        .withColumn("pos", F.explode(F.expr("sequence(pos, last_pos)")))
        .join(cal.spine(), "pos")
        .where(F.col("ref_year") - F.col("last_year") <= schema.SEASON_LAG)
        .select("dt_ref", "DriverId")
    )
