"""Point-in-time statistics: every entity over the last N rounds, as of every date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall import schema
from pitwall.functions import metrics
from pitwall.operators.calendar import calendar, spine_of

#: Result rows of a task that follows entities through their windows, on average. An entity is never divided.
ROWS_PER_TASK = 100_000
#: Result rows for each core from which on a split of the input may hold too many to add up at once.
ROWS_PER_CORE = 500_000


def entity_sessions(results: DataFrame) -> DataFrame:
    """Result rows added up to one row per entity, round, date and mode. Partial sums
    are taken before the shuffle, so an entity or round with very many rows is small
    by the time it moves."""
    return results.sparkSession.sql(
        f"""
        SELECT DriverId, Year, RoundNumber, to_date(Date) AS date, Mode, {", ".join(metrics.parts())}
        FROM {{results}}
        WHERE DriverId IS NOT NULL AND Date IS NOT NULL
        GROUP BY DriverId, Year, RoundNumber, to_date(Date), Mode
        """,
        results=results,
    )


def _in_small_parts(results: DataFrame, counted: int, tasks: int) -> DataFrame:
    """The rows as they are added up, dealt to `tasks` tasks where there are many for each core.

    Partial sums take 400 bytes or so for each entity and session date of a split, and a split of a large file holds millions
    of rows. Rows are dealt by all their values, so an entity, round or date with very many rows is still spread.
    """
    needed = ["DriverId", "Year", "RoundNumber", "Date", "Mode", "Status", "Position", "GridPosition", "Points"]
    if counted <= ROWS_PER_CORE * results.sparkSession.sparkContext.defaultParallelism:
        return results
    return results.select(*needed).repartition(tasks, *needed)


def _season_cover(visits: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Add, per window, where an entity's stay in a season starts and ends.

    The rows of one season cover stretches of dates that may overlap. `starts_N` is 1 on
    the row that opens a stretch, `ends_N` the position at which one closes. Each season
    then adds 1 to a running sum exactly while at least one of its rows is inside.
    """
    rows = "(PARTITION BY DriverId, Year ORDER BY enter ROWS BETWEEN UNBOUNDED PRECEDING AND {})"
    reach = []
    for n in windows:
        reach.append(f"max(leave_{n}) OVER {rows.format('CURRENT ROW')} AS reach_{n}")
        reach.append(f"max(leave_{n}) OVER {rows.format('1 PRECEDING')} AS before_{n}")
    next_enter = "lead(enter) OVER (PARTITION BY DriverId, Year ORDER BY enter) AS next_enter"
    stretches = []
    for n in windows:
        stretches.append(f"int(leave_{n} IS NOT NULL AND coalesce(before_{n} < enter, true)) AS starts_{n}")
        stretches.append(f"if(reach_{n} >= enter AND coalesce(next_enter > reach_{n}, true), reach_{n}, NULL) AS ends_{n}")
    return visits.selectExpr("*", *reach, next_enter).selectExpr(*visits.columns, *stretches)


def _changes(visits: DataFrame, windows: Sequence[int]) -> DataFrame:
    """The changes each row makes to a window: its parts are added where it enters and
    taken away where it leaves; a season is added and taken away at its own ends."""
    moves = []
    for n in windows:
        enter = f"if(leave_{n} IS NULL, NULL, enter)"
        moves.append(f"struct({n} AS last_rounds, {enter} AS pos, 1 AS sign, starts_{n} AS seasons)")
        moves.append(f"struct({n} AS last_rounds, leave_{n} AS pos, -1 AS sign, if(ends_{n} <=> leave_{n}, -1, 0) AS seasons)")
        # Only a season that another row holds longer, or that was out of the window before, ends on its own.
        moves.append(f"struct({n} AS last_rounds, if(ends_{n} <=> leave_{n}, NULL, ends_{n}) AS pos, 0 AS sign, -1 AS seasons)")
    return (
        visits.selectExpr("DriverId", "Year", "Mode", *metrics.part_names(), f"inline(array({', '.join(moves)}))")
        .where("pos IS NOT NULL")
        # Sorted before the windows lay out a column for each statistic's part by mode.
        .sortWithinPartitions("DriverId", "last_rounds", "pos")
        .selectExpr(
            "DriverId",
            "last_rounds",
            "pos",
            "seasons",
            "if(sign = 1, Year, NULL) AS entered_year",
            "Mode",
            # Not a product: that would cut the digits of a decimal.
            *[f"CASE sign WHEN 1 THEN {name} WHEN -1 THEN -{name} ELSE 0 END AS {name}" for name in metrics.part_names()],
        )
    )


def entity_tasks(results: DataFrame, session_windows: DataFrame) -> tuple[int, int]:
    """The result rows that the calendar has counted, and how many tasks follow the entities through them.

    The sorts there hold several wide rows for each row of the shuffle, whose bytes say little of them."""
    counted = session_windows.agg(F.sum("rows")).first()[0] or 0
    return counted, max(results.sparkSession.sparkContext.defaultParallelism, -(-counted // ROWS_PER_TASK))


def window_states(results: DataFrame, session_windows: DataFrame, windows: Sequence[int]) -> DataFrame:
    """(DriverId, last_rounds, pos, until, last_year, 45 statistics): the statistics an
    entity has from date position `pos` up to, not including, `until`.

    Work grows with the result rows and not with rows times visible dates: each row
    changes a running sum twice per window. After the one shuffle to DriverId all
    windowing stays inside the partition; an entity holds at most a few rows per
    session date there, however many result rows it had.
    """
    stays = session_windows.select(
        "Year", "RoundNumber", "date", F.col("pos").alias("enter"), *[f"leave_{n}" for n in windows]
    )
    counted, tasks = entity_tasks(results, session_windows)
    visits = entity_sessions(_in_small_parts(results, counted, tasks)).join(stays, ["Year", "RoundNumber", "date"]).repartition(tasks, "DriverId")
    changes = _changes(_season_cover(visits, windows), windows)
    entity = "PARTITION BY DriverId, last_rounds ORDER BY pos"
    so_far = f"({entity} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    states = changes.selectExpr(
        "DriverId",
        "last_rounds",
        "pos",
        f"lead(pos) OVER ({entity}) AS until",
        f"max(entered_year) OVER {so_far} AS last_year",
        f"sum(seasons) OVER {so_far} AS qty_seasons",
        *[f"sum({value}) OVER {so_far} AS {name}" for name, value in metrics.scoped()],
    )
    # Of the changes on one position only the last spans any time, and it holds them all.
    return states.where("n_sessions > 0 AND until > pos").selectExpr(
        "DriverId", "last_rounds", "pos", "until", "last_year", *metrics.finals()
    )


def _spread(states: DataFrame) -> DataFrame:
    """One row per date position a state holds on."""
    return states.withColumn("pos", F.explode(F.expr("sequence(pos, until - 1)")))


def _as_of(spread: DataFrame, session_windows: DataFrame) -> DataFrame:
    """Positions to as-of dates, eligible entities only. Rounds are ranked by season
    first, so the newest season inside a window is the entity's newest of all."""
    return spread.join(spine_of(session_windows), "pos").where(F.col("ref_year") - F.col("last_year") <= schema.SEASON_LAG)


def driver_statistic(results: DataFrame, last_rounds: int, year_stop: int | None = None) -> DataFrame:
    """The 45 statistics of every eligible entity over its last `last_rounds` rounds,
    one row per (dt_ref, DriverId)."""
    sessions = calendar(results, year_stop).session_windows([last_rounds])
    spread = _spread(window_states(results, sessions, [last_rounds]))
    return _as_of(spread, sessions).select(*schema.FEATURE_KEY, *metrics.names())


def statistics_by_window(
    results: DataFrame,
    windows: Sequence[int] = schema.WINDOWS,
    year_stop: int | None = None,
    session_windows: DataFrame | None = None,
) -> DataFrame:
    """The rows of `driver_statistic` for every window length in one pass, told apart by `last_rounds`.

    For tables of single windows: nothing is set side by side, so no row is gathered. Rows stay with the task of their
    entity, one of `entity_tasks` by the hash of the entity. `session_windows`: the calendar's, if there already."""
    sessions = session_windows or calendar(results, year_stop).session_windows(windows)
    spread = _spread(window_states(results, sessions, windows))
    return _as_of(spread, sessions).select("last_rounds", *schema.FEATURE_KEY, *metrics.names())


def in_reading_order(statistics: DataFrame) -> DataFrame:
    """Newest dates first, for reading. Tables are written unsorted: a total order costs
    a shuffle of every row and is gone with the next read."""
    return statistics.orderBy(F.col("dt_ref").desc(), "DriverId")


def all_windows(
    results: DataFrame, windows: Sequence[int] = schema.WINDOWS, year_stop: int | None = None
) -> DataFrame:
    """All window lengths in one pass: (dt_ref, DriverId, every statistic per window).

    A row exists where the entity has rows in the longest window; the statistics of a
    window it is absent from are null. The windows of an entity and date already share
    a partition, so setting them side by side moves no data.
    """
    sessions = calendar(results, year_stop).session_windows(windows)
    spread = _spread(window_states(results, sessions, windows))
    return _as_of(_gathered(spread, windows), sessions).select(*schema.FEATURE_KEY, *suffixed(windows))


def windows_of_seasons(
    results: DataFrame, session_windows: DataFrame, windows: Sequence[int], seasons: Sequence[int]
) -> DataFrame:
    """`all_windows` on the as-of dates of these seasons alone, with the column `season`.

    `results` must hold all rows of the rounds that the longest window reaches on those
    dates; other rows change nothing. States are cut to the stretch from the first to the
    last of the dates before they are spread.
    """
    dates = session_windows.where(F.col("in_spine") & F.col("ref_year").isin(*seasons))
    first, last = dates.agg(F.min("pos"), F.max("pos")).first()
    if first is None:
        first, last = 1, 0
    states = window_states(results, session_windows, windows).where(f"pos <= {last} AND until > {first}")
    cut = states.withColumns({"pos": F.greatest("pos", F.lit(first)), "until": F.least("until", F.lit(last + 1))})
    found = _as_of(_gathered(_spread(cut), windows), dates)
    return found.select(F.col("ref_year").alias("season"), *schema.FEATURE_KEY, *suffixed(windows))


def _gathered(spread: DataFrame, windows: Sequence[int]) -> DataFrame:
    """The windows of an entity and position side by side."""
    # One element per window length, so the list is as short as `windows`.
    gathered = spread.groupBy("DriverId", "pos").agg(
        F.max("last_year").alias("last_year"),
        F.expr(f"collect_list(struct(last_rounds, {', '.join(metrics.names())}))").alias("found"),
    )
    return gathered.selectExpr(
        "DriverId",
        "pos",
        "last_year",
        *[f"try_element_at(filter(found, w -> w.last_rounds = {n}), 1) AS w_{n}" for n in windows],
    ).selectExpr("DriverId", "pos", "last_year", *[f"w_{n}.{name} AS {name}_{n}" for n in windows for name in metrics.names()])


def suffixed(windows: Sequence[int]) -> list[str]:
    return [f"{name}_{n}" for n in windows for name in metrics.names()]


def one_window(wide: DataFrame, last_rounds: int, keys: Sequence[str] = schema.FEATURE_KEY) -> DataFrame:
    """The table of one window length, cut out of `all_windows` without moving rows."""
    present = wide.where(F.col(f"qty_sessions_{last_rounds}").isNotNull())
    return present.select(
        *keys, *[F.col(f"{name}_{last_rounds}").alias(name) for name in metrics.names()]
    )
