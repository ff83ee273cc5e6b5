"""As-of statistics against the plain definition, on hand-made and random results."""

from __future__ import annotations

import datetime as dt
import math
import random
from fractions import Fraction

import duckdb
import pytest

from checks import literal as L
from checks.compare import differences
from pitwall.functions import metrics
from pitwall.operators import asof, calendar, coverage, features
from pitwall.sources import layers

LIMITED = L.KNOWN.replace("FROM results)", "FROM results WHERE Year IS NOT NULL AND Date IS NOT NULL)", 1)


def plain(results, select, *ctes):
    con = duckdb.connect()
    frame = results.toPandas()
    con.register("results_frame", frame)
    con.execute(
        "CREATE TABLE results AS SELECT * REPLACE (CAST(Year AS INTEGER) AS Year, CAST(RoundNumber AS INTEGER) AS "
        "RoundNumber, CAST(Date AS TIMESTAMP) AS Date, CAST(Position AS DOUBLE) AS Position, CAST(GridPosition AS DOUBLE) "
        "AS GridPosition, CAST(Points AS DOUBLE) AS Points) FROM results_frame"
    )
    con.execute(
        "UPDATE results SET Position = CASE WHEN isnan(Position) THEN NULL ELSE Position END, "
        "GridPosition = CASE WHEN isnan(GridPosition) THEN NULL ELSE GridPosition END, "
        "Points = CASE WHEN isnan(Points) THEN NULL ELSE Points END"
    )
    return con.execute(L.query(LIMITED, *ctes, select=select)).df()


def random_rows(seed):
    """Few entities over several seasons; rounds held out of order and over several
    dates, entities that pause for seasons, missing values everywhere."""
    draw = random.Random(seed)
    rows = []
    for year in range(2000, 2000 + draw.randint(3, 7)):
        for number in range(1, draw.randint(2, 5)):
            start = dt.date(year, draw.randint(1, 12), draw.randint(1, 28))
            for mode in draw.sample(["Race", "Sprint", None], draw.randint(1, 2)):
                day = min(start + dt.timedelta(days=draw.choice([0, 0, 1, 40])), dt.date(year, 12, 31))
                for driver in "abcdef":
                    if (seed * 7 + ord(driver) * 3 + year) % 3 and draw.random() < 0.7:
                        for _ in range(draw.choice([1, 1, 2])):
                            rows.append(
                                (
                                    draw.choice([driver] * 9 + [None]),
                                    day,
                                    draw.choice([number] * 15 + [None]),
                                    mode,
                                    draw.choice([None, 1.0, 2.0, 3.0, 4.0, 6.0]),
                                    draw.choice([None, 1.0, 2.0, 5.0, 9.0]),
                                    draw.choice([None, 0.0, 0.5, 8.0, 25.0]),
                                    draw.choice(["Finished", "+1 Lap", "Retired", "1 + 1", None]),
                                )
                            )
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
@pytest.mark.parametrize("n", [1, 3, 8])
def test_random_results_match_the_definition(make_results, seed, n):
    # In two of the fixtures some dates belong to the season before.
    shift = (lambda d: d.year - (d.toordinal() % 5 == 0)) if seed > 2 else None
    results = make_results(random_rows(seed), shift)
    ours = asof.driver_statistic(results, n).toPandas()
    assert differences(ours, plain(results, f"SELECT * FROM stat_{n}", L.statistic(n))) == ""


@pytest.mark.parametrize("seed", [5, 6])
def test_calendar_and_coverage_match_the_definition(make_results, seed):
    results = make_results(random_rows(seed), (lambda d: d.year - (d.toordinal() % 5 == 0)) if seed == 6 else None)
    ours = calendar.last_n_rounds(results, 4).toPandas()
    ranks = "SELECT dt_ref, Year, RoundNumber, place AS rn FROM standing WHERE place <= 4"
    assert differences(ours, plain(results, ranks)) == ""
    ours = coverage.eligible_drivers(results).toPandas()
    assert differences(ours, plain(results, "SELECT dt_ref, DriverId FROM latest WHERE season >= ref_year - 2 AND DriverId IS NOT NULL")) == ""
    ours = coverage.asof_sessions(results).toPandas()
    counts = """SELECT dt_ref, COUNT(*) AS qty_rows, COUNT(DISTINCT DriverId) AS qty_drivers,
                COUNT(DISTINCT Year * 100 + RoundNumber) AS qty_rounds FROM spine JOIN results ON CAST(Date AS DATE) <= dt_ref GROUP BY dt_ref"""
    assert differences(ours, plain(results, counts)) == ""


def test_wide_equals_joined_windows(make_results):
    results = make_results(random_rows(7))
    windows = (1, 2, 5)
    wide = features.driver_all_statistic(results, windows)
    joined = features.side_by_side({n: asof.driver_statistic(results, n) for n in windows})
    assert wide.columns == joined.columns
    assert len(wide.columns) == 2 + 45 * 3
    assert differences(wide.toPandas(), joined.toPandas()) == ""
    superset = asof.all_windows(results, windows)
    for n in windows:
        one = asof.one_window(superset, n)
        assert differences(one.toPandas(), asof.driver_statistic(results, n).toPandas()) == ""


@pytest.mark.parametrize("seed", [5, 7])
def test_windows_of_one_pass_equal_single_ones(make_results, seed):
    results = make_results(random_rows(seed))
    found = asof.statistics_by_window(results, (1, 2, 5))
    for n in (1, 2, 5):
        one = found.where(f"last_rounds = {n}").drop("last_rounds")
        assert differences(one.toPandas(), asof.driver_statistic(results, n).toPandas()) == ""


@pytest.mark.parametrize("seed", [6, 8])
def test_one_store_of_all_windows_gives_the_joined_table(spark, make_results, tmp_path, seed):
    rows = make_results(random_rows(seed))
    sessions = calendar.calendar(rows).session_windows((1, 2, 5))
    statistics, (_, buckets) = asof.statistics_by_window(rows, (1, 2, 5), session_windows=sessions), asof.entity_tasks(rows, sessions)
    name = layers.save_as_dealt(statistics, str(tmp_path), f"dealt_{seed}", ["DriverId"], buckets, "last_rounds")
    # A task writes one file a window, at most.
    assert all(len([*folder.glob("*.parquet")]) <= buckets for folder in (tmp_path / name).glob("last_rounds=*"))
    found = features.side_by_side(spark.table(name), windows=(1, 2, 5))
    joined = features.side_by_side({n: asof.driver_statistic(rows, n) for n in (1, 2, 5)})
    assert found.columns == joined.columns
    assert differences(found.toPandas(), joined.toPandas()) == ""
    spark.sql(f"DROP TABLE {name}")


ROW = ("Race", 1.0, 2.0, 25.0, "Finished")


def stat(results, n, driver, date):
    rows = asof.driver_statistic(results, n).where(f"DriverId = '{driver}' AND dt_ref = DATE'{date}'").collect()
    return rows[0] if rows else None


def test_round_with_only_its_sprint_held_takes_a_rank(make_results):
    results = make_results(
        [("a", "2020-03-01", 1, *ROW), ("b", "2020-03-07", 2, "Sprint", 1.0, 1.0, 8.0, "Finished"), ("a", "2020-03-08", 2, *ROW)]
    )
    assert stat(results, 1, "a", "2020-03-07") is None
    assert stat(results, 1, "b", "2020-03-07")["qty_sessions_s"] == 1
    assert stat(results, 1, "a", "2020-03-08")["qty_sessions"] == 1
    assert stat(results, 2, "a", "2020-03-07")["qty_sessions"] == 1


def test_entity_away_two_seasons_stays_three_leaves(make_results):
    rows = [("a", "2015-01-10", 1, *ROW)] + [("b", f"{y}-06-10", 1, *ROW) for y in range(2015, 2019)]
    results = make_results(rows)
    assert stat(results, 50, "a", "2017-06-10")["qty_sessions"] == 1
    assert stat(results, 50, "a", "2018-06-10") is None


def test_nulls_and_modes_in_averages(make_results):
    results = make_results(
        [
            ("a", "2020-03-01", 1, "Race", None, 3.0, None, "Retired"),
            ("a", "2020-03-01", 1, "Sprint", 4.0, None, None, "+2 Laps"),
            ("a", "2020-03-01", 1, None, 2.0, 1.0, None, None),
        ]
    )
    row = stat(results, 5, "a", "2020-03-01")
    assert row["total_points"] is None
    assert row["total_points_r"] == 0.0  # rows of other modes count as 0
    assert row["avg_position"] == 3.0
    assert row["avg_position_s"] == 1.33  # (0 + 4 + 0) / 3
    assert row["avg_position_r"] == 0.0  # the race position is missing, two zeros remain
    assert row["avg_overtake"] == -1.0
    assert row["qty_sessions_finished"] == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sums_recover_after_any_value(make_results, seed):
    """One row a round: the sum of a window is that of its last rounds, whatever left it before."""
    draw = random.Random(seed)
    values = [None, 0.0, 3.0, 0.1, 0.2, 1 / 3, -7.5, 1e17, -1e17, math.inf, -math.inf, math.nan]
    points = [draw.choice(values) for _ in range(60)]
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=5 * i) for i in range(60)]
    grid = [p if p is None or not math.isfinite(p) else float(draw.choice([1, 2, 20, 10**8])) for p in points]
    rows = [("a", d, i + 1, "Race", 1.0, g, p, "Finished") for i, (d, g, p) in enumerate(zip(days, grid, points))]
    results = make_results(rows)
    found = {r["dt_ref"]: r for r in asof.driver_statistic(results, 2).collect()}
    for i, day in enumerate(days):
        held = [p for p in points[max(i - 1, 0) : i + 1] if p is not None]
        finite = [Fraction(repr(p)) for p in held if math.isfinite(p)]
        odd = sum(p for p in held if not math.isfinite(p))
        if not held:
            assert found[day]["total_points"] is None and found[day]["avg_gridposition"] is None
            continue
        expected = odd or float(sum(finite))
        for name in ("total_points", "total_points_r"):
            assert found[day][name] == pytest.approx(expected, rel=1e-14, abs=1e-14, nan_ok=True), (day, held)
        places = [g for g in grid[max(i - 1, 0) : i + 1] if g is not None]
        average = found[day]["avg_gridposition"]
        assert average == pytest.approx(sum(places) / len(places), rel=1e-14, nan_ok=True)


@pytest.mark.parametrize("place, points", [(1.0, 1e18), (2e9, 1.0)])
def test_values_no_sum_can_hold_are_refused(make_results, place, points):
    with pytest.raises(Exception, match="too large"):
        asof.driver_statistic(make_results([("a", "2020-03-01", 1, "Race", place, 1.0, points, "Finished")]), 5).collect()


def test_fractions_leave_no_rest(make_results):
    rows = [("a", f"2020-01-{d:02d}", d, "Race", 1.0, 1.0, 0.1 * d if d < 6 else 0.0, "Finished") for d in range(1, 12)]
    results = make_results(rows)
    assert stat(results, 5, "a", "2020-01-10")["total_points"] == 0.0
    assert stat(results, 5, "a", "2020-01-04")["total_points"] == 1.0


def test_year_stop_limits_the_dates_only(make_results):
    results = make_results([("a", f"{y}-06-10", 1, *ROW) for y in (2015, 2016, 2017)])
    dates = [str(r["dt_ref"]) for r in asof.driver_statistic(results, 5, year_stop=2016).collect()]
    assert sorted(dates) == ["2015-06-10", "2016-06-10"]


def test_later_rows_do_not_change_earlier_dates(make_results):
    rows = random_rows(8)
    days = sorted({r[1] for r in rows})
    cut = days[len(days) // 2]
    whole = asof.driver_statistic(make_results(rows), 3).where(f"dt_ref <= DATE'{cut}'").toPandas()
    early = asof.driver_statistic(make_results([r for r in rows if r[1] <= cut]), 3).toPandas()
    assert differences(whole, early) == ""


def test_date_in_two_seasons_is_refused(make_results):
    results = make_results([("a", "2020-03-01", 1, *ROW)]).union(make_results([("b", "2020-03-01", 1, *ROW)], lambda d: 2019))
    with pytest.raises(Exception, match="two seasons"):
        asof.driver_statistic(results, 5).collect()


def test_places_add_up_and_windows_grow(make_results):
    wide = features.driver_all_statistic(make_results(random_rows(9)), (2, 5)).toPandas()
    assert (wide.qty_place_2 == wide.qty_1place_2 + wide.qty_2place_2 + wide.qty_3place_2).all()
    assert (wide.qty_sessions_2 <= wide.qty_sessions_5).all()
    assert not wide.duplicated(["dt_ref", "DriverId"]).any()


def test_column_names():
    assert len(metrics.names()) == 45
    assert metrics.names()[0] == "qty_seasons"
    assert metrics.names()[-1] == "qty_gridpos5_S"


def test_no_cartesian_or_nested_loop(make_results):
    df = asof.driver_statistic(make_results(random_rows(1)), 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_partitions_follow_the_result_rows_and_not_their_bytes(spark, make_results, monkeypatch):
    rows = [(f"d{i}", f"{2000 + k}-05-01", 1, "Race", 1.0, 2.0, 8.0, "Finished") for i in range(20) for k in range(3)]
    results = make_results(rows)
    sessions = calendar.calendar(results).session_windows([5, 10])
    monkeypatch.setattr(asof, "ROWS_PER_TASK", 5, raising=False)
    assert asof.window_states(results, sessions, [5, 10]).rdd.getNumPartitions() == 12


def test_a_season_costs_no_event_of_its_own_where_its_last_row_leaves(spark, make_results):
    rows = [("a", f"{2000 + k}-05-01", 1, "Race", 1.0, 2.0, 8.0, "Finished") for k in range(4)]
    results = make_results(rows)
    sessions = calendar.calendar(results).session_windows([2]).withColumnRenamed("pos", "enter")
    visits = asof.entity_sessions(results).join(sessions, ["Year", "RoundNumber", "date"])
    changes = asof._changes(asof._season_cover(visits, [2]), [2])
    assert changes.count() == 8
    assert changes.agg({"seasons": "sum"}).first()[0] == 0


@pytest.mark.parametrize("seed", [3, 8])
def test_many_rows_for_each_core_are_dealt_before_they_are_added_up(make_results, monkeypatch, seed):
    results = make_results(random_rows(seed) * 2)
    expected = asof.all_windows(results, [2, 3]).toPandas()
    monkeypatch.setattr(asof, "ROWS_PER_CORE", 0)
    assert differences(asof.all_windows(results, [2, 3]).toPandas(), expected) == ""


def test_the_rows_of_one_entity_and_round_are_dealt_to_all_tasks(make_results, monkeypatch):
    rows = [("a", "2001-03-01", 1, "Race", float(i % 20), float(i % 9), float(i % 7), "Finished") for i in range(2000)]
    results = make_results(rows).coalesce(1)
    assert asof._in_small_parts(results, 2000, 8).rdd.getNumPartitions() == 1
    monkeypatch.setattr(asof, "ROWS_PER_CORE", 100)
    dealt = asof._in_small_parts(results, 2000, 8).rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(dealt) == 2000 and len(dealt) == 8 and max(dealt) < 600
