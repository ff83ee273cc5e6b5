"""As-of lookups on any date, and the stored statements, against their DataFrame forms."""

from __future__ import annotations

import datetime as dt

from pitwall.operators import asof, champions, features, intervals
from pitwall.plans import functions
from pitwall.session import stage
from pitwall.sources import layers
from pitwall.sources.fixture import results

from conftest import SF

ROWS = [
    ("a", "2000-03-01", 1, "Race", 1.0, 1.0, 25.0, "Finished"),
    ("a", "2000-05-01", 2, "Race", 2.0, 1.0, 18.0, "Finished"),
    ("b", "2001-03-01", 1, "Race", 3.0, 1.0, 15.0, "Finished"),
]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_probes_between_before_and_after_sessions(spark, make_results):
    states = stage(intervals.state_intervals(make_results(ROWS), [2]), "states")
    probes = [
        ("a", dt.datetime(2000, 2, 29, 23, 59)), ("a", dt.datetime(2000, 3, 1)), ("a", dt.datetime(2000, 4, 30, 23, 59)),
        ("a", dt.datetime(2000, 4, 30, 23, 59)), ("a", dt.datetime(2000, 12, 31)), ("a", dt.datetime(2001, 3, 1)),
        ("a", dt.datetime(2002, 12, 31)), ("a", dt.datetime(2003, 1, 1)), ("b", dt.datetime(2003, 12, 31)),
        ("b", dt.datetime(2004, 1, 1)), ("b", None), (None, dt.datetime(2001, 1, 1)), ("c", dt.datetime(2001, 1, 1)),
    ]
    df = spark.createDataFrame([(e, t, k) for k, (e, t) in enumerate(probes)], "who string, when timestamp, no int")
    found = intervals.as_of(df, states, 2, entity="who", at="when")
    got = {r["no"]: r["total_points"] for r in found.collect()}
    # The round of 2001 pushes the first of 2000 out of a window of two.
    assert got == {0: None, 1: 25.0, 2: 25.0, 3: 25.0, 4: 43.0, 5: 18.0, 6: 18.0, 7: None, 8: 15.0, 9: None, 10: None, 11: None, 12: None}
    assert found.columns[:3] == ["who", "when", "no"]


def test_the_lookup_is_an_equi_join(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        states = stage(intervals.state_intervals(results(spark, SF), [5]), "states")
        probes = results(spark, SF).select("DriverId", "Date")
        plan = _plan(intervals.as_of(probes, states, 5, at="Date"))
        assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_on_session_dates_the_lookup_equals_the_spread_table(spark):
    rows = results(spark, SF)
    states = stage(intervals.state_intervals(rows), "states")
    whole = asof.driver_statistic(rows, 40)
    again = intervals.as_of(whole.select("dt_ref", "DriverId"), states, 40, at="dt_ref").select(*whole.columns)
    assert whole.exceptAll(again).isEmpty() and again.exceptAll(whole).isEmpty()
    functions.publish_statistics(spark, rows, states)
    for stop in (1996, 2001):
        by_sql = spark.sql("SELECT * FROM driver_statistic(40, :stop)", args={"stop": stop})
        by_frame = asof.driver_statistic(rows, 40, stop)
        assert by_sql.exceptAll(by_frame).isEmpty() and by_frame.exceptAll(by_sql).isEmpty()
        assert "NestedLoop" not in _plan(by_sql)


def test_stored_statements_move_data_as_often_as_their_frames(spark):
    rows = results(spark, SF)
    layers.publish_view(rows, "results")
    by_sql = layers.run_query(spark, "champions", {"year_stop": 1997})
    by_frame = champions.champions(rows.where("Year <= 1997"))
    assert by_sql.exceptAll(by_frame).isEmpty() and by_frame.exceptAll(by_sql).isEmpty()
    assert _plan(by_sql).count("Exchange hash") == _plan(by_frame).count("Exchange hash")
    assert _plan(by_sql).count("WindowGroupLimit") == _plan(by_frame).count("WindowGroupLimit")
    wide, winners = stage(features.driver_all_statistic(rows), "wide"), stage(by_frame, "winners")
    layers.publish_view(wide, "driver_all_statistic")
    layers.publish_view(winners, "champions")
    by_sql, by_frame = layers.run_query(spark, "tb_abt"), features.label(wide, winners)
    assert by_sql.columns == by_frame.columns
    assert by_sql.exceptAll(by_frame).isEmpty() and by_frame.exceptAll(by_sql).isEmpty()
    assert _plan(by_sql).count("Exchange") == _plan(by_frame).count("Exchange")
