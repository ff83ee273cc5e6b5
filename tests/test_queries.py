"""Registered queries against their DuckDB statements, on the smallest test tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.compare import differences, duck

from conftest import SF
from pitwall import schema
from pitwall.operators import asof, intervals
from pitwall.plans import registry

ORACLES = entry.oracle_sql()


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in ORACLES])
def test_query_equals_its_statement(spark, name):
    ours = entry.queries()[name](spark, SF).toPandas()
    assert differences(ours, duck(SF).execute(ORACLES[name]).df()) == ""


@pytest.mark.parametrize("name", ["consolidate_windows", "consolidate_bucketed"])
def test_stored_windows_take_one_pass_and_no_gathering(spark, name, monkeypatch):
    passes, gathered = [], []
    states, beside = asof.window_states, asof._gathered
    monkeypatch.setattr(asof, "window_states", lambda rows, dates, windows: passes.append(tuple(windows)) or states(rows, dates, windows))
    monkeypatch.setattr(asof, "_gathered", lambda spread, windows: gathered.append(windows) or beside(spread, windows))
    entry.queries()[name](spark, SF)
    assert (passes, gathered) == ([schema.WINDOWS], [])


def test_stored_windows_are_set_side_by_side_where_they_lie(spark):
    plan = entry.queries()["consolidate_windows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange" not in plan, plan


def test_results_that_are_replaced_are_not_kept(spark):
    def folders():
        root = Path(spark.conf.get("spark.checkpoint.dir")) / "pitwall"
        return {p.name for p in root.glob("bronze-*")}

    before = folders()
    entry.queries()["silver_after_reload"](spark, SF)
    assert folders() == before


def test_a_lookup_in_one_window_builds_no_other(spark, monkeypatch):
    built, states = [], intervals.window_states
    monkeypatch.setattr(intervals, "window_states", lambda rows, dates, windows: built.append(list(windows)) or states(rows, dates, windows))
    entry.queries()["asof_any_date"](spark, SF)
    assert built == [[5]]


@pytest.mark.parametrize("name", ["scored_with_team", "first_team"])
def test_a_table_that_is_read_once_is_not_written_first(spark, name, monkeypatch):
    staged, write = [], registry.stage
    monkeypatch.setattr(registry, "_STORED", {})
    monkeypatch.setattr(registry, "stage", lambda df, *names: staged.append(names[0]) or write(df, *names))
    entry.queries()[name](spark, SF)
    assert sorted(staged) == ["champions", "entities"]


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 47 and df.count() > 0


def test_reading_order(spark):
    rows = entry.queries()["driver_statistic_ordered"](spark, SF).select("dt_ref", "DriverId").collect()
    assert rows == sorted(rows, key=lambda r: (-r["dt_ref"].toordinal(), r["DriverId"]))
