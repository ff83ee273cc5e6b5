"""Champions, labels, sampling, splits, profiles, curves and serving tables."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from pitwall.operators import champions, features, ranking, serving


def test_champion_ties_and_missing_points(make_results):
    win = ("Race", 1.0, 1.0)
    results = make_results(
        [
            ("b", "2019-03-01", 1, *win, 10.0, "Finished"),
            ("a", "2019-03-01", 1, "Sprint", 1.0, 1.0, 4.0, "Finished"),
            ("a", "2019-03-02", 1, *win, 6.0, "Finished"),
            ("c", "2020-03-01", 1, *win, None, "Finished"),
            ("d", "2020-03-01", 1, *win, 0.0, "Finished"),
        ]
    )
    rows = {r["Year"]: r for r in champions.champions(results).collect()}
    assert rows[2019]["DriverId"] == "a" and rows[2019]["total_points"] == 10.0
    assert rows[2020]["DriverId"] == "d"
    assert all(r["rank_driver"] == 1 for r in rows.values())


def test_label_marks_the_champion_on_all_its_dates(spark):
    table = spark.createDataFrame(
        [(dt.date(2019, 1, 1), "a"), (dt.date(2019, 2, 1), "a"), (dt.date(2019, 2, 1), "b"), (dt.date(2020, 1, 1), "a")],
        "dt_ref date, DriverId string",
    )
    winners = spark.createDataFrame([(2019, "a", 9.0, 1)], "Year int, DriverId string, total_points double, rank_driver int")
    rows = features.label(table, winners).collect()
    assert sum(r["flChampion"] for r in rows) == 2 and len(rows) == 4


def _abt(spark):
    days = [dt.date(y, m, 1) for y in (2022, 2023, 2024, 2025) for m in range(1, 9)]
    rows = [(d, x, int(x == "a"), float(i) if i % 3 else None) for i, d in enumerate(days) for x in "ab"]
    return spark.createDataFrame(rows, "dt_ref date, DriverId string, flChampion int, avg_x_5 double")


def test_sampling_and_splits(spark):
    abt = _abt(spark)
    kept = features.season_tail_sampling(abt)
    assert kept.select("dt_ref").distinct().count() == 4 * 3
    split = features.temporal_split(abt, 2024, 2024, 2025)
    sizes = {r["split"]: (r["rows"], r["columns"]) for r in features.split_sizes(abt, split).collect()}
    assert sizes == {"all": (64, 4), "train": (12, 4), "test": (6, 4), "oot": (16, 4)}
    assert features.training_matrix(split).columns == ["split", "dt_ref", "DriverId", "flChampion", "avg_x_5"]


def test_nulls_are_profiled_and_filled(spark):
    abt = _abt(spark)
    assert [tuple(r) for r in features.null_profile(abt).collect()] == [("avg_x_5", 22)]
    filled = features.impute_sentinel(abt)
    assert filled.where("avg_x_5 = -10000").count() == 22
    assert filled.dtypes == abt.dtypes


@pytest.mark.parametrize("levels", [3, 5000])
def test_auc_and_curve(spark, levels):
    draw = random.Random(levels)
    data = [(draw.randint(0, levels) / 7, int(draw.random() < 0.3), draw.choice("xy")) for _ in range(3000)]
    scored = spark.createDataFrame(data, "score double, label int, part string")
    ours = {r["part"]: r["auc"] for r in ranking.roc_auc(scored, "score", "label", ["part"]).collect()}
    for part, auc in ours.items():
        rows = [(s, y) for s, y, p in data if p == part]
        pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
        pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert auc == pytest.approx(pairs / len(pos) / len(neg), abs=1e-12)
    whole = ranking.roc_auc(scored, "score", "label").first()["auc"]
    judge = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert whole == pytest.approx(judge.evaluate(scored), abs=1e-9)

    full = ranking.roc_curve(scored, "score", "label", drop_intermediate=False).orderBy(F.desc("threshold")).collect()
    assert (full[0]["fpr"], full[0]["tpr"]) == (0.0, 0.0) and (full[-1]["fpr"], full[-1]["tpr"]) == (1.0, 1.0)
    expected = _corners(data)
    short = ranking.roc_curve(scored, "score", "label").where("threshold < double('infinity')").orderBy(F.desc("threshold"))
    assert [r["threshold"] for r in short.collect()] == expected


def _corners(data):
    """Thresholds at which the curve bends, by comparing each step with the next."""
    steps = {}
    for score, y, _ in data:
        pos, neg = steps.get(score, (0, 0))
        steps[score] = (pos + y, neg + 1 - y)
    order = sorted(steps, reverse=True)
    last = len(order) - 1
    return [s for i, s in enumerate(order) if i in (0, last) or steps[order[i + 1]] != steps[s]]


def test_auc_of_one_class_is_null(spark):
    scored = spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, label int")
    assert ranking.roc_auc(scored, "score", "label").first()["auc"] is None


def test_serving_tables(spark):
    day = [dt.date(2020, 1, 1), dt.date(2020, 2, 1)]
    rows = [
        (day[0], "a", 2020, 0.5, "a_t", "#111111"), (day[1], "a", 2020, 0.7, "a_t", "#111111"),
        (day[0], "b", 2020, 0.1, None, "#ffffff"), (day[1], "b", 2020, 0.9, "b_u", "#222222"),
        (day[1], "c", 2020, 0.7, "c_u", "#222222"),
    ]
    scored = spark.createDataFrame(
        rows, "dt_ref date, DriverId string, Year int, prob_win double, driver_team_id string, TeamColor string"
    )
    assert [r["DriverId"] for r in serving.top_probability(scored, 3).collect()] == ["b", "a", "c"]
    # The first row of b has no team, so b is left out.
    assert {r["driver_team_id"] for r in serving.first_team(scored).collect()} == {"a_t", "c_u"}
    chosen = serving.filter_entities_seasons(scored, ["a_t", "b_u"], [2020])
    pivot = serving.pivot_probability(chosen, ["b_u", "a_t"]).orderBy("dt_ref")
    assert pivot.columns == ["dt_ref", "a_t", "b_u"]
    assert [tuple(r)[1:] for r in pivot.collect()] == [(0.5, None), (0.7, 0.9)]
    colors = serving.color_lookup(chosen, ["b_u", "nobody", "a_t"]).collect()
    assert [(r["driver_team_id"], r["TeamColor"]) for r in colors] == [
        ("b_u", "#222222"), ("nobody", None), ("a_t", "#111111")
    ]
    assert [tuple(r) for r in serving.season_domain(scored).collect()] == [(2020, True)]


def test_entity_dimension_takes_the_latest_team(make_results):
    rows = make_results([("a", "2019-03-01", 1, "Race", 1.0, 1.0, 1.0, "x"), ("a", "2020-03-01", 1, "Race", 1.0, 1.0, 1.0, "x")])
    moved = rows.withColumn("TeamId", F.when(F.col("Year") == 2020, "new").otherwise("old"))
    assert [(r["DriverId"], r["TeamId"], r["TeamColor"]) for r in serving.entity_dimension(moved).collect()] == [
        ("a", "new", "#aabbcc")
    ]
