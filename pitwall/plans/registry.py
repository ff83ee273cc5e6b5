"""Every operator as a named query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall import schema
from pitwall.functions import scalars
from pitwall.operators import asof, calendar, coverage, features, forest, intervals, ranking, serving
from pitwall.operators import champions as season
from pitwall.plans import functions, jobs, seasons
from pitwall.session import remove_folder, stage, staging_path
from pitwall.sources import layers, published, raw
from pitwall.sources.fixture import publish_files, results, table
from pitwall.streaming.ingest import ingest
from pitwall.streaming.ledger import read_ledger, session_digests, unchanged_sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Split years that suit the seasons of the test data.
SPLIT = {"train_before": 2000, "test_year": 2000, "oot_year": 2001}
# A tree small enough for SQL to check: one split over all rows, on features of few values.
STUMP = ["qty_1place_5", "qty_place_5", "qty_seasons_40", "qty_poli_win_20", "qty_sessions_with_points_10"]
STUMP_SETTINGS = {"trees": 1, "max_depth": 1, "bootstrap": False, "subset": "all", "balanced": True}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _abt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir)
    winners = stage(season.champions(rows), "champions")
    return features.label(features.driver_all_statistic(rows), winners)


_STORED: dict[tuple[str, str], DataFrame] = {}


def stored_abt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table as later jobs find it: written once for a session and folder, read by every query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = stage(_abt(spark, sf_dir), "abt")
    return _STORED[key]


def _scored(spark: SparkSession, sf_dir: str, abt: DataFrame | None = None) -> DataFrame:
    """The whole labelled table with a fixed formula in place of the model, so SQL can check it. Queries that read it
    once pass the table itself: it is not written first."""
    abt = serving.add_row_id(stored_abt(spark, sf_dir) if abt is None else abt).withColumn(
        "prob_win", F.col("total_points_5") / (1.0 + F.col("total_points_10"))
    )
    return serving.scored_with_team(abt, stage(serving.entity_dimension(results(spark, sf_dir)), "entities"))


# --- season results -----------------------------------------------------------------


@query
def season_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.season_points(results(spark, sf_dir))


@query
def champions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season.champions(results(spark, sf_dir))


# --- as-of calendar -----------------------------------------------------------------


@query
def date_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.date_spine(results(spark, sf_dir))


@query
def last_n_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.last_n_rounds(results(spark, sf_dir), 50)


@query
def asof_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.asof_sessions(results(spark, sf_dir))


@query
def eligible_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.eligible_drivers(results(spark, sf_dir))


@query
def min_season_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = calendar.min_season_filter(results(spark, sf_dir), 1999)
    return kept.groupBy("Year", "Mode").agg(F.count(F.lit(1)).alias("rows"))


@query
def season_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers.publish_view(results(spark, sf_dir), "results")
    return layers.run_query(spark, "season_rounds", {"year_start": 1980, "year_stop": 2000})


# --- statistics ---------------------------------------------------------------------


def _register_statistic(n: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return asof.driver_statistic(results(spark, sf_dir), n)

    QUERIES[f"driver_statistic_{n}"] = run


for _n in schema.WINDOWS:
    _register_statistic(_n)


@query
def driver_statistic_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.in_reading_order(asof.driver_statistic(results(spark, sf_dir), 5))


@query
def driver_all_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.driver_all_statistic(results(spark, sf_dir))


def _stored_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One store with a folder for each window length, all written in one pass over the results by the tasks that follow
    the entities, a bucket each: setting windows side by side by entity and date moves no row."""
    rows = results(spark, sf_dir)
    sessions = calendar.calendar(rows).session_windows(schema.WINDOWS)
    statistics, (_, buckets) = asof.statistics_by_window(rows, session_windows=sessions), asof.entity_tasks(rows, sessions)
    root, name = staging_path(spark, "statistics"), f"statistics_{uuid.uuid4().hex[:12]}"
    return spark.table(layers.save_as_dealt(statistics, root, name, ["DriverId"], buckets, "last_rounds"))


def _stored_windows(spark: SparkSession, sf_dir: str) -> dict[int, DataFrame]:
    """A stored table for each window length."""
    stored = _stored_statistics(spark, sf_dir)
    return {n: stored.where(F.col("last_rounds") == n).drop("last_rounds") for n in schema.WINDOWS}


@query
def consolidate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table from stored per-window tables, as the layer job's tables allow."""
    return features.side_by_side(_stored_statistics(spark, sf_dir))


@query
def consolidate_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table from catalog tables found by name, each dealt into buckets of the same keys."""
    root, prefix = staging_path(spark, "bucketed"), f"bucketed_{uuid.uuid4().hex[:12]}_"
    for n, table in _stored_windows(spark, sf_dir).items():
        layers.save_bucketed(table, root, f"{prefix}{n}", schema.FEATURE_KEY, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stored = sorted(layers.catalog_tables(spark, prefix), key=lambda name: int(name.removeprefix(prefix)))
    return features.side_by_side_buckets({int(name.removeprefix(prefix)): spark.table(name) for name in stored})


@query
def tb_abt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _abt(spark, sf_dir)


def _intervals(spark: SparkSession, sf_dir: str, windows: Sequence[int] = schema.WINDOWS) -> DataFrame:
    return stage(intervals.state_intervals(results(spark, sf_dir), windows), "state_intervals")


@query
def asof_any_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shipment with statistics of its supplier as of the day and hour it left: dates between sessions, many of them twice."""
    hours = F.make_interval(hours=F.col("l_linenumber"))
    probes = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("DriverId"), (F.col("l_shipdate") + hours).alias("left_at")
    )
    return intervals.as_of(probes, _intervals(spark, sf_dir, [5]), 5, at="left_at")


@query
def statistic_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function, with its parameters bound by Spark."""
    functions.publish_statistics(spark, results(spark, sf_dir), _intervals(spark, sf_dir))
    return spark.sql("SELECT * FROM driver_statistic(:n, :year_stop)", args={"n": 10, "year_stop": 2000})


@query
def statistic_on_a_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions.publish_statistics(spark, results(spark, sf_dir), _intervals(spark, sf_dir))
    return spark.sql("SELECT * FROM driver_statistic_on(20, DATE '1999-05-17')")


@query
def champions_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers.publish_view(results(spark, sf_dir), "results")
    return layers.run_query(spark, "champions", {"year_stop": 2000})


@query
def tb_abt_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored label join over published layer tables."""
    rows = results(spark, sf_dir)
    layers.publish_view(stage(season.champions(rows), "champions"), "champions")
    layers.publish_view(stage(features.driver_all_statistic(rows), "driver_all_statistic"), "driver_all_statistic")
    return layers.run_query(spark, "tb_abt")


# --- training sets ------------------------------------------------------------------


@query
def season_tail_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.season_tail_sampling(stored_abt(spark, sf_dir))


@query
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.temporal_split(stored_abt(spark, sf_dir), **SPLIT)


@query
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    abt = stored_abt(spark, sf_dir)
    return features.split_sizes(abt, features.temporal_split(abt, **SPLIT))


@query
def training_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.training_matrix(features.temporal_split(stored_abt(spark, sf_dir), **SPLIT))


@query
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = features.temporal_split(stored_abt(spark, sf_dir), **SPLIT)
    train = split.where("split = 'train'")
    return features.null_profile(train.select(*[c for c in train.columns if c not in (*schema.FEATURE_KEY, "split")]))


@query
def impute_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.impute_sentinel(_abt(spark, sf_dir))


# --- ranking quality ----------------------------------------------------------------


def _label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels scored by text length."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")


@query
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = ranking.roc_curve(_label_scores(spark, sf_dir), "n_chars", "quality")
    # The start point's infinite threshold is written as null.
    return curve.withColumn("threshold", F.nullif("threshold", F.lit(float("inf"))))


@query
def roc_curve_all_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = ranking.roc_curve(_label_scores(spark, sf_dir), "n_chars", "quality", drop_intermediate=False)
    return curve.withColumn("threshold", F.nullif("threshold", F.lit(float("inf"))))


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    abt = stored_abt(spark, sf_dir).select(*schema.FEATURE_KEY, schema.LABEL, "total_points_5")
    scored = features.temporal_split(abt, **SPLIT)
    auc = ranking.roc_auc(scored, "total_points_5", schema.LABEL, ["split"])
    return auc.select("split", F.round("auc", 9).alias("auc"))


@query
def roc_curve_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    abt = stored_abt(spark, sf_dir).select(*schema.FEATURE_KEY, schema.LABEL, "total_points_5")
    curve = ranking.roc_curve(features.temporal_split(abt, **SPLIT), "total_points_5", schema.LABEL, ["split"])
    return curve.withColumn("threshold", F.nullif("threshold", F.lit(float("inf"))))


# --- model --------------------------------------------------------------------------


def _stump(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PipelineModel]:
    abt = stored_abt(spark, sf_dir)
    split = features.temporal_split(abt.select(*schema.FEATURE_KEY, schema.LABEL, *STUMP), **SPLIT)
    return abt, forest.fit(split.where("split = 'train'"), STUMP, **STUMP_SETTINGS)


def _areas(model: PipelineModel, split: DataFrame) -> DataFrame:
    scored = forest.predict(model, split).select("split", schema.LABEL, "prob_win")
    return ranking.roc_auc(scored, "prob_win", schema.LABEL, ["split"]).withColumn("auc", F.round("auc", 4))


@query
def fit_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve of each split, for a tree that SQL can grow as well."""
    abt, model = _stump(spark, sf_dir)
    return _areas(model, features.temporal_split(abt, **SPLIT))


@query
def score_abt(spark: SparkSession, sf_dir: str) -> DataFrame:
    abt, model = _stump(spark, sf_dir)
    scored = jobs.score(model, abt, results(spark, sf_dir))
    return scored.withColumns({c: F.round(f"`{c}`", 9) for c in ("0", "prob_win")})


@query
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.feature_importance(_stump(spark, sf_dir)[1], spark)


@query
def fit_forest_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve of each split for the published forest, fitted on the training split."""
    abt = stored_abt(spark, sf_dir)
    split = features.temporal_split(abt, **SPLIT)
    return _areas(forest.fit(split.where("split = 'train'"), features.feature_columns(abt)), split)


# --- serving ------------------------------------------------------------------------


@query
def entity_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.entity_dimension(results(spark, sf_dir))


@query
def format_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir).withColumn("color", scalars.format_color(F.col("TeamColor")))
    return rows.groupBy("TeamName", "TeamColor", "color").agg(F.count(F.lit(1)).alias("rows"))


@query
def scored_with_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, _abt(spark, sf_dir))


@query
def first_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.first_team(_scored(spark, sf_dir, _abt(spark, sf_dir)))


@query
def top_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.top_probability(_scored(spark, sf_dir).select("dt_ref", "DriverId", "prob_win", "driver_team_id"))


@query
def season_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.season_domain(_scored(spark, sf_dir))


@query
def filter_entities_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return serving.filter_entities_seasons(scored, *serving.default_selection(scored))


@query
def selected_from_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default selection, read from scores stored by entity."""
    root = staging_path(spark, "gold")
    layers.write_table(serving.by_entity(stage(_scored(spark, sf_dir), "scored")), root, "scored", **serving.SERVING_OPTIONS)
    stored = layers.read_table(spark, root, "scored")
    return serving.filter_entities_seasons(stored, *serving.default_selection(stored))


@query
def pivot_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default pivot in long form: the names of the pivoted columns depend on the data."""
    scored = _scored(spark, sf_dir)
    ids, seasons = serving.default_selection(scored)
    pivoted = serving.pivot_probability(serving.filter_entities_seasons(scored, ids, seasons), ids)
    return pivoted.unpivot(["dt_ref"], sorted(ids), "driver_team_id", "mean_prob_win")


@query
def color_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    ids, seasons = serving.default_selection(scored)
    return serving.color_lookup(serving.filter_entities_seasons(scored, ids, seasons), sorted(ids))


# --- sources ------------------------------------------------------------------------


@query
def consolidate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as raw session files, then read back as one clean table."""
    folder = staging_path(spark, "raw")
    raw.land_sessions(results(spark, sf_dir), folder)
    return raw.consolidate(spark, folder)


def _published(spark: SparkSession, sf_dir: str) -> str:
    folder = staging_path(spark, "published")
    publish_files(results(spark, sf_dir), folder)
    return folder


@query
def consolidate_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several layouts, with 64-bit and double keys, two units of time and missing columns, as one clean table."""
    return published.consolidate(spark, _published(spark, sf_dir))[0]


@query
def bronze_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bronze job keeps and rejects of such files, season by season, and its own counts of the same pass."""
    bronze = staging_path(spark, "bronze")
    counts = jobs.run_bronze(spark, _published(spark, sf_dir), bronze)
    kept = jobs.bronze_results(spark, bronze).select("Year", F.lit("kept").alias("reason"))
    rejected = layers.read_table(spark, bronze, "rejects").select("Year", "reason")
    observed = spark.createDataFrame([(None, f"counted {k}", v) for k, v in counts.items()], "Year int, reason string, rows long")
    return kept.unionByName(rejected).groupBy("Year", "reason").agg(F.count(F.lit(1)).alias("rows")).unionByName(observed)


@query
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the file stream: the second takes only the seasons added since."""
    folder, bronze, checkpoint = (staging_path(spark, n) for n in ("raw", "bronze", "stream"))
    rows = results(spark, sf_dir)
    raw.load_sessions(rows.where("Year < 2000"), folder)
    ingest(spark, folder, bronze, checkpoint)
    raw.load_sessions(rows, folder)
    ingest(spark, folder, bronze, checkpoint)
    return spark.read.schema(schema.RESULTS).parquet(bronze)


@query
def incremental_new_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = results(spark, sf_dir)
    new = raw.new_sessions(rows, rows.where((F.col("Year") < 2000) & (F.col("Mode") == "Race")))
    return new.groupBy(*schema.SESSION_KEY).agg(F.count(F.lit(1)).alias("rows"))


@query
def backfill_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reload of all seasons before the current one into an out-of-date raw folder."""
    folder = staging_path(spark, "raw")
    rows = results(spark, sf_dir)
    raw.land_sessions(rows.withColumn("Status", F.lit("stale")), folder)
    raw.load_sessions(rows, folder, reload_data=True, current_year=2001)
    stored = raw.scan_raw(spark, folder)
    return stored.groupBy("Year", "Status").agg(F.count(F.lit(1)).alias("rows"))


@query
def ingest_after_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, ingest, reload of past seasons, ingest: the reloaded sessions replace their old rows."""
    folder, bronze, checkpoint = (staging_path(spark, n) for n in ("raw", "bronze", "stream"))
    rows = results(spark, sf_dir)
    raw.land_sessions(rows.withColumn("Status", F.lit("stale")), folder)
    ingest(spark, folder, bronze, checkpoint)
    raw.load_sessions(rows, folder, reload_data=True, current_year=2001)
    ingest(spark, folder, bronze, checkpoint)
    stored = spark.read.schema(schema.RESULTS).parquet(bronze)
    return stored.groupBy("Year", "Status").agg(F.count(F.lit(1)).alias("rows"))


@query
def ingest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, ingest, reload of past seasons of which the older half has changed, ingest: the ledger beside what bronze
    holds. Reloaded sessions with the same rows are still those of batch 0."""
    folder, bronze, checkpoint, ledger = (staging_path(spark, n) for n in ("raw", "bronze", "stream", "ledger"))
    rows = results(spark, sf_dir)
    raw.land_sessions(rows, folder)
    ingest(spark, folder, bronze, checkpoint, ledger=ledger)
    late = rows.withColumn("Status", F.when(F.col("Year") < 1996, "late").otherwise(F.col("Status")))
    raw.load_sessions(late, folder, reload_data=True, current_year=2000)
    ingest(spark, folder, bronze, checkpoint, ledger=ledger)
    held = session_digests(spark.read.schema(schema.RESULTS).parquet(bronze).select(*schema.RESULTS.fieldNames()))
    known = read_ledger(spark, ledger)
    return unchanged_sessions(held, known).join(known, [*schema.SESSION_KEY, "rows"]).select(*schema.SESSION_KEY, "rows", "batch")


@query
def silver_after_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver tables of results whose newest two seasons held other points, then of the true ones: the labelled table,
    whose seasons in reach of the change were built again."""
    silver, state = (staging_path(spark, n) for n in ("silver", "silver_state"))
    rows = results(spark, sf_dir)
    stale = F.when(F.col("Year") >= 1997, F.col("Points") + 1).otherwise(F.col("Points"))
    for version in (rows.withColumn("Points", stale), rows):
        bronze = staging_path(spark, "bronze")
        version.write.partitionBy("Year").parquet(bronze)
        stored = spark.read.schema(schema.RESULTS).parquet(bronze).select(*schema.RESULTS.fieldNames())
        seasons.refresh_silver(spark, stored, session_digests(stored), silver, state)
        remove_folder(spark, bronze)
    return seasons.read_seasons(spark, silver, "tb_abt")


@query
def incremental_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New sessions where sprints have no mode: a stored session without a mode is not new."""
    rows = results(spark, sf_dir).withColumn("Mode", F.nullif("Mode", F.lit("Sprint")))
    new = raw.new_sessions(rows, rows.where("Year < 2000"))
    return new.groupBy(*schema.SESSION_KEY).agg(F.count(F.lit(1)).alias("rows"))


@query
def session_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = scalars.session_key(F.col("Year"), F.col("RoundNumber"), scalars.mode_identifier(F.col("Mode")))
    return results(spark, sf_dir).groupBy(key.alias("session_key")).agg(F.count(F.lit(1)).alias("rows"))


@query
def durations_to_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    since = {"Q1": "hour", "Q2": "day", "Q3": "month", "Time": "year"}
    rows = table(spark, sf_dir, "events").select(
        "event_id", *[(ts - F.date_trunc(unit, ts)).alias(name) for name, unit in since.items()]
    )
    return raw.durations_to_seconds(rows)


def _session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session, with event texts made up from the nations."""
    rows = results(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        rows.select(*schema.SESSION_KEY, "Date")
        .distinct()
        .join(nation, F.col("RoundNumber") == F.col("n_nationkey"))
        .select(
            *schema.SESSION_KEY,
            "Date",
            F.concat(F.col("Year").cast("string"), F.lit(" Grand Prix of "), "n_name").alias("OfficialEventName"),
            F.concat("n_name", F.lit(" Grand Prix")).alias("EventName"),
            F.col("n_name").alias("Country"),
            F.col("r_name").alias("Location"),
        )
    )


@query
def enrich_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results without their date get it back, with the event texts."""
    listed = stage(_session_list(spark, sf_dir), "session_list")
    return raw.enrich_sessions(results(spark, sf_dir).drop("Date"), listed)


@query
def enrich_unlisted_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list lacks the later rounds: their rows stay, without date and texts."""
    listed = stage(_session_list(spark, sf_dir).where("RoundNumber <= 6"), "session_list")
    return raw.enrich_sessions(results(spark, sf_dir).drop("Date"), listed)
