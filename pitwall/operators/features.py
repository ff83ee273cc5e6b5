"""The wide feature table, its label, and the training sets cut from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwall import schema
from pitwall.operators.asof import all_windows
from pitwall.session import stage


def side_by_side(
    tables: Mapping[int, DataFrame] | DataFrame, keys: Sequence[str] = schema.FEATURE_KEY, windows: Sequence[int] = schema.WINDOWS
) -> DataFrame:
    """Stored tables of single windows as one wide table, each column named with its window.

    The tables are stacked and gathered in one grouping, so their rows are shuffled once
    together and not joined table by table. Rows that a table lacks, and null keys, are
    left out. Tables of one store come as that store, with a folder `last_rounds` for each of
    `windows`: it is stacked already, and if it lies in buckets of some of `keys`, no row moves.
    """
    if isinstance(tables, DataFrame):
        columns = {n: [c for c in tables.columns if c not in (*keys, "last_rounds")] for n in windows}
        stacked = _stackable(tables, F.col("last_rounds"), columns[windows[0]], keys)
    else:
        columns = {n: [c for c in table.columns if c not in keys] for n, table in tables.items()}
        parts = [_stackable(table, F.lit(n), columns[n], keys) for n, table in tables.items()]
        stacked = parts[0]
        for part in parts[1:]:
            stacked = stacked.unionByName(part)
    held = [
        F.first(F.when(F.col("window") == n, F.col("statistics")), ignorenulls=True).alias(f"w{n}") for n in columns
    ]
    gathered = stacked.dropna(subset=list(keys)).groupBy(*keys).agg(*held).dropna(subset=[f"w{n}" for n in columns])
    return gathered.select(*keys, *[F.col(f"w{n}.{c}").alias(f"{c}_{n}") for n, names in columns.items() for c in names])


def _stackable(table: DataFrame, window: Column, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return table.select(*keys, window.alias("window"), F.struct(*values).alias("statistics"))


def side_by_side_buckets(tables: Mapping[int, DataFrame], keys: Sequence[str] = schema.FEATURE_KEY) -> DataFrame:
    """`side_by_side` for catalog tables dealt into the same buckets by `keys`: joins that move no row. Each table has
    one row per key; null keys are left out."""
    renamed = []
    for n, table in tables.items():
        values = [F.col(c).alias(f"{c}_{n}") for c in table.columns if c not in keys]
        renamed.append(table.select(*keys, *values))
    wide = renamed[0].dropna(subset=list(keys))
    for table in renamed[1:]:
        wide = wide.join(table, list(keys))
    return wide


def present_everywhere(wide: DataFrame, windows: Sequence[int] = schema.WINDOWS) -> DataFrame:
    """Rows of `all_windows` that exist in every window, as an inner join would leave."""
    return wide.dropna(subset=[f"qty_sessions_{n}" for n in windows])


def driver_all_statistic(
    results: DataFrame, windows: Sequence[int] = schema.WINDOWS, year_stop: int | None = None
) -> DataFrame:
    """All windows side by side: 2 keys and 45 statistics per window."""
    return present_everywhere(all_windows(results, windows, year_stop), windows)


def label(features: DataFrame, champions: DataFrame) -> DataFrame:
    """Add flChampion: the entity is the champion of the as-of date's season.

    `champions` has one row per season. Pass a staged or stored table: the optimizer
    then knows its size and spares the wide side the shuffle.
    """
    winners = champions.select(
        F.col("Year").alias("champion_year"), F.col("DriverId").alias("champion_id"), "rank_driver"
    )
    return (
        features.join(
            winners,
            (F.col("DriverId") == F.col("champion_id")) & (F.year("dt_ref") == F.col("champion_year")),
            "left",
        )
        .withColumn(schema.LABEL, F.coalesce("rank_driver", F.lit(0)))
        .drop("champion_year", "champion_id", "rank_driver")
    )


def feature_columns(abt: DataFrame) -> list[str]:
    return [c for c in abt.columns if c not in (*schema.FEATURE_KEY, schema.LABEL)]


def season_tail_sampling(abt: DataFrame, tail: int = schema.SEASON_TAIL) -> DataFrame:
    """Drop the newest `tail` dates of each season.

    Pass a stored table: it is read once for its dates and once for its rows. Only the
    distinct dates are ranked; they are staged, so the wide rows are not shuffled for a
    list of that size.
    """
    newest = Window.partitionBy(F.year("dt_ref")).orderBy(F.col("dt_ref").desc())
    kept = (
        abt.select("dt_ref").distinct().withColumn("newer", F.row_number().over(newest) - 1).where(F.col("newer") >= tail)
    )
    return abt.join(stage(kept.select("dt_ref"), "sampled_dates"), "dt_ref", "left_semi")


def temporal_split(abt: DataFrame, train_before: int, test_year: int, oot_year: int) -> DataFrame:
    """Add `split`: sampled rows before `train_before` are train, sampled rows of
    `test_year` are test, all rows of `oot_year` are oot. The rest is left out.

    Pass a stored table, as for the sampling. The rows are joined with the staged list of
    their dates once, not split and re-united.
    """
    year = F.year("dt_ref")
    newest = Window.partitionBy(year).orderBy(F.col("dt_ref").desc())
    dates = (
        abt.select("dt_ref")
        .distinct()
        .withColumn("sampled", F.row_number().over(newest) > schema.SEASON_TAIL)
        .withColumn(
            "split",
            F.when(F.col("sampled") & (year < train_before), "train")
            .when(F.col("sampled") & (year == test_year), "test")
            .when(year == oot_year, "oot"),
        )
        .where("split IS NOT NULL")
        .select("dt_ref", "split")
    )
    return abt.join(stage(dates, "split_dates"), "dt_ref")


def split_sizes(abt: DataFrame, split: DataFrame) -> DataFrame:
    """Rows and columns of the whole table and of each split."""
    width = len(abt.columns)
    whole = abt.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("all").alias("split"), "rows")
    parts = split.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    return whole.unionByName(parts).withColumn("columns", F.lit(width))


def training_matrix(split: DataFrame) -> DataFrame:
    """Keys, split and label first, then the features in table order."""
    features = [c for c in split.columns if c not in (*schema.FEATURE_KEY, schema.LABEL, "split")]
    return split.select("split", *schema.FEATURE_KEY, schema.LABEL, *features)


def impute_sentinel(df: DataFrame, value: float = schema.SENTINEL) -> DataFrame:
    """Nulls of all numeric columns become `value`, in one call."""
    return df.na.fill(value, subset=[f.name for f in df.schema if isinstance(f.dataType, T.NumericType)])


def null_profile(df: DataFrame) -> DataFrame:
    """(feature, nulls) of the columns that have nulls. One aggregate row, unpivoted."""
    counts = df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "feature", "nulls").where("nulls > 0")
