"""The results table, derived from the order tables of the test data."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall import schema
from pitwall.session import pin_utc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round per month, its sprint on the last day but one, its race on the last."""
    line = table(spark, sf_dir, "lineitem")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")

    season = F.year("l_shipdate")
    entity = F.col("l_suppkey")
    sprint = F.col("l_linestatus") == "O"
    month_end = F.last_day("l_shipdate")
    nation = F.col("s_nationkey").cast("string")
    color = F.concat(F.lit("AB00"), F.lpad(nation, 2, "0"))

    retired = (entity % 4 == 0) & (season > 1997)
    not_started = (entity % 5 == 0) & (season < 1999)
    return (
        line.where(~retired & ~not_started)
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            entity.cast("string").alias("DriverId"),
            season.cast("int").alias("Year"),
            F.month("l_shipdate").cast("int").alias("RoundNumber"),
            F.when(sprint, F.date_sub(month_end, 1)).otherwise(month_end).cast("timestamp").alias("Date"),
            F.when(sprint, "Sprint").otherwise("Race").alias("Mode"),
            F.nullif(F.col("l_linenumber"), F.lit(7)).cast("double").alias("Position"),
            F.nullif(F.col("l_partkey") % 10 + 1, F.lit(10)).cast("double").alias("GridPosition"),
            F.when(F.col("l_linenumber") <= 3, F.col("l_quantity")).otherwise(0.0).alias("Points"),
            F.when(F.col("l_returnflag") == "A", "Finished")
            .when(F.col("l_returnflag") == "R", "+1 Lap")
            .otherwise("Retired")
            .alias("Status"),
            F.when(F.col("s_nationkey") % 6 != 5, F.concat(F.lit("team_"), nation)).alias("TeamId"),
            F.concat(F.lit("Team "), nation).alias("TeamName"),
            F.when(F.col("s_nationkey") % 3 == 1, F.concat(F.lit("#"), color))
            .when(F.col("s_nationkey") % 3 == 2, color)
            .alias("TeamColor"),
            F.col("s_name").alias("FullName"),
        )
        .select(*schema.RESULTS.fieldNames())
    )


def publish_files(rows: DataFrame, folder: str) -> int:
    """Write results as other tools would, a file for each session, season by season in another way: 64-bit keys, doubles
    with gaps, timestamps of nanoseconds, no column TeamColor or one without type. Returns the number of files.

    Rows without a position lose their season (in seasons of double keys the round becomes 0.5 too), rows of 50 points
    their round.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = 0
            for (year, number, mode), rows in batch.groupby(["Year", "RoundNumber", "Mode"]):
                table = pa.Table.from_pandas(rows, preserve_index=False)
                keys = pa.float64() if year % 3 == 0 else pa.int64()
                unit = "ns" if mode == "Sprint" else "us"
                columns = {name: table[name] for name in table.column_names if not name.startswith("lost_")}
                for name in ("Year", "RoundNumber"):
                    lost = rows[f"lost_{name}"].to_numpy(bool)
                    columns[name] = pa.array(rows[name].to_numpy(), mask=lost).cast(keys)
                if year % 3 == 0:
                    columns["RoundNumber"] = pa.compute.if_else(rows["lost_Year"].to_numpy(bool), 0.5, columns["RoundNumber"])
                columns["Date"] = table["Date"].cast(pa.timestamp("us")).cast(pa.timestamp(unit))
                if year < 1995:
                    del columns["TeamColor"]
                elif year == 1995:
                    columns["TeamColor"] = pa.nulls(len(rows))
                system, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
                name = f"{path}/{year}_{number:02}_{mode[0]}_{uuid.uuid4().hex[:8]}.parquet"
                with system.open_output_stream(name) as out:
                    pq.write_table(pa.table(columns), out)
                files += 1
            yield pd.DataFrame({"files": [files]})

    lost = [F.col("Position").isNull().alias("lost_Year"), (F.col("Points") == 50).alias("lost_RoundNumber")]
    spread = rows.select("*", *lost).repartition("Year", "RoundNumber", "Mode").sortWithinPartitions("Year", "RoundNumber", "Mode")
    path = rows.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration()).mkdirs(path)
    return spread.mapInPandas(write, "files long").agg(F.sum("files")).first()[0]
