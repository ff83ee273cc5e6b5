"""Publishing layers to a database or an object store."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

from pitwall.schema import SESSION_KEY
from pitwall.sources.layers import list_folder, newest

# Fixed value: rows per insert statement.
BATCH_ROWS = 1000


def table_name(root: str, path: str, prefix: str = "") -> str:
    """Target name: the folders below the root joined by `_`, after an optional prefix."""
    parts = PurePosixPath(path).relative_to(PurePosixPath(root)).parts
    return "_".join([prefix, *parts] if prefix else parts)


def layer_tables(spark: SparkSession, root: str) -> list[str]:
    """Folders below `root` that hold a table: versions, a table log, a finished write or a
    stream's sink log. Partition folders (`key=value`) are never entered.

    Listed with the file system of `root`, so object stores work as local folders do.
    """
    found, folders = [], [root.rstrip("/")]
    while folders:
        folder = folders.pop()
        children = list_folder(spark, folder)
        if children.keys() & {"_delta_log", "_SUCCESS", "_spark_metadata"} or newest(spark, folder) != folder:
            found.append(folder)
        else:
            folders += [f"{folder}/{n}" for n, is_folder in children.items() if is_folder and n[0] not in "_." and "=" not in n]
    return sorted(found)


def jdbc_writer(df: DataFrame, url: str, table: str, options: Mapping[str, str] | None = None) -> DataFrameWriter:
    """A writer that replaces `table`. The tasks insert their own rows in batches; no row
    passes through the driver. `numPartitions` in `options` bounds the connections."""
    return (
        df.write.format("jdbc")
        .mode("overwrite")
        .options(url=url, dbtable=table, batchsize=str(BATCH_ROWS), **dict(options or {}))
    )


def publish_layer(
    spark: SparkSession,
    root: str,
    url: str,
    prefix: str = "",
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> list[str]:
    """Copy every table of a layer to a database; the target names are returned."""
    names = []
    for path in layer_tables(spark, root):
        name = table_name(root, path, prefix)
        jdbc_writer(spark.read.format(fmt).load(newest(spark, path)), url, name, options).save()
        names.append(name)
    return names


def publish_raw(spark: SparkSession, raw: str, target: str) -> None:
    """Copy a raw folder to an object-store prefix, as parquet, with the same layout."""
    rows = spark.read.parquet(raw)
    keys = [c for c in SESSION_KEY if c in rows.columns]
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*keys) if keys else writer).parquet(target)
