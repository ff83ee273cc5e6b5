"""Layer tables: one folder per table under a layer root."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from pitwall.session import remove_folder, writing

#: Formats whose tables are replaced by a new version folder. Others bring snapshots of their own.
PLAIN = ("parquet", "orc", "json", "csv")
_VERSION = re.compile(r"v=[0-9]+")
QUERY_FOLDER = Path(__file__).resolve().parent.parent / "plans" / "sql"


def _version_numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[2:]) for n, is_folder in list_folder(spark, path).items() if is_folder and _VERSION.fullmatch(n))


def newest(spark: SparkSession, path: str) -> str:
    """The folder of a table's newest finished version; the table's own folder if it has no versions."""
    for number in reversed(_version_numbers(spark, path)):
        if "_SUCCESS" in list_folder(spark, f"{path}/v={number}"):
            return f"{path}/v={number}"
    return path


def read_table(
    spark: SparkSession, root: str, name: str, fmt: str = "parquet", schema: StructType | None = None
) -> DataFrame:
    """A layer table. With a schema no file is opened to infer one."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(newest(spark, f"{root.rstrip('/')}/{name}"))


def write_table(
    df: DataFrame, root: str, name: str, fmt: str = "parquet", partition_by: Sequence[str] = (), **options: str
) -> str:
    """Replace a layer table whole. Rows are written by the tasks that hold them, so the
    number of files follows the data. The folder written to is returned. `options` go to
    the writer.

    A plain file format gets a new version folder, which counts from the moment its write
    has finished: readers see the old table or the new one, and a plan may read the
    table it replaces. The version before stays for those who still read it, older ones
    and what broken-off writes left below it are removed. One writer at a time.
    """
    spark, path = df.sparkSession, f"{root.rstrip('/')}/{name}"
    writer = df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "static").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt not in PLAIN:
        writer.save(path)
        return path
    before, numbers = newest(spark, path), _version_numbers(spark, path)
    target = f"{path}/v={max(numbers, default=0) + 1}"
    writer.save(target)
    for number in numbers:
        if before != path and number < int(before.rpartition("=")[2]):
            remove_folder(spark, f"{path}/v={number}")
    return target


def save_bucketed(df: DataFrame, root: str, name: str, keys: Sequence[str], buckets: int) -> str:
    """Write a layer table as a catalog table, dealt into buckets by `keys` and sorted in them, one file each.

    Tables of the same keys and number of buckets are joined or grouped on all of `keys`
    without a shuffle. Name keys that hardly repeat together, as a bucket holds all rows of
    its keys, and choose the number by the size of the largest table. The catalog has the
    session's `name`; the files are under `root`.
    """
    dealt = df.repartition(buckets, *keys).write.mode("overwrite").option("path", f"{root.rstrip('/')}/{name}")
    dealt.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return name


def save_as_dealt(df: DataFrame, root: str, name: str, keys: Sequence[str], buckets: int, partition_by: str) -> str:
    """`save_bucketed` with a folder for each value of `partition_by`, for rows that are dealt by `keys` to `buckets` tasks
    already: none is moved, a task writes one file a folder. Rows dealt otherwise are stored as well, in more files."""
    writer = df.write.mode("overwrite").option("path", f"{root.rstrip('/')}/{name}")
    with writing(df.sparkSession):
        writer.partitionBy(partition_by).bucketBy(buckets, *keys).saveAsTable(name)
    return name


def catalog_tables(spark: SparkSession, prefix: str) -> list[str]:
    """Names of the stored tables of the current database that begin with `prefix`; views are left out."""
    found = spark.catalog.listTables(pattern=f"{prefix}*")
    return sorted(t.name for t in found if t.tableType != "TEMPORARY" and t.name.startswith(prefix))


def publish_view(df: DataFrame, name: str) -> None:
    """Make `df` readable by name in this session."""
    df.createOrReplaceTempView(name)


def view_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Read a layer table and publish it under its own name."""
    publish_view(read_table(spark, root, name, fmt), name)
    return spark.table(name)


def read_query(name: str) -> str:
    """Text of a stored statement."""
    return (QUERY_FOLDER / f"{name}.sql").read_text(encoding="utf-8")


def run_query(spark: SparkSession, name: str, args: Mapping[str, object] | None = None) -> DataFrame:
    """A stored statement with named parameters bound by Spark, not pasted into the text."""
    return spark.sql(read_query(name), args=dict(args or {}))


def save_query(
    spark: SparkSession, name: str, root: str, args: Mapping[str, object] | None = None, table: str | None = None
) -> str:
    """Run a stored statement and write it as a layer table."""
    return write_table(run_query(spark, name, args), root, table or name)


def list_folder(spark: SparkSession, folder: str) -> dict[str, bool]:
    """Names in a folder, and whether each is a folder itself. Empty if there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return {}
    return {entry.getPath().getName(): entry.isDirectory() for entry in files.listStatus(path)}
