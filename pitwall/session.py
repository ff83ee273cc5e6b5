"""Session settings and the shared staging folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def spark_session(app_name: str = "pitwall", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings every job relies on; `settings` come on top."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # The wide plans compile more classes than the default cache of 100 holds.
        "spark.sql.codegen.cache.maxEntries": "1000",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """Dates are cut from timestamps, so the session zone is part of the result."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def observing_session(spark: SparkSession) -> SparkSession:
    """A session beside `spark`, with its settings, for plans that are observed.

    A session that has observed anything can't be shipped to tasks any more, which the
    engine does with the session of a fitted forest.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def staging_root(spark: SparkSession) -> str:
    """The shared folder for staged tables: `spark.checkpoint.dir` where the cluster sets it.

    A local session without the setting gets a folder of its own. Anything else is
    refused, since a folder on one machine is not visible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="pitwall-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/pitwall/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder through its own file system; a missing one is no error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def writing(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Session settings while a table is written. What the write shuffled goes with its end; else those files stay until
    the driver happens to collect its garbage."""
    held = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **settings}
    before = {key: spark.conf.get(key, None) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staged_for_job(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end, also after an error. For jobs that
    write their results elsewhere; a plan that still reads a staged table must not leave it."""
    paths: list[str] = []
    token = _STAGED.set(paths)
    try:
        yield
    finally:
        _STAGED.reset(token)
        for path in paths:
            remove_folder(spark, path)


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back, from a folder for each value of `partition_by` if named.

    Later plans then start from files that outlive any executor, and the optimizer
    knows their true size: it broadcasts a staged side only when the files are below
    `spark.sql.autoBroadcastJoinThreshold` and shuffles it otherwise.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    held = _STAGED.get()
    if held is not None:
        held.append(path)
    with writing(spark):
        df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
