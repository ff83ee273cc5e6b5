"""Raw session files: landing, consolidation, incremental loads and backfills."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from pitwall import schema
from pitwall.functions.scalars import duration_seconds


def _session_match(left: DataFrame, right: DataFrame) -> Column:
    """Equal session keys; a missing part equals a missing part."""
    match = F.lit(True)
    for c in schema.SESSION_KEY:
        match &= left[c].eqNullSafe(right[c])
    return match


def enrich_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add the session's date and event texts to every result row; null for a session
    that is not listed. A session listed twice raises an error.

    The list is joined as it comes: the optimizer broadcasts it when its files are small.
    """
    texts = F.struct(*schema.SESSION_METADATA)
    listed = sessions.groupBy(*schema.SESSION_KEY).agg(F.first(texts).alias("texts"), F.count(F.lit(1)).alias("times"))
    once = listed.withColumn(
        "texts", F.when(F.col("times") > 1, F.raise_error(F.lit("a session is listed twice"))).otherwise(F.col("texts"))
    )
    joined = rows.join(once, _session_match(rows, once), "left")
    metadata = [F.col("texts")[c].alias(c) for c in schema.SESSION_METADATA]
    return joined.select(*[rows[c] for c in rows.columns], *metadata)


def durations_to_seconds(rows: DataFrame) -> DataFrame:
    """The lap and race times, held as intervals, become seconds."""
    return rows.withColumns({c: duration_seconds(c) for c in schema.DURATIONS if c in rows.columns})


def normalise(rows: DataFrame) -> DataFrame:
    """Bring raw rows to the contract: microsecond timestamps, contract types, and null
    instead of NaN, which must not count as a value in sums and averages."""
    fields = {f.name: f.dataType for f in schema.RESULTS}
    cast = {}
    for name, kind in fields.items():
        value = F.col(name).cast(kind)
        cast[name] = F.when(~F.isnan(value), value) if isinstance(kind, DoubleType) else value
    return rows.withColumns(cast)


def land_sessions(rows: DataFrame, raw: str) -> None:
    """Write result rows as raw files, one folder per session.

    Only folders of sessions in `rows` are replaced. Rows are shuffled to their session
    first, so a session is written by one task; a session too large for that is split
    by the rebalance.
    """
    rows.hint("rebalance", *schema.SESSION_KEY).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*schema.SESSION_KEY).parquet(raw)


def scan_raw(spark: SparkSession, raw: str, columns: StructType = schema.RESULTS) -> DataFrame:
    """All raw files of a data set as one table, with a declared schema."""
    return spark.read.schema(columns).parquet(raw).select(*columns.fieldNames())


def consolidate(spark: SparkSession, raw: str, columns: StructType = schema.RESULTS) -> DataFrame:
    """The clean results table: the union of all raw files in contract types."""
    return normalise(scan_raw(spark, raw, columns))


def new_sessions(incoming: DataFrame, present: DataFrame, reload_data: bool = False) -> DataFrame:
    """Rows of sessions that `present` does not hold yet; all rows on a reload.

    Every new session is taken, whichever others exist. Only the distinct session keys
    of `present` enter the join. A key part that is null equals a null.
    """
    if reload_data:
        return incoming
    held = present.select(*[F.col(c).alias(f"held_{c}") for c in schema.SESSION_KEY]).distinct()
    match = F.lit(True)
    for c in schema.SESSION_KEY:
        match &= F.col(c).eqNullSafe(F.col(f"held_{c}"))
    return incoming.join(held, match, "left_anti")


def backfill_years(incoming: DataFrame, first_year: int, current_year: int) -> DataFrame:
    """Rows of the seasons a reload replaces: from `first_year` up to, not including,
    the current one. The range reaches the scan and prunes folders by season."""
    return incoming.where((F.col("Year") >= first_year) & (F.col("Year") < current_year))


def load_sessions(
    incoming: DataFrame,
    raw: str,
    reload_data: bool = False,
    first_year: int = 1980,  # fixed value: first season of a full reload
    current_year: int | None = None,
) -> None:
    """Add new sessions to the raw folder, or with `reload_data` replace past seasons."""
    spark = incoming.sparkSession
    if reload_data:
        if current_year is None:
            raise ValueError("a reload needs the current year")
        land_sessions(backfill_years(incoming, first_year, current_year), raw)
        return
    known = session_keys(spark, raw)
    land_sessions(incoming if known is None else new_sessions(incoming, known), raw)


def session_keys(spark: SparkSession, raw: str) -> DataFrame | None:
    """Keys of the sessions on disk, or None if nothing is there yet. They are folder
    names, so no data is read."""
    try:
        return spark.read.parquet(raw).select(*schema.SESSION_KEY)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
