"""Incremental ingest as a file stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitwall import schema
from pitwall.session import stage, staged_for_job
from pitwall.sources.raw import normalise
from pitwall.streaming.ledger import read_ledger, same_session, session_digests, unchanged_sessions, write_ledger


def raw_stream(
    spark: SparkSession, raw: str, columns: StructType = schema.RESULTS, max_files: int | None = None
) -> DataFrame:
    """New raw files as they arrive, `max_files` per batch where given."""
    reader = spark.readStream.schema(columns)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return normalise(reader.parquet(raw).select(*columns.fieldNames(), "_metadata.file_path"))


def session_rows(spark: SparkSession, raw: str, files: Sequence[str], columns: StructType = schema.RESULTS) -> DataFrame:
    """All rows in the folders of these files, and no other folder is read."""
    uri, path = spark._jvm.java.net.URI, spark._jvm.org.apache.hadoop.fs.Path
    folders = sorted({path(uri(f)).getParent().toString() for f in files})
    reader = spark.read.schema(columns).option("basePath", raw)
    return normalise(reader.parquet(*folders).select(*columns.fieldNames()))


def ingest(
    spark: SparkSession,
    raw: str,
    bronze: str,
    checkpoint: str,
    columns: StructType = schema.RESULTS,
    max_files: int | None = None,
    ledger: str | None = None,
) -> None:
    """Take every session with a raw file not yet taken into the bronze table, then stop.

    A batch names sessions; each is read whole from its folder and replaces what bronze
    holds of it. So a reload replaces its sessions, a session in several files or batches
    is whole, and a batch that is run again after a fault changes nothing. A session's
    files must be in one folder, as `land_sessions` writes them; a batch reads the folders
    of its own files only. The checkpoint remembers the files already taken; it must be on
    storage that all executors share and that outlives the job.

    With `ledger`, a folder, sessions that hold the same rows as before are not written.
    Their entries lose the digest before bronze is written and get the new one after, so
    what a fault interrupts counts as changed. The entry's batch is the one that last wrote
    the session.
    """

    def replace(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        with staged_for_job(own):
            taken = stage(batch.select(*schema.SESSION_KEY, "file_path").distinct(), "batch_sessions")
            # The names of the batch's files, which the stream has listed on the driver already.
            files = [r[0] for r in taken.select("file_path").distinct().collect()]
            if not files:
                return
            held = taken.select(*schema.SESSION_KEY).distinct()
            rows = session_rows(own, raw, files, columns)
            whole = rows.join(held, same_session(rows, held), "left_semi")
            if ledger is None:
                write(whole)
                return
            known = read_ledger(own, ledger)
            # Only sessions that may be unchanged are read for their digest.
            unsure = whole.join(known, same_session(whole, known), "left_semi")
            same = stage(unchanged_sessions(session_digests(unsure), known), "same_sessions")
            # Digest and bronze come from one copy: raw files may be replaced meanwhile.
            copy = stage(whole.join(same, same_session(whole, same), "left_anti"), "changed_sessions")
            entries = stage(session_digests(copy).withColumn("batch", F.lit(number).cast("long")), "ledger_entries")
            if entries.isEmpty():
                return
            write_ledger(entries.withColumn("digest", F.lit(None).cast("string")), ledger)
            write(copy)
            write_ledger(entries, ledger)

    def write(rows: DataFrame) -> None:
        writer = rows.hint("rebalance", *schema.SESSION_KEY).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(*schema.SESSION_KEY).parquet(bronze)

    run = (
        raw_stream(spark, raw, columns, max_files)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(replace)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
