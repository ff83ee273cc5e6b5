"""Raw session files as other tools write them.

Such files do not agree on types: keys are 64-bit integers or, with gaps, doubles;
timestamps count micro- or nanoseconds, with a zone or without; a column without values
has no type, or is not there. One declared schema cannot read them all. So the footers
are read first, by tasks, and each distinct layout gets a scan of its own with the types
its files have. The scans are put together by column name, missing columns as nulls, and
narrowed to the contract: a key that is not a whole number of its type, or is missing,
is not cut to fit but rejects its row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwall import schema
from pitwall.session import observing_session, stage
from pitwall.sources.raw import normalise

#: Larger files are not read whole for their footer: Spark opens those one by one.
WHOLE_FILE = 64 << 20

# Columns that a row cannot do without.
KEYS = ("Year", "RoundNumber")

_PLAIN = {
    pa.int8(): "int", pa.int16(): "int", pa.int32(): "int", pa.int64(): "bigint", pa.uint8(): "int", pa.uint16(): "int",
    pa.uint32(): "bigint", pa.float32(): "float", pa.float64(): "double", pa.bool_(): "boolean", pa.date32(): "date",
    pa.string(): "string", pa.large_string(): "string",
}


def _spark_type(kind: pa.DataType) -> str:
    """The type to read a column with; `nanos` for timestamps of nanoseconds, `void` for a column without type."""
    if pa.types.is_dictionary(kind):
        kind = kind.value_type
    if pa.types.is_timestamp(kind):
        return "nanos" if kind.unit == "ns" else "timestamp" if kind.tz else "timestamp_ntz"
    if pa.types.is_decimal(kind):
        return f"decimal({kind.precision},{kind.scale})"
    return "void" if pa.types.is_null(kind) else _PLAIN.get(kind, "unknown")


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("path").to_pylist(), batch.column("content"), strict=True)
        found = [(path, pq.ParquetFile(pa.BufferReader(content.as_buffer()))) for path, content in rows]
        layouts = []
        for _, file in found:
            kinds = {f.name: _spark_type(f.type) for f in file.schema_arrow}
            # The oldest form of timestamps, which Arrow takes for nanoseconds.
            kinds |= {c.path: "timestamp" for c in map(file.schema.column, range(len(file.schema))) if c.physical_type == "INT96"}
            layouts.append(json.dumps(kinds, sort_keys=True))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found]), pa.array(layouts)], names=["path", "layout"])


def layouts(spark: SparkSession, raw: str) -> DataFrame:
    """(path, layout): the columns and types of every file, as JSON."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(raw)
    small = files.where(F.col("length") <= WHOLE_FILE).select("path", "content").mapInArrow(_layouts, "path string, layout string")
    large = [
        (r["path"], json.dumps({f.name: f.dataType.simpleString() for f in spark.read.parquet(r["path"]).schema}, sort_keys=True))
        for r in files.where(F.col("length") > WHOLE_FILE).select("path").collect()
    ]
    return small.unionByName(spark.createDataFrame(large, "path string, layout string")) if large else small


def _as_written(name: str, kind: str, target: T.DataType) -> Column:
    """A column of a file in the contract's type, or null where its value does not fit."""
    value = F.col(name)
    if kind == "void":
        return value.cast(target)
    if kind == "nanos":
        # Whole microseconds, downwards.
        value = F.timestamp_micros(F.expr(f"(`{name}` - pmod(`{name}`, 1000L)) div 1000L"))
    if isinstance(target, T.IntegerType) and kind != "int":
        whole = value.try_cast("int")
        return F.when(whole.cast("double") == value.try_cast("double"), whole)
    return value.try_cast(target)


def scan(spark: SparkSession, raw: str, columns: T.StructType = schema.RESULTS) -> DataFrame:
    """All files under `raw` with the columns of the contract, and for each of KEYS whether
    the file held a value (`has_Year`, ...) that may not have fitted.

    Folders may name columns (`Year=2001`), which then need not be in the files.
    """
    found = stage(layouts(spark, raw), "raw_layouts")
    parts = []
    # A few distinct layouts, and the file names that Spark needs to list anyway.
    for row in found.groupBy("layout").agg(F.collect_list("path").alias("paths")).collect():
        held = {k: v for k, v in json.loads(row["layout"]).items() if k in columns.fieldNames()}
        if "unknown" in held.values():
            raise TypeError(f"columns of no type of the contract: {sorted(k for k, v in held.items() if v == 'unknown')}")
        if "nanos" in held.values():
            # Read only for files that could not be read otherwise.
            spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
        # A column that is not in the files may be in the names of their folders.
        kinds = {c: held.get(c) or columns[c].dataType.simpleString() for c in columns.fieldNames()}
        declared = ", ".join(f"`{c}` {'bigint' if k == 'nanos' else k}" for c, k in kinds.items() if k != "void")
        rows = spark.read.schema(declared).option("basePath", raw).parquet(*row["paths"])
        rows = rows.select("*", *[F.lit(None).alias(c) for c, k in kinds.items() if k == "void"])
        keys = [F.col(c).isNotNull().alias(f"has_{c}") for c in KEYS]
        parts.append(rows.select(*[_as_written(c, k, columns[c].dataType).alias(c) for c, k in kinds.items()], *keys))
    if not parts:
        return spark.createDataFrame([], columns).select("*", *[F.lit(False).alias(f"has_{c}") for c in KEYS])
    return reduce(DataFrame.unionByName, parts)


def read(spark: SparkSession, raw: str, columns: T.StructType = schema.RESULTS) -> DataFrame:
    """The contract's columns and `reason`: null for a good row, else why it is rejected."""
    rows = scan(spark, raw, columns)
    reasons = []
    for c in KEYS:
        reasons.append(F.when(F.col(c).isNull() & F.col(f"has_{c}"), F.lit(f"{c} does not fit")))
        reasons.append(F.when(F.col(c).isNull(), F.lit(f"{c} is missing")))
    reason = F.coalesce(*reasons).alias("reason")
    return normalise(rows).select(*columns.fieldNames(), reason)


def consolidate(spark: SparkSession, raw: str, columns: T.StructType = schema.RESULTS) -> tuple[DataFrame, DataFrame, Observation]:
    """(good rows, rejected rows with their reason, counts).

    The counts `rows` and `rejected` are taken in the pass that reads the good rows, and
    are there once that has run; rejected rows need a pass of their own only if there are any.
    """
    rows = read(observing_session(spark), raw, columns)
    counts = Observation()
    seen = rows.observe(counts, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
    return seen.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL"), counts
