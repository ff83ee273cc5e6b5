"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwall.session import stage, staging_path

__all__ = ["columns_of", "giving_back", "narrowed", "shuffle_partitions", "stage", "staging_path", "text_rows", "whole", "without"]


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash later."""
    return df.select(*[F.col(f"`{name}`") for name in names])


def whole(column: str = "text") -> F.Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns, one slice of 256 at a time: a batch of long texts is not copied whole."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield from zip(*[part.column(part.schema.get_field_index(name)).to_pylist() for name in names], strict=True)


def _return_memory() -> None:
    """Workers live on from task to task; Arrow and glibc keep freed memory for the next one unless asked."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def giving_back(*stores: dict) -> Callable:
    """For functions over batches: at their end the worker empties `stores` and returns what memory it no longer uses,
    Arrow's and, where the C library can, that of arrays and objects."""

    def around(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
        @wraps(run)
        def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from run(batches)
            finally:
                for store in stores:
                    store.clear()
                _return_memory()

        return wrapped

    return around


#: Bits of the map that `narrowed` broadcasts: 4 MiB, whatever the number of keys.
MAP_BITS = 1 << 25


def _marked(df: DataFrame, keys: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` with a column that says whether `name` may be among `keys`, and that column's name.

    It is false only for values that are not. Keys become bits of a map of fixed size, in
    rows of 4 KiB, 1,024 at most, which is broadcast. With very many keys the map fills
    up and marks all rows. The helping columns have names that no table has.
    """
    tag = uuid.uuid4().hex
    bucket, bit, bits, maybe = (f"{x}_{tag}" for x in ("bucket", "bit", "bits", "maybe"))
    place = F.pmod(F.xxhash64(name), F.lit(MAP_BITS)) + 1
    maps = keys.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias(bucket)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias(bits)
    )
    maps = stage(maps, "bitmap")
    marked = df.withColumn(bucket, F.bitmap_bucket_number(place)).withColumn(bit, F.bitmap_bit_position(place))
    marked = marked.join(F.broadcast(maps), bucket, "left")
    held = f"(cast(conv(hex(substring({bits}, cast({bit} div 8 as int) + 1, 1)), 16, 10) as int) >> cast({bit} % 8 as int)) & 1"
    return marked.withColumn(maybe, F.expr(f"{bits} IS NOT NULL AND {held} = 1")).drop(bucket, bit, bits), maybe


def narrowed(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of `df` whose `name` may be among `keys`; no such row is lost.

    Wide rows that no key wants stay out of the shuffle of the join that follows.
    """
    marked, maybe = _marked(df, keys, name)
    return marked.where(maybe).drop(maybe)


def without(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Rows of `df` whose `name` is not among `ids`. Only rows that may be move for the join; null names stay."""
    marked, maybe = _marked(df, ids, name)
    sure = F.col(name).isNull() | ~F.col(maybe)
    rest = marked.where(~sure).join(ids.select(name).distinct(), name, "left_anti")
    return marked.where(sure).select(*df.columns).unionByName(rest.select(*df.columns))
