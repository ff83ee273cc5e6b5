"""Shards of near equal size, by longest-processing-time scheduling of groups.

Rows of equal text stay together. Groups go to shards in order of their bytes, largest
first, each to the least loaded shard, through a heap. The heap deals out size classes,
not single groups: groups of equal size are interchangeable, and sizes are told apart to
twelve binary digits (exactly below 4,096). So there are at most some 100,000 classes
whatever the number of rows, and only these reach the driver. Which group of a class goes
where is its rank there, counted in parts so that no task holds a whole class.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitwall.llm.common import columns_of, shuffle_partitions, stage, whole

SHARDS = 24
#: Bytes that a row takes beside its text.
ROW_BYTES = 8
DIGITS = 12
#: Rows of a shard that one task numbers.
NUMBERED = 100_000


def deal(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """(class, ends, shards) from (class, groups, bytes): ranks below ends[i] go to shards[i].

    The heap holds the shards by load. A step gives the least loaded shard as many groups
    as bring it level with the next; when loads are within one group of each other,
    whole rounds are dealt at once.
    """
    heap = [(0.0, s) for s in range(shards)]
    plan = []
    for name, groups, total in sorted(classes, reverse=True):
        each, left, given = total / groups, groups, [0] * shards
        while left:
            least, shard = heap[0]
            if left >= shards and max(heap)[0] - least <= each:
                rounds = left // shards
                heap = [(load + rounds * each, s) for load, s in heap]
                given = [n + rounds for n in given]
                left -= rounds * shards
                continue
            heapq.heappop(heap)
            gap = heap[0][0] - least if heap else left * each
            some = min(left, max(1, int(gap // each)))
            heapq.heappush(heap, (least + some * each, shard))
            given[shard] += some
            left -= some
        ends, which, at = [], [], 0
        for shard, some in enumerate(given):
            if some:
                at += some
                ends.append(at)
                which.append(shard)
        plan.append((name, ends, which))
    return plan


def _rank(df: DataFrame, key: list[str], order: list[str], parts: int, name: str) -> DataFrame:
    """Adds a number from 0 without gaps within `key`. A part of a key is numbered by one task and starts where the last ends."""
    cut = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sizes = cut.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*order)) - 1
    joined = cut.withColumn("_at", within).join(starts, [*key, "_part"])
    return joined.withColumn(name, (F.col("_start") + F.col("_at")).cast("long")).drop("_start", "_at", "_part")


def lpt_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, size, text_crc32, shard, slot.

    size: UTF-8 bytes plus 8. A null text counts and groups as an empty one. Slots run
    from 0 without gaps in each shard, roughly in no order; rows that repeat a doc_id get
    slots of their own. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = whole()
    rows = stage(
        columns_of(docs, "doc_id", "text").select(
            "doc_id",
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("same"),
        ),
        "shard_rows",
    )
    parts = shuffle_partitions(spark)
    groups = rows.groupBy("same").agg(F.sum("size").alias("bytes"))
    digits = F.greatest(F.length(F.bin("bytes")) - DIGITS, F.lit(0))
    groups = groups.withColumn("digits", digits).withColumn(
        "class", F.expr("shiftleft(shiftright(bytes, digits), digits)")
    )
    groups = stage(groups.select("same", "class", "bytes"), "shard_groups")
    classes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("groups"), F.sum("bytes").alias("bytes"))
    plan = deal([tuple(r) for r in classes.collect()], shards)
    schema = T.StructType([
        T.StructField("class", T.LongType()),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("which", T.ArrayType(T.IntegerType())),
    ])
    plan_rows = stage(spark.createDataFrame(plan, schema), "shard_plan")
    ranked = _rank(groups.select("same", "class"), ["class"], ["same"], parts, "rank").join(plan_rows, "class")
    placed = ranked.select(
        "same", F.expr("element_at(which, 1 + size(filter(ends, e -> e <= rank)))").alias("shard")
    )
    placed = stage(rows.join(stage(placed, "shard_of_group"), "same").drop("same"), "shard_of_row")
    total = placed.count()
    slots = _rank(placed, ["shard"], ["doc_id", "text_crc32", "size"], max(parts, total // (shards * NUMBERED)), "slot")
    return slots.select("doc_id", "size", "text_crc32", "shard", "slot")
