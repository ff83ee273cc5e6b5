"""Connected components of an edge table, by rounds of hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of `edges` (a, b: long).

    Every round replaces an edge by edges to the smallest neighbour of its larger end and
    of its smaller end in turn. Neighbours are reduced to a minimum before they move, so
    a node with very many edges costs one row for each task. Each round is written to the
    shared folder; the loop ends when a round changes nothing. Rows with a null end or
    equal ends add nothing. No edges give an empty table.
    """
    pairs = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    pairs = stage(pairs, "edges")
    seen = None
    while True:
        # The larger neighbours of a node, and the node, move to its smallest neighbour.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        )
        large = large.distinct()
        # The smaller neighbours of a node, and the node, move to the smallest of them.
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(floor, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                      F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        pairs = stage(small, "edges")
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = state
