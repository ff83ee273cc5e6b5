"""The trie of conversation prefixes, screened by a count-min sketch.

A prefix is named by the XOR of its turns' digests, each mixed with its place; turns
themselves become digests before anything moves. All names go through a count-min sketch.
It never counts too little, so an estimate of one proves that no other conversation has
that prefix: the node is complete where it stands and its row is put out as it is. Only
prefixes that may be shared are shuffled and grouped exactly. The sketch keeps of each
cell whether two or more fell into it, which is all the screen asks; it grows with the
rows up to 2 x 16 MiB, beyond which more prefixes than needed are grouped, with the same
result.

No step runs level by level. What a node sums over its subtree is a sum over its members:
a member adds one leaf if it stands for the leaf it ends in, and it saves the tokens
between the node and the first node of its path of which it is the smallest member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwall.llm.common import columns_of, shuffle_partitions, stage, text_rows, whole

#: A conversation borrows from the first of its hundred; at most LONGEST turns.
HUNDRED = 100
LONGEST = 5
#: Turns of one conversation that a task sums up at a time.
PIECE = 1 << 16
#: Cells of each row of the sketch for one prefix, their bounds, and cells in one block of it.
CELLS = 8
LEAST, MOST = 1 << 16, 1 << 27
BLOCK = 1 << 16
FLUSH = 1 << 20
#: Bytes of conversation ids that move as one row.
JOINED = 4096

KEY = ["depth", "p", "q"]


def _sum_before(by: list[str], value: Column, part: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))


def turns(conversations: DataFrame) -> DataFrame:
    """(c, i, h, g, n): the place of every turn in its conversation from 1, two digests of it, its code points.

    Turns are dealt out by ranges of (conversation, turn), so a conversation of any length
    is spread; each range is numbered by itself and starts where the one before ended.
    """
    role, text = whole("role"), whole("text")
    rows = columns_of(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn",
        F.xxhash64(F.lit("h"), role, text).alias("h"), F.xxhash64(F.lit("g"), role, text).alias("g"),
        F.length(text).cast("long").alias("n"),
    )
    rows = stage(rows, "trie_turns")
    parts = shuffle_partitions(rows.sparkSession)
    order = ["c", F.col("turn").asc_nulls_first(), "h", "g"]
    rows = stage(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "trie_ranges")
    sizes = rows.groupBy("c", "part").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.withColumn("start", _sum_before(["c"], F.col("size"), "part")).where("start IS NOT NULL").select("c", "part", "start")
    place = F.row_number().over(Window.partitionBy("c", "part").orderBy(*order[1:]))
    return rows.withColumn("place", place).join(stage(starts, "trie_starts"), ["c", "part"], "left").select(
        "c", (F.coalesce("start", F.lit(0)) + F.col("place")).alias("i"), "h", "g", "n"
    )


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, depth, h, g, n) of the rebuilt conversations, and (c, length) of all of them.

    The first h turns of conversation c - c % 100 stand before the conversation's own
    turns after its first h, where h is the CRC-32 of its number modulo 6.
    """
    sizes = stage(own.groupBy("c").agg(F.max("i").alias("size")), "trie_sizes")
    donor = (F.col("c") - F.col("c") % HUNDRED).alias("donor")
    lent = F.least(F.col("skip"), F.coalesce("held", F.lit(0)))
    conversations = sizes.select("c", "size", donor, (F.crc32(F.col("c").cast("string").cast("binary")) % (LONGEST + 1)).alias("skip"))
    donors = sizes.select(F.col("c").alias("donor"), F.least("size", F.lit(LONGEST)).alias("held"))
    conversations = conversations.join(donors, "donor", "left").select("c", "donor", "skip", "size", lent.alias("lent"))
    conversations = stage(conversations, "trie_conversations")
    rest = own.join(conversations.select("c", "skip", "lent"), "c").where("i > skip").select(
        "c", (F.col("i") - F.col("skip") + F.col("lent")).alias("depth"), "h", "g", "n"
    )
    first = own.where((F.col("i") <= LONGEST) & (F.col("c") % HUNDRED == 0)).withColumnRenamed("c", "donor")
    borrowed = conversations.where("lent > 0").select("c", "donor", "lent").join(first, "donor").where("i <= lent").select(
        "c", F.col("i").alias("depth"), "h", "g", "n"
    )
    length = (F.col("lent") + F.greatest(F.col("size") - F.col("skip"), F.lit(0))).alias("length")
    return rest.unionByName(borrowed), conversations.select("c", length)


def prefixes(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """(c, depth, p, q, up_p, up_q, before, n, ends) of every prefix, the empty one included.

    p and q name the prefix, up_p and up_q the one before; before: code points of all its
    turns but the last; ends: whether the conversation is no longer.
    """
    mixed = steps.select(
        "c", "depth", "n", F.xxhash64("depth", "h").alias("x"), F.xxhash64("depth", "g", F.lit("g")).alias("y"),
        F.expr(f"(depth - 1) div {PIECE}").alias("piece"),
    )
    mixed = stage(mixed, "trie_steps")
    within = Window.partitionBy("c", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Conversations of more than one piece, whose later pieces go on from the sums of the earlier ones.
    long = mixed.where(F.col("depth") == PIECE + 1).select("c")
    totals = mixed.join(long, "c", "left_semi").groupBy("c", "piece").agg(
        F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("n").alias("n")
    )
    earlier = Window.partitionBy("c").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "c", "piece", F.bit_xor("x").over(earlier).alias("x0"), F.bit_xor("y").over(earlier).alias("y0"), F.sum("n").over(earlier).alias("n0")
    ).where("piece > 0")
    zero = F.lit(0).cast("long")
    named = mixed.select(
        "c", "depth", "piece", "n", "x", "y",
        F.bit_xor("x").over(within).alias("p"), F.bit_xor("y").over(within).alias("q"), F.sum("n").over(within).alias("path"),
    ).join(stage(carried, "trie_carried"), ["c", "piece"], "left")
    p = F.col("p").bitwiseXOR(F.coalesce("x0", zero))
    q = F.col("q").bitwiseXOR(F.coalesce("y0", zero))
    named = named.select(
        "c", "depth", p.alias("p"), q.alias("q"), p.bitwiseXOR(F.col("x")).alias("up_p"), q.bitwiseXOR(F.col("y")).alias("up_q"),
        (F.col("path") + F.coalesce("n0", zero) - F.col("n")).alias("before"), "n",
    )
    empty = lengths.select("c", zero.alias("depth"), zero.alias("p"), zero.alias("q"), F.lit(None).cast("long").alias("up_p"),
                           F.lit(None).cast("long").alias("up_q"), zero.alias("before"), zero.alias("n"))
    return named.unionByName(empty).join(lengths, "c").withColumn("ends", F.col("depth") == F.col("length")).drop("length")


def _sketch(names: DataFrame, cells: int) -> list[np.ndarray]:
    """Of each of the two rows of the sketch one bit for each cell: whether two or more prefixes fell into it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for row, parts in enumerate(held):
                places, times = np.unique(np.concatenate(parts), return_counts=True)
                cuts = np.flatnonzero(np.diff(places >> 16)) + 1
                for at, many in zip(np.split(places, cuts), np.split(times > 1, cuts), strict=True):
                    low = (at & (BLOCK - 1)).astype(np.uint16)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row], pa.int32()), pa.array([int(at[0] >> 16)], pa.int32()),
                         pa.array([low.tobytes()], pa.binary()), pa.array([low[many].tobytes()], pa.binary())],
                        names=["row", "block", "met", "again"],
                    )

        for batch in batches:
            for parts, name in zip(held, ("p", "q"), strict=True):
                parts.append(batch.column(name).to_numpy() & (cells - 1))
            size += batch.num_rows
            if size >= FLUSH:
                yield from flush()
                held, size = [[], []], 0
        if size:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for row, block, met, again in text_rows(batches, "row", "block", "met", "again"):
            one, two = seen.setdefault((row, block), (np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)))
            met = np.frombuffer(met, np.uint16)
            two[met[one[met]]] = True
            two[np.frombuffer(again, np.uint16)] = True
            one[met] = True
        for (row, block), (_, two) in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(two).tobytes()], pa.binary())],
                names=["row", "block", "bits"],
            )

    parts = shuffle_partitions(names.sparkSession)
    found = (
        names.select("p", "q").mapInArrow(count, "row int, block int, met binary, again binary")
        .repartition(parts, "row", "block").mapInArrow(merge, "row int, block int, bits binary")
    )
    out = [np.zeros(cells // 8, np.uint8) for _ in range(2)]
    # 2 x MOST / 8 bytes at most, whatever the rows.
    for row, block, bits in found.collect():
        out[row][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)] = np.frombuffer(bits, np.uint8)
    return out


def screened(names: DataFrame) -> DataFrame:
    """`names` with `shared` and, of the prefix before, `above`: false only where no other conversation has it."""
    cells = min(MOST, max(LEAST, 1 << (CELLS * names.count()).bit_length()))
    bits = names.sparkSession.sparkContext.broadcast(_sketch(names, cells))
    schema = f"{', '.join(f'{n} {t}' for n, t in names.dtypes)}, shared boolean, above boolean"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = bits.value

        def several(batch: pa.RecordBatch, *columns: str) -> pa.Array:
            out = np.ones(batch.num_rows, bool)
            for row, name in zip(maps, columns, strict=True):
                at = batch.column(name).fill_null(0).to_numpy() & (cells - 1)
                out &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            return pa.array(out)

        for batch in batches:
            flags = [several(batch, "p", "q"), several(batch, "up_p", "up_q")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *flags], names=[*batch.schema.names, "shared", "above"])

    return names.mapInArrow(look, schema)


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, p, q, ends_sha256) from (depth, p, q, c): SHA-256 of the numbers in order, joined by commas.

    The numbers are put in order over the whole table and joined to short runs by the
    tasks that hold them, so that the one task that must read all of a node's members
    streams a few long rows.
    """
    parts = shuffle_partitions(ends.sparkSession)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, held, size = None, None, [], 0

        def row() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*own, first, ",".join(held)), kinds, strict=True)],
                                              names=[*KEY, "first", "joined"])

        for depth, p, q, c in text_rows(batches, *KEY, "c"):
            if own != (depth, p, q) or size > JOINED:
                if held:
                    yield row()
                own, first, held, size = (depth, p, q), c, [], 0
            held.append(str(c))
            size += len(held[-1]) + 1
        if held:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None

        def row() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*own, state.hexdigest()), kinds, strict=True)],
                                              names=[*KEY, "ends_sha256"])

        for depth, p, q, joined in text_rows(batches, *KEY, "joined"):
            if own != (depth, p, q):
                if state:
                    yield row()
                own, state = (depth, p, q), hashlib.sha256(joined.encode())
            else:
                state.update(b"," + joined.encode())
        if state:
            yield row()

    runs = ends.select(*KEY, "c").repartitionByRange(parts, *KEY, "c").sortWithinPartitions(*KEY, "c")
    runs = runs.mapInArrow(join, "depth long, p long, q long, first long, joined string")
    return runs.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(
        digest, "depth long, p long, q long, ends_sha256 string"
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of `conversations` (conv_id, turn, role, text), rebuilt: conv_id
    (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns stand in order of turn, null first; turns of equal number in order of their
    digests, and repeated rows as often as they are there. A null role or text is an empty
    one. Rows without conv_id take no part. A conversation left without turns is a member
    of the root alone. An empty table gives no rows, not even a root; other columns are
    ignored. Names of prefixes have 128 bits, which are taken to tell them apart.
    """
    zero = F.lit(0).cast("long")
    own = stage(turns(conversations), "trie_own")
    steps, lengths = rebuilt(own)
    lengths = stage(lengths, "trie_lengths")
    names = stage(prefixes(steps, lengths), "trie_prefixes")
    names = stage(screened(names), "trie_screened")
    alone, shared = names.where("NOT shared"), names.where("shared")
    tops = alone.where("above AND depth > 0")

    # Possibly shared prefixes, exactly: smallest member, and what follows from it.
    nodes = shared.groupBy(*KEY).agg(
        F.min("c").alias("conv_id"), F.any_value("up_p").alias("up_p"), F.any_value("up_q").alias("up_q"), F.any_value("before").alias("before")
    )
    nodes = stage(nodes, "trie_nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_p").alias("p"), F.col("up_q").alias("q")]
    kids = nodes.where("depth > 0").select(*up).unionByName(tops.select(*up))
    kids = kids.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie_parents")

    # Where each conversation becomes the smallest member, and whether it stands for a leaf.
    first = nodes.select("conv_id", "before", (F.col("n_children") == 0).alias("leaf")).unionByName(
        alone.select(F.col("c").alias("conv_id"), "before", F.col("ends").alias("leaf"))
    ).groupBy("conv_id").agg(F.min("before").alias("mine"), F.max("leaf").alias("leaf"))
    path = names.where("ends").select("c", (F.col("before") + F.col("n")).alias("path"))
    members = path.join(first.withColumnRenamed("conv_id", "c"), "c", "left").select(
        "c", F.coalesce("mine", "path").alias("mine"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf")
    )
    members = stage(members, "trie_members")
    saved = F.greatest(F.col("mine") - F.col("before"), zero)
    sums = shared.select("c", *KEY, "before").join(members, "c").groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens")
    )

    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    found = nodes.join(sums, KEY).join(_digests(shared.where("ends")), KEY, "left").select(
        "conv_id", "depth", "up_p", "up_q", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )

    def tail(rows: DataFrame) -> DataFrame:
        """Nodes of one member, which need nothing but their own row."""
        return rows.select(
            F.col("c").alias("conv_id"), "depth", "up_p", "up_q", F.lit(1).cast("long").alias("n_convs"),
            F.when(F.col("ends"), 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
            zero.alias("saved_tokens"),
            F.when(F.col("ends"), F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"),
        )

    # The parent's smallest member is asked for by shared nodes and the tops of tails; the rest of a tail has its own.
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("p").alias("up_p"), F.col("q").alias("up_q"), F.col("conv_id").alias("parent")
    )
    rows = found.unionByName(tail(tops)).join(parents, ["depth", "up_p", "up_q"], "left")
    rest = tail(alone.where("NOT above OR depth = 0")).withColumn("parent", F.lit(None).cast("long"))
    return rows.unionByName(rest).select(
        "conv_id", "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )
