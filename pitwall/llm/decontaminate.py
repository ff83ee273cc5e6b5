"""Benchmark passages in documents, by SimHash of item-sized windows.

Everything is DataFrame operations. A shingle is five neighbouring words, as many as the
item has if it is shorter. Where a document has a shingle of an item, windows of the item's length are
laid at every start that takes the shingle in. A running count of the shingles that any
item has drops those windows, and no others, that cannot be similar to an item. Every
window left gets a 64-bit SimHash, each shingle as often as it occurs, from running sums
over the document. The bits are cut into blocks: two fingerprints within RADIUS differ in
some block by RADIUS // BLOCKS bits at most, so looking up each block of a window among the
items' blocks and all their neighbours by that many bits finds all items within the radius.
Candidates are kept when the weighted overlap of the shingles, weights being their counts,
is 0.8 of the weighted union or more. A shingle adds to the overlap of the windows that
begin at or before it, and after the place where the item's count of it is used up; so the
overlaps of all windows come from one running sum as well, and the work grows with the
length of an item, not with its square.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwall.llm.common import columns_of, narrowed, stage, whole

WORDS = 5
RADIUS = 19
#: Widths of the blocks; 64 bits in all.
BLOCKS = (13, 13, 13, 13, 12)
#: Bits b and b + 32 of a fingerprint, counted in two lanes of one number.
LANES = 0x0000000100000001

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: F.Column) -> F.Column:
    """The words of a text, A-Z in lower case."""
    parts = F.split(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def shingles(text: F.Column, width: int = WORDS) -> F.Column:
    """Hashes of the shingles of a text, in order; none for no words, one for fewer than `width`.

    The words are bound as the one element of an array, else they would be split anew
    for every shingle.
    """

    def of(w: F.Column) -> F.Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
        made = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) > 0, made).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words(text)), of), F.lit(0))


def _bits() -> list[F.Column]:
    """The bits of h in lanes, to be summed."""
    return [F.shiftrightunsigned("h", b).bitwiseAND(F.lit(LANES)).alias(f"s{b}") for b in range(32)]


def _print() -> F.Column:
    """The SimHash of n shingles whose lanes have the sums s0 to s31."""
    total = F.lit(0).cast("long")
    for b in range(32):
        for lane in range(2):
            ones = f"(shiftrightunsigned(s{b}, {32 * lane}) & 4294967295L)"
            total = total.bitwiseOR(F.expr(f"if(2 * {ones} > n, shiftleft(1L, {b + 32 * lane}), 0L)"))
    return total


def _fingerprints(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds `print`, the SimHash of the array `held`."""
    flat = rows.select(*key, F.explode("held").alias("h")).select(*key, *_bits())
    counted = flat.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"s{b}").alias(f"s{b}") for b in range(32)])
    return rows.join(counted.select(*key, _print().alias("print")), key)


def _running(key: list[str], *order: str) -> Window:
    return Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _windows(anchors: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, copy, n_words, start, stop (shingles) of each window that may be similar to an item.

    `anchors` are the places of items' shingles. Similar texts have 0.8 of the window's
    shingles in common at least.
    """
    key = ["doc_id", "copy", "n_words"]
    lengths = items.select("n_words", F.explode("held").alias("h")).distinct()
    width = F.greatest(F.col("n_words") - (WORDS - 1), F.lit(1))
    widths = anchors.join(lengths, "h").select(*key).distinct().withColumn("width", width)
    # Reached: starts that take in a shingle of an item of this length. Shared: shingles of any item.
    own = anchors.join(lengths, "h").select(*key, "pos", F.lit(1).alias("own")).distinct()
    marks = anchors.select("doc_id", "copy", "size", "pos").distinct().join(widths, ["doc_id", "copy"])
    marks = marks.join(own, [*key, "pos"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    begin = F.struct(F.greatest(F.col("pos") - F.col("width") + 1, F.lit(0)).alias("at"), F.lit(1).alias("d"))
    end = F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("d"))
    steps = marks.select(*key, "width", "size", "own", F.explode(F.array(begin, end)).alias("e"))
    steps = steps.groupBy(*key, "width", "size", F.col("e.at").alias("at")).agg(
        F.sum("e.d").alias("shared"), F.sum(F.col("e.d") * F.col("own")).alias("reached")
    )
    runs = steps.select(
        *key, "width", "size", "at",
        F.lead("at").over(Window.partitionBy(*key).orderBy("at")).alias("next"),
        *[F.sum(c).over(_running(key, "at")).alias(c) for c in ("shared", "reached")],
    )
    # The least window of a run is its last, where the text ends.
    least = F.least(F.col("width"), F.col("size") - F.col("next") + 1)
    runs = runs.where((F.col("reached") > 0) & (5 * F.col("shared") >= 4 * least))
    starts = runs.withColumn("start", F.explode(F.sequence("at", F.col("next") - 1)))
    starts = starts.withColumn("stop", F.least(F.col("start") + F.col("width"), F.col("size")))
    return starts.where(5 * F.col("shared") >= 4 * (F.col("stop") - F.col("start"))).select(*key, "start", "stop")


def _window_prints(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """`windows` with their SimHash `print`: differences of running sums over the part of the text that has windows."""
    key = ["doc_id", "copy"]
    part = windows.groupBy(*key).agg(F.min("start").alias("first"), F.max("stop").alias("last"))
    held = narrowed(texts, part.select("doc_id"), "doc_id").select("doc_id", _copy(), "text").join(part, key)
    held = held.dropDuplicates(key)
    held = held.select(
        *key, "first", F.posexplode(F.slice(shingles(whole()), F.col("first") + 1, F.col("last") - F.col("first"))).alias("i", "h")
    )
    rows = held.select(
        *key, (F.col("first") + F.col("i")).alias("at"), F.lit(1).alias("turn"), "h",
        *[F.lit(None).cast("int").alias(c) for c in ("n_words", "start", "stop", "sign")],
    )
    # A window's bounds stand before the shingle at their place.
    bounds = F.array(
        F.struct(F.col("start").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("stop").alias("at"), F.lit(1).alias("sign"))
    )
    asked = windows.select(*key, "n_words", "start", "stop", F.explode(bounds).alias("b")).select(
        *key, "b.at", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("h"), "n_words", "start", "stop", "b.sign"
    )
    over = _running(key, "at", "turn")
    sums = rows.unionByName(asked).select(*key, "n_words", "start", "stop", "sign", "at", "turn", *_bits())
    sums = sums.select(*key, "n_words", "start", "stop", "sign", *[F.sum(f"s{b}").over(over).alias(f"s{b}") for b in range(32)])
    sums = sums.where("sign IS NOT NULL").groupBy(*key, "n_words", "start", "stop").agg(
        *[F.sum(F.col("sign") * F.col(f"s{b}")).alias(f"s{b}") for b in range(32)]
    )
    return sums.withColumn("n", F.col("stop") - F.col("start")).select(*key, "n_words", "start", "stop", _print().alias("print"))


def _overlaps(anchors: DataFrame, items: DataFrame, pairs: DataFrame) -> DataFrame:
    """`pairs` of windows and items with `overlap`, the number of shingles in common."""
    key = ["doc_id", "copy", "n_words", "item_no"]
    counts = items.select("item_no", F.explode("held").alias("h")).groupBy("item_no", "h").agg(F.count(F.lit(1)).cast("int").alias("k"))
    places = anchors.groupBy("doc_id", "copy", "h").agg(F.sort_array(F.collect_set("pos")).alias("places"))
    hits = pairs.select(*key).distinct().join(places, ["doc_id", "copy"]).join(counts, ["item_no", "h"])
    hits = hits.withColumn("width", F.greatest(F.col("n_words") - (WORDS - 1), F.lit(1)))
    spans = F.expr(
        "transform(places, (p, i) -> struct(greatest(0, p - width + 1, if(i >= k, places[i - k] + 1, 0)) AS lo, p + 1 AS hi))"
    )
    spans = hits.select(*key, F.explode(spans).alias("s"))
    steps = spans.select(*key, F.explode(F.expr("array(struct(s.lo AS at, 1 AS d), struct(s.hi AS at, -1 AS d))")).alias("e"))
    steps = steps.groupBy(*key, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d")).withColumn("turn", F.lit(0))
    asked = pairs.withColumn("at", F.col("start")).withColumn("d", F.lit(0).cast("long")).withColumn("turn", F.lit(1))
    rows = steps.unionByName(asked, allowMissingColumns=True)
    rows = rows.withColumn("overlap", F.sum("d").over(_running(key, "at", "turn")))
    return rows.where("turn = 1").select(*pairs.columns, "overlap")


def _copy() -> F.Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(whole()).alias("copy")


def _blocks() -> F.Column:
    parts, at = [], 0
    for number, width in enumerate(BLOCKS):
        value = F.shiftrightunsigned("print", at).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        parts.append(F.struct(F.lit(number).alias("block"), F.lit(width).alias("width"), value.alias("value")))
        at += width
    return F.explode(F.array(*parts))


def _near_masks(width: int) -> list[int]:
    return [sum(1 << b for b in c) for n in range(RADIUS // len(BLOCKS) + 1) for c in combinations(range(width), n)]


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """item_id, n_words, held (shingles in order) and print of each distinct item text with words."""
    items = columns_of(benchmark, "item_id", "text").where("item_id IS NOT NULL")
    items = items.select("item_id", F.size(words(whole())).alias("n_words"), shingles(whole()).alias("held"))
    items = items.where(F.size("held") > 0).dropDuplicates(["item_id", "held"])
    items = items.withColumn("item_no", F.xxhash64("item_id", "held"))
    return stage(_fingerprints(items, ["item_no"]), "decontam_items")


def _short(texts: DataFrame, items: DataFrame) -> DataFrame:
    """The result rows of items of under five words.

    Shingles and windows are then as long as the item, so a window has one shingle, which
    is its fingerprint as well: it is similar where it is equal.
    """
    found = None
    held = items.where(F.col("n_words") < WORDS).select("item_id", "n_words", F.col("print").alias("h"))
    for row in held.select("n_words").distinct().orderBy("n_words").collect():  # four at most
        places = texts.select("doc_id", F.posexplode(shingles(whole(), row["n_words"])).alias("start", "h"))
        same = places.join(held.where(F.col("n_words") == row["n_words"]), "h").select("doc_id", "item_id", "n_words", "start")
        found = same if found is None else found.unionByName(same)
    if found is None:
        found = texts.where("false").select("doc_id").crossJoin(held.where("false").select("item_id", "n_words")).withColumn("start", F.lit(0))
    return found.groupBy("doc_id", "item_id").agg(
        F.countDistinct("start", "n_words").alias("n_windows"), F.min("start").alias("start"),
    ).select("doc_id", "item_id", "n_windows", "start", F.lit(0).alias("hamming"), F.lit(1.0).alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it.

    doc_id, item_id, n_windows (similar windows), start (first word of the best, from 0),
    hamming and similarity of the best. `docs` has doc_id and text, `benchmark` item_id
    and text. Null and empty texts hold nothing; rows without an id are left out; an item
    of n words, under five, has n-word shingles and is found wherever its words stand.
    Repeated rows give the rows of one. Items may have any length. An empty table on either side gives no rows; other columns are ignored.
    """
    texts = columns_of(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    every = item_shingles(benchmark)
    short, items = _short(texts, every), every.where(F.col("n_words") >= WORDS)
    grams = stage(items.select(F.explode("held").alias("h")).distinct(), "decontam_shingles")
    places = texts.select("doc_id", _copy(), F.explode(F.array(shingles(whole()))).alias("all"))
    places = places.select("doc_id", "copy", F.size("all").alias("size"), F.posexplode("all").alias("pos", "h"))
    anchors = stage(places.join(grams, "h").distinct(), "decontam_anchors")
    windows = stage(_windows(anchors, items), "decontam_windows")
    windows = stage(_window_prints(texts, windows), "decontam_prints")

    masks = F.create_map(*[
        x for width in sorted(set(BLOCKS)) for x in (F.lit(width), F.array(*[F.lit(m) for m in _near_masks(width)]))
    ])
    near = items.select("item_no", F.col("print").alias("item_print"), _blocks().alias("b"))
    near = near.select("item_no", "item_print", "b.block", "b.value", F.explode(masks[F.col("b.width")]).alias("mask"))
    near = near.select("item_no", "item_print", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    # Neighbouring windows share fingerprints: each is looked up once.
    prints = windows.select("print").distinct()
    probes = prints.select("print", _blocks().alias("b")).select("print", "b.block", "b.value")
    hamming = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    alike = (
        probes.join(stage(near, "decontam_near"), ["block", "value"])
        .withColumn("hamming", hamming)
        .where(F.col("hamming") <= RADIUS)
        .select("print", "item_no", "hamming")
        .distinct()
    )
    pairs = stage(windows.join(alike, "print").drop("print"), "decontam_pairs")
    sizes = items.select("item_no", "item_id", F.size("held").alias("item_size"))
    checked = _overlaps(anchors, items, pairs).join(sizes, "item_no")
    union = F.col("stop") - F.col("start") + F.col("item_size") - F.col("overlap")
    found = checked.where(5 * F.col("overlap") >= 4 * union).withColumn("similarity", F.col("overlap") / union)
    best = F.max_by(
        F.struct("start", "hamming", "similarity"), F.struct("similarity", -F.col("hamming"), -F.col("start"))
    ).alias("best")
    long = found.groupBy("doc_id", "item_id").agg(F.countDistinct("start", "n_words").alias("n_windows"), best).select(
        "doc_id", "item_id", "n_windows", "best.start", "best.hamming", "best.similarity"
    )
    # Different texts of one item, short and long.
    first = F.min_by(F.struct("start", "hamming", "similarity"), F.struct(-F.col("similarity"), "hamming", "start")).alias("best")
    return long.unionByName(short).groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"), first).select(
        "doc_id", "item_id", "n_windows", "best.start", "best.hamming", "best.similarity"
    )
