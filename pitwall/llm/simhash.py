"""SimHash near-duplicates, with pigeonring filtering of the candidates.

A fingerprint is a ring of four segments of 16 bits. Two fingerprints that differ in three
bits or fewer have a segment from which on the ring every chain of 1, 2, 3 and 4 segments
differs in no more than its share of the budget: 0, 1, 2 and 3 bits. So for each of the
four starts a fingerprint is turned until that segment stands first, and goes to the
bucket of its first two segments, and as a visitor to the buckets whose second segment has
one bit more. Who meets in a bucket keeps the first two budgets; the third is checked
next, and only what is left is compared as a whole.

A bucket may hold near copies by the thousand. One that outgrows `BUCKET` is not compared:
its rows go on to buckets of three segments, again with visitors as far as the third budget
allows. There the homes differ in their last segment alone, so there are 65,536 of them at
most, and visitors stream past them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import columns_of, shuffle_partitions, stage, text_rows
from pitwall.llm.components import components

WORDS = 3
SEED = 42
RADIUS = 3
#: Segments of the ring and their bits.
SEGMENTS, BITS = 4, 16
#: Budgets of chains of two and three segments; that of one is 0, that of all is RADIUS.
TWO, THREE = RADIUS * 2 // SEGMENTS, RADIUS * 3 // SEGMENTS
#: Rows that a task compares with each other in one go, and shingles that it counts in one go.
BUCKET = 4096
SHINGLES = 1 << 16
_LOW16, _LOW32 = np.uint64(0xFFFF), np.uint64(0xFFFFFFFF)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, lowest first."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text, as a signed number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    data, n = b" ".join(words), max(1, len(words) - WORDS + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(WORDS, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES):
        spans = zip(starts[at : at + SHINGLES], ends[at : at + SHINGLES], strict=True)
        hashes = np.fromiter((digest(data[a:b], SEED) for a, b in spans), np.uint64, min(SHINGLES, n - at))
        counts += _bit_counts(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        found: list[int] = []
        for doc_id, text in text_rows(batches, "doc_id", "text"):
            ids.append(doc_id)
            found.append(fingerprint(text))
            if len(ids) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "fp"])
                ids, found = [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _flips(bits: int, most: int) -> np.ndarray:
    """All masks of `bits` bits with `most` or fewer set."""
    masks = np.arange(1 << bits, dtype=np.uint64)
    return masks[np.bitwise_count(masks) <= most]


def _turned(fp: np.ndarray, start: int) -> np.ndarray:
    """The ring turned until segment `start` stands in the highest bits."""
    by = np.uint64(BITS * start)
    return fp if not start else (fp << by) | (fp >> np.uint64(64 - BITS * start))


def _batch(start: np.ndarray, key: np.ndarray, home: np.ndarray, ring: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(start.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(home, pa.bool_()), pa.array(ring.view(np.int64))],
        names=["start", "key", "home", "ring"],
    )


_ROWS = "start int, key long, home boolean, ring long"


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint to its bucket of two segments, and to those whose second segment has one bit more."""
    for batch in batches:
        for start in range(SEGMENTS):
            ring = _turned(batch.column("fp").to_numpy().view(np.uint64), start)
            key, number = ring >> np.uint64(32), np.full(len(ring), start)
            yield _batch(number, key, np.ones(len(ring), bool), ring)
            for bit in range(BITS):
                mask = np.uint64(1 << bit)
                lacks = (key & mask) == 0
                yield _batch(number[lacks], key[lacks] | mask, np.zeros(int(lacks.sum()), bool), ring[lacks])


def _deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large buckets to buckets of three segments: at home, and wherever the third budget lets them visit.

    Two homes of the old bucket meet twice, once in the bucket of each; that costs work
    and changes no link.
    """
    masks = {used: _flips(BITS, THREE - used) for used in range(TWO + 1)}
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            start, key, ring = (part.column(n).to_numpy() for n in ("start", "key", "ring"))
            key, ring = key.view(np.uint64), ring.view(np.uint64)
            used = np.bitwise_count((ring >> np.uint64(32)) ^ key).astype(np.int64)
            third = (ring >> np.uint64(16)) & _LOW16
            for n, own in masks.items():
                rows = np.flatnonzero(used == n)
                if len(rows):
                    keys = ((key[rows] << np.uint64(16)) | third[rows])[:, None] ^ own[None, :]
                    home = np.broadcast_to((own == 0) & (n == 0), keys.shape)
                    yield _batch(np.repeat(start[rows], len(own)), keys.ravel(), home.ravel(), np.repeat(ring[rows], len(own)))


def _unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give the groups of i and j, pair by pair, the smaller of their labels."""
    while True:
        a, b = labels[i], labels[j]
        low = np.minimum(a, b)
        if (a == b).all():
            return
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


class _Bucket:
    """The homes of one bucket, in groups of what is linked among them."""

    def __init__(self, homes: np.ndarray):
        self.homes = homes
        self.labels = np.arange(len(homes))
        for i, j in self._near(homes):
            _unite(self.labels, i, j)

    def _near(self, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in others, in homes) of what is within the radius, in pieces."""
        step = max(1, (1 << 20) // max(1, len(self.homes)))
        for at in range(0, len(others), step):
            gap = others[at : at + step, None] ^ self.homes[None, :]
            i, j = np.nonzero(np.bitwise_count(gap >> np.uint64(BITS)) <= THREE)
            whole = np.bitwise_count(gap[i, j]) <= RADIUS
            yield i[whole] + at, j[whole]

    def ties(self) -> tuple[np.ndarray, np.ndarray]:
        """Every home that is not the first of its group, with that first one."""
        moved = self.labels != np.arange(len(self.homes))
        return self.homes[moved], self.homes[self.labels[moved]]

    def visit(self, others: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each visitor with the first home of each group that it links to."""
        for i, j in self._near(others):
            pairs = np.unique(i * len(self.homes) + self.labels[j])
            if len(pairs):
                yield others[pairs // len(self.homes)], self.homes[pairs % len(self.homes)]


def _back(ring: np.ndarray, start: int) -> np.ndarray:
    return _turned(ring, (SEGMENTS - start) % SEGMENTS)


_OUT = "a long, b long, start int, key long, home boolean, ring long"


def _out(ends: tuple[np.ndarray, np.ndarray], start: int) -> pa.RecordBatch:
    a, b = (_back(x, start).view(np.int64) for x in ends)
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), none, pa.nulls(len(a), pa.bool_()), none],
        names=["a", "b", "start", "key", "home", "ring"],
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, np.ndarray, np.ndarray]]:
    """Runs of equal (start, key) in sorted rows, piece by piece: start, key, whether it begins here, homes, rings.

    A run of one row says nothing and is left out, unless it may go on in another batch.
    """
    last = None
    for batch in batches:
        start, key, ring = (batch.column(n).to_numpy() for n in ("start", "key", "ring"))
        home, ring = batch.column("home").to_numpy(zero_copy_only=False), ring.view(np.uint64)
        cuts = np.flatnonzero((start[1:] != start[:-1]) | (key[1:] != key[:-1])) + 1
        begin, end = np.append(0, cuts), np.append(cuts, len(key))
        wanted = end - begin > 1
        wanted[0] = wanted[-1] = len(key) > 0
        for a, b in zip(begin[wanted].tolist(), end[wanted].tolist(), strict=True):
            own = (int(start[a]), int(key[a]))
            yield *own, own != last, home[a:b], ring[a:b]
            last = own


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties of the buckets, whose rows stand together; rows of those over BUCKET are sent on."""
    start, key, size = 0, 0, 0
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def small() -> Iterator[pa.RecordBatch]:
        home, ring = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, bool), None)
        if len(home) > 1 and home.any():
            bucket = _Bucket(ring[home])
            yield _out(bucket.ties(), start)
            for ends in bucket.visit(ring[~home]):
                yield _out(ends, start)

    def large(home: np.ndarray, ring: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(ring), pa.int64())
        return pa.RecordBatch.from_arrays(
            [none, none, *_batch(np.full(len(ring), start), np.full(len(ring), key, np.int64), home, ring).columns],
            names=["a", "b", "start", "key", "home", "ring"],
        )

    for own_start, own_key, begins, home, ring in _runs(batches):
        if begins:
            yield from small()
            start, key, size, held = own_start, own_key, 0, []
        size += len(ring)
        held.append((home, ring))
        if size > BUCKET:
            for piece in held:
                yield large(*piece)
            held = []
    yield from small()


def _compare_large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties of buckets of three segments. Homes, 65,536 at most, come first; visitors stream past them."""
    start, bucket, homes = 0, None, []

    def settled() -> Iterator[pa.RecordBatch]:
        nonlocal bucket, homes
        if homes:
            bucket, homes = _Bucket(np.concatenate(homes)), []
            yield _out(bucket.ties(), start)

    for own_start, _, begins, home, ring in _runs(batches):
        if begins:
            yield from settled()
            start, bucket, homes = own_start, None, []
        if home.any():
            homes.append(ring[home])
        if not home.all():
            yield from settled()
            if bucket is not None:
                for ends in bucket.visit(ring[~home]):
                    yield _out(ends, start)
    yield from settled()


def links(found: DataFrame) -> DataFrame:
    """(a, b) of fingerprints of `found` (fp: long, distinct) that connect all those within the radius of each other, and no others."""
    parts = shuffle_partitions(found.sparkSession)

    def in_buckets(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "start", "key").sortWithinPartitions("start", "key", F.col("home").desc())

    first = in_buckets(found.select("fp").mapInArrow(_deal, _ROWS)).mapInArrow(_compare, _OUT)
    first = stage(first, "simhash_links")
    again = first.where("ring IS NOT NULL").select("start", "key", "ring").mapInArrow(_deal_again, _ROWS)
    second = stage(in_buckets(again).mapInArrow(_compare_large, _OUT), "simhash_links")
    return first.where("a IS NOT NULL").select("a", "b").unionByName(second.select("a", "b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable by links, the row's own included. Texts
    of equal fingerprints are linked. A null, empty or blank text has the fingerprint zero
    and is linked like any other; a text of one or two words has one shingle. A row without
    doc_id has a fingerprint, a null component and links nothing. Repeated rows are
    repeated, an empty table gives no rows, other columns are ignored.
    """
    rows = stage(fingerprints(docs), "simhash_rows")
    heads = rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("head"))
    heads = stage(heads, "simhash_heads")
    groups = stage(components(links(heads.select("fp"))), "simhash_groups")
    labelled = heads.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    least = labelled.where("component IS NOT NULL").groupBy("component").agg(F.min("head").alias("least"))
    classes = labelled.join(least, "component", "left").select("fp", F.coalesce("least", "head").alias("least"))
    return rows.join(stage(classes, "simhash_classes"), "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"),
    )
