"""Word n-gram Jaccard self-join by signature trees.

Two texts link when their sets of 5-word shingles have a Jaccard similarity of 0.8 or
more. The work goes in three steps, each a Spark job over packed numpy columns:

1. `candidate_edges`: every shingle's number of sets (its frequency) is counted over the
   whole table, in hash buckets. A set that shares under 80 % of its shingles with any
   other has no partner and goes no further. The others are tied through the first
   shingles of their frequency order: two sets of similarity 0.8 share at least one of
   the first `n - ceil(0.8 n) + 1`. Shingles held by more than one set in 256 are found
   beforehand (there are at most 256 times the mean set size of them); they come last in
   the order and are tied inside the task, so no task sees all holders of one.
2. The ties form clusters. A cluster is cut into blocks of similar sizes and bounded
   shingle count.
3. In a block, a signature tree: leaves hold sets, every node holds the OR of the token
   bitmaps below it and the range of their sizes. A dual traversal compares a pair of
   nodes by the largest overlap the bitmaps and sizes allow, drops it if that is too
   little or if all sets below both are linked already, else goes down, and counts exact
   overlaps at the leaves. Then one set of each linked group of each block meets those
   of the other blocks, and last every pair of blocks that still holds two groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import columns_of, giving_back, narrowed, shuffle_partitions, stage, text_rows, without
from pitwall.llm.components import components

WORDS = 5
#: A shingle in more than one of so many sets is common.
COMMON = 256
#: Shingles kept in memory by a task before it sends them on, and shingles of a block.
FLUSH = 1 << 21
BLOCK = 1 << 18
LEAF = 16


def needed_overlap(a: int, b: int) -> int:
    """Least overlap for 100 * overlap >= 80 * union, of sets of a and b shingles."""
    return -(-4 * (a + b) // 9)


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


class _Hashes(dict):
    """64-bit hashes of words. Short ones are remembered, 65,536 of them, which is 12 MB, until the task ends."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= 1 << 16:
                self.clear()
            self[word] = value
        return value


_HASHES = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        width = min(WORDS, len(codes))
        hashes = _mix(codes[: len(codes) - width + 1] + np.uint64(width))
        for k in range(1, width):
            hashes = _mix(hashes * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(codes) - width + 1 + k])
    return np.unique(hashes)


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(hashes.tobytes())
    low, high = value & (2**64 - 1), value >> 64
    return low - 2**64 if low >= 2**63 else low, high - 2**64 if high >= 2**63 else high


@giving_back(_HASHES)
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, and rows (common = hash, n = count) of shingles frequent in this task."""
    rows: list[tuple] = []
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal rows, held, size
        if held:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(8, len(held) // (2 * COMMON))
            for token, count in zip(tokens[often].view(np.int64).tolist(), counts[often].tolist(), strict=True):
                rows.append((None, count, None, None, token))
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "n", "key", "high", "common"]
        )
        rows, held, size = [], [], 0
        return out

    seen: set[tuple[int, int]] = set()
    for doc_id, text in text_rows(batches, "doc_id", "text"):
        hashes = shingle_set(text)
        key = _digest(hashes) if len(hashes) else (None, None)
        rows.append((doc_id, len(hashes), *key, None))
        if len(hashes) and key not in seen:
            seen.add(key)
            held.append(hashes)
            size += len(hashes)
        if size >= FLUSH or len(rows) >= 50_000:
            yield flush()
    if rows:
        yield flush()


def _packed(columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"slot": pa.int32(), "tokens": pa.binary(), "more": pa.binary(), "keys": pa.binary(), "counts": pa.binary(), "short": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in columns.items()], names=list(columns))


_PACKED = "slot int, tokens binary, more binary, keys binary, counts binary, short binary"


def _pack(slots: np.ndarray, tokens: np.ndarray, more: np.ndarray, keys: np.ndarray, short: np.ndarray) -> pa.RecordBatch:
    """One row for each slot. Rows of a slot come in runs of a key, which is stored once."""
    order = np.argsort(slots, kind="stable")
    slots, tokens, more, keys, short = slots[order], tokens[order], more[order], keys[order], short[order]
    out: dict[str, list] = {"slot": [], "tokens": [], "more": [], "keys": [], "counts": [], "short": []}
    cuts = np.flatnonzero(np.diff(slots)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(slots)], strict=True):
        runs = start + np.concatenate(([0], np.flatnonzero(np.diff(keys[start:end])) + 1))
        out["slot"].append(int(slots[start]))
        out["tokens"].append(tokens[start:end].tobytes())
        out["more"].append(more[start:end].tobytes())
        out["keys"].append(keys[runs].tobytes())
        out["counts"].append(np.diff(np.append(runs, end)).astype(np.uint32).tobytes())
        out["short"].append(short[runs].tobytes())
    return _packed(out)


def _unpack(batches: Iterator[pa.RecordBatch], token: type, more: type) -> tuple[np.ndarray, ...] | None:
    """The columns of all rows, laid out one after the other: beside the packed rows no column stands in memory twice."""
    rows = [row for batch in batches for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True)]
    if not rows:
        return None
    slots, tokens, mores, keys, counts, short = zip(*rows, strict=True)
    del rows
    each = np.frombuffer(b"".join(counts), np.uint32)
    sizes = [len(x) // np.dtype(token).itemsize for x in tokens]
    return (
        np.repeat(np.array(slots, np.int32), sizes),
        np.frombuffer(b"".join(tokens), token),
        np.frombuffer(b"".join(mores), more),
        np.repeat(np.frombuffer(b"".join(keys), np.uint64), each),
        np.repeat(np.frombuffer(b"".join(short), np.int32), each),
    )


#: Frequency of a common shingle: after all others.
_LAST = np.uint32(2**32 - 1)


def _shared(batches: Iterator[pa.RecordBatch], slots: int) -> tuple[np.ndarray, ...] | None:
    """(token, frequency, key, short) of the shingles of a slot that more than one set holds, and of marked ones.

    Columns are let go as soon as the next is made: 61 bytes for each shingle at most were measured."""
    got = _unpack(batches, np.uint32, np.uint8)
    if got is None:
        return None
    slot, low, high, keys, short = got
    marked = slot >= slots
    # A common shingle keeps no slot of its own: its 40 bits name it.
    tokens = np.where(marked, np.int32(0), slot).astype(np.uint64)
    for bits, column in ((8, high), (32, low)):
        tokens <<= np.uint64(bits)
        tokens |= column
    tokens[marked] |= np.uint64(1 << 63)
    del got, slot, low, high, marked, column
    order = np.lexsort((keys, tokens))
    tokens, keys = tokens[order], keys[order]
    short = short[order]
    del order
    first = np.ones(len(tokens), bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])  # copies of a set count once
    tokens, keys = tokens[first], keys[first]
    short = short[first]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    runs = np.diff(np.append(starts, len(tokens)))
    del first, starts
    times = np.repeat(runs.astype(np.uint32), runs)
    times[tokens >= np.uint64(1 << 63)] = _LAST
    keep = times >= 2
    tokens, times, keys, short = tokens[keep], times[keep], keys[keep], short[keep]
    order = np.argsort(keys, kind="stable")  # in runs of a key, as they are packed
    return tokens[order], times[order], keys[order], short[order]


def candidate_edges(docs: DataFrame, described: DataFrame) -> DataFrame:
    """(a, b): ties between set keys, or between a key and the number of a common shingle.

    Two different sets of similarity 0.8 or more are always tied through some chain.
    """
    spark = docs.sparkSession
    total, sets = described.where("n > 0 AND key IS NOT NULL").agg(F.sum("n"), F.count(F.lit(1))).first()
    slots = max(shuffle_partitions(spark), math.ceil((total or 0) / FLUSH))
    common = (
        described.where("common IS NOT NULL").groupBy("common").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= max(8, (sets or 0) / (2 * COMMON)))
    )
    # Proven bound: no more than 2 * COMMON times the mean set size, as each is in that share of all sets.
    frequent = np.sort(np.array([r[0] for r in common.select("common").collect()], np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast(frequent)

    @giving_back(_HASHES)
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles to the slot of their hash. A common one stays with its set, marked."""
        common, seen = shared.value, set()
        tokens: list[np.ndarray] = []
        keys: list[int] = []
        short: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal tokens, keys, short, size
            lengths = [len(x) for x in tokens]
            all_tokens, all_keys = np.concatenate(tokens), np.repeat(np.array(keys, np.int64).view(np.uint64), lengths)
            all_short = np.repeat(np.array(short, np.int32), lengths)
            tokens, keys, short, size = [], [], [], 0
            if len(common):
                at = np.minimum(np.searchsorted(common, all_tokens), len(common) - 1)
                marked = common[at] == all_tokens
            else:
                marked = np.zeros(len(all_tokens), bool)
            slot = (all_tokens >> np.uint64(32)) % np.uint64(slots)
            slot = np.where(marked, slots + (all_keys % np.uint64(slots)), slot).astype(np.int32)
            # 40 bits beside the slot tell shingles apart; a clash only makes one seem more frequent.
            low = (all_tokens & np.uint64(2**32 - 1)).astype(np.uint32)
            high = (all_tokens >> np.uint64(56)).astype(np.uint8)
            del all_tokens, marked
            return _pack(slot, low, high, all_keys, all_short)

        for (text,) in text_rows(batches, "text"):
            hashes = shingle_set(text)
            if not len(hashes):
                continue
            key = _digest(hashes)[0]
            if key in seen:
                continue
            seen.add(key)
            tokens.append(hashes)
            keys.append(key)
            # Length of the prefix, less the set's number of tokens: what remains to be added is the shared ones.
            short.append(prefix_length(len(hashes)) - len(hashes))
            size += len(hashes)
            if size >= FLUSH:
                yield flush()
        if size:
            yield flush()

    @giving_back()
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shared shingles with their frequency, to the slot of their set."""
        got = _shared(batches, slots)
        if got is not None and len(got[0]):
            tokens, times, keys, short = got
            del got
            yield _pack((keys % np.uint64(slots)).astype(np.int32), tokens, times, keys, short)

    @giving_back()
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shared shingles of each prefix: common ones tied here, others to their slot."""
        got = _unpack(batches, np.uint64, np.uint32)
        if got is None:
            return
        _, tokens, times, keys, short = got
        del got
        order = np.lexsort((tokens, times, keys))
        tokens, times, keys, short = tokens[order], times[order], keys[order], short[order]
        first = np.ones(len(tokens), bool)
        first[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
        tokens, times, keys, short = tokens[first], times[first], keys[first], short[first]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        runs = np.diff(np.append(starts, len(keys)))
        place = np.arange(len(keys)) - np.repeat(starts, runs)
        keep = place < np.repeat(runs + short[starts], runs)
        tokens, times, keys = tokens[keep], times[keep], keys[keep]
        here = times == _LAST
        if here.any():
            ends = _forest(tokens[here], keys[here])
            # The root of each common shingle is tied to the shingle, which all tasks name alike.
            yield _edges(*ends)
            tops = pd.DataFrame({"t": tokens[here], "k": keys[here]}).groupby("t", sort=False)["k"].min()
            yield _edges(tops.index.to_numpy(np.uint64), tops.to_numpy(np.uint64))
        if not here.all():
            tokens, keys = tokens[~here], keys[~here]
            yield _edges(keys, tokens, (_mix(tokens) % np.uint64(slots)).astype(np.int32))

    @giving_back()
    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of the keys that share a shingle of their prefixes."""
        ready, tokens, keys = [], [], []
        for batch in batches:
            for slot, a, b in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if slot < 0:
                    ready.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
                else:
                    keys.append(np.frombuffer(a, np.uint64))
                    tokens.append(np.frombuffer(b, np.uint64))
        if tokens:
            ready.append(_forest(np.concatenate(tokens), np.concatenate(keys)))
        for a, b in ready:
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    texts = columns_of(docs, "text")
    return (
        texts.mapInArrow(send, _PACKED)
        .repartitionById(slots, F.col("slot") % slots)
        .mapInArrow(count, _PACKED)
        .repartitionById(slots, "slot")
        .mapInArrow(choose, "slot int, a binary, b binary")
        .repartitionById(slots, F.when(F.col("slot") < 0, F.pmod(F.xxhash64("a"), F.lit(slots)).cast("int")).otherwise(F.col("slot")))
        .mapInArrow(tie, "a long, b long")
    )


def _edges(a: np.ndarray, b: np.ndarray, slots: np.ndarray | None = None) -> pa.RecordBatch:
    """Packed pairs; slot -1 for those that are edges already."""
    if slots is None:
        slots = np.full(len(a), -1, np.int32)
    order = np.argsort(slots, kind="stable")
    a, b, slots = np.ascontiguousarray(a[order]), np.ascontiguousarray(b[order]), slots[order]
    cuts = (np.flatnonzero(np.diff(slots)) + 1).tolist()
    spans = list(zip([0, *cuts], [*cuts, len(slots)], strict=True)) if len(slots) else []
    return pa.RecordBatch.from_arrays(
        [pa.array([int(slots[s]) for s, _ in spans], pa.int32()),
         pa.array([a[s:e].tobytes() for s, e in spans], pa.binary()),
         pa.array([b[s:e].tobytes() for s, e in spans], pa.binary())],
        names=["slot", "a", "b"],
    )


def _forest(tokens: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, smallest key of its group), where keys that share a token are in one group."""
    names, key = np.unique(keys, return_inverse=True)
    token = np.unique(tokens, return_inverse=True)[1]
    label = np.arange(len(names))
    while True:
        low = np.full(token.max() + 1, len(names))
        np.minimum.at(low, token, label[key])
        new = label.copy()
        np.minimum.at(new, key, low[token])
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(names))
    return names[moved], names[label[moved]]


class _Linked:
    """Groups of linked sets; a label for each set."""

    def __init__(self, labels: np.ndarray):
        self.labels = labels
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        a, b = self.labels[i], self.labels[j]
        if a != b:
            self.labels[self.labels == max(a, b)] = min(a, b)
            self.links.append((i, j))


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One bit for each shingle that two or more of the sets hold, so overlaps are exact."""
    sizes = [len(x) for x in sets]
    names, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    bit = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = times[code] > 1
    width = max(1, -(-int((times > 1).sum()) // 64))
    out = np.zeros((len(sets), width), np.uint64)
    where = bit[code[shared]]
    np.bitwise_or.at(out, (owner[shared], where >> 6), np.uint64(1) << (where & 63).astype(np.uint64))
    return out


class SignatureTree:
    """Sets in order of size and signature; a node is a range of them."""

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray, members: np.ndarray):
        first = np.argmax(bitmaps != 0, axis=1) if len(bitmaps) else np.empty(0, int)
        self.members = members[np.lexsort((members, first[members], sizes[members]))]
        self.bits, self.sizes = bitmaps[self.members], sizes[self.members]
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, int, int]] = {}
        if len(members):
            self._node(0, len(members))

    def _node(self, start: int, end: int) -> np.ndarray:
        if end - start <= LEAF:
            signature = np.bitwise_or.reduce(self.bits[start:end], axis=0)
        else:
            middle = (start + end) // 2
            signature = self._node(start, middle) | self._node(middle, end)
        sizes = self.sizes[start:end]
        self.nodes[start, end] = (signature, int(sizes.min()), int(sizes.max()))
        return signature


def _traverse(left: SignatureTree, right: SignatureTree, linked: _Linked) -> None:
    """Dual traversal from the two roots; equal trees compare every pair once."""
    same = left is right
    stack = [((0, len(left.members)), (0, len(right.members)))] if len(left.members) and len(right.members) else []
    while stack:
        u, v = stack.pop()
        a, a_min, a_max = left.nodes[u]
        b, b_min, b_max = right.nodes[v]
        labels_a, labels_b = linked.labels[left.members[slice(*u)]], linked.labels[right.members[slice(*v)]]
        if labels_a[0] == labels_b[0] and (labels_a == labels_a[0]).all() and (labels_b == labels_a[0]).all():
            continue
        most = min(int(np.bitwise_count(a & b).sum()), a_max, b_max)
        if most < needed_overlap(a_min, b_min) or 5 * a_max < 4 * b_min or 5 * b_max < 4 * a_min:
            continue
        long_u, long_v = u[1] - u[0] > LEAF, v[1] - v[0] > LEAF
        if not long_u and not long_v:
            _leaves(left, u, right, v, linked)
            continue
        parts_u = [(u[0], sum(u) // 2), (sum(u) // 2, u[1])] if long_u else [u]
        parts_v = [(v[0], sum(v) // 2), (sum(v) // 2, v[1])] if long_v else [v]
        # The nodes on the diagonal come off the stack first, as likely links there save later work.
        stack += sorted(((x, y) for x in parts_u for y in parts_v if not same or x <= y), key=lambda p: p[0] == p[1])


def _leaves(left: SignatureTree, u: tuple, right: SignatureTree, v: tuple, linked: _Linked) -> None:
    for i in range(*u):
        overlap = np.bitwise_count(left.bits[i] & right.bits[v[0] : v[1]]).sum(axis=1, dtype=np.int64)
        union = left.sizes[i] + right.sizes[v[0] : v[1]] - overlap
        for j in np.flatnonzero(100 * overlap >= 80 * union):
            linked.join(left.members[i], right.members[v[0] + j])


def _block_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) between sets of one block, or of two blocks (side 0 and 1), enough to connect what is linked."""
    sets = [np.frombuffer(x, np.uint64) for x in group["hashes"]]
    ids, sizes = group["doc_id"].to_numpy(), np.array([len(x) for x in sets])
    labels = np.unique(group["label"].to_numpy(), return_inverse=True)[1]
    linked, bitmaps = _Linked(labels), _bitmaps(sets)
    side = group["side"].to_numpy()
    trees = [SignatureTree(bitmaps, sizes, np.flatnonzero(side == s)) for s in (0, 1)]
    _traverse(trees[0], trees[1] if len(trees[1].members) else trees[0], linked)
    a, b = ([ids[i] for i, _ in linked.links], [ids[j] for _, j in linked.links])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


@giving_back(_HASHES)
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle set of each text that still has the key it was chosen by."""
    columns: tuple[list, ...] = ([], [], [], [])
    size = 0
    for doc_id, text, key, cluster in text_rows(batches, "doc_id", "text", "key", "cluster"):
        hashes = shingle_set(text)
        if len(hashes) and _digest(hashes)[0] == key:
            for column, value in zip(columns, (doc_id, cluster, len(hashes), hashes.tobytes()), strict=True):
                column.append(value)
            size += len(hashes)
        if size >= FLUSH:
            yield _sets_batch(columns)
            columns, size = ([], [], [], []), 0
    if columns[0]:
        yield _sets_batch(columns)


def _sets_batch(columns: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "cluster", "n", "hashes"]
    )


def _in_blocks(sets: DataFrame) -> DataFrame:
    """Adds grade (sizes a quarter apart) and block, of about BLOCK shingles each."""
    graded = sets.withColumn("grade", F.floor(F.log(F.col("n").cast("double")) / math.log(1.25)).cast("int"))
    mass = graded.groupBy("cluster", "grade").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    return graded.join(mass, ["cluster", "grade"]).withColumn(
        "block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    )


def tree_links(sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect all sets (doc_id, cluster, n, hashes) of similarity 0.8 or more within a cluster."""
    blocks = stage(_in_blocks(sets).drop("blocks"), "ngram_blocks")
    alone = blocks.withColumn("label", F.col("doc_id")).withColumn("side", F.lit(0))
    first = stage(alone.groupBy("cluster", "grade", "block").applyInPandas(_block_links, "a long, b long"), "ngram_links")

    def labelled(links: DataFrame) -> DataFrame:
        groups = components(links)
        return blocks.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
            "label", F.coalesce("component", "doc_id")
        ).drop("component")

    # One set of each group and size grade meets those of the other blocks.
    heads = labelled(first).groupBy("cluster", "grade", "block", "label").agg(F.min("doc_id").alias("doc_id"))
    heads = _in_blocks(heads.select("doc_id", "label").join(blocks.select("doc_id", "cluster", "n", "hashes"), "doc_id"))
    # Neighbouring grades meet: each head also stands in the block row of the grade below.
    near = heads.withColumn("row", F.explode(F.array(F.col("grade"), F.col("grade") - 1))).withColumn("side", F.lit(0))
    near = near.groupBy("cluster", "row", F.when(F.col("blocks") > 1, F.col("block")).otherwise(0).alias("part"))
    second = stage(near.applyInPandas(_block_links, "a long, b long"), "ngram_links")

    # Every pair of blocks that still holds two groups.
    links = first.unionByName(second)
    state = stage(labelled(links), "ngram_state")
    held = state.groupBy("cluster", "grade", "block").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    open_clusters = held.groupBy("cluster").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l < h").select("cluster")
    held = held.join(open_clusters, "cluster")
    other = held.select("cluster", *[F.col(c).alias(f"{c}_2") for c in ("grade", "block", "low", "high", "least", "most")])
    pairs = held.join(other, "cluster").where(
        ((F.col("grade_2") == F.col("grade")) & (F.col("block_2") > F.col("block")) | (F.col("grade_2") == F.col("grade") + 1))
        & ((F.col("low") != F.col("low_2")) | (F.col("high") != F.col("high_2")) | (F.col("low") != F.col("high")))
        & (5 * F.col("most") >= 4 * F.col("least_2"))
    )
    ends = pairs.select(
        F.col("cluster"),
        F.xxhash64("cluster", "grade", "block", "grade_2", "block_2").alias("pair"),
        F.explode(F.array(
            F.struct(F.col("grade"), F.col("block"), F.lit(0).alias("side")),
            F.struct(F.col("grade_2").alias("grade"), F.col("block_2").alias("block"), F.lit(1).alias("side")),
        )).alias("e"),
    ).select("cluster", "pair", "e.*")
    third = ends.join(state, ["cluster", "grade", "block"]).groupBy("pair").applyInPandas(_block_links, "a long, b long")
    return links.unionByName(stage(third, "ngram_links"))


def ngram_join(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable by links, the row's own included.
    A null, empty or blank text has an empty set and no link. A text of under five words
    has one shingle. Rows of equal sets are linked. A row without doc_id gets a null
    component and links nothing. An empty table gives no rows; other columns are ignored.
    """
    docs = columns_of(docs, "doc_id", "text")
    described = stage(
        docs.mapInArrow(_describe, "doc_id long, n long, key long, high long, common long"), "ngram_described"
    )
    rows = described.where("common IS NULL")
    heads = rows.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key", "high").agg(F.min("doc_id").alias("head"))
    heads = stage(heads, "ngram_heads")
    clusters = components(candidate_edges(docs, described))
    chosen = heads.join(clusters.withColumnRenamed("node", "key").withColumnRenamed("component", "cluster"), "key")
    chosen = stage(chosen.select(F.col("head").alias("doc_id"), "key", "cluster"), "ngram_chosen")
    sets = narrowed(docs, chosen, "doc_id").join(chosen, "doc_id").mapInArrow(_sets, "doc_id long, cluster long, n long, hashes binary")
    links = components(tree_links(sets))
    heads = heads.join(links.withColumnRenamed("node", "head"), "head", "left").select(
        "key", "high", F.coalesce("component", "head").alias("least")
    )
    return rows.join(stage(heads, "ngram_classes"), ["key", "high"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, less those that are linked to a smaller doc_id.

    Texts without words are linked with nothing and stay, as do rows without doc_id. Of
    rows that repeat a doc_id whose text has words, one stays.
    """
    found = stage(ngram_join(docs), "ngram_found")
    later = found.where("component_id < doc_id").select("doc_id")
    twice = found.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    gone = stage(later.unionByName(twice).distinct(), "ngram_gone")
    kept = without(docs, gone, "doc_id")
    heads = twice.join(later, "doc_id", "left_anti")
    again = narrowed(docs, heads, "doc_id").join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(again.select(*docs.columns))
