"""Clusters of vectors on an integer grid, by Lloyd rounds with shallot search.

Every vector carries, from round to round, its centroid, the second-nearest one, an upper
bound of the distance to the first and a lower bound of the distance to all others. When
centroids move, the bounds move with them, and a vector whose bounds stay apart is not
looked at. Any other vector measures its own centroid and the remembered second one and
starts from the closer of the two: it scans that centroid's neighbours, nearest first, as
long as they stand in a ball that the second-best distance found so far allows. The ball
shrinks with every better find. Bounds are floating-point numbers with a margin and only
rule centroids out; the distances of what is left are compared as integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwall.llm.common import columns_of, staging_path
from pitwall.session import remove_folder

CLUSTERS = 40
ROUNDS = 5
WIDTH = 64
#: Steps of the grid in one unit, and the largest coordinate: squares of 64 differences fit 63 bits.
GRID = 256
REACH = 1 << 27
#: Bounds that are this close, as a share of the distances at hand, count as equal.
MARGIN = 1e-9

_STATE = "vec_id long, x array<int>, cluster int, second int, upper double, lower double, total array<long>, n long"


class Search:
    """The centroids of one round, their distances from each other and how far each has moved."""

    def __init__(self, centres: np.ndarray, before: np.ndarray | None = None):
        self.centres = centres
        k = len(centres)
        gaps = ((centres[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
        self.between = np.sqrt(gaps.astype(np.float64))
        ranked = self.between.copy()
        np.fill_diagonal(ranked, -1.0)
        self.order = ranked.argsort(axis=1, kind="stable")
        self.half = self.between[np.arange(k), self.order[:, 1]] / 2 if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(((centres - before) ** 2).sum(axis=1).astype(np.float64))
        # The farthest that any other centroid has moved.
        far = np.argsort(self.moved)
        self.others = np.full(k, self.moved[far[-1]])
        if k > 1:
            self.others[far[-1]] = self.moved[far[-2]]
        self.slack = MARGIN * (1 + self.between.max() + self.moved.max())

    def distance(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        gap = x - self.centres[cluster]
        return np.einsum("ij,ij->i", gap, gap)

    def assign(
        self, x: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The arguments after `x`, brought up to date."""
        if len(self.centres) == 1:
            return cluster, second, upper, lower
        cluster, second = cluster.copy(), second.copy()
        upper, lower = upper + self.moved[cluster], lower - self.others[cluster]

        def open_rows(rows: np.ndarray) -> np.ndarray:
            limit = np.maximum(lower[rows], self.half[cluster[rows]])
            return rows[~(upper[rows] * (1 + MARGIN) + self.slack < limit)]

        rows = open_rows(np.arange(len(x)))
        upper[rows] = np.sqrt(self.distance(x[rows], cluster[rows]).astype(np.float64))
        rows = open_rows(rows)
        if len(rows):
            found = self._scan(x[rows], cluster[rows], second[rows])
            cluster[rows], second[rows] = found[0], found[1]
            upper[rows], lower[rows] = np.sqrt(found[2].astype(np.float64)), np.sqrt(found[3].astype(np.float64))
        return cluster, second, upper, lower

    def _scan(self, x: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest and second-nearest centroid with their squared distances; of equal ones the smaller number."""
        near, next_ = self.distance(x, first), self.distance(x, second)
        swap = (next_ < near) | (next_ == near) & (second < first)
        best, other = np.where(swap, second, first), np.where(swap, first, second)
        near, next_ = np.where(swap, next_, near), np.where(swap, near, next_)
        start, known = best.copy(), other.copy()
        radius = np.sqrt(near.astype(np.float64))
        rows = np.arange(len(x))
        for place in range(1, len(self.centres)):
            centre = self.order[start[rows], place]
            ball = (radius[rows] + np.sqrt(next_[rows].astype(np.float64))) * (1 + MARGIN) + self.slack
            inside = self.between[start[rows], centre] <= ball
            rows, centre = rows[inside], centre[inside]  # those behind are farther still
            if not len(rows):
                break
            fresh = centre != known[rows]
            at, c = rows[fresh], centre[fresh]
            d = self.distance(x[at], c)
            wins = (d < near[at]) | (d == near[at]) & (c < best[at])
            places = ~wins & ((d < next_[at]) | (d == next_[at]) & (c < other[at]))
            w, p = at[wins], at[places]
            other[w], next_[w] = best[w], near[w]
            best[w], near[w] = c[wins], d[wins]
            other[p], next_[p] = c[places], d[places]
        return best, other, near, next_


def on_grid(vectors: DataFrame) -> DataFrame:
    """(vec_id, x array<int>) of the vectors that take part."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    place = F.transform("embedding", lambda v: F.floor(v.cast("double") * GRID))
    too_far = F.exists("x", lambda v: F.abs(v) > REACH)
    stop = F.raise_error(F.lit(f"a component lies beyond {REACH} steps of the grid"))
    kept = columns_of(vectors, "vec_id", "embedding").where((F.size("embedding") == WIDTH) & finite)
    return kept.select("vec_id", place.alias("x")).select(
        "vec_id", F.when(too_far, stop).otherwise(F.col("x").cast("array<int>")).alias("x")
    )


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, WIDTH)


def _round(state: DataFrame, search: Search) -> DataFrame:
    """The next state, with one row of sums for each cluster and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(search.centres)
        totals, counts = np.zeros((k, WIDTH), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch)
            held = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("cluster", "second", "upper", "lower")]
            found = search.assign(x, *held)
            for c in np.unique(found[0]):
                mine = x[found[0] == c]
                totals[c] += mine.sum(axis=0)
                counts[c] += len(mine)
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64())
            columns = [pa.array(v, t) for v, t in zip(found, kinds, strict=True)]
            none = [pa.nulls(len(x), pa.list_(pa.int64())), pa.nulls(len(x), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), *columns, *none],
                names=["vec_id", "x", "cluster", "second", "upper", "lower", "total", "n"],
            )
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.list_(pa.int32())), pa.array(some, pa.int32()),
             pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.float64()), pa.nulls(len(some), pa.float64()),
             pa.array(list(totals[some]), pa.list_(pa.int64())), pa.array(counts[some], pa.int64())],
            names=["vec_id", "x", "cluster", "second", "upper", "lower", "total", "n"],
        )

    return state.mapInArrow(run, _STATE)


def _means(state: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Every centroid the floor of its vectors' mean; one without vectors stays. One row for each cluster is collected."""
    sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(WIDTH)]
    out = centres.copy()
    for row in state.where("total IS NOT NULL").groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
        out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(WIDTH)]
    return out


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector of `vectors` (vec_id, embedding) that takes part: vec_id, cluster,
    distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of 64 components take part, none of them null, NaN or infinite. A component
    beyond 2^27 steps of the grid stops the job: its squares do not fit a long. The first
    centroids are the `k` vectors (all, if there are fewer) of the smallest SHA-256 of
    "2:<vec_id>"; rows that repeat a vec_id come in order of their components, those without
    one come last. Equal distances go to the smaller number, equal centroids stay apart.
    Repeated rows count as often as they stand there. Without vectors there are no rows;
    other columns are ignored. Each round is written to the shared folder and takes the
    place of the one before.
    """
    spark = vectors.sparkSession
    path = staging_path(spark, "shallot_grid")
    on_grid(vectors).write.parquet(path)
    held = spark.read.schema("vec_id long, x array<int>").parquet(path)
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = held.select(order.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    centres = np.array([r["x"] for r in first], np.int64).reshape(-1, WIDTH)
    final = "vec_id long, cluster int, distance long"
    if not len(centres):
        remove_folder(spark, path)
        return spark.createDataFrame([], f"{final}, cluster_inertia long, inertia long, centroid_sha256 string")
    search = Search(centres)
    state = held.select(
        "vec_id", "x", F.lit(0).alias("cluster"), F.lit(int(search.order[0, 1]) if len(centres) > 1 else 0).alias("second"),
        F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"),
    )
    for _ in range(rounds):
        before, path = path, staging_path(spark, "shallot_round")
        _round(state, search).write.parquet(path)
        remove_folder(spark, before)
        written = spark.read.schema(_STATE).parquet(path)
        moved = _means(written, centres)
        search, centres = Search(moved, centres), moved
        state = written.where("total IS NULL").drop("total", "n")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            names = ("cluster", "second", "upper", "lower")
            cluster = search.assign(x, *[batch.column(n).to_numpy(zero_copy_only=False) for n in names])[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(search.distance(x, cluster), pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    before, path = path, staging_path(spark, "shallot_found")
    state.mapInArrow(last, final).write.parquet(path)
    remove_folder(spark, before)
    found = spark.read.schema(final).parquet(path)
    # One row for each cluster, k at most.
    inertia = {
        r["cluster"]: int(r["s"])
        for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    }
    rows = [
        (c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest())
        for c, x in enumerate(centres.tolist())
    ]
    described = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(described), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
