"""Approximate nearest neighbours by learned partitions.

A bounded sample gets a neighbour graph, which is cut into parts of equal size so that
neighbours tend to share a part. A small softmax classifier learns, for a vector, in which
parts its neighbours lie. Every row is indexed in its most probable part; a query is
routed to the most probable parts, as many as a second sample needs for the wanted recall,
and all rows of those parts are ranked by the exact inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwall.llm.common import columns_of, stage

K = 20
#: Rows of a part, most parts, rows of the fitted sample (a bound in itself), and of queries to set the probes by.
PART_ROWS = 4096
PARTS = 128
SAMPLE = 6000
TRIALS = 500
#: Share of the true neighbours that the routed parts must hold in the sample.
RECALL = 0.97
GRAPH = 12
#: Rows, and queries, that one task compares at a time.
BLOCK = 8192
#: Rounding of a matrix product, for vectors of length 1.
SLACK = 1e-9


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of each row, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for start in range(0, len(x), 512):
        near = x[start : start + 512] @ x.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -np.inf
        out[start : start + 512] = np.argpartition(near, -k, axis=1)[:, -k:]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A part for each row, of nearly equal sizes: halved along main axes, then rows move to where their neighbours are."""
    label = np.zeros(len(x), np.int64)

    def halve(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1 or len(rows) < 2:
            label[rows] = first
            return
        centred = x[rows] - x[rows].mean(axis=0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        cut = len(order) * (n // 2) // n
        halve(order[:cut], first, n // 2)
        halve(order[cut:], first + n // 2, n - n // 2)

    halve(np.arange(len(x)), 0, parts)
    most = int(np.ceil(1.05 * len(x) / parts))
    sizes = np.bincount(label, minlength=parts)
    for _ in range(8):
        moved = 0
        for i in range(len(x)):
            votes = np.bincount(label[graph[i]], minlength=parts)
            best, own = int(votes.argmax()), label[i]
            if votes[best] > votes[own] and sizes[best] < most:
                label[i] = best
                sizes[best] += 1
                sizes[own] -= 1
                moved += 1
        if moved < len(x) // 200:
            break
    return label


def fit_classifier(x: np.ndarray, target: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a softmax over the parts, by full-batch Adam."""
    w, b = np.zeros((x.shape[1], target.shape[1])), np.zeros(target.shape[1])
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, rounds + 1):
        slope = (probabilities(x, w, b) - target) / len(x)
        for value, grad, m, v in ((w, x.T @ slope + 1e-5 * w, 0, 1), (b, slope.sum(axis=0), 2, 3)):
            moments[m] = 0.9 * moments[m] + 0.1 * grad
            moments[v] = 0.999 * moments[v] + 0.001 * grad**2
            value -= 0.3 * (moments[m] / (1 - 0.9**step)) / (np.sqrt(moments[v] / (1 - 0.999**step)) + 1e-9)
    return w, b


def probabilities(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = x @ w + b
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


class Partitions:
    """The fitted classifier and the number of parts a query visits."""

    def __init__(self, sample: np.ndarray, trials: np.ndarray, parts: int, k: int):
        self.scale = 1 / max(np.abs(sample).max(), 1e-300) if len(sample) else 1.0
        x = sample * self.scale
        self.parts = max(1, min(parts, len(x) // (4 * GRAPH)))
        self.w, self.b, self.probes = np.zeros((x.shape[1], 1)), np.zeros(1), 1
        if self.parts == 1:
            return
        graph = neighbour_graph(x, GRAPH)
        label = balanced_parts(x, graph, self.parts)
        target = np.zeros((len(x), self.parts))
        np.add.at(target, (np.repeat(np.arange(len(x)), GRAPH), label[graph].ravel()), 1 / (GRAPH + 1))
        target[np.arange(len(x)), label] += 1 / (GRAPH + 1)
        self.w, self.b = fit_classifier(x, target)
        home = self.order(sample)[:, 0]
        near = np.argsort(-(trials @ sample.T), axis=1)[:, :k]
        rank = np.argsort(self.order(trials), axis=1)
        wanted = np.take_along_axis(rank, home[near], axis=1)
        held = [(wanted < m).mean() for m in range(1, self.parts + 1)]
        self.probes = next((m for m, share in enumerate(held, 1) if share >= RECALL), self.parts)

    def order(self, x: np.ndarray) -> np.ndarray:
        """The parts from most to least probable, for each row."""
        return np.argsort(-probabilities(x * self.scale, self.w, self.b), axis=1, kind="stable")


def usable(df: DataFrame) -> DataFrame:
    """vec_id and embedding of rows that take part: an id, finite components, not all zero, and the usual length."""
    rows = columns_of(df, "vec_id", "embedding").where(
        "vec_id IS NOT NULL AND embedding IS NOT NULL"
        " AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
        " AND exists(embedding, x -> x <> 0)"
    )
    rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"))
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (usual["n"] if usual else 0)).dropDuplicates(["vec_id"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("embedding"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sample(rows: DataFrame, total: int, n: int, seed: int) -> np.ndarray:
    """About n rows drawn by a hash of vec_id, n and a half at most."""
    share = int(min(1.0, n / total) * (1 << 30))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < share).limit(n + n // 2)
    return np.array([r[0] for r in drawn.select("embedding").collect()], float)


def _search(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        asked = group["asked"].to_numpy()
        x = np.stack([np.frombuffer(v) for v in group["vector"]])
        ids = group["vec_id"].to_numpy()
        rows, row_ids = x[~asked], ids[~asked]
        out = []
        for start in range(0, int(asked.sum()), 256):
            queries, query_ids = x[asked][start : start + 256], ids[asked][start : start + 256]
            near = queries @ rows.T
            near[query_ids[:, None] == row_ids[None, :]] = -np.inf
            slack = SLACK * np.linalg.norm(queries, axis=1) * (np.linalg.norm(rows, axis=1).max() if len(rows) else 0)
            for i, query in enumerate(queries):
                least = np.partition(near[i], -k)[-k] if len(rows) > k else -np.inf
                found = np.flatnonzero((near[i] >= least - slack[i]) & (near[i] > -np.inf))
                scores = (rows[found] * query).sum(axis=1)  # the same sum for equal vectors, unlike the product above
                best = np.lexsort((row_ids[found], -scores))[:k]
                out.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": row_ids[found][best], "score": scores[best]}))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return pd.concat(out)

    return run


def nearest(df: DataFrame, is_query: F.Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row of `df` that `is_query` selects.

    `df` has vec_id and embedding. Nearest is the largest inner product; equal scores go
    by vec_id; a row is no candidate of its own vec_id. Rows without an id, null, zero or
    non-finite vectors, and vectors of another length than most have, take no part. Rows
    that repeat a vec_id count once. Fewer than k candidates give fewer rows, an empty
    table none. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = stage(usable(df), "ann_rows")
    total = rows.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], empty)
    parts = min(PARTS, -(-total // PART_ROWS))
    sample = _sample(rows, total, SAMPLE, 1) if parts > 1 else np.empty((0, 1))
    trials = _sample(rows, total, TRIALS, 2) if parts > 1 else sample
    model = Partitions(sample, trials, parts, k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.ascontiguousarray(_matrix(batch), float)
                home = model.order(x)[:, 0] if model.parts > 1 else np.zeros(len(x), int)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home, pa.int32()), batch.column(batch.schema.get_field_index("vec_id")),
                     pa.array([v.tobytes() for v in x], pa.binary()),
                     batch.column(batch.schema.get_field_index("asked"))], names=["part", "vec_id", "vector", "asked"]
                )

    marked = rows.withColumn("asked", is_query)
    index = stage(marked.mapInArrow(place, "part int, vec_id long, vector binary, asked boolean"), "ann_index")
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # at most PARTS rows
    counts = np.array([sizes.get(p, 0) for p in range(model.parts)])
    blocks = np.maximum(1, -(-counts // BLOCK))
    asked = index.where("asked").count()
    shares = max(1, -(-asked * model.probes // (model.parts * BLOCK)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.frombuffer(v) for v in batch.column(0).to_pylist()])
            order = model.order(x) if model.parts > 1 else np.zeros((len(x), 1), int)
            # More parts where the first ones hold fewer than k rows beside the query.
            enough = (np.cumsum(counts[order], axis=1) < k + 1).sum(axis=1) + 1
            visits = np.minimum(np.maximum(model.probes, enough), model.parts)
            which = [i for i, n in enumerate(visits) for p in order[i, :n] for _ in range(blocks[p])]
            part = [p for i, n in enumerate(visits) for p in order[i, :n] for _ in range(blocks[p])]
            block = [j for i, n in enumerate(visits) for p in order[i, :n] for j in range(blocks[p])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(block, pa.int32()),
                 batch.column(1).take(pa.array(which)), batch.column(0).take(pa.array(which))],
                names=["part", "block", "vec_id", "vector"],
            )

    sent = index.where("asked").select("vector", "vec_id").mapInArrow(route, "part int, block int, vec_id long, vector binary")
    sent = sent.withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(shares)).cast("int")).withColumn("asked", F.lit(True))
    many = F.create_map(*[x for p in range(model.parts) for x in (F.lit(p), F.lit(int(blocks[p])))])
    held = index.select(
        "part",
        F.pmod(F.xxhash64("vec_id"), many[F.col("part")]).cast("int").alias("block"),
        "vec_id",
        "vector",
        F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"),
        F.lit(False).alias("asked"),
    )
    found = sent.unionByName(held).groupBy("part", "block", "share").applyInPandas(
        _search(k), "query_id long, vec_id long, score double"
    )
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
