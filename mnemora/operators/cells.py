"""Approximate vector search: an inverted file of cells around centroids that are fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.operators.vectors import _units
from mnemora.runtime import durable

#: Vectors that centroids are fitted on at most.
SAMPLE = 20_000
#: Places that scores are rounded to, so that ties are ties.
DIGITS = 9


def fit(rows: DataFrame, key: str, cells: int, column: str = "embedding", sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Unit centroids by Lloyd's rounds over the ``sample`` vectors of the smallest hash; one of no width without vectors."""
    x = np.array([r[0] for r in rows.orderBy(F.xxhash64(key)).limit(sample).select(column).collect()], np.float64)
    if not len(x):
        return np.zeros((1, 0))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[np.random.default_rng(0).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(n > 0, sums / np.maximum(n, 1e-12), c)
    return c


def search(rows: DataFrame, queries: DataFrame, key: str, centroids: np.ndarray, probes: int, k: int = 10, column: str = "embedding", block: int = 4096) -> DataFrame:
    """``(query, other, score, rank)``: of each query's ``probes`` cells the k rows of the greatest cosine, itself left out; ties by ``other``.

    Queries are a stated set, held in blocks of about ``block``. Each block scans the rows once, as matrix products of a batch's cells with
    the queries that visit them; a task hands on no more than k rows a query. Null vectors match nothing.
    """
    spark = queries.sparkSession
    asked = durable(queries.where(F.col(column).isNotNull()).select(F.col(key).cast("string").alias("query"), F.col(column).cast("array<double>").alias("q")))
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    narrow = rows.where(F.col(column).isNotNull()).select(F.col(key).cast("string").alias("other"), F.col(column).cast("array<double>").alias("v"))

    def scanned(i: int) -> DataFrame:
        stated = asked.where(F.col("block") == i).select("query", "q").collect()  # about ``block`` vectors
        x = np.array([r.q for r in stated], np.float64) if stated else np.zeros((0, 0))
        visited = _visited(x, centroids, probes) if len(x) else np.zeros((0, len(centroids)), bool)
        shared = spark.sparkContext.broadcast((np.array([r.query for r in stated], object), _units(x), visited))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, x, visited = shared.value
            if not len(names):
                return
            best = _Best(names, k)
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    ids = np.array(part.column(0).to_pylist(), object)
                    cell = (v @ centroids.T).argmax(1)
                    y = _units(v)
                    if visited.all():
                        best.add(np.arange(len(names)), ids, x @ y.T)
                        continue
                    for c in np.unique(cell).tolist():
                        own = np.nonzero(cell == c)[0]
                        q = np.nonzero(visited[:, c])[0]
                        if len(q):
                            best.add(q, ids[own], x[q] @ y[own].T)
            q, ids, scores = best.rows()
            for at in range(0, len(q), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(names[q[at : at + 8192]], pa.string()), pa.array(ids[at : at + 8192], pa.string()), pa.array(scores[at : at + 8192])], ["query", "other", "score"])

        return narrow.mapInArrow(run, "query string, other string, score double")

    hits = reduce(DataFrame.unionByName, (scanned(i) for i in range(blocks))).withColumn("score", F.round("score", DIGITS))
    at = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "other"))
    return hits.withColumn("rank", at).where(F.col("rank") <= k)


def _visited(x: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """Whether each vector, a row, visits each cell, a column."""
    found = np.zeros((len(x), len(centroids)), bool)
    np.put_along_axis(found, np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes], True, axis=1)
    return found


class _Best:
    """The k best rows of each query so far, by rounded score, then id."""

    def __init__(self, names: np.ndarray, k: int):
        self.names, self.k = names, k
        self.least = np.full(len(names), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.new = self.kept = 0

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of rows, a column each, with queries, a row each."""
        near = np.nonzero(scores.max(1) >= self.least[queries] - 10.0**-DIGITS)[0]
        queries, scores = queries[near], np.round(scores[near], DIGITS)
        floor = self.least[queries]
        if scores.shape[1] > self.k + 1:  # one more, as a row may be the query itself
            floor = np.maximum(floor, np.partition(scores, -self.k - 1, axis=1)[:, -self.k - 1])
        q, r = np.nonzero(scores >= floor[:, None])
        other = self.names[queries[q]] != ids[r]
        q, r = q[other], r[other]
        self.held.append((queries[q], ids[r], scores[q, r]))
        self.new += len(q)
        if self.new > max(200_000, self.kept):
            self._cut()

    def _cut(self) -> None:
        q, ids, scores = (np.concatenate(x) for x in zip(*self.held))
        _, place = np.unique(ids, return_inverse=True)
        order = np.lexsort((place, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.least[q[rank == self.k - 1]] = scores[rank == self.k - 1]
        top = rank < self.k
        self.held, self.new, self.kept = [(q[top], ids[top], scores[top])], 0, int(top.sum())

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
        self._cut()
        return self.held[0]
