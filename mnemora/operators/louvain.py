"""Louvain communities in a fixed order, and their hierarchy.

Nodes move one after another, so that one task does it all; it holds numbers of nodes and communities in memory and the edges in files of
its own, so that its memory is bounded by the nodes. graph.label_communities() is parallel, but another method.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.runtime import durable

#: Least gain of a move and of a level, levels at most.
MOVE, LEVEL, LEVELS = 1e-10, 1e-5, 4
#: Entries of the matrix that are looked at together; nodes of more neighbours than WIDE are looked at as arrays.
CHUNK, WIDE = 1_000_000, 200


class Matrix:
    """Symmetric weights by row: ends of the rows in memory, columns and weights in files."""

    def __init__(self, parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], nodes: int):
        """From rows, columns and weights, ascending by row, then column."""
        self.nodes, n = nodes, 0
        count, self.size = np.zeros(nodes, np.int64), np.zeros(nodes)
        # unnamed files, which go with this object
        columns, weights = tempfile.TemporaryFile(), tempfile.TemporaryFile()  # noqa: SIM115
        for r, c, w in parts:
            if len(r):
                count += np.bincount(r, minlength=nodes)
                self.size += np.bincount(r, w, nodes)
                columns.write(c.astype(np.int32).tobytes())
                weights.write(w.astype(np.float64).tobytes())
                n += len(r)
        columns.flush()
        weights.flush()
        self.ends = np.concatenate([[0], np.cumsum(count)])
        self.columns = np.memmap(columns, np.int32, "r", shape=(n,)) if n else np.zeros(0, np.int32)
        self.weights = np.memmap(weights, np.float64, "r", shape=(n,)) if n else np.zeros(0)

    def chunks(self) -> Iterator[tuple[int, int]]:
        """Ranges of rows with about CHUNK entries each, or one row."""
        at = 0
        while at < self.nodes:
            to = max(at + 1, int(np.searchsorted(self.ends, self.ends[at] + CHUNK, "right")) - 1)
            yield at, to
            at = to

    def entries(self, at: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and weights of a range of rows."""
        i, j = self.ends[at], self.ends[to]
        return np.repeat(np.arange(at, to), np.diff(self.ends[at : to + 1])), np.asarray(self.columns[i:j]), np.asarray(self.weights[i:j])


def partition(m: Matrix) -> tuple[np.ndarray, float]:
    """``(community of each node, modularity)``; a community has the number of one of its first nodes."""
    total = float(m.size.sum())
    size, ends = m.size.tolist(), m.ends.tolist()
    of, load = list(range(m.nodes)), m.size.tolist()
    at_once = np.arange(m.nodes)  # of, for wide rows
    loads = m.size.copy()
    moves = total
    while moves:
        moves = 0
        for a, b in m.chunks():
            first = ends[a]
            narrow = ends[b] - first <= CHUNK
            columns, weights = (x[first : ends[b]].tolist() for x in (m.columns, m.weights)) if narrow else ((), ())
            for n in range(a, b):
                i, j = ends[n], ends[n + 1]
                home, own = of[n], size[n]
                load[home] -= own
                if j - i > WIDE:
                    loads[home] -= own
                    best = _wide(n, home, own / total, m.columns[i:j], m.weights[i:j], at_once, loads)
                    loads[best] += own
                else:
                    pull = {home: 0.0}
                    for k in range(i - first, j - first):
                        if (v := columns[k]) != n:
                            c = of[v]
                            pull[c] = pull.get(c, 0.0) + weights[k]
                    best, most = home, 0.0
                    for c in sorted(pull):
                        if (gain := pull[c] - load[c] * own / total) > most + MOVE:
                            best, most = c, gain
                    if best != home:
                        loads[home] -= own
                        loads[best] += own
                load[best] += own
                if best != home:
                    moves += 1
                    of[n] = at_once[n] = best
    inside = np.zeros(m.nodes)
    for a, b in m.chunks():
        r, c, w = m.entries(a, b)
        same = at_once[r] == at_once[c]
        inside += np.bincount(at_once[r[same]], w[same], m.nodes)
    q = sum(inside[c] / total - (load[c] / total) ** 2 for c in np.unique(at_once).tolist()) if total else 0.0
    return at_once, float(q)


def _wide(n: int, home: int, share: float, columns: np.ndarray, weights: np.ndarray, of: np.ndarray, loads: np.ndarray) -> int:
    """The community that a node with many neighbours moves to; its own size isn't in the loads."""
    other = columns != n
    found, at = np.unique(np.append(of[columns[other]], home), return_inverse=True)
    gains = np.bincount(at, np.append(weights[other], 0.0)) - loads[found] * share
    best, most, after = home, 0.0, 0
    while len(more := np.nonzero(gains[after:] > most + MOVE)[0]):
        after += int(more[0]) + 1
        best, most = int(found[after - 1]), float(gains[after - 1])
    return best


def _merged(m: Matrix, to: np.ndarray, nodes: int) -> Matrix:
    """Weights between the communities ``to`` of the nodes."""
    keys, sums, held = [], [], 0

    def fold() -> None:
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums[:] = [np.bincount(at, np.concatenate(sums), len(found))]
        keys[:] = [found]

    for a, b in m.chunks():
        r, c, w = m.entries(a, b)
        found, at = np.unique(to[r] * nodes + to[c], return_inverse=True)
        keys.append(found)
        sums.append(np.bincount(at, w, len(found)))
        held += len(found)
        if held > max(4 * CHUNK, 2 * len(keys[0])):
            fold()
            held = len(keys[0])
    fold()
    return Matrix(((keys[0][i : i + CHUNK] // nodes, keys[0][i : i + CHUNK] % nodes, sums[0][i : i + CHUNK]) for i in range(0, len(keys[0]), CHUNK)), nodes)


def levels(m: Matrix, most: int = LEVELS) -> list[np.ndarray]:
    """For each level the smallest node of each node's community."""
    member, least = np.arange(m.nodes), np.arange(m.nodes)  # each node's row in the matrix, the smallest node of each row
    found: list[np.ndarray] = []
    before = 0.0
    while m.nodes and len(found) < most:
        of, q = partition(m)
        groups, to = np.unique(of, return_inverse=True)
        if found and (len(groups) == 1 or q - before < LEVEL):
            break
        smallest = np.full(len(groups), len(member))
        np.minimum.at(smallest, to, least)
        order = np.argsort(smallest)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        to, least, before = place[to], smallest[order], q
        member = to[member]
        found.append(least[member])
        if len(found) < most:
            m = _merged(m, to, len(groups))
    return found


def communities(edges: DataFrame) -> DataFrame:
    """``(id, level, community)`` of edges ``(source_id, target_id)``; a community is named by its smallest member.

    Parallel edges add weight, loops are left out.
    """
    real = durable(edges.where("source_id <> target_id").groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.count("*").alias("w")))
    # numbers without gaps, ascending with the ids
    nodes = durable(real.select(F.explode(F.array("a", "b")).alias("id")).distinct().orderBy("id").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)))
    sizes = {r.part: r.n for r in nodes.groupBy("part").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total, total + sizes[part]
    if not total:
        return edges.select(F.col("source_id").alias("id"), F.lit(0).alias("level"), F.col("target_id").alias("community")).where(F.lit(False))
    start = F.create_map(*(F.lit(x) for pair in starts.items() for x in pair))[F.col("part")]
    nodes = durable(nodes.select("id", (start + F.col("at")).cast("long").alias("n")))
    names = lambda n, at: nodes.select(F.col("id").alias(n), F.col("n").alias(at))
    numbered = real.join(names("a", "i"), "a").join(names("b", "j"), "b").select("i", "j", F.col("w").cast("double").alias("w"))
    both = numbered.unionByName(numbered.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).repartition(1).sortWithinPartitions("i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matrix((tuple(c.to_numpy() for c in b.columns) for b in batches), total)
        for level, community in enumerate(levels(m)):
            for i in range(0, total, 100_000):
                c = community[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(c))), pa.array(np.full(len(c), level, np.int32)), pa.array(c)], ["n", "level", "c"])

    found = durable(both.mapInArrow(run, "n long, level int, c long"))
    return found.join(names("id", "n"), "n").join(names("community", "c"), "c").select("id", "level", "community")


def described(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``(level, community, parent, members, edges)``: the parent is the community one level up, edges are those inside."""
    up = found.select("id", (F.col("level") - 1).alias("level"), F.col("community").alias("parent"))
    per = found.join(up, ["id", "level"], "left").groupBy("level", "community").agg(F.min("parent").alias("parent"), F.count("*").alias("members"))
    a, b = found.select(F.col("id").alias("source_id"), "level", "community"), found.select(F.col("id").alias("target_id"), "level", F.col("community").alias("there"))
    inside = edges.join(a, "source_id").join(b, ["target_id", "level"]).where("community = there").groupBy("level", "community").agg(F.count("*").alias("edges"))
    return per.join(inside, ["level", "community"], "left").na.fill(0, ["edges"])
