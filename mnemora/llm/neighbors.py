"""The k most similar vectors of every vector by multiprobe p-stable hashing with exact reranking.

Vectors of equal numbers are one class, named by its smallest id. L tables hash the normalised classes by M functions
floor((a.x + b) / W) with normal a, for which the chance that a neighbour at a given distance falls into a given bucket
is known. A bucket with too many members is hashed again by further functions of half the width, as often as it takes, so
that dense regions end in buckets as small as any other. The first pass compares coarse codes of the classes of each bucket,
which bounds the distance of everyone's k-th neighbour. The second pass visits perturbed buckets in the order of
estimated success at that distance, until the estimate says that a neighbour at this distance is found with the chance
asked for, and merges what all tables give by exact similarity.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.runtime import durable, lookup_join

#: Tables, width of a slot in units of distance on the unit sphere, classes a bucket should hold, functions a table at least and at most.
TABLES, WIDTH, BUCKET, FUNCTIONS = 4, 3.0, 1024, (2, 24)
#: Perturbations of a table's functions at most (the T of multiprobe hashing), and the chance to find the k-th neighbour at which visiting ends.
PROBES, CHANCE = 160, 0.98
#: Members of a bucket above which it is hashed again, functions that do so, and how often: then slots are narrower than 1e-6.
BLOCK, FINER, LEVELS = 8192, 2, 22
#: A branch of a bucket that was hashed again is left out if its share of the bucket's chance is below this.
BRANCH_LEAST = 0.01
#: Buckets that are hashed again, at most: where there would be more, all tables get one more function.
SPLIT_MOST = 1_000_000
#: Classes that one task compares with one bucket, about; a bucket that more ask is copied to several tasks.
ASKED_MOST = 65_536
#: What a row does in its bucket.
MEMBER, MEMBER_ASKS, ASKS = 0, 1, 2
#: By how much similarities of codes may differ from exact ones, and usually do.
CODE_ERROR, CODE_USUAL = 0.004, 0.0007
#: Queries that an exact search holds at once.
STATED = 8192


def _mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    h = h.astype(np.uint64)
    with np.errstate(over="ignore"):
        for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return (h ^ (h >> np.uint64(33))).astype(np.int64)


def _tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal distribution, by a rational approximation good to 1e-7."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * poly


class Hashing:
    """The tables' functions, drawn from a seed, which buckets are hashed again, and the order in which perturbations are worth visiting."""

    def __init__(self, width: int, functions: int, tables: int = TABLES, slot: float = WIDTH, probes: int = PROBES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.m, self.tables, self.slot = functions, tables, slot
        self.a = rng.standard_normal((tables, width, functions))
        self.b = rng.uniform(0, slot, (tables, functions))
        self.finer = rng.standard_normal((LEVELS, tables, width, FINER))
        self.shift = rng.uniform(0, slot, (LEVELS, tables, FINER))
        self.mix = rng.integers(1, 2**62, functions + tables + FINER) | 1
        self.sets = [(), *self._template(functions, probes)]
        self.split: list[np.ndarray] = []  # by level, the sorted keys of buckets that are hashed again
        self.dense: dict[int, str] = {}  # of buckets too full after all levels, the last id that stands for them

    @staticmethod
    def _template(m: int, probes: int) -> list[tuple[int, ...]]:
        """Sets of ranks among the 2m sorted distances to slot borders, by rising expected sum of squares."""
        rank = np.arange(1, 2 * m + 1)
        low = rank * (rank + 1) / (4 * (m + 1) * (m + 2))
        high = 1 - (2 * m + 1 - rank) / (m + 1) + (2 * m + 1 - rank) * (2 * m + 2 - rank) / (4 * (m + 1) * (m + 2))
        z = np.where(rank <= m, low, high)
        heap, out = [(z[0], (0,))], []
        while heap and len(out) < probes:
            score, s = heapq.heappop(heap)
            if not any(2 * m - 1 - i in s for i in s):
                out.append(s)
            if (last := s[-1]) + 1 < 2 * m:
                heapq.heappush(heap, (score - z[last] + z[last + 1], (*s[:-1], last + 1)))
                heapq.heappush(heap, (score + z[last + 1], (*s, last + 1)))
        return out

    def home(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots of each function, and where in its slot each vector lies, from 0 to 1."""
        at = (x @ self.a[t] + self.b[t]) / self.slot
        slots = np.floor(at).astype(np.int64)
        return slots, at - slots

    def again(self, x: np.ndarray, t: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of the functions of a further level."""
        at = (x @ self.finer[level, t] + self.shift[level, t]) / self._slot(level)
        slots = np.floor(at).astype(np.int64)
        return slots, at - slots

    def _slot(self, level: int) -> float:
        return self.slot / 2 ** (level + 1)

    def key(self, slots: np.ndarray, t: int) -> np.ndarray:
        return _mixed((slots * self.mix[: self.m]).sum(1) + self.mix[self.m + t])

    def below(self, key: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Keys of the buckets that a bucket is hashed into."""
        return _mixed(key * 31 + (slots * self.mix[-FINER:]).sum(1) + 1)

    def _is_split(self, key: np.ndarray, level: int) -> np.ndarray:
        held = self.split[level]
        if not len(held):
            return np.zeros(len(key), bool)
        return held[np.minimum(np.searchsorted(held, key), len(held) - 1)] == key

    def leaf(self, x: np.ndarray, t: int) -> np.ndarray:
        """The bucket of each vector, after all levels."""
        key = self.key(self.home(x, t)[0], t)
        rows = np.arange(len(x))
        for level in range(len(self.split)):
            rows = rows[self._is_split(key[rows], level)]
            if not len(rows):
                break
            key[rows] = self.below(key[rows], self.again(x[rows], t, level)[0])
        return key

    def newest(self, x: np.ndarray, t: int) -> np.ndarray:
        """Keys at the last level of those vectors whose buckets were all hashed again so far."""
        key = self.key(self.home(x, t)[0], t)
        for level in range(len(self.split)):
            inside = self._is_split(key, level)
            x, key = x[inside], key[inside]
            key = self.below(key, self.again(x, t, level)[0])
        return key

    def visits(self, x: np.ndarray, distance: np.ndarray, chance: float = CHANCE) -> tuple[np.ndarray, np.ndarray]:
        """``(rows, keys)`` of the buckets to visit besides a vector's own, for neighbours at each one's given distance.

        For each function the chance that the neighbour stays in the slot, or goes to the one below or above, follows
        from a normal step of that distance. A set's chance in a table is the product over its functions. Sets are tried in
        the order that is best on average until the chance is reached; of what they gave, each vector visits in its own order
        no more than it takes.
        """
        rows = np.arange(len(x))
        distance = np.maximum(distance, 1e-9)
        sigma = distance[:, None] / self.slot
        tables = []
        for t in range(self.tables):
            slots, f = self.home(x, t)
            below, above = _tail(f / sigma), _tail((1 - f) / sigma)
            stay = np.maximum(1 - below - above, 1e-12)
            moves = np.concatenate([below / stay, above / stay], 1)
            order = np.argsort(-moves, axis=1, kind="stable")
            tables.append((slots, stay.prod(1), np.take_along_axis(moves, order, 1), order, self.leaf(x, t)))
        got = np.zeros((self.tables, len(x)))
        open_ = np.ones(len(x), bool)
        found: list[tuple[np.ndarray, ...]] = []
        for s in self.sets:
            live = rows[open_]
            if not len(live):
                break
            for t, (slots, stay, moves, order, own) in enumerate(tables):
                step = np.zeros((len(live), self.m), np.int64)
                gain = stay[live].copy()
                valid = np.ones(len(live), bool)
                for i in s:
                    which = order[live, i]
                    at = np.arange(len(live)), which % self.m
                    valid &= step[at] == 0
                    step[at] = np.where(which < self.m, -1, 1)
                    gain *= moves[live, i]
                to = live[valid]
                to, keys, gain = self._leaves(x, to, t, self.key(slots[to] + step[valid], t), gain[valid], distance)
                got[t] += np.bincount(to, gain, len(x))
                found.append((to, np.full(len(to), t), keys, gain, keys == own[to]))
            open_ = 1 - np.prod(1 - np.minimum(got, 1), axis=0) < chance
        to, table, keys, gain, own = (np.concatenate(p) for p in zip(*found))
        best = np.lexsort((-gain, ~own, to))
        to, table, keys, gain, own = to[best], table[best], keys[best], gain[best], own[best]
        starts = np.searchsorted(to, rows)
        missed = np.ones(len(to))
        for t in range(self.tables):
            sums = np.concatenate([[0.0], np.cumsum(np.where(table == t, gain, 0))])
            missed *= 1 - np.minimum(sums[:-1] - sums[starts][to], 1)  # before this one
        needed = ~own & (1 - missed < chance)
        return to[needed], keys[needed]

    def _leaves(self, x: np.ndarray, rows: np.ndarray, t: int, keys: np.ndarray, gain: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, keys and chances with buckets that are hashed again replaced by those of their parts that are worth a visit."""
        ready = []
        for level in range(len(self.split)):
            inside = self._is_split(keys, level)
            ready.append((rows[~inside], keys[~inside], gain[~inside]))
            rows, keys, gain = rows[inside], keys[inside], gain[inside]
            if not len(rows):
                break
            slots, f = self.again(x[rows], t, level)
            sigma = distance[rows, None] / self._slot(level)
            below, above = _tail(f / sigma), _tail((1 - f) / sigma)
            moves = np.stack([below, np.maximum(1 - below - above, 0), above], 2)
            share = np.ones((len(rows), 1))
            steps = np.zeros((1, 0), np.int64)
            for j in range(FINER):
                share = (share[:, :, None] * moves[:, None, j, :]).reshape(len(rows), -1)
                steps = np.concatenate([np.repeat(steps, 3, 0), np.tile([-1, 0, 1], len(steps))[:, None]], 1)
            r, c = np.nonzero((share >= BRANCH_LEAST) | (share >= share.max(1, keepdims=True)))
            rows, keys, gain = rows[r], self.below(keys[r], slots[r] + steps[c]), gain[r] * share[r, c]
        ready.append((rows, keys, gain))
        return tuple(np.concatenate(p) for p in zip(*ready))


def usable(rows: DataFrame, id_col: str, vec_col: str, width: int) -> DataFrame:
    """``(id, vec binary)``: rows of non-null ids with exactly ``width`` finite numbers, not all zero; vec holds single-precision numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            right = lists.is_valid().to_numpy(zero_copy_only=False) & (lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == width)
            picked = np.nonzero(right)[0]
            taken = b.take(pa.array(picked))
            x = taken.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width) + np.float32(0)  # no negative zero
            fine = np.isfinite(x).all(1) & x.any(1)
            yield pa.RecordBatch.from_arrays([taken.column(0).filter(pa.array(fine)), _binary(x[fine])], ["id", "vec"])

    narrow = rows.where(F.col(id_col).isNotNull() & (F.size(vec_col) == width)).select(F.col(id_col).cast("string"), F.col(vec_col).cast("array<float>"))
    return narrow.mapInArrow(run, "id string, vec binary")


def _binary(x: np.ndarray) -> pa.Array:
    """A binary value of each row's bytes."""
    each = x.shape[1] * x.itemsize
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(each)
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """Rows of numbers from binary values."""
    if not len(column):
        return np.zeros((0, width), dtype)
    first, last = (int(o) for o in np.frombuffer(column.buffers()[1], np.int32)[[column.offset, column.offset + len(column)]])
    return np.frombuffer(column.buffers()[2], np.uint8)[first:last].view(dtype).reshape(-1, width)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x / (top := np.abs(x).max(1, keepdims=True)), axis=1, keepdims=True) / top


def _codes(x: np.ndarray) -> np.ndarray:
    """Unit vectors as signed bytes and the step that one unit of them is."""
    step = (np.abs(x).max(1, keepdims=True) / 127).astype(np.float32)
    return np.concatenate([np.rint(x / step).astype(np.int8), step.view(np.int8)], 1)


def _decoded(codes: np.ndarray) -> np.ndarray:
    return codes[:, :-4].astype(np.float32) * np.ascontiguousarray(codes[:, -4:]).view(np.float32)


def _fitted(classes: DataFrame, n: int, width: int, tables: int) -> Hashing:
    """Functions for ``n`` classes, with the keys of all buckets of more than BLOCK members at each level.

    The driver sees these keys only, of which there are at most ``n * tables / BLOCK`` a level and SPLIT_MOST in all.
    """
    functions = min(FUNCTIONS[1], max(FUNCTIONS[0], int(log2(max(n, 1) / BUCKET)) if n > BUCKET else 0))
    while True:
        h = Hashing(width, functions, tables)
        full = None
        for _ in range(LEVELS + 1):
            if n <= BLOCK:  # no bucket can be too full
                break

            def keys(batches: Iterator[pa.RecordBatch], h: Hashing = h) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    x = _unit(_matrix(b.column(0), np.float32, width))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h.newest(x, t) for t in range(tables)]))], ["key"])

            counts = classes.select("vec").mapInArrow(keys, "key long").groupBy("key").count().where(F.col("count") > BLOCK)
            full = np.array(sorted(r.key for r in counts.limit(SPLIT_MOST + 1).collect()), np.int64)
            if not len(full) or len(full) + sum(map(len, h.split)) > SPLIT_MOST or len(h.split) == LEVELS:
                break
            h.split.append(full)
        if full is None or not len(full):
            return h
        if len(h.split) == LEVELS:  # slots of the last level can't tell these vectors apart
            h.dense = _standing(classes, h, set(full.tolist()), width)
            return h
        functions += 1


def _standing(classes: DataFrame, h: Hashing, full: set[int], width: int) -> dict[int, str]:
    """Of buckets that no level could divide, the BLOCK-th smallest id."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.array(sorted(full), np.int64)
        for b in batches:
            x = _unit(_matrix(b.column(1), np.float32, width))
            for t in range(h.tables):
                key = h.leaf(x, t)
                inside = np.isin(key, held)
                yield pa.RecordBatch.from_arrays([pa.array(key[inside]), b.column(0).filter(pa.array(inside))], ["key", "k"])

    first = Window.partitionBy("key").orderBy("k")  # tasks keep BLOCK ids of a bucket before they are shuffled
    kept = classes.select("k", "vec").mapInArrow(keys, "key long, k string").withColumn("at", F.row_number().over(first)).where(F.col("at") <= BLOCK)
    return {r.key: r.k for r in kept.groupBy("key").agg(F.max("k").alias("k")).collect()}


_ROW = "key long, part int, role int, k string, vec binary, low double"


def _rows(key: np.ndarray, part: np.ndarray, role: np.ndarray, k: pa.Array, vec: pa.Array, low: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(part.astype(np.int32)), pa.array(role.astype(np.int32)), k, vec, pa.array(low)], ["key", "part", "role", "k", "vec", "low"])


def _roles(h: Hashing, key: np.ndarray, k: pa.Array) -> np.ndarray:
    """Members ask, too; in a bucket that can't be divided only the smallest ids are members, to which ties go."""
    role = np.full(len(key), MEMBER_ASKS)
    if h.dense:
        for i, (bucket, name) in enumerate(zip(key.tolist(), k.to_pylist())):
            if bucket in h.dense and name.encode() > h.dense[bucket].encode():
                role[i] = ASKS
    return role


def _at_home(classes: DataFrame, h: Hashing, width: int) -> DataFrame:
    """Codes of each class in its own bucket of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(_matrix(b.column(1), np.float32, width))
            codes = _binary(_codes(x))
            for t in range(h.tables):
                key = h.leaf(x, t)
                yield _rows(key, np.zeros(len(x)), _roles(h, key, b.column(0)), b.column(0), codes, np.full(len(x), -2.0))

    return classes.select("k", "vec").mapInArrow(run, _ROW)


def _asked(bounded: DataFrame, h: Hashing, width: int, chance: float) -> dict[int, int]:
    """Tasks that each bucket is copied to, of those that more than ASKED_MOST classes ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            x = _unit(_matrix(b.column(0), np.float32, width))
            yield pa.RecordBatch.from_arrays([pa.array(h.visits(x, _distance(b.column(1)), chance)[1])], ["key"])
            for t in range(h.tables):
                yield pa.RecordBatch.from_arrays([pa.array(h.leaf(x, t))], ["key"])

    counts = bounded.select("vec", "low").mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") > ASKED_MOST)
    return {r["key"]: -(-r["count"] // ASKED_MOST) for r in counts.collect()}  # at most one in ASKED_MOST of all visits


def _distance(low: pa.Array) -> np.ndarray:
    return np.sqrt(2 * np.maximum(CODE_USUAL, 1 - CODE_ERROR - low.to_numpy(zero_copy_only=False)))


def _visiting(bounded: DataFrame, h: Hashing, width: int, chance: float, parts: dict[int, int]) -> DataFrame:
    """Each class as a member of its own buckets, and asking in those that it visits."""

    def spread(key: np.ndarray, k: pa.Array) -> np.ndarray:
        """The task of each that asks."""
        part = np.zeros(len(key), np.int64)
        if parts:
            many = np.array([parts.get(x, 1) for x in key.tolist()])
            hot = np.nonzero(many > 1)[0]
            part[hot] = [hash_of(k[i].as_py()) % many[i] for i in hot.tolist()]
        return part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            k, vec = b.column(0), b.column(1)
            x, low = _unit(_matrix(vec, np.float32, width)), b.column(2).to_numpy(zero_copy_only=False)
            for t in range(h.tables):
                key = h.leaf(x, t)
                role, part = _roles(h, key, k), spread(key, k)
                yield _rows(key, part, role, k, vec, low)
                if parts:  # copies of members for the other tasks of their bucket
                    for i in np.nonzero(role != ASKS)[0].tolist():
                        if (n := parts.get(int(key[i]), 1)) > 1:
                            others = np.array([p for p in range(n) if p != part[i]])
                            at = pa.array(np.full(n - 1, i))
                            yield _rows(np.full(n - 1, key[i]), others, np.full(n - 1, MEMBER), k.take(at), vec.take(at), np.zeros(n - 1))
            rows, keys = h.visits(x, _distance(b.column(2)), chance)
            if len(rows):
                at = pa.array(rows)
                yield _rows(keys, spread(keys, k.take(at)), np.full(len(rows), ASKS), k.take(at), vec.take(at), low[rows])

    return bounded.select("k", "vec", "low").mapInArrow(run, _ROW)


def _sliced(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows``, as visits hold many numbers a row."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def hash_of(name: str) -> int:
    """The same in every process."""
    return reduce(lambda h, c: (h * 31 + c) & 0xFFFFFFFF, name.encode(), 7)


def _blocks(batches: Iterator[pa.RecordBatch], decode: Callable) -> Iterator[tuple[bool, pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """``(new, ids, vectors of members; ids, vectors, bounds of those that ask)``: a bucket's members at once, those that ask in batches."""
    group, held, waiting = None, [], []

    def members() -> tuple[pa.Array, np.ndarray]:
        if len(held) > 1:
            held[:] = [(pa.concat_arrays([a for a, _ in held]), np.concatenate([b for _, b in held]))]
        return held[0]

    def members_ask():
        for part in waiting:
            yield *members(), *part
        waiting.clear()

    for b in batches:
        if not b.num_rows:
            continue
        key, part, role = (b.column(i).to_numpy() for i in range(3))
        k, x, low = b.column(3), decode(b.column(4)), b.column(5).to_numpy()
        cuts = np.nonzero((np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(role) != 0))[0] + 1
        for i, j in zip([0, *cuts], [*cuts, len(key)]):
            if (now := (key[i], part[i])) != group:
                yield from members_ask()
                group = now
                held.clear()
            if role[i] != ASKS:
                held.append((k[i:j], x[i:j]))
            if role[i] == MEMBER_ASKS:
                waiting.append((k[i:j], x[i:j], low[i:j]))
            elif role[i] == ASKS and held:
                yield from members_ask()
                yield *members(), k[i:j], x[i:j], low[i:j]
    yield from members_ask()


def _floor(sims: np.ndarray, top: int) -> np.ndarray:
    """A bound that at least ``top`` of each row reach, and few others: the top-th of the maxima of groups of columns."""
    n, m = sims.shape
    groups = min(m // 8, 64 * top)
    if groups < 2 * top:
        return np.partition(sims, m - top, axis=1)[:, m - top] if m >= top else np.full(n, -2.0, np.float32)
    each = m // groups
    maxima = sims[:, : groups * each].reshape(n, groups, each).max(2)
    return np.partition(maxima, groups - top, axis=1)[:, groups - top]


def _bounds(members: DataFrame, width: int, top: int) -> DataFrame:
    """``(k, low)``: for each class and each of its buckets a similarity that ``top`` others in it reach; none where there are fewer."""
    both = members.repartition("key").sortWithinPartitions("key", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y, k, x, _ in _blocks(batches, lambda c: _decoded(_matrix(c, np.int8, width + 4))):
            if len(ids) > top:
                for i in range(0, len(k), 512):
                    low = _floor(x[i : i + 512] @ y.T, top + 1)  # one of them is itself
                    yield pa.RecordBatch.from_arrays([k[i : i + 512], pa.array(low.astype(np.float64))], ["k", "low"])

    return both.mapInArrow(run, "k string, low double").groupBy("k").agg(F.max("low").alias("low"))


def _compare(rows: DataFrame, width: int, top: int) -> DataFrame:
    """``(k, other, sim)``: for each that asks its ``top`` most similar members of each bucket, other than itself, above its bound."""
    both = rows.repartition("key", "part").sortWithinPartitions("key", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y, k, x, low in _blocks(batches, lambda c: _unit(_matrix(c, np.float32, width))):
            yield from _answers(ids, y, k, x, low, top)

    return both.mapInArrow(run, "k string, other string, sim double")


def _answers(ids: pa.Array, y: np.ndarray, k: pa.Array, x: np.ndarray, low: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    y32 = y.astype(np.float32)
    for i in range(0, len(k), 512):
        q, own = x[i : i + 512], k[i : i + 512]
        sims = q.astype(np.float32) @ y32.T
        least = (low[i : i + 512] - 2e-6).astype(np.float32)  # what single precision can't tell goes on
        above = sims >= least[:, None]
        if len(many := np.nonzero(np.count_nonzero(above, axis=1) > 4 * top)[0]):
            above[many] &= sims[many] >= _floor(sims[many], top + 1)[:, None] - np.float32(2e-6)
        rows, cols = np.nonzero(above)
        for a in range(0, len(rows), 200_000):
            r, c = rows[a : a + 200_000], cols[a : a + 200_000]
            names, asking = ids.take(pa.array(c)), own.take(pa.array(r))
            exact = np.einsum("ij,ij->i", q[r], y[c])
            other = np.asarray(pc.not_equal(names, asking))
            if len(r) > top * len(q):  # ties: only the smallest ids go on
                rank = np.empty(len(ids), np.int64)
                rank[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
                order = np.lexsort((rank[c], -np.round(exact, 9), ~other, r))
                starts = np.r_[0, np.nonzero(np.diff(r[order]))[0] + 1]
                at = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
                keep = np.zeros(len(r), bool)
                keep[order[at < top]] = True
                other &= keep
            kept = pa.array(other)
            yield pa.RecordBatch.from_arrays([asking.filter(kept), names.filter(kept), pa.array(exact[other])], ["k", "other", "sim"])


def _best(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` most similar others of each k."""
    # one shuffle by k serves both the grouping and the window
    distinct = found.repartition("k").groupBy("k", "other").agg(F.max("sim").alias("sim"))
    return distinct.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy(F.desc(F.round("sim", 9)), "other"))).where(F.col("at") <= top).drop("at")


def exact(queries: DataFrame, classes: DataFrame, width: int, top: int) -> DataFrame:
    """``(k, other, sim)``: the ``top`` most similar others of stated queries ``(k, vec)``, each against all, STATED queries at once."""
    spark = queries.sparkSession
    found = [spark.createDataFrame([], "k string, other string, sim double")]
    part: list = []

    def search(stated: list) -> DataFrame:
        names = [r.k for r in stated]
        x = _unit(np.stack([np.frombuffer(r.vec, np.float32) for r in stated]))
        shared = spark.sparkContext.broadcast((names, x))  # STATED vectors at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, x = shared.value
            k, low = pa.array(names, pa.string()), np.full(len(names), -2.0)
            for b in batches:
                yield from _answers(b.column(0), _unit(_matrix(b.column(1), np.float32, width)), k, x, low, top)

        return durable(_best(classes.select("k", "vec").mapInArrow(run, "k string, other string, sim double"), top))

    for r in queries.select("k", "vec").toLocalIterator():
        part.append(r)
        if len(part) == STATED:
            found.append(search(part))
            part = []
    if part:
        found.append(search(part))
    return reduce(DataFrame.unionByName, found)


def classes_of(rows: DataFrame, id_col: str, vec_col: str, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``named(id, h)``, ``classes(k, vec, several)`` and ``several(k, h)``, the classes of more than one id; vectors are shuffled once."""
    every = durable(usable(rows, id_col, vec_col, width).withColumn("h", F.concat_ws("-", F.xxhash64("vec"), F.xxhash64(F.lit(1), "vec"))))
    torn = every.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("id")
    if not torn.isEmpty():
        torn = durable(torn)
        one = every.join(torn, "id", "left_semi").groupBy("id").agg(F.max(F.struct("vec", "h")).alias("m")).select("id", "m.vec", "m.h")
        every = every.join(torn, "id", "left_anti").unionByName(one)
    grouped = every.groupBy("vec").agg(F.min("id").alias("k"), (F.max("id") != F.min("id")).alias("several"), F.first("h").alias("h"))
    classes = durable(grouped)
    return every.select("id", "h"), classes.select("k", "vec"), classes.where("several").select("k", "h")


def nearest(rows: DataFrame, id_col: str = "id", vec_col: str = "embedding", width: int = 64, k: int = 10, tables: int = TABLES, chance: float = CHANCE) -> DataFrame:
    """``(id, other, sim, rank)``: for each usable id its k most similar other ids by cosine similarity.

    Similarities are computed in double precision and rounded to 9 decimals; ties go to the smaller id. Vectors of
    other widths, with nulls, NaN or infinity, and zero vectors are in no pair, repeated rows count once; of several vectors
    of an id the greatest by its bytes holds. Approximate: a neighbour is missed with a chance of about 1 - ``chance``, or
    more where PROBES perturbations a table don't reach that. Whoever finds fewer than k is searched for in full. An empty
    input gives an empty result.
    """
    named, classes, several = classes_of(rows, id_col, vec_col, width)
    n = classes.count()
    h = _fitted(classes, n, width, tables)
    low = durable(_bounds(_at_home(classes, h, width), width, k))
    # fewer than k at home: nothing is known of the distance, and neighbours up to right angles are looked for
    bounded = classes.join(low, "k", "left").select("k", "vec", F.coalesce(F.col("low") - F.lit(CODE_ERROR), F.lit(0.0)).alias("low"))
    if n > ASKED_MOST:  # below, no bucket can be asked by more
        bounded = durable(bounded)
        parts = _asked(bounded, h, width, chance)
    else:
        parts = {}
    near = durable(_best(_compare(_visiting(bounded, h, width, chance, parts), width, k), k))
    counts = near.groupBy("k").count().where(F.col("count") >= min(k, n - 1))
    short = durable(classes.join(counts, "k", "left_anti"))
    if not short.isEmpty():
        near = near.join(short.select("k"), "k", "left_anti").unionByName(exact(short, classes, width, k))
    return _named(near, named, several, k)


def _named(near: DataFrame, named: DataFrame, several: DataFrame, k: int) -> DataFrame:
    """Classes' neighbours to ids' neighbours. A class's own ids are its nearest, at similarity 1."""
    members = durable(lookup_join(named, several, "h").select("k", "id").distinct())
    # a class keeps its k + 1 smallest ids, which are all that anyone's k nearest may hold of it
    first = members.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("id"))).where(F.col("at") <= k + 1)
    heads = durable(first.groupBy(F.col("k").alias("other")).agg(F.collect_list("id").alias("ids")))  # k + 1 ids at most
    others = near.select("k", "other", F.round("sim", 9).alias("sim")).unionByName(several.select("k", F.col("k").alias("other"), F.lit(1.0).alias("sim")))
    every = lookup_join(others, heads, "other", "left").select("k", F.explode(F.coalesce("ids", F.array("other"))).alias("other"), "sim")
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("sim"), "other"))
    ranked = durable(every.withColumn("rank", rank).where(F.col("rank") <= k + 1))
    single = ranked.join(several.select("k"), "k", "left_anti").where(F.col("rank") <= k).select(F.col("k").alias("id"), "other", "sim", "rank")
    lists = ranked.join(several.select("k"), "k", "left_semi").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "sim"))).alias("list"))  # k + 1 items at most
    # every id of a class gets its class's list without itself
    copied = lookup_join(members, lists, "k").select("id", F.posexplode(F.slice(F.expr("filter(list, x -> x.other <> id)"), 1, k)).alias("at", "n"))
    return single.unionByName(copied.select("id", F.col("n.other").alias("other"), F.col("n.sim").alias("sim"), (F.col("at") + 1).alias("rank")))


def pairs(neighbors: DataFrame) -> DataFrame:
    """Distinct ``(id_a, id_b)``, id_a < id_b, of which at least one is among the other's nearest."""
    return neighbors.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def recall(rows: DataFrame, asking: DataFrame, id_col: str = "id", vec_col: str = "embedding", width: int = 64, k: int = 10) -> DataFrame:
    """``(n_queries, wanted, found, recall)`` of ``nearest`` for the stated ids ``asking(id)``, against an exact search.

    Equal vectors under several ids are told apart as ``nearest`` does. Without usable ids nothing is wanted and recall is null.
    """
    named, classes, several = classes_of(rows, id_col, vec_col, width)
    stated = usable(rows, id_col, vec_col, width).join(asking.select(F.col(id_col).cast("string").alias("id")).distinct(), "id", "left_semi")
    one = durable(stated.groupBy("id").agg(F.max("vec").alias("vec")))
    of_class = one.join(classes, "vec").select("id", "k", "vec")
    near = exact(of_class.select("k", "vec").distinct(), classes, width, k)
    wanted = _named(near, named, several, k).join(one.select("id"), "id", "left_semi").select("id", "other")
    found = nearest(rows, id_col, vec_col, width, k).select("id", "other", F.lit(1).alias("hit"))
    both = wanted.join(found, ["id", "other"], "left")
    counts = both.agg(F.countDistinct("id").alias("n_queries"), F.count("*").alias("wanted"), F.count("hit").alias("found"))
    return counts.withColumn("recall", F.round(F.col("found") / F.nullif("wanted", F.lit(0)), 4))
