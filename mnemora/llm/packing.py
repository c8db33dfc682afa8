"""Items of varying length into containers of fixed capacity, by a configuration linear program over the length histogram.

The driver sees the histogram only, which has at most one row per length up to the capacity, whatever the number of items.
A content is a list of slots, and a slot may hold any item that isn't longer; so for each length the slots that long or longer
must be as many as such items. The program of the fewest contents under these demands is solved by multiplicative weights on both
sides: demands weigh more the less they are covered, contents are used more the more weight they cover. New contents
come from a knapsack dynamic program over all lengths at the prices that the weights make. Any prices also give a bound that no
packing can beat: all items' prices together over the greatest price of a content. The program starts from packing the longest
first and ends once its value is near the bound. It is rounded in several ways, what is left over is packed longest first, and
the fewest containers are taken. Items are then dealt out by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemora.runtime import durable

#: Rounds of pricing at most, updates of the weights in each, and the gap to the bound at which the program ends.
ROUNDS, UPDATES, GAP = 50, 400, 0.0005
#: How sharply weights fall with coverage in the first round and the last, how strongly contents answer, and how far from the best new ones may be.
SHARP, ANSWER, NEAR = (30.0, 3000.0), 60.0, 0.03
#: What is added to the uses of contents before they are rounded down; each is tried.
ROUNDINGS = (1e-9, 0.3, 0.5, 0.7)
#: Rows of one length that one task ranks, about.
RANKED = 200_000

Contents = list[tuple[list[tuple[int, int]], int]]


def longest_first(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> Contents:
    """Contents, as ``(index of size, items)``, and numbers of containers, when each is filled by the longest items that fit."""
    left = counts.astype(np.int64).copy()
    alive = np.nonzero(left)[0].tolist()
    lengths = [int(sizes[i]) for i in alive]
    made = []
    while alive:
        room, high, uses = capacity, len(alive), []
        while (high := bisect_right(lengths, room, 0, high)) > 0:
            i = alive[high - 1]
            c = min(int(left[i]), room // lengths[high - 1])
            uses.append((i, c))
            room -= c * lengths[high - 1]
            high -= 1
        times = min(int(left[i]) // c for i, c in uses)
        made.append((uses, times))
        for i, c in uses:
            left[i] -= c * times
            if not left[i]:
                at = bisect_left(lengths, int(sizes[i]))
                del lengths[at], alive[at]
    return made


def knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each room up to the capacity the greatest value, the size to use next for it, and the room from which that is used.

    Any size may be used any number of times. Sizes ascend.
    """
    dense = np.full(capacity + 1, -np.inf)
    dense[sizes] = value
    best, size, at = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
    least = int(sizes[0])
    for c in range(least, capacity + 1):
        tried = best[c - least :: -1] + dense[least : c + 1]
        j = int(tried.argmax())
        if tried[j] > best[c - 1] * (1 + 1e-12):
            best[c], size[c], at[c] = tried[j], j + least, c
        else:
            best[c], size[c], at[c] = best[c - 1], size[c - 1], at[c - 1]
    return best, size, at


def _through(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The greatest value of a content, and the best content through each size if it is near that: content, size and uses of each entry."""
    best, size, at = knapsack(sizes, value, capacity)
    index = np.zeros(capacity + 1, np.int64)
    index[sizes] = np.arange(len(sizes))
    good = np.nonzero(value + best[capacity - sizes] >= (1 - NEAR) * best[capacity])[0]
    room = capacity - sizes[good]
    live = np.arange(len(good))
    content, item = [live], [good]
    while len(live := live[size[room[live]] > 0]):
        s = size[room[live]]
        content.append(live)
        item.append(index[s])
        room[live] = at[room[live]] - s
    keys, uses = np.unique(np.concatenate(content) * len(sizes) + np.concatenate(item), return_counts=True)
    return float(best[capacity]), keys // len(sizes), keys % len(sizes), uses


def _bound_of_lengths(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best bound by prices of one for what leaves less than ``e``, none for what is less than ``e``, and by length between; and its prices."""
    volume, number = np.zeros(capacity + 1), np.zeros(capacity + 1)
    volume[sizes], number[sizes] = sizes * counts, counts
    volume, number = np.cumsum(volume), np.cumsum(number)
    e = np.arange(capacity // 2 + 1)
    bounds = number[capacity] - number[capacity - e] + (volume[capacity - e] - np.where(e > 0, volume[np.maximum(e - 1, 0)], 0)) / capacity
    k = int(bounds.argmax())
    return float(bounds[k]), np.where(sizes > capacity - k, 1.0, np.where(sizes < k, 0.0, sizes / capacity))


@dataclass
class Program:
    """Entries ``(content, index of size, uses)``, how often each content is used, the value of that and the bound."""

    content: np.ndarray
    item: np.ndarray
    uses: np.ndarray
    times: np.ndarray
    value: float
    bound: float


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> Program:
    """The configuration program, started from packing the longest first, until value and bound are near or ROUNDS are over."""
    m = len(sizes)
    demand = np.cumsum(counts[::-1].astype(np.float64))[::-1]  # items of each length or longer
    first = longest_first(sizes, counts, capacity)
    content = np.array([j for j, (u, _) in enumerate(first) for _ in u])
    item, uses = (np.array([e[k] for u, _ in first for e in u]) for k in (0, 1))
    x = np.array([t for _, t in first], np.float64)
    bound, price = _bound_of_lengths(sizes, counts, capacity)
    done = Program(content, item, uses, x.copy(), float(x.sum()), bound)
    known: set[int] = set()
    spread = np.random.default_rng(0).integers(1, 2**62, m) | 1
    for sharp in np.geomspace(*SHARP, ROUNDS):
        if done.value <= bound * (1 + GAP):
            break
        best, c, i, u = _through(sizes, price, capacity)
        bound = max(bound, float(counts @ price) / best)
        name = np.zeros(int(c.max()) + 1, np.int64)
        np.add.at(name, c, spread[i] * (u * 0x9E3779B1 + 1))
        new = np.array([h not in known for h in name.tolist()])
        known.update(name.tolist())
        number, kept = np.cumsum(new) - 1 + len(x), new[c]
        content, item, uses = np.concatenate([content, number[c[kept]]]), np.concatenate([item, i[kept]]), np.concatenate([uses, u[kept]])
        x = np.concatenate([x, np.full(int(new.sum()), 0.02 * x.sum() / max(1, new.sum()))])
        total = np.zeros(m)
        answer = min(0.3, ANSWER / sharp)
        for step in range(UPDATES):
            x *= bound / x.sum()
            covered = np.cumsum(np.bincount(item, uses * x[content], m)[::-1])[::-1] / demand
            if (low := covered.min()) > 0 and bound / low < done.value:
                done = Program(content, item, uses, x / low, bound / low, bound)
            price = np.cumsum(np.exp(-sharp * (covered - low)) / demand)
            worth = np.bincount(content, uses * price[item], len(x))
            x = x * np.exp(np.clip(answer * (worth * (x.sum() / float(x @ worth)) - 1), -0.3, 0.3))
            if step >= UPDATES // 2:
                total += price / (price @ counts)
        price = total
        alive = x > 1e-5 * x.mean()
        number, kept = np.cumsum(alive) - 1, alive[content]
        content, item, uses, x = number[content[kept]], item[kept], uses[kept], x[alive]
    done.bound = bound
    return done


@dataclass
class Plan:
    """Rows of ``plan``, the number of containers, and how few there must be."""

    rows: list[tuple[int, ...]]
    containers: int
    bound: float


def _dealt(sizes: np.ndarray, counts: np.ndarray, contents: Contents) -> tuple[list[tuple[int, ...]], np.ndarray, list[int]]:
    """Items to slots, the longest first and each to the shortest that holds it; what is left over, and how often each content is used.

    Rows are ``(index of size, low, high, content, per, offset, slot size, start)``: rank r of the size takes slot
    ``start + r - low`` of those slots, numbered through all containers of the content.
    """
    slots = []
    for j, (u, times) in enumerate(contents):
        offset = 0
        for i, c in sorted(u, reverse=True):
            slots.append((i, j, c, offset, c * times))
            offset += c * int(sizes[i])
    slots.sort()
    rows, left, used, stack = [], counts.astype(np.int64).copy(), [0] * len(contents), []
    for k in range(len(sizes) - 1, -1, -1):
        while slots and slots[-1][0] >= k:
            i, j, c, offset, n = slots.pop()
            stack.append([i, j, c, offset, n, 0])
        low = 0
        while left[k] and stack:
            i, j, c, offset, n, start = stack[-1]
            take = min(int(left[k]), n - start)
            rows.append((k, low, low + take, j, c, offset, int(sizes[i]), start))
            low, stack[-1][5] = low + take, start + take
            used[j] = max(used[j], -(-(start + take) // c))
            left[k] -= take
            if stack[-1][5] == n:
                stack.pop()
    return rows, left, used


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> Plan:
    """Where items of each of the ascending sizes go, ``counts`` of each, and the bound on how few containers can hold them.

    Rows are ``(size, low, high, container, per, place, step, start)``: the item of rank r, low <= r < high, among those of its size stands
    in slot q = start + r - low of these, which is in container ``container + q // per`` at ``place + q % per * step``.
    """
    if not len(sizes):
        return Plan([], 0, 0.0)
    program = solve(sizes, counts, capacity)
    by = np.argsort(program.content, kind="stable")
    cuts = np.searchsorted(program.content[by], np.arange(len(program.times) + 1))
    held = [[(int(program.item[e]), int(program.uses[e])) for e in by[a:b]] for a, b in zip(cuts[:-1], cuts[1:])]
    best: tuple[int, list, list] | None = None
    for more in (None, *ROUNDINGS):  # none: all longest first
        times = np.zeros(len(held)) if more is None else np.floor(program.times + more)
        chosen = [(held[j], int(times[j])) for j in np.nonzero(times)[0]]
        rows, left, used = _dealt(sizes, counts, chosen)
        rest = longest_first(sizes, left, capacity)
        n = sum(used) + sum(t for _, t in rest)
        if best is None or n < best[0]:
            best = n, [(u, t) for (u, _), t in zip(chosen, used)], rest
    n, chosen, rest = best
    rows, left, _ = _dealt(sizes, counts, chosen)
    more, after, _ = _dealt(sizes, left, rest)
    assert not after.any()
    before = counts.astype(np.int64) - left  # ranks already placed
    base = np.cumsum([0, *(t for _, t in chosen), *(t for _, t in rest)])
    out = [(int(sizes[k]), low, high, int(base[j]), per, place, step, start) for k, low, high, j, per, place, step, start in rows]
    out += [(int(sizes[k]), low + int(before[k]), high + int(before[k]), int(base[len(chosen) + j]), per, place, step, start) for k, low, high, j, per, place, step, start in more]
    return Plan(sorted(out), n, program.bound)


def pieces(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """``(id, piece, pieces, start, size)``: an item over the capacity becomes full pieces and a rest, any other is one piece."""
    return (
        items.select(id_col, F.coalesce(size_col, F.lit(0)).cast("long").alias("whole"))
        .select(id_col, "whole", F.greatest(F.lit(1), F.ceil(F.col("whole") / F.lit(capacity))).cast("int").alias("pieces"))
        .select(id_col, "whole", "pieces", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        .select(id_col, "piece", "pieces", (F.col("piece").cast("long") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("piece").cast("long") * capacity).cast("int").alias("size"))
    )


def planned(items: DataFrame, id_col: str, size_col: str, capacity: int) -> tuple[DataFrame, Plan]:
    """The result of ``pack`` and the plan behind it."""
    spark = items.sparkSession
    cut = durable(pieces(items, id_col, size_col, capacity))
    histogram = cut.where("size > 0").groupBy("size").count().orderBy("size").collect()  # at most ``capacity`` rows
    sizes, counts = (np.array([r[k] for r in histogram], np.int64) for k in ("size", "count"))
    made = plan(sizes, counts, capacity)
    columns = np.array(made.rows, np.int64).reshape(-1, 8).T
    shared = spark.sparkContext.broadcast(((columns[0] << 40) + columns[1], columns))  # bounded by lengths and contents, not by items

    @F.pandas_udf("container long, place int")
    def spot(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, (_, low, _, container, per, place, step, start) = shared.value
        at = np.searchsorted(starts, (size.to_numpy().astype(np.int64) << 40) + rank.to_numpy(), "right") - 1
        q = start[at] + rank.to_numpy() - low[at]
        return pd.DataFrame({"container": container[at] + q // per[at], "place": (place[at] + q % per[at] * step[at]).astype(np.int32)})

    salts = 1 + int(counts.sum()) // RANKED
    salted = cut.where("size > 0").withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int"))
    local = salted.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy(id_col, "piece")) - 1)
    before = salted.groupBy("size", "salt").count()
    before = before.select("size", "salt", (F.sum("count").over(Window.partitionBy("size").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = local.join(before, ["size", "salt"]).withColumn("spot", spot("size", F.col("rank") + F.col("before")))
    names = [id_col, "piece", "pieces", "start", "size"]
    empty = cut.where("size = 0").select(*names, F.lit(0).cast("long").alias("container"), F.lit(0).alias("place"))
    return ranked.select(*names, "spot.container", "spot.place").unionByName(empty), made


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """``(id, piece, pieces, start, size, container, place)`` for every item: the container and the offset in it.

    Only an item over the capacity has several pieces; ``start`` is where the piece starts in the item. Containers are
    numbered from 0 without gaps, their contents don't overlap. An item of no size, or null, stands at the start of container 0.
    Repeated rows are items of their own. An empty input gives an empty result.
    """
    return planned(items, id_col, size_col, capacity)[0]
