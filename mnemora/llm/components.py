"""Pairwise matches to groups by seed-tree pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.runtime import durable, lookup_join


def applied_links(rows: DataFrame, a: str = "alias", b: str = "canonical_id", status: str = "status", time_col: str = "decided_at", wanted: str = "applied") -> DataFrame:
    """Distinct links ``(a, b)``, a < b, of two different non-null ids whose latest row has the wanted status.

    The order of the two ids doesn't matter. A null time is earlier than any other; at equal times the larger status
    holds. Case and outer white space of the status are ignored.
    """
    clean = F.lower(F.regexp_replace(status, r"(?U)^\s+|\s+$", ""))
    x, y = F.col(a).cast("string"), F.col(b).cast("string")
    return (
        rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        .agg(F.max(F.struct(F.col(time_col).alias("t"), clean.alias("s"))).alias("last"))
        .where(F.col("last.s") == wanted)
        .select("a", "b")
    )


def groups(links: DataFrame, least: int | None = None) -> DataFrame:
    """``(id, group_id)`` of every id that stands in ``links(a, b)``; group_id is the smallest id of its component.

    In each round a vertex tells all its neighbours the smallest id of its neighbourhood. A vertex that nobody names
    so drops out and hangs below the smallest id that it was told; the ids that a vertex was told are linked to
    the smallest of them and make the graph of the next round. Rounds are logarithmic in practice as each one drops
    every vertex that is no local minimum. At last, seeds are what never dropped out, and their ids flow down the
    forest, last dropped first. Repeated and self links don't matter; an empty input gives an empty result.
    """
    x, y = F.col("a"), F.col("b")
    edges = durable(
        links.where("a is not null and b is not null and a <> b")
        .select(F.explode(F.array(F.struct(x.alias("u"), y.alias("v")), F.struct(y.alias("u"), x.alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .distinct()
    )
    everyone, layers, rows = edges.select(F.col("u").alias("id")).distinct(), [], edges.count()
    while rows:
        low = durable(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        told = lookup_join(edges, low, "u", rows=rows, least=least).select(F.col("v").alias("w"), F.col("m").alias("t"))
        told = durable(told.unionByName(low.select(F.col("u").alias("w"), F.col("m").alias("t"))).distinct())
        best = durable(told.groupBy("w").agg(F.min("t").alias("best"), F.max(F.col("t") == F.col("w")).alias("named")))
        layers.append(best.where("not named").select(F.col("w").alias("id"), F.col("best").alias("parent")))
        kept = lookup_join(told, best.select("w", "best"), "w", rows=2 * rows, least=least).where("t <> best")
        edges = durable(
            kept.select(F.explode(F.array(F.struct(F.col("t").alias("u"), F.col("best").alias("v")), F.struct(F.col("best").alias("u"), F.col("t").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .distinct()
        )
        rows = edges.count()
    if not layers:
        return everyone.select("id", F.col("id").alias("group_id"))
    dropped = reduce(DataFrame.unionByName, layers).select("id")
    labelled = [durable(everyone.join(dropped, "id", "left_anti").select("id", F.col("id").alias("group_id")))]
    for layer in reversed(layers):
        above = reduce(DataFrame.unionByName, labelled).withColumnRenamed("id", "parent")
        labelled.append(durable(lookup_join(layer, above, "parent", least=least).select("id", "group_id")))
    return reduce(DataFrame.unionByName, labelled)
