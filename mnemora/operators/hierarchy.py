"""Parent-child rows to full hierarchies by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.runtime import durable, lookup_join


def latest_parents(rows: DataFrame, id_col: str = "id", parent_col: str = "parent_id", time_col: str = "updated_at") -> DataFrame:
    """One row ``(id, parent)`` per distinct non-null id: of several rows the one with the latest time holds.

    A null time is earlier than any other; at equal times the larger parent holds, so that the result is defined.
    An empty parent is null.
    """
    last = F.max(F.struct(F.col(time_col).alias("t"), F.col(parent_col).cast("string").alias("p")))
    return (
        rows.where(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("string").alias("id"))
        .agg(last.alias("last"))
        .select("id", F.expr("nullif(last.p, '')").alias("parent"))
    )


def resolve(links: DataFrame, least: int | None = None) -> DataFrame:
    """``(id, root_id, depth, path array)`` of every id of ``links(id, parent)``, in which ids are unique.

    A null or unknown parent makes a root. Each round joins the pointers of unresolved ids to the pointers that these
    point to, which doubles the jump and joins the path segments; a forest of depth d needs log2(d) rounds. A
    round that resolves nothing proves that only circles, and what leads into them, remain: within 2^k steps of a
    root some id is resolved in every round k. Such ids have depth -1, an empty path, and as root the smallest id of
    their circle. An empty input gives an empty result.
    """
    links = durable(links)
    known = links.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    first = lookup_join(links, known, "parent", "left", least=least).select(
        "id",
        F.when(F.col("known"), F.col("parent")).otherwise(F.col("id")).alias("anc"),
        F.array("id").alias("path"),
        F.coalesce(~F.col("known"), F.lit(True)).alias("done"),
    )
    first = durable(first)
    done, rest = [first.where("done")], first.where("not done")
    left = rest.count()
    while left:
        state = reduce(DataFrame.unionByName, [*done, rest]).select(
            F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("path").alias("above"), F.col("done").alias("ends")
        )
        jumped = lookup_join(rest.drop("done"), state, "anc", rows=left, least=least).select(
            "id", F.col("next").alias("anc"), F.concat("above", "path").alias("path"), F.col("ends").alias("done")
        )
        jumped = durable(jumped)
        done.append(jumped.where("done"))
        now = jumped.where("not done").count()
        if now == left:
            break
        rest, left = jumped.where("not done"), now
    trees = reduce(DataFrame.unionByName, done).select(
        "id", F.col("anc").alias("root_id"), (F.size("path") - 1).alias("depth"), "path"
    )
    if not left:
        return trees
    stuck = _circles(durable(rest.select("id").join(links, "id").select("id", F.col("parent").alias("anc"))), left, least)
    return trees.unionByName(stuck.select("id", "root_id", F.lit(-1).alias("depth"), F.array().cast("array<string>").alias("path")))


def _circles(links: DataFrame, rows: int, least: int | None) -> DataFrame:
    """``(id, root_id)`` for ids none of which ever reaches a root: root_id is the smallest id of the circle reached.

    After k doublings a pointer is 2^k steps ahead and ``low`` the smallest of the 2^k ids from its own on. Once the
    number of distinct pointers stays the same these are exactly the ids on circles, and once ``low`` stays the same
    everywhere on them it is the circle's smallest.
    """
    state, ends = durable(links.withColumn("low", F.col("id"))), -1
    while True:
        ahead = state.select(F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("low").alias("lower"))
        step = lookup_join(state, ahead, "anc", rows=rows, least=least).select(
            "id", F.col("next").alias("anc"), F.least("low", "lower").alias("low"), (F.col("lower") < F.col("low")).alias("moved")
        )
        step = durable(step)
        now, moved = step.agg(F.countDistinct("anc"), F.max("moved")).first()
        state = step.drop("moved")
        if now == ends and not moved:
            break
        ends = now
    on_circle = state.select(F.col("id").alias("anc"), F.col("low").alias("root_id"))
    return lookup_join(state.drop("low"), on_circle, "anc", rows=rows, least=least).select("id", "root_id")


def descendants(tree: DataFrame) -> DataFrame:
    """``(id, descendant_id, distance)``: every id of a tree with each id below it. Ids on circles have none."""
    return tree.select(F.col("id").alias("descendant_id"), "depth", F.posexplode("path").alias("at", "id")).where(
        "at < depth"
    ).select("id", "descendant_id", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
