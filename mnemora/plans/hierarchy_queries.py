"""Queries on community hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators import hierarchy
from mnemora.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hierarchy.resolve(hierarchy.latest_parents(table(spark, sf_dir, "communities")))
    return tree.select("id", "root_id", F.col("depth").cast("int").alias("depth"), F.array_join("path", "/").alias("path"))


def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve(hierarchy.latest_parents(table(spark, sf_dir, "communities"))))


_LATEST = """with recursive latest as (
  select id, nullif(max(row(coalesce(updated_at, ''), coalesce(parent_id, '')))[2], '') parent from communities where id is not null group by id),
linked as (select l.id, case when p.id is null then null else l.parent end parent from latest l left join latest p on l.parent = p.id),
tree as (
  select id, id root_id, 0 depth, id as path from linked where parent is null
  union all
  select l.id, t.root_id, t.depth + 1, t.path || '/' || l.id from linked l join tree t on l.parent = t.id)"""

QUERIES = {"p2_found": p2_found, "p2_descendants": p2_descendants}

SQL = {
    "p2_found": _LATEST
    + """,
stuck as (select id, parent from linked where id not in (select id from tree)),
reach as (select id, parent spot from stuck union select r.id, s.parent from reach r join stuck s on r.spot = s.id),
circle as (select id from reach where id = spot)
select id, root_id, depth::integer depth, path from tree
union all
select r.id, min(r.spot), -1, '' from reach r join circle c on r.spot = c.id group by r.id""",
    "p2_descendants": _LATEST
    + """,
below as (
  select parent id, id descendant_id, 1 distance from linked where parent is not null and id in (select id from tree)
  union all
  select l.parent, b.descendant_id, b.distance + 1 from below b join linked l on b.id = l.id where l.parent is not null)
select id, descendant_id, distance::integer distance from below""",
}
