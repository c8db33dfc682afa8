"""Problem 4 over entity_aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm import components
from mnemora.runtime import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.groups(components.applied_links(table(spark, sf_dir, "entity_aliases")))


def p4_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups there are of each size."""
    return p4_found(spark, sf_dir).groupBy("group_id").agg(F.count("*").alias("members")).groupBy("members").agg(F.count("*").alias("n_groups"))


_FOUND = """with recursive pairs as (
  select least(alias, canonical_id) a, greatest(alias, canonical_id) b,
         max(row(coalesce(decided_at, ''), lower(trim(status))))[2] status
  from entity_aliases where alias is not null and canonical_id is not null and alias <> canonical_id group by 1, 2),
links as (select a, b from pairs where status = 'applied' union select b, a from pairs where status = 'applied'),
reach as (select a id, a other from links union select r.id, l.b from reach r join links l on r.other = l.a),
found as (select id, min(other) group_id from reach group by id)"""

QUERIES = {"p4_found": p4_found, "p4_group_sizes": p4_group_sizes}

SQL = {
    "p4_found": _FOUND + " select id, group_id from found",
    "p4_group_sizes": _FOUND + " select members, count(*) n_groups from (select count(*) members from found group by group_id) group by members",
}
