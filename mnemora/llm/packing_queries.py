"""Problem 7 over documents, measured in tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm import packing, tokens
from mnemora.runtime import table

CAPACITY = 2048


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of each document, or of each piece of one over the capacity."""
    return packing.pack(tokens.count(table(spark, sf_dir, "documents")), "doc_id", "tokens", CAPACITY)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers there are by per cent of their capacity in use; and of all, how many at least no packing can do without."""
    rows, plan = packing.planned(tokens.count(table(spark, sf_dir, "documents")), "doc_id", "tokens", CAPACITY)
    used = rows.groupBy("container").agg(F.sum("size").alias("used"))
    by = used.groupBy(F.floor(F.col("used") * 100 / CAPACITY).cast("int").alias("percent")).agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    return by.withColumn("all_containers", F.lit(plan.containers)).withColumn("bound", F.lit(plan.bound))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}

SQL: dict[str, str] = {}
