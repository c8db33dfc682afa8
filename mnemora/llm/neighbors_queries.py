"""Problem 5 over vec_entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm import neighbors
from mnemora.runtime import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.pairs(neighbors.nearest(table(spark, sf_dir, "vec_entries")))


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the 10 nearest of the ids divisible by 100, by an exact search against all, ``nearest`` finds."""
    rows = table(spark, sf_dir, "vec_entries")
    number = F.expr("try_cast(substring_index(id, ':', -1) as bigint)")
    return neighbors.recall(rows, rows.where(number % 100 == 0).select("id"))


QUERIES = {"p5_found": p5_found, "p5_recall": p5_recall}

SQL: dict[str, str] = {}
