"""Problem 1 over longmemeval_full, with languages named by documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm import pairs
from mnemora.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.broken(table(spark, sf_dir, "longmemeval_full"), table(spark, sf_dir, "documents").select("lang", "text"))


def p1_by_defect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions have each defect."""
    return p1_found(spark, sf_dir).groupBy("defect").agg(F.count("*").alias("n_questions"))


QUERIES = {"p1_found": p1_found, "p1_by_defect": p1_by_defect}

SQL: dict[str, str] = {}
