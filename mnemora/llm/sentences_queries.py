"""Problem 8 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemora.llm import sentences
from mnemora.runtime import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(table(spark, sf_dir, "documents"))


QUERIES = {"p8_found": p8_found}

SQL: dict[str, str] = {}
