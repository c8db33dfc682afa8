"""Problem 6 over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm import tokens
from mnemora.runtime import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p6_tokens_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and characters per spelled language of the whole corpus."""
    docs = table(spark, sf_dir, "documents")
    sized = tokens.count(docs.select(F.struct("lang", F.length("text").alias("chars")).alias("of"), "text"), "of", "text")
    return sized.groupBy(F.col("of.lang").alias("lang")).agg(
        F.count("*").alias("docs"), F.sum("tokens").alias("tokens"), F.sum("of.chars").alias("chars")
    )


QUERIES = {"p6_ids": p6_ids, "p6_tokens_by_lang": p6_tokens_by_lang}

SQL: dict[str, str] = {}
