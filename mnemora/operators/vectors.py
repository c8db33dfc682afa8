"""Vector retrieval by exact cosine, filters, quantisation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.runtime import durable


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Length 1; a zero vector stays zero, null stays null."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of other lengths, empty or zero ones."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)


def cosine_to(rows: DataFrame, key: str, query: list[float], column: str = "embedding") -> DataFrame:
    """``(key, score)`` of all rows of the query's width; none for an empty or zero query."""
    length = sqrt(sum(x * x for x in query))
    if not length:
        return rows.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    q = F.array(*(F.lit(float(x) / length) for x in query))
    n = norm(F.col(column))
    score = F.when(n == 0, F.lit(0.0)).otherwise(dot(F.col(column), q) / n)
    return rows.where(F.size(column) == len(query)).select(key, score.alias("score"))


def chunks_to(rows: DataFrame, query: list[float], limit: int = 20, column: str = "embedding") -> DataFrame:
    """``(doc_id, chunk_id, score, rank)``: the ``limit`` chunks ``(chunk_id, doc_id, vector)`` most similar to the query, ties by chunk."""
    from mnemora.operators.lexical import ranked

    top = ranked(cosine_to(rows.select("chunk_id", column), "chunk_id", query, column), "chunk_id", limit)
    return top.join(rows.select("chunk_id", "doc_id"), "chunk_id").select("doc_id", "chunk_id", "score", "rank")


def similar_question(asked: DataFrame, outputs: DataFrame, least: float = 0.9) -> DataFrame:
    """``(question, output, score)``: for each of a stated set of questions ``(question, embedding)`` the most similar pending or confirmed
    output of ``(output, state, embedding)`` if its cosine is at least ``least``; ties to the smaller output."""
    open_ = outputs.where("state in ('pending', 'confirmed')")
    rows = open_.select(F.col("output").alias("id"), "embedding")
    found = queries_against_all(asked.select(F.concat(F.lit("?"), F.col("question")).alias("id"), "embedding"), rows, "id", least)
    found = found.withColumn("score", F.round("score", 9))
    best = found.groupBy("a").agg(F.max(F.struct("score")).alias("m"), F.min_by("b", F.struct((-F.col("score")).alias("s"), "b")).alias("output"))
    return best.select(F.substring("a", 2, 1_000_000).alias("question"), "output", F.col("m.score").alias("score"))


def filtered(rows: DataFrame, docs: DataFrame, doc_col: str = "doc_id", most: int = 100) -> DataFrame:
    """Rows of the first ``most`` documents of a filter, by id; an empty filter gives none."""
    return rows.join(F.broadcast(docs.select(doc_col).distinct().orderBy(doc_col).limit(most)), doc_col, "left_semi")


def quantized(rows: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """``(key, codes array<int>, scale)``: normalised numbers as steps of one scale for all rows, which is their largest magnitude over 127."""
    unit = rows.select(key, normalized(F.col(column)).alias("v"))
    top = unit.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 1.0
    scale = top / 127
    return unit.select(key, F.transform("v", lambda x: F.round(x / F.lit(scale)).cast("int")).alias("codes"), F.lit(scale).alias("scale"))


def queries_against_all(queries: DataFrame, rows: DataFrame, key: str, least: float, column: str = "embedding", block: int = 4096) -> DataFrame:
    """``(a, b, score)`` with cosine of at least ``least`` between a stated set of queries and all other rows of the same width.

    Queries are held in blocks of about ``block`` vectors, by hash; each scan of the rows is a matrix product of a block with
    batches of rows. Null vectors, and such with nulls, match nothing; zero vectors have cosine 0 to all.
    """
    spark = queries.sparkSession
    asked = durable(queries.where(F.col(column).isNotNull()).select(F.col(key).cast("string").alias("a"), F.col(column).cast("array<double>").alias("q")))
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)))
    narrow = rows.where(F.col(column).isNotNull()).select(F.col(key).cast("string").alias("b"), F.col(column).cast("array<double>").alias("v"))

    def scanned(i: int) -> DataFrame:
        stated: dict[int, tuple[list, list]] = {}
        for r in asked.where(F.col("block") == i).select("a", "q").collect():  # about ``block`` vectors
            if None not in r.q:
                names, x = stated.setdefault(len(r.q), ([], []))
                names.append(r.a)
                x.append(r.q)
        shared = spark.sparkContext.broadcast({w: (np.array(names, object), _units(np.array(x))) for w, (names, x) in stated.items() if w})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
                for width, (names, x) in shared.value.items():
                    at = np.nonzero(sizes == width)[0]
                    for k in range(0, len(at), 1024):
                        part = b.take(pa.array(at[k : k + 1024]))
                        y = _units(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
                        ids = np.array(part.column(0).to_pylist(), object)
                        scores = x @ y.T
                        q, r = np.nonzero(scores >= least)
                        other = names[q] != ids[r]
                        q, r = q[other], r[other]
                        yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.string()), pa.array(ids[r], pa.string()), pa.array(scores[q, r])], ["a", "b", "score"])

        return narrow.mapInArrow(run, "a string, b string, score double")

    return reduce(DataFrame.unionByName, (scanned(i) for i in range(blocks)))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1.0, n)


def near_duplicates(pairs: DataFrame, never: Column) -> DataFrame:
    """For each ``a`` the most similar ``b`` that no rule forbids to merge; ties to the smaller b."""
    return pairs.where(~never).groupBy("a").agg(F.min_by(F.struct("b", "score"), F.struct((-F.col("score")).alias("s"), "b")).alias("m")).select("a", "m.b", "m.score")


def _tokens(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)))


def never_merge(a: Column, b: Column) -> Column:
    """Names that must not be merged: other words with digits, or draft against final, or primary against secondary."""
    x, y = _tokens(a), _tokens(b)
    digits = lambda t: F.sort_array(F.filter(t, lambda w: w.rlike("[0-9]")))
    has = F.array_contains
    veto = digits(x) != digits(y)
    for p, q in (("draft", "final"), ("primary", "secondary")):
        veto = veto | ((has(x, p) != has(y, p)) & (has(x, q) | has(y, q))) | ((has(x, q) != has(y, q)) & (has(x, p) | has(y, p)))
    return veto
