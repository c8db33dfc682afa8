"""BM25 retrieval with prefix terms and weighted columns."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from mnemora.functions.text import words
from mnemora.runtime import durable

#: Weights of the columns of entries and of chunks.
ENTRY_WEIGHTS = {"id": 3.0, "content": 1.0, "tags": 1.5, "article_path": 3.0}
CHUNK_WEIGHTS = {"heading": 1.0, "content": 1.0}
K1, B, IDF_LEAST = 1.2, 0.75, 1e-6


def _hits(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda w: F.startswith(w, F.lit(term))))


def counted(docs: DataFrame, key: str, weights: dict[str, float], terms: list[str]) -> DataFrame:
    """``(key, length, tf)``: words of all columns together, and for each term its weighted count of words that start with it."""
    # words in a projection of their own, so that each text is taken apart once however many terms look at it
    split = docs.select(key, *(words(F.coalesce(c, F.lit(""))).alias(f"w{i}") for i, c in enumerate(weights)))
    tokens = [(F.col(f"w{i}"), w) for i, w in enumerate(weights.values())]
    length = sum((F.size(t) for t, _ in tokens), F.lit(0))
    tf = F.array(*(sum((_hits(t, term) * w for t, w in tokens), F.lit(0.0)) for term in terms))
    return split.select(key, length.alias("length"), tf.alias("tf"))


def bm25(docs: DataFrame, key: str, weights: dict[str, float], terms: list[str]) -> DataFrame:
    """``(key, score)`` of all documents that hold a word with one of the prefixes ``terms``, which must be distinct.

    One scan and no shuffle of documents: what has a hit is written, and while that runs the number of documents, their mean
    length and each term's document frequency are observed. Null columns have no words. No terms, or no documents, give an
    empty result. Many queries cost less by ``index``.
    """
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    rows = counted(docs, key, weights, terms)
    seen = Observation()
    measures = [F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *(F.sum((F.col("tf")[i] > 0).cast("long")).alias(f"d{i}") for i in range(len(terms)))]
    rows = durable(rows.observe(seen, *measures).where(F.exists("tf", lambda x: x > 0)))
    n, mean = seen.get["n"], seen.get["mean"]
    df = [seen.get[f"d{i}"] or 0 for i in range(len(terms))]
    idf = [max(log((n - d + 0.5) / (d + 0.5)), IDF_LEAST) for d in df]
    norm = K1 * (1 - B + B * F.col("length") / F.lit(float(mean or 1.0)))
    parts = (F.lit(w) * F.col("tf")[i] * (K1 + 1) / (F.col("tf")[i] + norm) for i, w in enumerate(idf))
    return rows.select(key, sum(parts, F.lit(0.0)).alias("score"))


@dataclass
class Index:
    """Words ``(doc, w0, w1, ...)`` of the documents' columns, ``(doc, key)``, how many there are, their mean length, and the columns' weights.

    Numbers ``doc`` ascend with the keys.
    """

    words: DataFrame
    keys: DataFrame
    documents: int
    mean: float
    weights: list[float]


def index(docs: DataFrame, key: str, weights: dict[str, float]) -> Index:
    """Takes every text apart once, for any number of queries."""
    ordered = docs.select(F.col(key).cast("string").alias("key"), *(F.coalesce(c, F.lit("")).alias(f"w{i}") for i, c in enumerate(weights)))
    taken = ordered.orderBy("key").withColumn("doc", F.monotonically_increasing_id())
    split = durable(taken.select("doc", "key", *(words(F.col(f"w{i}")).alias(f"w{i}") for i in range(len(weights)))))
    length = sum((F.size(f"w{i}") for i in range(len(weights))), F.lit(0))
    n, mean = split.agg(F.count("*"), F.avg(length)).first()
    return Index(split.drop("key"), split.select("doc", "key"), n, float(mean or 1.0), [float(w) for w in weights.values()])


#: Documents that are looked at together.
BLOCK = 8192


class _Block:
    """Weighted counts of prefixes in some documents, by prefix: ``doc`` (places in ``docs``) and ``tf`` from ``ends[t]`` to ``ends[t + 1]``."""

    def __init__(self, batch: pa.RecordBatch, weights: list[float], terms: list[str]):
        """``terms`` ascend."""
        self.docs = batch.column(0).to_numpy()
        self.length = np.zeros(len(self.docs))
        words, docs, worth = [], [], []
        for column, w in zip(batch.columns[1:], weights):
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            self.length += sizes
            words.append(column.flatten())
            docs.append(np.repeat(np.arange(len(sizes)), sizes))
            worth.append(np.full(len(docs[-1]), w))
        coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
        listed = coded.dictionary.to_pylist()
        order = sorted(range(len(listed)), key=listed.__getitem__)
        place = np.empty(len(listed), np.int64)
        place[order] = np.arange(len(listed))
        word, doc, worth = place[coded.indices.to_numpy()], np.concatenate(docs), np.concatenate(worth)
        n = len(self.docs)
        posts, at = np.unique(word * n + doc, return_inverse=True)
        tf = np.bincount(at, worth, len(posts))
        starts = np.searchsorted(posts, np.arange(len(listed) + 1) * n)
        vocabulary = [listed[i] for i in order]
        found, sums, ends = [], [], [0]
        for t in terms:
            i = bisect_left(vocabulary, t)
            j = i
            while j < len(vocabulary) and vocabulary[j].startswith(t):
                j += 1
            d, x = posts[starts[i] : starts[j]] % n, tf[starts[i] : starts[j]]
            if j > i + 1:
                d, at = np.unique(d, return_inverse=True)
                x = np.bincount(at, x, len(d))
            found.append(d)
            sums.append(x)
            ends.append(ends[-1] + len(d))
        self.doc, self.tf, self.ends = np.concatenate(found), np.concatenate(sums), ends

    def best(self, parts: np.ndarray, terms: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and sums of the ``limit`` best documents for some terms, by the rounded sum, then place."""
        spans = [(self.ends[t], self.ends[t + 1]) for t in terms]
        if not any(b > a for a, b in spans):
            return np.zeros(0, np.int64), np.zeros(0)
        docs = np.concatenate([self.doc[a:b] for a, b in spans])
        scores = np.bincount(docs, np.concatenate([parts[a:b] for a, b in spans]))
        top = docs if len(docs) <= limit else np.arange(len(scores))
        if len(scores) > limit:
            least = np.partition(scores, -limit)[-limit]
            top = np.nonzero(scores >= least - 2e-9)[0]
        top = np.unique(top)
        top = top[scores[top] > 0]
        top = top[np.lexsort((top, -np.round(scores[top], 9)))[:limit]]
        return top, scores[top]


def search(found: Index, queries: DataFrame, limit: int) -> DataFrame:
    """``(query, key, score, rank)``: the ``limit`` best documents of each of the queries ``(query, term)``, by the score of ``bm25``.

    Terms are prefixes of words, repeats count once. The set of queries is stated: their terms go to every task. One scan counts the
    documents of each term, another scores blocks of documents for each distinct set of terms and hands on ``limit`` documents of a block.
    """
    told = queries.where("term is not null and term <> ''").select("query", "term").distinct()
    names = durable(told.groupBy("query").agg(F.array_sort(F.collect_list("term")).alias("terms")))  # the words of one query
    sets = durable(names.select("terms").distinct().withColumn("q", F.monotonically_increasing_id()))
    asked = sets.collect()
    if not asked or not found.documents:
        return names.select("query", F.lit("").alias("key"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    spark = queries.sparkSession
    terms = sorted({t for r in asked for t in r.terms})
    at = {t: i for i, t in enumerate(terms)}
    weights = found.weights
    known = spark.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known.value), np.int64)
        for block in _blocks(batches):
            total += np.diff(_Block(block, weights, known.value).ends)
        held = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    df = np.zeros(len(terms), np.int64)
    for r in found.words.mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df
    idf = np.array([max(log((found.documents - d + 0.5) / (d + 0.5)), IDF_LEAST) for d in df.tolist()])
    stated = spark.sparkContext.broadcast((idf, [r.q for r in asked], [np.array([at[t] for t in r.terms]) for r in asked]))
    mean = found.mean

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, numbers, sets = stated.value
        for block in map(lambda b: _Block(b, weights, known.value), _blocks(batches)):
            norm = K1 * (1 - B + B * block.length / mean)
            parts = np.repeat(idf, np.diff(block.ends)) * block.tf * (K1 + 1) / (block.tf + norm[block.doc])
            for i in range(0, len(sets), 4096):
                best = [block.best(parts, x, limit) for x in sets[i : i + 4096]]
                q = np.repeat(np.array(numbers[i : i + 4096], np.int64), [len(d) for d, _ in best])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(block.docs[np.concatenate([d for d, _ in best])]), pa.array(np.concatenate([s for _, s in best]))], ["q", "doc", "score"])

    scored = found.words.mapInArrow(score, "q long, doc long, score double").withColumn("score", F.round("score", 9))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "doc")
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return top.join(found.keys, "doc").join(sets, "q").join(names, "terms").select("query", "key", "score", "rank")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows, BLOCK at a time or in as many as 64 MB have."""
    held, rows, size = [], 0, 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= BLOCK or size > 64_000_000:
            yield pa.concat_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.concat_batches(held)


def ranked(scored: DataFrame, key: str, limit: int, score: str = "score", digits: int = 9) -> DataFrame:
    """The ``limit`` best rows with their rank from 1; ties by key. Scores are rounded so that ties are ties."""
    top = scored.withColumn(score, F.round(score, digits)).orderBy(F.desc(score), key).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))  # of at most ``limit`` rows


def tagged(entries: DataFrame, tags: list[str], column: str = "tags") -> DataFrame:
    """Entries whose comma-joined tags hold each of ``tags`` anywhere."""
    for t in tags:
        entries = entries.where(F.contains(column, F.lit(t)))
    return entries


def strong_signal(top: DataFrame, score: str = "score") -> DataFrame:
    """``(strong)`` of a list's best two scores: the first is at least 0.4 as s / (1 + s), and alone or at least twice the second."""
    norm = top.select((F.abs(score) / (1 + F.abs(score))).alias("s")).orderBy(F.desc("s")).limit(2)
    both = norm.agg(F.max("s").alias("a"), F.min("s").alias("b"), F.count("*").alias("n"))
    return both.select(F.coalesce((F.col("a") >= 0.4) & ((F.col("n") == 1) | (F.col("a") >= 2 * F.col("b"))), F.lit(False)).alias("strong"))


def recall_learnings(learnings: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Newest rows that hold the query in content or tags."""
    hit = F.contains("content", F.lit(query)) | F.contains("tags", F.lit(query))
    return learnings.where(F.coalesce(hit, F.lit(False))).orderBy(F.desc("created_at"), "id").limit(limit)
