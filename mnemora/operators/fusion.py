"""Ranked lists fused by weighted reciprocal rank, and the search facade's shaping of the result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
WEIGHTS = {"bm25": 0.7, "vector": 0.3, "graph": 0.2}
#: Tag boost a match and at most, recency boost at age 0 and half-life in days.
TAG_BOOST, TAG_MOST, RECENCY_BOOST, HALF_LIFE = 0.03, 0.15, 0.05, 14.0


def ranked_list(rows: DataFrame, channel: str, order: int = 0, doc: str = "id", chunk: str | None = None) -> DataFrame:
    """One list for fuse() of rows with ``rank``; ``order`` is the list's place among the lists."""
    of = F.col(chunk) if chunk else F.lit(None).cast("string")
    return rows.select(F.lit(channel).alias("channel"), F.lit(order).alias("list"), F.col(doc).alias("doc_id"), of.alias("chunk_id"), F.col("rank").cast("int").alias("rank"))


def fuse(lists: list[DataFrame], weights: dict[str, float] = WEIGHTS, limit: int | None = None) -> DataFrame:
    """``(doc_id, score, chunk_id, bm25_rank, vector_rank, graph_rank, rank)`` by the sum of weight / (60 + rank) over lists.

    A document counts once a list, at its best rank. Its chunk is the best ranked over all lists, the first list's on
    ties. Best ranks are kept by channel. Ties by id.
    """
    rows = reduce(DataFrame.unionByName, lists)
    best = rows.groupBy("channel", "list", "doc_id").agg(F.min_by("chunk_id", "rank").alias("chunk_id"), F.min("rank").alias("rank"))
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("channel"))
    of = lambda c: F.min(F.when(F.col("channel") == c, F.col("rank"))).alias(f"{c}_rank")
    chunk = F.min_by("chunk_id", F.when(F.col("chunk_id").isNotNull(), F.struct("rank", "list"))).alias("chunk_id")
    score = F.round(F.sum(F.round(weight / (RRF_K + F.col("rank")), 15)), 9).alias("score")
    fused = best.groupBy("doc_id").agg(score, chunk, *(of(c) for c in ("bm25", "vector", "graph")))
    top = fused.orderBy(F.desc("score"), "doc_id")
    top = top.limit(limit) if limit else top
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))  # ranked lists are short


def min_max(rows: DataFrame, score: str = "score") -> DataFrame:
    """Scores from 0 to 1; all 1 where they are equal."""
    low, high = rows.agg(F.min(score), F.max(score)).first()
    if low is None or low == high:
        return rows.withColumn(score, F.lit(1.0))
    return rows.withColumn(score, (F.col(score) - F.lit(low)) / F.lit(high - low))


def matches(tags: Column, wanted: list[str], fold: bool = False) -> Column:
    """How many of the wanted tags a comma-joined list has, exactly or without case."""
    have = F.transform(F.split(tags, ","), lambda t: F.lower(F.trim(t)) if fold else F.trim(t))
    return F.size(F.array_intersect(have, F.array(*(F.lit(w.lower() if fold else w) for w in wanted)))) if wanted else F.lit(0)


def recency(date: Column, now: int) -> Column:
    """Boost by age in days; none without a date or before it."""
    days = (F.lit(now) - date) / 86400.0
    return F.when(date.isNotNull() & (days >= 0), RECENCY_BOOST * F.pow(F.lit(2.0), -days / HALF_LIFE)).otherwise(0.0)


def shape(fused: DataFrame, entries: DataFrame, dates: DataFrame, now: int, limit: int, require: list[str] | None = None, boost: list[str] | None = None, keep: Column | None = None) -> DataFrame:
    """The facade's result: scores from 0 to 1 over the whole pool, then the hard tag filter, boosts, order, predicate, limit.

    A kept row's score hence depends on dropped rows. ``require`` and ``boost`` match tags exactly.
    """
    pool = min_max(fused.select("doc_id", "score"))
    rows = pool.join(entries.select(F.col("id").alias("doc_id"), "tags"), "doc_id", "left").join(dates.select(F.col("id").alias("doc_id"), "source_date"), "doc_id", "left")
    if require:
        rows = rows.where(matches(F.col("tags"), require) == len(set(require)))
    boosted = F.col("score") + F.least(F.lit(TAG_MOST), TAG_BOOST * matches(F.coalesce("tags", F.lit("")), boost or [])) + recency(F.col("source_date"), now)
    rows = rows.withColumn("score", F.round(boosted, 9))
    if keep is not None:
        rows = rows.where(keep)
    top = rows.orderBy(F.desc("score"), "doc_id").limit(limit)
    return top.select("doc_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"))


CHANNELS = ("bm25", "vector", "graph")


def chosen(channels: list[str] | None) -> list[str]:
    """The channels to run, in their order; all without a choice. An unknown name is an error."""
    if unknown := sorted(set(channels or ()) - set(CHANNELS)):
        raise ValueError(f"unknown channels: {', '.join(unknown)}")
    return [c for c in CHANNELS if c in channels] if channels else list(CHANNELS)


def run(legs: dict[str, list], entries: DataFrame, dates: DataFrame, now: int, limit: int, channels: list[str] | None = None, **how) -> tuple[DataFrame, list[str]]:
    """The facade: the fused lists of the chosen channels, shaped, and the channels that ran.

    ``legs`` has for each channel functions of a list length that each give ``(id, rank)``, and perhaps chunk_id; only those of
    chosen channels are called, and a channel without any doesn't count as run. The pool is ``limit``, or three times that with any filter, boost or
    predicate in ``how``, see ``shape``.
    """
    pool = limit * 3 if any(v is not None and v != [] for v in how.values()) else limit
    ran = [c for c in chosen(channels) if legs.get(c)]
    lists = []
    for c in ran:
        for leg in legs[c]:
            rows = leg(pool)
            lists.append(ranked_list(rows, c, len(lists), "id", "chunk_id" if "chunk_id" in rows.columns else None))
    if not lists:
        return entries.select(F.col("id").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False)), ran
    return shape(fuse(lists, limit=pool), entries, dates, now, limit, **how), ran


def variants(query: str, expand=None) -> list[tuple[str, str]]:
    """``(kind, text)``: the query and what ``expand(query)`` adds to it, lexical, vector and hypothetical texts; the query alone where it fails.

    Repeats of the query and empty texts are left out. A stop by the user isn't taken for a failure.
    """
    rows = [("original", query)]
    if expand is not None:
        try:
            more = expand(query) or {}
        except Exception:  # a provider's failure costs the variants, not the search
            more = {}
        rows += [(kind, t) for kind in ("lex", "vec", "hyde") for t in more.get(kind, []) if t and t.strip() and t != query]
    return rows


def legacy(text: DataFrame, vector: DataFrame, entries: DataFrame, dates: DataFrame, now: int, limit: int, boost: list[str] | None = None) -> DataFrame:
    """The older fusion: equal weights, boosts on the raw sum, tags without case."""
    rows = text.select("id", F.col("rank").alias("a")).join(vector.select("id", F.col("rank").alias("b")), "id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    rows = rows.join(entries.select("id", "tags"), "id", "left").join(dates, "id", "left")
    score = part("a") + part("b") + F.least(F.lit(TAG_MOST), TAG_BOOST * matches(F.coalesce("tags", F.lit("")), boost or [], True)) + recency(F.col("source_date"), now)
    return rows.select("id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def blend(candidates: DataFrame, scored: DataFrame) -> DataFrame:
    """Retrieval and rerank scores mixed by rank: 0.75 to 0.25 up to rank 3, 0.6 to 0.4 up to 10, else 0.4 to 0.6.

    Only if at least half of the candidates were scored, else retrieval's alone; one without a rerank score keeps its own.
    Both are scaled from 0 to 1 first.
    """
    base = min_max(candidates.select("doc_id", "rank", "score"))
    n, m = candidates.count(), scored.count()
    if not n or m / n < 0.5:
        return base.select("doc_id", F.round("score", 9).alias("score"))
    own = F.when(F.col("rank") <= 3, 0.75).when(F.col("rank") <= 10, 0.6).otherwise(0.4)
    both = base.join(min_max(scored.select("doc_id", F.col("score").alias("rerank")), "rerank"), "doc_id", "left")
    return both.select("doc_id", F.round(F.when(F.col("rerank").isNull(), F.col("score")).otherwise(own * F.col("score") + (1 - own) * F.col("rerank")), 9).alias("score"))


def federated(projects: dict[str, DataFrame], limit: int) -> DataFrame:
    """Results of several projects by their own scores, which aren't ranked anew."""
    rows = reduce(DataFrame.unionByName, (df.select(F.lit(p).alias("project"), "doc_id", "score") for p, df in projects.items()))
    return rows.orderBy(F.desc("score"), "project", "doc_id").limit(limit)


def trusted(rows: DataFrame, confirmed: DataFrame, include: bool | None) -> DataFrame:
    """Rows but for outputs: these stay if ``include`` is true, or, if it is null, when they are confirmed."""
    is_output = F.startswith("doc_id", F.lit("output:"))
    if include:
        return rows
    if include is False:
        return rows.where(~is_output)
    return rows.where(~is_output).unionByName(rows.where(is_output).join(confirmed.select("doc_id").distinct(), "doc_id", "left_semi"))


def longest_within(docs: DataFrame, key: str, doc: str, size: str, tokens: Column, budget: int) -> DataFrame:
    """``(key, doc, rank, tokens, spent)``: for each key its longest documents, ties by id, until one would exceed the budget.

    ``tokens`` is an expression of ``size``, so that all documents of one size cost alike: sizes are added up first, and only
    documents of sizes that fit are ranked, each within its size.
    """
    sizes = docs.groupBy(key, size).agg(F.count("*").alias("n_of")).withColumn("tokens", tokens.cast("long"))
    before = Window.partitionBy(key).orderBy(F.desc(size)).rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.withColumn("spent_before", F.coalesce(F.sum(F.col("n_of") * F.col("tokens")).over(before), F.lit(0))).withColumn("rank_before", F.coalesce(F.sum("n_of").over(before), F.lit(0)))
    room = F.when(F.col("tokens") == 0, F.col("n_of")).otherwise(F.floor((F.lit(budget) - F.col("spent_before")) / F.col("tokens")))
    kept = sums.withColumn("kept", F.greatest(F.lit(0), F.least("n_of", room))).withColumn("cut", F.coalesce(F.max((F.col("kept") < F.col("n_of")).cast("int")).over(before), F.lit(0)))
    kept = kept.where("cut = 0 and kept > 0").select(key, size, "tokens", "spent_before", "rank_before", "kept")
    at = F.row_number().over(Window.partitionBy(key, size).orderBy(doc))
    rows = docs.join(kept, [key, size]).withColumn("at", at).where("at <= kept")
    return rows.select(key, doc, (F.col("rank_before") + F.col("at")).cast("int").alias("rank"), "tokens", (F.col("spent_before") + F.col("at") * F.col("tokens")).alias("spent"))


def within_budget(rows: DataFrame, order: str, tokens: str, budget: int) -> DataFrame:
    """The first rows until one would exceed the budget, where it ends. For one ranked list, which is short."""
    running = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    spent = rows.withColumn("spent", F.sum(tokens).over(running))
    return spent.withColumn("over", F.max((F.col("spent") > budget).cast("int")).over(running)).where("over = 0").drop("over")
