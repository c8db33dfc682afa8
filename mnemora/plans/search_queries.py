"""Queries on lexical, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import corpus, fusion, graph, lexical, vectors
from mnemora.plans import fixtures as X
from mnemora.plans.text_queries import TERMS_OF_QUESTIONS as _TERMS
from mnemora.runtime import table

#: The fixed query: prefix terms, and the embedding of vec_id 0.
TERMS = ["vector", "ledger", "snapshot", "rebuild"]
OTHER_TERMS = ["citation", "merge"]
LEG_TERMS = ["stale", "manifest", "ranked", "snapshot", "pinned", "embedding", "cache"]
TAGS = ["graph", "index"]
NOW = 1735689600


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The embedding of vec_id 0, or none, to which nothing is similar."""
    found = table(spark, sf_dir, "embeddings").where("vec_id = 0 and embedding is not null").select("embedding").first()
    return [float(x) for x in found[0]] if found else []


def _top_tags(spark: SparkSession, sf_dir: str) -> list[str]:
    tags = X.entries(spark, sf_dir).select(F.explode(F.split("tags", ",")).alias("t")).where("t <> ''")
    return [r[0] for r in tags.groupBy("t").count().orderBy(F.desc("count"), "t").limit(2).collect()]


def bm25_list(spark: SparkSession, sf_dir: str, terms: list[str] = TERMS, limit: int = 50) -> DataFrame:
    return lexical.ranked(lexical.bm25(X.entries(spark, sf_dir), "id", lexical.ENTRY_WEIGHTS, terms), "id", limit)


def bm25_doc_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_list(spark, sf_dir, limit=10)


def bm25_chunk_list(spark: SparkSession, sf_dir: str, limit: int = 50) -> DataFrame:
    c = X.chunks(spark, sf_dir)
    return lexical.ranked(lexical.bm25(c, "chunk_id", lexical.CHUNK_WEIGHTS, TERMS), "chunk_id", limit).join(c.select("chunk_id", "doc_id"), "chunk_id")


def bm25_chunk_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_chunk_list(spark, sf_dir, 20)


def strong_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.strong_signal(bm25_list(spark, sf_dir, limit=2))


def bm25_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of entries whose tags hold the most frequent tag."""
    kept = lexical.tagged(X.entries(spark, sf_dir), _top_tags(spark, sf_dir)[:1])
    return lexical.ranked(lexical.bm25(kept, "id", lexical.ENTRY_WEIGHTS, TERMS), "id", 10)


def count_uncompiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits on sources of a tier under 3."""
    hits = lexical.bm25(X.entries(spark, sf_dir), "id", lexical.ENTRY_WEIGHTS, TERMS[:1])
    paths = X.items(spark, sf_dir).where("tier < 3").select(F.concat(F.lit("src:"), F.regexp_extract("source_path", r"(\d+)", 1)).alias("id"))
    return hits.join(paths, "id").agg(F.count("*").alias("uncompiled"))


def learnings_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of communities that mention alias, as learnings."""
    c = table(spark, sf_dir, "communities").where("summary is not null").select(F.col("id"), F.col("summary").alias("content"), F.lit("").alias("tags"), F.col("updated_at").alias("created_at")).distinct()
    return lexical.recall_learnings(c, "alias").select("id", "content", "created_at")


def vector_list(spark: SparkSession, sf_dir: str, limit: int = 50) -> DataFrame:
    return lexical.ranked(vectors.cosine_to(X.vectors(spark, sf_dir), "id", _query_vector(spark, sf_dir)), "id", limit)


def cosine_doc_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_list(spark, sf_dir, 10)


def cosine_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Among the first hundred ids of inbox documents."""
    docs = table(spark, sf_dir, "documents").where("source = 'inbox'").select(F.concat(F.lit("src:"), F.col("doc_id").cast("string")).alias("id"))
    kept = vectors.filtered(X.vectors(spark, sf_dir), docs, "id")
    return lexical.ranked(vectors.cosine_to(kept, "id", _query_vector(spark, sf_dir)), "id", 10)


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whose vec_id is divisible by 100 against all."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    found = vectors.queries_against_all(e.where("cast(id as long) % 100 = 0"), e, "id", 0.2)
    return found.select("a", "b", F.round("score", 6).alias("score"))


def int8_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = vectors.quantized(table(spark, sf_dir, "embeddings"), "vec_id")
    return q.select("vec_id", F.array_join("codes", ",").alias("codes"))


def int8_roundtrip_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the ten nearest to the fixed vector after quantisation."""
    e, v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), _query_vector(spark, sf_dir)
    back = vectors.quantized(e, "vec_id").select("vec_id", F.transform("codes", lambda x: x.cast("double")).alias("embedding"))
    top = lambda df: lexical.ranked(vectors.cosine_to(df, "vec_id", v), "vec_id", 10)
    hit = top(back).select("vec_id").join(top(e).select("vec_id"), "vec_id")
    return hit.agg((F.count("*") / 10).alias("recall_at_10"))


def normalized_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.vectors(spark, sf_dir).select("id", F.round(vectors.norm(vectors.normalized(F.col("embedding"))), 6).alias("norm"), F.round(vectors.norm(F.col("embedding")), 4).alias("raw_norm"))


def never_merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases and their targets: may the names be merged at all?"""
    a = table(spark, sf_dir, "entity_aliases").where("canonical_id is not null").select("alias", "canonical_id").distinct()
    return a.select("alias", "canonical_id", vectors.never_merge(F.col("alias"), F.col("canonical_id")).alias("never"))


def _lists(spark: SparkSession, sf_dir: str, graph: bool = False) -> list[DataFrame]:
    lists = [
        fusion.ranked_list(bm25_chunk_list(spark, sf_dir), "bm25", 0, "doc_id", "chunk_id"),
        fusion.ranked_list(bm25_list(spark, sf_dir), "bm25", 1),
        fusion.ranked_list(vector_list(spark, sf_dir), "vector", 2),
    ]
    if graph:
        lists.append(fusion.ranked_list(chunk_vector_list(spark, sf_dir), "vector", 3, "doc_id", "chunk_id"))
        lists.append(fusion.ranked_list(graph_list(spark, sf_dir), "graph", 4))
    return lists


def chunk_vector_list(spark: SparkSession, sf_dir: str, limit: int = 20) -> DataFrame:
    """Embeddings as those of the first chunks of documents of their numbers."""
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("src:"), F.col("vec_id").cast("string")).alias("doc_id"), "embedding")
    c = X.chunks(spark, sf_dir).where("chunk_index = 0").groupBy("doc_id").agg(F.min("chunk_id").alias("chunk_id"))
    return vectors.chunks_to(e.join(c, "doc_id"), _query_vector(spark, sf_dir), limit)


def chunk_vector_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_vector_list(spark, sf_dir)


def document_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents and the names that they link as a graph; only documents are articles."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("src:"), F.col("doc_id").cast("string")).alias("source_id"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)))).alias("target_id"))
    edges = d.select("source_id", F.replace(F.lower("target_id"), F.lit(" "), F.lit("-")).alias("target_id"), F.lit("cites").alias("relation")).distinct()
    articles = edges.select(F.col("source_id").alias("id"), F.concat(F.lit("docs/"), "source_id").alias("article_path")).distinct()
    return edges, articles.unionByName(edges.select(F.col("target_id").alias("id"), F.lit("").alias("article_path")).distinct())


def graph_list(spark: SparkSession, sf_dir: str, limit: int = 50) -> DataFrame:
    """The graph leg over links: documents within two links of what the query names."""
    edges, nodes = document_edges(spark, sf_dir)
    none = spark.createDataFrame([], "alias string, canonical_id string")
    near = graph.graph_leg(edges, nodes, none, LEG_TERMS, limit, factor=1)
    order = Window.orderBy("score", "id")  # of at most ``limit`` rows
    return near.select("id", "score", F.row_number().over(order).alias("rank"))


def graph_list_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_list(spark, sf_dir)


def bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents of every question of the memory benchmark, all in one plan."""
    q = table(spark, sf_dir, "longmemeval_full").where("question is not null").select(F.col("question").alias("query")).distinct()
    terms = q.select("query", F.explode(T.query_terms(F.col("query"))).alias("term"))
    found = lexical.search(lexical.index(X.entries(spark, sf_dir), "id", lexical.ENTRY_WEIGHTS), terms, 3)
    return found.select("query", F.col("key").alias("id"), "score", "rank")


def _legs(spark: SparkSession, sf_dir: str) -> dict:
    return {
        "bm25": [lambda n: bm25_list(spark, sf_dir, limit=n)], "vector": [lambda n: vector_list(spark, sf_dir, n)],
        "graph": [lambda n: graph_list(spark, sf_dir, n)],
    }


def search_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facade over some channels and all, each with the channels that ran."""
    out = []
    for channels in (["bm25"], ["vector", "bm25"], None):
        rows, ran = fusion.run(_legs(spark, sf_dir), X.entries(spark, sf_dir), X.entry_dates(spark, sf_dir), NOW, 10, channels)
        out.append(rows.select(F.lit("+".join(ran)).alias("channels"), "doc_id", "score", "rank"))
    return out[0].unionByName(out[1]).unionByName(out[2])


def similar_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings divisible by 100 as questions, and stored vectors as outputs, of which every third number's state is stale."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("question"), "embedding")
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("long")
    outputs = X.vectors(spark, sf_dir).select(F.col("id").alias("output"), F.when(n % 3 == 0, "stale").when(n % 3 == 1, "pending").otherwise("confirmed").alias("state"), "embedding")
    return vectors.similar_question(e, outputs, 0.2)


def hybrid_rrf_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: BM25 and cosine lists of documents, fused."""
    lists = [fusion.ranked_list(bm25_list(spark, sf_dir), "bm25"), fusion.ranked_list(vector_list(spark, sf_dir), "vector", 1)]
    return fusion.fuse(lists, limit=10).select("doc_id", "score", "bm25_rank", "vector_rank", "rank")


def hybrid_three_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk and document BM25, document and chunk vectors, and the graph leg over the documents' links."""
    return fusion.fuse(_lists(spark, sf_dir, True), limit=20)


def multi_query_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query and a lexical variant, each its own list."""
    lists = [fusion.ranked_list(bm25_list(spark, sf_dir), "bm25"), fusion.ranked_list(bm25_list(spark, sf_dir, OTHER_TERMS), "bm25", 1)]
    return fusion.fuse(lists, limit=10).select("doc_id", "score", "bm25_rank", "rank")


def _shaped(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    fused = fusion.fuse([fusion.ranked_list(bm25_list(spark, sf_dir), "bm25"), fusion.ranked_list(vector_list(spark, sf_dir), "vector", 1)])
    return fusion.shape(fused, X.entries(spark, sf_dir), X.entry_dates(spark, sf_dir), NOW, 10, **how)


def search_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shaped(spark, sf_dir)


def search_facade_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent tag required, the second boosted."""
    tags = _top_tags(spark, sf_dir)
    return _shaped(spark, sf_dir, require=tags[:1], boost=tags[1:])


def search_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even numbers only, by a predicate that the caller brings."""
    even = F.regexp_extract("doc_id", "([0-9]+)", 1).cast("long") % 2 == 0
    return _shaped(spark, sf_dir, keep=even)


def cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of each embedding with that of the next number."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return both.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("next")), 9).alias("score"))


def vector_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored vectors after inbox documents' were deleted and embeddings put in: which ids there are, of which width."""
    gone = table(spark, sf_dir, "documents").where("source = 'inbox'").select(F.concat(F.lit("src:"), F.col("doc_id").cast("string")).alias("id"))
    new = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("src:"), (F.col("vec_id") * 3).cast("string")).alias("id"), "embedding")
    left = corpus.upsert(X.vectors(spark, sf_dir).join(gone, "id", "left_anti"), new, ["id"])
    return left.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


def legacy_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.legacy(bm25_list(spark, sf_dir), vector_list(spark, sf_dir), X.entries(spark, sf_dir), X.entry_dates(spark, sf_dir), NOW, 10, _top_tags(spark, sf_dir)[:1])


def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine as the rerank score of the text list's first thirty."""
    top = bm25_list(spark, sf_dir, limit=30).select(F.col("id").alias("doc_id"), "rank", "score")
    scored = vectors.cosine_to(X.vectors(spark, sf_dir), "id", _query_vector(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.round("score", 9).alias("score")).join(top.select("doc_id"), "doc_id")
    return fusion.blend(top, scored)


def federated_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbox and the rest as two projects."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("src:"), F.col("doc_id").cast("string")).alias("id"), F.coalesce(F.col("source") == "inbox", F.lit(False)).alias("inbox"))
    entries = X.entries(spark, sf_dir).join(docs, "id")
    top = lambda df: lexical.ranked(lexical.bm25(df, "id", lexical.ENTRY_WEIGHTS, TERMS), "id", 10).select(F.col("id").alias("doc_id"), F.round(1 / (fusion.RRF_K + F.col("rank")), 9).alias("score"))
    return fusion.federated({"inbox": top(entries.where("inbox")), "other": top(entries.where("not inbox"))}, 10)


QUERIES = {
    f.__name__: f
    for f in (bm25_doc_top10, bm25_chunk_top20, strong_signal, bm25_tagged, count_uncompiled, learnings_recall, cosine_doc_top10, cosine_filtered, similar_pairs, int8_codes, int8_roundtrip_topk, normalized_norms, never_merge_pairs, hybrid_rrf_top10, hybrid_three_channel, multi_query_fusion, search_recency, search_facade_filters, legacy_hybrid, rerank_blend, federated_top10, chunk_vector_top20, graph_list_top50, bm25_batch, search_channels, similar_questions, search_predicate, cosine_neighbours, vector_upkeep)
}


def _bm25_sql(name: str, source: str, key: str, weights: dict[str, float], terms: list[str], limit: int) -> str:
    """CTEs that end in ``name(key, score, rank)``, word by word from unnested columns."""
    cols = " union all ".join(f"select {key} k, {w} w, unnest(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')) word from {source}" for c, w in weights.items())
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""{name}_w as ({cols}), {name}_q(term) as (values {values}),
{name}_len as (select s.{key} k, coalesce(l.n, 0) n from {source} s left join (select k, count(*) n from {name}_w group by k) l on s.{key} = l.k),
{name}_tf as (select k, term, sum(w) tf from {name}_w join {name}_q on starts_with(word, term) group by k, term),
{name}_df as (select term, greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) idf from (select term, count(*) d from {name}_tf group by term), (select count(*) n from {source})),
{name}_sc as (select t.k, round(sum(d.idf * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.n / a.m))), 9) score from {name}_tf t join {name}_df d on t.term = d.term join {name}_len l on t.k = l.k, (select avg(n) m from {name}_len) a group by t.k),
{name} as (select k, score, row_number() over (order by score desc, k) rank from {name}_sc qualify rank <= {limit})"""


_QV = "(select embedding::double[] from embeddings where vec_id = 0)"
_VEC = f"""vec_s as (select id k, round(list_cosine_similarity(embedding::double[], {_QV}), 9) score from vectors),
vec as (select k, score, row_number() over (order by score desc, k) rank from vec_s qualify rank <= 50)"""
_CVEC = (f"""cvec as (select e.doc_id, c.chunk_id, round(list_cosine_similarity(embedding::double[], {_QV}), 9) score, row_number() over (order by round(list_cosine_similarity(embedding::double[], {_QV}), 9) desc, c.chunk_id) rank
  from (select 'src:' || vec_id doc_id, embedding from embeddings) e join (select doc_id, min(chunk_id) chunk_id from chunks where chunk_index = 0 group by doc_id) c on e.doc_id = c.doc_id)""",)
_LEG = LEG_TERMS
_GRAPH = (
    "gname(id) as (values " + ", ".join(f"('{x}')" for x in sorted({"-".join(_LEG[i : i + n]) for n in (1, 2, 3) for i in range(len(_LEG) - n + 1)})) + ")",
    r"glink as (select distinct 'src:' || doc_id s, replace(lower(unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1))), ' ', '-') t from documents where text is not null), gway as (select s id, t other from glink union select t, s from glink)",
    "g0 as (select id, 0.0::double c from gname where id in (select id from gway)), g1 as (select id, min(c) c from (select * from g0 union all select other, c + 1 / 0.7 from g0 join gway using (id)) group by id)",
    "g2 as (select id, min(c) c from (select * from g1 union all select other, c + 1 / 0.7 from g1 join gway using (id)) group by id)",
    "lnk as (select id k, round(c, 9) score, row_number() over (order by round(c, 9), id) rank from g2 where id in (select s from glink))",
)
_DOC = _bm25_sql("doc", "entries", "id", lexical.ENTRY_WEIGHTS, TERMS, 50)
_CHUNK = _bm25_sql("chk", "chunks", "chunk_id", lexical.CHUNK_WEIGHTS, TERMS, 50)
_HEAD = (X.ENTRIES, X.VECTORS, _DOC, _VEC)
_TAGS = "tagcount as (select t, row_number() over (order by count(*) desc, t) rn from (select unnest(str_split(tags, ',')) t from entries) where t <> '' group by t)"
_FUSED = "fused as (select k, round(sum(w), 9) score from (select k, round(0.7 / (60 + rank), 15) w from doc union all select k, round(0.3 / (60 + rank), 15) from vec) group by k)"
_POOL = "pool as (select k, case when mx = mn then 1.0 else (score - mn) / (mx - mn) end score from fused, (select min(score) mn, max(score) mx from fused))"
_AGE = f"case when source_date is not null and {NOW} >= source_date then 0.05 * pow(2, -(({NOW} - source_date) / 86400.0) / 14) else 0 end"
_ROUNDTRIP = f"""unit as (select vec_id, list_transform(embedding::double[], lambda x: x / n) v from (select vec_id, embedding, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings)),
s as (select max(list_max(list_transform(v, lambda x: abs(x)))) / 127 scale from unit), q as (select vec_id, list_transform(v, lambda x: round(x / scale)::integer) codes from unit, s)"""

SQL = {
    "bm25_doc_top10": X.with_(X.ENTRIES, _DOC) + "select k id, score, rank::integer rank from doc where rank <= 10",
    "bm25_chunk_top20": X.with_(X.CHUNKS, _CHUNK) + "select k chunk_id, score, rank::integer rank, doc_id from chk join chunks on k = chunk_id where rank <= 20",
    "strong_signal": X.with_(X.ENTRIES, _DOC) + "select a >= 0.4 and (n = 1 or a >= 2 * b) strong from (select max(s) a, min(s) b, count(*) n from (select score / (1 + score) s from doc where rank <= 2))",
    "bm25_tagged": X.with_(X.ENTRIES, _TAGS, "kept as (select * from entries where contains(tags, (select t from tagcount where rn = 1)))", _bm25_sql("doc", "kept", "id", lexical.ENTRY_WEIGHTS, TERMS, 10)) + "select k id, score, rank::integer rank from doc",
    "count_uncompiled": X.with_(X.ENTRIES, X.ITEMS, _bm25_sql("doc", "entries", "id", lexical.ENTRY_WEIGHTS, TERMS[:1], 10)) + "select count(*) uncompiled from doc_sc join items on k = 'src:' || doc_id where tier < 3",
    "learnings_recall": "select distinct id, summary as content, updated_at created_at from communities where summary is not null and contains(summary, 'alias') order by updated_at desc, id limit 10",
    "cosine_doc_top10": X.with_(X.VECTORS, _VEC) + "select k id, score, rank::integer rank from vec where rank <= 10",
    "cosine_filtered": X.with_(X.VECTORS) + f"""select id, score, row_number() over (order by score desc, id)::integer rank from (select id, round(list_cosine_similarity(embedding::double[], {_QV}), 9) score from vectors
      where id in (select distinct 'src:' || doc_id x from documents where source = 'inbox' order by x limit 100)) order by score desc, id limit 10""",
    "similar_pairs": """select * from (select a.vec_id::varchar a, b.vec_id::varchar b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) score from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id) where score >= 0.2""",
    "int8_codes": X.with_(_ROUNDTRIP) + "select vec_id, array_to_string(codes, ',') codes from q",
    "int8_roundtrip_topk": X.with_(_ROUNDTRIP) + f""", a as (select vec_id from q order by round(list_cosine_similarity(codes::double[], {_QV}), 9) desc, vec_id limit 10),
b as (select vec_id from embeddings order by round(list_cosine_similarity(embedding::double[], {_QV}), 9) desc, vec_id limit 10) select count(*) / 10 recall_at_10 from a join b using (vec_id)""",
    "normalized_norms": X.with_(X.VECTORS) + "select id, 1.0::double norm, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 4) raw_norm from vectors",
    "never_merge_pairs": r"""with p as (select distinct alias, canonical_id from entity_aliases where canonical_id is not null),
      t as (select alias, canonical_id, list_distinct(regexp_extract_all(lower(alias), '[\p{L}\p{Nd}]+')) x, list_distinct(regexp_extract_all(lower(canonical_id), '[\p{L}\p{Nd}]+')) y from p)
      select alias, canonical_id, list_sort(list_filter(x, lambda w: regexp_matches(w, '[0-9]'))) <> list_sort(list_filter(y, lambda w: regexp_matches(w, '[0-9]')))
        or (contains(x, 'draft') <> contains(y, 'draft') and (contains(x, 'final') or contains(y, 'final'))) or (contains(x, 'final') <> contains(y, 'final') and (contains(x, 'draft') or contains(y, 'draft')))
        or (contains(x, 'primary') <> contains(y, 'primary') and (contains(x, 'secondary') or contains(y, 'secondary'))) or (contains(x, 'secondary') <> contains(y, 'secondary') and (contains(x, 'primary') or contains(y, 'primary'))) never from t""",
    "hybrid_rrf_top10": X.with_(*_HEAD, _FUSED) + """select f.k doc_id, f.score, d.rank::integer bm25_rank, v.rank::integer vector_rank, row_number() over (order by f.score desc, f.k)::integer rank
      from fused f left join doc d on f.k = d.k left join vec v on f.k = v.k order by f.score desc, f.k limit 10""",
    "hybrid_three_channel": X.with_(
        X.ENTRIES, X.VECTORS, X.CHUNKS, _DOC, _VEC, _CHUNK, *_CVEC, *_GRAPH,
        "lists as (select 'bm25' c, 0 l, 0.7 w, c.doc_id k, x.k chunk, x.rank from chk x join chunks c on x.k = c.chunk_id union all select 'bm25', 1, 0.7, k, null, rank from doc union all select 'vector', 2, 0.3, k, null, rank from vec union all select 'vector', 3, 0.3, doc_id, chunk_id, rank from cvec where rank <= 20 union all select 'graph', 4, 0.2, k, null, rank from lnk where rank <= 50)",
        "best as (select c, l, w, k, arg_min(chunk, rank) chunk, min(rank) rank from lists group by c, l, w, k)",
        "out as (select k doc_id, round(sum(round(w / (60 + rank), 15)), 9) score, arg_min(chunk, row(rank, l)) filter (chunk is not null) chunk_id, min(rank) filter (c = 'bm25') b, min(rank) filter (c = 'vector') v, min(rank) filter (c = 'graph') g from best group by k)",
    ) + "select doc_id, score, chunk_id, b::integer bm25_rank, v::integer vector_rank, g::integer graph_rank, row_number() over (order by score desc, doc_id)::integer rank from out order by score desc, doc_id limit 20",
    "chunk_vector_top20": X.with_(X.CHUNKS, *_CVEC) + "select doc_id, chunk_id, score, rank::integer rank from cvec where rank <= 20",
    "graph_list_top50": X.with_(*_GRAPH) + "select k id, score, rank::integer rank from lnk where rank <= 50",
    "bm25_batch": X.with_(X.ENTRIES, _TERMS, "q as (select distinct question query, term from terms)",
        "w as (" + " union all ".join(f"select id k, {w} w, unnest(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')) word from entries" for c, w in lexical.ENTRY_WEIGHTS.items()) + ")",
        "len as (select id k, coalesce(n, 0) n from entries left join (select k, count(*) n from w group by k) l on id = l.k), post as (select k, word, sum(w) tf from w group by k, word)",
        "voc as (select distinct word from post), head as (select word, term from voc join (select distinct term from q) on starts_with(word, term)), tf as (select k, term, sum(tf) tf from post join head using (word) group by k, term)",
        "df as (select term, greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) idf from (select term, count(*) d from tf group by term), (select count(*) n from entries))",
        "part as (select t.k, t.term, d.idf * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * l.n / a.m)) p from tf t join df d using (term) join len l on t.k = l.k, (select avg(n) m from len) a)")
    + "select query, k id, score, (row_number() over (partition by query order by score desc, k))::integer rank from (select query, k, round(sum(p), 9) score from q join part using (term) group by query, k) qualify rank <= 3",
    "search_channels": X.with_(*_HEAD, X.ENTRY_DATES, *_GRAPH,
        "ch as (select 'bm25' ch, k, 0.7 w, rank from doc where rank <= 10 union all select 'bm25+vector', k, 0.7, rank from doc where rank <= 10 union all select 'bm25+vector', k, 0.3, rank from vec where rank <= 10 union all select 'bm25+vector+graph', k, 0.7, rank from doc where rank <= 10 union all select 'bm25+vector+graph', k, 0.3, rank from vec where rank <= 10 union all select 'bm25+vector+graph', k, 0.2, rank from lnk where rank <= 10)",
        "fu as (select ch, k, round(sum(round(w / (60 + rank), 15)), 9) score from ch group by ch, k qualify row_number() over (partition by ch order by score desc, k) <= 10)",
        "po as (select ch, k, case when max(score) over (partition by ch) = min(score) over (partition by ch) then 1.0 else (score - min(score) over (partition by ch)) / (max(score) over (partition by ch) - min(score) over (partition by ch)) end score from fu)")
    + f"select ch channels, k doc_id, score, row_number() over (partition by ch order by score desc, k)::integer rank from (select ch, k, round(score + {_AGE}, 9) score from po left join entry_dates on k = id)",
    "similar_questions": X.with_(X.VECTORS) + """select question, output, score from (select a.vec_id::varchar question, b.id output, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) score from embeddings a, vectors b
      where a.vec_id % 100 = 0 and regexp_extract(b.id, '([0-9]+)', 1)::bigint % 3 <> 0) where score >= 0.2 qualify row_number() over (partition by question order by score desc, output) = 1""",
    "search_predicate": X.with_(*_HEAD, X.ENTRY_DATES, _FUSED, _POOL) + f"select k doc_id, score, row_number() over (order by score desc, k)::integer rank from (select k, round(score + {_AGE}, 9) score from pool left join entry_dates on k = id where regexp_extract(k, '([0-9]+)', 1)::bigint % 2 = 0) order by score desc, k limit 10",
    "cosine_neighbours": "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) score from embeddings a join embeddings b on a.vec_id = b.vec_id - 1",
    "vector_upkeep": X.with_(X.VECTORS, "u as (select 'src:' || vec_id * 3 id, len(embedding) w from embeddings)", "v as (select id, len(embedding) w from vectors where id not in (select 'src:' || doc_id from documents where source = 'inbox') and id not in (select id from u) union all select * from u)") + "select w::integer width, count(*) n, min(id) as first, max(id) as last from v group by w",
    "multi_query_fusion": X.with_(X.ENTRIES, _DOC, _bm25_sql("alt", "entries", "id", lexical.ENTRY_WEIGHTS, OTHER_TERMS, 50)) + """select k doc_id, score, b::integer bm25_rank, row_number() over (order by score desc, k)::integer rank from
      (select k, round(sum(round(0.7 / (60 + rank), 15)), 9) score, min(rank) b from (select k, rank from doc union all select k, rank from alt) group by k) order by score desc, k limit 10""",
    "search_recency": X.with_(*_HEAD, X.ENTRY_DATES, _FUSED, _POOL) + f"select k doc_id, score, row_number() over (order by score desc, k)::integer rank from (select k, round(score + {_AGE}, 9) score from pool left join entry_dates on k = id) order by score desc, k limit 10",
    "search_facade_filters": X.with_(*_HEAD, X.ENTRY_DATES, _TAGS, _FUSED, _POOL) + f"""select k doc_id, score, row_number() over (order by score desc, k)::integer rank from
      (select k, round(score + case when list_contains(list_transform(str_split(tags, ','), lambda t: trim(t)), (select t from tagcount where rn = 2)) then 0.03 else 0 end + {_AGE}, 9) score from pool join entries e on k = e.id left join entry_dates d on k = d.id
       where list_contains(list_transform(str_split(tags, ','), lambda t: trim(t)), (select t from tagcount where rn = 1))) order by score desc, k limit 10""",
    "legacy_hybrid": X.with_(*_HEAD, X.ENTRY_DATES, _TAGS) + f"""select k id, round(s + case when list_contains(list_transform(str_split(tags, ','), lambda t: lower(trim(t))), (select lower(t) from tagcount where rn = 1)) then 0.03 else 0 end + {_AGE}, 9) score
      from (select k, sum(1.0 / (60 + rank)) s from (select k, rank from doc union all select k, rank from vec) group by k) join entries e on k = e.id left join entry_dates d on k = d.id order by score desc, k limit 10""",
    "rerank_blend": X.with_(X.ENTRIES, X.VECTORS, _DOC) + f""", top as (select * from doc where rank <= 30), base as (select k, rank, case when a = b then 1.0 else (score - a) / (b - a) end s from top, (select min(score) a, max(score) b from top)),
rr as (select k, round(list_cosine_similarity(embedding::double[], {_QV}), 9) r from top join vectors on k = id), n as (select k, case when a = b then 1.0 else (r - a) / (b - a) end r from rr, (select min(r) a, max(r) b from rr)),
own as (select base.k, s, r, case when rank <= 3 then 0.75 when rank <= 10 then 0.6 else 0.4 end o, (select count(*) from rr) / (select count(*) from top) >= 0.5 ok from base left join n on base.k = n.k)
select k doc_id, round(case when not ok or r is null then s else o * s + (1 - o) * r end, 9) score from own""",
    "federated_top10": X.with_(X.ENTRIES, "inb as (select e.* from entries e join documents d on e.id = 'src:' || d.doc_id where coalesce(d.source = 'inbox', false))", "oth as (select e.* from entries e join documents d on e.id = 'src:' || d.doc_id where not coalesce(d.source = 'inbox', false))",
        _bm25_sql("p", "inb", "id", lexical.ENTRY_WEIGHTS, TERMS, 10), _bm25_sql("o", "oth", "id", lexical.ENTRY_WEIGHTS, TERMS, 10)) + """select * from (select 'inbox' project, k doc_id, round(1 / (60 + rank), 9) score from p union all select 'other', k, round(1 / (60 + rank), 9) from o) order by score desc, project, doc_id limit 10""",
}
