"""Queries on events, chunking, communities and approximate search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import chunking, providers
from mnemora.operators import cells, graph, louvain
from mnemora.plans import fixtures as X
from mnemora.runtime import durable, table
from mnemora.sources import code
from mnemora.streaming import events as E


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(E.tumbling(table(spark, sf_dir, "events")), "start")


def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(E.sliding(table(spark, sf_dir, "events")), "start")


def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(E.sessions(table(spark, sf_dir, "events"), "6 hours"), "start", "end")


def events_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.once(table(spark, sf_dir, "events").select("user_id", "event_type", F.date_trunc("day", "ts").alias("ts")), ["user_id", "event_type", "ts"]).groupBy("event_type").agg(F.count("*").alias("user_days"))


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in each event's payload, by type."""
    e = table(spark, sf_dir, "events").withColumn("data", F.from_json("props", "k int"))
    return e.groupBy("event_type").agg(F.count("data.k").alias("with_k"), F.sum("data.k").alias("sum_k"), F.max("data.k").alias("max_k"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return chunking.chunked(docs, "doc_id", "text", 400, 40).select("doc_id", "chunk_index", "heading", F.length("content").alias("chars"))


def chunk_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a document folded eight at a time into one digest."""
    return chunking.reduced(X.chunks(spark, sf_dir), "doc_id", "chunk_index", "content", lambda parts: F.sha2(F.array_join(parts, "\n"), 256))


def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return providers.embedded(docs, "text", providers.HashEmbedder(8)).select("doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 3).cast("string")), ",").alias("embedding"))


def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.community_edges(X.relations(spark, sf_dir), X.graph_entities(spark, sf_dir), X.NOW)
    return louvain.described(louvain.communities(edges), edges)


def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of cells against all rows, for every vector whose number is divisible by 100."""
    v = durable(X.vectors(spark, sf_dir))
    q = v.where("cast(regexp_extract(id, '([0-9]+)', 1) as long) % 100 = 0")
    c = cells.fit(v, "id", 64)
    near = cells.search(v, q, "id", c, 12).select("query", "other", F.lit(1).alias("near"))
    exact = cells.search(v, q, "id", c, len(c))
    return exact.join(near, ["query", "other"], "left").agg(F.round(F.count("near") / F.greatest(F.count("*"), F.lit(1)), 4).alias("recall"))


#: Fenced blocks: fence, language, code.
_FENCE = r"(?m)^(`{3,}|~{3,})[ \t]*([\w+#.-]*)[^\n]*\n((?:(?!\1)(?:[^\n]*\n|[^\n]+\z))*)(?:\1)?"
_TAGS = {"python": ("python3",), "go": ("golang",), "javascript": ("typescript",), "c": ("c++",)}


def code_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions in the fenced code of documents, in every language that the operator parses."""
    tags = F.lower(F.regexp_extract("block", _FENCE, 2))
    ext = F.coalesce(*(F.when(tags.isin(lang, *of[0].split(), *_TAGS.get(lang, ())), F.lit(of[0].split()[0])) for lang, of in code.LANGUAGES.items()))
    blocks = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all(F.regexp_replace("text", "\r", ""), F.lit(_FENCE), F.lit(0))).alias("block"))
    path = F.concat(F.col("doc_id").cast("string"), F.lit("."), ext)
    found = code.structure(blocks.select(path.alias("path"), F.regexp_extract("block", _FENCE, 3).alias("code")), "path", "code")
    doc = F.regexp_replace("path", r"\.[^.]*$", "")
    return found.select(doc.alias("doc"), F.explode("functions").alias("function")).groupBy("function").agg(F.countDistinct("doc").alias("docs"))


QUERIES = {f.__name__: f for f in (events_tumbling, events_sliding, events_session, events_dedup, event_payloads, document_chunks, chunk_digests, hash_embeddings, louvain_communities, ann_recall, code_structure)}

_FOLD = ",\n".join(f"r{k + 1} as (select doc_id, i // 8 i, case when count(*) = 1 then min(t) else sha256(string_agg(t, chr(10) order by i)) end t from r{k} group by doc_id, i // 8)" for k in range(6))

SQL = {
    "chunk_digests": X.with_(X.CHUNKS, "r0 as (select doc_id, chunk_index::bigint i, content t from chunks)", _FOLD) + "select doc_id, t as content from r6",
    "events_tumbling": "select date_trunc('day', ts)::timestamp as start, event_type, count(*) events, round(sum(value), 6) total from events group by 1, 2",
    "events_sliding": "select s as start, count(*) events, count(distinct user_id) users from (select date_trunc('day', ts)::timestamp - interval 1 day * k s, user_id from events, (values (0), (1)) v(k)) group by s",
    "events_session": """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end n from events window w as (partition by user_id order by ts)),
      s as (select user_id, ts, sum(n) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, min(ts) as start, max(ts) + interval 6 hours as "end", count(*) events from s group by user_id, k""",
    "events_dedup": "select event_type, count(distinct (user_id, date_trunc('day', ts))) user_days from events group by event_type",
    "event_payloads": "select event_type, count(json_extract_string(props, '$.k')::integer) with_k, sum(json_extract_string(props, '$.k')::integer)::bigint sum_k, max(json_extract_string(props, '$.k')::integer) max_k from events group by event_type",
}
