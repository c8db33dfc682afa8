"""Domain tables derived from the test tables, for Spark and, as heads of the checking SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.runtime import table

#: Instant that stands for now in queries that need one.
NOW = "2025-01-01T00:00:00Z"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("src:"), F.col("doc_id").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("content"),
        F.coalesce("tags", F.lit("")).alias("tags"), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("article_path"),
    )


ENTRIES = "entries as (select 'src:' || doc_id id, coalesce(text, '') as content, coalesce(tags, '') tags, 'docs/' || doc_id || '.md' article_path from documents)"


def entry_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("ingested_at is not null")
    return d.select(F.concat(F.lit("src:"), F.col("doc_id").cast("string")).alias("id"), F.unix_timestamp("ingested_at").alias("source_date"))


ENTRY_DATES = "entry_dates as (select 'src:' || doc_id id, floor(epoch(ingested_at))::bigint source_date from documents where ingested_at is not null)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids with 64 finite numbers, not all zero."""
    v = table(spark, sf_dir, "vec_entries")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    return v.where(fine & (F.size("embedding") == 64)).groupBy("id").agg(F.max("embedding").alias("embedding"))


VECTORS = """vectors as (select id, max(embedding) embedding from vec_entries where len(embedding) = 64
  and len(list_filter(embedding, lambda x: x is not null and not isnan(x) and not isinf(x))) = 64
  and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by id)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct chunks; of rows with one id the one with the longest content holds, then the largest heading."""
    c = table(spark, sf_dir, "chunks_meta")
    last = F.max(F.struct(F.length("content").alias("n"), F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("content", F.lit("")).alias("content"), "doc_id", "chunk_index")).alias("m")
    return c.groupBy("chunk_id").agg(last).select("chunk_id", "m.doc_id", "m.chunk_index", "m.heading", "m.content")


CHUNKS = """chunks as (select chunk_id, doc_id, chunk_index, coalesce(heading, '') heading, coalesce(content, '') as content from chunks_meta
  qualify row_number() over (partition by chunk_id order by length(content) desc nulls last, coalesce(heading, '') desc, coalesce(content, '') desc, doc_id desc, chunk_index desc) = 1)"""


def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    lit, cat = F.lit, F.concat
    make = lambda df, key, kind, name, path: df.select(key.alias("id"), lit(kind).alias("type"), name.alias("name"), path.alias("article_path"))
    wiki = lambda key: cat(lit("wiki/"), key, lit(".md"))
    key = lambda prefix, c: cat(lit(prefix), F.col(c).cast("string"))
    level = cat(lit("priority-"), F.substring("o_orderpriority", 1, 1))
    parts = [
        make(t("region"), key("region-", "r_regionkey"), "claim", F.col("r_name"), lit("")),
        make(t("nation"), key("nation-", "n_nationkey"), "technique", F.col("n_name"), wiki(key("nation-", "n_nationkey"))),
        make(t("supplier"), key("supplier-", "s_suppkey"), "concept", F.col("s_name"), wiki(key("supplier-", "s_suppkey"))),
        make(t("customer"), key("customer-", "c_custkey"), "artifact", F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, wiki(key("customer-", "c_custkey"))).otherwise("")),
        make(t("part"), key("part-", "p_partkey"), "source", F.col("p_name"), lit("")),
        t("orders").select(level.alias("id"), lit("concept").alias("type"), F.col("o_orderpriority").alias("name"), lit("").alias("article_path")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


GRAPH_ENTITIES = """graph_entities as (
  select 'region-' || r_regionkey id, 'claim' as type, r_name as name, '' article_path from region
  union all select 'nation-' || n_nationkey, 'technique', n_name, 'wiki/nation-' || n_nationkey || '.md' from nation
  union all select 'supplier-' || s_suppkey, 'concept', s_name, 'wiki/supplier-' || s_suppkey || '.md' from supplier
  union all select 'customer-' || c_custkey, 'artifact', c_name, case when c_custkey % 2 = 0 then 'wiki/customer-' || c_custkey || '.md' else '' end from customer
  union all select 'part-' || p_partkey, 'source', p_name, '' from part
  union all select distinct 'priority-' || left(o_orderpriority, 1), 'concept', o_orderpriority, '' from orders)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    make = lambda df, s, o, r, c, vf: df.select(s.alias("source_id"), o.alias("target_id"), F.lit(r).alias("relation"), c.cast("double").alias("confidence"), vf.alias("valid_from"), F.lit("").alias("valid_to"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    cites = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("d"))
    level = F.concat(F.lit("priority-"), F.substring("o_orderpriority", 1, 1))
    uses = t("orders").groupBy("o_custkey", level.alias("level")).agg(F.max("o_totalprice").alias("p"), F.min("o_orderdate").alias("d"))
    out = make(t("nation"), key("nation-", "n_nationkey"), key("region-", "n_regionkey"), "derived_from", F.lit(0.9), F.lit(""))
    out = out.unionByName(make(t("supplier"), key("supplier-", "s_suppkey"), key("nation-", "s_nationkey"), "extends", F.lit(0.8), F.lit("")))
    out = out.unionByName(make(t("customer"), key("customer-", "c_custkey"), key("nation-", "c_nationkey"), "implements", F.lit(0.7), F.lit("")))
    out = out.unionByName(make(cites, key("supplier-", "l_suppkey"), key("part-", "l_partkey"), "cites", F.lit(0.0), stamp("d")))
    return out.unionByName(make(uses, key("customer-", "o_custkey"), F.col("level"), "optimizes", F.round(F.col("p") / 1000000, 6), stamp("d")))


RELATIONS = """relations as (
  select 'nation-' || n_nationkey source_id, 'region-' || n_regionkey target_id, 'derived_from' relation, 0.9::double confidence, '' valid_from, '' valid_to from nation
  union all select 'supplier-' || s_suppkey, 'nation-' || s_nationkey, 'extends', 0.8, '', '' from supplier
  union all select 'customer-' || c_custkey, 'nation-' || c_nationkey, 'implements', 0.7, '', '' from customer
  union all select 'supplier-' || l_suppkey, 'part-' || l_partkey, 'cites', 0.0, strftime(min(l_shipdate), '%Y-%m-%dT%H:%M:%SZ'), '' from lineitem group by l_suppkey, l_partkey
  union all select 'customer-' || o_custkey, 'priority-' || left(o_orderpriority, 1), 'optimizes', round(max(o_totalprice) / 1000000, 6), strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%SZ'), '' from orders group by o_custkey, left(o_orderpriority, 1))"""


def graph_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of suppliers, each the alias of the one before, cut at every fourth."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0")
    key = lambda c: F.concat(F.lit("supplier-"), c.cast("string"))
    return s.select(key(F.col("s_suppkey")).alias("alias"), key(F.col("s_suppkey") - 1).alias("canonical_id"))


GRAPH_ALIASES = "graph_aliases as (select 'supplier-' || s_suppkey as alias, 'supplier-' || (s_suppkey - 1) canonical_id from supplier where s_suppkey % 4 <> 0)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each source: hash, size, type, tier and hits."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_path"), F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("hash"),
        F.coalesce("source_type", F.lit("article")).alias("file_type"), F.octet_length(text).cast("long").alias("size_bytes"),
        (F.col("doc_id") % 4).cast("int").alias("tier"), (F.col("doc_id") % 7).cast("int").alias("hits"), "doc_id", "ingested_at",
    )


ITEMS = """items as (select 'docs/' || doc_id || '.md' source_path, 'sha256:' || sha256(coalesce(text, '')) hash, coalesce(source_type, 'article') file_type,
  octet_length(encode(coalesce(text, '')))::bigint size_bytes, (doc_id % 4)::integer tier, (doc_id % 7)::integer hits, doc_id from documents)"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",\n".join(parts) + "\n"
