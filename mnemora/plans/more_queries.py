"""Queries on links, triples, views and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import fusion, graph, links, vectors
from mnemora.plans import fixtures as X
from mnemora.plans import graph_queries as G
from mnemora.plans import search_queries as S
from mnemora.runtime import durable, table
from mnemora.sources import code, files


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "entities").where("name is not null and id is not null").select("name", "id")


def wikilinks_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.rewrite(_docs(spark, sf_dir), _names(spark, sf_dir), "doc_id", "text", links.sanitized).select("doc_id", F.md5("text").alias("digest"))


def wikilinks_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.rewrite(_docs(spark, sf_dir), _names(spark, sf_dir), "doc_id", "text", links.stripped).select("doc_id", F.md5("text").alias("digest"))


def triples_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases as triples: the reason's first word as the predicate."""
    a = table(spark, sf_dir, "entity_aliases").select(F.lit(1).alias("one"), F.concat(F.lit(" "), "alias").alias("source"), F.col("canonical_id").alias("target"), F.concat_ws(" ", F.slice(F.split("reason", " "), 1, 2)).alias("predicate"), (F.col("confidence") * 1.2).alias("confidence"), F.col("created_at").alias("pos"), F.substring("entity_type", 1, 1).alias("doc")).distinct()
    e = table(spark, sf_dir, "entities").select(F.col("id").alias("name"))
    s = spark.createDataFrame([("old form", "was"), ("short form", "short")], "word string, predicate string")
    return links.normalize_triples(a.withColumn("doc", F.concat("doc", F.substring("pos", 1, 10))), e, s)


def entities_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of aliases as entities of the documents that the triples come from."""
    a = table(spark, sf_dir, "entity_aliases")
    doc = F.concat(F.substring("entity_type", 1, 1), F.substring("created_at", 1, 10))
    both = a.select(doc.alias("doc"), F.explode(F.array("alias", "canonical_id")).alias("name"), F.col("entity_type").alias("type"), F.col("created_at").alias("pos")).where("name is not null and doc is not null")
    return links.normalize_entities(both, ["concept", "technique", "claim"], triples_normalized(spark, sf_dir), 40)


def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose number is divisible by 100 the nearest other of at least 0.6 with a mergeable source path."""
    v = X.vectors(spark, sf_dir)
    found = vectors.queries_against_all(v.where("cast(regexp_extract(id, '([0-9]+)', 1) as long) % 100 = 0"), v, "id", 0.6)
    path = table(spark, sf_dir, "documents").select(F.concat(F.lit("src:"), F.col("doc_id").cast("string")).alias("id"), F.regexp_extract("source_path", r"([^/]*)$", 1).alias("name"))
    named = found.withColumn("score", F.round("score", 9)).join(path.select(F.col("id").alias("a"), F.col("name").alias("x")), "a").join(path.select(F.col("id").alias("b"), F.col("name").alias("y")), "b")
    return vectors.near_duplicates(named, F.coalesce(vectors.never_merge(F.col("x"), F.col("y")), F.lit(False)))


def ego_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges among what is within one step of a supplier, under the name that it goes by, and isn't a source."""
    r, e = X.relations(spark, sf_dir), X.graph_entities(spark, sf_dir)
    center = durable(graph.resolved(G._ids(spark, "supplier-7"), X.graph_aliases(spark, sf_dir)))
    near = graph.neighbors(r, center, 1).select("id").unionByName(center).join(e.where("type <> 'source'").select("id"), "id", "left_semi")
    return r.join(near.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(near.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("source_id", "target_id", "relation")


def rerank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifteen passages for a reranker, 400 tokens of four characters each and 8000 in all."""
    top = S.bm25_list(spark, sf_dir, limit=15).join(X.entries(spark, sf_dir).select("id", "content"), "id")
    cut = top.withColumn("passage", F.substring("content", 1, 1600)).withColumn("tokens", F.ceil(F.length("passage") / 4))
    return fusion.within_budget(cut, "rank", "tokens", 8000).select("id", "rank", "tokens", "spent")


def hydrated_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused results with their best chunk's passage, else the entry's."""
    top = fusion.fuse(S._lists(spark, sf_dir), limit=10)
    c = X.chunks(spark, sf_dir).select("chunk_id", "heading", F.col("content").alias("chunk"))
    rows = top.join(c, "chunk_id", "left").join(X.entries(spark, sf_dir).select(F.col("id").alias("doc_id"), F.col("content").alias("entry")), "doc_id", "left")
    return rows.select("doc_id", "rank", F.coalesce("heading", F.lit("")).alias("heading"), F.md5(F.coalesce(F.nullif("chunk", F.lit("")), "entry", F.lit(""))).alias("passage"))


def workspace_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    t = lambda x: table(spark, sf_dir, x)
    pending = X.items(spark, sf_dir).where("tier < 3")
    parts = [n("entries", t("documents")), n("chunks", X.chunks(spark, sf_dir)), n("vectors", X.vectors(spark, sf_dir)), n("entities", t("entities").select("id").distinct()), n("aliases", t("entity_aliases").where("lower(trim(status)) = 'applied'")), n("communities", t("communities").select("id").distinct()), n("pending", pending)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def query_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of items raised by one for each event of a user of the same number."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("more"))
    return X.items(spark, sf_dir).join(e, "doc_id", "left").select("source_path", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("hits"))


def lint_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar vectors, of queries divisible by 100, whose documents share no link target."""
    v = X.vectors(spark, sf_dir)
    found = vectors.queries_against_all(v.where("cast(regexp_extract(id, '([0-9]+)', 1) as long) % 100 = 0"), v, "id", 0.7)
    t = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("src:"), F.col("doc_id").cast("string")).alias("id"), F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("l"))
    both = found.join(t.select(F.col("id").alias("a"), F.col("l").alias("x")), "a").join(t.select(F.col("id").alias("b"), F.col("l").alias("y")), "b")
    return both.where(~F.arrays_overlap("x", "y")).select("a", "b", F.round("score", 6).alias("score"))


def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.content_hash(F.col("text")).alias("hash"), F.octet_length("text").alias("bytes"))


#: Signals of types by file names and words.
SIGNALS = [{"type": "minutes", "names": ["meeting", "minutes"]}, {"type": "graph", "words": ["graph leg", "entity graph", "backlink"], "least": 2}, {"type": "code", "pattern": "```python"}]


def source_path_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of documents by their first 500 characters and path, and the language of code by the extension."""
    d = table(spark, sf_dir, "documents")
    head = F.coalesce(F.substring("text", 1, 500), F.lit(""))
    path = F.coalesce("source_path", F.lit(""))
    rows = d.select("doc_id", files.signalled_type(path, head, SIGNALS).alias("type"), files.source_type(path).alias("by_extension"), files.ignored(path, ["*.txt", "inbox"]).alias("ignored"), code.language(path).alias("language"))
    return rows


def filler_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a sentence put before them that is filler, which goes again."""
    d = _docs(spark, sf_dir).where(r"text rlike '\\w'")
    clean = T.without_filler_sentences(F.concat(F.lit("In summary, it works.\n"), F.col("text")))
    return d.select("doc_id", F.contains(F.lower(clean), F.lit("in summary")).alias("left"), F.length(clean).alias("chars"))


def trusted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of which every third is an output; those of a tier under 2 are confirmed."""
    top = S.bm25_list(spark, sf_dir, limit=30)
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("long")
    rows = top.select(F.when(n % 3 == 0, F.concat(F.lit("output:"), n.cast("string"))).otherwise(F.col("id")).alias("doc_id"), "score")
    sure = X.items(spark, sf_dir).where("tier < 2").select(F.concat(F.lit("output:"), F.col("doc_id").cast("string")).alias("doc_id"))
    return fusion.trusted(rows, sure, None)


QUERIES = {f.__name__: f for f in (content_hashes, source_path_types, filler_stripped, trusted_results)} | {f.__name__: f for f in (wikilinks_sanitized, wikilinks_stripped, triples_normalized, entities_normalized, semantic_dedup, ego_graph, rerank_candidates, hydrated_top10, workspace_status, query_hits, lint_connections)}

_LINKS = r"""names as (select lower(name) k, min(id) id from entities where name is not null and id is not null group by 1),
parts as (select doc_id, generate_subscripts(l, 1) pos, unnest(l) part from (select doc_id, str_split(regexp_replace(text, '(\[\[[^\]]+\]\])', chr(1) || '\1' || chr(1), 'g'), chr(1)) l from documents where text is not null)),
solved as (select p.*, regexp_full_match(part, '\[\[[^\]]+\]\]') is_link, n.id, substring(part, 3, length(part) - 4) t from parts p left join names n on regexp_full_match(part, '\[\[[^\]]+\]\]') and lower(split_part(substring(part, 3, length(part) - 4), '|', 1)) = n.k)"""
_PAIR = "pairs as (select a.id a, b.id b, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) s from vectors a, vectors b where regexp_extract(a.id, '([0-9]+)', 1)::bigint % 100 = 0 and a.id <> b.id)"

_TYPE = "case " + " ".join(f"when lower(regexp_extract(p, '\\.([^./]+)$', 1)) in ({', '.join(repr(x) for x in exts.split())}) then '{t}'" for t, exts in files.TYPES.items()) + " else 'article' end"
_LANG = "case " + " ".join(f"when lower(regexp_extract(p, '\\.([^./]+)$', 1)) in ({', '.join(repr(x) for x in v[0].split())}) then '{t}'" for t, v in code.LANGUAGES.items()) + " end"

SQL = {
    "content_hashes": "select doc_id, 'sha256:' || sha256(text) hash, octet_length(encode(text))::integer bytes from documents where text is not null",
    "source_path_types": f"""with d as (select doc_id, coalesce(source_path, '') p, coalesce(substring(text, 1, 500), '') h from documents), e as (select *, regexp_extract(p, '([^/]*)$', 1) n, h l from d)
      select case when contains(n, 'meeting') or contains(n, 'minutes') then 'minutes' when contains(l, 'graph leg')::integer + contains(l, 'entity graph')::integer + contains(l, 'backlink')::integer >= 2 then 'graph' when contains(h, '```python') then 'code' else {_TYPE} end as type,
        {_TYPE} by_extension, ends_with(lower(p), '.txt') or contains('/' || p || '/', '/inbox/') ignored, {_LANG} as language, doc_id from e""",
    "trusted_results": X.with_(X.ENTRIES, X.ITEMS, S._DOC, "r as (select case when regexp_extract(k, '([0-9]+)', 1)::bigint % 3 = 0 then 'output:' || regexp_extract(k, '([0-9]+)', 1) else k end doc_id, score from doc where rank <= 30)")
    + "select doc_id, score from r where not starts_with(doc_id, 'output:') or doc_id in (select 'output:' || doc_id from items where tier < 2)",
    "filler_stripped": "select doc_id, contains(lower(text), 'in summary') as left, length(text)::integer + 1 chars from documents where regexp_matches(text, '\\w')",
    "wikilinks_sanitized": X.with_(_LINKS) + "select doc_id, md5(string_agg(case when is_link and id is not null then case when id = t then '[[' || id || ']]' else '[[' || id || '|' || split_part(t, '|', -1) || ']]' end else part end, '' order by pos)) digest from solved group by doc_id",
    "wikilinks_stripped": X.with_(_LINKS) + "select doc_id, md5(string_agg(case when is_link and id is null then split_part(t, '|', -1) else part end, '' order by pos)) digest from solved group by doc_id",
    "triples_normalized": """with a as (select distinct trim(' ' || alias) source, trim(canonical_id) target, array_to_string(str_split(reason, ' ')[1:2], ' ') w, confidence * 1.2 confidence, created_at pos, left(entity_type, 1) || left(created_at, 10) doc from entity_aliases),
      s(word, predicate) as (values ('old form', 'was'), ('short form', 'short'), ('was', 'was'), ('short', 'short')),
      r as (select doc, source, predicate, target, greatest(0.0, least(1.0, coalesce(confidence, 0.0))) confidence, pos from a join s on lower(trim(w)) = s.word where source <> target and source in (select id from entities where id is not null) and target in (select id from entities where id is not null))
      select * from r qualify row_number() over (partition by doc order by pos, source, target, predicate) <= 60""",
    "semantic_dedup": X.with_(X.VECTORS, _PAIR, r"named as (select a, b, round(s, 9) score, regexp_extract(x.source_path, '([^/]*)$', 1) x, regexp_extract(y.source_path, '([^/]*)$', 1) y from pairs join documents x on a = 'src:' || x.doc_id join documents y on b = 'src:' || y.doc_id where s >= 0.6)",
        r"tok as (select *, regexp_extract_all(lower(x), '[\p{L}\p{Nd}]+') u, regexp_extract_all(lower(y), '[\p{L}\p{Nd}]+') v from named)")
    + """select a, b, score from tok where not coalesce(list_sort(list_filter(list_distinct(u), lambda w: regexp_matches(w, '[0-9]'))) <> list_sort(list_filter(list_distinct(v), lambda w: regexp_matches(w, '[0-9]'))) or (contains(u, 'draft') <> contains(v, 'draft') and (contains(u, 'final') or contains(v, 'final'))) or (contains(u, 'final') <> contains(v, 'final') and (contains(u, 'draft') or contains(v, 'draft')))
        or (contains(u, 'primary') <> contains(v, 'primary') and (contains(u, 'secondary') or contains(v, 'secondary'))) or (contains(u, 'secondary') <> contains(v, 'secondary') and (contains(u, 'primary') or contains(v, 'primary'))), false)
        qualify row_number() over (partition by a order by score desc, b) = 1""",
    "ego_graph": X.with_(X.RELATIONS, X.GRAPH_ENTITIES, X.GRAPH_ALIASES, G._CLOSE, "c as (select canonical_id id from terminal where alias = 'supplier-7')", "near as (select id from graph_entities where type <> 'source' and (id in (select id from c) or id in (select source_id from relations where target_id in (select id from c) union all select target_id from relations where source_id in (select id from c))))", recursive=True) + "select source_id, target_id, relation from relations where source_id in (select id from near) and target_id in (select id from near)",
    "rerank_candidates": X.with_(X.ENTRIES, S._DOC, "c as (select k id, rank, ceil(length(substring(content, 1, 1600)) / 4)::bigint tokens from doc join entries on k = id where rank <= 15)", "s as (select *, sum(tokens) over (order by rank) spent from c)") + "select id, rank::integer rank, tokens, spent::bigint spent from (select *, max((spent > 8000)::integer) over (order by rank) o from s) where o = 0",
    "hydrated_top10": X.with_(X.ENTRIES, X.VECTORS, X.CHUNKS, S._DOC, S._VEC, S._CHUNK,
        "lists as (select 0 l, 0.7 w, c.doc_id k, x.k chunk, x.rank from chk x join chunks c on x.k = c.chunk_id union all select 1, 0.7, k, null, rank from doc union all select 2, 0.3, k, null, rank from vec)",
        "best as (select l, w, k, arg_min(chunk, rank) chunk, min(rank) rank from lists group by l, w, k)", "top as (select k, round(sum(round(w / (60 + rank), 15)), 9) score, arg_min(chunk, row(rank, l)) filter (chunk is not null) chunk from best group by k order by score desc, k limit 10)")
    + "select t.k doc_id, (row_number() over (order by score desc, t.k))::integer rank, coalesce(heading, '') heading, md5(coalesce(nullif(c.content, ''), e.content, '')) passage from top t left join chunks c on t.chunk = c.chunk_id left join entries e on t.k = e.id",
    "workspace_status": X.with_(X.CHUNKS, X.VECTORS, X.ITEMS) + """select 'entries' part, count(*) n from documents union all select 'chunks', count(*) from chunks union all select 'vectors', count(*) from vectors union all select 'entities', count(*) from (select distinct id from entities)
      union all select 'aliases', count(*) from entity_aliases where lower(trim(status)) = 'applied' union all select 'communities', count(*) from (select distinct id from communities) union all select 'pending', count(*) from items where tier < 3""",
    "query_hits": X.with_(X.ITEMS) + "select source_path, hits + coalesce(more, 0) hits from items left join (select user_id, count(*) more from events group by user_id) on doc_id = user_id",
    "lint_connections": X.with_(X.VECTORS, _PAIR, r"t as (select 'src:' || doc_id id, regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1) l from documents where text is not null)") + "select a, b, round(s, 6) score from pairs join t x on a = x.id join t y on b = y.id where s >= 0.7 and not list_has_any(x.l, y.l)",
}

SQL["entities_normalized"] = f"""with tr as ({SQL['triples_normalized']}), b as (select left(entity_type, 1) || left(created_at, 10) doc, trim(unnest([alias, canonical_id])) as name, lower(trim(entity_type)) as type, created_at pos from entity_aliases),
  c as (select doc, name, case when type in ('concept', 'technique', 'claim') then type else 'concept' end as type, pos from b where name <> '' and doc is not null),
  o as (select * from c qualify row_number() over (partition by doc, name order by pos nulls first, type) = 1), f as (select * from o qualify row_number() over (partition by doc order by pos nulls first, name) <= 40)
  select doc, name, type, pos from f where (doc, name) in (select (doc, source) from tr union select (doc, target) from tr)"""
