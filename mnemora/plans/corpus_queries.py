"""Queries on corpus upkeep and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import corpus, graph, vectors
from mnemora.plans import fixtures as X
from mnemora.plans import graph_queries as G
from mnemora.plans import search_queries as S
from mnemora.runtime import table


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.items(spark, sf_dir).where("doc_id % 11 <> 5").select(F.col("source_path").alias("path"), "hash", F.col("file_type").alias("type"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state before: some rows not there yet, some of another hash or type."""
    i = X.items(spark, sf_dir).where("doc_id % 10 <> 9")
    return i.select(F.col("source_path").alias("path"), F.when(F.col("doc_id") % 13 == 0, F.lit("sha256:old")).otherwise(F.col("hash")).alias("hash"), F.when(F.col("doc_id") % 17 == 0, F.lit("image")).otherwise(F.col("file_type")).alias("type"))


def source_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.diff(_current(spark, sf_dir), _manifest(spark, sf_dir))


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    committed = _manifest(spark, sf_dir).withColumn("deleted", F.pmod(F.length("path"), F.lit(5)) == 0)
    return corpus.change_feed(_current(spark, sf_dir), committed)


def manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = X.items(spark, sf_dir).select(F.col("source_path").alias("key"), F.col("hash").alias("value"), "doc_id")
    base = i.where("doc_id % 5 <> 4").select("key", "value")
    ours = i.where("doc_id % 7 <> 3").select("key", F.when(F.col("doc_id") % 3 == 0, F.lit("ours")).otherwise(F.col("value")).alias("value"))
    theirs = i.where("doc_id % 6 <> 1").select("key", F.when(F.col("doc_id") % 2 == 0, F.lit("theirs")).otherwise(F.col("value")).alias("value"))
    return corpus.merge_three_way(base, ours, theirs)


def compile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.items(spark, sf_dir).select("source_path", corpus.tiered_key(F.col("tier"), _parts()).alias("compile_key"))


def _parts(new: bool = False) -> dict:
    """What items were compiled with, of which some numbers have another by now."""
    n = F.col("doc_id")
    made = {"content": F.col("hash"), "pipeline": F.lit("p1"), "templates": F.col("file_type"), "models": F.lit("m1"), "config": F.concat(F.lit("c"), (n % 2).cast("string")), "embed": F.lit("e1")}
    return {p: F.when(n % (k + 4) == 0, F.concat(c, F.lit("+"))).otherwise(c) if new else c for k, (p, c) in enumerate(made.items())}


def drift_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of six parts is the first that an item would be compiled anew for."""
    i = X.items(spark, sf_dir)
    of = lambda new: i.select(F.col("source_path").alias("path"), *(c.alias(p) for p, c in _parts(new).items()))
    return corpus.drift(of(False), of(True), list(corpus.PARTS))


def reconcile_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = X.vectors(spark, sf_dir).select(F.concat(F.lit("docs/"), F.regexp_extract("id", r"(\d+)", 1), F.lit(".md")).alias("path"))
    return corpus.reconcile(_current(spark, sf_dir), _manifest(spark, sf_dir), vectors)


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("source"), F.explode(T.wikilinks(F.col("text"))).alias("name"))
    return links.distinct()


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.provenance(_concepts(spark, sf_dir))


def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of at least three sources."""
    return _concepts(spark, sf_dir).groupBy("name").agg(F.count("*").cast("int").alias("n_sources")).where("n_sources >= 3")


def removed_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbox documents removed: concepts with what is left of their sources."""
    removed = table(spark, sf_dir, "documents").where("source = 'inbox'").select(F.col("doc_id").alias("source"))
    kept, deferred = corpus.without_sources(_concepts(spark, sf_dir), removed)
    return kept.groupBy("name").agg(F.count("*").cast("int").alias("n_sources")).unionByName(deferred.select(F.concat(F.lit("deferred:"), F.col("source").cast("string")).alias("name"), F.lit(0).alias("n_sources")))


def removed_and_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts with what is left of their sources once inbox documents are gone for good."""
    removed = table(spark, sf_dir, "documents").where("source = 'inbox'").select(F.col("doc_id").alias("source"))
    kept, _ = corpus.without_sources(_concepts(spark, sf_dir), removed, prune=True)
    return kept.groupBy("name").agg(F.count("*").cast("int").alias("n_sources"))


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with passes done, leases and attempts, made of their numbers."""
    i = X.items(spark, sf_dir)
    n = F.col("doc_id")
    return i.select(
        F.col("source_path").alias("path"), F.when(n % 13 == 0, F.lit("sha256:old")).otherwise(F.col("hash")).alias("hash"), "size_bytes", "tier", "hits", "doc_id",
        F.when(n % 5 == 0, "error").otherwise("done").alias("status"), (n % 3).cast("int").alias("attempts"), F.when(n % 4 == 0, "worker-1").alias("lease"),
        (n % 2 == 0).alias("indexed"), (n % 3 == 0).alias("embedded"), (n % 9 != 0).alias("parsed"),
        F.when(n % 6 == 0, "").when(n % 6 == 1, F.lit(None).cast("string")).otherwise(F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("last_queried"), "ingested_at",
    )


def queue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with all their columns, flags stored as numbers read as booleans."""
    flags = ["indexed", "embedded", "parsed"]
    stored = _queue(spark, sf_dir).withColumns({f: F.col(f).cast("int") for f in flags})
    return stored.select("path", "hash", "size_bytes", "tier", "hits", "status", "attempts", F.coalesce("lease", F.lit("")).alias("lease"), *(F.col(f).cast("boolean").alias(f) for f in flags))


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of documents, those with fenced code with the names that it defines."""
    d = table(spark, sf_dir, "documents")
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^(?:def|func|class) (\w+)"), F.lit(1)))
    rows = d.select(F.coalesce("source_path", F.lit("")).alias("path"), F.coalesce("source_type", F.lit("article")).alias("type"), (F.col("doc_id") % 4).alias("tier"), "text", F.array_join(names, " ").alias("structure"), "doc_id")
    keyed = rows.withColumn("path", F.concat("path", F.lit("#"), F.col("doc_id").cast("string")))
    return corpus.index_entries(keyed).select("id", "tags", F.md5("content").alias("digest"))


def queue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = ["indexed", "embedded", "parsed"]
    old = _queue(spark, sf_dir).where("doc_id % 10 <> 9").select("path", "hash", "size_bytes", "status", "attempts", "lease", *flags)
    new = X.items(spark, sf_dir).where("doc_id % 11 <> 5").select(F.col("source_path").alias("path"), "hash", "size_bytes")
    return corpus.queue_upsert(old, new, flags)


def pending_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with an open pass, for each tier that has passes."""
    flags = {0: ["indexed"], 1: ["embedded"], 3: ["indexed", "embedded", "parsed"]}
    q = _queue(spark, sf_dir)
    parts = [corpus.pending(q, k, flags).select("path", F.lit(k).alias("of_tier")) for k in flags]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def promotion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a low tier that were asked for often."""
    return _queue(spark, sf_dir).where("tier <= 1 and hits >= 3").select("path", "tier", "hits")


def demotion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the highest tier last asked for, or, if never, put in, before a day; an empty instant is none."""
    last = F.nullif("last_queried", F.lit(""))
    put_in = F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _queue(spark, sf_dir).where((F.col("tier") == 3) & (F.coalesce(last, put_in) < "2024-10-01T00:00:00Z")).select("path", "last_queried")


def tiers_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("source_path is not null")
    own = F.when(F.col("doc_id") % 8 == 0, 3)
    files = d.select("source_path", own.alias("own")).groupBy(F.col("source_path").alias("path")).agg(F.max("own").alias("own"))
    folders = files.select(F.explode(F.array(F.regexp_extract("path", r"^([^/]+)/", 1), F.regexp_extract("path", r"^([^/]+/[^/]+)/", 1))).alias("folder")).where("folder <> ''").distinct()
    folders = folders.where(F.pmod(F.length("folder"), F.lit(3)) == 1).withColumn("tier", F.pmod(F.length("folder"), F.lit(4)))
    return corpus.resolved_tier(files, folders, {"md": 2, "txt": 0})


def coverage_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with how far it came, by path."""
    how = F.when(F.col("indexed") & F.col("embedded") & F.col("parsed"), "complete").when(F.col("indexed") | F.col("embedded") | F.col("parsed"), "partial").otherwise("none")
    return _queue(spark, sf_dir).select("path", how.alias("coverage")).orderBy("path")


def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each item is passed over or taken up again: the first rule that fits."""
    q, now = _queue(spark, sf_dir).where("doc_id % 10 <> 9"), X.items(spark, sf_dir).where("doc_id % 11 <> 5").select(F.col("source_path").alias("path"), F.col("hash").alias("now"))
    done = F.col("indexed") & F.col("embedded")
    rule = F.when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("hash"), "modified").when(~done, "resume").when(F.col("lease").isNull(), "adopt").otherwise("unchanged")
    return q.join(now, "path", "left").select("path", rule.alias("rule"))


def source_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a document, then those of the document of half its number, each once."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("tags", ","), lambda t: t != "").alias("t"))
    half = d.select(F.col("doc_id").alias("other"), F.col("t").alias("u"))
    return d.join(half, F.floor(F.col("doc_id") / 2) == F.col("other"), "left").select("doc_id", F.array_join(corpus.ordered_union(F.col("t"), F.col("u")), "|").alias("tags"))


def source_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as outputs that hold the hash of their document as it was."""
    c = table(spark, sf_dir, "chunks_meta").select(F.col("chunk_id").alias("output"), F.col("doc_id").alias("source")).distinct()
    was = _manifest(spark, sf_dir).select(F.concat(F.lit("src:"), F.regexp_extract("path", r"(\d+)", 1)).alias("source"), "hash")
    now = _current(spark, sf_dir).select(F.concat(F.lit("src:"), F.regexp_extract("path", r"(\d+)", 1)).alias("source"), "hash")
    return corpus.stale_outputs(c.join(was, "source"), now)


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the document of the next number as their source."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "[\r  　​]", " ").alias("text"))
    known = table(spark, sf_dir, "entities").where("name is not null").select("name")
    source = docs.select((F.col("id") - 1).alias("id"), F.col("text").alias("source_text"))
    return corpus.quality(docs.join(source, "id", "left"), known)


def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("ingested_at").cast("timestamp").alias("changed"))
    known = table(spark, sf_dir, "entities").where("name is not null").select("name")
    edges = graph.stated_relations(docs.where("text is not null"), "id", "text")
    return corpus.lint(docs, known, "2024-10-01 00:00:00", edges=edges, scores=quality_score(spark, sf_dir).select("id", "combined"))


def independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of customers' orders by the suppliers' hundreds that they draw on."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return corpus.independence(rows.select(F.col("o_custkey").alias("output"), F.col("l_orderkey").alias("confirmation"), (F.col("l_suppkey") % 10).alias("chunk")))


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of answers by group and status: no latency in sum where one is missing."""
    r = table(spark, sf_dir, "longmemeval_full").distinct()
    return r.groupBy("group_name", "status").agg(F.count("*").alias("calls"), F.sum("retrieved_count").alias("retrieved"), F.round(corpus.strict_sum(F.col("search_latency_ms")), 3).alias("latency"), corpus.one_or_mixed(F.col("judgment")).alias("judgment"))


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "longmemeval_full").distinct()
    p = lambda q: F.round(F.percentile("search_latency_ms", F.lit(q)), 6)
    return r.groupBy("group_name").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.avg("search_latency_ms"), 6).alias("mean"), F.round(F.count("search_latency_ms") * 1000 / F.nullif(F.sum("search_latency_ms"), F.lit(0)), 6).alias("qps"))


def latency_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.buckets(table(spark, sf_dir, "longmemeval_full"), "search_latency_ms", [50, 100, 250, 500, 1000, 2500, 5000])


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of answers that passed, that hold the truth, and mean score, by group."""
    r = table(spark, sf_dir, "longmemeval_full").distinct()
    return r.groupBy("group_name").agg(
        F.round(F.avg((F.col("judgment") == "PASS").cast("int")), 6).alias("pass_rate"), F.round(F.avg(T.is_grounded(F.col("generated_answer"), F.col("ground_truth")).cast("int")), 6).alias("fact_rate"), F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("n")
    )


def grounding_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each question's claims; 1 without any."""
    return table(spark, sf_dir, "longmemeval_full").groupBy("question_id").agg(F.coalesce(F.avg("score"), F.lit(1.0)).alias("grounding"))


def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of items by tier: how many, of what size, asked, in each status, and who took the last lease."""
    q = _queue(spark, sf_dir)
    holder = F.max_by("lease", F.when(F.col("lease").isNotNull(), F.struct("attempts", "path"))).alias("holder")
    return q.groupBy("tier").agg(
        F.count("*").alias("items"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("hits") >= 3).alias("asked"), F.round(F.avg("size_bytes"), 4).alias("mean_bytes"),
        F.count_if(F.col("indexed") & F.col("embedded")).alias("written"), F.count_if(F.col("status") == "error").alias("failed"), holder,
    )


def wiki_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of documents as a wiki: links that lead somewhere, documents with links, names that are linked, links a document, names linked often."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    links = d.select("doc_id", F.explode(F.array_distinct(T.wikilinks(F.col("text")))).alias("target")).select("doc_id", F.lower("target").alias("target")).distinct()
    names = table(spark, sf_dir, "entities").where("name is not null").select(F.lower("name").alias("target")).distinct()
    hit = links.join(names.withColumn("ok", F.lit(1)), "target", "left")
    per = hit.groupBy("target").agg(F.count("*").alias("n"), F.max("ok").alias("ok"))
    counts = hit.agg(F.count("*").alias("links"), F.count("ok").alias("whole"), F.countDistinct("doc_id").alias("linking"))
    names_linked = per.agg(F.count("ok").alias("linked"), F.count_if(F.col("n") >= 4).alias("hubs"))
    rows = counts.crossJoin(names_linked).crossJoin(d.agg(F.count("*").alias("docs"))).crossJoin(names.agg(F.count("*").alias("names")))  # one row each
    share = lambda a, b: F.round(F.col(a) / F.nullif(b, F.lit(0)), 6)
    return rows.select(share("whole", "links").alias("link_integrity"), F.round(1 - F.col("linking") / F.nullif("docs", F.lit(0)), 6).alias("orphan_rate"), share("linked", "names").alias("coverage"), share("links", "docs").alias("mean_degree"), "hubs")


def events_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest events of each user, and how many were dropped for them."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return corpus.bounded(e, "user_id", ["ts", "event_id"], 5).select("event_id", "user_id", "dropped")


def curation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of aliases folded into their targets, or dropped where a decision rejects them."""
    a = graph.latest_aliases(table(spark, sf_dir, "entity_aliases"))
    first = a.groupBy(F.col("alias").alias("name")).agg(F.min(F.struct("canonical_id", "status")).alias("m"))
    actions = first.select("name", F.when(F.col("m.status") == "rejected", "drop").when(F.col("m.status") == "applied", "fold").otherwise("keep").alias("action"), F.col("m.canonical_id").alias("into"))
    names = a.select(F.explode(F.array("alias", "canonical_id")).alias("name")).distinct()
    return corpus.curated(names, actions, vectors.never_merge)


def ondemand_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three sources on a topic that aren't compiled in full yet, of twice as many hits."""
    hits = S.bm25_list(spark, sf_dir, limit=6).select(F.substring("id", 5, 1_000_000).cast("long").alias("doc_id"), "rank")
    return hits.join(X.items(spark, sf_dir).where("tier < 3").select("doc_id", "source_path", "tier"), "doc_id").orderBy("rank").limit(3).select("source_path", "tier", "rank")


def learnings_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "communities").where("summary is not null").select(F.sha2("summary", 256).alias("id"), F.col("summary").alias("content"), F.col("updated_at").alias("created_at"))
    return corpus.prune_learnings(c, "2024-10-01T00:00:00Z")


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.exact_copies(table(spark, sf_dir, "documents"), "doc_id", "text")


def concept_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of entities, with their applied aliases' names."""
    names = table(spark, sf_dir, "entities").where("name is not null").select("name").distinct()
    return corpus.fold_concepts(names.withColumn("aliases", F.array(F.replace("name", F.lit("-"), F.lit(" ")))))


def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.upsert(_manifest(spark, sf_dir), _current(spark, sf_dir).where("type = 'notes'"), ["path"])


def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the catalogue of their sources: by kind and whether the language is the main one."""
    d, s = table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_catalog")
    rows = d.join(F.broadcast(s), "source", "left")  # the catalogue has one row a source and doesn't grow
    return rows.groupBy("kind", F.coalesce(F.lower(F.trim("lang")) == F.col("main_lang"), F.lit(False)).alias("main")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (source_diff, change_feed, manifest_merge, compile_keys, drift_class, reconcile_drift, provenance, evidence_gate, removed_cascade, wiki_scorecard, events_ring, curation_fold, ondemand_topic, removed_and_pruned, queue_rows, index_entries, queue_upsert, pending_by_tier, promotion_candidates, demotion_candidates, tiers_resolved, coverage_list, skip_reasons, source_unions, source_staleness, quality_score, lint_findings, independence, usage_rollup, latency_stats, latency_buckets, scorecard, grounding_mean, queue_stats, learnings_prune, exact_copies, concept_fold, keyed_upsert, source_types)
}

_CUR = "cur as (select source_path path, hash, file_type as type from items where doc_id % 11 <> 5)"
_MAN = "man as (select source_path path, case when doc_id % 13 = 0 then 'sha256:old' else hash end hash, case when doc_id % 17 = 0 then 'image' else file_type end as type from items where doc_id % 10 <> 9)"
_CON = r"con as (select distinct doc_id source, unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) as name from documents where text is not null)"
_QUEUE = """queue as (select i.source_path path, case when doc_id % 13 = 0 then 'sha256:old' else hash end hash, size_bytes, tier, hits, doc_id, case when doc_id % 5 = 0 then 'error' else 'done' end status, (doc_id % 3)::integer attempts,
  case when doc_id % 4 = 0 then 'worker-1' end as lease, doc_id % 2 = 0 as indexed, doc_id % 3 = 0 as embedded, doc_id % 9 <> 0 as parsed,
  case when doc_id % 6 = 0 then '' when doc_id % 6 = 1 then null else strftime(d.ingested_at, '%Y-%m-%dT%H:%M:%SZ') end last_queried, d.ingested_at from items i join documents d using (doc_id))"""
_HITS = " + ".join("(length(low) - length(replace(low, '" + p.replace("'", "''") + f"', ''))) / {len(p)}" for p in T.FILLER)

SQL = {
    "source_diff": X.with_(X.ITEMS, _CUR, _MAN) + "select * from (select coalesce(c.path, m.path) path, case when m.path is null then 'Added' when c.path is null then 'Removed' when c.hash <> m.hash or c.type <> m.type then 'Modified' end change from cur c full join man m on c.path = m.path) where change is not null",
    "change_feed": X.with_(X.ITEMS, _CUR, _MAN) + "select * from (select coalesce(c.path, m.path) path, case when c.path is not null and (m.path is null or length(m.path) % 5 = 0 or c.hash <> m.hash) then 'Upsert' when c.path is null and length(m.path) % 5 <> 0 then 'Delete' end op from cur c full join man m on c.path = m.path) where op is not null",
    "manifest_merge": X.with_(X.ITEMS) + """select * from (select source_path as key, case when o is distinct from b then o else t end as value from (select source_path, case when doc_id % 5 <> 4 then hash end b,
      case when doc_id % 7 <> 3 then case when doc_id % 3 = 0 then 'ours' else hash end end o, case when doc_id % 6 <> 1 then case when doc_id % 2 = 0 then 'theirs' else hash end end t from items)) where value is not null""",
    "compile_keys": X.with_(X.ITEMS) + "select source_path, sha256(array_to_string(case when tier < 3 then ['mnemora/v1', hash, 'p1', 'e1', 'c' || doc_id % 2] else ['mnemora/v1', hash, 'p1', file_type, 'm1', 'c' || doc_id % 2, 'e1'] end, chr(10))) compile_key from items",
    "drift_class": X.with_(X.ITEMS) + "select source_path path, case when doc_id % 4 = 0 then 'content' when doc_id % 5 = 0 then 'pipeline' when doc_id % 6 = 0 then 'templates' when doc_id % 7 = 0 then 'models' when doc_id % 8 = 0 then 'config' when doc_id % 9 = 0 then 'embed' else 'unchanged' end drift from items",
    "wiki_scorecard": r"""with d as (select doc_id, text from documents where text is not null), l as (select distinct doc_id, lower(unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1))) t from d), k as (select distinct lower(name) n from entities where name is not null)
      select round(count(*) filter (t in (select n from k)) / count(*), 6) link_integrity, round(1 - count(distinct doc_id) / (select count(*) from d), 6) orphan_rate, round(count(distinct t) filter (t in (select n from k)) / (select count(*) from k), 6) coverage,
        round(count(*) / (select count(*) from d), 6) mean_degree, (select count(*) from (select t from l group by t having count(*) >= 4)) hubs from l""",
    "events_ring": "select event_id, user_id, greatest(0, count(*) over (partition by user_id) - 5) dropped from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 5",
    "curation_fold": r"""with latest as (select alias, canonical_id, max(row(coalesce(decided_at, ''), lower(trim(status))))[2] status from entity_aliases where alias <> canonical_id group by 1, 2),
      f as (select alias as name, canonical_id as into_, status from latest qualify row_number() over (partition by alias order by canonical_id, status) = 1), n as (select alias as name from latest union select canonical_id from latest),
      t as (select n.name, f.into_, f.status, list_distinct(regexp_extract_all(lower(n.name), '[\p{L}\p{Nd}]+')) x, list_distinct(regexp_extract_all(lower(f.into_), '[\p{L}\p{Nd}]+')) y from n left join f on n.name = f.name),
      v as (select *, list_sort(list_filter(x, lambda w: regexp_matches(w, '[0-9]'))) <> list_sort(list_filter(y, lambda w: regexp_matches(w, '[0-9]')))
        or (contains(x, 'draft') <> contains(y, 'draft') and (contains(x, 'final') or contains(y, 'final'))) or (contains(x, 'final') <> contains(y, 'final') and (contains(x, 'draft') or contains(y, 'draft')))
        or (contains(x, 'primary') <> contains(y, 'primary') and (contains(x, 'secondary') or contains(y, 'secondary'))) or (contains(x, 'secondary') <> contains(y, 'secondary') and (contains(x, 'primary') or contains(y, 'primary'))) never from t)
      select name, case when coalesce(status = 'applied' and not never, false) then case when length(name) > length(into_) then name else into_ end else name end kept from v where status is distinct from 'rejected'""",
    "ondemand_topic": X.with_(X.ENTRIES, X.ITEMS, S._DOC) + "select source_path, tier, rank::integer rank from doc join items on k = 'src:' || doc_id where rank <= 6 and tier < 3 order by rank limit 3",
    "reconcile_drift": X.with_(X.ITEMS, X.VECTORS, _CUR, _MAN) + "select coalesce(c.path, m.path) path, case when c.path is null then 'drop' when m.path is null or c.hash <> m.hash then 'index' when coalesce(c.path, m.path) not in (select 'docs/' || regexp_extract(id, '(\\d+)', 1) || '.md' from vectors) then 'embed' else 'skip' end action from cur c full join man m on c.path = m.path",
    "provenance": X.with_(_CON) + "select source, count(distinct name) articles from con group by source",
    "evidence_gate": X.with_(_CON) + "select name, count(*)::integer n_sources from con group by name having count(*) >= 3",
    "removed_cascade": X.with_(_CON, "rem as (select doc_id source from documents where source = 'inbox')", "one as (select name from con group by name having count(*) = 1)", "def as (select distinct source from con where source in (select source from rem) and name in (select name from one))")
    + "select name, count(*)::integer n_sources from con where source not in (select source from rem where source not in (select source from def)) group by name union all select 'deferred:' || source, 0 from def",
    "removed_and_pruned": X.with_(_CON) + "select name, count(*)::integer n_sources from con where source not in (select doc_id from documents where source = 'inbox') group by name",
    "concept_fold": """with recursive n as (select distinct name, unnest([lower(trim(name)), lower(trim(replace(name, '-', ' ')))]) k from entities where name is not null), e as (select distinct x.name a, y.name b from n x join n y using (k)),
      r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a as name, b canonical from r qualify row_number() over (partition by a order by length(b) desc, b) = 1""",
    "queue_rows": X.with_(X.ITEMS, _QUEUE) + "select path, hash, size_bytes, tier, hits, status, attempts, coalesce(lease, '') as lease, indexed, embedded, parsed from queue",
    "index_entries": r"""with d as (select coalesce(source_path, '') || '#' || doc_id path, coalesce(source_type, 'article') t, doc_id % 4 tier, text, regexp_extract_all(text, '(?m)^(?:def|func|class) (\w+)', 1) l from documents where trim(coalesce(text, ''), ' ') <> ''),
      s as (select *, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') s from d)
      select 'src:' || path id, t || ',tier:' || tier || case when s <> '' then ',parsed' else '' end tags, md5(case when s <> '' then text || chr(10) || chr(10) || '---' || chr(10) || 'Structure:' || chr(10) || s else text end) digest from s""",
    "queue_upsert": X.with_(X.ITEMS, _QUEUE) + """select coalesce(o.path, n.path) path, coalesce(n.hash, o.hash) hash, coalesce(n.size_bytes, o.size_bytes) size_bytes, case when k then o.status else 'pending' end status, case when k then o.attempts else 0 end attempts,
      case when k then o.lease end as lease, k and indexed as indexed, k and embedded as embedded, k and parsed as parsed
      from (select o, n, o.path is not null and (n.path is null or o.hash = n.hash) k, o.indexed indexed, o.embedded embedded, o.parsed parsed from (select * from queue where doc_id % 10 <> 9) o full join (select source_path path, hash, size_bytes, doc_id from items where doc_id % 11 <> 5) n on o.path = n.path)""",
    "pending_by_tier": X.with_(X.ITEMS, _QUEUE) + "select path, 0 of_tier from queue where not indexed union all select path, 1 from queue where tier >= 1 and not embedded union all select path, 3 from queue where tier = 3 and not (indexed and embedded and parsed)",
    "promotion_candidates": X.with_(X.ITEMS, _QUEUE) + "select path, tier, hits from queue where tier in (0, 1) and hits >= 3",
    "demotion_candidates": X.with_(X.ITEMS, _QUEUE) + "select path, last_queried from queue where tier = 3 and case when last_queried is null or last_queried = '' then strftime(ingested_at, '%Y-%m-%dT%H:%M:%SZ') else last_queried end < '2024-10-01T00:00:00Z'",
    "tiers_resolved": r"""with f as (select source_path path, max(case when doc_id % 8 = 0 then 3 end) own from documents where source_path is not null group by 1),
      d as (select distinct regexp_extract(path, '^([^/]+)/', 1) d from f union select regexp_extract(path, '^([^/]+/[^/]+)/', 1) from f), t as (select d, length(d) % 4 tier from d where d <> '' and length(d) % 3 = 1)
      select path, coalesce(own, (select arg_max(tier, length(d)) from t where starts_with(path, d || '/')), case lower(regexp_extract(path, '\.([^./]+)$', 1)) when 'md' then 2 when 'txt' then 0 end, 1)::integer tier from f""",
    "coverage_list": X.with_(X.ITEMS, _QUEUE) + "select path, case indexed::integer + embedded::integer + parsed::integer when 3 then 'complete' when 0 then 'none' else 'partial' end coverage from queue order by path",
    "skip_reasons": X.with_(X.ITEMS, _QUEUE) + "select path, case when doc_id % 11 = 5 then 'removed' when doc_id % 13 = 0 then 'modified' when not (indexed and embedded) then 'resume' when lease is null then 'adopt' else 'unchanged' end rule from queue where doc_id % 10 <> 9",
    "source_unions": """with t as (select doc_id, list_filter(coalesce(str_split(tags, ','), []), lambda x: x <> '') t from documents), u as (select a.doc_id, list_concat(a.t, coalesce(b.t, [])) l from t a left join t b on a.doc_id // 2 = b.doc_id)
      select doc_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|'), '') tags from u""",
    "source_staleness": X.with_(X.ITEMS, _CUR, _MAN) + r"select distinct chunk_id output, c.doc_id source from chunks_meta c join man m on c.doc_id = 'src:' || regexp_extract(m.path, '(\d+)', 1) left join cur n on m.path = n.path where m.hash is distinct from n.hash",
    "quality_score": rf"""with d as (select doc_id id, regexp_replace(text, '[\r \x{{2028}}　​]', ' ', 'g') t from documents where text is not null), k as (select distinct name from entities where name is not null),
      l as (select id, unnest(regexp_extract_all(t, '\[\[([^\]]+)\]\]', 1)) target from d), w as (select id, avg(case when k.name is null then 0 else 1 end) wikilink from l left join k on l.target = k.name group by id),
      e as (select id, t, lower(t) low, octet_length(encode(t)) n from d)
      , sx as (select id - 1 id, generate_subscripts(l, 1) n, unnest(l) s from (select id, regexp_split_to_array(t, '[.!?\n]') l from d)),
      ww as (select id, n, list_filter(regexp_split_to_array(trim(s, ' '), '[\t-\r\x{{85}}\p{{Z}}]+'), lambda x: x <> '') w from sx),
      pp as (select id, n, i, lower(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) phrase from ww, (values (1), (2), (3), (4), (5)) v(i) where i <= len(w) - 2),
      ff as (select id, phrase, min(n * 10 + i) as place from pp where octet_length(encode(phrase)) >= 10 group by id, phrase), kk as (select id, phrase from ff qualify row_number() over (partition by id order by place) <= 50),
      kp as (select kk.id, count(*) np, count(*) filter (contains(low, phrase)) h from kk join e on kk.id = e.id group by kk.id),
      z as (select e.id, coalesce(wikilink, 1.0) wl, round(((starts_with(regexp_replace(t, '^\s+', ''), '---') and contains(t, 'concept:'))::integer + regexp_matches(t, '(?m)^## ')::integer + ((length(t) - length(replace(t, '```', ''))) / 3 % 2 = 0)::integer) / 3.0, 6) format,
        round(case when t = '' or s.t2 is null or s.t2 = '' then 0 else least(1.0, n / least(6000.0, greatest(400.0, octet_length(encode(t2)) * 0.15))) end, 6) coverage, round(coalesce(wikilink, 1.0), 6) wikilink, round(1 - least(1.0, 0.1 * ({_HITS})), 6) anti_pattern,
        case when t = '' or s.t2 is null or s.t2 = '' then 0 when kp.np is null then 1 else kp.h / kp.np end g0,
        round(g0, 6) grounding, ((starts_with(regexp_replace(t, '^\s+', ''), '---') and contains(t, 'concept:'))::integer + regexp_matches(t, '(?m)^## ')::integer + ((length(t) - length(replace(t, '```', ''))) / 3 % 2 = 0)::integer) / 3.0 f0,
        case when t = '' or s.t2 is null or s.t2 = '' then 0 else least(1.0, n / least(6000.0, greatest(400.0, octet_length(encode(t2)) * 0.15))) end c0, 1 - least(1.0, 0.1 * ({_HITS})) a0
      from e left join w on e.id = w.id left join (select id - 1 id, t t2 from d) s on e.id = s.id left join kp on e.id = kp.id)
      select id, format, grounding, coverage, wikilink, anti_pattern, round(0.15 * f0 + 0.3 * g0 + 0.2 * c0 + 0.15 * w0 + 0.2 * a0, 6) combined from (select *, wl w0 from z)""",
    "lint_findings": r"""with d as (select doc_id id, replace(coalesce(text, ''), chr(13), '') t, ingested_at from documents), k as (select distinct lower(name) n from entities where name is not null),
      f as (select distinct id, 'completeness' rule, x detail from (select id, unnest(regexp_extract_all(t, '\[\[([^\]]+)\]\]', 1)) x from d) where lower(x) not in (select n from k)
        union all select id, 'style', 'no front matter' from d where t <> '' and not regexp_matches(t, '^﻿?---\n')
        union all select distinct id, 'impute', unnest(regexp_extract_all(t, '\b(TODO|UNKNOWN|TBD)\b', 1)) from d
        union all select distinct id, 'short section', trim(regexp_extract(s, '^#{1,6}[ \t]+([^\n]*)', 1)) from (select id, unnest(str_split(regexp_replace(t, '\n(#{1,6}[ \t])', chr(1) || '\1', 'g'), chr(1))) s from d) where starts_with(s, '#') and length(trim(regexp_replace(s, '^#{1,6}[^\n]*\n?', ''))) < 50
        union all select id, 'staleness', '' from d where ingested_at < timestamp '2024-10-01' - interval 90 days)
      select id, rule, detail from f
      union all select distinct source_id::bigint, 'consistency', target_id from _rel where relation = 'contradicts' union all select id, 'quality', combined::varchar from _q where combined < 0.5""",
    "independence": """with c as (select distinct o_custkey output, l_orderkey k, l_suppkey % 10 chunk from lineitem join orders on l_orderkey = o_orderkey), s as (select output, k, list(chunk) l from c group by output, k),
      p as (select x.output, 1 - len(list_intersect(x.l, y.l)) / (len(x.l) + len(y.l) - len(list_intersect(x.l, y.l))) d from s x join s y on x.output = y.output and x.k < y.k), n as (select output, count(*) n from s group by output)
      select n.output, round(coalesce(avg(d), 0), 6) independence, n from n left join p on n.output = p.output group by n.output, n""",
    "usage_rollup": "select group_name, status, count(*) calls, sum(retrieved_count)::bigint retrieved, round(case when count(*) > count(search_latency_ms) then null else sum(search_latency_ms) end, 3) latency, case when count(distinct judgment) = 0 then '' when count(distinct judgment) = 1 then max(judgment) else 'mixed' end judgment from (select distinct * from longmemeval_full) group by group_name, status",
    "latency_stats": "select group_name, round(quantile_cont(search_latency_ms, 0.5), 6) p50, round(quantile_cont(search_latency_ms, 0.95), 6) p95, round(avg(search_latency_ms), 6) mean, round(count(search_latency_ms) * 1000 / nullif(sum(search_latency_ms), 0), 6) qps from (select distinct * from longmemeval_full) group by group_name",
    "latency_buckets": "select le::double le, count(*) filter (search_latency_ms <= le) n from longmemeval_full, (values (50), (100), (250), (500), (1000), (2500), (5000)) b(le) group by le",
    "scorecard": r"""select group_name, round(avg((judgment = 'PASS')::integer), 6) pass_rate, round(avg(coalesce(trim(regexp_replace(lower(ground_truth), '\s+', ' ', 'g')) <> '' and contains(trim(regexp_replace(lower(generated_answer), '\s+', ' ', 'g')), trim(regexp_replace(lower(ground_truth), '\s+', ' ', 'g'))), false)::integer), 6) fact_rate,
      round(avg(score), 6) mean_score, count(*) n from (select distinct * from longmemeval_full) group by group_name""",
    "grounding_mean": "select question_id, coalesce(avg(score), 1.0) grounding from longmemeval_full group by question_id",
    "queue_stats": X.with_(X.ITEMS, _QUEUE) + "select tier, count(*) items, sum(size_bytes)::bigint bytes, count(*) filter (hits >= 3) asked, round(avg(size_bytes), 4) mean_bytes, count(*) filter (indexed and embedded) written, count(*) filter (status = 'error') failed, arg_max(lease, row(attempts, path)) filter (lease is not null) as holder from queue group by tier",
    "learnings_prune": "select id, created_at, content from (select sha256(summary) id, min(updated_at) created_at, min(summary) as content from communities where summary is not null group by 1) where created_at >= '2024-10-01T00:00:00Z' order by created_at desc, id limit 500",
    "exact_copies": "select doc_id, min(doc_id) over (partition by text) group_id, count(*) over (partition by text) copies from documents where coalesce(text, '') <> ''",
    "keyed_upsert": X.with_(X.ITEMS, _CUR, _MAN, "new as (select * from cur where type = 'notes')") + "select * from man where path not in (select path from new) union all select * from new",
    "source_types": "select kind, coalesce(lower(trim(lang)) = main_lang, false) main, count(*) docs, sum(n_chars)::bigint chars from documents d left join source_catalog s on d.source = s.source group by 1, 2",
}

_REL = G.SQL["stated_relations"].replace("'src:' || doc_id", "doc_id::varchar")
SQL["lint_findings"] = SQL["lint_findings"].replace("with d as", f"with _rel as ({_REL}), _q as ({SQL['quality_score']}), d as", 1)
