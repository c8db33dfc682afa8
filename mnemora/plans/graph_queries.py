"""Queries on the entity graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.operators import graph
from mnemora.plans import fixtures as X
from mnemora.runtime import table

#: Instant between the dates of the edges.
AT = "1998-01-01T00:00:00Z"
SEEDS = ["supplier-1", "supplier-2", "customer-4"]


def _ids(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.relations(spark, sf_dir)
    return graph.link_aliases(r, r, X.graph_aliases(spark, sf_dir))


def edge_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.edge_view(X.relations(spark, sf_dir), _derived(spark, sf_dir))
    return rows.select("source_id", "target_id", "relation", "alias_id", "valid_from")


def live_edges_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.relations(spark, sf_dir).where(graph.live_at(AT)).select(*graph.KEY, "valid_from")


def entity_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(graph.edge_view(X.relations(spark, sf_dir), _derived(spark, sf_dir)))


def connection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that leave and that reach each entity."""
    r = X.relations(spark, sf_dir)
    out = r.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("n_out"))
    into = r.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n_in"))
    rows = X.graph_entities(spark, sf_dir).select("id").join(out, "id", "left").join(into, "id", "left").na.fill(0)
    return rows.select("id", "n_out", "n_in", (F.col("n_out") + F.col("n_in")).alias("connections"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, but for sources, that no alias links to another."""
    a = table(spark, sf_dir, "entity_aliases").where("canonical_id is not null").select(F.col("alias").alias("source_id"), F.col("canonical_id").alias("target_id"))
    linked = graph.both_ways(a).select("id")
    return table(spark, sf_dir, "entities").where("id is not null and type <> 'source'").select("id", "type").distinct().join(linked, "id", "left_anti")


def cites_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, e = X.relations(spark, sf_dir), X.graph_entities(spark, sf_dir)
    return graph.citing(r, e).select("id", F.lit("cites").alias("side")).unionByName(graph.citing(r, e, cited=True).select("id", F.lit("cited").alias("side")))


def traverse_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(X.relations(spark, sf_dir), _ids(spark, "nation-3"), 2).select("id", "depth")


def traverse_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier reaches along edges."""
    starts = X.graph_entities(spark, sf_dir).where("id like 'supplier-%'").select("id")
    return graph.neighbors(X.relations(spark, sf_dir), starts, 3, "out").select("start", "id", "depth")


def traverse_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred ids around two nations, and whether there are more."""
    reached = graph.neighbors(X.relations(spark, sf_dir), _ids(spark, "nation-3", "nation-4"), 2)
    return graph.capped(reached, 100).select("start", "id", "depth", "partial")


def edges_of_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What some ids are linked to by one relation, at either end."""
    return graph.neighbors(X.relations(spark, sf_dir), _ids(spark, "nation-3", "supplier-4"), 1, "both", "extends").select("start", "id")


def canonical_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.canonical(X.graph_aliases(spark, sf_dir))


def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the aliases whose row decided last is applied."""
    a = graph.latest_aliases(table(spark, sf_dir, "entity_aliases")).where("status = 'applied'")
    return graph.components(a.select(F.col("alias").alias("a"), F.col("canonical_id").alias("b")))


def pair_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending pairs that others between their components block."""
    return graph.pair_conflicts(graph.latest_aliases(table(spark, sf_dir, "entity_aliases")))


def free_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entities of one name that no decision rejects, in either direction."""
    a = graph.latest_aliases(table(spark, sf_dir, "entity_aliases"))
    pairs = a.select(F.least("alias", "canonical_id").alias("a"), F.greatest("alias", "canonical_id").alias("b")).distinct()
    return graph.rejected_either_way(pairs, a)


def alias_unlink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived edges left once the aliases of suppliers whose number ends in 7 are taken back."""
    gone = X.graph_aliases(spark, sf_dir).where("alias like '%7'").select("alias")
    aliases = X.graph_aliases(spark, sf_dir).withColumn("status", F.lit("applied"))
    derived, marked = graph.unlink(_derived(spark, sf_dir), aliases, gone)
    kept = derived.groupBy("alias_id").agg(F.count("*").alias("edges"))
    return marked.select(F.col("alias").alias("alias_id"), "status").join(kept, "alias_id", "left").na.fill(0, ["edges"])


def supersession_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triggered(X.relations(spark, sf_dir), ["optimizes"], 0.3)


def cluster_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of aliases as clusters of their aliases, as a model might propose them."""
    a = table(spark, sf_dir, "entity_aliases").where("alias is not null and canonical_id is not null")
    rows = a.select(F.col("canonical_id").alias("cluster"), F.col("alias").alias("pos"), F.col("alias").alias("id"), (F.col("confidence") * 1.3 - 0.1).alias("confidence"))
    return graph.guarded_clusters(rows, table(spark, sf_dir, "entities").where("id is not null").select("id"), ["ada"])


def link_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir).select("alias_id", "source_id", "target_id", "relation")


def alias_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sweep(X.relations(spark, sf_dir), X.graph_aliases(spark, sf_dir)).select("alias_id", "source_id", "target_id", "relation")


def graph_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = X.relations(spark, sf_dir).where(graph.live_at(X.NOW))
    return graph.graph_leg(r, X.graph_entities(spark, sf_dir), X.graph_aliases(spark, sf_dir), ["supplier", "7", "priority", "1"], 10)


def relevance_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.relevance(X.relations(spark, sf_dir), X.graph_entities(spark, sf_dir), _ids(spark, *SEEDS), X.NOW, aliases=X.graph_aliases(spark, sf_dir))


def serialize_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.serialize(X.relations(spark, sf_dir), X.graph_entities(spark, sf_dir), _ids(spark, *SEEDS))


def graph_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple circles among aliases, of any length."""
    a = table(spark, sf_dir, "entity_aliases").where("canonical_id is not null")
    return graph.cycles(a.select(F.col("alias").alias("source_id"), F.col("canonical_id").alias("target_id")))


def entity_upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of entities as upserts, in the order of their update."""
    e = table(spark, sf_dir, "entities").where("id is not null").distinct()
    seq = F.concat_ws("|", F.coalesce("updated_at", F.lit("")), F.coalesce("created_at", F.lit("")), F.coalesce("name", F.lit("")), F.coalesce("definition", F.lit("")), F.coalesce("article_path", F.lit("")), F.coalesce("metadata", F.lit("")), F.coalesce("type", F.lit("")))
    return graph.fold_entities(e.withColumn("seq", seq))


def _orders_as_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("customer-"), F.col("o_custkey").cast("string")).alias("source_id"), F.concat(F.lit("priority-"), F.substring("o_orderpriority", 1, 1)).alias("target_id"), F.lit("optimizes").alias("relation"),
        (F.floor(F.col("o_totalprice") / 10000) / 100).alias("confidence"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("evidence"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("valid_from"), F.col("o_orderkey").alias("seq"),
    )


def relation_upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = F.when(F.col("seq") % 50 == 0, F.lit("rumoured")).otherwise(F.col("relation"))
    return graph.fold_relations(_orders_as_upserts(spark, sf_dir).withColumn("relation", unknown), ["optimizes"])


def alias_upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "entity_aliases").where("canonical_id is not null").distinct()
    seq = F.concat_ws("|", F.coalesce("decided_at", F.lit("")), F.coalesce("created_at", F.lit("")), F.coalesce("status", F.lit("")), F.coalesce("reason", F.lit("")), F.coalesce("source", F.lit("")))
    return graph.fold_aliases(a.withColumn("status", F.lower(F.trim("status"))).withColumn("seq", seq))


def functional_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier, under whatever name, keeps the part that it delivered last."""
    forms = graph.canonical(X.graph_aliases(spark, sf_dir)).select(F.col("alias").alias("id"), F.col("canonical_id").alias("root"))
    return graph.supersede(X.relations(spark, sf_dir), forms, "cites").select("source_id", "target_id", "valid_from", "valid_to")


_NAME = r"[^\p{L}\p{Nd}]+"


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Entities with a name, and its words."""
    e = table(spark, sf_dir, "entities").where("id is not null and type is not null and name is not null").groupBy("id").agg(F.max("type").alias("type"), F.max("name").alias("name"))
    return e, F.filter(F.split(F.lower(F.regexp_replace("name", _NAME, " ")), " "), lambda w: F.length(w) >= 2)


def alias_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of names, see alias_classes, with a word that at most 60 names or 5 % of the type's entities have."""
    return graph.blocks(*_named(spark, sf_dir), 60, 0.05)


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of the pairs of alias_blocks that no decision rejects."""
    return graph.rejected_either_way(alias_blocks(spark, sf_dir), graph.latest_aliases(table(spark, sf_dir, "entity_aliases")))


def alias_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each entity with a name: the smallest id of its type with the same words."""
    return graph.name_classes(*_named(spark, sf_dir)).select("id", "class")


def elect_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each component of aliases, among ids with a row in entities."""
    e = table(spark, sf_dir, "entities").where("id is not null").select("id", "article_path", "created_at").distinct()
    return graph.elect(alias_components(spark, sf_dir).join(e, "id"), "component")


def community_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.community_edges(X.relations(spark, sf_dir), X.graph_entities(spark, sf_dir), X.NOW).select(*graph.KEY)


def _by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities put to the nation they belong to, others by their own id."""
    r = X.relations(spark, sf_dir).where("relation in ('extends', 'implements')").select(F.col("source_id").alias("id"), F.col("target_id").alias("community"))
    e = X.graph_entities(spark, sf_dir).where("type <> 'source'").select("id").distinct()
    return e.join(r, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.community_edges(X.relations(spark, sf_dir), X.graph_entities(spark, sf_dir), X.NOW)
    return graph.modularity(edges, _by_nation(spark, sf_dir))


def label_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = graph.community_edges(X.relations(spark, sf_dir), X.graph_entities(spark, sf_dir), X.NOW)
    return graph.label_communities(edges)


def member_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.member_hash(_by_nation(spark, sf_dir), "community")


def community_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pick_level(table(spark, sf_dir, "communities").where("level is not null").dropDuplicates(["id", "level", "summary", "member_count"]))


def related_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share parts."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("concept"), F.col("l_partkey").alias("source")).distinct()
    return graph.related(p)


def stated_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stated_relations(table(spark, sf_dir, "documents").where("text is not null").withColumn("id", F.concat(F.lit("src:"), F.col("doc_id").cast("string"))), "id", "text")


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left once the claims are deleted."""
    e, r = X.graph_entities(spark, sf_dir), X.relations(spark, sf_dir)
    left = graph.without(e, r, _derived(spark, sf_dir), e.where("type = 'claim'").select("id"))
    key = lambda df, part: df.select(F.lit(part).alias("part"), "source_id", "target_id", "relation")
    alone = left[0].select(F.lit("entities").alias("part"), F.col("id").alias("source_id"), F.lit("").alias("target_id"), F.lit("").alias("relation"))
    return alone.unionByName(key(left[1], "relations")).unionByName(key(left[2], "derived"))


QUERIES = {
    f.__name__: f
    for f in (edge_view, live_edges_asof, entity_degree, connection_counts, orphans, cites_semi_join, traverse_depth2, traverse_capped, edges_of_relation, traverse_out, canonical_closure, alias_components, pair_conflicts, free_blocks, alias_unlink, supersession_triggers, cluster_guards, link_aliases, alias_sweep, graph_leg, relevance_signals, serialize_subgraph, graph_cycles, entity_upsert_fold, relation_upsert_fold, alias_upsert_fold, functional_supersession, alias_blocks, candidate_pairs, alias_classes, elect_canonical, community_input, modularity, label_communities, member_hash, community_level, related_top8, stated_relations, delete_cascade)
}

_LIVE = lambda t: f"(valid_from = '' or valid_from <= '{t}') and (valid_to = '' or valid_to > '{t}')"
_DERIVED = """derived as (select distinct * from (
  select a.alias alias_id, a.canonical_id source_id, r.target_id, r.relation from relations r join graph_aliases a on r.source_id = a.alias
  union all select a.alias, r.source_id, a.canonical_id, r.relation from relations r join graph_aliases a on r.target_id = a.alias) d
  where source_id <> target_id and not exists (select 1 from relations r where r.source_id = d.source_id and r.target_id = d.target_id and r.relation = d.relation))"""
_WAYS = "ways as (select source_id id, target_id other, relation, valid_from, valid_to from relations union all select target_id, source_id, relation, valid_from, valid_to from relations)"
_LAST = "latest as (select alias, canonical_id, max(row(coalesce(decided_at, ''), lower(trim(status))))[2] status from entity_aliases where alias <> canonical_id group by 1, 2)"
_COMP = _LAST + """, links as (select alias a, canonical_id b from latest where status = 'applied' union select canonical_id, alias from latest where status = 'applied'),
reach as (select a id, b other from links union select r.id, l.b from reach r join links l on r.other = l.a), comp as (select id, least(id, min(other)) component from reach group by id)"""
_CLOSE = "chain as (select alias, canonical_id spot, 1 n from graph_aliases union all select c.alias, a.canonical_id, n + 1 from chain c join graph_aliases a on c.spot = a.alias where n < 40), terminal as (select alias, arg_max(spot, n) canonical_id from chain group by alias)"
_SEEDS = "seeds(id) as (values " + ", ".join(f"('{s}')" for s in SEEDS) + ")"
_NATION = "member as (select distinct e.id, coalesce(r.target_id, e.id) community from graph_entities e left join relations r on e.id = r.source_id and r.relation in ('extends', 'implements') where e.type <> 'source')"
_CEDGES = f"cedges as (select r.* from relations r join graph_entities s on r.source_id = s.id join graph_entities t on r.target_id = t.id where relation <> 'cites' and source_id <> target_id and s.type <> 'source' and t.type <> 'source' and {_LIVE(X.NOW)})"
_AFF = ", ".join(f"('{a}', '{b}', {v})" for (x, y), v in graph.AFFINITY.items() for a, b in sorted({(x, y), (y, x)}))
_WORDS = ", ".join(f"('{r}', '{w}')" for r, ws in graph.RELATION_WORDS.items() for w in ws)

SQL = {
    "edge_view": X.with_(X.RELATIONS, X.GRAPH_ALIASES, "d0 as (select a.alias alias_id, a.canonical_id source_id, r.target_id, r.relation, r.valid_from from relations r join graph_aliases a on r.source_id = a.alias union all select a.alias, r.source_id, a.canonical_id, r.relation, r.valid_from from relations r join graph_aliases a on r.target_id = a.alias)")
    + "select source_id, target_id, relation, '' alias_id, valid_from from relations union all select source_id, target_id, relation, alias_id, valid_from from d0 where source_id <> target_id and (source_id, target_id, relation) not in (select (source_id, target_id, relation) from relations) qualify row_number() over (partition by source_id, target_id, relation order by alias_id) = 1",
    "live_edges_asof": X.with_(X.RELATIONS) + f"select source_id, target_id, relation, valid_from from relations where {_LIVE(AT)}",
    "entity_degree": X.with_(X.RELATIONS, X.GRAPH_ALIASES, _DERIVED, "view as (select source_id, target_id, relation from relations union all select distinct source_id, target_id, relation from derived)")
    + "select id, count(*) degree from (select source_id id from view union all select target_id from view where source_id <> target_id) group by id",
    "connection_counts": X.with_(X.RELATIONS, X.GRAPH_ENTITIES) + "select id, coalesce(o, 0) n_out, coalesce(i, 0) n_in, coalesce(o, 0) + coalesce(i, 0) connections from graph_entities left join (select source_id, count(*) o from relations group by 1) on id = source_id left join (select target_id, count(*) i from relations group by 1) on id = target_id",
    "orphans": "select distinct id, type from entities where id is not null and type <> 'source' and id not in (select alias from entity_aliases where canonical_id is not null union all select canonical_id from entity_aliases where canonical_id is not null)",
    "cites_semi_join": X.with_(X.RELATIONS, X.GRAPH_ENTITIES) + "select id, 'cites' side from graph_entities where id in (select source_id from relations where relation = 'cites') union all select id, 'cited' from graph_entities where id in (select target_id from relations where relation = 'cites')",
    "traverse_depth2": X.with_(X.RELATIONS, _WAYS, "one as (select distinct other id from ways where id = 'nation-3'), two as (select distinct w.other id from one join ways w on one.id = w.id)") + "select id, min(depth)::integer depth from (select id, 1 depth from one union all select id, 2 from two) where id <> 'nation-3' group by id",
    "traverse_out": X.with_(X.RELATIONS, "walk as (select source_id start, target_id id, 1 depth from relations where source_id like 'supplier-%' union all select w.start, r.target_id, depth + 1 from walk w join relations r on w.id = r.source_id where depth < 3)", recursive=True) + "select start, id, min(depth)::integer depth from walk where start <> id group by start, id",
    "traverse_capped": X.with_(X.RELATIONS, _WAYS, "st(s) as (values ('nation-3'), ('nation-4'))", "one as (select distinct s, other id from st join ways on s = id), two as (select distinct s, w.other id from one join ways w on one.id = w.id)",
        "al as (select s start, id, min(depth)::integer depth from (select s, id, 1 depth from one union all select s, id, 2 from two) where id <> s group by s, id)")
    + "select start, id, depth, count(*) over (partition by start) > 100 partial from al qualify row_number() over (partition by start order by depth, id) <= 100",
    "edges_of_relation": X.with_(X.RELATIONS, _WAYS, "st(s) as (values ('nation-3'), ('supplier-4'))") + "select distinct s start, other id from st join ways on s = id where relation = 'extends' and other <> s",
    "alias_sweep": X.with_(X.RELATIONS, X.GRAPH_ALIASES, "e as (select source_id s, target_id t, relation r from relations)",
        "d as (select a.alias alias_id, case when s = a.alias then a.canonical_id else s end s, case when s = a.alias then t else a.canonical_id end t, r from e join graph_aliases a on s = a.alias or t = a.alias where case when s = a.alias then a.canonical_id else s end <> case when s = a.alias then t else a.canonical_id end and (case when s = a.alias then a.canonical_id else s end, case when s = a.alias then t else a.canonical_id end, r) not in (select (s, t, r) from e)"
        " union select a.alias, case when s = a.alias then a.canonical_id else s end, case when s = a.alias then t else a.canonical_id end, r from d join graph_aliases a on s = a.alias or t = a.alias where case when s = a.alias then a.canonical_id else s end <> case when s = a.alias then t else a.canonical_id end and (case when s = a.alias then a.canonical_id else s end, case when s = a.alias then t else a.canonical_id end, r) not in (select (s, t, r) from e))", recursive=True)
    + "select alias_id, s source_id, t target_id, r relation from d",
    "canonical_closure": X.with_(X.GRAPH_ALIASES, _CLOSE, recursive=True) + "select alias, canonical_id from terminal",
    "alias_components": X.with_(_COMP, recursive=True) + "select id, component from comp",
    "pair_conflicts": X.with_(_COMP, "o as (select l.*, coalesce(x.component, l.alias) x, coalesce(y.component, l.canonical_id) y from latest l left join comp x on l.alias = x.id left join comp y on l.canonical_id = y.id where status in ('rejected', 'pending'))",
        "n as (select least(x, y) a, greatest(x, y) b, count(distinct (least(alias, canonical_id), greatest(alias, canonical_id))) n from o group by 1, 2)", recursive=True)
    + "select alias, canonical_id, n - 1 blockers from o join n on least(x, y) = a and greatest(x, y) = b where status = 'pending' and n > 1",
    "free_blocks": X.with_(_LAST) + "select distinct least(alias, canonical_id) a, greatest(alias, canonical_id) b from latest where (least(alias, canonical_id), greatest(alias, canonical_id)) not in (select (least(alias, canonical_id), greatest(alias, canonical_id)) from latest where status = 'rejected')",
    "alias_unlink": X.with_(X.RELATIONS, X.GRAPH_ALIASES, _DERIVED) + "select alias alias_id, case when alias like '%7' then 'rejected' else 'applied' end status, case when alias like '%7' then 0 else (select count(*) from derived where alias_id = alias) end edges from graph_aliases",
    "supersession_triggers": X.with_(X.RELATIONS) + "select source_id, target_id, relation, case when confidence >= 0.3 then 'supersede' else 'conflict' end action from relations where relation = 'optimizes'",
    "cluster_guards": """with m as (select alias id, canonical_id cluster, confidence from entity_aliases where alias is not null and canonical_id is not null and alias <> 'ada' and alias in (select id from entities where id is not null)),
      f as (select id, cluster, confidence from m qualify row_number() over (partition by id order by cluster, confidence nulls first) = 1)
      select cluster, id, greatest(0.0, least(1.0, coalesce(confidence * 1.3 - 0.1, 0.0))) confidence from f where cluster in (select cluster from f group by cluster having count(*) >= 2)""",
    "link_aliases": X.with_(X.RELATIONS, X.GRAPH_ALIASES, _DERIVED) + "select alias_id, source_id, target_id, relation from derived",
    "graph_leg": X.with_(X.RELATIONS, X.GRAPH_ENTITIES, X.GRAPH_ALIASES, _WAYS, _CLOSE, "named(id) as (values ('supplier'), ('7'), ('priority'), ('1'), ('supplier-7'), ('7-priority'), ('priority-1'), ('supplier-7-priority'), ('7-priority-1'))",
        "seed as (select distinct coalesce(t.canonical_id, n.id) id from named n left join terminal t on n.id = t.alias)", "h0 as (select id, 0.0::double score from seed where id in (select id from graph_entities))",
        f"cost as (select id, other, min(1 / case relation when 'cites' then 0.7 when 'contradicts' then 1.1 else 1.0 end) c from ways where {_LIVE(X.NOW)} group by id, other)",
        "h1 as (select id, min(score) score from (select * from h0 union all select c.other, score + c.c from h0 join cost c on h0.id = c.id) group by id)",
        "h2 as (select id, min(score) score from (select * from h1 union all select c.other, score + c.c from h1 join cost c on h1.id = c.id) group by id)", recursive=True) + "select h2.id, round(score, 9) score from h2 join graph_entities e on h2.id = e.id where article_path <> '' order by round(score, 9), h2.id limit 50",
    "relevance_signals": X.with_(X.RELATIONS, X.GRAPH_ENTITIES, X.GRAPH_ALIASES, _CLOSE, _WAYS, _SEEDS.replace("seeds(id)", "named(id)"), "seeds as (select distinct coalesce(canonical_id, id) id from named left join terminal on id = alias)", f"plain as (select distinct id, other from ways where relation <> 'cites' and {_LIVE(X.NOW)})",
        "w1 as (select s.id start, p.other id from seeds s join plain p on s.id = p.id), w2 as (select start, id from w1 union select w1.start, p.other from w1 join plain p on w1.id = p.id)",
        "direct as (select id, count(distinct start)::double v from w2 where start <> id group by id)",
        "cited as (select distinct source_id, target_id from relations where relation = 'cites' and source_id in (select id from seeds))",
        "overlap as (select c.source_id id, count(*) / (select count(*) from cited) v from (select distinct source_id, target_id from relations where relation = 'cites') c join cited d on c.target_id = d.target_id where c.source_id in (select id from graph_entities where article_path <> '') group by c.source_id)",
        "cand as (select id from direct union select id from overlap), deg as (select id, count(*) n from ways group by id)",
        "mids as (select distinct p.other id from seeds s join plain p on s.id = p.id), common as (select c.id, sum(1 / ln(d.n)) v from cand c join plain p on c.id = p.id join mids m on p.other = m.id join deg d on m.id = d.id where d.n > 1 group by c.id)",
        f"aff(s, t, v) as (values {_AFF})", "ta as (select k.type, avg(coalesce(a.v, 1.0)) v from (select distinct type from graph_entities) k, (select e.type from graph_entities e join seeds s on e.id = s.id) s left join aff a on a.s = s.type and a.t = k.type group by k.type)", recursive=True)
    + """select c.id, round(3 * coalesce(d.v, 0) + 4 * coalesce(o.v, 0) + 1.5 * coalesce(m.v, 0) + coalesce(t.v, 0), 6) score, round(coalesce(d.v, 0), 6) direct_link, round(coalesce(o.v, 0), 6) source_overlap, round(coalesce(m.v, 0), 6) common_neighbor, round(coalesce(t.v, 0), 6) type_affinity
      from cand c join graph_entities e on c.id = e.id left join direct d on c.id = d.id left join overlap o on c.id = o.id left join common m on c.id = m.id left join ta t on e.type = t.type where e.article_path <> '' and c.id not in (select id from seeds) order by score desc, c.id limit 10""",
    "serialize_subgraph": X.with_(X.RELATIONS, X.GRAPH_ENTITIES, _WAYS, _SEEDS, "r1 as (select distinct source_id, target_id, relation from relations where source_id in (select id from seeds) or target_id in (select id from seeds))",
        "n1 as (select source_id id from r1 union select target_id from r1), r2 as (select distinct source_id, target_id, relation from relations where source_id in (select id from n1) or target_id in (select id from n1))",
        "al as (select *, 1 hop from r1 union all select *, 2 from (select * from r2 except select * from r1)), few as (select *, row_number() over (order by hop, source_id, relation, target_id) n from al qualify n <= 60)")
    + "select n::integer n, hop::integer hop, '(' || coalesce(nullif(s.name, ''), source_id) || ') --[' || relation || ']--> (' || coalesce(nullif(t.name, ''), target_id) || ')' line, (select count(*) from al) > 60 truncated from few left join graph_entities s on source_id = s.id left join graph_entities t on target_id = t.id",
    "graph_cycles": "with recursive e as (select distinct alias a, canonical_id b from entity_aliases where canonical_id is not null and alias <> canonical_id)"
    + ", p as (select a first, b last, [a, b] path from e where b > a union all select first, e.b, list_append(path, e.b) from p join e on last = e.a where e.b > first and not list_contains(path, e.b))"
    + " select array_to_string(path, '>') path, len(path)::integer edges from p join e on last = e.a and e.b = first",
    "entity_upsert_fold": """with e as (select *, coalesce(updated_at, '') || '|' || coalesce(created_at, '') || '|' || coalesce(name, '') || '|' || coalesce(definition, '') || '|' || coalesce(article_path, '') || '|' || coalesce(metadata, '') || '|' || coalesce(type, '') seq from (select distinct * from entities where id is not null))
      select id, arg_max_null(type, seq) as type, arg_max(name, seq) filter (coalesce(name, '') <> '') as name, arg_max(definition, seq) filter (coalesce(definition, '') <> '') definition, arg_max(article_path, seq) filter (coalesce(article_path, '') <> '') article_path,
        arg_min_null(created_at, seq) created_at, arg_max_null(updated_at, seq) updated_at from e group by id""",
    "relation_upsert_fold": """with u as (select 'customer-' || o_custkey source_id, 'priority-' || left(o_orderpriority, 1) target_id, 'optimizes' relation, floor(o_totalprice / 10000) / 100 confidence, 'order ' || o_orderkey evidence,
        case when o_orderkey % 3 = 0 then '' else strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') end valid_from, o_orderkey seq from orders where o_orderkey % 50 <> 0),
      w as (select *, max(confidence) over (partition by source_id, target_id order by seq rows between unbounded preceding and 1 preceding) b from u), x as (select *, b is null or confidence > b wins from w)
      select source_id, target_id, relation, arg_max(confidence, seq) filter (wins) confidence, arg_max(evidence, seq) filter (wins) evidence, coalesce(arg_min(valid_from, seq) filter (wins and valid_from <> ''), '') valid_from, min(seq) first_seq from x group by all""",
    "alias_upsert_fold": """with a as (select alias, canonical_id, lower(trim(status)) status, reason, source, coalesce(decided_at, '') || '|' || coalesce(created_at, '') || '|' || coalesce(lower(trim(status)), '') || '|' || coalesce(reason, '') || '|' || coalesce(source, '') seq from (select distinct * from entity_aliases where canonical_id is not null)),
      k as (select *, min(case when status = 'rejected' then seq end) over (partition by alias, canonical_id) u from a)
      select alias, canonical_id, arg_max_null(status, seq) status, arg_max_null(reason, seq) reason, arg_min_null(source, seq) source from k where u is null or seq <= u group by alias, canonical_id""",
    "functional_supersession": X.with_(X.RELATIONS, X.GRAPH_ALIASES, _CLOSE, "r as (select r.*, coalesce(t.canonical_id, r.source_id) s from relations r left join terminal t on r.source_id = t.alias where relation = 'cites')",
        "k as (select s, target_id keep, valid_from since from r qualify row_number() over (partition by s order by valid_from desc, confidence desc, target_id) = 1)", recursive=True)
    + "select source_id, target_id, valid_from, case when target_id <> keep and valid_to = '' then greatest(since, valid_from) else valid_to end valid_to from r join k on r.s = k.s",
    "alias_blocks": rf"""with e as (select id, max(type) as type, max(name) as name from entities where id is not null and type is not null and name is not null group by id),
      l as (select id, type, list_sort(list_distinct(list_filter(str_split(lower(regexp_replace(name, '{_NAME}', ' ', 'g')), ' '), lambda x: length(x) >= 2))) l from e),
      c as (select type, l, min(id) id, count(*) copies from l group by type, l), w as (select id, type, copies, unnest(l) w from c), size as (select type, sum(copies) n from c group by type),
      rare as (select w.type, w from w join size on w.type = size.type group by w.type, w, n having count(*) <= 60 or sum(copies) <= floor(n * 0.05))
      select distinct x.id a, y.id b from w x join rare r on x.type = r.type and x.w = r.w join w y on x.type = y.type and x.w = y.w where x.id < y.id""",
    "elect_canonical": X.with_(_COMP, recursive=True) + "select component, e.id canonical_id from comp c join (select distinct id, article_path, created_at from entities where id is not null) e on c.id = e.id qualify row_number() over (partition by component order by coalesce(article_path, '') <> '' desc, coalesce(created_at, '') desc, e.id) = 1",
    "community_input": X.with_(X.RELATIONS, X.GRAPH_ENTITIES, _CEDGES) + "select source_id, target_id, relation from cedges",
    "modularity": X.with_(X.RELATIONS, X.GRAPH_ENTITIES, _CEDGES, _NATION, "w as (select source_id a, target_id b from cedges union all select target_id, source_id from cedges)", "c as (select x.community, count(*) filter (x.community = y.community) i, count(*) t from w join member x on a = x.id join member y on b = y.id group by 1)")
    + "select round(sum(i / m - pow(t / m, 2)), 6) modularity from c, (select sum(t) m from c)",
    "member_hash": X.with_(X.RELATIONS, X.GRAPH_ENTITIES, _NATION) + "select community, sha256(string_agg(id, chr(10) order by id)) hash, count(*) members from member group by community",
    "community_level": "with p as (select level, count(*) n from (select distinct id, level, summary, member_count from communities where level is not null) where coalesce(summary, '') <> '' and member_count >= 3 group by level) select coalesce(max(level) filter (n >= 2), max(level), -1)::integer as level from p",
    "related_top8": "with p as (select distinct l_suppkey concept, l_partkey source from lineitem) select concept, other, shared, rank::integer rank from (select x.concept, y.concept other, count(*) shared, row_number() over (partition by x.concept order by count(*) desc, y.concept) rank from p x join p y on x.source = y.source and x.concept <> y.concept group by 1, 2) where rank <= 8",
    "stated_relations": rf"""with b as (select 'src:' || doc_id source_id, unnest(regexp_split_to_array(replace(text, chr(13), ''), '\n\n|\n#{{1,3}}\s')) block from documents where text is not null), w(relation, word) as (values {_WORDS}),
      l as (select source_id, block, unnest(regexp_extract_all(block, '\[\[([^\]]+)\]\]', 1)) target_id from b where contains(block, '[[')) select distinct source_id, target_id, relation from l join w on contains(lower(block), word) where source_id <> target_id""",
    "delete_cascade": X.with_(X.RELATIONS, X.GRAPH_ENTITIES, X.GRAPH_ALIASES, _DERIVED, "gone as (select id from graph_entities where type = 'claim')")
    + "select 'entities' part, id source_id, '' target_id, '' relation from graph_entities where type <> 'claim' union all select 'relations', source_id, target_id, relation from relations where source_id not in (select id from gone) and target_id not in (select id from gone) union all select 'derived', source_id, target_id, relation from derived where source_id not in (select id from gone) and target_id not in (select id from gone)",
}

SQL["alias_classes"] = SQL["alias_blocks"].split("c as (", 1)[0].rstrip().rstrip(",") + " select id, min(id) over (partition by type, l) class from l"
SQL["candidate_pairs"] = f"with p as ({SQL['alias_blocks']}), {_LAST} select a, b from p where (a, b) not in (select (least(alias, canonical_id), greatest(alias, canonical_id)) from latest where status = 'rejected')"
