"""The typed, bi-temporal entity graph: views, folds, traversal, aliases, relevance, communities.

Edges are ``(source_id, target_id, relation, confidence, valid_from, valid_to)``; instants are RFC 3339 strings in UTC and
compare as strings, an empty one is open.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.operators import hierarchy
from mnemora.runtime import durable, lookup_join

KEY = ["source_id", "target_id", "relation"]
# Weights of relations in the graph leg, others 1; a lower weight costs more.
LEG_WEIGHTS = {"contradicts": 1.1, "cites": 0.7}
# Affinity of entity types, each pair once, others 1.
AFFINITY = {
    ("concept", "concept"): 0.8, ("concept", "technique"): 1.2, ("concept", "source"): 1.0, ("concept", "claim"): 1.0, ("concept", "artifact"): 0.8,
    ("technique", "technique"): 0.8, ("technique", "source"): 1.0, ("technique", "claim"): 0.8, ("technique", "artifact"): 1.0,
    ("source", "source"): 0.5, ("source", "claim"): 0.8, ("source", "artifact"): 0.8,
    ("claim", "claim"): 0.5, ("claim", "artifact"): 1.0, ("artifact", "artifact"): 0.5,
}
RELEVANCE = {"direct_link": 3.0, "source_overlap": 4.0, "common_neighbor": 1.5, "type_affinity": 1.0}
# Words by which a block of text states a relation between its article and a linked one.
RELATION_WORDS = {
    "implements": ("implements", "implementation of", "is an implementation", "实现了", "实现方式"),
    "extends": ("extends", "extension of", "builds on", "builds upon", "扩展了", "基于"),
    "optimizes": ("optimizes", "optimization of", "improves upon", "faster than", "优化了", "改进了", "提升了"),
    "contradicts": ("contradicts", "conflicts with", "disagrees with", "challenges", "矛盾", "冲突", "挑战了"),
    "prerequisite_of": ("prerequisite", "requires knowledge of", "depends on", "built on top of", "前提", "依赖于", "前置条件"),
    "trades_off": ("trade-off", "tradeoff", "trades off", "at the cost of", "取舍", "权衡", "代价是"),
}


def live_at(at: str) -> Column:
    """Whether an edge is valid at an instant; the end is exclusive."""
    return ((F.col("valid_from") == "") | (F.col("valid_from") <= at)) & ((F.col("valid_to") == "") | (F.col("valid_to") > at))


def edge_view(relations: DataFrame, derived: DataFrame) -> DataFrame:
    """Asserted edges, and derived ones that none of them shadows; of several causes the lowest alias holds."""
    free = derived.join(relations.select(*KEY), KEY, "left_anti")
    first = Window.partitionBy(*KEY).orderBy("alias_id")
    kept = free.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return relations.withColumn("alias_id", F.lit("")).unionByName(kept)


def both_ways(edges: DataFrame, *keep: str) -> DataFrame:
    """``(id, other, ...)`` of every edge from either end."""
    ends = F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("other")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("other")))
    return edges.select(F.explode(ends).alias("e"), *keep).select("e.id", "e.other", *keep)


def degree(edges: DataFrame) -> DataFrame:
    """``(id, degree)``: how many edges touch each id; a loop counts once."""
    ends = F.array_distinct(F.array("source_id", "target_id"))
    return edges.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def citing(edges: DataFrame, entities: DataFrame, relation: str = "cites", cited: bool = False) -> DataFrame:
    """Entities that cite something, or, the other way, are cited."""
    end = "target_id" if cited else "source_id"
    return entities.join(edges.where(F.col("relation") == relation).select(F.col(end).alias("id")), "id", "left_semi")


def neighbors(edges: DataFrame, starts: DataFrame, depth: int = 1, direction: str = "both", relation: str | None = None) -> DataFrame:
    """``(start, id, depth)``: what each start ``(id)`` reaches in one to five steps, by the least number, without itself."""
    if relation:
        edges = edges.where(F.col("relation") == relation)
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"))
    step = {"out": out, "in": out.select(F.col("other").alias("id"), F.col("id").alias("other")), "both": both_ways(edges)}[direction].distinct()
    seen = durable(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth")).distinct())
    layers = [seen]
    for d in range(1, min(max(depth, 1), 5) + 1):
        ahead = layers[-1].select("start", "id").join(step, "id").select("start", F.col("other").alias("id")).distinct()
        new = durable(ahead.join(reduce(DataFrame.unionByName, layers).select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(d)))
        layers.append(new)
        if new.isEmpty():
            break
    return reduce(DataFrame.unionByName, layers[1:])


def capped(reached: DataFrame, most: int = 10_000) -> DataFrame:
    """The first ``most`` rows of ``neighbors()`` for each start, by depth and id, and whether there were more (``partial``)."""
    order = F.row_number().over(Window.partitionBy("start").orderBy("depth", "id"))
    sizes = reached.groupBy("start").agg((F.count("*") > most).alias("partial"))
    return reached.withColumn("at", order).where(F.col("at") <= most).drop("at").join(sizes, "start")


def canonical(aliases: DataFrame, most: int = 32) -> DataFrame:
    """``(alias, canonical_id)``: where the chain of applied aliases ends; an alias on or into a circle, or of a longer chain, is itself.

    An alias has one target; of several the smallest holds.
    """
    links = aliases.where("alias is not null and canonical_id is not null").groupBy(F.col("alias").alias("id")).agg(F.min("canonical_id").alias("parent"))
    ends = links.select(F.col("parent").alias("id")).distinct().join(links, "id", "left_anti").select("id", F.lit(None).cast("string").alias("parent"))
    found = hierarchy.resolve(links.unionByName(ends)).where("depth <> 0")
    return found.select(F.col("id").alias("alias"), F.when(F.col("depth").between(1, most), F.col("root_id")).otherwise(F.col("id")).alias("canonical_id"))


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of links ``(a, b)``: the smallest id reached in any direction.

    Alternates two steps until neither changes an edge: every id links its larger neighbours to the smallest id around it, and
    then its smaller neighbours and itself to the smallest of these. What is left are stars around the components' smallest ids.
    """
    pairs = links.where("a is not null and b is not null")
    edges = durable(pairs.where("a <> b").select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("other")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("id", "other").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        around = edges.unionByName(edges.select(F.col("other").alias("id"), F.col("id").alias("other")))
        least = durable(around.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("m")))
        large = lookup_join(durable(around.where("other > id")), least, "id", rows=before[0]).select(F.col("other").alias("id"), F.col("m").alias("other"))
        large = durable(large.where("id <> other").distinct())
        low = durable(large.groupBy("id").agg(F.min("other").alias("m")))
        small = lookup_join(large, low, "id", rows=2 * before[0]).where("other <> m").select(F.col("other").alias("id"), F.col("m").alias("other"))
        edges = durable(small.unionByName(low.select("id", F.col("m").alias("other"))).distinct())
        if (now := mark(edges)) == before:
            break
        before = now
    found = edges.select("id", F.col("other").alias("component"))
    alone = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(found, "id", "left_anti")
    return found.unionByName(alone.select("id", F.col("id").alias("component")))


def fold_entities(rows: DataFrame) -> DataFrame:
    """One row an id of upserts in order ``seq``: type and updated_at of the last, created_at of the first, else the last that isn't empty."""
    last = lambda c: F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("seq"))).alias(c)
    return rows.groupBy("id").agg(F.max_by("type", "seq").alias("type"), *(last(c) for c in ("name", "definition", "article_path")), F.min_by("created_at", "seq").alias("created_at"), F.max_by("updated_at", "seq").alias("updated_at"))


def fold_relations(rows: DataFrame, known: list[str] | None = None) -> DataFrame:
    """One edge a key of upserts in order ``seq``. Loops are rejected, and, with ``known``, relations that aren't among these.

    A row wins if it is the first or its confidence is over that of all before. The last winner gives evidence, confidence
    and source_doc, the first winner with a valid_from gives that.
    """
    order = Window.partitionBy(*KEY).orderBy("seq")
    rows = rows.where(F.col("relation").isin(known)) if known is not None else rows
    before = F.max("confidence").over(order.rowsBetween(Window.unboundedPreceding, -1))
    won = rows.where("source_id <> target_id").withColumn("wins", before.isNull() | (F.col("confidence") > before))
    winner = F.when(F.col("wins"), F.col("seq"))
    return won.groupBy(*KEY).agg(
        F.max_by("confidence", winner).alias("confidence"), F.max_by("evidence", winner).alias("evidence"),
        F.coalesce(F.min_by("valid_from", F.when(F.col("wins") & (F.col("valid_from") != ""), F.col("seq"))), F.lit("")).alias("valid_from"), F.min("seq").alias("first_seq"),
    )


def latest_aliases(rows: DataFrame) -> DataFrame:
    """``(alias, canonical_id, status)`` of each pair's row decided last; a null time is earliest, at equal times the larger status holds.

    Case and outer white space of the status are ignored; pairs of one id, or with a null one, are left out.
    """
    clean = F.lower(F.regexp_replace("status", r"(?U)^\s+|\s+$", ""))
    last = F.max(F.struct(F.col("decided_at").alias("at"), clean.alias("status"))).alias("last")
    return rows.where("alias <> canonical_id").groupBy("alias", "canonical_id").agg(last).select("alias", "canonical_id", "last.status")


def pair_conflicts(aliases: DataFrame) -> DataFrame:
    """``(alias, canonical_id, blockers)`` of the pending pairs of ``latest_aliases`` that must not be linked.

    A pair is blocked by every other pair, rejected or pending, between the components that applied links make of its two ids, in
    either direction. Components of the two ids may be one.
    """
    aliases = durable(aliases)
    c = durable(components(aliases.where("status = 'applied'").select(F.col("alias").alias("a"), F.col("canonical_id").alias("b"))))
    of = lambda df, end, name: df.join(c.select(F.col("id").alias(end), F.col("component").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))
    open_ = of(of(aliases.where("status in ('rejected', 'pending')"), "alias", "x"), "canonical_id", "y")
    open_ = durable(open_.withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y")).withColumn("pair", F.array(F.least("alias", "canonical_id"), F.greatest("alias", "canonical_id"))))
    many = open_.select("a", "b", "pair").distinct().groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    return open_.where("status = 'pending'").join(many, ["a", "b"]).select("alias", "canonical_id", (F.col("n") - 1).alias("blockers"))


def rejected_either_way(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of which no row of ``latest_aliases`` in either direction is rejected."""
    bad = aliases.where("status = 'rejected'").select(F.least("alias", "canonical_id").alias("x"), F.greatest("alias", "canonical_id").alias("y")).distinct()
    return pairs.join(bad, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")


def unlink(derived: DataFrame, aliases: DataFrame, cleared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Derived edges without those caused by the aliases ``(alias)``, and the aliases with their rows marked rejected."""
    gone = cleared.select("alias").distinct()
    marked = aliases.join(gone.withColumn("cleared", F.lit(True)), "alias", "left")
    status = F.when(F.col("cleared"), F.lit("rejected")).otherwise(F.col("status"))
    return derived.join(gone.withColumnRenamed("alias", "alias_id"), "alias_id", "left_anti"), marked.withColumn("status", status).drop("cleared")


def triggered(edges: DataFrame, functional: list[str], least: float = 0.8) -> DataFrame:
    """``(source_id, target_id, relation, action)``: what a new edge asks for.

    supersede for a functional relation of at least that confidence, conflict below, and for every contradicts; others ask for nothing.
    """
    is_functional = F.col("relation").isin(functional)
    action = F.when(F.col("relation") == "contradicts", "conflict").when(is_functional & (F.coalesce("confidence", F.lit(0.0)) >= least), "supersede").when(is_functional, "conflict")
    return edges.select(*KEY, action.alias("action")).where("action is not null")


def guarded_clusters(members: DataFrame, known: DataFrame, never: list[str] = ()) -> DataFrame:
    """``(cluster, id, confidence)`` of proposed clusters ``(cluster, pos, id, confidence)`` that may be applied.

    Ids that aren't in ``known(id)``, or that are among ``never``, go; an id stays in the first cluster, by ``pos``, that names it; clusters
    of fewer than two are dropped; confidences are brought between 0 and 1, null to 0.
    """
    real = members.where(~F.col("id").isin(list(never)) if never else F.lit(True)).join(known.select("id").distinct(), "id", "left_semi")
    first = real.groupBy("id").agg(F.min(F.struct("cluster", "pos", "confidence")).alias("m")).select("id", "m.cluster", "m.confidence")
    size = first.groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 2").select("cluster")
    return first.join(size, "cluster", "left_semi").select("cluster", "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence"))


def fold_aliases(rows: DataFrame) -> DataFrame:
    """One row a pair of upserts in order ``seq``: status and reason of the last row up to the first rejection; source of the first."""
    reject = F.min(F.when(F.col("status") == "rejected", F.col("seq"))).over(Window.partitionBy("alias", "canonical_id"))
    kept = rows.withColumn("until", reject).where("until is null or seq <= until")
    return kept.groupBy("alias", "canonical_id").agg(F.max_by("status", "seq").alias("status"), F.max_by("reason", "seq").alias("reason"), F.min_by("source", "seq").alias("source"))


def link_aliases(edges: DataFrame, relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges of each alias copied onto its target, stamped with the alias; no loops, nothing that is asserted already."""
    pairs = aliases.select(F.col("alias").alias("id"), "canonical_id")
    moved = lambda end, other: edges.join(pairs.withColumnRenamed("id", end), end).select(F.col(end).alias("alias_id"), F.col("canonical_id").alias(end), other, "relation", "confidence", "valid_from", "valid_to")
    copies = moved("source_id", "target_id").unionByName(moved("target_id", "source_id")).where("source_id <> target_id")
    return copies.join(relations.select(*KEY), KEY, "left_anti").dropDuplicates(["alias_id", *KEY])


def sweep(relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Derived edges of all applied aliases, replayed over the union view until a pass adds none: chains stamp the last hop.

    There are no more derived edges than ids for each end, so that passes come to an end.
    """
    columns = ["alias_id", *KEY, "confidence", "valid_from", "valid_to"]
    derived = durable(link_aliases(relations, relations, aliases).select(*columns))
    size = derived.count()
    while True:
        view = relations.select(*columns[1:]).unionByName(derived.select(*columns[1:]))
        added = link_aliases(view, relations, aliases).select(*columns).join(derived.select("alias_id", *KEY), ["alias_id", *KEY], "left_anti")
        derived = durable(derived.unionByName(added))
        if (now := derived.count()) == size:
            return derived
        size = now


def supersede(edges: DataFrame, forms: DataFrame, functional: str) -> DataFrame:
    """Edges of a functional predicate, of which each source keeps the one of the latest valid_from.

    Others that are open to an id that isn't the kept target's end at the later of the kept one's start and their own.
    ``forms(id, root)`` gives ids that mean the same; others mean themselves. Equal starts: the larger confidence, then the smaller target.
    """
    root = lambda df, c, out: df.join(forms.select(F.col("id").alias(c), F.col("root").alias(out)), c, "left").withColumn(out, F.coalesce(out, c))
    rows = root(root(edges.where(F.col("relation") == functional), "source_id", "s"), "target_id", "t")
    kept = rows.groupBy("s").agg(F.max(F.struct("valid_from", "confidence")).alias("k"))
    best = rows.join(kept, "s").where((F.col("valid_from") == F.col("k.valid_from")) & (F.col("confidence") == F.col("k.confidence"))).groupBy("s").agg(F.min("t").alias("keep"), F.max("valid_from").alias("since"))
    ended = F.when((F.col("t") != F.col("keep")) & (F.col("valid_to") == ""), F.greatest("since", "valid_from")).otherwise(F.col("valid_to"))
    return rows.join(best, "s").select(*KEY, "confidence", "valid_from", ended.alias("valid_to"))


def graph_leg(edges: DataFrame, entities: DataFrame, aliases: DataFrame, terms: list[str], limit: int, weights: dict[str, float] = LEG_WEIGHTS, factor: int = 5) -> DataFrame:
    """``(id, score)``: articles within two edges of what the query names, cheapest first, ties by id.

    Words, and two or three of them joined by dashes, name entities by id, through applied aliases. An edge costs one over its
    weight; a weight of 0 or less excludes its relation.
    """
    named = {"-".join(terms[i : i + n]) for n in (1, 2, 3) for i in range(len(terms) - n + 1)}
    asked = entities.sparkSession.createDataFrame([(x,) for x in sorted(named)] or [("",)], "id string")
    ends = canonical(aliases)
    seeds = asked.join(ends.withColumnRenamed("alias", "id"), "id", "left").select(F.coalesce("canonical_id", "id").alias("id")).distinct()
    known = entities.select("id", "article_path")
    best = durable(seeds.join(known, "id").select("id", F.lit(0.0).alias("score")))
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("relation")), F.lit(1.0))
    steps = durable(both_ways(edges.withColumn("w", weight).where("w > 0").withColumn("cost", 1 / F.col("w")), "cost").groupBy("id", "other").agg(F.min("cost").alias("cost")))
    for _ in range(2):
        further = best.join(steps, "id").select(F.col("other").alias("id"), (F.col("score") + F.col("cost")).alias("score"))
        best = durable(best.unionByName(further).groupBy("id").agg(F.min("score").alias("score")))
    return best.join(known, "id").where("article_path <> ''").select("id", F.round("score", 9).alias("score")).orderBy("score", "id").limit(limit * factor)


def resolved(ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ids ``(id)`` as what applied aliases stand for, each once."""
    ends = canonical(aliases).withColumnRenamed("alias", "id")
    return ids.join(ends, "id", "left").select(F.coalesce("canonical_id", "id").alias("id")).distinct()


def relevance(edges: DataFrame, entities: DataFrame, seeds: DataFrame, at: str, limit: int = 10, weights: dict[str, float] = RELEVANCE, aliases: DataFrame | None = None) -> DataFrame:
    """``(id, score, direct_link, source_overlap, common_neighbor, type_affinity)`` of articles near the seeds ``(id)``.

    direct_link: how many seeds reach it within two live edges that aren't citations. source_overlap: what it cites of what the seeds
    cite, over all that they cite. common_neighbor: sum of 1 / ln(degree) over neighbours that it shares with any seed, of a
    degree over 1, which counts all edges. type_affinity: mean over the seeds. Seeds themselves are no candidates; with ``aliases``
    they are what these stand for.
    """
    seeds = durable(resolved(seeds, aliases)) if aliases is not None else seeds.distinct()
    plain = durable(edges.where((F.col("relation") != "cites") & live_at(at)))
    cites = edges.where("relation = 'cites'")
    direct = neighbors(plain, seeds, 2).groupBy("id").agg(F.countDistinct("start").cast("double").alias("direct_link"))
    cited = cites.join(seeds.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select("source_id", "target_id").distinct()
    total = cited.count()
    articles = entities.where("article_path <> ''").select("id")
    shared = cites.select(F.col("source_id").alias("id"), "target_id").distinct().join(cited.groupBy("target_id").agg(F.count("*").alias("n")), "target_id")
    overlap = shared.join(articles, "id", "left_semi").groupBy("id").agg((F.sum("n") / F.lit(float(max(total, 1)))).alias("source_overlap"))
    candidates = durable(direct.join(overlap, "id", "full_outer").join(seeds, "id", "left_anti"))
    steps = both_ways(plain).where("id <> other").distinct()
    near = steps.join(seeds, "id", "left_semi").select(F.col("other").alias("mid")).distinct()
    mids = near.join(degree(edges).withColumnRenamed("id", "mid"), "mid").where("degree > 1").select("mid", (1 / F.log("degree")).alias("w"))
    common = steps.withColumnRenamed("other", "mid").join(candidates.select("id"), "id", "left_semi").join(mids, "mid").groupBy("id").agg(F.sum("w").alias("common_neighbor"))
    pairs = [(a, b, v) for (x, y), v in AFFINITY.items() for a, b in {(x, y), (y, x)}]
    table = entities.sparkSession.createDataFrame(pairs, "seed_type string, type string, v double")
    seed_types = entities.join(seeds, "id", "left_semi").groupBy(F.col("type").alias("seed_type")).agg(F.count("*").alias("k"))
    seeds_in_all = seed_types.agg(F.sum("k")).first()[0] or 1
    # pairs that aren't listed count 1, so that only the listed ones' differences from it need a join
    affinity = seed_types.join(table, "seed_type").groupBy("type").agg((F.sum(F.col("k") * (F.col("v") - 1)) / F.lit(float(seeds_in_all))).alias("off"))
    rows = candidates.join(common, "id", "left").join(entities.where("article_path <> ''").select("id", "type"), "id").join(affinity, "type", "left").na.fill(0.0)
    rows = rows.withColumn("type_affinity", 1 + F.col("off"))
    score = sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0))
    return rows.select("id", F.round(score, 6).alias("score"), *(F.round(c, 6).alias(c) for c in weights)).orderBy(F.desc("score"), "id").limit(limit)


def serialize(edges: DataFrame, entities: DataFrame, seeds: DataFrame, hops: int = 2, most: int = 60) -> DataFrame:
    """``(n, hop, line, truncated)``: edges around the seeds ``(id)``, each once at its first hop, sorted within a hop, the first ``most``.

    ``truncated`` tells whether there were more.
    """
    reached = [durable(seeds.distinct())]
    found = []
    for hop in range(1, hops + 1):
        ids = reached[-1]
        touching = both_ways(edges, "source_id", "target_id", "relation").join(ids, "id", "left_semi")
        new = touching.select(*KEY, F.lit(hop).alias("hop"), "other").dropDuplicates([*KEY, "other"])
        if found:
            new = new.join(reduce(DataFrame.unionByName, found).select(*KEY), KEY, "left_anti")
        found.append(durable(new))
        reached.append(durable(found[-1].select(F.col("other").alias("id")).distinct().join(reduce(DataFrame.unionByName, reached), "id", "left_anti")))
    rows = durable(reduce(DataFrame.unionByName, found).groupBy(*KEY).agg(F.min("hop").alias("hop")).orderBy("hop", "source_id", "relation", "target_id").limit(most + 1))
    truncated = rows.count() > most
    rows = rows.orderBy("hop", "source_id", "relation", "target_id").limit(most)
    name = lambda end: entities.select(F.col("id").alias(end), F.nullif("name", F.lit("")).alias(f"{end}_name"))
    rows = rows.join(name("source_id"), "source_id", "left").join(name("target_id"), "target_id", "left")
    n = F.row_number().over(Window.orderBy("hop", "source_id", "relation", "target_id"))  # of at most ``most`` rows
    show = lambda end: F.coalesce(f"{end}_name", end)
    return rows.select(n.alias("n"), "hop", F.format_string("(%s) --[%s]--> (%s)", show("source_id"), F.col("relation"), show("target_id")).alias("line"), F.lit(truncated).alias("truncated"))


def cycles(edges: DataFrame) -> DataFrame:
    """``(path, edges)``: all simple circles, each from its smallest id, joined by >.

    Paths grow only among ids that may lie on circles, until none is left. Dense graphs have exponentially many circles.
    """
    step = durable(edges.where("source_id <> target_id").select(F.col("source_id").alias("end"), F.col("target_id").alias("next")).distinct())
    step = _trimmed(step)
    paths, found = step.where("next > end").select(F.array("end", "next").alias("path")), []
    while True:
        ahead = durable(paths.withColumn("end", F.element_at("path", -1)).join(step, "end"))
        found.append(ahead.where(F.col("next") == F.col("path")[0]).select("path"))
        paths = ahead.where((F.col("next") > F.col("path")[0]) & ~F.array_contains("path", F.col("next"))).select(F.concat("path", F.array("next")).alias("path"))
        if paths.isEmpty():
            return reduce(DataFrame.unionByName, found).select(F.array_join("path", ">").alias("path"), F.size("path").alias("edges"))


def _trimmed(step: DataFrame) -> DataFrame:
    """Edges ``(end, next)`` without those that no circle has, as nothing leads on from them or to them; what joins circles may stay."""
    rows = step.count()
    while rows:
        for a, b in (("end", "next"), ("next", "end")):
            gone = _run_out(step, a, b)
            step = durable(step.join(gone.withColumnRenamed("id", "end"), "end", "left_anti").join(gone.withColumnRenamed("id", "next"), "next", "left_anti"))
        left = step.count()
        if left == rows:
            break
        rows = left
    return step


def _run_out(step: DataFrame, a: str, b: str) -> DataFrame:
    """``(id)``: ids without a way on, from a to b, and those whose only way leads to such an id.

    Pointers along only ways double each round; a round that finds no such id proves that there is none further off.
    """
    only = step.groupBy(F.col(a).alias("id")).agg(F.count("*").alias("n"), F.min(b).alias("to"))
    ids = step.select(F.explode(F.array("end", "next")).alias("id")).distinct()
    state = durable(ids.join(only, "id", "left").select("id", F.when(F.col("n") == 1, F.col("to")).otherwise(F.col("id")).alias("anc"), F.col("n").isNull().alias("out")))
    rows, was = state.count(), 0
    while (now := state.where("out").count()) > was:
        was = now
        ahead = state.select(F.col("id").alias("anc"), F.col("anc").alias("next"), F.col("out").alias("ends"))
        state = durable(lookup_join(state.select("id", "anc"), ahead, "anc", rows=rows).select("id", F.col("next").alias("anc"), F.col("ends").alias("out")))
    return state.where("out").select("id")


def blocks(entities: DataFrame, name_tokens: Column, floor: int = 20, share: float = 0.0) -> DataFrame:
    """``(a, b)``, a < b: entities of one type with a telling word in common: one that few different names of the type have.

    Few means at most ``floor`` names, or at most a ``share`` of the type's entities; with a share, pairs grow faster than names.
    Entities of the same words are one class, named by its smallest id, so that copies make no pairs; see name_classes().
    """
    classes = name_classes(entities, name_tokens).groupBy("class", "type", "words").agg(F.count("*").alias("copies"))
    words = classes.select("class", "type", "copies", F.explode("words").alias("w"))
    size = classes.groupBy("type").agg(F.sum("copies").alias("n"))
    rare = words.groupBy("type", "w").agg(F.count("*").alias("df"), F.sum("copies").alias("held")).join(size, "type").where((F.col("df") <= floor) | (F.col("held") <= F.floor(F.col("n") * share))).where("df > 1")
    told = words.join(rare.select("type", "w"), ["type", "w"])
    return told.alias("x").join(told.alias("y"), ["type", "w"]).where("x.class < y.class").select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def name_classes(entities: DataFrame, name_tokens: Column) -> DataFrame:
    """``(id, type, words, class)``: the smallest id of the type with the same set of words."""
    rows = entities.select("id", "type", F.sort_array(F.array_distinct(name_tokens)).alias("words"))
    return rows.join(rows.groupBy("type", "words").agg(F.min("id").alias("class")), ["type", "words"])


def elect(members: DataFrame, key: str) -> DataFrame:
    """``(key, canonical_id)``: the member with an article, then the newest, then the smallest id; an empty date is oldest."""
    order = F.struct((F.coalesce("article_path", F.lit("")) != "").alias("has"), F.coalesce("created_at", F.lit("")).alias("at"))
    best = members.withColumn("o", order)
    top = best.groupBy(key).agg(F.max("o").alias("o"))
    return best.join(top, [key, "o"]).groupBy(key).agg(F.min("id").alias("canonical_id"))


def community_edges(edges: DataFrame, entities: DataFrame, at: str) -> DataFrame:
    """Live edges that aren't citations or loops, between entities that aren't sources."""
    real = entities.where("type <> 'source'").select("id")
    rows = edges.where((F.col("relation") != "cites") & (F.col("source_id") != F.col("target_id")) & live_at(at))
    return rows.join(real.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(real.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def label_communities(edges: DataFrame) -> DataFrame:
    """``(id, community)`` by label propagation, which differs from Louvain's local moving but runs on all nodes at once.

    In each round the nodes of one half, by hash, take the heaviest label around them, the smallest on ties. It ends when neither half changes, or when two rounds no longer change fewer nodes than any two before.
    """
    weight = durable(both_ways(edges).where("id <> other").groupBy("id", "other").agg(F.count("*").alias("w")))
    labels = durable(weight.select("id", F.col("id").alias("community")).distinct())
    rows = weight.count()
    fewest, changed, still = rows + 1, [], 0
    for r in count():
        votes = lookup_join(weight.withColumnRenamed("other", "key"), labels.withColumnRenamed("id", "key"), "key", rows=rows).groupBy("id", "community").agg(F.sum("w").alias("w"))
        heard = votes.groupBy("id").agg(F.min_by("community", F.struct((-F.col("w")).alias("w"), "community")).alias("heard"))
        half = F.pmod(F.xxhash64("id"), F.lit(2)) == r % 2
        step = durable(labels.join(heard, "id").select("id", F.when(half, F.col("heard")).otherwise(F.col("community")).alias("community"), (half & (F.col("heard") != F.col("community"))).alias("moved")))
        changed.append(step.where("moved").count())
        labels = step.drop("moved")
        if r % 2:
            now = changed[-1] + changed[-2]
            still = 0 if now < fewest else still + 1
            fewest = min(fewest, now)
            if not now or still == 2:
                return labels


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """``(modularity)`` of a partition ``(id, community)``: over communities, the share of ends inside less the squared share of ends."""
    ends = both_ways(edges).join(member, "id").join(member.select(F.col("id").alias("other"), F.col("community").alias("there")), "other")
    of = ends.groupBy("community").agg(F.count_if(F.col("community") == F.col("there")).alias("inside"), F.count("*").alias("total"))
    m = of.agg(F.sum("total")).first()[0] or 1
    return of.agg(F.round(F.sum(F.col("inside") / m - F.pow(F.col("total") / m, F.lit(2.0))), 6).alias("modularity"))


def member_hash(members: DataFrame, key: str) -> DataFrame:
    """``(key, hash)``: SHA-256 of a community's sorted members, one a line."""
    return members.groupBy(key).agg(F.sha2(F.array_join(F.sort_array(F.collect_set("id")), "\n"), 256).alias("hash"), F.countDistinct("id").alias("members"))


def pick_level(communities: DataFrame, least: int = 3) -> DataFrame:
    """``(level)``: the highest with two summarised communities of ``least`` members, else the highest with one, else -1."""
    per = communities.where(F.coalesce("summary", F.lit("")) != "").where(F.col("member_count") >= least).groupBy("level").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.max(F.when(F.col("n") >= 2, F.col("level"))), F.max("level"), F.lit(-1)).alias("level"))


def related(pairs: DataFrame, most: int = 8, large: int = 500) -> DataFrame:
    """``(concept, other, shared, rank)`` of distinct ``(concept, source)``: the concepts that share most sources, ties by name.

    Sources of up to ``large`` concepts make pairs. Larger ones don't: pairs found otherwise count them by their sets of large
    sources; for concepts that share large ones only, those of one set are a class, of which the first ``most`` + 1 names are
    all that any list may need.
    """
    pairs = durable(pairs.distinct())
    size = pairs.groupBy("source").agg(F.count("*").alias("n"))
    small = pairs.join(size.where(F.col("n") <= large).select("source"), "source", "left_semi")
    wide = durable(pairs.join(size.where(F.col("n") > large).select("source"), "source", "left_semi").groupBy("concept").agg(F.sort_array(F.collect_set("source")).alias("wide")))
    both = small.alias("x").join(small.alias("y"), "source").where("x.concept <> y.concept").groupBy(F.col("x.concept").alias("concept"), F.col("y.concept").alias("other")).agg(F.count("*").alias("shared"))
    both = both.join(wide, "concept", "left").join(wide.select(F.col("concept").alias("other"), F.col("wide").alias("w2")), "other", "left")
    both = both.select("concept", "other", (F.col("shared") + F.coalesce(F.size(F.array_intersect("wide", "w2")), F.lit(0))).alias("shared"))
    first = F.row_number().over(Window.partitionBy("wide").orderBy("concept"))
    named = durable(wide.withColumn("at", first).where(F.col("at") <= most + 1).select("wide", F.col("concept").alias("other")))
    sets = wide.select("wide").distinct().withColumn("s", F.explode("wide"))
    near = sets.alias("x").join(sets.alias("y"), "s").groupBy(F.col("x.wide").alias("wide"), F.col("y.wide").alias("w2")).agg(F.count("*").alias("shared"))
    lists = near.join(named.withColumnRenamed("wide", "w2"), "w2").withColumn("at", F.row_number().over(Window.partitionBy("wide").orderBy(F.desc("shared"), "other"))).where(F.col("at") <= most + 1)
    only = wide.join(lists.select("wide", "other", "shared"), "wide").where("concept <> other").select("concept", "other", "shared")
    rows = both.unionByName(only).groupBy("concept", "other").agg(F.max("shared").alias("shared"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("shared"), "other"))).where(F.col("rank") <= most)


def stated_relations(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(source_id, target_id, relation)``: a block of text that links another article and has a relation's words states it."""
    block = docs.select(key, F.explode(F.split(F.regexp_replace(text, "\r", ""), r"\n\n|\n#{1,3}\s")).alias("block")).where(F.contains("block", F.lit("[[")))
    low = F.lower("block")
    has = F.filter(F.array(*(F.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in ws)), F.lit(r)) for r, ws in RELATION_WORDS.items())), lambda x: x.isNotNull())
    links = block.select(F.col(key).cast("string").alias("source_id"), F.explode(F.regexp_extract_all("block", F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))).alias("target_id"), has.alias("r"))
    return links.select("source_id", "target_id", F.explode("r").alias("relation")).where("source_id <> target_id").distinct()


def without(entities: DataFrame, relations: DataFrame, derived: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after entities ``(id)`` are deleted with all edges that touch them."""
    cut = lambda df: df.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return entities.join(gone, "id", "left_anti"), cut(relations), cut(derived)
