"""Upkeep of a corpus: change detection, merges, quality, lint, aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.functions import text as T


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose key isn't in the new ones, and the new ones. Keys are unique in ``new``."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def diff(current: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(path, change)``: Added, Modified (other hash or type) or Removed. Both sides are ``(path, hash, type)``."""
    c, m = current.alias("c"), manifest.alias("m")
    both = c.join(m, F.col("c.path") == F.col("m.path"), "full_outer")
    same = F.col("c.hash").eqNullSafe(F.col("m.hash")) & F.col("c.type").eqNullSafe(F.col("m.type"))
    change = F.when(F.col("m.path").isNull(), "Added").when(F.col("c.path").isNull(), "Removed").when(~same, "Modified")
    return both.select(F.coalesce("c.path", "m.path").alias("path"), change.alias("change")).where("change is not null")


def change_feed(current: DataFrame, committed: DataFrame) -> DataFrame:
    """``(path, op)``: Upsert what is missing, deleted or of another hash in the committed state ``(path, hash, deleted)``; Delete what is gone."""
    c, k = current.alias("c"), committed.alias("k")
    both = c.join(k, F.col("c.path") == F.col("k.path"), "full_outer")
    gone = F.coalesce("k.deleted", F.lit(True))
    op = F.when(F.col("c.path").isNotNull() & (gone | ~F.col("c.hash").eqNullSafe(F.col("k.hash"))), "Upsert").when(F.col("c.path").isNull() & ~gone, "Delete")
    return both.select(F.coalesce("c.path", "k.path").alias("path"), op.alias("op")).where("op is not null")


def merge_three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """``(key, value)``: ours where it differs from the base, also if it is gone there, else theirs."""
    b, o, t = base.select("key", F.col("value").alias("b")), ours.select("key", F.col("value").alias("o")), theirs.select("key", F.col("value").alias("t"))
    rows = b.join(o, "key", "full_outer").join(t, "key", "full_outer")
    return rows.select("key", F.when(~F.col("o").eqNullSafe(F.col("b")), F.col("o")).otherwise(F.col("t")).alias("value")).where("value is not null")


#: What a compiled article depends on, in the order in which drift is told, and the order of the last two below tier 3.
PARTS = ("content", "pipeline", "templates", "models", "config", "embed")


def tiered_key(tier: Column, parts: dict[str, Column]) -> Column:
    """The compile key of all PARTS; below tier 3, where nothing is generated, of content, pipeline, embed and config, in this order."""
    low = compile_key(*(parts[p] for p in ("content", "pipeline", "embed", "config")))
    return F.when(tier < 3, low).otherwise(compile_key(*(parts[p] for p in PARTS)))


def compile_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit("mnemora/v1"), *(F.coalesce(p, F.lit("")) for p in parts)), 256)


def drift(old: DataFrame, new: DataFrame, parts: list[str]) -> DataFrame:
    """``(path, drift)``: the first of ``parts`` that differs, or unchanged, for paths on both sides."""
    o, n = old.alias("o"), new.alias("n")
    which = reduce(lambda w, p: w.when(~F.col(f"o.{p}").eqNullSafe(F.col(f"n.{p}")), p), parts, F)
    return o.join(n, F.col("o.path") == F.col("n.path")).select(F.col("o.path").alias("path"), which.otherwise("unchanged").alias("drift"))


def reconcile(files: DataFrame, indexed: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(path, action)`` of files ``(path, hash)`` against indexed rows of the same form and ids with vectors ``(path)``.

    drop what has no file; index what is new or of another hash; embed what has no vector; skip the rest.
    """
    f, i, v = files.alias("f"), indexed.alias("i"), vectors.select("path").distinct().withColumn("has", F.lit(True)).alias("v")
    both = f.join(i, F.col("f.path") == F.col("i.path"), "full_outer").withColumn("p", F.coalesce("f.path", "i.path")).join(v, F.col("p") == F.col("v.path"), "left")
    action = F.when(F.col("f.path").isNull(), "drop").when(F.col("i.path").isNull() | (F.col("f.hash") != F.col("i.hash")), "index").when(F.col("v.has").isNull(), "embed").otherwise("skip")
    return both.select(F.col("p").alias("path"), action.alias("action"))


def provenance(concepts: DataFrame) -> DataFrame:
    """``(source, articles)`` of distinct pairs ``(name, source)``."""
    return concepts.groupBy("source").agg(F.count("*").alias("articles"))


def without_sources(concepts: DataFrame, removed: DataFrame, prune: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``(name, source)`` after sources ``(source)`` are removed, and the sources deferred.

    A source that is the only one of some concept is deferred and stays everywhere; with ``prune`` none is deferred, and
    concepts left without a source are gone.
    """
    if prune:
        return concepts.join(removed.distinct(), "source", "left_anti"), removed.select("source").where(F.lit(False))
    only = concepts.groupBy("name").agg(F.count("*").alias("n"), F.min("source").alias("source")).where("n = 1").select("source").distinct()
    deferred = removed.distinct().join(only, "source", "left_semi")
    return concepts.join(removed.distinct().join(deferred, "source", "left_anti"), "source", "left_anti"), deferred


def queue_upsert(old: DataFrame, new: DataFrame, flags: list[str]) -> DataFrame:
    """Rows ``(path, hash, size_bytes, status, attempts, lease, *flags)`` after new ones ``(path, hash, size_bytes)`` are put in.

    A row of the same hash keeps its state and flags. One of another hash, or a new one, is pending, without attempts, lease or flags.
    Rows that aren't in the new ones stay. Paths are unique on both sides.
    """
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.path") == F.col("n.path"), "full_outer")
    same = F.coalesce((F.col("o.path").isNotNull()) & (F.col("n.path").isNull() | F.col("o.hash").eqNullSafe(F.col("n.hash"))), F.lit(False))
    keep = lambda c, other: F.when(same, F.col(f"o.{c}")).otherwise(other).alias(c)
    return both.select(
        F.coalesce("o.path", "n.path").alias("path"), F.when(F.col("n.path").isNull(), F.col("o.hash")).otherwise(F.col("n.hash")).alias("hash"),
        F.when(F.col("n.path").isNull(), F.col("o.size_bytes")).otherwise(F.col("n.size_bytes")).alias("size_bytes"),
        keep("status", F.lit("pending")), keep("attempts", F.lit(0)), keep("lease", F.lit(None).cast("string")), *(keep(f, F.lit(False)) for f in flags),
    )


def index_entries(sources: DataFrame) -> DataFrame:
    """``(id, tags, content)`` of sources ``(path, type, tier, text, structure)`` that have text: tags are type, tier and whether code was parsed.

    A structure is appended to the text under a line.
    """
    parsed = F.coalesce(F.col("structure") != "", F.lit(False))
    tags = F.concat_ws(",", "type", F.concat(F.lit("tier:"), F.col("tier").cast("string")), F.when(parsed, F.lit("parsed")))
    content = F.when(parsed, F.concat("text", F.lit("\n\n---\nStructure:\n"), "structure")).otherwise(F.col("text"))
    return sources.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(F.concat(F.lit("src:"), "path").alias("id"), tags.alias("tags"), content.alias("content"))


def pending(rows: DataFrame, tier: int, flags: dict[int, list[str]]) -> DataFrame:
    """Rows of at least a tier with an open flag of that tier's passes."""
    return rows.where((F.col("tier") >= tier) & reduce(lambda a, b: a | b, (~F.coalesce(f, F.lit(False)) for f in flags[tier])))


def resolved_tier(files: DataFrame, folders: DataFrame, by_extension: dict[str, int], default: int = 1) -> DataFrame:
    """``(path, tier)`` of files ``(path, own)``: the own one, else the nearest folder's of ``(folder, tier)``, else the extension's."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = files.withColumn("folder", F.explode(above)).join(folders, "folder")
    near = up.groupBy("path").agg(F.max_by("tier", F.length("folder")).alias("near"))
    ext = F.element_at(F.create_map(*(F.lit(x) for kv in by_extension.items() for x in kv)), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    return files.join(near, "path", "left").select("path", F.coalesce("own", "near", ext, F.lit(default)).alias("tier"))


def ordered_union(a: Column, b: Column) -> Column:
    """The items of both arrays in order, each once; a null array is empty."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def stale_outputs(outputs: DataFrame, sources: DataFrame) -> DataFrame:
    """``(output, source)``: sources of outputs ``(output, source, hash)`` whose hash in ``sources(source, hash)`` is another, or gone."""
    now = sources.select("source", F.col("hash").alias("now"))
    return outputs.join(now, "source", "left").where(~F.col("hash").eqNullSafe(F.col("now"))).select("output", "source")


def quality(articles: DataFrame, known: DataFrame, text: str = "text", source: str = "source_text") -> DataFrame:
    """``(id, format, grounding, coverage, wikilink, anti_pattern, combined)`` of ``(id, text, source_text)``; lengths in bytes.

    format: front matter with a concept key, a second-level heading, even fences, a third each. grounding: the share of the
    source's key phrases that the article has. coverage: length against 15 % of the source's, from 400 to 6000. wikilink: the share of
    links to ``known(name)``, 1 without links. anti_pattern: 0.1 off for each filler phrase.
    """
    # phrases and the folded text in columns of their own, so that each is made once
    articles = articles.select("id", F.coalesce(text, F.lit("")).alias("_t"), F.coalesce(source, F.lit("")).alias("_s"))
    articles = articles.withColumns({"_low": F.lower("_t"), "_phrases": T.key_phrases(F.col("_s"))})
    t, s, low, phrases = (F.col(c) for c in ("_t", "_s", "_low", "_phrases"))
    trimmed = F.regexp_replace(t, r"^\s+", "")
    third = lambda c: c.cast("int")
    fences = F.size(F.split(t, "```")) - 1
    format_ = (third(F.startswith(trimmed, F.lit("---")) & F.contains(t, F.lit("concept:"))) + third(t.rlike(r"(?m)^## ")) + third(fences % 2 == 0)) / 3.0
    held = F.size(F.filter(phrases, lambda p: F.contains(low, p)))
    some = (t != "") & (s != "")
    grounding = F.when(some & (F.size(phrases) > 0), held / F.size(phrases)).otherwise(F.when(some, 1.0).otherwise(0.0))
    coverage = F.when(some, F.least(F.lit(1.0), F.octet_length(t) / F.least(F.lit(6000.0), F.greatest(F.lit(400.0), F.octet_length(s) * 0.15)))).otherwise(0.0)
    hits = reduce(lambda a, b: a + b, (F.size(F.split(low, "\\Q" + p + "\\E")) - 1 for p in T.FILLER))
    links = articles.select("id", F.explode(T.wikilinks(t)).alias("target"))
    solved = links.join(known.select(F.col("name").alias("target")).distinct().withColumn("ok", F.lit(1)), "target", "left").groupBy("id").agg(F.avg(F.coalesce("ok", F.lit(0))).alias("wikilink"))
    dims = articles.select("id", format_.alias("format"), grounding.alias("grounding"), coverage.alias("coverage"), (1 - F.least(F.lit(1.0), 0.1 * hits)).alias("anti_pattern"))
    rows = dims.join(solved, "id", "left").withColumn("wikilink", F.coalesce("wikilink", F.lit(1.0)))
    combined = 0.15 * F.col("format") + 0.3 * F.col("grounding") + 0.2 * F.col("coverage") + 0.15 * F.col("wikilink") + 0.2 * F.col("anti_pattern")
    return rows.select("id", *(F.round(c, 6).alias(c) for c in ("format", "grounding", "coverage", "wikilink", "anti_pattern")), F.round(combined, 6).alias("combined"))


def lint(docs: DataFrame, known: DataFrame, now: str, stale_days: int = 90, edges: DataFrame | None = None, scores: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """``(id, rule, detail)`` of documents ``(id, text, changed)``: broken links, no front matter, open placeholders, short sections, stale.

    With live ``edges`` also consistency, for each document with an edge that contradicts, and with ``scores(id, combined)`` quality, for those
    scored under ``least``. Orphans and connections have operators of their own.
    """
    t = F.regexp_replace(F.coalesce("text", F.lit("")), "\r", "")
    broken = docs.select("id", F.explode(F.array_distinct(T.wikilinks(t))).alias("detail")).join(known.select(F.lower("name").alias("k")).distinct(), F.lower("detail") == F.col("k"), "left_anti").withColumn("rule", F.lit("completeness"))
    style = docs.where((t != "") & ~t.rlike(r"^﻿?---\n")).select("id", F.lit("no front matter").alias("detail"), F.lit("style").alias("rule"))
    impute = docs.select("id", F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b(TODO|UNKNOWN|TBD)\b"), F.lit(1)))).alias("detail")).withColumn("rule", F.lit("impute"))
    heads = docs.select("id", F.explode(F.split(t, r"\n(?=#{1,6}[ \t])")).alias("s")).where(F.startswith("s", F.lit("#")))
    body = F.trim(F.regexp_replace("s", r"^#{1,6}[^\n]*\n?", ""))
    short = heads.where(F.length(body) < 50).select("id", F.trim(F.regexp_extract("s", r"^#{1,6}[ \t]+([^\n]*)", 1)).alias("detail")).distinct().withColumn("rule", F.lit("short section"))
    stale = docs.where(F.col("changed") < F.lit(now).cast("timestamp") - F.expr(f"interval {stale_days} days")).select("id", F.lit("").alias("detail"), F.lit("staleness").alias("rule"))
    found = [broken, style, impute, short, stale]
    if edges is not None:
        found.append(edges.where("relation = 'contradicts'").select(F.col("source_id").cast(docs.schema["id"].dataType).alias("id"), F.col("target_id").alias("detail")).distinct().withColumn("rule", F.lit("consistency")))
    if scores is not None:
        found.append(scores.where(F.col("combined") < least).select("id", F.col("combined").cast("string").alias("detail"), F.lit("quality").alias("rule")))
    return reduce(DataFrame.unionByName, (f.select("id", "rule", "detail") for f in found))


def bounded(events: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The newest ``most`` events of each key, and for each how many older ones were dropped before it in all (``dropped``)."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    sizes = events.groupBy(key).agg(F.greatest(F.lit(0), F.count("*") - most).alias("dropped"))
    return events.withColumn("at", newest).where(F.col("at") <= most).drop("at").join(sizes, key)


def curated(concepts: DataFrame, actions: DataFrame, veto) -> DataFrame:
    """``(name, kept)`` of concepts ``(name)`` after actions ``(name, action, into)`` fold or drop some; a concept has one action at most.

    A fold into a concept that isn't there, into itself, or that ``veto(name, into)`` forbids keeps the name. Of a fold's two names the longer
    one is kept, ties the target's; dropped ones are gone; folds aren't followed further.
    """
    known = concepts.select(F.col("name").alias("into")).distinct().withColumn("there", F.lit(True))
    rows = concepts.select("name").distinct().join(actions.select("name", "action", "into"), "name", "left").join(known, "into", "left")
    folds = F.coalesce((F.col("action") == "fold") & F.col("there") & (F.col("into") != F.col("name")) & ~veto(F.col("name"), F.col("into")), F.lit(False))
    longer = F.when(F.length("name") > F.length("into"), F.col("name")).otherwise(F.col("into"))
    return rows.where(~F.coalesce(F.col("action") == "drop", F.lit(False))).select("name", F.when(folds, longer).otherwise(F.col("name")).alias("kept"))


def independence(confirmations: DataFrame) -> DataFrame:
    """``(output, independence, n)``: mean Jaccard distance over pairs of an output's confirmations ``(output, confirmation, chunk)``.

    0 with fewer than two. Confirmations of equal chunks are one class with a weight, so that copies make no pairs; classes
    pair only where they share a chunk, the rest have distance 1.
    """
    sets = confirmations.groupBy("output", "confirmation").agg(F.sort_array(F.collect_set("chunk")).alias("l"))
    classes = sets.groupBy("output", "l").agg(F.count("*").alias("m")).withColumn("c", F.xxhash64(F.col("l")))
    n = classes.groupBy("output").agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("equal"))
    c = classes.select("output", "c", "m", F.size("l").alias("size"), F.explode("l").alias("chunk"))
    x, y = c.alias("x"), c.alias("y")
    shared = x.join(y, ["output", "chunk"]).where("x.c < y.c").groupBy("output", F.col("x.c").alias("a"), F.col("y.c").alias("b"), F.col("x.m").alias("ma"), F.col("y.m").alias("mb"), F.col("x.size").alias("sa"), F.col("y.size").alias("sb")).agg(F.count("*").alias("both"))
    near = shared.groupBy("output").agg(F.sum(F.col("ma") * F.col("mb") * F.col("both") / (F.col("sa") + F.col("sb") - F.col("both"))).alias("near"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return n.join(near, "output", "left").select("output", F.round(F.when(F.col("n") < 2, 0.0).otherwise(1 - (F.coalesce("near", F.lit(0.0)) + F.col("equal")) / pairs), 6).alias("independence"), "n")


def strict_sum(value: Column) -> Column:
    """A sum that is null if any part is."""
    return F.when(F.count_if(value.isNull()) > 0, None).otherwise(F.sum(value))


def one_or_mixed(value: Column) -> Column:
    """The only value, mixed if there are several, empty if there is none."""
    n = F.countDistinct(value)
    return F.when(n == 0, "").when(n == 1, F.max(value)).otherwise("mixed")


def buckets(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """``(le, n)``: how many values are at most each bound; null values count nowhere."""
    return rows.select(*(F.count_if(F.col(value) <= b).alias(str(i)) for i, b in enumerate(bounds))).select(F.explode(F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(bounds)))).alias("b")).select("b.*")


def prune_learnings(rows: DataFrame, since: str, most: int = 500) -> DataFrame:
    """The newest ``most`` rows of distinct ids from an instant on; of one id the oldest row holds."""
    once = rows.groupBy("id").agg(F.min(F.struct("created_at", "content")).alias("m")).select("id", "m.*")
    return once.where(F.col("created_at") >= since).orderBy(F.desc("created_at"), "id").limit(most)


def exact_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, group_id, copies)``: the smallest id of all with the same non-empty text. Texts are compared by SHA-256."""
    hashed = docs.where(F.coalesce(text_col, F.lit("")) != "").select(id_col, F.sha2(text_col, 256).alias("h"))
    size = hashed.groupBy("h").agg(F.min(id_col).alias("group_id"), F.count("*").alias("copies"))
    return hashed.join(size, "h").select(F.col(id_col), "group_id", "copies")


def fold_concepts(rows: DataFrame) -> DataFrame:
    """``(name, canonical)`` of concepts ``(name, aliases array)``: those linked by names and aliases, without case, take the longest name.

    Order doesn't matter, which differs from a sequential fold where links are ambiguous.
    """
    from mnemora.operators.graph import components

    key = lambda c: F.lower(F.trim(c))
    links = rows.select("name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("b")).select(F.concat(F.lit("n:"), F.col("name")).alias("a"), F.concat(F.lit("k:"), key(F.col("b"))).alias("b"))
    found = components(links).where("id like 'n:%'").select(F.substring("id", 3, 1_000_000).alias("name"), "component")
    best = found.groupBy("component").agg(F.min_by("name", F.struct((-F.length("name")).alias("n"), "name")).alias("canonical"))
    return found.join(best, "component").select("name", "canonical")
