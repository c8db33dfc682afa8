"""Rewriting of [[links]] against tables of names, and cleaning of extracted triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PARTS = r"\[\[[^\]]+\]\]|(?:(?!\[\[[^\]]+\]\])[\s\S])+"


def rewrite(docs: DataFrame, names: DataFrame, key: str, text: str, replace) -> DataFrame:
    """``(key, text)`` with each link replaced by ``replace(link, display, id)``; id is null for targets that aren't in ``names(name, id)``.

    A link is ``[[target]]`` or ``[[target|display]]``; targets compare without case. Of several ids of a name the one of the least
    ``priority`` holds, if names have that, then the smallest. Only texts with links are taken apart, links alone are
    shuffled to the names, and a text's parts come together again by its key, which must be unique.
    """
    linked = F.contains(text, F.lit("[["))
    parts = docs.where(linked).select(key, F.posexplode(F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0))).alias("pos", "part"))
    is_link = F.col("part").rlike(r"^\[\[[^\]]+\]\]$")
    inner = F.expr("substring(part, 3, length(part) - 4)")
    links = parts.where(is_link).select(key, "pos", inner.alias("inner"))
    target = F.split("inner", r"\|")
    links = links.select(key, "pos", target[0].alias("target"), F.element_at(target, -1).alias("display"))
    first = F.col("priority") if "priority" in names.columns else F.lit(0)
    known = names.groupBy(F.lower("name").alias("k")).agg(F.min_by("id", F.struct(first, F.col("id"))).alias("known_id"))
    solved = links.join(known, F.lower("target") == F.col("k"), "left").select(key, "pos", replace(F.col("target"), F.col("display"), F.col("known_id")).alias("part"))
    whole = parts.where(~is_link).unionByName(solved).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias(text))
    rest = docs.where(~F.coalesce(linked, F.lit(False))).select(key, text)
    return whole.unionByName(rest)


def sanitized(target: Column, display: Column, id_: Column) -> Column:
    """Known targets by their id, with the display kept; others as they are."""
    shown = F.concat(F.lit("[["), id_, F.lit("|"), display, F.lit("]]"))
    asis = F.when(target == display, F.concat(F.lit("[["), target, F.lit("]]"))).otherwise(F.concat(F.lit("[["), target, F.lit("|"), display, F.lit("]]")))
    return F.when(id_.isNull(), asis).when(id_ == display, F.concat(F.lit("[["), id_, F.lit("]]"))).otherwise(shown)


def stripped(target: Column, display: Column, id_: Column) -> Column:
    """Known targets as links, others as their display alone."""
    return F.when(id_.isNull(), display).otherwise(sanitized(target, display, F.lit(None).cast("string")))


def normalize_entities(entities: DataFrame, types: list[str], triples: DataFrame, most: int = 40, default: str = "concept") -> DataFrame:
    """``(doc, name, type, pos)`` out of a document's entities in order ``pos``: trimmed, each name once at its first place, types that
    aren't known as ``default``, the first ``most``, and of these what stands in a triple of ``normalize_triples``."""
    clean = entities.select("doc", F.trim("name").alias("name"), F.lower(F.trim("type")).alias("type"), "pos").where("name <> ''")
    clean = clean.withColumn("type", F.when(F.col("type").isin(types), F.col("type")).otherwise(default))
    once = clean.groupBy("doc", "name").agg(F.min(F.struct("pos", "type")).alias("m")).select("doc", "name", "m.type", "m.pos")
    at = F.row_number().over(Window.partitionBy("doc").orderBy("pos", "name"))
    ends = triples.select("doc", F.explode(F.array("source", "target")).alias("name")).distinct()
    return once.withColumn("at", at).where(F.col("at") <= most).drop("at").join(ends, ["doc", "name"], "left_semi").select("doc", "name", "type", "pos")


def normalize_triples(triples: DataFrame, entities: DataFrame, synonyms: DataFrame, most: int = 60) -> DataFrame:
    """``(doc, source, predicate, target, confidence, pos)`` out of triples of a document in order ``pos``.

    Names are trimmed; a predicate is a known name or one of its ``synonyms(word, predicate)``, without case; loops and ends
    that aren't ``entities(name)`` go; confidence is cut to 0 to 1, null is 0; of what is left the first ``most`` of a document stay, which
    is the operator's point: a model's list is cut.
    """
    clean = triples.select("doc", F.trim("source").alias("source"), F.trim("target").alias("target"), F.lower(F.trim("predicate")).alias("word"), "confidence", "pos")
    words = synonyms.select(F.lower("word").alias("word"), "predicate").unionByName(synonyms.select(F.lower("predicate").alias("word"), "predicate")).groupBy("word").agg(F.min("predicate").alias("predicate"))
    known = entities.select("name").distinct()
    rows = clean.where("source <> target").join(words, "word")
    for end in ("source", "target"):
        rows = rows.join(known.withColumnRenamed("name", end), end, "left_semi")
    rows = rows.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))))
    at = F.row_number().over(Window.partitionBy("doc").orderBy("pos", "source", "target", "predicate"))
    return rows.withColumn("at", at).where(F.col("at") <= most).select("doc", "source", "predicate", "target", "confidence", "pos")
