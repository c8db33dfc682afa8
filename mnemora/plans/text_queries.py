"""Queries on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import fusion
from mnemora.plans import fixtures as X
from mnemora.runtime import table

_DOCS = "docs as (select doc_id, replace(text, chr(13), '') text, tags, source, lang, ingested_at from documents where text is not null)"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_KEEP = r"[^a-z0-9_\-\p{Han}\p{Hangul}\x{3040}-\x{30FF}]"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null")


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def wikilink_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _docs(spark, sf_dir).select("doc_id", F.explode(T.wikilinks(F.col("text"))).alias("target"))
    return links.groupBy("target").agg(F.count("*").alias("links"), F.countDistinct("doc_id").alias("docs"))


def wikilinks_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _docs(spark, sf_dir).select("doc_id", F.explode(T.wikilinks(F.col("text"))).alias("target")).distinct()
    names = table(spark, sf_dir, "entities").where("name is not null").select(F.lower("name").alias("known")).distinct()
    return links.join(names, F.lower("target") == F.col("known"), "left_anti")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.headings(F.col("text"))).alias("pos", "line"))
    return found.select("doc_id", "pos", F.length(F.regexp_extract("line", "^#+", 0)).alias("level"), F.trim(F.regexp_replace("line", r"^#+[ \t]+", "")).alias("heading"))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "longmemeval_full").select("question").where("question is not null").distinct()
    return q.select("question", F.posexplode(T.query_terms(F.col("question"))).alias("pos", "term"))


def df_prune_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    asked = query_terms(spark, sf_dir)
    df = T.prefix_document_frequency(asked.select("term").distinct(), docs, "doc_id", "text")
    return T.prune_frequent(asked.join(df, "term"), docs.count(), "question").select("question", "pos", "term", "df")


def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "longmemeval_full").select("question_id", "ground_truth", "generated_answer").distinct()
    return rows.select("question_id", "ground_truth", "generated_answer", T.is_grounded(F.col("generated_answer"), F.col("ground_truth")).alias("grounded"))


_SPACES = r"[\t\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each phrase, in any script."""
    cut = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.key_phrases(F.regexp_replace("text", _SPACES, " "))).alias("pos", "phrase"))
    return cut.groupBy("phrase").agg(F.countDistinct("doc_id").alias("docs"))


def source_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.source_date(F.col("text"), F.lit(None).cast("long"), F.unix_timestamp("ingested_at")).alias("source_date"))


def front_matter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = T.front_matter(F.col("text"))
    field = lambda k: F.trim(F.regexp_extract(block, rf"(?m)^{k}:[ \t]*([^\n]*)$", 1))
    rows = _docs(spark, sf_dir).where(block != "")
    return rows.select("doc_id", field("title").alias("title"), field("date").alias("date"), F.length(T.body(F.col("text"))).alias("body_chars"))


def noisy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "entities").where("name is not null").select("id", "name").distinct()
    return names.select("id", "name", T.is_noisy_name(F.col("name")).alias("noisy"), T.slug(F.col("name")).alias("slug"))


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "entities").where("id is not null").select("id").distinct()
    return ids.select("id", T.display_name(F.col("id")).alias("display"))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source its longest documents up to a budget of 8000 tokens of four characters, cut at 16000 characters each."""
    docs = _docs(spark, sf_dir).where("source is not null").select("source", "doc_id", F.length("text").alias("n"))
    return fusion.longest_within(docs, "source", "doc_id", "n", F.floor(F.least("n", F.lit(16000)) / 4), 8000)


def chunk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive chunks of a document to be summarised together, for a budget of 4000 tokens."""
    c = X.chunks(spark, sf_dir)
    n = c.groupBy("doc_id").agg(F.count("*").alias("n"))
    size = F.when(F.floor(F.lit(4000) / F.col("n")) >= 1000, F.lit(1)).otherwise(F.ceil(F.col("n") / 4))
    grouped = c.join(n, "doc_id").withColumn("grp", F.floor(F.col("chunk_index") / size).cast("int"))
    return grouped.groupBy("doc_id", "grp").agg(F.count("*").alias("members"), F.min("chunk_index").alias("first_index"), F.sum(F.length("content")).alias("chars"))


def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of transcripts, by speaker."""
    lines = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", T.turn(F.col("line")).alias("turn")).where("turn is not null").select("doc_id", "pos", "turn.role", "turn.said")


def truncated_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.substring(text, 1, 2000)).alias("head"), (F.length(text) > 2000).alias("cut"))


def confidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of aliases' reasons, and ages of their decisions, as confidence labels."""
    a = table(spark, sf_dir, "entity_aliases").select("alias", "canonical_id", "confidence").distinct()
    level = F.when(F.col("confidence") >= 0.9, " HIGH ").when(F.col("confidence") < 0.5, "low").when(F.col("confidence") < 0.7, "so so")
    return a.select("alias", "canonical_id", "confidence", T.confidence_label(level).alias("label"))


def newest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest date among the documents of each source; 0 where none has one."""
    d = _docs(spark, sf_dir)
    date = T.source_date(F.col("text"), F.lit(None).cast("long"), F.unix_timestamp("ingested_at"))
    return d.select("source", date.alias("date")).groupBy("source").agg(F.max("date").alias("newest"))


def sections_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents over 600 characters that hold a link; shorter documents are one section."""
    t = F.regexp_replace("text", "\r", "")
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sections(t, 600)).alias("pos", "section"))
    return rows.where(F.contains("section", F.lit("[["))).select("doc_id", "pos", F.md5("section").alias("digest"))


def front_matter_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter of entities, and what comes back when it is read."""
    e = table(spark, sf_dir, "entities").where("id is not null and name is not null").select("id", "name", "type").distinct()
    text = T.with_front_matter(F.lit("Body."), concept=F.col("id"), title=F.col("name"), kind=F.col("type"))
    return e.select("id", "name", "type", F.md5(text).alias("digest"), T.body(text).alias("body"))


QUERIES = {
    f.__name__: f
    for f in (confidence_labels, newest_sources, sections_containing, front_matter_built, token_estimate, wikilink_targets, wikilinks_broken, sections, query_terms, df_prune_terms, evidence_spans, key_phrases, source_dates, front_matter_fields, noisy_names, display_names, context_budget, chunk_groups, session_turns, truncated_content)
}

TERMS_OF_QUESTIONS = _TERMS = rf"""cleaned as (select question, list_filter(list_transform(regexp_split_to_array(trim(lower(question)), '\s+'), lambda w: regexp_replace(w, '{_KEEP}', '', 'g')), lambda w: w <> '') w
  from (select distinct question from longmemeval_full where question is not null)),
kept as (select question, w, list_filter(w, lambda x: x not in ({_STOP})) k from cleaned),
terms as (select question, generate_subscripts(l, 1) - 1 pos, unnest(l) term from (select question, case when len(k) > 0 then k else w end l from kept))"""
_ROLES = ", ".join(f"('{label}', '{role}')" for role in T.SPEAKERS for label in T.speakers(role))
_LABEL = r"^(?:\*\*)?(" + "|".join(T.speakers()) + r")( [0-9]{1,3})?(?:\*\*[ \x{A0}]?[:：]|[ \x{A0}]?[:：]\*\*|[ \x{A0}]?[:：])[ \t\x{A0}\x{3000}]?"
_FM = r"'^﻿?---\n((?:[^\n]*\n)*?)---(?:\n|$)'"

SQL = {
    "confidence_labels": "select distinct alias, canonical_id, confidence, case when confidence >= 0.9 then 'high' when confidence < 0.5 then 'low' else 'medium' end as label from entity_aliases",
    "newest_sources": rf"""select source, max(coalesce(epoch(try_cast(nullif(regexp_extract(regexp_extract(replace(text, chr(13), ''), {_FM}, 1), '(?m)^date:[ \t]*["'']?(\d{{4}}-\d{{2}}-\d{{2}})', 1), '') as date))::bigint,
      floor(epoch(ingested_at))::bigint, 0)::bigint) newest from documents where text is not null group by source""",
    "sections_containing": X.with_(_DOCS) + r"""select doc_id, pos::integer pos, md5(section) digest from (select doc_id, generate_subscripts(l, 1) - 1 pos, unnest(l) section from
      (select doc_id, case when length(text) <= 600 then [text] else list_filter(str_split(regexp_replace(text, '(^|\n)(#{1,6}[ \t])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') end l from docs)) where contains(section, '[[')""",
    "front_matter_built": """select distinct id, name, type, md5('---' || chr(10) || 'concept: ' || id || chr(10) || 'title: ' || name || chr(10) || case when type is null then '' else 'kind: ' || type || chr(10) end || '---' || chr(10) || 'Body.') digest, 'Body.' body from entities where id is not null and name is not null""",
    "key_phrases": r"""with s as (select doc_id, generate_subscripts(l, 1) n, unnest(l) s from (select doc_id, regexp_split_to_array(text, '[.!?\n]') l from documents where text is not null)),
      w as (select doc_id, n, list_filter(regexp_split_to_array(trim(s, ' '), '[\t-\r\x{85}\p{Z}]+'), lambda x: x <> '') w from s),
      p as (select doc_id, n, i, lower(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) phrase from w, (values (1), (2), (3), (4), (5)) v(i) where i <= len(w) - 2),
      f as (select doc_id, phrase, min(n * 10 + i) as place from p where octet_length(encode(phrase)) >= 10 group by doc_id, phrase), k as (select doc_id, phrase from f qualify row_number() over (partition by doc_id order by place) <= 50)
      select phrase, count(*) docs from k group by phrase""",
    "token_estimate": r"""select doc_id, (floor(cjk * 3 / 2) + floor((length(text) - cjk) / 4))::bigint tokens from
      (select doc_id, text, length(regexp_replace(text, '[^\p{Han}\p{Hangul}\p{Katakana}\p{Hiragana}]', '', 'g')) cjk from documents where text is not null)""",
    "wikilink_targets": r"select target, count(*) links, count(distinct doc_id) docs from (select doc_id, unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) target from documents where text is not null) group by target",
    "wikilinks_broken": r"""select distinct doc_id, target from (select doc_id, unnest(regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1)) target from documents where text is not null)
      where lower(target) not in (select lower(name) from entities where name is not null)""",
    "sections": X.with_(_DOCS) + r"""select doc_id, pos::integer pos, length(regexp_extract(line, '^#+'))::integer as level, trim(regexp_replace(line, '^#+[ \t]+', '')) heading from
      (select doc_id, generate_subscripts(l, 1) - 1 pos, unnest(l) line from (select doc_id, regexp_extract_all(text, '(?m)^#{1,6}[ \t]+[^\n]+$') l from docs))""",
    "query_terms": X.with_(_TERMS) + "select question, pos::integer pos, term from terms",
    "df_prune_terms": X.with_(_TERMS) + r""", words as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) word from documents where text is not null),
vocab as (select word, list(doc_id) ids from words group by word),
df as (select t.term, coalesce(len(list_distinct(flatten(list(v.ids)))), 0) df from (select distinct term from terms) t left join vocab v on starts_with(v.word, t.term) group by t.term),
marked as (select t.question, t.pos, t.term, d.df, (d.df <= floor(0.2 * (select count(*) from documents where text is not null)) or (select count(*) from documents where text is not null) <= 100) rare,
  row_number() over (partition by t.question order by t.pos) rn from terms t join df d on t.term = d.term)
select question, pos::integer pos, term, df::bigint df from (select *, bool_or(rare) over (partition by question) r from marked) where case when r then rare else rn <= 3 end""",
    "evidence_spans": r"""with sq as (select distinct question_id, ground_truth, generated_answer from longmemeval_full)
      select question_id, ground_truth, generated_answer, coalesce(trim(regexp_replace(lower(ground_truth), '\s+', ' ', 'g')) <> '' and contains(trim(regexp_replace(lower(generated_answer), '\s+', ' ', 'g')), trim(regexp_replace(lower(ground_truth), '\s+', ' ', 'g'))), false) grounded from sq""",
    "source_dates": rf"""select doc_id, coalesce(epoch(try_cast(nullif(regexp_extract(regexp_extract(replace(text, chr(13), ''), {_FM}, 1), '(?m)^date:[ \t]*["'']?(\d{{4}}-\d{{2}}-\d{{2}})', 1), '') as date))::bigint,
      floor(epoch(ingested_at))::bigint, 0)::bigint source_date from documents where text is not null""",
    "front_matter_fields": rf"""with b as (select doc_id, replace(text, chr(13), '') t from documents where text is not null), f as (select doc_id, t, regexp_extract(t, {_FM}, 1) fm from b)
      select doc_id, trim(regexp_extract(fm, '(?m)^title:[ \t]*([^\n]*)$', 1)) title, trim(regexp_extract(fm, '(?m)^date:[ \t]*([^\n]*)$', 1)) date, length(regexp_replace(t, {_FM}, ''))::integer body_chars from f where fm <> ''""",
    "noisy_names": r"""select distinct id, name, length(name) < 2 or regexp_matches(name, '^[0-9]+$') or regexp_matches(name, '[$\\/]') or contains(name, '.md') noisy,
      substring(regexp_replace(regexp_replace(lower(name), '[^a-z0-9 \-]', '', 'g'), ' ', '-', 'g'), 1, 50) slug from entities where name is not null""",
    "display_names": "select id, array_to_string(list_transform(str_split(replace(id, '-', ' '), ' '), lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ') display from (select distinct id from entities where id is not null)",
    "context_budget": """with r as (select source, doc_id, length(text) n, row_number() over (partition by source order by length(text) desc, doc_id) rank from documents where text is not null and source is not null),
      s as (select source, doc_id, rank, floor(least(n, 16000) / 4)::bigint tokens, sum(floor(least(n, 16000) / 4)) over (partition by source order by rank) spent from r)
      select source, doc_id, rank::integer rank, tokens, spent::bigint spent from (select *, max(case when spent > 8000 then 1 else 0 end) over (partition by source order by rank) o from s) where o = 0""",
    "chunk_groups": X.with_(X.CHUNKS) + """, n as (select doc_id, count(*) n from chunks group by doc_id)
      select c.doc_id, floor(chunk_index / case when floor(4000 / n) >= 1000 then 1 else ceil(n / 4) end)::integer grp, count(*) members, min(chunk_index) first_index, sum(length(content))::bigint chars
      from chunks c join n on c.doc_id = n.doc_id group by 1, 2""",
    "session_turns": X.with_(_DOCS, f"role(who, role) as (values {_ROLES})") + rf"""select doc_id, pos::integer pos, role || case when role = 'speaker' then regexp_extract(line, '{_LABEL}', 2) else '' end role, regexp_replace(line, '{_LABEL}', '') said from
      (select doc_id, generate_subscripts(l, 1) - 1 pos, unnest(l) line from (select doc_id, str_split(text, chr(10)) l from docs)) join role on regexp_extract(line, '{_LABEL}', 1) = who""",
    "truncated_content": "select doc_id, md5(substring(text, 1, 2000)) head, length(text) > 2000 cut from documents where text is not null",
}
