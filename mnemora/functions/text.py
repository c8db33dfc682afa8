"""Column expressions on texts, all JVM-side."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that queries drop.
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "of", "in", "to", "for", "with", "on", "at", "by", "from", "as", "and", "or", "not", "but", "it",
    "its", "this", "that", "these", "those",
)
# Phrases that lower an article's quality.
FILLER = (
    "in conclusion", "in summary", "it is important to note", "it's important to note", "it is worth noting", "it's worth noting",
    "as an ai", "this article discusses", "in this article", "this article will", "delve into", "needless to say",
    "at the end of the day", "when it comes to", "in today's world", "last but not least",
)
# Labels that lead a turn of a transcript, by the role of who speaks; who asks is a user, who answers an assistant.
SPEAKERS = {
    "user": (
        "User", "Human", "Question", "Utilisateur", "Usuario", "Pregunta", "Frage", "Nutzer", "質問", "利用者", "用户", "用戶", "问", "问题",
        "질문", "사용자", "Вопрос", "Пользователь", "سؤال", "المستخدم", "ผู้ใช้", "คำถาม", "प्रश्न", "उपयोगकर्ता",
    ),
    "assistant": (
        "Assistant", "Answer", "Réponse", "Asistente", "Respuesta", "Antwort", "Assistent", "回答", "助手", "答",
        "답변", "Ответ", "جواب", "المساعد", "ผู้ช่วย", "คำตอบ", "उत्तर", "सहायक",
    ),
    "system": ("System",),
    "speaker": ("Speaker",),
}
_CJK = r"\p{IsHan}\p{IsHangul}\p{IsKatakana}\p{IsHiragana}"
#: Query words keep these characters only.
_KEPT = r"[^a-z0-9_\-\p{IsHan}\p{IsHangul}\x{3040}-\x{30FF}]"
TOKEN = r"[\p{L}\p{N}]+"
WIKILINK = r"\[\[([^\]]+)\]\]"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Three tokens for two CJK characters and one for four others, each rounded down; null for null."""
    cjk = F.length(F.regexp_replace(text, f"[^{_CJK}]", ""))
    return (F.floor(cjk * 3 / 2) + F.floor((F.length(text) - cjk) / 4)).cast("long")


def query_terms(text: Column) -> Column:
    """Words of a query in order, cleaned and without stop words; all of them if nothing else is left; null for null."""
    cleaned = F.filter(F.transform(F.split(F.trim(F.lower(text)), r"\s+"), lambda w: F.regexp_replace(w, _KEPT, "")), lambda w: w != "")
    kept = F.filter(cleaned, lambda w: ~w.isin(*STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(cleaned)


def wikilinks(text: Column) -> Column:
    """Targets of all [[links]], in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1))


def headings(text: Column) -> Column:
    """Heading lines of levels 1 to 6, marks included."""
    return F.regexp_extract_all(F.regexp_replace(text, "\r", ""), F.lit(r"(?m)^#{1,6}[ \t]+[^\n]+$"), F.lit(0))


def front_matter(text: Column) -> Column:
    """What stands between a leading line of three dashes and the next; empty without both."""
    return F.regexp_extract(F.regexp_replace(text, "\r", ""), r"^﻿?---\n((?:[^\n]*\n)*?)---(?:\n|$)", 1)


def with_front_matter(text: Column, **fields: Column) -> Column:
    """A text after a block of its fields, in their order, without those that are null; line ends in them become spaces."""
    lines = (F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), F.regexp_replace(v, r"[\r\n]+", " "))) for k, v in fields.items())
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.coalesce(text, F.lit("")))


def sections(text: Column, least: int = 0) -> Column:
    """A text split before each heading line; one of at most ``least`` characters is a section as it is, 0 splits always."""
    parts = F.filter(F.split(text, r"(?m)(?=^#{1,6}[ \t])"), lambda s: s != "")
    return F.when(F.length(text) <= least, F.array(text)).otherwise(parts) if least else parts


def body(text: Column) -> Column:
    """A text without its front matter."""
    return F.regexp_replace(F.regexp_replace(text, "\r", ""), r"^﻿?---\n(?:[^\n]*\n)*?---(?:\n|$)", "")


def squeezed(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def is_grounded(source: Column, evidence: Column) -> Column:
    """Whether the evidence stands in the source but for case and white space; empty or null evidence never does."""
    return F.coalesce((squeezed(evidence) != "") & F.contains(squeezed(source), squeezed(evidence)), F.lit(False))


def speakers(*roles: str) -> list[str]:
    """The labels of these roles, or of all, in composed and in decomposed form, longest first."""
    forms = {unicodedata.normalize(f, s) for r in roles or SPEAKERS for s in SPEAKERS[r] for f in ("NFC", "NFD")}
    return sorted(forms, key=lambda s: (-len(s), s))


def turn(line: Column) -> Column:
    """``(role, said)`` of a line that a speaker's label leads, plain, numbered or bold, else null; a numbered speaker's role has its number."""
    label = "(" + "|".join(speakers()) + ")"
    lead = rf"^(?:\*\*)?{label}( [0-9]{{1,3}})?(?:\*\*[ \x{{A0}}]?[:：]|[ \x{{A0}}]?[:：]\*\*|[ \x{{A0}}]?[:：])[ \t\x{{A0}}\x{{3000}}]?"
    who = F.regexp_extract(line, lead, 1)
    known = F.create_map(*(F.lit(x) for r in SPEAKERS for label in speakers(r) for x in (label, r)))
    role = F.element_at(known, who)
    numbered = F.when(role == "speaker", F.concat(role, F.regexp_extract(line, lead, 2))).otherwise(role)
    return F.when(who != "", F.struct(numbered.alias("role"), F.regexp_replace(line, lead, "").alias("said")))


def key_phrases(text: Column) -> Column:
    """The first five windows of three words of each sentence, lower case, of at least ten bytes, distinct, the first fifty."""
    def of_sentence(s: Column) -> Column:
        w = F.filter(F.split(s, r"(?U)\s+"), lambda x: x != "")
        starts = F.when(F.size(w) >= 3, F.sequence(F.lit(1), F.least(F.lit(5), F.size(w) - 2))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.lower(F.array_join(F.slice(w, i, 3), " ")))

    found = F.flatten(F.transform(F.split(text, r"[.!?\n]"), of_sentence))
    return F.slice(F.array_distinct(F.filter(found, lambda p: F.octet_length(p) >= 10)), 1, 50)


def display_name(slug: Column) -> Column:
    """Dashes as spaces, each word with a capital."""
    return F.array_join(F.transform(F.split(F.replace(slug, F.lit("-"), F.lit(" ")), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def slug(text: Column) -> Column:
    """Lower-case letters and digits, with dashes for spaces, at most fifty characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9 \-]", ""), " ", "-"), 1, 50)


def confidence_label(text: Column) -> Column:
    """high, medium or low; medium for anything else."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("high", "medium", "low"), t).otherwise("medium")


def is_noisy_name(name: Column) -> Column:
    """Names that are no concepts: shorter than two characters, digits only, or with $, a backslash, a slash or .md."""
    return (F.length(name) < 2) | name.rlike(r"^[0-9]+$") | name.rlike(r"[$\\/]") | F.contains(name, F.lit(".md"))


def without_filler_sentences(text: Column) -> Column:
    """A text without its lines' sentences that hold a filler phrase, code fences untouched; the text itself if nothing is left.

    Fences split the text into parts of which every second one is code.
    """
    parts = F.split(text, "```")

    def clean(part: Column) -> Column:
        sentences = F.regexp_extract_all(part, F.lit(r"[^.!?。！？\n]*[.!?。！？]+[ \t]*|[^.!?。！？\n]+|\n"), F.lit(0))
        filler = lambda s: F.exists(F.array(*map(F.lit, FILLER)), lambda p: F.contains(F.lower(s), p))
        return F.array_join(F.filter(sentences, lambda s: ~filler(s)), "")

    cleaned = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, clean(p)).otherwise(p)), "```")
    return F.when(F.trim(F.regexp_replace(cleaned, r"\s+", " ")) == "", text).otherwise(cleaned)


def source_date(text: Column, modified: Column, added: Column) -> Column:
    """Unix seconds of the front matter's date, else of the file's change, else of its adding; 0 without any.

    Only a block that closes within the first 4096 bytes counts.
    """
    block = F.when(F.octet_length(front_matter(text)) <= 4096, front_matter(text))
    written = F.regexp_extract(block, r"(?m)^date:[ \t]*[\"']?(\d{4}-\d{2}-\d{2})", 1)
    day = F.unix_date(F.try_to_date(F.nullif(written, F.lit("")), "yyyy-MM-dd")) * 86400
    return F.coalesce(day.cast("long"), modified, added, F.lit(0)).cast("long")


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def prefix_document_frequency(terms: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(term, df)``: documents with a word that starts with the term; none gives 0. Terms are distinct and not empty.

    Words meet terms on their first two characters, so that no pair is tried in vain that an equality can rule out; a
    shorter term meets words on its one character.
    """
    vocabulary = docs.select(id_col, F.explode(F.array_distinct(words(F.col(text_col)))).alias("word"))
    keyed = terms.select("term", F.substring("term", 1, 2).alias("head"), F.lit(2).alias("n")).where("length(term) >= 2")
    short = terms.select("term", F.col("term").alias("head"), F.lit(1).alias("n")).where("length(term) = 1")
    heads = vocabulary.select(id_col, "word", F.explode(F.array(F.struct(F.substring("word", 1, 2).alias("head"), F.lit(2).alias("n")), F.struct(F.substring("word", 1, 1).alias("head"), F.lit(1).alias("n")))).alias("h")).select(id_col, "word", "h.*")
    hits = heads.join(keyed.unionByName(short), ["head", "n"]).where(F.startswith("word", F.col("term"))).select("term", id_col).distinct()
    return terms.join(hits.groupBy("term").agg(F.count("*").alias("df")), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def prune_frequent(terms: DataFrame, corpus: int, key: str, least: int = 100, share: float = 0.2, backstop: int = 3) -> DataFrame:
    """Terms ``(key, pos, term, df)`` of each query without those in more than a share of a corpus of over ``least`` documents.

    A query that would lose all keeps its first ``backstop``. A query's terms are few.
    """
    from pyspark.sql import Window

    of = Window.partitionBy(key)
    rare = (F.col("df") <= int(share * corpus)) | F.lit(corpus <= least)
    at = F.row_number().over(of.orderBy("pos"))
    marked = terms.withColumn("rare", rare).withColumn("any", F.max("rare").over(of)).withColumn("at", at)
    return marked.where(F.when(F.col("any"), F.col("rare")).otherwise(F.col("at") <= backstop)).drop("rare", "any", "at")
