"""Oversized texts to pieces at natural boundaries, by regular expressions with bounded quantifiers and SQL array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemora.llm.markup import FIRST_ITEM, GAP, ITEM, RULE, TURN

#: Code points of a piece at most, and of the overlap with the piece before.
LIMIT, OVERLAP = 2000, 200
_NL = "(?:\\r\\n|\\n|\\r)"
_LINE = f"(?:[^\\r\\n]++{_NL}?|{_NL})"
_BLANK = f"{GAP}*+{_NL}"
_END = f"{GAP}*+(?:{_NL}|\\z)"


def _fence(mark: str) -> str:
    """An opening fence, the lines up to the closing one of the same mark, and that, or the text's end."""
    return f"{GAP}*+{mark}{_LINE}(?:(?!{GAP}*+{mark}{_END}){_LINE})*+(?:{GAP}*+{mark}{_END})?"


#: What ends a paragraph without a blank line; a numbered item only if it is the first, as lines may be wrapped at numbers.
_STARTS = f"{GAP}*+(?:```|~~~|#{{1,6}}[ \\t]|\\||>|{FIRST_ITEM}|{TURN})|[ ]{{0,3}}{RULE}(?:{_NL}|\\z)"
#: The kinds of blocks, each with the expression that takes the whole of it; a text is a sequence of them, gaps included.
KINDS = {
    "gap": f"(?:{_BLANK})++|{GAP}++\\z",
    "front": f"(?:\\A|(?<=\\A\\ufeff))---{_END}(?:(?!---{_END}){_LINE})*+---{_END}",
    "fence": f"(?:{_fence('```')}|{_fence('~~~')})",
    "rule": f"[ ]{{0,3}}{RULE}(?:{_NL}|\\z)",
    "heading": f"[ ]{{0,3}}#{{1,6}}[ \\t]{_LINE}",
    "table": f"(?:{GAP}*+\\|{_LINE})++",
    "quote": f"(?:{GAP}*+>{_LINE})++",
    "list": f"{GAP}*+{ITEM}{_LINE}(?:(?:{_BLANK})*+(?![ ]{{0,3}}{RULE}(?:{_NL}|\\z)){GAP}*+{ITEM}{_LINE})*+",
    "turn": f"{GAP}*+{TURN}{_LINE}(?:(?!{_BLANK}|{_STARTS}|{GAP}){_LINE})*+",
    "paragraph": f"{_LINE}(?:(?!{_BLANK}|{_STARTS}|{GAP}){_LINE})*+",
}
BLOCKS = "|".join(f"(?:{x})" for x in KINDS.values())


def _kind(block: Column) -> Column:
    """The kind of a block that BLOCKS took."""
    is_a = lambda k: block.rlike(f"\\A(?:{KINDS[k]})\\z")
    found = F.when(is_a("gap"), F.lit("gap"))
    for kind in ("front", "rule", "heading"):
        found = found.when(is_a(kind), F.lit(kind))
    return found.otherwise(F.lit("text"))


def oversized(chunks: DataFrame, id_col: str, text_col: str, limit: int, *others: str) -> DataFrame:
    """Distinct rows of an id and its text over the limit, with a key for both. Null texts are never over it.

    Of the other columns one row's values hold, by the smallest. One shuffle, of the long texts only, which the windows
    over ``id, of`` use again.
    """
    of = F.xxhash64(text_col).alias("of")
    long = chunks.where(F.length(text_col) > limit).groupBy(F.col(id_col).cast("string").alias(id_col), of)
    return long.agg(F.first(text_col).alias(text_col), *(F.min(c).alias(c) for c in others))


def blocks(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, of, at, kind, start, first)``: each block of each text, where it starts, and where its first non-space character is."""
    cut = texts.select(id_col, "of", F.posexplode(F.regexp_extract_all(text_col, F.lit(BLOCKS), F.lit(0))).alias("at", "block"))
    order = Window.partitionBy(id_col, "of").orderBy("at")
    sized = cut.select(
        id_col, "of", "at", _kind(F.col("block")).alias("kind"), F.length("block").alias("size"),
        F.length(F.regexp_extract("block", "\\A[\\s\\u00a0\\u3000\\ufeff]*", 0)).alias("lead"),
    )
    placed = sized.withColumn("start", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.select(id_col, "of", "at", "kind", F.col("start").cast("int").alias("start"), (F.col("start") + F.col("lead")).cast("int").alias("first"))


def boundaries(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, of, boundary)``: the first non-space character of each block but the first and those that follow a heading.

    Rules and front matter are no blocks.
    """
    order = Window.partitionBy(id_col, "of").orderBy("at")
    real = blocks(texts, id_col, text_col).where(~F.col("kind").isin("gap", "rule", "front"))
    before = F.lag("kind").over(order)
    return real.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != "heading")).select(id_col, "of", F.col("first").alias("boundary"))


def covered(texts: DataFrame, cut: DataFrame, id_col: str = "chunk_id", text_col: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(id, pieces, whole)``: for each text over the limit how many pieces ``pieces()`` made of it, and whether they are as they must be.

    They start and end with the text without a gap, hold what stands there, keep to the limit and the overlap, and wherever a natural
    boundary lies where a piece may end, it ends at one.
    """
    long = oversized(texts, id_col, text_col, limit)
    marks = boundaries(long, id_col, text_col).groupBy(id_col, "of").agg(F.collect_list("boundary").alias("marks"))
    order = F.sort_array(F.collect_list(F.struct("piece", "start", "end", F.col(text_col).alias("piece_text"))))
    lists = cut.groupBy(id_col).agg(order.alias("p"))  # the pieces of one text
    rows = long.join(marks, [id_col, "of"], "left").join(lists, id_col, "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<int>")))
    room = limit - overlap
    least = max(1, room // 4, min(overlap, room))

    def fine(x: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.get("p", i - 1)["end"])
        here = F.substring(F.col(text_col), x["start"] + 1, x["end"] - x["start"]) == x["piece_text"]
        passed = lambda end: F.size(F.filter("marks", lambda m: (m > before) & (m < end)))
        missed = F.exists("marks", lambda m: (m >= before + least) & (m + passed(m) <= before + room))  # a mark takes the room of a character
        at_mark = F.array_contains("marks", x["end"]) | (x["end"] == F.length(text_col))
        return (x["start"] <= before) & (before - x["start"] <= overlap) & (x["end"] > before) & (x["end"] - x["start"] <= limit) & here & (at_mark | ~missed)

    ends = (F.get("p", F.lit(0))["start"] == 0) & (F.element_at("p", -1)["end"] == F.length(text_col))
    ok = ends & F.forall(F.transform("p", fine), lambda b: b)
    return rows.select(id_col, F.coalesce(F.size("p"), F.lit(0)).alias("pieces"), F.coalesce(ok, F.lit(False)).alias("whole"))


def pieces(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content", heading_col: str = "heading", start_col: str = "start_offset", end_col: str = "end_offset", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(id, piece, heading, start, end, place_start, place_end, content)`` for each text over ``limit`` code points.

    Pieces cover the text in order; each but the first repeats up to ``overlap`` code points of the one before, from a
    word's start where there is one. No piece is longer than ``limit``. A piece ends, where it can, before a natural boundary, else
    after a line, a sentence, a word, and else at the limit. ``place`` is the piece's own range between the text's
    offsets, null if these are null or don't fit the text's length. Repeated rows count once.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    texts = oversized(chunks, id_col, text_col, limit, heading_col, start_col, end_col)
    room = limit - overlap
    least = max(1, room // 4, min(overlap, room))  # so that what a piece repeats stands in the one before
    marks = boundaries(texts, id_col, text_col).groupBy(id_col, "of").agg(F.sort_array(F.collect_list("boundary")).alias("marks"))
    # natural boundaries split the text into parts; parts are joined greedily by a bounded expression over marked text
    mark = "\\uFDD0"
    texts = texts.join(marks, [id_col, "of"], "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<int>")))
    edges = F.concat(F.array(F.lit(0)), F.col("marks"), F.array(F.length(text_col)))
    parts = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.substring(F.translate(text_col, "\ufdd0", "\ufdd1"), F.element_at(edges, i) + 1, F.element_at(edges, i + 1) - F.element_at(edges, i)))
    # a quantified class and no quantified group, as the latter would take the stack; a mark takes the room of a character
    run = f"[\\s\\S]{{{least},{room}}}"
    pattern = "|".join((f"{run}(?={mark}|\\z)", f"{run}(?<=[\\r\\n])", f"{run}(?<=[.!?…。！？؟।])(?=\\s|[^\\x00-\\x7f])", f"{run}(?<=\\s)", f"[\\s\\S]{{1,{room}}}"))
    marked = F.regexp_extract_all(F.array_join(parts, "\ufdd0"), F.lit(pattern), F.lit(0))
    cut = texts.withColumn("cut", F.transform(marked, lambda x: F.translate(x, "\ufdd0", "")))
    ends = F.aggregate("cut", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    cut = cut.withColumn("ends", ends)

    def piece(x: Column, i: Column) -> Column:
        start = F.get("ends", i)
        tail = F.when(i > 0, F.right(F.get("cut", i - 1), F.lit(overlap))).otherwise("") if overlap else F.lit("")
        # lookback: from the first word that starts in the overlap, or all of it where no word does
        kept = F.when(F.length(tail) < start, F.regexp_replace(tail, "\\A\\S*\\s+(?=\\S)", "")).otherwise(tail)
        return F.struct(i.alias("piece"), (start - F.length(kept)).alias("start"), F.get("ends", i + 1).alias("end"), F.concat(kept, x).alias("text"))

    # a text that holds the mark itself, which no character is, is cut from the original
    own = F.when(F.contains(text_col, F.lit("\ufdd0")), F.col(text_col)).alias("own")
    out = cut.select(id_col, heading_col, start_col, own, (F.col(end_col) - F.col(start_col) == F.length(text_col)).alias("fits"), F.explode(F.transform("cut", piece)).alias("p"))
    place = lambda c: F.when(F.col("fits"), F.col(start_col) + F.col(f"p.{c}"))
    return out.select(id_col, "p.piece", heading_col, "p.start", "p.end", place("start").alias("place_start"), place("end").alias("place_end"), F.coalesce(F.substring(F.col("own"), F.col("p.start") + 1, F.col("p.end") - F.col("p.start")), F.col("p.text")).alias(text_col))
