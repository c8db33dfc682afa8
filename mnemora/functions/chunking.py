"""Sequential chunking of texts by an estimate of tokens, for the few rules that no expression states."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CJK = re.compile(r"[぀-ヿㇰ-ㇿ㐀-鿿ꥠ-꥿가-퟿豈-﫿ᄀ-ᇿ㄰-㆏ヲ-ン]")


def estimate(text: str) -> int:
    cjk = len(_CJK.findall(text))
    return cjk * 3 // 2 + (len(text) - cjk) // 4


def _filled(units: list[str], cost: int, limit: int, opens) -> Iterator[list[str]]:
    """Runs of units of at most ``limit`` tokens, ``cost`` more a unit; a unit that opens a section starts a run. A unit over the limit is a run of its own."""
    run: list[str] = []
    spent = 0
    for unit in units:
        tokens = estimate(unit)
        if run and (spent + tokens > limit or opens(unit)):
            yield run
            run, spent = [], 0
        run.append(unit)
        spent += tokens + cost
    if run:
        yield run


def chunk(text: str | None, limit: int, overlap: int = 0) -> list[tuple[str, str]]:
    """``(heading, text)`` of each chunk: one if the text is within the limit, else by headings or, without any, by paragraphs.

    Blank chunks are dropped. With an overlap, each but the first is led by the last ``overlap`` tokens of four bytes of the
    one before, from a whole character and, where there is one, a word on.
    """
    text = text or ""
    if limit <= 0 or estimate(text) <= limit:
        return [("", text)]
    if "\n## " in text or "\n# " in text:
        opens = lambda line: re.match(r"#{1,3} ", line) is not None
        runs = [(r, "\n".join(r)) for r in _filled(text.split("\n"), 1, limit, opens)]
        found, heading = [], ""
        for lines, joined in runs:
            if opens(lines[0]):
                heading = lines[0].lstrip("#").lstrip(" ")
            found.append((heading, joined.strip()))
    else:
        found = [("", "\n\n".join(r).strip()) for r in _filled(text.split("\n\n"), 2, limit, lambda _: False)]
    found = [(h, t) for h, t in found if t]
    if overlap <= 0:
        return found
    return [(h, t if i == 0 else f"{tail(found[i - 1][1], overlap * 4)}\n{t}") for i, (h, t) in enumerate(found)]


def tail(text: str, size: int) -> str:
    raw = text.encode()
    if len(raw) <= size:
        return text
    kept = raw[-size:].decode(errors="ignore") if size else ""
    rest = re.split(r"[ \n\t]", kept, maxsplit=1)
    return rest[1] if len(rest) == 2 and rest[1] else kept


def chunked(docs: DataFrame, id_col: str, text_col: str, limit: int, overlap: int = 0) -> DataFrame:
    """``(id, chunk_index, heading, content)`` of every row. Null texts give one empty chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, h, t) for k, text in zip(b[id_col], b[text_col]) for i, (h, t) in enumerate(chunk(text, limit, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "chunk_index", "heading", "content"])

    narrow = docs.select(F.col(id_col), F.col(text_col))
    return narrow.mapInPandas(run, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, chunk_index int, heading string, content string")


def reduced(rows: DataFrame, group: str, index: str, text: str, fold, width: int = 8) -> DataFrame:
    """``(group, text)``: consecutive texts folded ``width`` at a time by ``fold(array column)`` until one is left.

    ``index`` runs from 0 without gaps. A run of one passes through.
    """
    rows = rows.select(group, F.col(index).cast("long").alias("i"), F.col(text).alias("t"))
    left = (rows.agg(F.max("i")).first()[0] or 0) + 1
    while left > 1:
        runs = rows.groupBy(group, F.floor(F.col("i") / width).alias("i")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("l"))  # width items at most
        rows = runs.select(group, "i", F.when(F.size("l") == 1, F.col("l")[0]).otherwise(fold(F.col("l"))).alias("t"))
        left = -(-left // width)
    return rows.select(group, F.col("t").alias(text))
