"""Hooks for models, with stand-ins that give the same result every time."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """FNV-1a of the text and the dimension's number, below 1000, over 1000."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        extra = np.arange(self.dimensions, dtype=np.uint64) & np.uint64(0xFF)
        out = []
        for text in texts:
            h = 0x811C9DC5
            for byte in text.encode():
                h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
            last = (np.uint64(h) ^ extra) * np.uint64(0x01000193) & np.uint64(0xFFFFFFFF)
            out.append(((last % np.uint64(1000)).astype(np.float32) / np.float32(1000)).tolist())
        return out


def embedded(rows: DataFrame, text: str, embedder: Embedder, column: str = "embedding") -> DataFrame:
    """Rows with a vector of each text in Arrow batches; a null text is embedded as an empty one."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(texts.fillna("").tolist()))

    return rows.withColumn(column, run(F.col(text)))


class Completer(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


class Scripted:
    """Answers by the first pattern that a prompt matches."""

    def __init__(self, answers: dict[str, str], otherwise: str = ""):
        self.answers, self.otherwise = answers, otherwise

    def complete(self, prompts: list[str]) -> list[str]:
        return [next((a for p, a in self.answers.items() if re.search(p, x)), self.otherwise) for x in prompts]


def completed(rows: DataFrame, prompt: Column, completer: Completer, column: str = "answer") -> DataFrame:
    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(completer.complete(prompts.fillna("").tolist()))

    return rows.withColumn(column, run(prompt))


def rerank_scores(answer: Column) -> Column:
    """``array<struct<id, score>>`` out of a model's answer: from the first bracket to the last, fences ignored; null if it doesn't parse."""
    return F.from_json(F.nullif(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), F.lit("")), "array<struct<id:string,score:double>>")


def parse_ids(answer: str) -> list:
    """The JSON list in an answer, or an empty one."""
    m = re.search(r"\[.*\]", answer, re.DOTALL)
    try:
        return json.loads(m[0]) if m else []
    except json.JSONDecodeError:
        return []


def table_function(parse: Callable[[bytes], Iterator[tuple]], schema: str):
    """A UDTF of a parser of file contents, to be registered by the caller that trusts it."""

    class Parser:
        def eval(self, content: bytes):
            yield from parse(bytes(content or b""))

    return F.udtf(Parser, returnType=schema)
