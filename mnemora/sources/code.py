"""Structure of source code by patterns: imports, types and functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns made by hand: for each language its extensions and the patterns of its imports, types and functions, the name in group 1.
LANGUAGES = {
    "python": ("py", r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", r"(?m)^\s*class\s+(\w+)", r"(?m)^\s*(?:async\s+)?def\s+(\w+)"),
    "go": ("go", r'(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$', r"(?m)^type\s+(\w+)\s+(?:struct|interface)", r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)"),
    "javascript": ("js jsx ts tsx", r"""(?m)(?:from\s+|require\(\s*|^\s*import\s+)['"]([^'"\n]+)['"]""", r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum|type)\s+(\w+)", r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    "rust": ("rs", r"(?m)^\s*(?:pub\s+)?use\s+([^;\n]+);", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(\w+)", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"),
    "java": ("java", r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+);", r"(?m)^\s*(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|interface|enum|record)\s+(\w+)", r"(?m)^\s+(?:(?:public|private|protected|static|final|synchronized)\s+)+[\w<>\[\], ]+\s(\w+)\s*\("),
    "c": ("c h cc cpp hpp", r'(?m)^\s*#include\s+[<"]([^>"\n]+)[>"]', r"(?m)^\s*(?:typedef\s+)?(?:struct|enum|union|class)\s+(\w+)", r"(?m)^[A-Za-z_][\w\s*]*?\b(\w+)\s*\([^;{}]*\)\s*\{"),
    "ruby": ("rb", r"(?m)^\s*require(?:_relative)?\s+['\"]([^'\"\n]+)['\"]", r"(?m)^\s*(?:class|module)\s+([\w:]+)", r"(?m)^\s*def\s+([\w.?!=]+)"),
    "json": ("json", r"$^", r"$^", r'(?m)^ {0,2}"([^"\n]+)"\s*:'),
    "yaml": ("yaml yml", r"$^", r"$^", r"(?m)^([\w.-]+):"),
    "toml": ("toml", r"$^", r"(?m)^\s*\[+([^\]\n]+)\]+", r"(?m)^([\w.-]+)\s*="),
}


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return reduce(lambda w, kv: w.when(ext.isin(kv[1][0].split()), kv[0]), LANGUAGES.items(), F).otherwise(F.lit(None))


def structure(files: DataFrame, path: str, text: str) -> DataFrame:
    """``(path, language, imports, types, functions)`` of files of a known language, names in order and once each."""
    lang = language(F.col(path))

    def names(part: int) -> Column:
        def of(pattern: str) -> Column:
            first = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
            second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if pattern.count("(") - pattern.count("(?") > 1 and "|import" in pattern else None
            both = first if second is None else F.zip_with(first, second, lambda a, b: F.when(a != "", a).otherwise(b))
            return F.array_distinct(both)

        return reduce(lambda w, kv: w.when(F.col("language") == kv[0], of(kv[1][part])), LANGUAGES.items(), F).otherwise(F.array().cast("array<string>"))

    rows = files.select(path, text, lang.alias("language")).where("language is not null")
    return rows.select(path, "language", names(1).alias("imports"), names(2).alias("types"), names(3).alias("functions"))


def summary(rows: DataFrame, path: str) -> DataFrame:
    """``(path, summary)``: the structure as text, parts without names left out."""
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{title}:\n  "), F.array_join(c, "\n  "), F.lit("\n"))).otherwise("")
    return rows.select(path, F.concat(F.lit("Language: "), "language", F.lit("\n"), part("Imports", "imports"), part("Types", "types"), part("Functions", "functions")).alias("summary"))
