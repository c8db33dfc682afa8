"""Folders of files as rows: paths, types, hashes, texts."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Types by extension; others are articles.
TYPES = {
    "paper": "pdf", "dataset": "xlsx xls csv", "image": "png jpg jpeg gif webp svg bmp",
    "code": "go py js jsx ts tsx rs java c h cc cpp hpp rb php cs swift kt scala sh sql lua r pl json yaml yml toml",
}
#: Bytes that one entry of an archive, and all of them, may unpack to; rows that a table may show.
ENTRY_MOST, ARCHIVE_MOST, ROWS_MOST = 50 << 20, 200 << 20, 1000


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """``(path, rel, size, modified, content)`` of all files below a folder, but for hidden and ignored ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    rows = files.select("path", rel.alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return rows.where(~F.col("rel").rlike(r"(^|/)\.") & ~ignored(F.col("rel"), ignore or []))


def ignored(rel: Column, patterns: list[str]) -> Column:
    """``*.ext`` by ending without case, others as a path, a leading folder, or a folder or name anywhere."""
    tests = []
    for p in patterns:
        if p.startswith("*."):
            tests.append(F.endswith(F.lower(rel), F.lit(p[1:].lower())))
        else:
            tests.append(F.contains(F.concat(F.lit("/"), rel, F.lit("/")), F.lit(f"/{p}/")))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def source_type(path: Column) -> Column:
    ext = extension(path)
    return reduce(lambda w, kv: w.when(ext.isin(kv[1].split()), kv[0]), TYPES.items(), F).otherwise("article")


def signalled_type(path: Column, head: Column, signals: list[dict]) -> Column:
    """The type of the first signal that fits, else by extension.

    A signal has a type, and a pattern that the head holds, or words of the file's name, or words of the head of which at
    least ``least`` (1) stand there, all in the given case.
    """
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    found = []
    for s in signals:
        tests = [F.contains(head, F.lit(s["pattern"]))] if s.get("pattern") else []
        tests += [F.contains(name, F.lit(w)) for w in s.get("names", [])]
        if s.get("words"):
            tests.append(reduce(lambda a, b: a + b, (F.contains(head, F.lit(w)).cast("int") for w in s["words"])) >= s.get("least", 1))
        found.append(F.when(reduce(lambda a, b: a | b, tests, F.lit(False)), s["type"]))
    return F.coalesce(*found, source_type(path))


class _Visible(HTMLParser):
    """Text of HTML without scripts and styles, block elements on lines of their own."""

    blocks = set("p div br li ul ol table tr h1 h2 h3 h4 h5 h6 section article header footer blockquote pre title".split())

    def __init__(self) -> None:
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.blocks:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        if tag in self.blocks:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_text(html: str) -> str:
    parser = _Visible()
    parser.feed(html)
    lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip() for x in "".join(parser.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


class TooLarge(ValueError):
    """An archive that unpacks to more than it may."""


class Archive:
    """Entries of a zip file, none and not all of them larger than they may be when unpacked, whatever their headers say."""

    def __init__(self, raw: bytes, entry_most: int = ENTRY_MOST, archive_most: int = ARCHIVE_MOST):
        self.zip, self.entry_most, self.left = zipfile.ZipFile(io.BytesIO(raw)), entry_most, archive_most

    def names(self, pattern: str) -> list[str]:
        number = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
        return sorted((n for n in self.zip.namelist() if re.fullmatch(pattern, n)), key=number)

    def read(self, name: str) -> bytes:
        most = min(self.entry_most, self.left)
        with self.zip.open(name) as f:
            data = f.read(most + 1)
        if len(data) > most:
            raise TooLarge(name)
        self.left -= len(data)
        return data


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def _paragraphs(xml: bytes, paragraph: str) -> str:
    """Text of each paragraph element on a line."""
    lines = []
    for p in ElementTree.fromstring(xml).iter():
        if _local(p) == paragraph:
            lines.append("".join({"t": t.text or "", "tab": "\t", "br": "\n"}.get(_local(t), "") for t in p.iter()))
    return "\n".join(lines)


def docx_text(raw: bytes) -> str:
    return _paragraphs(Archive(raw).read("word/document.xml"), "p").strip()


def pptx_text(raw: bytes) -> str:
    a = Archive(raw)
    slides = [_paragraphs(a.read(n), "p") for n in a.names(r"ppt/slides/slide\d+\.xml")]
    return "\n\n".join(f"Slide {i + 1}:\n{s.strip()}" for i, s in enumerate(slides)).strip()


def xlsx_text(raw: bytes) -> str:
    """Rows of each sheet, cells apart by bars."""
    a = Archive(raw)
    shared = []
    if a.names(r"xl/sharedStrings\.xml"):
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in ElementTree.fromstring(a.read("xl/sharedStrings.xml")) if _local(si) == "si"]
    sheets = []
    for n in a.names(r"xl/worksheets/sheet\d+\.xml"):
        rows = []
        for row in (x for x in ElementTree.fromstring(a.read(n)).iter() if _local(x) == "row"):
            cells = []
            for c in (x for x in row if _local(x) == "c"):
                value = next((v.text or "" for v in c.iter() if _local(v) in ("v", "t")), "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            rows.append(" | ".join(cells))
        sheets.append("\n".join(rows))
    return "\n\n".join(sheets).strip()


def epub_text(raw: bytes) -> str:
    a = Archive(raw)
    return "\n\n".join(html_text(a.read(n).decode(errors="replace")) for n in a.names(r".*\.x?html?")).strip()


def eml_text(raw: bytes) -> str:
    """Headers that matter, then the plain body, else the HTML one as text."""
    m = email.message_from_bytes(raw, policy=email.policy.default)
    head = "\n".join(f"{h}: {m[h]}" for h in ("From", "To", "Date", "Subject") if m[h])
    part = m.get_body(("plain", "html"))
    text = part.get_content() if part else ""
    return f"{head}\n\n{html_text(text) if part and part.get_content_subtype() == 'html' else text.strip()}".strip()


def csv_text(raw: bytes) -> str:
    """The first row as headers, then at most a thousand rows, ragged ones too, and how many more there are."""
    rows = list(csv.reader(io.StringIO(raw.decode("utf-8-sig", errors="replace"))))
    if not rows:
        return ""
    lines = ["Headers: " + " | ".join(rows[0]), "", *(" | ".join(r) for r in rows[1 : ROWS_MOST + 1])]
    if (more := len(rows) - 1 - ROWS_MOST) > 0:
        lines += ["", f"... ({more} more rows truncated)"]
    return "\n".join(lines).strip()


READERS = {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text, "epub": epub_text, "eml": eml_text, "csv": csv_text, "html": None, "htm": None}


def extracted(files: DataFrame, readers: dict | None = None) -> DataFrame:
    """``(rel, type, text, error)`` of scanned files by extension; other files must be valid UTF-8 texts.

    A file that can't be read has a null text and an error. ``readers`` adds or replaces functions of bytes, as for PDF.
    """
    known = READERS | {"html": lambda b: html_text(b.decode(errors="replace")), "htm": lambda b: html_text(b.decode(errors="replace"))} | (readers or {})

    def read(rel: str, content: bytes) -> tuple[str | None, str | None]:
        reader = known.get(rel.rpartition(".")[2].lower()) if "." in rel else None
        try:
            return (reader(content) if reader else content.decode("utf-8-sig")), None
        except Exception as e:  # noqa: BLE001  one bad file must not end the scan
            return None, f"{type(e).__name__}: {e}"[:200]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [read(r, bytes(c)) for r, c in zip(b["rel"], b["content"])]
            yield pd.DataFrame({"rel": b["rel"], "type": b["type"], "text": [t for t, _ in found], "error": [e for _, e in found]})

    return files.select("rel", source_type(F.col("rel")).alias("type"), "content").mapInPandas(run, "rel string, type string, text string, error string")


def manifest(files: DataFrame) -> DataFrame:
    """``(path, hash, type, size)`` of scanned files, for corpus.diff()."""
    return files.select(F.col("rel").alias("path"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"), source_type(F.col("rel")).alias("type"), "size")


def readable(files: DataFrame, content: str = "content") -> DataFrame:
    """Files whose bytes are text: valid UTF-8 without a zero byte. Null contents aren't."""
    text = F.col(content).cast("binary")
    return files.where(F.coalesce(F.is_valid_utf8(text.cast("string")) & ~F.contains(text, F.lit(b"\x00")), F.lit(False)))


def ingested(files: DataFrame, known: DataFrame) -> DataFrame:
    """The manifest ``(path, hash, type, size)`` after scanned files were taken in: theirs, and known rows of other paths."""
    new = manifest(files)
    return known.join(new.select("path"), "path", "left_anti").select(*new.columns).unionByName(new)


def pages(fetched: DataFrame, folder: str = "raw") -> DataFrame:
    """``(rel, content, url)`` files out of fetched pages ``(url, html)``: the visible text under a name made of the address.

    Pages without text, or with another scheme than http or https, are left out; of equal addresses one page, the largest, is taken.
    """
    visible = F.pandas_udf(lambda html: html.map(lambda h: html_text(h) if h else None), "string")
    name = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace("url", r"^https?://", "")), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    once = fetched.where(F.col("url").rlike(r"^https?://[^/\s]")).groupBy("url").agg(F.max("html").alias("html"))
    rows = once.select(F.concat(F.lit(folder + "/"), name, F.lit(".md")).alias("rel"), visible("html").alias("content"), "url")
    return rows.where(F.trim(F.coalesce("content", F.lit(""))) != "")


def append_jsonl(rows: DataFrame, folder: str) -> None:
    """Adds rows as JSON lines; readers take files as they appear."""
    rows.write.mode("append").json(folder)
