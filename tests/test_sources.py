import io
import zipfile

import pytest
from pyspark.sql import functions as F

from mnemora.functions import chunking, providers
from mnemora.sources import code, files


def zipped(**parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return b.getvalue()


def test_a_folder_of_many_formats(spark, tmp_path):
    docx = zipped(**{"word/document.xml": "<w:d xmlns:w='u'><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t><w:tab/></w:r></w:p></w:d>"})
    xlsx = zipped(**{"xl/sharedStrings.xml": "<s><si><t>name</t></si></s>", "xl/worksheets/sheet1.xml": "<w><row><c t='s'><v>0</v></c><c><v>2</v></c></row></w>"})
    pptx = zipped(**{"ppt/slides/slide2.xml": "<a:s xmlns:a='u'><a:p><a:t>B</a:t></a:p></a:s>", "ppt/slides/slide1.xml": "<a:s xmlns:a='u'><a:p><a:t>A</a:t></a:p></a:s>"})
    epub = zipped(**{"c1.xhtml": "<html><body><p>Chapter</p><script>x</script></body></html>"})
    eml = b"From: a@b\nSubject: Hi\nContent-Type: text/plain\n\nBody\n"
    parts = {"a.docx": docx, "b.xlsx": xlsx, "c.pptx": pptx, "d.epub": epub, "e.eml": eml, "f.csv": b"h1,h2\n1,2\n3\n", "g.html": b"<p>Para&amp;</p>", "h.md": b"# T", "i.bin": b"\xff\xfe\xfa", "j.docx": b"no zip", "sub/k.py": b"def f(): pass", ".hidden/x.md": b"x", "skip/y.md": b"y", "z.PNG": b"p"}
    for name, data in parts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    scanned = files.scan(spark, str(tmp_path), ["skip", "*.png"])
    got = {r.rel: r for r in files.extracted(scanned, {"md": lambda b: b.decode().lower()}).collect()}
    assert got["a.docx"].text == "One\nTwo" and got["b.xlsx"].text == "name | 2" and got["c.pptx"].text == "Slide 1:\nA\n\nSlide 2:\nB" and got["d.epub"].text == "Chapter"
    assert got["e.eml"].text == "From: a@b\nSubject: Hi\n\nBody" and got["f.csv"].text == "Headers: h1 | h2\n\n1 | 2\n3" and got["g.html"].text == "Para&" and got["h.md"].text == "# t"
    assert got["i.bin"].text is None and got["j.docx"].error and got["sub/k.py"].type == "code" and set(got) & {".hidden/x.md", "skip/y.md", "z.PNG"} == set()
    assert files.manifest(scanned).where("path = 'h.md'").first().hash.startswith("sha256:")


def test_archives_that_unpack_to_too_much():
    bomb = zipped(**{"word/document.xml": "x" * 5000})
    with pytest.raises(files.TooLarge):
        files.Archive(bomb, entry_most=1000).read("word/document.xml")
    with pytest.raises(files.TooLarge):
        files.Archive(bomb, archive_most=4000).read("word/document.xml")


def test_types_by_signals(spark):
    signals = [{"type": "law", "names": ["act"]}, {"type": "log", "words": ["error", "warn"], "least": 2}, {"type": "memo", "pattern": "MEMO:"}]
    rows = [("x/the-act.md", "", "law"), ("a.txt", "Error and WARN", "article"), ("b.txt", "error, then warn", "log"), ("x/the-Act.md", "", "article"), ("a.csv", "error", "dataset"), ("a.bin", "MEMO: x", "memo"), ("noext", None, "article")]
    df = spark.createDataFrame(rows, "p string, h string, want string")
    assert df.where(~files.signalled_type(F.col("p"), F.col("h"), signals).eqNullSafe(F.col("want"))).count() == 0


def test_code_structure(spark):
    rows = [("a.py", "import os\nfrom x.y import z\nclass A:\n    def f(self): pass\n"), ("b.go", 'package b\nimport "fmt"\ntype T struct {}\nfunc (t T) M() {}\n'), ("c.json", '{\n  "k": 1\n}'), ("d.rs", "use a::b;\npub struct S;\npub async fn g() {}\n"), ("e.txt", "x"), ("f.py", None)]
    got = {r.p: r for r in code.structure(spark.createDataFrame(rows, "p string, t string"), "p", "t").collect()}
    assert (got["a.py"].imports, got["a.py"].types, got["a.py"].functions) == (["os", "x.y"], ["A"], ["f"])
    assert (got["b.go"].imports, got["b.go"].types, got["b.go"].functions) == (["fmt"], ["T"], ["M"]) and got["c.json"].functions == ["k"] and got["d.rs"].functions == ["g"] and "e.txt" not in got
    assert "Types:\n  A" in code.summary(code.structure(spark.createDataFrame(rows[:1], "p string, t string"), "p", "t"), "p").first().summary


def test_chunks():
    assert chunking.chunk(None, 10) == [("", "")] and chunking.chunk("short", 10) == [("", "short")]
    text = "# A\n" + "word " * 30 + "\n## B\n" + "word " * 10 + "\n\n"
    got = chunking.chunk(text, 30)
    assert [h for h, _ in got] == ["A", "A", "B"] or [h for h, _ in got] == ["A", "B"]
    assert all(t for _, t in got)
    paras = chunking.chunk("\n\n".join("p" * 40 for _ in range(6)), 25)
    assert len(paras) == 3 and paras[0][1] == "p" * 40 + "\n\n" + "p" * 40
    lapped = chunking.chunk("\n\n".join(f"{i} " + "字" * 20 for i in range(3)), 31, 2)
    assert lapped[1][1].startswith("字字\n1 ") and chunking.tail("ab cd", 4) == "cd" and chunking.estimate("日本語abcd") == 5


def test_providers(spark):
    v = providers.HashEmbedder(3).embed(["a", "a", "b"])
    assert v[0] == v[1] != v[2] and len(v[0]) == 3
    h = 0x811C9DC5
    for b in b"a\x01":
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    assert v[0][1] == pytest.approx(h % 1000 / 1000)
    df = spark.createDataFrame([("x",), (None,)], "t string")
    assert providers.embedded(df, "t", providers.HashEmbedder(4)).where("size(embedding) = 4").count() == 2
    told = providers.completed(df, F.col("t"), providers.Scripted({"x": 'Sure: ```[{"id": "1", "score": 2.5}]```'})).withColumn("s", providers.rerank_scores(F.col("answer")))
    assert [r.s for r in told.collect()] == [[(("1"), 2.5)], None] or told.first().s[0].score == 2.5
    assert providers.parse_ids("x [1, 2] y") == [1, 2] and providers.parse_ids("none") == []
    lines = providers.table_function(lambda b: ((x,) for x in b.decode().split("\n")), "line string")
    spark.udtf.register("lines_of", lines)
    assert spark.sql("select * from lines_of(cast('a\nb' as binary))").count() == 2


def test_readable_files_pages_and_ingestion(spark):
    rows = [("a.md", b"text", 4), ("b.md", b"\xff\xfe", 2), ("c.md", b"x\x00y", 3), ("d.md", None, 0), ("e.md", "čau".encode(), 4)]
    f = spark.createDataFrame(rows, "rel string, content binary, size long")
    assert {r.rel for r in files.readable(f).collect()} == {"a.md", "e.md"}
    known = spark.createDataFrame([("a.md", "sha256:old", "article", 1), ("z.md", "sha256:z", "article", 9)], "path string, hash string, type string, size long")
    got = {r.path: r.hash for r in files.ingested(files.readable(f), known).collect()}
    assert set(got) == {"a.md", "e.md", "z.md"} and got["a.md"] != "sha256:old" and got["z.md"] == "sha256:z"
    html = [("https://Ex.org/a/?b=1", "<p>One</p><script>no</script>"), ("ftp://ex.org", "<p>x</p>"), ("https://ex.org/empty", "<style>s</style>"), ("https://ex.org/null", None), ("https://Ex.org/a/?b=1", "")]
    found = files.pages(spark.createDataFrame(html, "url string, html string")).collect()
    assert [(r.rel, r.content.strip()) for r in found] == [("raw/ex-org-a-b-1.md", "One")]


def test_names_by_priority(spark):
    from mnemora.operators import links

    docs = spark.createDataFrame([(1, "[[Graph]] and [[graph|it]]")], "id int, text string")
    names = spark.createDataFrame([("graph", "zz", 1), ("Graph", "aa", 2)], "name string, id string, priority int")
    assert links.rewrite(docs, names, "id", "text", links.sanitized).first().text == "[[zz|Graph]] and [[zz|it]]"
    assert links.rewrite(docs, names.drop("priority"), "id", "text", links.sanitized).first().text == "[[aa|Graph]] and [[aa|it]]"
