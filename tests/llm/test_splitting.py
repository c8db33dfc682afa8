from mnemora.llm import splitting

PAD = "word " * 500
TEXT = (
    "# Title\n\nFirst paragraph\nwrapped.\n\n"
    "Second.\n- item\n\n- item\n  - inner\n\n"
    "| a | b |\n|---|---|\n| 1 | 2 |\n\n"
    "> quote\n> more\n\n---\n\n"
    "```py\n# no heading\n\n- no list\n~~~\n```\n\n"
    "## Next\nStays with it.\n　Indented.\n\nUser: hi\nthere\nAssistant: yes\n\n62. is\n\n" + PAD
)


def bounds(spark, *rows):
    df = spark.createDataFrame([(i, t) for i, t in rows], "chunk_id string, content string")
    long = splitting.oversized(df, "chunk_id", "content", 2000)
    return {(r.chunk_id, r.boundary) for r in splitting.boundaries(long, "chunk_id", "content").collect()}


def test_blocks_of_all_kinds(spark):
    wanted = [TEXT.index(x) for x in ("Second.", "- item", "| a", "> quote", "```py", "## Next", "Indented.", "User:", "Assistant:", "62. is", PAD)]
    assert bounds(spark, ("c", TEXT), ("c", TEXT), ("d", None), ("e", ""), ("f", "short\n\ntext")) == {("c", b) for b in wanted}
    crlf = TEXT.replace("\n", "\r\n")
    assert {crlf[b : b + 4] for _, b in bounds(spark, ("c", crlf))} == {TEXT[w : w + 4].replace("\n", "\r\n")[:4] for w in wanted}


def test_numbers_at_line_starts_and_open_fences(spark):
    text = "See Kap.\n62. Die Seite\n1. item\n2. item\n\n```\n" + "x\n\n" * 1000
    assert {b for _, b in bounds(spark, ("c", text))} == {text.index("1. item"), text.index("```")}


def test_pieces_cover_the_text_within_the_limit(spark):
    long = "。".join(f"句子{i}" for i in range(900))
    rows = [("a", TEXT, "h", 5, 5 + len(TEXT)), ("b", long, None, None, None), ("c", "x" * 5000, "", 1, 2), ("d", None, "h", 0, 0), ("a", TEXT, "h", 5, 5 + len(TEXT)), ("e", "﷐ y\n\n" * 700, "", 0, 3500), ("f", "🚀" * 2300, "", 0, 2300)]
    df = spark.createDataFrame(rows, "chunk_id string, content string, heading string, start_offset int, end_offset int")
    texts = {r[0]: r[1] for r in rows}
    got = {}
    for r in splitting.pieces(df).collect():
        got.setdefault(r.chunk_id, []).append(r)
    assert set(got) == {"a", "b", "c", "e", "f"}
    for k, pieces in got.items():
        pieces.sort(key=lambda r: r.piece)
        at = 0
        for p in pieces:
            assert p.content == texts[k][p.start : p.end] and len(p.content) <= 2000 and at - 200 <= p.start <= at < p.end
            at = p.end
        assert at == len(texts[k]) and [p.piece for p in pieces] == list(range(len(pieces)))
    assert got["a"][0].place_start == 5 and got["c"][0].place_start is None and got["b"][0].place_start is None
    assert all(p.end == len(long) or long[p.end - 1] == "。" for p in got["b"])
    assert splitting.pieces(df.limit(0)).count() == 0


def test_covered_tells_wrong_pieces(spark):
    rows = [("a", TEXT, "h", 5, 5 + len(TEXT)), ("c", "x" * 5000, "", 1, 2), ("d", None, "h", 0, 0)]
    df = spark.createDataFrame(rows, "chunk_id string, content string, heading string, start_offset int, end_offset int")
    cut = splitting.pieces(df).select("chunk_id", "piece", "start", "end", "content")
    assert {tuple(r) for r in splitting.covered(df, cut).select("chunk_id", "whole").collect()} == {("a", True), ("c", True)}
    for wrong in (cut.where("piece <> 1"), cut.withColumn("end", cut["end"] - 1), cut.withColumn("content", cut.piece.cast("string"))):
        assert not any(r.whole for r in splitting.covered(df, wrong).collect())
    assert [r.whole for r in splitting.covered(df, cut.limit(0)).collect()] == [False, False]
