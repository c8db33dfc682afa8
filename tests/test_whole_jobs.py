"""Queries on rows that a narrower reading of the job would leave out."""

import hashlib

from mnemora import plans


def stored(spark, folder, **tables):
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def run(spark, name, sf_dir):
    return plans.queries()[name](spark, sf_dir)


def test_key_phrases_in_any_script(spark, tmp_path):
    rows = [(1, "один два три четыре"), (2, "Один\u00a0Два\u3000ТРИ"), (3, "plain ascii words"), (4, "déjà vu encore"), (5, None)]
    got = {tuple(r) for r in run(spark, "key_phrases", stored(spark, tmp_path, documents=("doc_id long, text string", rows))).collect()}
    assert got == {("один два три", 2), ("два три четыре", 1), ("plain ascii words", 1), ("déjà vu encore", 1)}


def test_chunk_digests_of_every_document(spark, tmp_path):
    sources = [("inbox", 1), (None, 2), ("wiki", 3)]
    docs = ("doc_id long, source string", [(i, s) for s, i in sources])
    chunks = [(f"c{i}", f"src:{i}", 0, "", f"text {i}") for i in (1, 2, 3, 4)] + [("c5", "src:1", 1, "", "more")]
    d = stored(spark, tmp_path, documents=docs, chunks_meta=("chunk_id string, doc_id string, chunk_index int, heading string, content string", chunks))
    got = {r.doc_id: r.content for r in run(spark, "chunk_digests", d).collect()}
    assert got == {"src:1": hashlib.sha256(b"text 1\nmore").hexdigest(), "src:2": "text 2", "src:3": "text 3", "src:4": "text 4"}


def test_related_top8_counts_every_part(spark, tmp_path):
    lines = [(1, 1), (1, 10), (1, 3), (2, 1), (2, 3), (2, 3), (3, 10), (4, 7)]
    d = stored(spark, tmp_path, lineitem=("l_suppkey long, l_partkey long", lines))
    got = {(r.concept, r.other, r.shared, r["rank"]) for r in run(spark, "related_top8", d).collect()}
    assert got == {(1, 2, 2, 1), (1, 3, 1, 2), (2, 1, 2, 1), (3, 1, 1, 1)}


def test_session_turns_in_any_language(spark, tmp_path):
    text = "User: hi\n用户：你好\nRéponse: oui\n**Speaker 2**: so\n**Assistant:** yes\nОтвет: да\nUsers: none\nनहीं: x"
    rows = run(spark, "session_turns", stored(spark, tmp_path, documents=("doc_id long, text string", [(1, text)]))).collect()
    assert sorted((r.pos, r.role, r.said) for r in rows) == [
        (0, "user", "hi"), (1, "user", "你好"), (2, "assistant", "oui"), (3, "speaker 2", "so"), (4, "assistant", "yes"), (5, "assistant", "да"),
    ]


def test_code_structure_of_every_language(spark, tmp_path):
    text = "```python\ndef f():\n```\n~~~go\nfunc f() {}\nfunc G() {}\n~~~\n```\ndef plain():\n```\n```sql\nselect 1\n```\n```TypeScript x\nfunction h() {}\n"
    rows = run(spark, "code_structure", stored(spark, tmp_path, documents=("doc_id long, text string", [(1, text), (2, "~~~python\ndef f():\n~~~")]))).collect()
    assert {tuple(r) for r in rows} == {("f", 2), ("G", 1), ("h", 1)}


def test_alias_blocks_of_words_within_the_share(spark, tmp_path):
    rows = [(f"e{i:04}", "t", f"shared name{i}" if i < 65 else f"other{i // 1400} name{i}") for i in range(1400)] + [("f0000", "t", "Name3, shared")]
    d = stored(spark, tmp_path, entities=("id string, type string, name string", rows))
    got = {tuple(r) for r in run(spark, "alias_blocks", d).collect()}
    assert got == {(f"e{i:04}", f"e{j:04}") for i in range(65) for j in range(i + 1, 65)}
    classes = {r.id: r["class"] for r in run(spark, "alias_classes", d).collect()}
    assert len(classes) == 1401 and classes["f0000"] == "e0003" and classes["e0003"] == "e0003"
