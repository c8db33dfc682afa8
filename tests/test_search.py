import pytest
from pyspark.sql import functions as F

from mnemora.functions import text as T
from mnemora.operators import cells, fusion, lexical, vectors


def ranks(spark, channel, ids, order=0, chunks=False):
    rows = [(d, c if chunks else None, i + 1) for i, (d, c) in enumerate(x if chunks else (x, None) for x in ids)]
    df = spark.createDataFrame(rows, "id string, chunk string, rank int")
    return fusion.ranked_list(df, channel, order, "id", "chunk" if chunks else None)


def test_fusion_counts_best_ranks(spark):
    got = fusion.fuse([ranks(spark, "bm25", ["A", "B"]), ranks(spark, "vector", ["B", "C"], 1)]).collect()
    by = {r.doc_id: r.score for r in got}
    assert [r.doc_id for r in got] == ["A", "B", "C"] or [r.doc_id for r in got] == ["B", "A", "C"]
    assert by["A"] == pytest.approx(0.7 / 61) and by["B"] == pytest.approx(0.7 / 62 + 0.3 / 61) and by["C"] == pytest.approx(0.3 / 62)
    one = {r.doc_id: r for r in fusion.fuse([ranks(spark, "bm25", [("A", "c1"), ("A", "c2"), ("B", "c1")], 0, True)]).collect()}
    assert one["A"].bm25_rank == 1 and one["A"].chunk_id == "c1" and one["B"].bm25_rank == 3


def test_scaling_blend_and_trust(spark):
    s = lambda *x: spark.createDataFrame(list(x), "doc_id string, rank int, score double")
    assert [r.score for r in fusion.min_max(s(("a", 1, 3.0), ("b", 2, 3.0))).collect()] == [1.0, 1.0]
    few = [(str(i), i + 1, 10.0 - i) for i in range(10)]
    base = {r.doc_id: r.score for r in fusion.blend(s(*few), s(*few[:4]).select("doc_id", "score")).collect()}
    assert base == {r.doc_id: pytest.approx(r.score) for r in fusion.min_max(s(*few)).collect()}
    assert fusion.blend(s(*few), s(*few[:5]).select("doc_id", (-F.col("score")).alias("score"))).where("doc_id = '0'").first().score == pytest.approx(0.75)
    d = spark.createDataFrame([("output:a",), ("output:b",), ("src:1",)], "doc_id string")
    sure = spark.createDataFrame([("output:a",)], "doc_id string")
    assert [fusion.trusted(d, sure, m).count() for m in (True, False, None)] == [3, 1, 2]
    b = spark.createDataFrame([(1, 5), (2, 4), (3, 4), (4, 1)], "at int, tokens int")
    assert [r.at for r in fusion.within_budget(b, "at", "tokens", 9).collect()] == [1, 2]


def test_bm25_prefixes_weights_and_empties(spark):
    e = spark.createDataFrame([("1", "graph graphs", "x", None), ("2", "nothing", "graph", "p"), ("3", None, None, None)], "id string, content string, tags string, article_path string")
    got = {r.id for r in lexical.bm25(e, "id", lexical.ENTRY_WEIGHTS, ["graph"]).collect()}
    assert got == {"1", "2"}
    assert lexical.bm25(e, "id", lexical.ENTRY_WEIGHTS, []).count() == 0
    assert lexical.bm25(e.limit(0), "id", lexical.ENTRY_WEIGHTS, ["graph"]).count() == 0
    assert not lexical.strong_signal(spark.createDataFrame([], "score double")).first()[0]
    assert lexical.strong_signal(spark.createDataFrame([(3.0,)], "score double")).first()[0]


def test_cosine_guards_and_never_merge(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0]), ("d", None)], "id string, embedding array<float>")
    assert {r.id: r.score for r in vectors.cosine_to(v, "id", [2.0, 0.0]).collect()} == {"a": 1.0, "b": 0.0}
    assert vectors.cosine_to(v, "id", [0.0, 0.0]).count() == 0
    names = [("mw-3", "mw-2", True), ("a-17-084", "a-17-84", True), ("plan-draft", "plan-final", True), ("k8s", "k8s", False), ("draft", "other", False)]
    df = spark.createDataFrame(names, "a string, b string, want boolean")
    assert df.where(vectors.never_merge(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    pairs = spark.createDataFrame([("x", "yb", 0.9), ("x", "ya", 0.9), ("x", "y-3", 0.99)], "a string, b string, score double")
    assert vectors.near_duplicates(pairs, vectors.never_merge(F.col("a"), F.col("b"))).first().b == "ya"


def test_cells_find_most_neighbours(spark):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((400, 16))
    v = spark.createDataFrame([(str(i), r.tolist()) for i, r in enumerate(x)], "id string, embedding array<float>")
    c = cells.fit(v, "id", 8)
    exact = cells.search(v, v, "id", c, 8).select("query", "other")
    assert exact.count() == 4000
    assert cells.search(v, v, "id", c, 5).select("query", "other").intersect(exact).count() > 3000


def test_cells_take_matrix_products_not_joined_pairs(spark):
    import numpy as np

    x = np.random.default_rng(2).standard_normal((300, 8)).astype(np.float32)
    x[200:] = x[:100]  # ties
    rows = [(f"r{i:03}", r.tolist()) for i, r in enumerate(x)] + [("none", None), ("zero", [0.0] * 8)]
    v = spark.createDataFrame(rows, "id string, embedding array<float>")
    q = v.where("id < 'r050'")
    c = cells.fit(v.where("embedding is not null"), "id", 6)
    found = cells.search(v, q, "id", c, 6, 5, block=16)
    assert "Join" not in found._jdf.queryExecution().simpleString()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 9)
    want = {(f"r{i:03}", f"r{j:03}", n + 1) for i in range(50) for n, j in enumerate(sorted((j for j in range(300) if j != i), key=lambda j: (-scores[i, j], j))[:5])}
    assert {(r.query, r.other, r["rank"]) for r in found.collect()} == want
    assert cells.search(v, q.limit(0), "id", c, 6).count() == 0


def test_bm25_batch_hands_on_the_best_of_blocks_only(spark):
    docs = spark.range(3000).selectExpr("concat('d', lpad(id, 4, '0')) id", "concat('alpha ', if(id % 3 = 0, 'alphabet ', ''), repeat('beta ', cast(id % 7 as int))) content")
    asked = spark.range(40).selectExpr("concat('q', id) query", "explode(array('alpha', if(id % 2 = 0, 'beta', 'alphab'))) term")
    built = lexical.index(docs, "id", {"content": 1.0})
    found = lexical.search(built, asked, 5)
    rows = found.collect()
    for q, terms in (("q0", ["alpha", "beta"]), ("q1", ["alpha", "alphab"])):
        want = lexical.ranked(lexical.bm25(docs, "id", {"content": 1.0}, terms), "id", 5).collect()
        assert sorted((r["rank"], r.key, r.score) for r in rows if r["query"] == q) == [(r["rank"], r.id, r.score) for r in want]
    assert len(rows) == 200
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # instead of a row for each query and document


def test_text_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(T.token_estimate(F.lit(x))) for x in ("abcdefg", "日本語", "日本語abcd", "")] == [1, 4, 5, 0]
    assert one(T.query_terms(F.lit("The of"))) == ["the", "of"] and one(T.query_terms(F.lit("Self-Attention is"))) == ["self-attention"]
    assert one(T.wikilinks(F.lit("[[Beta Systems]] [[Nonexistent Concept]] [[ ]]"))) == ["Beta Systems", "Nonexistent Concept", " "]
    assert not one(T.is_grounded(F.lit("a b"), F.lit(""))) and one(T.is_grounded(F.lit("A  b\nc"), F.lit("b C")))
    assert one(T.without_filler_sentences(F.lit("Good. In conclusion, bad. Fine.\n```\nin conclusion\n```"))) == "Good. Fine.\n```\nin conclusion\n```"
    assert one(T.without_filler_sentences(F.lit("In summary."))) == "In summary."
    assert one(T.front_matter(F.lit("---\na: 1\n---\nx"))) == "a: 1\n" and one(T.front_matter(F.lit("---\na: 1\nx"))) == ""
    assert one(T.display_name(F.lit("self-attention"))) == "Self Attention" and one(T.slug(F.lit("A b!C"))) == "a-bc"
    assert one(T.source_date(F.lit("---\ndate: 1970-01-02\n---\n"), F.lit(None).cast("long"), F.lit(5).cast("long"))) == 86400
    assert one(T.key_phrases(F.lit("one two three four. a b c"))) == ["one two three", "two three four"]
    assert [one(T.confidence_label(F.lit(x))) for x in (" High", "odd")] == ["high", "medium"]


def test_many_queries_score_as_one_by_one(spark):
    docs = spark.createDataFrame([("a", "graph graph ledger", "x"), ("b", "graphs and edges", None), ("c", None, None), ("d", "ledger of edge", "graph")], "id string, content string, tags string")
    weights = {"content": 1.0, "tags": 1.5}
    built = lexical.index(docs, "id", weights)
    queries = {"q1": ["graph", "edge"], "q2": ["led"], "q3": ["nothing"], "q4": ["graph", "graph"]}
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts] + [("q5", None), ("q6", "")], "query string, term string")
    got = {}
    for r in lexical.search(built, asked, 2).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.key, r.score))
    for q, terms in queries.items():
        want = [(r["rank"], r.id, r.score) for r in lexical.ranked(lexical.bm25(docs, "id", weights, list(dict.fromkeys(terms))), "id", 2).collect()]
        assert sorted(got.get(q, [])) == [(a, b, pytest.approx(c, abs=1e-9)) for a, b, c in sorted(want)]
    assert "q5" not in got and "q6" not in got
    assert lexical.search(lexical.index(docs.limit(0), "id", weights), asked, 2).count() == 0
    assert lexical.search(built, asked.limit(0), 2).count() == 0


def test_channels_pools_and_variants(spark):
    assert fusion.chosen(None) == ["bm25", "vector", "graph"] and fusion.chosen(["graph", "bm25"]) == ["bm25", "graph"]
    with pytest.raises(ValueError, match="fuzzy"):
        fusion.chosen(["bm25", "fuzzy"])
    lengths = []
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")

    def leg(n):
        lengths.append(n)
        return rows

    entries = spark.createDataFrame([("a", "t"), ("b", "u")], "id string, tags string")
    dates = spark.createDataFrame([], "id string, source_date long")
    got, ran = fusion.run({"bm25": [leg], "vector": [leg]}, entries, dates, 0, 5, ["graph", "bm25"])
    assert ran == ["bm25"] and lengths == [5] and [r.doc_id for r in got.orderBy("rank").collect()] == ["a", "b"]
    got, ran = fusion.run({"bm25": [leg]}, entries, dates, 0, 5, require=["u"])
    assert lengths == [5, 15] and [r.doc_id for r in got.collect()] == ["b"]
    assert fusion.run({}, entries, dates, 0, 5)[0].count() == 0
    assert fusion.variants("q", lambda q: {"lex": ["x", "q", ""], "hyde": ["h"]}) == [("original", "q"), ("lex", "x"), ("hyde", "h")]
    assert fusion.variants("q", lambda q: 1 / 0) == [("original", "q")] == fusion.variants("q")

    def stopped(q):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        fusion.variants("q", stopped)


def test_chunks_and_similar_questions(spark):
    c = spark.createDataFrame([("c1", "d1", [1.0, 0.0]), ("c2", "d2", [1.0, 1.0]), ("c3", "d3", [0.0, 1.0]), ("c4", "d4", None)], "chunk_id string, doc_id string, embedding array<float>")
    assert [(r.doc_id, r["rank"]) for r in vectors.chunks_to(c, [1.0, 0.0], 2).orderBy("rank").collect()] == [("d1", 1), ("d2", 2)]
    o = spark.createDataFrame([("o1", "stale", [1.0, 0.0]), ("o2", "pending", [1.0, 0.1]), ("o3", "confirmed", [1.0, 0.1])], "output string, state string, embedding array<float>")
    q = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [-1.0, 0.0])], "question string, embedding array<float>")
    assert [(r.question, r.output) for r in vectors.similar_question(q, o, 0.9).collect()] == [("q1", "o2")]
