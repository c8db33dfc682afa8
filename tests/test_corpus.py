import pytest
from pyspark.sql import functions as F

from mnemora.operators import corpus


def test_diff_and_feed(spark):
    c = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y"), ("n", "1", "x"), ("s", "1", "x")], "path string, hash string, type string")
    m = spark.createDataFrame([("a", "2", "x"), ("b", "1", "x"), ("g", "1", "x"), ("s", "1", "x")], "path string, hash string, type string")
    assert dict(map(tuple, corpus.diff(c, m).collect())) == {"a": "Modified", "b": "Modified", "n": "Added", "g": "Removed"}
    k = m.withColumn("deleted", F.col("path") == "s")
    assert dict(map(tuple, corpus.change_feed(c, k).collect())) == {"a": "Upsert", "n": "Upsert", "s": "Upsert", "g": "Delete"}
    assert corpus.diff(c.limit(0), m.limit(0)).count() == 0


def test_three_way_merge(spark):
    kv = lambda *x: spark.createDataFrame(list(x), "key string, value string")
    got = dict(map(tuple, corpus.merge_three_way(kv(("a", "0"), ("b", "0"), ("c", "0"), ("d", "0")), kv(("a", "1"), ("c", "0"), ("d", "0"), ("n", "1")), kv(("a", "2"), ("b", "2"), ("c", "2"))).collect()))
    assert got == {"a": "1", "c": "2", "n": "1"}


def test_quality_dimensions(spark):
    rows = [("a", "no links ``` here", ""), ("b", "---\nconcept: x\n---\n## H\nthe quick brown fox [[K]] [[L]] in summary in summary", "The quick brown fox."), ("n", None, None)]
    got = {r.id: r for r in corpus.quality(spark.createDataFrame(rows, "id string, text string, source_text string"), spark.createDataFrame([("K",)], "name string")).collect()}
    assert got["a"].wikilink == 1 and got["a"].format == 0 and got["a"].coverage == 0 and got["a"].grounding == 0
    assert got["b"].format == 1 and got["b"].wikilink == 0.5 and got["b"].anti_pattern == pytest.approx(0.8) and got["b"].grounding == 1 and got["n"].coverage == 0


def test_independence_is_a_mean_distance(spark):
    rows = [("o", "a", 1), ("o", "a", 2), ("o", "b", 2), ("o", "b", 3), ("o", "c", 1), ("o", "c", 2), ("p", "a", 1)]
    got = {r.output: r.independence for r in corpus.independence(spark.createDataFrame(rows, "output string, confirmation string, chunk int")).collect()}
    assert got == {"o": pytest.approx(4 / 9, abs=1e-6), "p": 0.0}


def test_sums_cascades_and_folds(spark):
    u = spark.createDataFrame([("x", 1.5), ("x", None), ("y", 1.0), ("y", 2.0)], "k string, cost double")
    assert dict(map(tuple, u.groupBy("k").agg(corpus.strict_sum(F.col("cost"))).collect())) == {"x": None, "y": 3.0}
    c = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3), ("C", 2), ("C", 3)], "name string, source int")
    kept, deferred = corpus.without_sources(c, spark.createDataFrame([(2,), (3,)], "source int"))
    assert {(r.name, r.source) for r in kept.collect()} == {("A", 1), ("B", 3), ("C", 3)} and [r.source for r in deferred.collect()] == [3]
    pruned, none = corpus.without_sources(c, spark.createDataFrame([(2,), (3,)], "source int"), prune=True)
    assert {(r.name, r.source) for r in pruned.collect()} == {("A", 1)} and none.count() == 0
    f = spark.createDataFrame([("Self Attention", ["attention"]), ("Attention", None), ("Other", [])], "name string, aliases array<string>")
    assert dict(map(tuple, corpus.fold_concepts(f).collect())) == {"Self Attention": "Self Attention", "Attention": "Self Attention", "Other": "Other"}
    d = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "")], "id int, text string")
    assert sorted(map(tuple, corpus.exact_copies(d, "id", "text").collect())) == [(1, 1, 2), (2, 1, 2)]


def test_lint(spark):
    d = spark.createDataFrame([(1, "---\na: 1\n---\n# H\nTODO [[X]]", "2024-01-01 00:00:00"), (2, None, None)], "id int, text string, c string").withColumn("changed", F.col("c").cast("timestamp"))
    got = {(r.id, r.rule, r.detail) for r in corpus.lint(d, spark.createDataFrame([("y",)], "name string"), "2024-10-01").collect()}
    assert got == {(1, "completeness", "X"), (1, "impute", "TODO"), (1, "short section", "H"), (1, "staleness", "")}


def test_queue_rows_of_another_hash_start_anew(spark):
    old = spark.createDataFrame([("a", "1", 5, "done", 2, "w", True), ("b", "1", 5, "done", 1, "w", True), ("c", "1", 5, "error", 1, None, None)], "path string, hash string, size_bytes int, status string, attempts int, lease string, indexed boolean")
    new = spark.createDataFrame([("a", "1", 6), ("b", "2", 6), ("d", None, 6)], "path string, hash string, size_bytes int")
    got = {r.path: tuple(r)[1:] for r in corpus.queue_upsert(old, new, ["indexed"]).collect()}
    assert got == {"a": ("1", 6, "done", 2, "w", True), "b": ("2", 6, "pending", 0, None, False), "c": ("1", 5, "error", 1, None, None), "d": (None, 6, "pending", 0, None, False)}
    assert corpus.queue_upsert(old.limit(0), new.limit(0), ["indexed"]).count() == 0


def test_tiers_by_the_nearest_folder(spark):
    files = spark.createDataFrame([("a/b/x.md", None), ("a/y.md", None), ("z.md", None), ("q.bin", None), ("a/b/own.md", 0)], "path string, own int")
    folders = spark.createDataFrame([("a", 2), ("a/b", 3)], "folder string, tier int")
    got = dict(map(tuple, corpus.resolved_tier(files, folders, {"md": 5}).collect()))
    assert got == {"a/b/x.md": 3, "a/y.md": 2, "z.md": 5, "q.bin": 1, "a/b/own.md": 0}


def test_unions_and_stale_outputs(spark):
    d = spark.createDataFrame([(["b", "a"], ["a", "c"]), (None, ["x"]), (None, None)], "a array<string>, b array<string>")
    assert [r.u for r in d.select(corpus.ordered_union(F.col("a"), F.col("b")).alias("u")).collect()] == [["b", "a", "c"], ["x"], []]
    o = spark.createDataFrame([("o1", "s1", "1"), ("o1", "s2", "1"), ("o2", "s3", None)], "output string, source string, hash string")
    now = spark.createDataFrame([("s1", "1"), ("s2", "2")], "source string, hash string")
    assert {tuple(r) for r in corpus.stale_outputs(o, now).collect()} == {("o1", "s2")}
