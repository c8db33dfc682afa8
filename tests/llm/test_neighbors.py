import numpy as np

from mnemora.llm import neighbors


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 9)
    return {(ids[i], ids[j]) for i in range(len(ids)) for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]}


def table(spark, ids, x):
    return spark.createDataFrame([(i, [float(v) for v in r], len(r)) for i, r in zip(ids, x)], "id string, embedding array<float>, dimensions int")


def clustered(n, seed=0, width=64):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((20, width))
    return (c[rng.integers(0, 20, n)] + 0.6 * rng.standard_normal((n, width))).astype(np.float32)


def test_small_tables_are_exact_with_copies_and_scaled_copies(spark):
    x = clustered(300)
    x[10:40] = x[10]
    x[50:60] = x[50] * np.linspace(1, 9, 10, dtype=np.float32)[:, None]
    ids = [f"v{i:03}" for i in range(300)]
    got = {(r.id, r.other) for r in neighbors.nearest(table(spark, ids, x), k=5).collect()}
    want = brute(ids, x.astype(np.float64), 5)
    assert len(got) == 1500 and len(got & want) / len(want) > 0.995


def test_full_buckets_are_hashed_again(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 200)
    monkeypatch.setattr(neighbors, "BUCKET", 50)
    x = clustered(1500, 1)
    x[:500] = x[0] + 0.01 * np.random.default_rng(3).standard_normal((500, 64)).astype(np.float32)
    ids = [f"v{i:04}" for i in range(1500)]
    got = {(r.id, r.other) for r in neighbors.nearest(table(spark, ids, x)).collect()}
    want = brute(ids, x.astype(np.float64), 10)
    assert len(got) == len(want) and len(got & want) / len(want) > 0.9


def test_vectors_that_no_slot_tells_apart_tie_to_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 100)
    monkeypatch.setattr(neighbors, "ASKED_MOST", 120)  # and their bucket is copied to several tasks
    x = clustered(600, 5)
    x[100:400] = x[100] * np.linspace(1, 3, 300, dtype=np.float32)[:, None]  # one direction, not one class
    ids = [f"v{i:03}" for i in range(600)]
    got = {}
    for r in neighbors.nearest(table(spark, ids, x)).collect():
        got.setdefault(r.id, []).append(r.other)
    assert len(got) == 600 and all(len(v) == 10 for v in got.values())
    for i in range(100, 400):
        assert sorted(got[ids[i]]) == [v for v in ids[100:111] if v != ids[i]][:10]
    want = brute(ids, x.astype(np.float64), 10)
    assert len({(a, b) for a, v in got.items() for b in v} & want) / len(want) > 0.9


def test_hot_class_and_repeated_rows(spark, monkeypatch):
    from mnemora import runtime

    monkeypatch.setattr(runtime, "HOT_LEAST", 50)
    x = clustered(300, 2)
    x[50:150] = x[50]
    ids = [f"v{i:03}" for i in range(300)]
    rows = table(spark, ids, x)
    got = {(r.id, r.other) for r in neighbors.nearest(rows.unionByName(rows)).collect()}
    want = brute(ids, x.astype(np.float64), 10)
    assert len(got) == 3000 and len(got & want) / len(want) > 0.99


def test_one_id_with_several_vectors_counts_once(spark):
    x = clustered(40, 4)
    rows = table(spark, [*(f"v{i}" for i in range(38)), "v0", "v1"], x)
    got = neighbors.nearest(rows).collect()
    assert len(got) == 380 and len({(r.id, r.other) for r in got}) == 380


def test_recall_against_brute_force(spark):
    x = clustered(3000, 6)
    rows = table(spark, [f"v:{i}" for i in range(3000)], x)
    r = neighbors.recall(rows, rows.where("substring_index(id, ':', -1) % 100 = 0")).first()
    assert (r.n_queries, r.wanted) == (30, 300) and r.recall >= 0.9
    assert neighbors.recall(rows.limit(0), rows).first().recall is None


def test_unusable_vectors_are_in_no_pair(spark):
    good = clustered(3)
    rows = [("a", good[0].tolist()), ("b", good[1].tolist()), ("b", good[1].tolist()), ("z", [0.0] * 64), ("n", [float("nan")] + [1.0] * 63), ("i", [float("inf")] + [1.0] * 63), ("s", [1.0] * 63), ("e", []), ("m", None), ("h", [None] + [1.0] * 63), (None, good[2].tolist())]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    assert {tuple(r) for r in neighbors.pairs(neighbors.nearest(df)).collect()} == {("a", "b")}
    assert neighbors.nearest(df.limit(0)).count() == 0


def test_estimates_are_chances():
    h = neighbors.Hashing(64, 8)
    assert abs(neighbors._tail(np.array([0.0, 1.0, 2.0])) - [0.5, 0.158655, 0.02275]).max() < 1e-6
    assert h.sets[:2] == [(), (0,)] and len(set(h.sets)) == len(h.sets) and all(15 - i not in s for s in h.sets for i in s)
