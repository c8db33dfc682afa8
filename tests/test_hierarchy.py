import random

from pyspark.sql import functions as F

from mnemora.operators import hierarchy


def found(spark, rows, least=None):
    df = spark.createDataFrame(rows, "id string, parent_id string, updated_at string, path string")
    tree = hierarchy.resolve(hierarchy.latest_parents(df), least)
    return {r.id: (r.root_id, r.depth, "/".join(r.path)) for r in tree.collect()}


def brute(parents):
    out = {}
    for i in parents:
        seen, at = [i], i
        while parents.get(at) and parents[at] in parents and parents[at] not in seen:
            at = parents[at]
            seen.append(at)
        if parents.get(at) and parents[at] in parents:
            circle = seen[seen.index(parents[at]) :]
            out[i] = (min(circle), -1, "")
        else:
            out[i] = (at, len(seen) - 1, "/".join(reversed(seen)))
    return out


def test_paths_roots_circles_and_dirt(spark):
    rows = [
        ("a", None, "1", "x"), ("b", "a", "1", "x"), ("c", "b", "1", "x"), ("c", "b", "1", "x"), ("d", "gone", "1", "x"), ("e", "", "1", "x"),
        ("f", "g", "1", "x"), ("g", "h", "1", "x"), ("h", "f", "1", "x"), ("i", "h", "1", "x"), ("j", "j", "1", "x"), ("k", "i", None, "x"),
        ("m", "a", "1", "x"), ("m", "c", "2", "x"), ("m", "b", None, "x"), (None, "a", "1", "x"), ("n", "a", "1", "x"), ("n", None, "2", "x"),
    ]
    got = found(spark, rows)
    assert got["c"] == ("a", 2, "a/b/c") and got["d"] == ("d", 0, "d") and got["e"] == ("e", 0, "e")
    assert got["m"] == ("a", 3, "a/b/c/m") and got["n"] == ("n", 0, "n")
    assert all(got[x] == ("f", -1, "") for x in "fghik") and got["j"] == ("j", -1, "") and None not in got


def test_a_long_chain_hot_parents_and_random_forests(spark):
    rng = random.Random(3)
    parents = {f"c{i:03}": f"c{i - 1:03}" if i else None for i in range(70)}
    parents |= {f"r{i:03}": rng.choice([f"r{rng.randrange(150):03}", "c050", None]) for i in range(150)}
    parents |= {f"s{i:03}": "c069" for i in range(300)}
    got = found(spark, [(k, v, "1", "") for k, v in parents.items()], least=20)
    assert got == brute(parents)


def test_empty_and_descendants(spark):
    assert found(spark, []) == {}
    tree = hierarchy.resolve(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "x")], "id string, parent string"))
    got = {tuple(r) for r in hierarchy.descendants(tree).select("id", "descendant_id", "distance").collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert tree.where(F.col("depth") < 0).count() == 1
