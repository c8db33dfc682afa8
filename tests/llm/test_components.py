import random

from hypothesis import given, settings
from hypothesis import strategies as st

from mnemora.llm import components


def union_find(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def groups(spark, pairs, least=None):
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = components.groups(df, least).collect()
    assert len(rows) == len({r.id for r in rows})
    return {r.id: r.group_id for r in rows}


def test_chains_stars_and_dirt(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    star = [("hub", f"s{i:03}") for i in range(200)]
    rng = random.Random(1)
    noise = [(f"r{rng.randrange(80):02}", f"r{rng.randrange(80):02}") for _ in range(70)]
    pairs = chain + star + noise + [("a", "a"), (None, "b"), ("c", None), ("hub", "s001"), ("s001", "hub")]
    assert groups(spark, pairs) == union_find(pairs)
    assert groups(spark, pairs, least=10) == union_find(pairs)
    assert groups(spark, []) == {}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefghijklmnop"), st.sampled_from("abcdefghijklmnop")), max_size=24))
def test_any_graph(spark, pairs):
    assert groups(spark, pairs) == union_find(pairs)


def test_links_hold_by_the_latest_row(spark):
    rows = [
        ("a", "b", " Applied ", "2", "x"), ("a", "b", "rejected", "1", "x"), ("c", "d", "applied", "1", "x"), ("d", "c", "REJECTED", "2", "x"), ("e", "f", "applied", None, "x"),
        ("g", "h", "applied", None, "x"), ("g", "h", "pending", "1", "x"), ("i", "i", "applied", "1", "x"), ("j", None, "applied", "1", "x"), ("k", "l", None, "1", "x"), ("e", "f", "applied", None, "x"),
    ]
    df = spark.createDataFrame(rows, "alias string, canonical_id string, status string, decided_at string, id string")
    assert sorted(map(tuple, components.applied_links(df).collect())) == [("a", "b"), ("e", "f")]
