from pyspark.sql import functions as F

from mnemora.operators import graph, louvain

EDGE = "source_id string, target_id string, relation string, confidence double, valid_from string, valid_to string"


def edges(spark, *rows):
    return spark.createDataFrame([(*r, *(0.5, "", "")[len(r) - 3 :]) if len(r) < 6 else r for r in rows], EDGE)


def test_live_at_has_an_exclusive_end(spark):
    e = edges(spark, ("a", "b", "x"), ("a", "c", "x", 0.5, "2020-01-01", "2025-06-01"), ("a", "d", "x", 0.5, "2099", ""))
    live = lambda t: sorted(r.target_id for r in e.where(graph.live_at(t)).collect())
    assert live("2026-01-01") == ["b"] and live("2024-01-01") == ["b", "c"] and live("2025-06-01") == ["b"]


def test_relation_fold_keeps_the_first_winning_date(spark):
    rows = [("s", "t", "r", 0.5, "e1", "", 1), ("s", "t", "r", 0.5, "e2", "2024", 2), ("s", "t", "r", 0.9, "e3", "2023", 3), ("s", "t", "r", 0.95, "e4", "2022", 4), ("s", "s", "r", 1.0, "e", "", 5)]
    got = graph.fold_relations(spark.createDataFrame(rows, "source_id string, target_id string, relation string, confidence double, evidence string, valid_from string, seq long")).collect()
    assert [(r.confidence, r.valid_from, r.evidence, r.first_seq) for r in got] == [(0.95, "2023", "e4", 1)]


def test_supersession_ends_others_and_only_once(spark):
    e = edges(spark, ("s", "t1", "f", 0.5, "2024-06", ""), ("s", "t2", "f", 0.5, "2025-03", ""), ("s", "t3", "f", 0.5, "2023", "2024"))
    got = {r.target_id: r.valid_to for r in graph.supersede(e, spark.createDataFrame([], "id string, root string"), "f").collect()}
    assert got == {"t1": "2025-03", "t2": "", "t3": "2024"}
    same = spark.createDataFrame([("t1", "t2")], "id string, root string")
    assert {r.target_id: r.valid_to for r in graph.supersede(e, same, "f").collect()}["t1"] == ""


def test_alias_chain_stamps_the_last_hop_and_shadows(spark):
    aliases = spark.createDataFrame([("zz", "yy"), ("yy", "xx")], "alias string, canonical_id string")
    got = {(r.alias_id, r.source_id, r.target_id) for r in graph.sweep(edges(spark, ("zz", "k", "x")), aliases).collect()}
    assert got == {("zz", "yy", "k"), ("yy", "xx", "k")}
    shown = graph.edge_view(edges(spark, ("c", "k", "extends")), spark.createDataFrame([("b", "c", "k", "extends", 0.1, "", ""), ("a", "c", "m", "x", 0.1, "", ""), ("b", "c", "m", "x", 0.2, "", "")], "alias_id string, " + EDGE))
    assert sorted((r.target_id, r.alias_id) for r in shown.collect()) == [("k", ""), ("m", "a")]


def test_graph_leg_takes_the_cheaper_way(spark):
    e = edges(spark, ("S", "X", "cites"), ("S", "Y", "extends"), ("Y", "X", "contradicts"))
    entities = spark.createDataFrame([(i, "p") for i in "SXY"], "id string, article_path string")
    none = spark.createDataFrame([], "alias string, canonical_id string")
    assert [(r.id, round(r.score, 6)) for r in graph.graph_leg(e, entities, none, ["S"], 10).collect()] == [("S", 0.0), ("Y", 1.0), ("X", 1.428571)]
    assert graph.graph_leg(e, entities, none, [], 10).count() == 0


def test_two_triangles(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    e = edges(spark, *((a, b, "x") for a, b in pairs))
    found = louvain.communities(e).where("level = 0")
    assert {r.id: r.community for r in found.collect()} == dict(zip("abcdef", "aaaddd"))
    assert graph.modularity(e, found.select("id", "community")).first()[0] == 0.357143
    assert {tuple(r)[1:] for r in louvain.described(found, e).where("level = 0").collect()} == {("a", None, 3, 3), ("d", None, 3, 3)}
    assert graph.label_communities(e).count() == 6
    assert louvain.communities(e.limit(0)).count() == 0


def test_louvain_of_more_edges_than_two_million(spark):
    e = spark.range(2_000_002).selectExpr("concat('n', id % 6) source_id", "concat('n', case when id % 6 = 5 and id < 999 then 0 else (id % 6) div 3 * 3 + (id + 1) % 3 end) target_id")
    found = {(r.id, r.community) for r in louvain.communities(e).where("level = 0").collect()}
    assert found == {(f"n{i}", f"n{i // 3 * 3}") for i in range(6)}


def test_louvain_is_the_sequential_one(spark, monkeypatch):
    import random
    from collections import defaultdict

    rng = random.Random(3)
    pairs = [(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(260)) if a % 4 == b % 4 or rng.random() < 0.2]
    name = lambda i: f"n{i:02}"
    weights = defaultdict(lambda: defaultdict(float))
    for a, b in pairs:
        if a != b:
            weights[name(a)][name(b)] += 1
            weights[name(b)][name(a)] += 1
    size = {n: sum(x.values()) for n, x in weights.items()}
    total, of, load, moved = sum(size.values()), {n: n for n in weights}, dict(size), True
    while moved:
        moved = False
        for n in sorted(weights):
            pull = defaultdict(float)
            for v, w in weights[n].items():
                pull[of[v]] += w
            home = best = of[n]
            load[home] -= size[n]
            pull.setdefault(home, 0.0)
            most = 0.0
            for c in sorted(pull):
                if (gain := pull[c] - load[c] * size[n] / total) > most + louvain.MOVE:
                    best, most = c, gain
            load[best] += size[n]
            moved |= best != home
            of[n] = best
    least = {c: min(n for n in of if of[n] == c) for c in set(of.values())}
    e = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "source_id string, target_id string")
    for wide in (0, 200):
        monkeypatch.setattr(louvain, "WIDE", wide)
        index = {n: i for i, n in enumerate(sorted(weights))}
        rows = [(index[n], index[v], w) for n in sorted(weights) for v, w in sorted(weights[n].items())]
        import numpy as np

        m = louvain.Matrix([tuple(np.array(x) for x in zip(*rows))], len(index))
        assert dict(zip(sorted(weights), louvain.levels(m)[0].tolist())) == {n: index[least[of[n]]] for n in of}
    assert {(r.id, r.community) for r in louvain.communities(e).where("level = 0").collect()} == {(n, least[of[n]]) for n in of}


def test_components_circles_and_neighbours(spark):
    links = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "z")], "a string, b string")
    assert {r.id: r.component for r in graph.components(links).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    e = edges(spark, ("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r"), ("c", "b", "r"))
    assert sorted(r.path for r in graph.cycles(e).collect()) == ["a>b>c", "b>c"]
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.depth) for r in graph.neighbors(e, start, 2, "out").collect()} == {("b", 1), ("c", 2)}
    assert graph.neighbors(e.limit(0), start, 2).count() == 0


def test_canonical_follows_chains_but_not_circles(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("n", None)], "alias string, canonical_id string")
    assert {r.alias: r.canonical_id for r in graph.canonical(a).collect()} == {"a": "c", "b": "c", "x": "x", "y": "y"}


def test_stated_relations_and_blocks(spark):
    d = spark.createDataFrame([("d", "It extends [[A]].\n\nNothing on [[B]].\r\n\r\n[[C]] builds on this, as [[d]] does."), ("n", None)], "id string, text string")
    assert {tuple(r) for r in graph.stated_relations(d, "id", "text").collect()} == {("d", "A", "extends"), ("d", "C", "extends")}
    e = spark.createDataFrame([("1", "t", "graph store"), ("2", "t", "graph index"), ("3", "u", "graph"), ("4", "t", None)], "id string, type string, name string")
    assert [tuple(r) for r in graph.blocks(e, F.split("name", " ")).collect()] == [("1", "2")]


def test_related_counts_large_sources_without_their_pairs(spark):
    import random

    rng = random.Random(2)
    rows = {(f"c{i:03}", s) for i in range(60) for s in rng.sample(range(40), 3)} | {(f"c{i:03}", 100 + s) for i in range(60) for s in range(3) if rng.random() < 0.6} | {(f"d{i:02}", 100) for i in range(12)}
    df = spark.createDataFrame(sorted(rows), "concept string, source int")
    of = {}
    for c, s in rows:
        of.setdefault(c, set()).add(s)
    want = set()
    for c in of:
        best = sorted(((-len(of[c] & of[o]), o) for o in of if o != c and of[c] & of[o]))[:8]
        want |= {(c, o, -n, i + 1) for i, (n, o) in enumerate(best)}
    for large in (500, 10):
        assert {(r.concept, r.other, r.shared, r["rank"]) for r in graph.related(df, large=large).collect()} == want


def test_cycles_of_any_length_beside_chains(spark):
    ring = [f"r{i}" for i in range(9)]
    pairs = [*zip(ring, ring[1:] + ring[:1]), ("r8", "r3"), ("c0", "r1"), ("r4", "d0"), *((f"d{i}", f"d{i + 1}") for i in range(20)), *((f"c{i + 1}", f"c{i}") for i in range(20)), ("r2", "q"), ("q", "p"), ("p", "q")]
    got = {tuple(r) for r in graph.cycles(edges(spark, *((a, b, "x") for a, b in pairs))).collect()}
    assert got == {(">".join(ring), 9), (">".join(ring[3:]), 6), ("p>q", 2)}
    assert graph.cycles(edges(spark, ("a", "b", "x"), ("b", "c", "x"))).count() == 0


def test_conflicts_over_components_and_rejections_either_way(spark):
    rows = [("b", "a", "applied", "1"), ("d", "c", "Applied ", "1"), ("a", "c", "rejected", "1"), ("b", "d", "pending", "2"), ("x", "y", "pending", "1"), ("b", "a", "pending", None), ("p", "p", "pending", "1"), (None, "q", "applied", "1"), ("b", "d", "pending", "2")]
    latest = graph.latest_aliases(spark.createDataFrame(rows, "alias string, canonical_id string, status string, decided_at string"))
    assert {tuple(r) for r in graph.pair_conflicts(latest).collect()} == {("b", "d", 1)}
    pairs = spark.createDataFrame([("c", "a"), ("a", "b")], "a string, b string")
    assert [tuple(r) for r in graph.rejected_either_way(pairs, latest).collect()] == [("a", "b")]
    assert graph.pair_conflicts(latest.limit(0)).count() == 0


def test_unlinked_triggers_and_guarded_clusters(spark):
    derived = spark.createDataFrame([("al", "s", "t", "r"), ("be", "s", "t", "r")], "alias_id string, source_id string, target_id string, relation string")
    aliases = spark.createDataFrame([("al", "c", "applied"), ("be", "c", "applied")], "alias string, canonical_id string, status string")
    kept, marked = graph.unlink(derived, aliases, spark.createDataFrame([("al",)], "alias string"))
    assert [r.alias_id for r in kept.collect()] == ["be"] and {(r.alias, r.status) for r in marked.collect()} == {("al", "rejected"), ("be", "applied")}
    e = spark.createDataFrame([("a", "b", "owns", 0.9), ("a", "c", "owns", None), ("a", "d", "contradicts", 1.0), ("a", "e", "cites", 1.0)], "source_id string, target_id string, relation string, confidence double")
    assert {(r.target_id, r.action) for r in graph.triggered(e, ["owns"]).collect()} == {("b", "supersede"), ("c", "conflict"), ("d", "conflict")}
    m = spark.createDataFrame([("1", 0, "a", 1.7), ("1", 1, "b", None), ("2", 0, "b", 0.5), ("2", 1, "c", 0.5), ("3", 0, "zz", 0.5), ("3", 1, "c", 0.5)], "cluster string, pos int, id string, confidence double")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {tuple(r) for r in graph.guarded_clusters(m, known).collect()} == {("1", "a", 1.0), ("1", "b", 0.0)}
