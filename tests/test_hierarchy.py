import random

import pytest

from veinstone.operators import hierarchy as h


def brute(links):
    parent = dict(links)
    out = {}
    for n in parent:
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            x = parent.get(x)
        out[n] = (seen[-1], len(seen) - 1) if x is None else (min(seen[seen.index(x) :]), -1)
    return out


def random_links(seed, n):
    rng = random.Random(seed)
    links = []
    for i in range(n):
        kind = rng.random()
        parent = None if kind < 0.03 else f"n{i}" if kind < 0.05 else f"n{rng.randrange(n)}" if kind < 0.15 else f"n{max(0, i - rng.randrange(1, 4))}"
        links.append((f"n{i}", parent))
    return links


def check(spark, links, core):
    df = spark.createDataFrame(links, "node string, parent string")
    tree = h.hierarchy(df, core).collect()
    expected = brute(links)
    assert {r.node: (r.root, r.depth) for r in tree} == expected
    # intervals: what lies inside a node's interval is what climbs to it
    parent = dict(links)
    cyclic = {r.node for r in tree if r.in_cycle}
    above = {}
    for n in parent:
        chain, x = set(), n
        while x not in cyclic and parent.get(x) is not None and parent[x] not in chain:
            x = parent[x]
            chain.add(x)
        above[n] = chain
    for a in random.Random(1).sample(tree, min(40, len(tree))):
        inside = {b.node for b in tree if b.tree == a.tree and a.enter < b.enter < a.leave}
        assert inside == {n for n, up in above.items() if a.node in up}, a


@pytest.mark.parametrize("core", [10**6, 12])
def test_random_graphs(spark, core):
    check(spark, random_links(5, 160), core)


def test_long_chain_and_long_cycle_need_few_rounds(spark):
    chain = [(f"c{i:03d}", f"c{i - 1:03d}" if i else None) for i in range(60)]
    cycle = [(f"z{i:03d}", f"z{(i + 1) % 40:03d}") for i in range(40)] + [("tail", "z007")]
    check(spark, chain + cycle, 8)


def test_paths_and_descendants(spark):
    links = [("a", None), ("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x"), ("z", "y")]
    tree = h.cut(h.hierarchy(spark.createDataFrame(links, "node string, parent string")))
    paths = {r.node: r.path for r in h.full_paths(tree).collect()}
    assert paths["d"] == ["a", "b", "d"] and paths["a"] == ["a"] and paths["z"] is None
    pairs = sorted((r.node, r.descendant, r.distance) for r in h.descendant_pairs(tree).collect())
    assert pairs == [("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)]
    below = h.descendants_of(tree, spark.createDataFrame([("b",), ("y",)], "node string")).collect()
    assert sorted((r.node, r.descendant) for r in below) == [("b", "c"), ("b", "d"), ("y", "z")]


def test_nulls_repeats_unknown_parents_and_empty(spark):
    df = spark.createDataFrame([(None, "a"), ("b", "q"), ("b", "p"), ("b", None)], "node string, parent string")
    got = {r.node: (r.root, r.depth) for r in h.hierarchy(df).collect()}
    assert got == {"b": ("p", 1), "p": ("p", 0), "q": ("q", 0)}
    assert h.hierarchy(spark.createDataFrame([], "node string, parent string")).count() == 0


def test_more_roots_and_cycles_than_the_core_holds(spark, monkeypatch):
    rounds, rake = [], h._rake

    def counted(table):
        rounds.append(1)
        assert len(rounds) < 30, "the rounds make no progress"
        return rake(table)

    monkeypatch.setattr(h, "_rake", counted)
    links = [(f"r{i:02d}", None) for i in range(20)] + [(f"s{i:02d}", f"s{i:02d}") for i in range(12)]
    links += [(f"p{i}", f"q{i}") for i in range(6)] + [(f"q{i}", f"p{i}") for i in range(6)]
    links += [(f"k{i:02d}", f"r{i:02d}") for i in range(10)] + [("l", "s03"), ("m", "l"), ("n", "q2"), ("o", "n")]
    check(spark, links, 8)


def test_paths_and_descendants_from_cycles(spark):
    links = [("a", None), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "y"), ("w", "z"), ("s", "s"), ("t", "s")]
    tree = h.cut(h.hierarchy(spark.createDataFrame(links, "node string, parent string")))
    paths = {r.node: r.path for r in h.full_paths(tree, from_cycles=True).collect()}
    assert paths == {"a": ["a"], "b": ["a", "b"], "x": ["x"], "y": ["y"], "z": ["y", "z"], "w": ["y", "z", "w"], "s": ["s"], "t": ["s", "t"]}
    pairs = sorted((r.node, r.descendant, r.distance) for r in h.descendant_pairs(tree, from_cycles=True).collect())
    assert pairs == [("a", "b", 1), ("s", "t", 1), ("y", "w", 2), ("y", "z", 1), ("z", "w", 1)]
    assert len(pairs) == tree.selectExpr("sum(leave - enter - 1)").first()[0]


def test_many_of_each_shape_above_the_bound_equal_the_unbounded_run(spark, monkeypatch):
    monkeypatch.setattr("veinstone.session.BROADCAST_BYTES", -1)  # joins are spread, not broadcast
    links = [(f"r{i:02d}", None) for i in range(50)] + [(f"k{i:02d}", f"r{i:02d}") for i in range(50)]
    links += [(f"s{i:02d}", f"s{i:02d}") for i in range(50)] + [(f"{a}{i:02d}", f"{b}{i:02d}") for i in range(50) for a, b in ("pq", "qp")]
    links += [("hub", None)] + [(f"l{i:03d}", "hub") for i in range(150)] + [(f"c{i:02d}", f"c{i - 1:02d}" if i else None) for i in range(50)]
    df = spark.createDataFrame(links, "node string, parent string")
    plain = lambda t: sorted((r.node, r.root, r.depth, r.in_cycle, r.leave - r.enter) for r in t.collect())
    bounded = plain(h.hierarchy(df, 8))
    assert bounded == plain(h.hierarchy(df))
    assert {(n, (root, depth)) for n, root, depth, *_ in bounded} == set(brute(links).items())


def test_nodes_whose_hashes_collide(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"n{i // 2}" if i else None) for i in range(60)], "node string, parent string")
    for bits in (64, 7):
        rows = h.with_hashed_ids(nodes, bits).collect()
        ids = {r.node: r.id for r in rows}
        assert len(set(ids.values())) == 60 and all(r.parent_id == (ids[r.parent] if r.parent else None) for r in rows)


def test_descendants_by_blocks_of_intervals(spark):
    links = random_links(11, 120)
    tree = h.cut(h.hierarchy(spark.createDataFrame(links, "node string, parent string")))
    rows = tree.collect()
    expected = {(a.node, b.node) for a in rows for b in rows if a.tree == b.tree and a.enter < b.enter < a.leave}
    got = h.descendants_of(tree, tree.select("node")).collect()
    assert len(got) == len(expected) and {(r.node, r.descendant) for r in got} == expected
    assert h.descendants_of(tree, tree.select("node").limit(0)).count() == 0
