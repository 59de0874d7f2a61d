"""Hierarchies against a walk per node."""

import random
import time

from netquarry.operators import hierarchy as H


def expected(nodes, links):
    nodes = {n for n in nodes if n is not None}
    parents = {}
    for p, c in links:
        if p in nodes and c in nodes:
            parents.setdefault(c, set()).add(p)
    up = {c: min(ps) for c, ps in parents.items()}
    below = {n: set() for n in nodes}
    out = {}
    for n in nodes:
        at, d, seen = n, 0, set()
        while at in up and at not in seen:
            seen.add(at)
            at = up[at]
            d += 1
            below[at].add(n)
        out[n] = ("CYCLE", -1) if at in up else (at, d)
    return {n: (*out[n], len(below[n] - {n})) for n in nodes}


def run(spark, nodes, links, **kw):
    n = spark.createDataFrame([(x,) for x in nodes], "node_id string")
    e = spark.createDataFrame(links, "parent_id string, child_id string")
    return {r.node_id: r for r in H.hierarchies(n, e, **kw).collect()}


def forest(seed, n=60):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(n)]
    links = []
    for i in range(1, n):
        if rng.random() < 0.9:
            links.append((nodes[rng.randrange(i)], nodes[i]))
    links.append((nodes[5], nodes[0]))  # may close a cycle
    links += [("gone", nodes[3]), (None, nodes[2]), (nodes[1], None), links[0]]
    return [*nodes, nodes[0], None, "self"], [*links, ("self", "self")]


def test_one_task_and_spread_agree_with_a_walk(spark):
    for seed in (1, 2):
        nodes, links = forest(seed)
        want = expected(nodes, links)
        whole = None
        for kw in ({}, {"component_limit": 0}, {"component_limit": 0, "hot": 3}, {"hot": 3}):
            got = run(spark, nodes, links, **kw)
            assert {k: (r.root_id, r.tree_depth, r.n_below) for k, r in got.items()} == want
            every = {k: (r.path, r.on_cycle, r.component, r.n_parents) for k, r in got.items()}
            whole = whole or every
            assert every == whole
            for r in got.values():
                if r.tree_depth >= 0:
                    assert r.path[0] == r.root_id and r.path[-1] == r.node_id and len(r.path) == r.tree_depth + 1
                else:
                    assert r.path is None
            assert got["self"].on_cycle and got["self"].n_below == 0


def test_node_below_a_cycle_keeps_its_subtree_whatever_the_order(spark):
    links = [("z", "y"), ("y", "z"), ("z", "b"), ("b", "a"), ("a", "c")]
    got = run(spark, list("abcyz"), links)
    assert {k: r.n_below for k, r in got.items()} == {"a": 1, "b": 2, "c": 0, "y": 4, "z": 4}
    assert {k for k, r in got.items() if r.on_cycle} == {"y", "z"}


def test_descendants_and_cycle_links(spark):
    n = spark.createDataFrame([(x,) for x in "abcd"], "node_id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d")], "parent_id string, child_id string")
    tree = H.hierarchies(n, e)
    assert {tuple(r) for r in H.descendants(tree).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert {(r.parent_id, r.node_id, r.back_edge) for r in H.cycle_edges(tree).collect()} == {("d", "d", True)}


def test_many_leaves_below_a_ring_take_linear_time():
    took = []
    for n in (10_000, 100_000):
        members = [("y", "z", 1), ("z", "y", 1)] + [(f"a{k}", "z", 1) for k in range(n)]
        began = time.perf_counter()
        rows = {r[0]: r for r in H.traverse(members, True)}
        took.append(time.perf_counter() - began)
        assert rows["z"][5] == rows["y"][5] == n + 1 and rows["a5"][3:7] == ("CYCLE", -1, 0, False)
    assert took[1] < 40 * took[0]


def test_the_back_edge_leads_into_the_smallest_node_of_a_ring(spark):
    links = [("c", "b"), ("b", "d"), ("d", "c"), ("d", "a")]
    n, e = spark.createDataFrame([(x,) for x in "abcd"], "node_id string"), spark.createDataFrame(links, "parent_id string, child_id string")
    for limit in (1000, 0):
        got = {tuple(r) for r in H.cycle_edges(H.hierarchies(n, e, False, limit)).collect()}
        assert got == {("b", "c", "b", True), ("b", "b", "d", False), ("b", "d", "c", False)}


def test_descendants_on_and_below_cycles(spark):
    n = spark.createDataFrame([(x,) for x in "abcst"], "node_id string")
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("s", "s"), ("s", "t")], "parent_id string, child_id string")
    want = {("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("a", "c", 2), ("s", "t", 1)}
    for limit in (1000, 0):
        assert {tuple(r) for r in H.descendants(H.hierarchies(n, e, False, limit)).collect()} == want
    for seed in (1, 2):
        nodes, links = forest(seed)
        tree = H.hierarchies(spark.createDataFrame([(x,) for x in nodes], "node_id string"), spark.createDataFrame(links, "parent_id string, child_id string"), False)
        found = H.descendants(tree).collect()
        counts = {k: 0 for k in nodes if k is not None}
        for r in found:
            counts[r.ancestor_id] += 1
        assert counts == {k: v[2] for k, v in expected(nodes, links).items()} and len({(r.ancestor_id, r.node_id) for r in found}) == len(found)


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, ["x"], [])["x"].root_id == "x"
