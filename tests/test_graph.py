"""Traversals against plain loops on random graphs, merging, metrics and search."""

import heapq
import json
import math
import random
import shutil

import pytest
from pyspark.sql import functions as F

from netquarry.functions.numbering import numbered
from netquarry.operators import graph as G
from netquarry.operators import metrics as M
from netquarry.operators import skew
from netquarry.operators import traverse as T
from netquarry.operators.components import connected
from netquarry.plans import registry
from netquarry.plans.design_graph import design_graph, every_module
from netquarry.schema import DEFAULT_WEIGHT, PROPAGATION, TRUTH_RELATIONS, WEIGHTS

RELATIONS = ["instantiates", "depended_by", "has_port", "drives", "covers", "references_clock"]
TYPES = ["Module", "Port", "Net", "Clock"]


def make(spark, seed, n=24, m=60):
    rng = random.Random(seed)
    nodes = [(f"n{k:02d}", rng.choice(TYPES), f"name_{k}", "d") for k in range(n)]
    edges = {}
    for _ in range(m):
        a, b = rng.sample(range(n), 2)
        edges[f"n{a:02d}", f"n{b:02d}"] = rng.choice(RELATIONS)
    g = G.Graph(spark.createDataFrame(nodes, "id string, type string, name string, design string").cache(), spark.createDataFrame([(a, b, r) for (a, b), r in edges.items()], "src string, dst string, relation string").cache())
    return g, {x[0]: x[1] for x in nodes}, edges


def seeds(spark, *pairs):
    return spark.createDataFrame(pairs, "run string, node string")


def heap(edges, starts, alpha, depth, least):
    """Best-first search with one label per node."""
    best, hop, pred = dict.fromkeys(starts, 1.0), dict.fromkeys(starts, 0), {}
    queue = [(-1.0, s, 0) for s in sorted(starts)]
    done = set()
    while queue:
        risk, node, d = heapq.heappop(queue)
        if node in done or -risk < best[node]:
            continue
        done.add(node)
        if hop[node] >= depth:
            continue
        for (a, b), r in edges.items():
            if a == node and b not in starts:
                new = best[a] * WEIGHTS.get(r, DEFAULT_WEIGHT) * alpha
                if new >= least and new > best.get(b, 0):
                    best[b], hop[b], pred[b] = new, hop[a] + 1, a
                    heapq.heappush(queue, (-new, b, hop[b]))
    return {k: (round(v, 9), hop[k]) for k, v in best.items() if k not in starts}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_weighted_labels_equal_a_heap(spark, seed):
    g, types, edges = make(spark, seed)
    got = T.weighted_bfs(g, seeds(spark, ("a", "n00"), ("a", "n01"), ("b", "n02"), ("b", "none")), alpha=0.9, max_depth=3).collect()
    assert {r.node: (round(r.risk, 9), r.hop) for r in got if r.run == "a"} == heap(edges, {"n00", "n01"}, 0.9, 3, 0.01)
    assert {r.node: (round(r.risk, 9), r.hop) for r in got if r.run == "b"} == heap(edges, {"n02"}, 0.9, 3, 0.01)
    for r in got:
        steps = list(zip(r.path, r.path[1:]))
        assert r.path[-1] == r.node and [edges[s] for s in steps] == r.relations
        assert math.isclose(math.prod(WEIGHTS[x] * 0.9 for x in r.relations), r.risk) and r.reason.count(" --") == len(steps)


def test_label_and_path_modes_differ_where_they_should(spark):
    rows = [("s", "m", "covers"), ("m", "x", "has_port"), ("s", "p", "has_port"), ("p", "m", "has_port")]
    nodes = [(k, "Module", k, "d") for k in "smpx"]
    g = G.Graph(spark.createDataFrame(nodes, "id string, type string, name string, design string"), spark.createDataFrame(rows, "src string, dst string, relation string"))
    label = {r.node for r in T.weighted_bfs(g, seeds(spark, ("r", "s")), alpha=0.9, max_depth=2).collect()}
    walks = {r.node for r in T.weighted_bfs(g, seeds(spark, ("r", "s")), alpha=0.9, max_depth=2, mode="path_max").collect()}
    assert label == {"m", "p"} and walks == {"m", "p", "x"}
    with pytest.raises(ValueError):
        T.weighted_bfs(g, seeds(spark, ("r", "s")), alpha=1.0)


def hops(edges, starts, depth):
    out, frontier = dict.fromkeys(starts, 0), set(starts)
    for d in range(1, depth + 1):
        frontier = {b for a, b in edges if a in frontier} - out.keys()
        out |= dict.fromkeys(frontier, d)
    return out


def test_levels_neighbourhoods_paths_and_truth(spark):
    g, types, edges = make(spark, 7)
    want = hops(edges, {"n00"}, 3)
    got = {r.node: r.hop for r in T.bfs(g, seeds(spark, ("a", "n00"))).collect()}
    assert got == {k: v for k, v in want.items() if v}
    two_way = {*edges, *((b, a) for a, b in edges)}
    near = {r.node: r.hop for r in T.neighborhood(g, seeds(spark, ("a", "n00")), hops=2).collect()}
    assert near == hops(two_way, {"n00"}, 2)
    assert T.neighborhood(g, seeds(spark, ("a", "n00")), hops=2, max_nodes=3).count() == 3
    full = hops(edges, {"n00"}, 5)
    target = max(full, key=lambda k: (full[k], k))
    on = {r.node: r.distance for r in T.shortest_paths(g, spark.createDataFrame([("a", "n00", target)], "run string, source string, target string")).collect()}
    back = hops({(b, a) for a, b in edges}, {target}, 5)
    assert on == {k: full[k] for k in full if k in back and full[k] + back[k] == full[target]}
    for kind, relations in TRUTH_RELATIONS.items():
        truth = T.ground_truth(g, spark.createDataFrame([("x", "n00", kind)], "run string, node string, change_type string")).collect()
        allowed = {e for e, r in edges.items() if r in relations}
        assert {r.node: r.hop for r in truth} == {k: v for k, v in hops(allowed, {"n00"}, 6).items() if v}


def test_pagerank_equals_dense_iteration(spark):
    g, types, edges = make(spark, 9)
    names = sorted(types)
    out = {a: [b for x, b in edges if x == a] for a in names}
    p = {n: 0.5 if n in ("n00", "n01") else 0.0 for n in names}
    x = dict(p)
    for _ in range(200):
        loose = sum(x[n] for n in names if not out[n])
        new = {n: 0.85 * (sum(x[a] / len(out[a]) for a in names if n in out[a]) + loose * p[n]) + 0.15 * p[n] for n in names}
        error, x = sum(abs(new[n] - x[n]) for n in names), new
        if error < len(names) * 1e-6:
            break
    top = max(x.values())
    got = {r.node: r.score for r in T.pagerank(g, seeds(spark, ("a", "n00"), ("a", "n01"))).collect()}
    want = {n: v / top for n, v in x.items() if v / top >= 1e-4 and n not in ("n00", "n01")}
    assert got.keys() == want.keys() and all(math.isclose(got[n], want[n], rel_tol=1e-6) for n in want)


def test_seeded_queries_run_from_every_module_and_commit(spark):
    path, got = "/root/testdata/sf0.001", registry.queries()
    g = design_graph(spark, path)
    edges = {(r.src, r.dst): r.relation for r in g.edges.collect()}
    modules = {r.id for r in g.nodes.where("type = 'Module'").collect()}
    want = {(m, k, v) for m in modules for k, v in hops({e for e, r in edges.items() if r in PROPAGATION}, {m}, 3).items() if v}
    assert {(r.run, r.node, r.hop) for r in got["g_bfs"](spark, path).collect()} == want
    commits = {a for (a, b), r in edges.items() if r == "modifies"}
    want = {(c, k, v) for c in commits for k, v in hops({e for e, r in edges.items() if r in PROPAGATION}, {b for (a, b), r in edges.items() if a == c and r == "modifies"}, 2).items() if v}
    assert {(r.run, r.node, r.hop) for r in got["g_from_commit"](spark, path).collect()} == want


def test_a_changed_folder_gives_another_graph(spark, tmp_path):
    for name in ("modules", "instances", "sdc_constraints", "commits"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    first = design_graph(spark, str(tmp_path))
    assert design_graph(spark, str(tmp_path)) is first
    shutil.copy("/root/testdata/sf0.01/commits.parquet", tmp_path / "commits.parquet")
    assert design_graph(spark, str(tmp_path)).nodes.count() > first.nodes.count()


def test_without_paths_nothing_else_changes(spark):
    g, types, edges = make(spark, 11, m=90)
    s = seeds(spark, ("a", "n00"), ("b", "n03"))
    for f, kw in ((T.bfs, {}), (T.structural, {}), (T.weighted_bfs, {"alpha": 0.9}), (T.weighted_bfs, {"mode": "path_max"})):
        with_paths = {(r.run, r.node): (round(r.risk, 9), r.hop) for r in f(g, s, **kw).collect()}
        assert {(r.run, r.node): (round(r.risk, 9), r.hop) for r in f(g, s, paths=False, **kw).collect()} == with_paths


def test_compare_runs_all_five_methods(spark):
    g, types, edges = make(spark, 9, m=200)
    first = min(a for (a, b), r in edges.items() if types[a] == types[b] == "Module" and r in ("instantiates", "depended_by"))
    s = seeds(spark, ("a", first), ("b", "n01"))
    got = {(r.method, r.run, r.node): (r.risk, r.hop) for r in T.compare(g, s, max_depth=3).collect()}
    assert {k[0] for k in got} == {"weighted_bfs", "bfs", "pagerank", "structural", "lexical"}
    ranks = {("pagerank", r.run, r.node): r.score for r in T.pagerank(g, s).collect()}
    assert {k for k in got if k[0] == "pagerank"} == ranks.keys() and all(math.isclose(got[k][0], v, rel_tol=1e-6) for k, v in ranks.items())
    for run, start in (("a", first), ("b", "n01")):
        far = hops(edges, {start}, 24)
        assert all(hop == far[node] for (m, r, node), (_, hop) in got.items() if m == "pagerank" and r == run)
    assert {k: v for k, v in got.items() if k[0] == "lexical"} == {("lexical", r.run, r.node): (r.risk, -1) for r in T.lexical(g, s).collect()}
    assert {r.method for r in T.compare(g, s, ("pagerank", "no_such_method")).collect()} == {"pagerank"}


def test_registered_pageranks_converge(spark):
    path = "/root/testdata/sf0.001"
    g = design_graph(spark, path)
    edges = [(r.src, r.dst) for r in g.edges.collect()]
    names = [r.id for r in g.nodes.select("id").collect()]
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    ranks, worst = {}, 0
    for r in registry.queries()["g_pagerank"](spark, path).collect():
        ranks.setdefault(r.run, {})[r.node] = r.score
    for run, seed in {(r.run, r.node) for r in every_module(g).collect()}:
        x = {seed: 1.0}
        for _ in range(200):
            new = {seed: 0.15 + 0.85 * sum(v for n, v in x.items() if n not in out)}
            for n, v in x.items():
                for b in out.get(n, ()):
                    new[b] = new.get(b, 0.0) + 0.85 * v / len(out[n])
            error, x = sum(abs(new.get(n, 0) - x.get(n, 0)) for n in {*new, *x}), new
            if error < 1e-12:
                break
        top = max(x.values())
        want = {n: v / top for n, v in x.items() if n != seed}
        have = ranks.get(run, {})
        worst = max([worst, *(abs(have.get(n, 0) - want.get(n, 0)) for n in {*have, *want})])
    assert worst < len(names) * 1e-6 / 0.15 + 1e-4


def test_other_designs_do_not_loosen_the_rank(spark):
    g, types, edges = make(spark, 9)
    rest = spark.range(2_000_000).select(F.concat(F.lit("x"), "id").alias("id"), F.lit("Net").alias("type"), F.lit("x").alias("name"), F.lit("other").alias("design"))
    alone = {r.node: r.score for r in T.pagerank(g, seeds(spark, ("a", "n00"))).collect()}
    among = {r.node: r.score for r in T.pagerank(G.Graph(g.nodes.unionByName(rest), g.edges), seeds(spark, ("a", "n00"))).collect()}
    assert alone.keys() == among.keys() and all(math.isclose(alone[n], among[n], rel_tol=1e-9) for n in alone)


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(None, 1), (5, 5)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: find(v) for v in root}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_last_writer_keeps_what_later_batches_lack(spark):
    a = spark.createDataFrame([("x", "Port", "in"), ("y", "Port", "out")], "id string, type string, direction string")
    b = spark.createDataFrame([("x", "Net")], "id string, type string")
    e1 = spark.createDataFrame([("x", "y", "references_clock")], "src string, dst string, relation string")
    e2 = spark.createDataFrame([("x", "y", "applies_to"), (None, "y", "drives")], "src string, dst string, relation string")
    g = G.build([a, b], [e1, e2])
    assert {tuple(r) for r in g.nodes.select("id", "type", "direction").collect()} == {("x", "Net", "in"), ("y", "Port", "out")}
    assert [tuple(r) for r in g.edges.select("src", "dst", "relation").collect()] == [("x", "y", "applies_to")]


def test_export(spark, tmp_path):
    g, types, edges = make(spark, 4, 6, 8)
    for kind in ("node_link", "graphml", "gexf", "parquet", "json"):
        G.export(g, str(tmp_path / kind), kind)
    data = json.loads((tmp_path / "node_link").read_text())
    assert len(data["nodes"]) == 6 and len(data["links"]) == len(edges)
    assert (tmp_path / "graphml").read_text().count("<edge ") == len(edges) == (tmp_path / "gexf").read_text().count("<edge ")
    assert spark.read.parquet(str(tmp_path / "parquet/nodes")).count() == 6
    with pytest.raises(ValueError):
        G.export(g, str(tmp_path / "x"), "dot")


def test_names_and_words(spark):
    rows = [("d::uart_top", "Module", "uart_top", "d"), ("d::uart_tx", "Module", "uart_tx", "d"), ("d::uart_tx::tx_data", "Port", "tx_data", "d")]
    g = G.Graph(spark.createDataFrame(rows, "id string, type string, name string, design string"), spark.createDataFrame([], "src string, dst string, relation string"))
    q = spark.createDataFrame([("d::uart_tx",), ("UART_TX",), ("tx_data",), ("uart",), ("none_such",), (None,)], "query string")
    assert {r.query: (r.node, r.rank) for r in T.resolve_names(g, q).collect()} == {"d::uart_tx": ("d::uart_tx", 1), "UART_TX": ("d::uart_tx", 2), "tx_data": ("d::uart_tx::tx_data", 2), "uart": ("d::uart_top", 3)}
    hit = {r.node: r.risk for r in T.lexical(g, seeds(spark, ("a", "d::uart_top"))).collect()}
    assert hit == {"d::uart_tx": 1 / 3}


def test_names_inside_words_short_names_and_endings_resolve(spark):
    rows = [("d::core", "Module", "core", "d"), ("d::fpualu", "Module", "fpualu", "d"), ("d::core::zq9", "Port", "zq9", "d"), ("d::a::rx", "Port", "rx", "d"), ("d::b::rx", "Port", "rx", "d")]
    g = G.Graph(spark.createDataFrame(rows, "id string, type string, name string, design string"), spark.createDataFrame([], "src string, dst string, relation string"))
    q = spark.createDataFrame([("alu",), ("q9",), ("xxfpualuxx",), ("core::zq9",), ("b::rx",), ("none",)], "query string")
    got = {r.query: (r.node, r.rank) for r in T.resolve_names(g, q).collect()}
    assert got == {"alu": ("d::fpualu", 3), "q9": ("d::core::zq9", 4), "xxfpualuxx": ("d::fpualu", 3), "core::zq9": ("d::core", 3), "b::rx": ("d::b::rx", 4)}


def test_metric_vectors(spark):
    p = spark.createDataFrame([("1", "b", 1.0, 1), ("1", "c", 0.9, 1), ("2", "b", 1.0, 1), ("3", "b", 1.0, 1), ("3", "d", 0.5, 2), ("5", "b", 1.0, 1)], "k string, node string, risk double, hop int")
    t = spark.createDataFrame([("1", "b"), ("1", "c"), ("2", "b"), ("2", "c"), ("3", "b"), ("3", "c"), ("4", "b")], "k string, node string")
    got = {r.k: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in M.confusion(p, t, ["k"]).collect()}
    assert got == {"1": (2, 0, 0, 1, 1), "2": (1, 0, 1, 1, 0.5), "3": (1, 1, 1, 0.5, 0.5), "4": (0, 0, 1, 0, 0), "5": (0, 1, 0, 0, 0)}
    ranked = spark.createDataFrame([("x", f"n{k}", 1.0 - k / 100, 1) for k in range(15)], "k string, node string, risk double, hop int")
    truth = spark.createDataFrame([("x", "n0"), ("x", "n5"), ("x", "n12")], "k string, node string")
    r = M.ranking(ranked, truth, ["k"], (5, 10, 15)).first()
    assert (round(r.recall_at_5, 6), round(r.recall_at_10, 6), r.recall_at_15, r.mrr) == (0.333333, 0.666667, 1.0, 1.0)
    r = M.ranking(ranked.limit(3), spark.createDataFrame([("x", "n1"), ("x", "n2")], "k string, node string"), ["k"], (2,)).first()
    assert r.mrr == 0.5
    r = M.ranking(ranked.limit(2), spark.createDataFrame([("x", "n0"), ("x", "n1")], "k string, node string"), ["k"], (2,)).first()
    assert r.ndcg_at_2 == 1.0


def test_vectors_in_blocks(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(60)] + [(99, None)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = v.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    one = {tuple(r) for r in T.vector_top_k(v, q, 3).select("query_id", "vec_id", "rank").collect()}
    assert one == {tuple(r) for r in T.vector_top_k(v, q, 3, block=2).select("query_id", "vec_id", "rank").collect()}
    assert all((k, k, 1) in one for k in range(0, 60, 7)) and len(one) == 9 * 3


def test_hot_keys_are_split(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", n) for n in range(400)] + [(None, 500)]
    df = spark.createDataFrame(rows, "key string, n int")
    ones = spark.createDataFrame([("hot", 1), ("k0", 2), ("k1", 3), (None, 4)], "key string, v int")
    want = sorted((k, n, {"hot": 1, "k0": 2, "k1": 3}[k]) for k, n in rows if k in ("hot", "k0", "k1"))
    for hot in (10_000, 20):
        assert sorted(tuple(r) for r in skew.join_one(df, ones, "key", 401, ["n"], hot).select("key", "n", "v").collect()) == want
    ranks = skew.ranked(df, ["key"], [F.desc("n")], "k", parts=7).collect()
    assert len(ranks) == len(rows)
    for key in {k for k, _ in rows}:
        assert {r.n: r.k for r in ranks if r.key == key} == {n: k for k, n in enumerate(sorted((n for x, n in rows if x == key), reverse=True), 1)}
    numbers = [(r.key, r.n, r.i) for r in numbered(df.where("key is not null"), "key", ["n"], "i", parts=5).collect()]
    assert sorted(numbers, key=lambda r: r[2]) == [(*r, i) for i, r in enumerate(sorted((k, n) for k, n in rows if k is not None), 1)]
    assert skew.ranked(df.limit(0), ["key"], [F.col("n")], "k").count() == 0 and numbered(df.limit(0), "key", ["n"]).count() == 0
