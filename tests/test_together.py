"""Searches within tasks against the same ones level by level over the whole graph."""

import random

import pytest
from pyspark.sql import functions as F

from netquarry import scratch
from netquarry.operators import graph as G
from netquarry.operators import together
from netquarry.operators import traverse as T
from netquarry.schema import TRUTH_RELATIONS

RELATIONS = ["instantiates", "depended_by", "has_port", "drives", "covers", "references_clock"]
TYPES = ["Module", "Port", "Net", "Constraint"]


@pytest.fixture(scope="module")
def many(spark):
    """Five designs, two of them tied by an edge, one node without a design and one edge to an unknown node."""
    rng = random.Random(5)
    nodes, edges = [], {}
    for d in range(5):
        nodes += [(f"d{d}::n{k:02d}", rng.choice(TYPES), f"name_{k}", f"d{d}") for k in range(20)]
        for _ in range(50):
            a, b = rng.sample(range(20), 2)
            edges[f"d{d}::n{a:02d}", f"d{d}::n{b:02d}"] = rng.choice(RELATIONS)
    nodes.append(("alone", "Module", "alone", None))
    edges["d0::n00", "d1::n00"] = "instantiates"
    edges["d2::n00", "alone"] = edges["alone", "d2::n01"] = edges["d3::n00", "unknown"] = edges["unknown", "d3::n07"] = "depended_by"
    g = G.Graph(spark.createDataFrame(nodes, "id string, type string, name string, design string").cache(), spark.createDataFrame([(a, b, r) for (a, b), r in edges.items()], "src string, dst string, relation string").cache())
    runs = [(n[0], n[0]) for n in nodes[::4]] + [("two", "d2::n05"), ("two", "d4::n05"), ("none", "nothing")]
    return g, spark.createDataFrame(runs, "run string, node string").cache()


def rows(df):
    columns = sorted(df.columns)
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in df.select(columns).collect())


@pytest.fixture()
def written(monkeypatch):
    """The tags of the tables written from now on."""
    tags, parts = [], scratch.parts
    monkeypatch.setattr(scratch, "parts", lambda df, tag, by: tags.append(tag) or parts(df, tag, by))
    return tags


def both(monkeypatch, written, f, tags):
    """The same within tasks, writing no table of runs and nodes, and round by round."""
    within = rows(f())
    assert not {*written} & {*tags}
    monkeypatch.setattr(together, "EDGES", 0)
    whole = rows(f())
    assert {*written} & {*tags}
    assert within == whole and within


def test_compare_f1(many, written):
    g, s = many
    methods = ("weighted_bfs", "bfs", "pagerank", "structural")
    sizes = rows(T.compare_sizes(g, s, methods))
    assert sizes and not {*written} & {"labels", "level", "rank", "ranked"}
    whole = T.compare(g, s, methods).groupBy("method", "run", "artifact_type").agg(F.count("*").alias("n"), F.sum("risk").alias("risk"))
    assert sizes == rows(whole)


def test_labels_f2(many, monkeypatch, written):
    g, s = many
    both(monkeypatch, written, lambda: T.weighted_bfs(g, s, alpha=0.9, max_depth=3, exclude_types=("Net",), paths=False), ("labels",))


def test_sizes_of_truth_f3(many, monkeypatch, written):
    g, s = many
    changes = s.crossJoin(s.sparkSession.createDataFrame([(k,) for k in [*TRUTH_RELATIONS, "other"]], "change_type string")).withColumn("run", F.concat_ws("/", "run", "change_type"))
    both(monkeypatch, written, lambda: T.truth_sizes(g, changes), ("truth",))


def test_walks_f4(many, monkeypatch, written):
    g, s = many
    both(monkeypatch, written, lambda: T.weighted_bfs(g, s, mode="path_max", change_type="width", paths=False), ("walk",))
    assert T.weighted_bfs(g, s, mode="path_max", paths=False, columns=("run", "node", "risk")).columns == ["run", "node", "risk"]


def test_ranks_f7(many, monkeypatch, written):
    g, s = many
    both(monkeypatch, written, lambda: T.pagerank(g, s, tolerance=1e-4), ("rank",))


def test_truth_f8(many, monkeypatch, written):
    g, s = many
    changes = s.crossJoin(s.sparkSession.createDataFrame([(k,) for k in [*TRUTH_RELATIONS, "other"]], "change_type string")).withColumn("run", F.concat_ws("/", "run", "change_type"))
    both(monkeypatch, written, lambda: T.ground_truth(g, changes), ("truth",))
    mixed = s.withColumn("change_type", F.when(F.col("node") == "d2::n05", "clock").otherwise("width"))
    assert T.ground_truth(g, mixed).where("run = 'two'").count()
