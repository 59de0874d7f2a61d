"""Traversals of a property graph, for many starting sets at once.

Every traversal takes ``seeds(run, node)`` and works on all runs together: a
level is one join of the frontier with the edges, whatever the number of runs.
Loops end when a frontier is empty or at the depth limit; each level is a table
in the shared folder.  Where paths are not asked for, weighted searches, the truth
and ranks run within tasks (``together``).

Ties are settled by the data alone: the predecessor with the higher risk, then
the smaller id; results never depend on row order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry import scratch
from netquarry.functions import scalars
from netquarry.operators import together
from netquarry.operators.changes import contained
from netquarry.operators.graph import Graph, both_ways, induced
from netquarry.schema import DEFAULT_WEIGHT, OVERRIDES, PROPAGATION, TRUTH_DEPTH, TRUTH_FALLBACK, TRUTH_RELATIONS, WEIGHTS


_FOUND = ("run", "node", "artifact_type", "artifact_name", "risk", "hop")
Search = Callable[[together.Share], Iterator[tuple]]  # arrays of runs, nodes, risks and hops


def known_seeds(graph: Graph, seeds: DataFrame) -> DataFrame:
    """Distinct seeds that are nodes of the graph."""
    return seeds.select("run", "node").distinct().join(graph.nodes.select(F.col("id").alias("node")), "node", "left_semi").select("run", "node")


def seeds_of_modules(graph: Graph, wanted: DataFrame) -> DataFrame:
    """``wanted(run, design, name)`` as seeds; raises if no name is a module."""
    modules = graph.nodes.where("type = 'Module'").select("design", "name", F.col("id").alias("node"))
    out = wanted.join(modules, ["design", "name"]).select("run", "node").distinct()
    if not out.limit(1).count():
        raise ValueError("none of the names is a module of the graph")
    return out


def seeds_of_commits(graph: Graph, commits: DataFrame) -> DataFrame:
    """``commits(run, commit)`` as seeds: the modules they modify; raises if no commit is in the graph."""
    if not commits.join(graph.nodes.where("type = 'Commit'").select(F.col("id").alias("commit")), "commit", "left_semi").limit(1).count():
        raise ValueError("none of the commits is in the graph")
    touched = graph.edges.where("relation = 'modifies'").select(F.col("src").alias("commit"), F.col("dst").alias("node"))
    return commits.join(touched, "commit").select("run", "node").distinct()


def _weights(edges: DataFrame, overrides: dict[str, float]) -> DataFrame:
    pairs = {**WEIGHTS, **overrides}
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return edges.withColumn("weight", F.coalesce(table[F.col("relation")], F.lit(DEFAULT_WEIGHT)))


def _level(at: DataFrame, edges: DataFrame, visited: DataFrame, paths: bool) -> DataFrame:
    """The nodes one step beyond ``at(run, node, path, relations)`` that are not visited, each by its smallest predecessor."""
    if not paths:
        step = at.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("run", F.col("dst").alias("node")).distinct()
        return step.join(visited.select("run", "node"), ["run", "node"], "left_anti")
    step = at.join(edges.select(F.col("src").alias("node"), F.col("dst"), "relation"), "node")
    best = step.groupBy("run", F.col("dst").alias("node")).agg(F.min(F.struct(F.col("node").alias("pred"), "relation", "path", "relations")).alias("b"))
    fresh = best.join(visited.select("run", "node"), ["run", "node"], "left_anti")
    return fresh.select("run", "node", F.concat("b.path", F.array("node")).alias("path"), F.concat("b.relations", F.array("b.relation")).alias("relations"))


def levels(graph: Graph, seeds: DataFrame, depth: int | None, edges: DataFrame | None = None, allowed: Column | None = None, paths: bool = True) -> DataFrame:
    """(run, node, hop, path, relations) by breadth first search, seeds at hop 0; no path and relations without ``paths``.

    ``allowed`` restricts the neighbours by their node columns (a node that is not
    allowed is not passed through either).
    """
    edges = (graph.edges if edges is None else edges).select("src", "dst", "relation")
    if allowed is not None:
        edges = edges.join(graph.nodes.where(allowed).select(F.col("id").alias("dst")), "dst", "left_semi")
    start = known_seeds(graph, seeds).select("run", "node", F.lit(0).alias("hop"), F.array("node").alias("path"), F.array().cast("array<string>").alias("relations"))
    columns = ["run", "node", "hop", "path", "relations"] if paths else ["run", "node", "hop"]
    start = start.select(columns)
    frontier = scratch.table(start, "level")
    done = [frontier]
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        visited = reduce(DataFrame.unionByName, [d.select("run", "node") for d in done])
        frontier = scratch.table(_level(frontier, edges, visited, paths).withColumn("hop", F.lit(hop)).select(columns), "level")
        if not frontier.limit(1).count():
            break
        done.append(frontier)
    return reduce(DataFrame.unionByName, done)


def _result(graph: Graph, reached: DataFrame, risk: Column) -> DataFrame:
    nodes = graph.nodes.select(F.col("id").alias("node"), F.col("type").alias("artifact_type"), F.col("name").alias("artifact_name"))
    out = reached.withColumn("risk", risk).join(nodes, "node")
    if "path" not in reached.columns:
        return out.select("run", "node", "artifact_type", "artifact_name", "risk", "hop")
    reason = scalars.path_reason(F.col("path"), F.col("relations"))
    return out.select("run", "node", "artifact_type", "artifact_name", "risk", "hop", "path", "relations", reason.alias("reason"))


def bfs(graph: Graph, seeds: DataFrame, max_depth: int = 3, exclude_types: tuple[str, ...] = (), paths: bool = True) -> DataFrame:
    """Impact by hops: risk 1 / (hop + 1) along the propagation relations; seeds are left out; ``paths`` tells how each is reached."""
    edges = graph.edges.where(F.col("relation").isin(*PROPAGATION))
    allowed = ~F.col("type").isin(*exclude_types) if exclude_types else None
    reached = levels(graph, seeds, max_depth, edges, allowed, paths).where("hop > 0")
    return _result(graph, reached, 1 / (F.col("hop") + 1))


def structural(graph: Graph, seeds: DataFrame, max_depth: int = 5, paths: bool = True) -> DataFrame:
    """Impact along the module hierarchy only."""
    edges = graph.edges.where(F.col("relation").isin("instantiates", "depended_by"))
    reached = levels(graph, seeds, max_depth, edges, F.col("type") == "Module", paths).where("hop > 0")
    return _result(graph, reached, 1 / (F.col("hop") + 1))


def weighted_bfs(graph: Graph, seeds: DataFrame, alpha: float = 0.7, max_depth: int = 5, min_risk: float = 0.01, change_type: str | None = None, exclude_types: tuple[str, ...] = (), mode: str = "label", paths: bool = True, columns: tuple[str, ...] = _FOUND) -> DataFrame:
    """Impact by decaying risk: each edge multiplies the risk by its weight and ``alpha``.

    ``mode="label"``: best-first semantics, one label (risk, hop) per node, the best
    one, and nothing is expanded from a label at ``max_depth``; computed as the
    fixpoint of rounds that derive all labels from those of the round before, which
    is unique since a step always lowers the risk (``alpha`` < 1).
    ``mode="path_max"``: the maximum over all walks of at most ``max_depth`` steps.
    Seeds are left out of the result.  Without ``paths`` it has just ``columns``.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    how = (alpha, max_depth, min_risk, change_type, exclude_types, mode)
    if paths:
        return _weighted_rounds(graph, seeds, *how, True)
    return _found(graph, known_seeds(graph, seeds), _weighted_search(*how), lambda left: _weighted_rounds(graph, left, *how, False), columns)


def _weighted_rounds(graph: Graph, seeds: DataFrame, alpha: float, max_depth: int, min_risk: float, change_type: str | None, exclude_types: tuple[str, ...], mode: str, paths: bool) -> DataFrame:
    """``weighted_bfs`` round by round over the whole graph."""
    edges = _weights(graph.edges.where(F.col("relation").isin(*PROPAGATION)).select("src", "dst", "relation"), OVERRIDES.get(change_type, {}))
    if exclude_types:
        edges = edges.join(graph.nodes.where(~F.col("type").isin(*exclude_types)).select(F.col("id").alias("dst")), "dst", "left_semi")
    edges = scratch.table(edges, "weighted")
    seeds = scratch.table(known_seeds(graph, seeds), "seeds")
    start = seeds.select("run", "node", F.lit(1.0).alias("risk"), F.lit(0).alias("hop"))
    if paths:
        start = start.withColumn("path", F.array("node")).withColumn("relations", F.array().cast("array<string>"))
    way = [F.col("path"), F.col("relations")] if paths else []

    def relax(labels: DataFrame) -> DataFrame:
        step = labels.where(F.col("hop") < max_depth).join(edges.select(F.col("src").alias("node"), "dst", "relation", "weight"), "node")
        step = step.withColumn("new", F.col("risk") * F.col("weight") * alpha).where(F.col("new") >= min_risk)
        # higher risk, then higher risk of the predecessor, then its smaller id
        key = F.struct((-F.col("new")).alias("new"), (-F.col("risk")).alias("risk"), F.col("node"), F.col("relation"), F.col("hop"), *([F.col("path"), F.col("relations")] if paths else []))
        best = step.groupBy("run", F.col("dst").alias("at")).agg(F.min(key).alias("b"))
        longer = [F.concat("b.path", F.array("at")).alias("path"), F.concat("b.relations", F.array("b.relation")).alias("relations")] if paths else []
        return best.select("run", F.col("at").alias("node"), (-F.col("b.new")).alias("risk"), (F.col("b.hop") + 1).alias("hop"), *longer)

    if mode == "path_max":
        layer, parts = start, []
        for _ in range(max_depth):
            layer = scratch.table(relax(layer), "walk")
            parts.append(layer)
        best = reduce(DataFrame.unionByName, parts).groupBy("run", "node").agg(F.min(F.struct((-F.col("risk")).alias("risk"), F.col("hop"), *way)).alias("b"))
        labels = best.select("run", "node", (-F.col("b.risk")).alias("risk"), "b.hop", *(["b.path", "b.relations"] if paths else []))
    else:
        labels, mark, old = start, None, None
        while True:
            derived = relax(labels).join(seeds, ["run", "node"], "left_anti")
            labels = scratch.table(start.unionByName(derived), "labels")
            if old is not None:
                scratch.drop(old)
            old = labels
            new = labels.agg(F.count("*"), F.sum(F.xxhash64("run", "node", "risk", "hop").cast("decimal(38,0)"))).first()
            if new == mark:
                break
            mark = new
    reached = labels.join(seeds, ["run", "node"], "left_anti")
    return _result(graph, reached, F.col("risk"))


def _found(graph: Graph, seeds: DataFrame, search: Search, apart: Callable[[DataFrame], DataFrame], columns: tuple[str, ...]) -> DataFrame:
    """What ``search`` finds within tasks, and ``apart`` for the runs that no task can take."""
    packed = together.split(graph, seeds, "artifact_name" in columns)
    return _told(packed, search, apart, columns)


def _told(packed: together.Packed, search: Search, apart: Callable[[DataFrame], DataFrame], columns: tuple[str, ...]) -> DataFrame:
    def work(share: together.Share) -> Iterator[dict]:
        for run, node, risk, hop in search(share):
            told = share.known[node] | ("score" in columns)  # plain ranks are also told of ends that are no nodes
            run, node = run[told], node[told]
            named = {"run": (share.runs, run), "node": (share.ids, node), "artifact_type": (share.type, node), "artifact_name": (share.name, node)}
            numbers = {"risk": risk, "score": risk, "hop": hop}
            for k in range(0, len(run), 100_000):
                cut = slice(k, k + 100_000)
                yield {c: named[c][0].take(pa.array(named[c][1][cut])) if c in named else pa.array(numbers[c][told][cut]) for c in columns}

    kinds = {"risk": "double", "score": "double", "hop": "int"}
    out = together.in_tasks(packed.parts, work, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))
    return out if packed.left is None else out.unionByName(apart(packed.left).select(*columns))


def _weighted_search(alpha: float = 0.7, max_depth: int = 5, min_risk: float = 0.01, change_type: str | None = None, exclude_types: tuple[str, ...] = (), mode: str = "label") -> Search:
    weights = {**WEIGHTS, **OVERRIDES.get(change_type, {})}
    return lambda share: share.weighted(share.where(PROPAGATION, never=exclude_types), weights, DEFAULT_WEIGHT, alpha, max_depth, min_risk, mode)


def _bfs_search(max_depth: int = 3, exclude_types: tuple[str, ...] = ()) -> Search:
    return lambda share: _hops(share, share.where(PROPAGATION, never=exclude_types), max_depth)


def _structural_search(max_depth: int = 5) -> Search:
    return lambda share: _hops(share, share.where(("instantiates", "depended_by"), only=("Module",)), max_depth)


def _hops(share: together.Share, edges: np.ndarray, depth: int) -> Iterator[tuple]:
    for hop, run, node in share.levels(edges, np.arange(len(share.runs)), depth):
        if hop:
            yield run, node, np.full(len(run), 1 / (hop + 1)), np.full(len(run), hop, np.int32)


def _truth_search(depth: int) -> Search:
    """Of runs seeded with ``change_type``."""

    def search(share: together.Share) -> Iterator[tuple]:
        kind = np.full(len(share.runs), "", object)
        kind[share.seed_run] = share.seeds.field("change_type").to_pylist()
        for k in np.unique(kind.astype(str)):
            for hop, run, node in share.levels(share.where(TRUTH_RELATIONS.get(k, TRUTH_FALLBACK)), np.flatnonzero(kind == k), depth):
                told = np.full(len(run), True) if hop else (share.type_of[node] == "Constraint") & (k == "constraint")
                yield run[told], node[told], np.zeros(told.sum()), np.full(told.sum(), hop, np.int32)

    return search


def _truth_seeds(changes: DataFrame) -> tuple[DataFrame, bool]:
    """Distinct changes, and whether each run has one type."""
    kind = F.when(F.col("change_type").isin(*TRUTH_RELATIONS), F.col("change_type")).otherwise("")
    seeds = scratch.table(changes.select("run", "node", kind.alias("change_type")).distinct(), "changes")
    return seeds, seeds.groupBy("run").agg(F.count_distinct("change_type").alias("n")).where("n > 1").isEmpty()


def ground_truth(graph: Graph, changes: DataFrame, depth: int = TRUTH_DEPTH) -> DataFrame:
    """(run, node, artifact_type, hop): what each change truly affects.

    ``changes(run, node, change_type)``; the search follows the relations of the
    change's type.  A constraint change may name constraint nodes as seeds: those
    are in the truth at hop 0, modules are not.
    """
    seeds, plain = _truth_seeds(changes)
    if not plain:
        return _truth_rounds(graph, seeds, depth)
    return _found(graph, seeds, _truth_search(depth), lambda left: _truth_rounds(graph, left, depth), ("run", "node", "artifact_type", "hop"))


def truth_sizes(graph: Graph, changes: DataFrame, depth: int = TRUTH_DEPTH) -> DataFrame:
    """(run, n): how many nodes ``ground_truth`` has, for the changes that affect any."""
    seeds, plain = _truth_seeds(changes)
    count = lambda truth: truth.groupBy("run").agg(F.count_distinct("node").alias("n"))
    if not plain:
        return count(_truth_rounds(graph, seeds, depth))
    packed = together.split(graph, seeds)

    def work(share: together.Share) -> Iterator[dict]:
        n = np.zeros(len(share.runs), np.int64)
        for run, node, _, _ in _truth_search(depth)(share):
            n += np.bincount(run[share.known[node]], minlength=len(n))
        some = np.flatnonzero(n)
        yield {"run": share.runs.take(pa.array(some)), "n": n[some]}

    out = together.in_tasks(packed.parts, work, "run string, n bigint")
    return out if packed.left is None else out.unionByName(count(_truth_rounds(graph, packed.left, depth)))


def _truth_rounds(graph: Graph, seeds: DataFrame, depth: int) -> DataFrame:
    """``ground_truth`` level by level over the whole graph."""
    rows = [(t, r) for t, rs in TRUTH_RELATIONS.items() for r in rs] + [("", r) for r in TRUTH_FALLBACK]
    table = graph.edges.sparkSession.createDataFrame(rows, "change_type string, relation string")
    edges = graph.edges.select(F.col("src").alias("node"), "dst", "relation").join(F.broadcast(table), "relation")  # a fixed table of some 60 rows
    at = scratch.table(seeds.withColumn("hop", F.lit(0)), "truth")
    done, hop = [at], 0
    while hop < depth:
        hop += 1
        visited = reduce(DataFrame.unionByName, [d.select("run", "node") for d in done])
        step = at.join(edges, ["node", "change_type"]).select("run", F.col("dst").alias("node"), "change_type").distinct()
        at = scratch.table(step.join(visited, ["run", "node"], "left_anti").withColumn("hop", F.lit(hop)).select("run", "node", "change_type", "hop"), "truth")
        if not at.limit(1).count():
            break
        done.append(at)
    nodes = graph.nodes.select(F.col("id").alias("node"), F.col("type").alias("artifact_type"))
    every = reduce(DataFrame.unionByName, done).join(nodes, "node")
    return every.where("hop > 0 or (change_type = 'constraint' and artifact_type = 'Constraint')").select("run", "node", "artifact_type", "hop")


def pagerank(graph: Graph, seeds: DataFrame, alpha: float = 0.85, iterations: int = 200, tolerance: float | None = 1e-6, min_score: float = 1e-4) -> DataFrame:
    """Personalised rank of every node for each run, divided by the run's highest; seeds are left out.

    Power iteration over all edges, unweighted; the rank of nodes without outgoing
    edges goes back to the seeds.  It stops when a run's total change falls below
    nodes x ``tolerance`` in all runs, counting the nodes of the designs of its
    seeds (other designs in the graph must not loosen it), or after ``iterations`` (always that many
    for ``tolerance=None``).  Ranks that are still zero take no part.
    """
    seeds = known_seeds(graph, seeds)
    packed = together.split(graph, seeds)
    if packed.left is not None:  # all runs take as many rounds
        return _rank_rounds(graph, seeds, alpha, iterations, tolerance, min_score)
    rounds = iterations if tolerance is None else _rounds(graph, seeds, alpha, iterations, tolerance)
    return _told(packed, _rank_search(alpha, rounds, min_score), None, ("run", "node", "score"))


def _rank_search(alpha: float, rounds: int, min_score: float) -> Search:
    """Ranks after a number of rounds, with the distance from the seeds."""

    def search(share: together.Share) -> Iterator[tuple]:
        for runs, nodes, seed, x, _ in share.ranks(alpha, rounds):
            number = np.full(len(share.ids), -1)
            number[nodes] = np.arange(len(nodes))
            far = np.zeros(x.shape, np.int32)
            for hop, run, node in share.levels(np.arange(len(share.src)), runs, None):
                far[number[node], run - runs[0]] = hop
            score = x / x.max(axis=0)
            node, run = np.nonzero((x > 0) & (score >= min_score) & ~seed)
            yield runs[run], nodes[node], score[node, run], far[node, run]

    return search


def _rounds(graph: Graph, seeds: DataFrame, alpha: float, iterations: int, tolerance: float) -> int:
    """How many rounds ``pagerank`` takes.

    A run's change never grows, so the runs stop together in the last of the rounds in
    which each first could.  After k rounds it is at most 2 ``alpha`` ** k: runs of the
    smallest designs are tried first, and then only those that could need more.
    """
    design = F.coalesce("design", F.lit("")).alias("design") if "design" in graph.nodes.columns else F.lit("").alias("design")
    homes = seeds.join(graph.nodes.select(F.col("id").alias("node"), design), "node").select("run", "design").distinct()
    sized = homes.join(graph.nodes.groupBy(design).agg(F.count("*").alias("n")), "design").groupBy("run").agg(F.sum("n").alias("n"))
    sized = scratch.table(sized, "sized")
    least = sized.agg(F.min("n")).first()[0]
    if least is None:
        return 1

    def last(some: DataFrame) -> int:
        tried = together.split(graph, seeds.join(some, "run"))

        def work(share: together.Share) -> Iterator[dict]:
            n = np.zeros(len(share.runs))
            n[share.seed_run] = share.seeds.field("n").to_numpy(zero_copy_only=False)
            rounds = [r.max() for *_, r in share.ranks(alpha, iterations, lambda runs, change: change / n[runs] < tolerance)]
            yield {"k": np.array(rounds, np.int64)}

        return together.in_tasks(tried.parts, work, "k bigint").agg(F.max("k")).first()[0] or 1

    most = last(sized.where(F.col("n") == least))
    more = sized.where((F.col("n") > least) & (2 * alpha**most >= F.col("n") * tolerance))
    return most if more.isEmpty() else max(most, last(more))


def _rank_rounds(graph: Graph, seeds: DataFrame, alpha: float, iterations: int, tolerance: float | None, min_score: float) -> DataFrame:
    """``pagerank`` round by round over the whole graph."""
    edges = graph.edges.select("src", "dst")
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = scratch.table(edges.join(out, "src"), "links")
    per = seeds.groupBy("run").agg(F.count("*").alias("m"))
    personal = scratch.table(seeds.join(per, "run").select("run", "node", (1.0 / F.col("m")).alias("p")), "personal")
    design = F.coalesce("design", F.lit("")).alias("design") if "design" in graph.nodes.columns else F.lit("").alias("design")
    homes = seeds.join(graph.nodes.select(F.col("id").alias("node"), design), "node").select("run", "design").distinct()
    sized = homes.join(graph.nodes.groupBy(design).agg(F.count("*").alias("n")), "design").groupBy("run").agg(F.sum("n").alias("n"))
    sized = scratch.table(sized, "sized") if tolerance is not None else sized
    fan = links.select(F.col("src").alias("node"), "dst", "out")
    inner = fan.select("node").distinct()
    always = personal.select("run", "node", (F.col("p") * (1 - alpha)).alias("a"), F.lit(0.0).alias("y"))
    x = scratch.table(personal.select("run", "node", F.col("p").alias("x")), "rank")
    for _ in range(iterations):
        # one aggregation a round: what moves along edges, what goes back, and the rank before it
        at = x.where("x > 0")
        moved = at.join(fan, "node").select("run", F.col("dst").alias("node"), (alpha * F.col("x") / F.col("out")).alias("a"), F.lit(0.0).alias("y"))
        loose = at.join(inner, "node", "left_anti").groupBy("run").agg(F.sum("x").alias("d"))
        back = loose.join(personal, "run").select("run", "node", (alpha * F.col("d") * F.col("p")).alias("a"), F.lit(0.0).alias("y"))
        old = at.select("run", "node", F.lit(0.0).alias("a"), F.col("x").alias("y"))
        new = moved.unionByName(back).unionByName(always).unionByName(old).groupBy("run", "node").agg(F.sum("a").alias("x"), F.sum("y").alias("y"))
        new = scratch.table(new, "rank")
        if tolerance is not None:
            worst = new.groupBy("run").agg(F.sum(F.abs(F.col("x") - F.col("y"))).alias("e")).join(sized, "run").agg(F.max(F.col("e") / F.col("n"))).first()[0]
        scratch.drop(x)
        x = new
        if tolerance is not None and (worst is None or worst < tolerance):
            break
    x = x.where("x > 0").select("run", "node", "x")
    top = x.groupBy("run").agg(F.max("x").alias("top"))
    ranked = x.join(top, "run").select("run", "node", (F.col("x") / F.col("top")).alias("score")).where(F.col("score") >= min_score)
    return ranked.join(seeds, ["run", "node"], "left_anti")


def ranked_with_paths(graph: Graph, seeds: DataFrame, ranked: DataFrame, depth: int | None = None) -> DataFrame:
    """Ranked nodes with the shortest path from a seed, the seed of smallest id among the nearest."""
    reached = levels(graph, seeds, depth)
    out = ranked.join(reached, ["run", "node"], "left")
    out = out.select("run", "node", "score", F.coalesce("hop", F.lit(-1)).alias("hop"), F.coalesce("path", F.array("node")).alias("path"), F.coalesce("relations", F.array().cast("array<string>")).alias("relations"))
    return _result(graph, out, F.col("score")).select("run", "node", "artifact_type", "artifact_name", "risk", "hop", "path", "relations", "reason")


def lexical(graph: Graph, seeds: DataFrame, fields: tuple[str, ...] = ("name", "raw_line", "property_text", "summary", "message", "constraint_type")) -> DataFrame:
    """Impact by words: the share of a seed's name parts that occur in the texts of a node of its design; hop -1.

    A part has at least three letters.  Parts are matched inside words by their
    rarest three-letter piece, each distinct part with each distinct text once.
    """
    have = [f for f in fields if f in graph.nodes.columns]
    text = F.lower(F.concat_ws(" ", *have))
    design = F.coalesce("design", F.lit("")).alias("design") if "design" in graph.nodes.columns else F.lit("").alias("design")
    names = known_seeds(graph, seeds).join(graph.nodes.select(F.col("id").alias("node"), F.lower("name").alias("name"), design), "node")
    parts = F.array_distinct(F.filter(F.array_append(F.split("name", "_"), F.col("name")), lambda w: F.length(w) >= 3))
    words = names.select("run", "design", F.explode(parts).alias("word")).distinct()
    counts = words.groupBy("run").agg(F.count_distinct("word").alias("n_words"))
    hay = graph.nodes.select(F.col("id").alias("node"), text.alias("line"), design)
    met = contained(words.select(F.col("word").alias("text")), hay.select("line"), 3)
    hit = words.join(met.withColumnRenamed("text", "word"), "word").join(hay, ["line", "design"]).select("run", "node", "word")
    scored = hit.groupBy("run", "node").agg(F.count_distinct("word").alias("n")).join(counts, "run")
    out = scored.join(known_seeds(graph, seeds), ["run", "node"], "left_anti")
    return out.select("run", "node", F.least(F.lit(1.0), F.col("n") / F.col("n_words")).alias("risk"), F.lit(-1).alias("hop"))


def _worded(graph: Graph, seeds: DataFrame) -> DataFrame:
    """``lexical`` in the columns of the other methods."""
    return lexical(graph, seeds).join(graph.nodes.select(F.col("id").alias("node"), F.col("type").alias("artifact_type")), "node")


def _ranked(graph: Graph, seeds: DataFrame, alpha: float = 0.85, iterations: int = 200, tolerance: float | None = 1e-6, min_score: float = 1e-4) -> DataFrame:
    """``pagerank`` in the columns of the other methods."""
    ranked = scratch.table(pagerank(graph, seeds, alpha, iterations, tolerance, min_score), "ranked")
    out = ranked.join(levels(graph, seeds, None, paths=False), ["run", "node"], "left")
    return _result(graph, out.select("run", "node", "score", F.coalesce("hop", F.lit(-1)).alias("hop")), F.col("score"))


def _fitting(f: Callable, options: dict) -> dict:
    return {k: v for k, v in options.items() if k in f.__code__.co_varnames}


def _method(graph: Graph, seeds: DataFrame, packed: together.Packed, method: str, options: dict) -> tuple[Search, Callable[[DataFrame], DataFrame]] | None:
    """A method's search within tasks, and the same for the runs that no task can take; None if it has none."""
    if method == "pagerank":
        o = {"alpha": 0.85, "iterations": 200, "tolerance": 1e-6, "min_score": 1e-4} | _fitting(_ranked, options)
        if packed.left is not None:
            return None
        rounds = o["iterations"] if o["tolerance"] is None else _rounds(graph, seeds, o["alpha"], o["iterations"], o["tolerance"])
        return _rank_search(o["alpha"], rounds, o["min_score"]), None
    make, whole = {"weighted_bfs": (_weighted_search, weighted_bfs), "bfs": (_bfs_search, bfs), "structural": (_structural_search, structural)}[method]
    return make(**_fitting(make, options)), lambda left: whole(graph, left, **_fitting(whole, options), paths=False)


_METHODS = ("weighted_bfs", "bfs", "pagerank", "structural", "lexical")


def compare(graph: Graph, seeds: DataFrame, methods: tuple[str, ...] = _METHODS, **options) -> DataFrame:
    """(method, run, node, artifact_type, risk, hop) of several methods; unknown names are skipped."""
    columns = ("run", "node", "artifact_type", "risk", "hop")
    parts, packed, known = [], None, known_seeds(graph, seeds)
    for m in (m for m in methods if m in _METHODS):
        if m == "lexical":
            found = _worded(graph, seeds)
        else:
            packed = packed or together.split(graph, known)
            search = _method(graph, known, packed, m, options)
            found = _told(packed, *search, columns) if search else _ranked(graph, seeds, **_fitting(_ranked, options))
        parts.append(found.select(F.lit(m).alias("method"), *columns))
    if not parts:
        raise ValueError("no known method")
    return reduce(DataFrame.unionByName, parts)


def compare_sizes(graph: Graph, seeds: DataFrame, methods: tuple[str, ...], **options) -> DataFrame:
    """(method, run, artifact_type, n, risk): how many nodes ``compare`` has and the sum of their risks, counted where they are found."""
    known = known_seeds(graph, seeds)
    packed = together.split(graph, known)
    searches, others = {}, []
    for m in (m for m in methods if m in _METHODS):
        search = _method(graph, known, packed, m, options) if m != "lexical" else None
        if search is None:
            others.append(compare(graph, seeds, (m,), **options))
            continue
        searches[m] = search[0]
        if packed.left is not None:
            others.append(search[1](packed.left).select(F.lit(m).alias("method"), "run", "artifact_type", "risk"))

    def work(share: together.Share) -> Iterator[dict]:
        types = share.type.dictionary_encode()
        kind = types.indices.fill_null(0).to_numpy(zero_copy_only=False)
        width = max(len(types.dictionary), 1)
        for m, search in searches.items():
            n, total = np.zeros(len(share.runs) * width, np.int64), np.zeros(len(share.runs) * width)
            for run, node, risk, _ in search(share):
                told = share.known[node]
                at = run[told] * width + kind[node[told]]
                n += np.bincount(at, minlength=len(n))
                total += np.bincount(at, risk[told], len(n))
            some = np.flatnonzero(n)
            yield {"method": pa.array([m] * len(some), pa.string()), "run": share.runs.take(pa.array(some // width)), "artifact_type": types.dictionary.take(pa.array(some % width)), "n": n[some], "risk": total[some]}

    parts = [together.in_tasks(packed.parts, work, "method string, run string, artifact_type string, n bigint, risk double")] if searches else []
    parts += [o.groupBy("method", "run", "artifact_type").agg(F.count("*").alias("n"), F.sum("risk").alias("risk")) for o in others]
    if not parts:
        raise ValueError("no known method")
    return reduce(DataFrame.unionByName, parts)


def neighborhood(graph: Graph, seeds: DataFrame, hops: int = 1, relations: tuple[str, ...] = (), types: tuple[str, ...] = (), max_nodes: int = 100) -> DataFrame:
    """(run, node, hop) within ``hops`` of the seeds, directions ignored; at most ``max_nodes`` a run, nearest first, then by id."""
    edges = graph.edges if not relations else graph.edges.where(F.col("relation").isin(*relations))
    reached = levels(graph, seeds, hops, both_ways(edges), F.col("type").isin(*types) if types else None)
    order = Window.partitionBy("run").orderBy("hop", "node")
    return reached.select("run", "node", "hop").withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_nodes).drop("k")


def shortest_paths(graph: Graph, pairs: DataFrame, most: int = 5) -> DataFrame:
    """(run, node, distance, total) on any shortest path of ``pairs(run, source, target)``, directed if there is one, else undirected; none beyond ``most`` hops."""
    pairs = pairs.select("run", "source", "target").distinct()

    def on_paths(edges: DataFrame, wanted: DataFrame) -> DataFrame:
        # searched once per end, however many pairs share it; the far end's level bounds what a pair looks at
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")
        ends = lambda c: wanted.select(F.col(c).alias("run"), F.col(c).alias("node")).distinct()
        ahead = scratch.table(levels(graph, ends("source"), most, edges).select(F.col("run").alias("source"), "node", F.col("hop").alias("distance")), "ahead")
        total = wanted.join(ahead.select("source", F.col("node").alias("target"), F.col("distance").alias("total")), ["source", "target"])
        total = scratch.table(total, "totals")
        furthest = total.agg(F.max("total")).first()[0] or 0
        behind = levels(graph, ends("target"), min(most, furthest), back).select(F.col("run").alias("target"), "node", F.col("hop").alias("rest"))
        near = ahead.where(F.col("distance") <= furthest)
        return total.join(behind, "target").where("rest <= total").withColumn("distance", F.col("total") - F.col("rest")).join(near, ["source", "node", "distance"]).select("run", "node", "distance", "total")

    directed = scratch.table(on_paths(graph.edges.select("src", "dst", "relation"), pairs), "paths")
    left = pairs.join(directed.select("run").distinct(), "run", "left_anti")
    return directed.unionByName(on_paths(both_ways(graph.edges), left))


def chain(graph: Graph, seeds: DataFrame, steps: list[tuple[str, str]], max_per_hop: int = 20) -> DataFrame:
    """(run, node, hop) along a chain of (relation, type) steps, an empty type for any; at most ``max_per_hop`` new nodes a step, by id."""
    at = known_seeds(graph, seeds).withColumn("hop", F.lit(0))
    parts = [at]
    for k, (relation, type_) in enumerate(steps, 1):
        edges = graph.edges.where(F.col("relation") == relation).select(F.col("src").alias("node"), "dst")
        step = at.join(edges, "node").select("run", F.col("dst").alias("node")).distinct()
        if type_:
            step = step.join(graph.nodes.where(F.col("type") == type_).select(F.col("id").alias("node")), "node", "left_semi")
        order = Window.partitionBy("run").orderBy("node")
        at = scratch.table(step.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_per_hop).select("run", "node", F.lit(k).alias("hop")), "chain")
        parts.append(at)
    return reduce(DataFrame.unionByName, parts).groupBy("run", "node").agg(F.min("hop").alias("hop"))


def full_context(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(run, node): all neighbours of the seeds, and theirs where they are ports, registers or clocks."""
    edges = both_ways(graph.edges)
    near = known_seeds(graph, seeds)
    one = near.unionByName(near.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("run", F.col("dst").alias("node"))).distinct()
    inner = one.join(graph.nodes.where(F.col("type").isin("Port", "Register", "Clock")).select(F.col("id").alias("node")), "node", "left_semi")
    two = inner.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("run", F.col("dst").alias("node"))
    return one.unionByName(two).distinct()


def resolve_names(graph: Graph, queries: DataFrame) -> DataFrame:
    """(query, node, rank): the node that each typed name means.

    In order: an id; a name or last id part that equals it; one that contains it or
    is contained in it, modules first.  Within a rank, an id that ends with ``::``
    and the name, then the smallest id.  Containment is found by three-letter pieces,
    shorter names by pieces of their length, never on all pairs.
    """
    q = queries.select("query", F.lower("query").alias("q")).where("query is not null and query <> ''").distinct()
    last = F.element_at(F.split("id", "::"), -1)
    named = graph.nodes.select("id", "type", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower(last)))).alias("key")).where("key is not null and key <> ''")
    by_id = q.join(graph.nodes.select(F.col("id").alias("query"), F.col("id").alias("node")), "query").select("query", "node", F.lit(1).alias("rank"))
    exact = q.join(named.withColumnRenamed("key", "q"), "q").select("query", F.col("id").alias("node"), F.lit(2).alias("rank"))
    open_q = q.join(by_id.unionByName(exact).select("query").distinct(), "query", "left_anti").select("query", "q")
    inside = contained(open_q.select(F.col("q").alias("text")), named.select(F.col("key").alias("line")), 3).select(F.col("text").alias("q"), F.col("line").alias("key"))
    around = contained(named.select(F.col("key").alias("text")), open_q.select(F.col("q").alias("line")), 3).select(F.col("line").alias("q"), F.col("text").alias("key"))
    near = open_q.join(inside.unionByName(around).distinct(), "q").join(named, "key")
    near = near.select("query", F.col("id").alias("node"), F.when(F.col("type") == "Module", 3).otherwise(4).alias("rank"))
    every = by_id.unionByName(exact).unionByName(near)
    ends = F.endswith("node", F.concat(F.lit("::"), F.col("query")))
    order = Window.partitionBy("query").orderBy("rank", F.when(F.col("rank").isin(3, 4) & ends, 0).otherwise(1), "node")
    return every.distinct().withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 1_000) -> DataFrame:
    """(query_id, vec_id, similarity, rank): brute-force cosine top k.

    ``vectors(vec_id, embedding)``; ``queries(query_id, embedding)`` is a stated
    query set that meets all vectors in blocks of at most ``block`` queries: each
    batch of vectors is multiplied with the block and gives k rows a query.
    """
    wanted = queries.where("embedding is not null").select("query_id", "embedding")
    blocks = max(1, -(-wanted.count() // block))
    kind = dict(vectors.dtypes)["vec_id"]

    def against(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows])
        q = np.array([r[1] for r in rows], np.float64)
        norms = np.sqrt((q * q).sum(axis=1)) if len(rows) else np.zeros(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = np.array(batch.column("embedding").to_pylist(), np.float64)
                if not len(v) or not len(q):
                    continue
                vec_ids = np.array(batch.column("vec_id").to_pylist())
                similar = (v @ q.T) / (np.sqrt((v * v).sum(axis=1))[:, None] * norms[None, :] + 1e-8)
                order = np.lexsort((np.broadcast_to(vec_ids[:, None], similar.shape), -similar), axis=0)[:k]
                cols = np.broadcast_to(np.arange(len(q)), order.shape)
                arrays = [pa.array(ids[cols.ravel()].tolist()), pa.array(vec_ids[order.ravel()].tolist()), pa.array(similar[order, cols].ravel())]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "similarity"])

        schema = f"query_id {dict(queries.dtypes)['query_id']}, vec_id {kind}, similarity double"
        return vectors.where("embedding is not null").select("vec_id", "embedding").mapInArrow(run, schema)

    parts = [against(wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()) for b in range(blocks)]
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def context(graph: Graph, members: DataFrame) -> Graph:
    """The subgraph of ``members(node)``."""
    return induced(graph, members.select(F.col("node").alias("id")))
