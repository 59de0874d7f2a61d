"""Traversals within tasks: a task has some runs and all edges that these can meet.

Nodes of one design, and designs that an edge or a run ties together, have one home;
homes never meet.  A home's edges go to a task with each ``RUNS`` of its runs, so what
is moved grows with the graph, and rows of (run, node) exist only as results: no table
of them is written, joined or shuffled.  A home of more than ``EDGES`` edges never
enters a task; ``split`` gives its runs back, to be searched level by level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry import scratch
from netquarry.operators.components import connected
from netquarry.operators.graph import Graph

EDGES = 300_000  # most edges of a home that a task takes
RUNS = 256  # runs that a task takes at a time
_CELLS = 1_500_000  # numbers of an array over edges and runs


@dataclass(frozen=True)
class Packed:
    """``parts``: a row per task's share; ``left``: the runs of homes too large for a task, None without any."""

    parts: DataFrame
    left: DataFrame | None


def split(graph: Graph, seeds: DataFrame, names: bool = False) -> Packed:
    """Runs of ``seeds(run, node, ...)`` with their edges; ``names`` packs the names of nodes as well."""
    design = F.coalesce("design", "id") if "design" in graph.nodes.columns else F.col("id")
    known = graph.nodes.select("id", "type", F.col("name") if names else F.lit(None).cast("string").alias("name"), design.alias("key"))
    ends = graph.edges.select("src", "dst", "relation").join(known.select(F.col("id").alias("dst"), "type", "name", F.col("key").alias("b")), "dst", "left")
    ends = ends.join(known.select(F.col("id").alias("src"), F.col("key").alias("a")), "src", "left")
    ends = scratch.table(ends.withColumns({"a": F.coalesce("a", "src"), "b": F.coalesce("b", "dst")}), "ends")
    runs = seeds.join(known.select(F.col("id").alias("node"), F.col("type").alias("own"), F.col("key").alias("a")), "node", "left")
    runs = scratch.table(runs.withColumn("a", F.coalesce("a", "node")), "runs")
    tied = runs.join(runs.groupBy("run").agg(F.min("a").alias("b")), "run").select("a", "b")
    homes = scratch.table(connected(ends.select("a", "b").unionByName(tied).where("a <> b")), "homes").select(F.col("node").alias("a"), "component")
    at_home = lambda df: df.join(homes, "a", "left").withColumn("home", F.coalesce("component", "a")).drop("component", "a")
    ends, runs = at_home(ends), at_home(runs)
    large = scratch.table(ends.groupBy("home").agg(F.count("*").alias("n")).where(F.col("n") > EDGES).select("home"), "large")
    left = None
    if not large.isEmpty():
        left = runs.join(large, "home", "left_semi").select(seeds.columns)
        ends, runs = ends.join(large, "home", "left_anti"), runs.join(large, "home", "left_anti")
    share = runs.groupBy("home").agg(F.ceil(F.count_distinct("run") / RUNS).alias("shares"))
    cut = runs.join(share, "home").groupBy("home", F.pmod(F.xxhash64("run"), F.col("shares")).alias("share"))
    cut = scratch.table(cut.agg(F.collect_list(F.struct(*seeds.columns, "own")).alias("s")), "shares")
    edges = ends.groupBy("home").agg(F.collect_list(F.struct("src", "dst", "relation", "type", "name")).alias("e"))
    parts = max(1, min(cut.count(), 2_000))
    return Packed(scratch.table(cut.join(edges, "home", "left").select("s", "e").repartition(parts), "packed"), left)


class Share:
    """The runs and edges of one row of ``Packed.parts``, numbered; nodes in the order of their ids."""

    def __init__(self, s: pa.StructScalar, e: pa.Scalar) -> None:
        seeds = s.values
        nodes, none = seeds.field("node"), pa.array([], pa.string())
        src, dst, relation, kind, name = (e.values.field(c) for c in ("src", "dst", "relation", "type", "name")) if e.is_valid else [none] * 5
        ids = pc.unique(pa.concat_arrays([src, dst, nodes]))
        self.ids = ids = ids.take(pc.sort_indices(ids))
        at = lambda x: pc.index_in(x, ids).to_numpy(zero_copy_only=False).astype(np.int64)
        self.src, self.dst = at(src), at(dst)
        order = np.lexsort((self.src, self.dst))
        self.src, self.dst = self.src[order], self.dst[order]
        self.relation = np.array(relation.take(pa.array(order)).to_pylist(), object)
        row = np.full(len(ids), -1)
        row[self.dst] = order
        seeded = at(nodes)
        every = pa.concat_arrays([kind, seeds.field("own")])
        row[seeded] = np.where(row[seeded] < 0, len(kind) + np.arange(len(seeded)), row[seeded])
        rows = pa.array(row, mask=row < 0)
        self.type = every.take(rows)
        self.name = pa.concat_arrays([name, pa.nulls(len(seeds), pa.string())]).take(rows)
        self.known = self.type.is_valid().to_numpy(zero_copy_only=False)
        self.type_of = np.array(self.type.to_pylist(), object)
        runs = seeds.field("run")
        self.runs = pc.unique(runs)
        self.seed_run = pc.index_in(runs, self.runs).to_numpy(zero_copy_only=False).astype(np.int64)
        self.seed_node = seeded
        self.seeds = seeds

    def where(self, relations: tuple[str, ...] | None, only: tuple[str, ...] = (), never: tuple[str, ...] = ()) -> np.ndarray:
        """Numbers of the edges of some relations to nodes of some types."""
        keep = np.ones(len(self.src), bool) if relations is None else np.isin(self.relation.astype(str), relations)
        if only or never:
            to = self.type_of[self.dst].astype(str)
            keep &= self.known[self.dst] & (np.isin(to, only) if only else ~np.isin(to, never))
        return np.flatnonzero(keep)

    def levels(self, edges: np.ndarray, runs: np.ndarray, depth: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(hop, run, node) of a breadth first search from ``runs``, hop by hop, seeds at 0; 64 runs are a word."""
        s, d = self.src[edges], self.dst[edges]
        starts = np.flatnonzero(np.diff(d, prepend=-1))
        ends = d[starts]
        place = np.full(len(self.runs), -1)
        place[runs] = np.arange(len(runs))
        bits = np.zeros((len(self.ids), -(-len(runs) // 64) * 64), bool)
        mine = place[self.seed_run] >= 0
        bits[self.seed_node[mine], place[self.seed_run[mine]]] = True
        front = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        seen, hop = front.copy(), 0
        while True:
            rows = np.flatnonzero(front.any(axis=1))
            if not len(rows):
                return
            node, run = np.nonzero(np.unpackbits(front[rows].view(np.uint8), axis=1, bitorder="little"))
            yield hop, runs[run], rows[node]
            if not len(s) or hop == depth:
                return
            new = np.zeros_like(front)
            new[ends] = np.bitwise_or.reduceat(front[s], starts, axis=0)
            front = new & ~seen
            seen |= front
            hop += 1

    def _met(self, edges: np.ndarray, runs: np.ndarray, depth: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``runs`` can meet: nodes, the edges among them renumbered as (source, target, edge)."""
        nodes = np.unique(np.concatenate([node for _, _, node in self.levels(edges, runs, depth)]))
        number = np.full(len(self.ids), -1)
        number[nodes] = np.arange(len(nodes))
        inside = edges[(number[self.src[edges]] >= 0) & (number[self.dst[edges]] >= 0)]
        return nodes, number, inside

    def _blocks(self, edges: np.ndarray) -> list[np.ndarray]:
        """Runs that are worked on at once."""
        width = int(np.clip(_CELLS // max(len(edges), 1), 1, 64))
        return [np.arange(k, min(k + width, len(self.runs))) for k in range(0, len(self.runs), width)]

    def _start(self, runs: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
        """Whether a node is a seed of a run: an array of nodes by runs."""
        at = np.zeros((n, len(runs)), bool)
        mine = (self.seed_run >= runs[0]) & (self.seed_run <= runs[-1])
        at[number[self.seed_node[mine]], self.seed_run[mine] - runs[0]] = True
        return at

    def weighted(self, edges: np.ndarray, weights: dict[str, float], default: float, alpha: float, depth: int, least: float, mode: str) -> Iterator[tuple]:
        """(run, node, risk, hop) of ``traverse.weighted_bfs``."""
        for runs in self._blocks(edges):
            nodes, number, inside = self._met(edges, runs, depth)
            seed = self._start(runs, number, len(nodes))
            weight = np.array([weights.get(r, default) for r in self.relation[inside]])
            slots = list(_slots(number[self.src[inside]], number[self.dst[inside]], weight))
            risk, hop = np.where(seed, 1.0, 0.0), np.zeros(seed.shape, np.int32)
            best, best_hop = np.zeros(seed.shape), np.zeros(seed.shape, np.int32)
            layer = 0
            while True:
                layer += 1
                usable = risk if mode == "path_max" else np.where(hop < depth, risk, 0.0)
                new, via, far = _relaxed(slots, usable, risk, hop, alpha, least, mode == "label")
                if mode == "path_max":
                    better = new > best
                    best, best_hop = np.where(better, new, best), np.where(better, layer, best_hop)
                    risk = new
                    if layer == depth or not new.any():
                        break
                    continue
                new[seed], far[seed] = 1.0, 0
                same = np.array_equal(new, risk) and np.array_equal(far, hop)
                risk, hop = new, far
                if same:
                    best, best_hop = risk, hop
                    break
            node, run = np.nonzero((best > 0) & ~seed)
            yield runs[run], nodes[node], best[node, run], best_hop[node, run]

    def ranks(self, alpha: float, iterations: int, stop: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple]:
        """(runs, nodes, seeds, ranks, rounds) a block, of ``traverse.pagerank``: ranks of nodes by runs after ``iterations`` rounds.

        With ``stop(runs, change)`` a block ends when all its runs may; ``rounds`` has the round in which each first could.
        """
        edges = np.arange(len(self.src))
        for runs in self._blocks(edges):
            nodes, number, inside = self._met(edges, runs, None)
            seed = self._start(runs, number, len(nodes))
            p = seed / seed.sum(axis=0)
            s, d = number[self.src[inside]], number[self.dst[inside]]
            out = np.bincount(s, minlength=len(nodes)).astype(float)
            loose, share = out == 0, (1 / np.maximum(out, 1))[:, None]
            slots = list(_slots(s, d, np.ones(len(s))))
            x, rounds = p, np.zeros(len(runs), np.int64)
            for k in range(1, iterations + 1):
                new = alpha * (_added(slots, x * share) + x[loose].sum(axis=0) * p) + (1 - alpha) * p
                if stop is not None:
                    done = stop(runs, np.abs(new - x).sum(axis=0))
                    rounds[done & (rounds == 0)] = k
                x = new
                if stop is not None and rounds.all():
                    break
            rounds[rounds == 0] = iterations
            yield runs, nodes, seed, x, rounds


def _slots(s: np.ndarray, d: np.ndarray, weight: np.ndarray) -> Iterator[tuple]:
    """The first incoming edge of every node, then the second of those that have one, ...: (targets, sources, weights), sources ascending."""
    order = np.lexsort((s, d))
    s, d, weight = s[order], d[order], weight[order]
    starts = np.flatnonzero(np.diff(d, prepend=-1))
    counts = np.diff(starts, append=len(d))
    by = np.argsort(-counts, kind="stable")
    starts, counts = starts[by], counts[by]
    for k in range(counts[0] if len(counts) else 0):
        e = starts[: np.searchsorted(-counts, -k, "left")] + k
        yield d[e], s[e], weight[e][:, None]


def _added(slots: list[tuple], x: np.ndarray) -> np.ndarray:
    """What all nodes get from their predecessors."""
    if not slots:
        return np.zeros_like(x)
    total = x[slots[0][1]]
    for _, s, _ in slots[1:]:
        total[: len(s)] += x[s]
    out = np.zeros_like(x)
    out[slots[0][0]] = total
    return out


def _relaxed(slots: list[tuple], usable: np.ndarray, risk: np.ndarray, hop: np.ndarray, alpha: float, least: float, ties: bool) -> tuple:
    """The best label that a predecessor gives: the higher risk, then (with ``ties``) the predecessor's higher risk, then its smaller id."""
    new, via, far = np.zeros_like(risk), np.zeros_like(risk), np.zeros(risk.shape, np.int32)
    if not slots:
        return new, via, far
    top, top_via, top_far = (np.zeros((len(slots[0][1]), risk.shape[1]), t) for t in (float, float, np.int32))
    for _, s, w in slots:
        n = len(s)
        got = usable[s] * w * alpha
        got[got < least] = 0.0
        if not ties:
            np.maximum(top[:n], got, out=top[:n])
            continue
        came = risk[s]
        row, run = np.nonzero((got > top[:n]) | ((got == top[:n]) & (got > 0) & (came > top_via[:n])))
        top[row, run], top_via[row, run], top_far[row, run] = got[row, run], came[row, run], hop[s[row], run] + 1
    ends = slots[0][0]
    new[ends], via[ends], far[ends] = top, top_via, top_far
    return new, via, far


def in_tasks(parts: DataFrame, work: Callable[[Share], Iterator[dict]], schema: str) -> DataFrame:
    """``work`` on every share; each dict of arrays that it yields is a batch of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in zip(batch.column("s"), batch.column("e")):
                for columns in work(Share(s, e)):
                    names = list(columns)
                    whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=names)
                    for k in range(0, whole.num_rows, 100_000):
                        yield whole.slice(k, 100_000)

    return parts.mapInArrow(run, schema)
