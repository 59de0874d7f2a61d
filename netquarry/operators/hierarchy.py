"""Parent-child rows to full hierarchies.

Method: connected components by pointer doubling over the parent links,
components co-located by one shuffle, then an iterative depth-first traversal
with node colouring inside each.  A component above ``component_limit`` nodes is
never put into one task: its depths, roots, sizes and cycles come from the same
doubling, carried on over distributed tables.

Defined results
* links with a null or unknown end, and repeated links, do not count;
* a node with several parents keeps the smallest parent id (``n_parents`` tells);
* a node on a cycle or below one: ``root_id`` is ``CYCLE``, ``tree_depth`` -1,
  ``path`` null; ``on_cycle`` is true for the members of the cycle itself;
* the back edge of a cycle, which closes the path of a traversal from its smallest
  node, is the link into that node;
* null node ids give no row, repeated node ids one row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry import scratch
from netquarry.operators.skew import HOT, join_one

CYCLE = "CYCLE"
COMPONENT_LIMIT = 100_000
SCHEMA = (
    "node_id string, parent_id string, n_parents int, component string, root_id string, "
    "tree_depth int, n_below int, on_cycle boolean, path array<string>"
)


def parent_table(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, parent, n_parents): every node once, its only or smallest known parent.

    ``nodes`` has the column ``node_id``; ``links`` has ``parent_id, child_id``.
    """
    known = nodes.select(F.col("node_id").alias("node")).where("node is not null").distinct()
    pairs = links.select(F.col("child_id").alias("node"), F.col("parent_id").alias("parent")).where("node is not null and parent is not null")
    pairs = pairs.distinct().join(known.select(F.col("node").alias("parent")), "parent", "left_semi")
    one = pairs.groupBy("node").agg(F.min("parent").alias("parent"), F.count("*").cast("int").alias("n_parents"))
    return known.join(one, "node", "left").withColumn("n_parents", F.coalesce("n_parents", F.lit(0)))


def components(parents: DataFrame, hot: int = HOT) -> DataFrame:
    """(node, parent, n_parents, component, cyclic): label of each weak component.

    Round k knows each node's ancestor at distance 2**k and the smallest id on
    the way there.  Only nodes that have not reached a root stay in the loop, so
    it takes log2(depth) rounds for trees; what never ends is on or below a
    cycle, and is labelled by the smallest id of that cycle.  Many children of one
    node all look up that node: beyond ``hot`` rows they are spread over tasks.
    """
    at = scratch.table(parents.select("node", F.coalesce("parent", "node").alias("ptr"), F.col("parent").isNull().alias("ended"), F.col("node").alias("least")), "comp")
    left, reach = at.where("not ended").count(), 1
    while left and reach <= left:
        far = at.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("ended").alias("ended2"), F.col("least").alias("least2"))
        step = join_one(at.where("not ended"), far, "ptr", left, ["node"], hot).select("node", F.col("ptr2").alias("ptr"), F.col("ended2").alias("ended"), F.least("least", "least2").alias("least"))
        new = scratch.table(step.unionByName(at.where("ended")), "comp")
        scratch.drop(at)
        at, reach, left = new, reach * 2, new.where("not ended").count()
    # 2**k exceeds the number of unended nodes: every pointer of those is on its cycle
    ring = at.where("not ended").select(F.col("node").alias("ptr"), F.col("least").alias("label"))
    cyclic = join_one(at.where("not ended"), ring.groupBy("ptr").agg(F.min("label").alias("label")), "ptr", left, ["node"], hot).select("node", F.col("label").alias("component"), F.lit(True).alias("cyclic"))
    trees = at.where("ended").select("node", F.col("ptr").alias("component"), F.lit(False).alias("cyclic"))
    return parents.join(trees.unionByName(cyclic), "node")


def traverse(members: list[tuple[str, str | None, int]], with_path: bool) -> Iterator[tuple]:
    """Iterative depth-first traversal of one component, nodes coloured white, grey, black.

    Yields (node, parent, n_parents, root, depth, n_below, on_cycle, path).
    """
    children: dict[str, list[str]] = {}
    parent = {node: up for node, up, _ in members}
    for node, up, _ in members:
        if up is not None:
            children.setdefault(up, []).append(node)
    for below in children.values():
        below.sort()
    colour: dict[str, int] = {}  # 1 grey: on the stack's path, 2 black: finished
    size: dict[str, int] = {}
    depth: dict[str, int] = {}
    root: dict[str, str] = {}
    ring: set[str] = set()
    starts = sorted(n for n, up in parent.items() if up is None)
    for start in [*starts, *sorted(parent)]:
        if start in colour:
            continue
        # roots come first: what is reached from another start is on a cycle or below one
        tree = parent[start] is None
        colour[start], depth[start], root[start], size[start] = 1, 0 if tree else -1, start if tree else CYCLE, 0
        stack = [(start, iter(children.get(start, ())))]
        while stack:
            node, rest = stack[-1]
            for child in rest:
                state = colour.get(child, 0)
                if state == 0:
                    colour[child], size[child] = 1, 0
                    depth[child], root[child] = depth[node] + 1 if tree else -1, root[node]
                    stack.append((child, iter(children.get(child, ()))))
                    break
                if state == 1:  # back edge: the path from child to node is a cycle
                    for member, _ in reversed(stack):
                        ring.add(member)
                        if member == child:
                            break
                elif state == 2:  # finished from an earlier start; its only parent is this node
                    size[node] += size[child] + 1
            else:
                colour[node] = 2
                stack.pop()
                if stack:
                    size[stack[-1][0]] += size[node] + 1
    total = len(parent)
    for node, up, n_parents in members:
        path = None
        if with_path and depth[node] >= 0:
            path, at = [], node
            while at is not None:
                path.append(at)
                at = parent[at]
            path.reverse()
        # each member of a cycle reaches the whole component, as only one cycle can be in it
        below = total - 1 if node in ring else size[node]
        yield node, up, n_parents, root[node], depth[node], below, node in ring, path


def _whole(with_path: bool):
    """mapInArrow over rows sorted by component; a component may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node_id", "parent_id", "n_parents", "component", "root_id", "tree_depth", "n_below", "on_cycle", "path"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.string())]
        current, members, out = None, [], []

        def flush(rows):
            cols = list(zip(*rows)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        def finish():
            for node, up, n, root, depth, below, ring, path in traverse(members, with_path):
                out.append((node, up, n, current, root, depth, below, ring, path))
                if len(out) >= 5000:
                    yield flush(out)
                    out.clear()

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("component", "node", "parent", "n_parents")]
            for comp, node, up, n in zip(*cols):
                if comp != current:
                    if members:
                        yield from finish()
                    current, members = comp, []
                members.append((node, up, n))
        if members:
            yield from finish()
        if out:
            yield flush(out)

    return run


def _spread(labelled: DataFrame, with_path: bool, hot: int = HOT) -> DataFrame:
    """The same result for components too large for one task, by pointer doubling only.

    Distance to the root and number of nodes below double their reach each
    round; both are sums over shuffled tables, so no task holds a component.
    """
    at = scratch.table(labelled.select("node", F.col("parent").alias("ptr"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("dist"), F.lit(1).cast("long").alias("reached")), "spread")
    rounds, reach, left = 0, 1, at.where("ptr is not null").count()
    total = left
    while left and reach <= total:
        far = at.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2"))
        up = at.where("ptr is not null").groupBy(F.col("ptr").alias("node")).agg(F.sum("reached").alias("more"))
        # finished rows stay out of the join: their null keys would meet in one task
        step = join_one(at.where("ptr is not null"), far, "ptr", left, ["node"], hot).select("node", F.col("ptr2").alias("ptr"), (F.col("dist") + F.col("dist2")).alias("dist"), "reached")
        step = step.unionByName(at.where("ptr is null"))
        new = scratch.table(step.join(up, "node", "left").select("node", "ptr", "dist", (F.col("reached") + F.coalesce("more", F.lit(0))).alias("reached")), "spread")
        scratch.drop(at)
        at, reach, rounds = new, reach * 2, rounds + 1
        left = at.where("ptr is not null").count()
    ring = at.where("ptr is not null").select(F.col("ptr").alias("node")).distinct().withColumn("on_cycle", F.lit(True))
    sizes = labelled.groupBy("component").agg(F.count("*").alias("members"))
    # below a cycle, the doubling counts every node once until the reach passes the depth
    out = labelled.join(at.select("node", "dist", "reached"), "node").join(ring, "node", "left").join(sizes, "component")
    ringed = F.coalesce("on_cycle", F.lit(False))
    out = out.select(
        F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), "n_parents", "component",
        F.when(F.col("cyclic"), F.lit(CYCLE)).otherwise(F.col("component")).alias("root_id"),
        F.when(F.col("cyclic"), F.lit(-1)).otherwise(F.col("dist")).cast("int").alias("tree_depth"),
        F.when(ringed, F.col("members") - 1).otherwise(F.col("reached") - 1).cast("int").alias("n_below"),
        ringed.alias("on_cycle"),
    )
    if not with_path:
        return out.withColumn("path", F.lit(None).cast("array<string>"))
    return _paths(out, total, hot)


def _paths(out: DataFrame, n_rows: int, hot: int) -> DataFrame:
    """Root-to-node paths by doubling: a segment of 2**k nodes is prefixed by its start's segment."""
    at = scratch.table(out.where("tree_depth >= 0").select("node_id", F.col("parent_id").alias("ptr"), F.array("node_id").alias("path")), "path")
    while at.where("ptr is not null").limit(1).count():
        far = at.select(F.col("node_id").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("path").alias("head"))
        step = join_one(at.where("ptr is not null"), far, "ptr", n_rows, ["node_id"], hot).select("node_id", F.col("ptr2").alias("ptr"), F.concat("head", "path").alias("path"))
        new = scratch.table(step.unionByName(at.where("ptr is null")), "path")
        scratch.drop(at)
        at = new
    return out.join(at.select("node_id", "path"), "node_id", "left")


def hierarchies(nodes: DataFrame, links: DataFrame, with_path: bool = True, component_limit: int = COMPONENT_LIMIT, hot: int = HOT) -> DataFrame:
    """Root, depth, path, number of nodes below and cycle membership of every node.

    ``nodes(node_id)``, ``links(parent_id, child_id)``; see the module's text for
    the defined results.  Columns as in ``SCHEMA``.
    """
    labelled = scratch.table(components(scratch.table(parent_table(nodes, links), "parents"), hot), "labelled")
    sizes = labelled.groupBy("component").agg(F.count("*").alias("members"))
    large = sizes.where(F.col("members") > component_limit).select("component")
    n_large = large.count()
    small = labelled.join(large, "component", "left_anti") if n_large else labelled
    out = small.select("component", "node", "parent", "n_parents").repartition("component").sortWithinPartitions("component", "node").mapInArrow(_whole(with_path), SCHEMA)
    if n_large:
        out = out.unionByName(_spread(scratch.table(labelled.join(large, "component", "left_semi"), "large"), with_path, hot))
    return out


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) of every other node below every node, on and below cycles too.

    Each node's chain of ancestors doubles until it ends at a root or repeats, so
    paths from a root are not needed; the distance is that of the shortest way.
    """
    up = F.when(F.col("parent_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("parent_id"))
    at = scratch.table(tree.select("node_id", up.alias("chain"), F.col("parent_id").isNull().alias("ended")), "chain")
    while at.where("not ended").limit(1).count():
        far = at.select(F.col("node_id").alias("last"), F.col("chain").alias("more"), F.col("ended").alias("ended2"))
        step = at.where("not ended").withColumn("last", F.element_at("chain", -1)).join(far, "last")
        step = step.select("node_id", F.array_distinct(F.concat("chain", "more")).alias("longer"), (F.size("chain") + F.size("more")).alias("most"), "ended2")
        step = step.select("node_id", F.col("longer").alias("chain"), (F.col("ended2") | (F.size("longer") < F.col("most"))).alias("ended"))
        new = scratch.table(step.unionByName(at.where("ended")), "chain")
        scratch.drop(at)
        at = new
    rows = at.select("node_id", F.posexplode("chain").alias("level", "ancestor_id"))
    return rows.where("ancestor_id <> node_id").select("ancestor_id", "node_id", (F.col("level") + 1).alias("distance"))


def cycle_edges(tree: DataFrame) -> DataFrame:
    """(component, parent_id, node_id, back_edge): the links that form cycles, and which of them a traversal finds closing one."""
    return tree.where("on_cycle").select("component", "parent_id", "node_id", (F.col("node_id") == F.col("component")).alias("back_edge"))
