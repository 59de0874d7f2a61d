"""Property graphs as two tables: merging with last-writer semantics, subgraphs, summaries, export."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry import scratch


@dataclass(frozen=True)
class Graph:
    """``nodes(id, type, name, design, ...)`` unique by id; ``edges(src, dst, relation, ...)`` unique by (src, dst)."""

    nodes: DataFrame
    edges: DataFrame


def union_in_order(batches: list[DataFrame]) -> DataFrame:
    """Batches one after the other, with ``seq`` telling which came later."""
    numbered = [b.withColumn("seq", F.lit(k)) for k, b in enumerate(batches)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def last_writer(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; each column keeps the last value that is not null, by ``seq``.

    Repeats within a batch are settled by the smallest value, so the result does
    not depend on the order in which rows are read.
    """
    values = [c for c in rows.columns if c not in (*keys, "seq")]
    kept = [F.expr(f"min_by({c}, struct(-seq, cast({c} as string))) filter (where {c} is not null)").alias(c) if dict(rows.dtypes)[c][:3] != "map" else F.max_by(c, F.col("seq")).alias(c) for c in values]
    return rows.groupBy(*keys).agg(*kept)


def build(node_batches: list[DataFrame], edge_batches: list[DataFrame]) -> Graph:
    """A graph from batches of nodes and edges in the order of writing, kept in the shared folder."""
    nodes = last_writer(union_in_order(node_batches), ["id"])
    edges = last_writer(union_in_order(edge_batches).where("src is not null and dst is not null"), ["src", "dst"])
    return Graph(scratch.table(nodes, "nodes"), scratch.table(edges, "edges"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, for traversals that ignore direction."""
    return edges.select("src", "dst", "relation").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation"))


def induced(graph: Graph, members: DataFrame) -> Graph:
    """The nodes of ``members(id)`` and the edges with both ends among them."""
    ids = members.select("id").distinct()
    edges = graph.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return Graph(graph.nodes.join(ids, "id", "left_semi"), edges)


def by_type(graph: Graph, type_: str, attributes: dict[str, str] | None = None, limit: int = 50) -> DataFrame:
    """Nodes of a type whose attributes equal the given ones without regard to case, the first ``limit`` by id."""
    out = graph.nodes.where(F.col("type") == type_)
    for key, value in (attributes or {}).items():
        out = out.where(F.lower(F.col(key).cast("string")) == str(value).lower())
    return out.orderBy("id").limit(limit)


def relation_counts(graph: Graph) -> DataFrame:
    """(kind, label, n): nodes by type and edges by relation."""
    nodes = graph.nodes.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "label", "n")
    edges = graph.edges.groupBy(F.col("relation").alias("label")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "label", "n")
    return nodes.unionByName(edges)


def degrees(graph: Graph, relations: tuple[str, ...] = ("instantiates", "has_port", "contains_register", "verified_by", "constrained_by")) -> DataFrame:
    """Outgoing edges of each module by relation, one column each, 0 without any."""
    modules = graph.nodes.where("type = 'Module'").select("id")
    counts = graph.edges.where(F.col("relation").isin(*relations)).groupBy(F.col("src").alias("id")).agg(*[F.count_if(F.col("relation") == r).alias(f"n_{r}") for r in relations])
    return modules.join(counts, "id", "left").fillna(0)


def context_lines(sub: Graph) -> DataFrame:
    """A subgraph as lines of text: nodes by type and name, then edges."""
    nodes = sub.nodes.select(F.lit(0).alias("part"), "id", F.concat(F.lit("["), "type", F.lit("] "), F.coalesce("name", F.lit("")), F.lit(" id="), "id").alias("line"))
    edges = sub.edges.select(F.lit(1).alias("part"), F.concat_ws(" ", "src", "dst").alias("id"), F.concat("src", F.lit(" --"), "relation", F.lit("--> "), "dst").alias("line"))
    return nodes.unionByName(edges)


def export(graph: Graph, path: str, kind: str) -> None:
    """Write a graph as ``parquet``, ``json`` (two tables), ``node_link``, ``graphml`` or ``gexf`` (one text file).

    The text formats are for graphs that a person opens: they are streamed to one
    file through the driver, row by row.  Any other format raises ValueError.
    """
    if kind in ("parquet", "json"):
        getattr(graph.nodes.write, kind)(f"{path}/nodes")
        getattr(graph.edges.write, kind)(f"{path}/edges")
        return
    if kind not in ("node_link", "graphml", "gexf"):
        raise ValueError(f"unknown format {kind!r}")
    flat = lambda v: "" if v is None else json.dumps(v, sort_keys=True) if isinstance(v, (dict, list)) else str(v)
    node_names = [c for c in graph.nodes.columns if c != "id"]
    edge_names = [c for c in graph.edges.columns if c not in ("src", "dst")]
    nodes, edges = graph.nodes.orderBy("id").toLocalIterator(), graph.edges.orderBy("src", "dst").toLocalIterator()
    with open(path, "w", encoding="utf-8") as f:
        if kind == "node_link":
            f.write('{"directed": true, "multigraph": false, "graph": {}, "nodes": [')
            for k, row in enumerate(nodes):
                f.write(("," if k else "") + json.dumps(row.asDict(True), default=str))
            f.write('], "links": [')
            for k, row in enumerate(edges):
                d = row.asDict(True)
                f.write(("," if k else "") + json.dumps({"source": d.pop("src"), "target": d.pop("dst"), **d}, default=str))
            f.write("]}")
        elif kind == "graphml":
            f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
            for n in node_names:
                f.write(f'<key id={quoteattr("n_" + n)} for="node" attr.name={quoteattr(n)} attr.type="string"/>\n')
            for n in edge_names:
                f.write(f'<key id={quoteattr("e_" + n)} for="edge" attr.name={quoteattr(n)} attr.type="string"/>\n')
            f.write('<graph edgedefault="directed">\n')
            for row in nodes:
                data = "".join(f"<data key={quoteattr('n_' + n)}>{escape(flat(row[n]))}</data>" for n in node_names if row[n] is not None)
                f.write(f"<node id={quoteattr(row['id'])}>{data}</node>\n")
            for row in edges:
                data = "".join(f"<data key={quoteattr('e_' + n)}>{escape(flat(row[n]))}</data>" for n in edge_names if row[n] is not None)
                f.write(f"<edge source={quoteattr(row['src'])} target={quoteattr(row['dst'])}>{data}</edge>\n")
            f.write("</graph></graphml>\n")
        else:
            f.write('<?xml version="1.0" encoding="utf-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">\n<nodes>\n')
            for row in nodes:
                f.write(f"<node id={quoteattr(row['id'])} label={quoteattr(flat(row['name']))}/>\n")
            f.write("</nodes>\n<edges>\n")
            for k, row in enumerate(edges):
                f.write(f'<edge id="{k}" source={quoteattr(row["src"])} target={quoteattr(row["dst"])} label={quoteattr(flat(row["relation"]))}/>\n')
            f.write("</edges>\n</graph></gexf>\n")
