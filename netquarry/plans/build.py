"""The whole graph of designs from their sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from netquarry import scratch
from netquarry.operators.graph import Graph, build
from netquarry.sources import assertions, commits, constraints, netlist


@dataclass(frozen=True)
class Design:
    """What a graph is built from; everything but the netlist may be missing.

    Without a name, every table has a column ``design``, and the designs are built
    together.
    """

    name: str | None
    netlist: DataFrame  # value: netlist JSON, one text per row
    constraint_files: DataFrame | None = None  # file_path, text
    assertion_files: DataFrame | None = None  # file_path, text; RTL files may be among them
    log: DataFrame | None = None  # rows of the git_log format
    compat: bool = True  # older reading of bus targets in constraints


def build_design(spark: SparkSession, design: Design) -> Graph:
    """The merged graph; batches are written in the order netlist, constraints, assertions, commits."""
    nodes, edges = netlist.to_graph(netlist.tables(design.netlist, design.name))
    alone = build(nodes, edges)
    if design.constraint_files is None and design.assertion_files is None and design.log is None:
        return alone
    base = alone.nodes
    if design.constraint_files is not None:
        parsed = scratch.table(constraints.parse_commands(constraints.scan(design.constraint_files, design.name), short_targets=design.compat), "parsed")
        n, e = constraints.to_graph(parsed, base)
        nodes, edges = nodes + n, edges + e
    if design.assertion_files is not None:
        with_clocks = build(nodes, edges).nodes if design.constraint_files is not None else base
        asserted = scratch.table(assertions.assertions(design.assertion_files, design.name), "asserted")
        names = base.where("type = 'Module'").select("name", "design")
        tests = scratch.table(assertions.testbenches(design.assertion_files, design.name, names), "tests")
        n, e = assertions.to_graph(asserted, tests, with_clocks)
        nodes, edges = nodes + n, edges + e
    if design.log is not None:
        n, e = commits.to_graph(scratch.table(commits.describe(design.log, design.name), "commits"), base)
        nodes, edges = nodes + n, edges + e
    return build(nodes, edges)
