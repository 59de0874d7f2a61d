"""The property graph over the project's tables, and the same graph in SQL.

Modules, instances, ports, nets, constraints, clocks and commits become nodes;
edges are written in the order of ``EDGE_ORDER``, a later relation between the
same two nodes replacing an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.operators.graph import Graph, build
from netquarry.scratch import load

EDGE_ORDER = ("instantiates", "depended_by", "has_instance", "instance_of", "has_port", "drives", "references_clock", "applies_to", "modifies", "modified_by")
TABLES = ("modules", "instances", "sdc_constraints", "commits")
_BUILT: dict[tuple, Graph] = {}


def _stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells one state of a folder from another: names, sizes and times of the tables' files."""
    out = []
    for name in TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        out.append(tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)))
    return tuple(out)


def forget() -> None:
    """Build graphs anew from now on; also needed after ``scratch.clear``."""
    _BUILT.clear()


def design_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a data folder, built once per session and state of the folder."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir))
    if key not in _BUILT:
        _BUILT[key] = _build(spark, sf_dir)
    return _BUILT[key]


def _node(df: DataFrame, id_: str, type_: str, **columns) -> DataFrame:
    rows = df.where(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("id")).agg(*[F.min(c).alias(n) for n, c in columns.items()])
    return rows.withColumn("type", F.lit(type_))


def _build(spark: SparkSession, sf_dir: str) -> Graph:
    modules = load(spark, sf_dir, "modules").select("module_id", "module_name", "design")
    known = modules.where("module_id is not null").select("module_id").distinct()
    parent, child = known.select(F.col("module_id").alias("parent_module")), known.select(F.col("module_id").alias("child_module"))
    inst = load(spark, sf_dir, "instances").select("instance_id", "inst_name", "parent_module", "child_module", "port_connections", "port_directions", "design")
    under, of = inst.join(parent, "parent_module", "left_semi"), inst.join(child, "child_module", "left_semi")
    linked = under.join(child, "child_module", "left_semi")
    ports = of.select("child_module", "design", F.explode(F.map_keys("port_connections")).alias("port"))
    ports = ports.withColumn("port_id", F.concat_ws("::", "child_module", "port"))
    wires = linked.select("parent_module", "child_module", "design", "port_directions", F.explode("port_connections").alias("port", "nets"))
    wires = wires.select("design", F.concat_ws("::", "child_module", "port").alias("port_id"), F.explode("nets").alias("net"), "parent_module", F.col("port_directions")[F.col("port")].alias("direction"))
    wires = wires.where("direction in ('input', 'output')").withColumn("net_id", F.concat_ws("::", "parent_module", "net"))
    sdc = load(spark, sf_dir, "sdc_constraints").select("constraint_id", "constraint_type", "raw_line", "source_clock", "dest_clock", "design")
    sdc = sdc.withColumn("from_id", F.concat(F.col("design"), F.lit("::clk::"), "source_clock")).withColumn("to_id", F.concat(F.col("design"), F.lit("::clk::"), "dest_clock"))
    clocks = sdc.select(F.col("from_id").alias("clock_id"), F.col("source_clock").alias("clock"), "design").unionByName(sdc.select(F.col("to_id").alias("clock_id"), F.col("dest_clock").alias("clock"), "design"))
    commits = load(spark, sf_dir, "commits").select("commit_id", "summary", "design", "modules_modified")
    touched = commits.select("commit_id", F.explode("modules_modified").alias("m"), "design").withColumn("module_id", F.concat_ws("::", "design", "m")).join(known, "module_id", "left_semi")
    nodes = [
        _node(modules, "module_id", "Module", name="module_name", design="design"),
        _node(inst, "instance_id", "Instance", name="inst_name", design="design"),
        _node(ports, "port_id", "Port", name="port", design="design"),
        _node(wires, "net_id", "Net", name="net", design="design"),
        _node(sdc, "constraint_id", "Constraint", name="constraint_type", design="design", raw_line="raw_line"),
        _node(clocks, "clock_id", "Clock", name="clock", design="design"),
        _node(commits, "commit_id", "Commit", name="summary", design="design", summary="summary"),
    ]

    def edge(df: DataFrame, src: str, dst: str, relation: str) -> DataFrame:
        return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(relation).alias("relation"))

    driven = edge(wires.where("direction = 'output'"), "port_id", "net_id", "drives").unionByName(edge(wires.where("direction = 'input'"), "net_id", "port_id", "drives"))
    edges = [
        edge(linked, "parent_module", "child_module", "instantiates"),
        edge(linked, "child_module", "parent_module", "depended_by"),
        edge(under, "parent_module", "instance_id", "has_instance"),
        edge(of, "instance_id", "child_module", "instance_of"),
        edge(ports, "child_module", "port_id", "has_port"),
        driven,
        edge(sdc, "constraint_id", "from_id", "references_clock"),
        edge(sdc, "constraint_id", "to_id", "applies_to"),
        edge(touched, "commit_id", "module_id", "modifies"),
        edge(touched, "module_id", "commit_id", "modified_by"),
    ]
    return build(nodes, edges)


def every_module(graph: Graph) -> DataFrame:
    """One run per module, seeded with it."""
    return graph.nodes.where("type = 'Module'").select(F.col("id").alias("run"), F.col("id").alias("node"))


# the same graph as common table expressions ``nodes``, ``edges`` and ``seeds``
GRAPH_SQL = """
known AS (SELECT DISTINCT module_id AS id FROM modules WHERE module_id IS NOT NULL),
under AS (SELECT * FROM instances WHERE parent_module IN (SELECT id FROM known)),
oft AS (SELECT * FROM instances WHERE child_module IN (SELECT id FROM known)),
linked AS (SELECT * FROM under WHERE child_module IN (SELECT id FROM known)),
ports AS (SELECT child_module, design, port, child_module || '::' || port AS port_id
          FROM (SELECT child_module, design, unnest(map_keys(port_connections)) AS port FROM oft)),
wires AS (SELECT design, child_module || '::' || e.key AS port_id, net, parent_module || '::' || net AS net_id, direction
          FROM (SELECT design, child_module, parent_module, e, unnest(e.value) AS net, map_extract(port_directions, e.key)[1] AS direction
                FROM (SELECT design, child_module, parent_module, port_directions, unnest(map_entries(port_connections)) AS e FROM linked))
          WHERE direction IN ('input', 'output')),
sdc AS (SELECT *, design || '::clk::' || source_clock AS from_id, design || '::clk::' || dest_clock AS to_id FROM sdc_constraints),
touched AS (SELECT commit_id, module_id FROM (SELECT commit_id, design || '::' || m AS module_id FROM
            (SELECT commit_id, design, unnest(modules_modified) AS m FROM commits)) WHERE module_id IN (SELECT id FROM known)),
node_rows AS (
  SELECT 0 AS seq, module_id AS id, 'Module' AS type, min(module_name) AS name, min(design) AS design, CAST(NULL AS VARCHAR) AS raw_line, CAST(NULL AS VARCHAR) AS summary FROM modules WHERE module_id IS NOT NULL GROUP BY 2
  UNION ALL SELECT 1, instance_id, 'Instance', min(inst_name), min(design), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM instances WHERE instance_id IS NOT NULL GROUP BY 2
  UNION ALL SELECT 2, port_id, 'Port', min(port), min(design), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM ports GROUP BY 2
  UNION ALL SELECT 3, net_id, 'Net', min(net), min(design), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM wires GROUP BY 2
  UNION ALL SELECT 4, constraint_id, 'Constraint', min(constraint_type), min(design), min(raw_line), CAST(NULL AS VARCHAR) FROM sdc WHERE constraint_id IS NOT NULL GROUP BY 2
  UNION ALL SELECT 5, clock_id, 'Clock', min(clock), min(design), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM
    (SELECT from_id AS clock_id, source_clock AS clock, design FROM sdc UNION ALL SELECT to_id, dest_clock, design FROM sdc) WHERE clock_id IS NOT NULL GROUP BY 2
  UNION ALL SELECT 6, commit_id, 'Commit', min(summary), min(design), CAST(NULL AS VARCHAR), min(summary) FROM commits WHERE commit_id IS NOT NULL GROUP BY 2),
nodes AS (SELECT id, arg_max(type, seq) AS type, arg_max(name, seq) AS name, arg_max(design, seq) AS design,
                 arg_max(raw_line, seq) FILTER (raw_line IS NOT NULL) AS raw_line, arg_max(summary, seq) FILTER (summary IS NOT NULL) AS summary
          FROM node_rows GROUP BY id),
edge_rows AS (
  SELECT 0 AS seq, parent_module AS src, child_module AS dst, 'instantiates' AS relation FROM linked
  UNION ALL SELECT 1, child_module, parent_module, 'depended_by' FROM linked
  UNION ALL SELECT 2, parent_module, instance_id, 'has_instance' FROM under
  UNION ALL SELECT 3, instance_id, child_module, 'instance_of' FROM oft
  UNION ALL SELECT 4, child_module, port_id, 'has_port' FROM ports
  UNION ALL SELECT 5, port_id, net_id, 'drives' FROM wires WHERE direction = 'output'
  UNION ALL SELECT 5, net_id, port_id, 'drives' FROM wires WHERE direction = 'input'
  UNION ALL SELECT 6, constraint_id, from_id, 'references_clock' FROM sdc
  UNION ALL SELECT 7, constraint_id, to_id, 'applies_to' FROM sdc
  UNION ALL SELECT 8, commit_id, module_id, 'modifies' FROM touched
  UNION ALL SELECT 9, module_id, commit_id, 'modified_by' FROM touched),
edges AS (SELECT src, dst, arg_max(relation, seq) AS relation FROM edge_rows WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst),
seeds AS (SELECT id AS run, id AS node FROM nodes WHERE type = 'Module')
"""
