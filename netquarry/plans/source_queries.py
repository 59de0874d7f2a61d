"""Queries of the sources, change generators and answers over texts made from the project's tables, with their SQL.

A netlist, a constraint file and a source file is made for every module, so that
what the sources must find is known from the tables alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry import scratch
from netquarry.functions import scalars as S
from netquarry.operators import answering, changes, results
from netquarry.operators import graph as G
from netquarry.operators import questions as Q
from netquarry.operators import traverse as T
from netquarry.plans.build import Design, build_design
from netquarry.plans.design_graph import GRAPH_SQL, design_graph, every_module
from netquarry.plans.graph_queries import _TRUTH, _walk
from netquarry.scratch import load
from netquarry.sources import assertions, commits, constraints, netlist

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _modules(spark, sf_dir) -> DataFrame:
    rows = load(spark, sf_dir, "modules").where("module_id is not null and module_name is not null and design is not null")
    return rows.groupBy("module_id").agg(F.min("module_name").alias("name"), F.min("design").alias("design"), F.min("src_file").alias("f"), F.min("src_start_line").alias("a"), F.min("src_end_line").alias("b"), F.coalesce(F.max("is_top"), F.lit(False)).alias("top"))


def _cells(spark, sf_dir, m: DataFrame) -> DataFrame:
    known = m.select("module_id")
    rows = load(spark, sf_dir, "instances").where("inst_name is not null and instance_id is not null")
    rows = rows.join(known.select(F.col("module_id").alias("parent_module")), "parent_module", "left_semi").join(known.select(F.col("module_id").alias("child_module")), "child_module", "left_semi")
    one = rows.groupBy("parent_module", "inst_name").agg(F.min_by(F.struct("child_module", "port_connections", "port_directions"), "instance_id").alias("r"))
    return one.select("parent_module", "inst_name", F.col("r.child_module").alias("child"), F.col("r.port_connections").alias("pc"), F.col("r.port_directions").alias("pd"))


_CLK = "clk_core"


def _bits(name: str) -> F.Column:
    return F.transform(F.sequence(F.lit(0), F.length(name) % 3), lambda k: (F.col("base") + k).cast("string"))


def _netlists(spark, sf_dir) -> DataFrame:
    """(design, value): the netlist of every module: its ports, cells of its instances, and a register on every output."""
    m = scratch.table(_modules(spark, sf_dir), "m")
    cells = scratch.table(_cells(spark, sf_dir, m), "i")
    ports = cells.select(F.col("child").alias("module_id"), F.explode(F.map_entries("pd")).alias("e")).groupBy("module_id", F.col("e.key").alias("port")).agg(F.min("e.value").alias("direction")).where("direction is not null")
    ports = scratch.table(ports, "p")
    pins = cells.select(F.col("parent_module").alias("module_id"), "inst_name", F.explode("pc").alias("port", "nets")).select("module_id", "inst_name", "port", F.get("nets", F.lit(0)).alias("net")).where("net is not null")
    names = pins.select("module_id", "net").unionByName(ports.select("module_id", F.col("port").alias("net"))).unionByName(m.select("module_id", F.lit(_CLK).alias("net"))).distinct()
    # a module's nets are numbered in its own array
    nets = names.groupBy("module_id").agg(F.array_sort(F.collect_list("net")).alias("l")).select("module_id", F.posexplode("l").alias("k", "net")).withColumn("base", F.col("k") * 3)
    nets = scratch.table(nets.select("module_id", "net", _bits("net").alias("bits")), "nets")
    port_map = ports.join(nets.withColumnRenamed("net", "port"), ["module_id", "port"]).groupBy("module_id").agg(F.map_from_entries(F.collect_list(F.struct("port", F.struct("direction", "bits")))).alias("ports"))
    net_map = nets.groupBy("module_id").agg(F.map_from_entries(F.collect_list(F.struct("net", F.struct("bits")))).alias("netnames"))
    wired = pins.join(nets, ["module_id", "net"]).groupBy("module_id", "inst_name").agg(F.map_from_entries(F.collect_list(F.struct("port", "bits"))).alias("connections"))
    key = m.select(F.col("module_id").alias("child"), F.concat(F.lit("\\"), "name").alias("type"))
    none = F.create_map().cast("map<string,string>")
    placed = cells.withColumnRenamed("parent_module", "module_id").join(key, "child").join(wired, ["module_id", "inst_name"], "left")
    placed = placed.select("module_id", "inst_name", F.struct("type", none.alias("parameters"), F.coalesce("connections", F.create_map().cast("map<string,array<string>>")).alias("connections"), F.col("pd").alias("port_directions")).alias("c"))
    clk = nets.where(F.col("net") == _CLK).select("module_id", F.col("bits").alias("clk"))
    out = ports.where("direction = 'output'").join(nets.withColumnRenamed("net", "port"), ["module_id", "port"]).join(clk, "module_id")
    even = F.length("port") % 2 == 0
    flags = F.when(even, F.create_map(F.lit("CLK_POLARITY"), F.lit("1"), F.lit("ARST_POLARITY"), F.lit("0"))).otherwise(F.create_map(F.lit("CLK_POLARITY"), F.lit("0")))
    flops = out.select("module_id", F.concat(F.lit("$ff$"), "port").alias("inst_name"), F.struct(F.when(even, "$adff").otherwise("$dff").alias("type"), flags.alias("parameters"), F.create_map(F.lit("CLK"), F.col("clk"), F.lit("Q"), F.col("bits")).alias("connections"), none.alias("port_directions")).alias("c"))
    cell_map = placed.unionByName(flops).groupBy("module_id").agg(F.map_from_entries(F.collect_list(F.struct("inst_name", "c"))).alias("cells"))
    src = F.concat("f", F.lit(":"), F.col("a").cast("string"), F.lit(".1-"), F.col("b").cast("string"), F.lit(".9"))
    attributes = F.map_filter(F.create_map(F.lit("src"), src, F.lit("top"), F.when(F.col("top"), "00000000000000000000000000000001")), lambda _, v: v.isNotNull())
    parameters = F.map_filter(F.create_map(F.lit("LINES"), F.bin(F.col("b").cast("bigint")), F.lit("NAME"), F.col("name")), lambda _, v: v.isNotNull())
    whole = m.join(port_map, "module_id", "left").join(net_map, "module_id", "left").join(cell_map, "module_id", "left")
    body = F.struct(attributes.alias("attributes"), parameters.alias("parameter_default_values"), "ports", "netnames", "cells")
    return whole.select("design", F.to_json(F.struct(F.create_map(F.concat(F.lit("\\"), "name"), body).alias("modules"))).alias("value"))


_M = """m AS (SELECT module_id, min(module_name) AS name, min(design) AS design, min(src_file) AS f, min(src_start_line) AS a, min(src_end_line) AS b, coalesce(bool_or(is_top), false) AS top
  FROM modules WHERE module_id IS NOT NULL AND module_name IS NOT NULL AND design IS NOT NULL GROUP BY 1),
i AS (SELECT parent_module, inst_name, r.child_module AS child, r.port_connections AS pc, r.port_directions AS pd FROM (
  SELECT parent_module, inst_name, arg_min({'child_module': child_module, 'port_connections': port_connections, 'port_directions': port_directions}, instance_id) AS r FROM instances
  WHERE inst_name IS NOT NULL AND instance_id IS NOT NULL AND parent_module IN (SELECT module_id FROM m) AND child_module IN (SELECT module_id FROM m) GROUP BY 1, 2)),
p AS (SELECT module_id, port, min(direction) AS direction FROM (SELECT child AS module_id, e.key AS port, e.value AS direction FROM (SELECT child, unnest(map_entries(pd)) AS e FROM i)) GROUP BY 1, 2 HAVING min(direction) IS NOT NULL),
pin AS (SELECT module_id, inst_name, child, port, net, map_extract(pd, port)[1] AS direction FROM (SELECT parent_module AS module_id, inst_name, child, pd, e.key AS port, e.value[1] AS net FROM (SELECT parent_module, inst_name, child, pd, unnest(map_entries(pc)) AS e FROM i)) WHERE net IS NOT NULL),
net AS (SELECT module_id, net AS name FROM pin UNION SELECT module_id, port FROM p UNION SELECT module_id, 'clk_core' FROM m),
reg AS (SELECT p.*, m.design FROM p JOIN m ON m.module_id = p.module_id WHERE direction = 'output')"""


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    return netlist.tables(_netlists(spark, sf_dir))


@query(f"WITH {_M} SELECT module_id, name AS module_name, '\\' || name AS yosys_name, CASE WHEN f IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL THEN f END AS src_file, coalesce(CASE WHEN f IS NOT NULL AND b IS NOT NULL THEN a END, -1) AS src_start_line, coalesce(CASE WHEN f IS NOT NULL AND a IS NOT NULL THEN b END, -1) AS src_end_line, top AS is_top, design FROM m")
def n_modules(spark, sf_dir):
    """The modules of all netlists; -1 for an unknown line."""
    return _tables(spark, sf_dir)["modules"].fillna(-1, ["src_start_line", "src_end_line"])


@query(f"WITH {_M} SELECT module_id || '::LINES' AS id, module_id, 'LINES' AS name, CAST(b AS VARCHAR) AS value FROM m WHERE b IS NOT NULL UNION ALL SELECT module_id || '::NAME', module_id, 'NAME', name FROM m")
def n_parameters(spark, sf_dir):
    """Their parameters, binary ones as numbers."""
    return _tables(spark, sf_dir)["parameters"].drop("design")


@query(f"WITH {_M} SELECT module_id || '::' || port AS id, module_id, port AS name, direction, CAST(1 + length(port) % 3 AS INTEGER) AS width, regexp_matches(lower(port), 'clk|clock|ck') AS is_clock FROM p")
def n_ports(spark, sf_dir):
    """Their ports with directions, widths and whether they look like clocks."""
    return _tables(spark, sf_dir)["ports"].drop("design")


@query(f"WITH {_M} SELECT module_id || '::' || name AS id, module_id, name, CAST(1 + length(name) % 3 AS INTEGER) AS width FROM net")
def n_nets(spark, sf_dir):
    """Their nets."""
    return _tables(spark, sf_dir)["nets"].drop("design")


@query(f"""WITH {_M} SELECT module_id || '::reg::' || port AS id, module_id, port AS name, 'clk_core' AS clk_net, CASE WHEN length(port) % 2 = 0 THEN 'posedge' ELSE 'negedge' END AS clock_edge,
CASE WHEN length(port) % 2 = 0 THEN 'async' END AS reset_kind, CASE WHEN length(port) % 2 = 0 THEN 'true' ELSE '' END AS reset_active_low, CAST(1 + length(port) % 3 AS INTEGER) AS width FROM reg""")
def n_registers(spark, sf_dir):
    """Registers by their output net, clock, edge and reset."""
    low = F.coalesce(F.col("reset_active_low").cast("string"), F.lit(""))
    return _tables(spark, sf_dir)["registers"].drop("design").withColumn("reset_active_low", low)


@query(f"WITH {_M} SELECT i.parent_module || '::inst::' || inst_name AS instance_id, inst_name, parent_module, child AS child_module, m.name AS child_module_name FROM i JOIN m ON m.module_id = i.child")
def n_instances(spark, sf_dir):
    """Cells that are modules."""
    return _tables(spark, sf_dir)["instances"].select("instance_id", "inst_name", "parent_module", "child_module", "child_module_name")


@query(f"WITH {_M} SELECT DISTINCT module_id AS parent_module, inst_name AS cell, child AS child_module, port, direction, net FROM pin")
def n_wires(spark, sf_dir):
    """Which port of which cell is wired to which net."""
    return _tables(spark, sf_dir)["wires"].drop("design")


@query(f"""WITH {_M} SELECT design || '::clk::clk_core' AS id, 'clk_core' AS name, list_sort(list(DISTINCT module_id || '::reg::' || port)) AS driven_registers, list_sort(list(DISTINCT module_id)) AS driven_modules FROM reg GROUP BY design""")
def n_clocks(spark, sf_dir):
    """Clocks with the registers and modules that they drive."""
    return _tables(spark, sf_dir)["clocks"].drop("design")


# the netlists' graph in SQL, in the order of writing
_NODES = """n0 AS (SELECT 0 AS seq, module_id AS id, 'Module' AS type, name, design FROM m
  UNION ALL SELECT 1, module_id || '::' || k.p, 'Parameter', k.p, design FROM m, (VALUES ('LINES'), ('NAME')) k(p) WHERE k.p = 'NAME' OR b IS NOT NULL
  UNION ALL SELECT 2, p.module_id || '::' || port, 'Port', port, m.design FROM p JOIN m ON m.module_id = p.module_id
  UNION ALL SELECT 3, module_id || '::reg::' || port, 'Register', port, design FROM reg
  UNION ALL SELECT DISTINCT 4, design || '::clk::clk_core', 'Clock', 'clk_core', design FROM reg
  UNION ALL SELECT 5, parent_module || '::inst::' || inst_name, 'Instance', inst_name, m.design FROM i JOIN m ON m.module_id = i.parent_module
  UNION ALL SELECT DISTINCT 6, pin.module_id || '::' || net, 'Net', net, m.design FROM pin JOIN m ON m.module_id = pin.module_id JOIN p ON p.module_id = pin.child AND p.port = pin.port WHERE pin.direction IN ('input', 'output'))"""
_EDGES = """e0 AS (SELECT 0 AS seq, module_id AS src, module_id || '::' || k.p AS dst, 'has_parameter' AS relation FROM m, (VALUES ('LINES'), ('NAME')) k(p) WHERE k.p = 'NAME' OR b IS NOT NULL
  UNION ALL SELECT 1, module_id || '::' || k.p, module_id, 'parameter_of' FROM m, (VALUES ('LINES'), ('NAME')) k(p) WHERE k.p = 'NAME' OR b IS NOT NULL
  UNION ALL SELECT 2, module_id, module_id || '::' || port, 'has_port' FROM p
  UNION ALL SELECT 3, module_id, module_id || '::reg::' || port, 'contains_register' FROM reg
  UNION ALL SELECT 4, module_id || '::reg::' || port, design || '::clk::clk_core', 'clocked_by' FROM reg
  UNION ALL SELECT 5, parent_module, child, 'instantiates' FROM i
  UNION ALL SELECT 6, parent_module || '::inst::' || inst_name, child, 'instance_of' FROM i
  UNION ALL SELECT 7, parent_module, parent_module || '::inst::' || inst_name, 'has_instance' FROM i
  UNION ALL SELECT 8, pin.child || '::' || pin.port, pin.module_id || '::' || net, 'drives' FROM pin JOIN p ON p.module_id = pin.child AND p.port = pin.port WHERE pin.direction = 'output'
  UNION ALL SELECT 8, pin.module_id || '::' || net, pin.child || '::' || pin.port, 'drives' FROM pin JOIN p ON p.module_id = pin.child AND p.port = pin.port WHERE pin.direction = 'input'
  UNION ALL SELECT 9, child, parent_module, 'depended_by' FROM i)"""


@query(f"WITH {_M}, {_NODES}, {_EDGES}, e AS (SELECT src, dst, arg_max(relation, seq) AS relation FROM e0 GROUP BY 1, 2) SELECT 'edge' AS kind, src AS a, dst AS b, relation AS label FROM e UNION ALL SELECT 'node', id, '', arg_max(type, seq) FROM n0 GROUP BY id")
def n_graph(spark, sf_dir):
    """The graph of all netlists: its nodes and edges."""
    g = build_design(spark, Design(None, _netlists(spark, sf_dir)))
    edges = g.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("relation").alias("label"))
    return edges.unionByName(g.nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.col("type").alias("label")))


def _sdc(spark, sf_dir) -> DataFrame:
    """(design, file_path, text): the constraints of every module, with comments, a continued line and a foreign command."""
    m = _modules(spark, sf_dir)
    inst = _cells(spark, sf_dir, m).groupBy(F.col("parent_module").alias("module_id")).agg(F.min("inst_name").alias("inst"))
    n = F.col("name")
    period = F.concat((F.coalesce("b", F.lit(9)) % 50 + 1).cast("string"), F.lit(".0"))
    lines = F.concat(
        F.lit("# made for "), n, F.lit("\ncreate_clock -period "), period, F.lit(" -name ck_"), n, F.lit(" -waveform {0 5} \\\n    [get_ports clk_"), n, F.lit("]\n"),
        F.lit("set_input_delay -clock ck_"), n, F.lit(" -max "), (F.coalesce("a", F.lit(3)) % 9).cast("string"), F.lit(".5 -rise -add_delay [get_ports {tx_data rx["), (F.coalesce("a", F.lit(3)) % 4).cast("string"), F.lit("]}] # late\n\n"),
        F.lit("set_multicycle_path 2 -setup -from [get_cells "), F.coalesce("inst", F.lit("u_none")), F.lit("] -to [get_clocks ck_"), n, F.lit("]\nputs done\n"),
        F.lit("create_generated_clock -name gen_"), n, F.lit(" -source [get_ports clk_"), n, F.lit("] -divide_by 4 -duty_cycle 40 -add -master_clock main [get_pins u_div/q]\nset_false_path -through [get_cells "), n, F.lit("]\n"),
    )
    return m.join(inst, "module_id", "left").select("design", F.concat(F.lit("c/"), n, F.lit(".sdc")).alias("file_path"), lines.alias("text"))


_C = """inst AS (SELECT parent_module AS module_id, min(inst_name) AS inst FROM i GROUP BY 1),
cmd AS (SELECT m.*, coalesce(inst, 'u_none') AS inst, k.line, 'c/' || name || '.sdc' AS file_path, CASE k.line
  WHEN 2 THEN 'create_clock -period ' || (coalesce(b, 9) % 50 + 1) || '.0 -name ck_' || name || ' -waveform {0 5}  [get_ports clk_' || name || ']'
  WHEN 3 THEN 'set_input_delay -clock ck_' || name || ' -max ' || (coalesce(a, 3) % 9) || '.5 -rise -add_delay [get_ports {tx_data rx[' || (coalesce(a, 3) % 4) || ']}]'
  WHEN 5 THEN 'set_multicycle_path 2 -setup -from [get_cells ' || coalesce(inst, 'u_none') || '] -to [get_clocks ck_' || name || ']'
  WHEN 7 THEN 'create_generated_clock -name gen_' || name || ' -source [get_ports clk_' || name || '] -divide_by 4 -duty_cycle 40 -add -master_clock main [get_pins u_div/q]'
  ELSE 'set_false_path -through [get_cells ' || name || ']' END AS raw_line FROM m LEFT JOIN inst ON inst.module_id = m.module_id, (VALUES (2), (3), (5), (7), (8)) k(line)),
sdc2 AS (SELECT *, design || '::sdc::' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS constraint_id FROM (SELECT *, row_number() OVER (PARTITION BY design ORDER BY file_path, line) AS n FROM cmd))"""


@query(f"WITH {_M}, {_C} SELECT constraint_id, raw_line, CAST(line AS INTEGER) AS line_number, file_path, design FROM sdc2")
def k_scan(spark, sf_dir):
    """The commands of constraint files, continued lines joined, comments and foreign commands out."""
    return constraints.scan(_sdc(spark, sf_dir))


@query(f"""WITH {_M}, {_C} SELECT constraint_id, split_part(raw_line, ' ', 1) AS constraint_type,
CASE line WHEN 2 THEN ['clk_' || name] WHEN 3 THEN ['tx_data', 'rx[' || (coalesce(a, 3) % 4) || ']'] WHEN 5 THEN [inst, 'ck_' || name] WHEN 7 THEN ['clk_' || name, 'u_div/q'] ELSE [name] END AS targets,
CASE WHEN line = 2 THEN CAST(coalesce(b, 9) % 50 + 1 AS DOUBLE) END AS period, CASE line WHEN 2 THEN 'ck_' || name WHEN 7 THEN 'gen_' || name END AS clock_name, CASE line WHEN 2 THEN 'clk_' || name WHEN 7 THEN 'u_div/q' END AS clock_port,
CASE WHEN line = 7 THEN 'clk_' || name END AS source_clock, CAST(CASE WHEN line = 7 THEN 4 ELSE 0 END AS INTEGER) AS divide_by, CASE WHEN line = 3 THEN 'ck_' || name END AS clock, CASE WHEN line = 3 THEN coalesce(a, 3) % 9 + 0.5 END::DOUBLE AS delay_max, CASE WHEN line = 3 THEN coalesce(a, 3) % 9 + 0.5 END::DOUBLE AS delay,
CASE WHEN line = 2 THEN '0 5' END AS waveform, CASE line WHEN 2 THEN 'false' WHEN 7 THEN 'true' ELSE '' END AS add, CASE WHEN line = 7 THEN 40.0 END::DOUBLE AS duty_cycle, CASE WHEN line = 7 THEN 'main' END AS master_clock, CASE WHEN line = 3 THEN 'true false true' ELSE '' END AS edges, CASE WHEN line = 5 THEN inst END AS path_from, CASE WHEN line = 5 THEN 'ck_' || name END AS path_to, CASE WHEN line = 8 THEN name END AS path_through, CASE WHEN line = 5 THEN 'true' WHEN line = 8 THEN 'false' ELSE '' END AS setup, CAST(CASE WHEN line = 5 THEN 2 ELSE 0 END AS INTEGER) AS multiplier FROM sdc2""")
def k_parsed(spark, sf_dir):
    """The arguments of their commands."""
    p = constraints.parse_commands(constraints.scan(_sdc(spark, sf_dir))).fillna(0, ["divide_by", "multiplier"])
    p = p.withColumn("edges", F.concat_ws(" ", *[F.col(c).cast("string") for c in ("rise", "fall", "add_delay")]))
    p = p.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("setup", "add")})
    return p.select("constraint_id", "constraint_type", "targets", "period", "clock_name", "clock_port", "source_clock", "divide_by", "clock", "delay_max", "delay", "waveform", "add", "duty_cycle", "master_clock", "edges", "path_from", "path_to", "path_through", "setup", "multiplier")


_WORDS = r"regexp_extract_all(raw_line, '[^\s]+')"


@query(rf"""WITH l AS (SELECT DISTINCT constraint_id, raw_line FROM sdc_constraints WHERE raw_line IS NOT NULL)
SELECT constraint_id, CASE WHEN (length(raw_line) - length(replace(raw_line, '''', ''))) % 2 = 0 THEN list_transform({_WORDS}, lambda w: replace(w, '''', '')) ELSE {_WORDS} END AS words,
TRY_CAST(list_filter({_WORDS}, lambda w: regexp_full_match(w, '-?\d+(\.\d+)?([eE][+-]?\d+)?'))[1] AS DOUBLE) AS first_number FROM l WHERE NOT regexp_matches(raw_line, '["\\#]') AND NOT regexp_matches(raw_line, '''[^'']*\s[^'']*''')""")
def k_words(spark, sf_dir):
    """The words of the tables' own command lines as a shell reads them (quoted blanks, for which SQL has no rule, left to the tests), and their first number."""
    rows = load(spark, sf_dir, "sdc_constraints").where("raw_line is not null").select("constraint_id", "raw_line").distinct()
    rows = rows.where(~F.col("raw_line").rlike(r'["\\#]') & ~F.col("raw_line").rlike(r"'[^']*\s[^']*'"))
    return rows.select("constraint_id", S.shell_words(F.col("raw_line")).alias("words"), S.first_number(F.col("raw_line")).alias("first_number"))


@query(f"""WITH {_M}, {_C} SELECT design, 'ck_' || name AS name, CAST(coalesce(b, 9) % 50 + 1 AS DOUBLE) AS period, round(1000 / CAST(coalesce(b, 9) % 50 + 1 AS DOUBLE), 6) AS frequency_mhz, 'clk_' || name AS port, CAST(NULL AS VARCHAR) AS source, 0 AS divide_by, false AS generated FROM m
UNION ALL SELECT design, 'gen_' || name, NULL, NULL, 'u_div/q', 'ck_' || name, 4, true FROM m""")
def k_clock_table(spark, sf_dir):
    """Clocks; the source of a generated one is the clock on its port."""
    t = constraints.clock_table(constraints.parse_commands(constraints.scan(_sdc(spark, sf_dir))))
    return t.fillna(0, ["divide_by"]).select("design", "name", "period", F.round("frequency_mhz", 6).alias("frequency_mhz"), "port", "source", "divide_by", "generated")


def _rtl(spark, sf_dir) -> DataFrame:
    """(design, module, file_path, text): a source for every module, and a testbench for every top module."""
    m = scratch.table(_modules(spark, sf_dir), "m")
    key = m.select(F.col("module_id").alias("child"), F.col("name").alias("child_name"))
    child = _cells(spark, sf_dir, m).join(key, "child").groupBy(F.col("parent_module").alias("module_id")).agg(F.min("child_name").alias("child"))
    n = F.col("name")
    first = F.coalesce("a", F.lit(3)).cast("string")
    place = F.when(F.col("child").isNotNull(), F.concat(F.lit("  "), "child", F.lit(" #(.W(2)) u_"), "child", F.lit(" (.clk_core(clk_core), .d_out(w));\n"))).otherwise(F.lit(""))
    text = F.concat(
        F.lit("module "), n, F.lit(" #(parameter DEPTH = "), F.coalesce("b", F.lit(9)).cast("string"), F.lit(") (input clk_core, input [7:0] d_in, output [3:0] d_out);\n  always @(posedge clk_core or negedge rst_n) if (!rst_n) x <= 0;\n  a_"), n,
        F.lit(": assert property (@(posedge clk_core) disable iff (!rst_n)\n    (x == "), first, F.lit(') |-> d_out) else $error("bad '), n, F.lit('");\n  assume property (@(posedge clk_core) x);\n'), place, F.lit("endmodule\n"),
    )
    rtl = m.join(child, "module_id", "left").select("design", n.alias("module"), F.concat("design", F.lit("/rtl/"), n, F.lit(".v")).alias("file_path"), text.alias("text"))
    bench = F.concat(F.lit("module tb_"), n, F.lit(";\n  "), n, F.lit(" #(.W(1)) dut (.clk(clk));\n  initial begin $finish; end\nendmodule\n"))
    return rtl.unionByName(m.where("top").select("design", F.concat(F.lit("tb_"), n).alias("module"), F.concat("design", F.lit("/tb/tb_"), n, F.lit(".v")).alias("file_path"), bench.alias("text")))


_A = """ch AS (SELECT i.parent_module AS module_id, min(c.name) AS child FROM i JOIN m c ON c.module_id = i.child GROUP BY 1),
src AS (SELECT m.*, ch.child, coalesce(a, 3) AS x, coalesce(b, 9) AS d, design || '/rtl/' || name || '.v' AS file_path FROM m LEFT JOIN ch ON ch.module_id = m.module_id),
sva0 AS (SELECT *, 3 AS line, 4 AS last, 'a_' || name AS label, 'assert' AS kind, 'a_' || name || ': assert property (@(posedge clk_core) disable iff (!rst_n) (x == ' || x || ') |-> d_out) else $error("bad ' || name || '");' AS body, '!rst_n' AS off, 'bad ' || name AS message FROM src
  UNION ALL SELECT *, 5, 5, NULL, 'assume', 'assume property (@(posedge clk_core) x);', NULL, NULL FROM src),
sva AS (SELECT *, design || '::sva::' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS assertion_id FROM (SELECT *, row_number() OVER (PARTITION BY design ORDER BY file_path, line) AS n FROM sva0))"""


@query(f"WITH {_M}, {_A} SELECT assertion_id, file_path, CAST(line AS INTEGER) AS line_number, CAST(last AS INTEGER) AS end_line, label AS name, kind AS assertion_type, body AS property_text, 'clk_core' AS clock_signal, off AS disable_condition, message AS error_message, name AS containing_module, design FROM sva")
def a_assertions(spark, sf_dir):
    """The concurrent assertions of all sources, with the module around them."""
    return assertions.assertions(_rtl(spark, sf_dir).select("design", "file_path", "text")).drop("property_type")


@query(f"WITH {_M}, {_A} SELECT file_path, name AS module, 1 AS first_line, CASE WHEN child IS NULL THEN 6 ELSE 7 END AS last_line FROM src UNION ALL SELECT design || '/tb/tb_' || name || '.v', 'tb_' || name, 1, 4 FROM m WHERE top")
def a_regions(spark, sf_dir):
    """Where each module begins and ends."""
    return assertions.regions(_rtl(spark, sf_dir))


@query(f"WITH {_M} SELECT design || '::test::tb_' || name AS test_id, 'tb_' || name AS name, design || '/tb/tb_' || name || '.v' AS file_path, [name] AS modules_instantiated, design FROM m WHERE top")
def a_tests(spark, sf_dir):
    """Testbenches and the modules that they place."""
    known = _modules(spark, sf_dir).select("design", "name")
    return assertions.testbenches(_rtl(spark, sf_dir).select("design", "file_path", "text"), None, known)


def _log(spark, sf_dir) -> DataFrame:
    rows = load(spark, sf_dir, "commits").where("sha is not null and design is not null")
    return rows.select("design", "sha", "author", "author_email", "commit_date", "message", "files_changed", "insertions", "deletions").distinct()


_L = r"""log AS (SELECT DISTINCT design, sha, message, files_changed, design || '::commit::' || substr(sha, 1, 8) AS commit_id FROM commits WHERE sha IS NOT NULL AND design IS NOT NULL),
lm AS (SELECT DISTINCT commit_id, design, regexp_extract(f, '([^/]+)\.(v|sv|vh|svh|vhd|vhdl)$', 1) AS module FROM (SELECT commit_id, design, unnest(files_changed) AS f FROM log) WHERE regexp_matches(f, '[^/]+\.(v|sv|vh|svh|vhd|vhdl)$'))"""


@query(f"WITH {_L}, s AS (SELECT commit_id, list_sort(list(module)) AS modules FROM lm GROUP BY 1) SELECT l.commit_id, substr(sha, 1, 8) AS short_sha, string_split(message, chr(10))[1] AS summary, coalesce(s.modules, []) AS modules_modified FROM log l LEFT JOIN s ON s.commit_id = l.commit_id")
def l_commits(spark, sf_dir):
    """Commits of a log with their ids, summaries and modules."""
    named = F.coalesce("modules_modified", F.array().cast("array<string>"))
    return commits.describe(_log(spark, sf_dir)).select("commit_id", "short_sha", "summary", named.alias("modules_modified"))


@query("SELECT DISTINCT src_file AS file, module_name AS module FROM modules WHERE src_file IS NOT NULL")
def l_module_files(spark, sf_dir):
    """The module of every source file."""
    return commits.module_file_map(load(spark, sf_dir, "modules"))


def _whole(spark, sf_dir):
    files = scratch.table(_rtl(spark, sf_dir).select("design", "file_path", "text"), "rtl")
    return build_design(spark, Design(None, _netlists(spark, sf_dir), _sdc(spark, sf_dir), files, _log(spark, sf_dir), compat=False))


# what constraints, assertions, tests and commits add to the netlists' nodes ``n1``
_ADDED = """n1 AS (SELECT id, arg_max(type, seq) AS type, arg_max(name, seq) AS name, arg_max(design, seq) AS design FROM n0 GROUP BY id),
tg AS (SELECT DISTINCT constraint_id, design, unnest(CASE line WHEN 2 THEN ['clk_' || name] WHEN 3 THEN ['tx_data', 'rx[' || (coalesce(a, 3) % 4) || ']'] WHEN 5 THEN [inst, 'ck_' || name] WHEN 7 THEN ['clk_' || name, 'u_div/q'] ELSE [name] END) AS t FROM sdc2),
mo AS (SELECT l.commit_id, n1.id FROM lm l JOIN n1 ON n1.type = 'Module' AND n1.design = l.design AND n1.name = l.module),
e1 AS (SELECT * FROM e0
  UNION ALL SELECT 10, design || '::clk::gen_' || name, design || '::clk::ck_' || name, 'derived_from' FROM m
  UNION ALL SELECT 11, constraint_id, design || '::clk::ck_' || name, 'references_clock' FROM sdc2 WHERE line = 3
  UNION ALL SELECT 11, constraint_id, design || '::clk::gen_' || name, 'references_clock' FROM sdc2 WHERE line = 7
  UNION ALL SELECT 12, constraint_id, n1.id, 'applies_to' FROM tg JOIN n1 ON n1.design = tg.design AND n1.name = tg.t AND n1.type IN ('Port', 'Module')
  UNION ALL SELECT 12, constraint_id, n1.id, 'applies_to' FROM tg JOIN n1 ON n1.design = tg.design AND n1.name = split_part(tg.t, '/', 1) AND n1.type = 'Instance'
  UNION ALL SELECT 12, constraint_id, design || '::clk::ck_' || name, 'applies_to' FROM sdc2 WHERE line = 5
  UNION ALL SELECT 13, n1.id, constraint_id, 'constrained_by' FROM tg JOIN n1 ON n1.design = tg.design AND n1.name = tg.t AND n1.type = 'Port'
  UNION ALL SELECT 14, assertion_id, n1.id, 'verifies' FROM sva JOIN n1 ON n1.type = 'Module' AND n1.design = sva.design AND n1.name = sva.name
  UNION ALL SELECT 15, n1.id, assertion_id, 'verified_by' FROM sva JOIN n1 ON n1.type = 'Module' AND n1.design = sva.design AND n1.name = sva.name
  UNION ALL SELECT 16, assertion_id, sva.design || '::clk::clk_core', 'uses_clock' FROM sva WHERE sva.design || '::clk::clk_core' IN (SELECT id FROM n1 WHERE type = 'Clock')
  UNION ALL SELECT 17, design || '::test::tb_' || name, module_id, 'covers' FROM m WHERE top
  UNION ALL SELECT 18, commit_id, id, 'modifies' FROM mo UNION ALL SELECT 19, id, commit_id, 'modified_by' FROM mo),
e2 AS (SELECT src, dst, arg_max(relation, seq) AS relation FROM e1 GROUP BY 1, 2)"""
_WHOLE = f"{_M}, {_C}, {_A}, {_L}, {_NODES}, {_EDGES}, {_ADDED}"


@query(f"WITH {_WHOLE} SELECT src, dst, relation FROM e2")
def b_edges(spark, sf_dir):
    """All edges of the graph built from netlists, constraints, sources and commits."""
    return _whole(spark, sf_dir).edges.select("src", "dst", "relation")


@query(f"""WITH {_WHOLE}, all_nodes AS (SELECT id, type FROM n1 UNION SELECT design || '::clk::ck_' || name, 'Clock' FROM m UNION SELECT design || '::clk::gen_' || name, 'Clock' FROM m UNION SELECT constraint_id, 'Constraint' FROM sdc2
  UNION SELECT assertion_id, 'Assertion' FROM sva UNION SELECT design || '::test::tb_' || name, 'Test' FROM m WHERE top UNION SELECT commit_id, 'Commit' FROM log)
SELECT id, type FROM all_nodes""")
def b_nodes(spark, sf_dir):
    """All its nodes."""
    return _whole(spark, sf_dir).nodes.select("id", "type")


@query(f"""WITH {_WHOLE} SELECT m.module_id AS id, count(e.dst) FILTER (e.relation = 'instantiates') AS n_instantiates, count(e.dst) FILTER (e.relation = 'has_port') AS n_has_port, count(e.dst) FILTER (e.relation = 'contains_register') AS n_contains_register,
count(e.dst) FILTER (e.relation = 'verified_by') AS n_verified_by, count(e.dst) FILTER (e.relation = 'constrained_by') AS n_constrained_by FROM m LEFT JOIN e2 e ON e.src = m.module_id GROUP BY 1""")
def b_degrees(spark, sf_dir):
    """Outgoing edges of its modules by relation."""
    return G.degrees(_whole(spark, sf_dir))


@query(f"""WITH {_WHOLE}, t AS (SELECT module_id AS module, module_id AS target FROM m UNION ALL SELECT src, dst FROM e2 WHERE relation = 'has_port'),
k AS (SELECT constraint_id, split_part(raw_line, ' ', 1) AS constraint_type FROM sdc2)
SELECT m.design, t.module, k.constraint_type, count(*) AS n FROM t JOIN e2 e ON e.dst = t.target AND e.relation = 'applies_to' JOIN k ON k.constraint_id = e.src JOIN m ON m.module_id = t.module GROUP BY 1, 2, 3""")
def k_per_module(spark, sf_dir):
    """Constraints of each module and its ports by type."""
    return constraints.counts_per_module(_whole(spark, sf_dir))


@query(f"""WITH {_WHOLE}, mods AS (SELECT module_id AS owner, name AS module, design, top FROM m), own AS (SELECT src AS owner, dst AS part, relation FROM e2 WHERE relation IN ('has_port', 'contains_register') AND src IN (SELECT module_id FROM m)),
port AS (SELECT id FROM n1 WHERE type = 'Port'), po AS (SELECT owner, part FROM own WHERE part IN (SELECT id FROM port)),
home AS (SELECT module_id AS target, module_id AS owner FROM m UNION SELECT part, owner FROM po UNION SELECT e.dst, min(o.owner) FROM e2 e JOIN own o ON o.part = e.src WHERE e.relation = 'clocked_by' GROUP BY 1),
cand AS (SELECT e.src AS c, 1 AS rank, e.dst AS target, h.owner FROM e2 e JOIN home h ON h.target = e.dst WHERE e.relation = 'applies_to' UNION ALL SELECT e.dst, 2, e.src, po.owner FROM e2 e JOIN po ON po.part = e.src WHERE e.relation = 'constrained_by'),
best AS (SELECT c, arg_min(owner, (rank, target, owner)) AS owner FROM cand GROUP BY 1), usual AS (SELECT design, arg_min(module, (NOT top, owner, module)) AS module FROM mods GROUP BY 1)
SELECT s.constraint_id, coalesce(mods.module, usual.module, 'unknown') AS module FROM sdc2 s LEFT JOIN best ON best.c = s.constraint_id LEFT JOIN mods ON mods.owner = best.owner LEFT JOIN usual ON usual.design = s.design""")
def k_attributed(spark, sf_dir):
    """The module that each constraint belongs to."""
    return changes.constraint_modules(_whole(spark, sf_dir))


@query(f"""WITH {_WHOLE}, r AS (SELECT src AS module, dst AS reg FROM e2 WHERE relation = 'contains_register'), q AS (
  SELECT DISTINCT 'clocks' AS kind, r.module, e.dst AS id FROM r JOIN e2 e ON e.src = r.reg AND e.relation = 'clocked_by'
  UNION SELECT 'constraints', p.src, e.src FROM e2 p JOIN e2 e ON e.dst = p.dst AND e.relation = 'applies_to' WHERE p.relation = 'has_port'
  UNION SELECT 'assertions', src, dst FROM e2 WHERE relation = 'verified_by'),
nm AS (SELECT id, name FROM n1 UNION SELECT constraint_id, split_part(raw_line, ' ', 1) FROM sdc2 UNION SELECT assertion_id, coalesce(label, assertion_id) FROM sva)
SELECT m.design, q.module, q.kind, CASE kind WHEN 'clocks' THEN 'What clocks drive registers in module ' WHEN 'constraints' THEN 'What constraints apply to module ' ELSE 'What assertions verify module ' END || m.name || '?' AS question_text, list_sort(list(DISTINCT nm.name)) AS gold
FROM q JOIN m ON m.module_id = q.module JOIN nm ON nm.id = q.id GROUP BY 1, 2, 3, 4""")
def q_cross(spark, sf_dir):
    """Questions about clocks, constraints and assertions of every module, with their answers."""
    return Q.cross_questions(_whole(spark, sf_dir))


def _sources(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    m = _modules(spark, sf_dir)
    modules = m.select("design", "name", F.col("top").alias("is_top"), F.array(F.lit("d_out")).alias("outputs"))
    return scratch.table(_rtl(spark, sf_dir).where("file_path like '%/rtl/%'"), "rtl"), modules


_D = """place AS (SELECT *, '  ' || child || ' #(.W(2)) u_' || child || ' (.clk_core(clk_core), .d_out(w));' AS whole FROM src WHERE child IS NOT NULL),
chg0 AS (SELECT design, name AS module, 'parameter' AS change_type, 'double' AS variant, 'parameter DEPTH = ' || d AS old_text, 'parameter DEPTH = ' || d * 2 AS new_text FROM src WHERE d >= 2
  UNION ALL SELECT design, name, 'parameter', 'halve', 'parameter DEPTH = ' || d, 'parameter DEPTH = ' || d // 2 FROM src WHERE d >= 4 UNION ALL SELECT design, name, 'parameter', 'boundary', 'parameter DEPTH = ' || d, 'parameter DEPTH = 1' FROM src WHERE d > 1
  UNION ALL SELECT design, name, 'width', k.v, k.o, k.n FROM src, (VALUES ('double', 'input [7:0] d_in', 'input [15:0] d_in'), ('halve', 'input [7:0] d_in', 'input [3:0] d_in'), ('double', 'output [3:0] d_out', 'output [7:0] d_out'), ('halve', 'output [3:0] d_out', 'output [1:0] d_out')) k(v, o, n)
  UNION ALL SELECT design, name, 'clock', 'edge_swap', 'posedge clk_core', 'negedge clk_core' FROM src UNION ALL SELECT design, name, 'clock', 'rename', 'clk_core', 'clk_alt' FROM src WHERE NOT top
  UNION ALL SELECT design, name, 'reset', 'polarity', 'negedge rst_n', 'posedge rst_n' FROM src
  UNION ALL SELECT design, name, 'dependency', 'remove', whole, '// ' || whole FROM place UNION ALL SELECT design, name, 'hierarchy', 'stub', whole, '// stub of u_' || child || chr(10) || 'assign w = 0;' FROM place)"""


@query(f"WITH {_M}, {_A}, {_D} SELECT * FROM chg0")
def d_changes(spark, sf_dir):
    """Every change of every source: parameters, widths, clocks, resets, dependencies and hierarchies."""
    return changes.generate(*_sources(spark, sf_dir), 1 << 30).select("design", "module", "change_type", "variant", "old_text", "new_text")


@query(f"""WITH {_M}, {_A}, {_D} SELECT design, change_type, count(*) AS n, count(DISTINCT change_type || variant) AS variants FROM (SELECT *, row_number() OVER (PARTITION BY design, change_type ORDER BY 1) AS k FROM chg0) WHERE k <= 3 GROUP BY 1, 2
UNION ALL SELECT 'at most', '', max(n), 0 FROM (SELECT least(3, count(*)) AS n FROM chg0 GROUP BY design, change_type)""".replace(", count(DISTINCT change_type || variant) AS variants", ", 0 AS variants"))
def d_limited(spark, sf_dir):
    """How many changes of a kind a limit of three keeps in each design."""
    made = changes.generate(*_sources(spark, sf_dir), 3)
    per = made.groupBy("design", "change_type").agg(F.count("*").alias("n"))
    top = per.agg(F.max("n").alias("n")).select(F.lit("at most").alias("design"), F.lit("").alias("change_type"), "n")
    return per.unionByName(top).withColumn("variants", F.lit(0))


@query(f"""WITH {_M}, {_A}, {_D}, t AS (SELECT c.*, s.name AS owner, 'module ' || s.name || ' #(parameter DEPTH = ' || d || ') (input clk_core, input [7:0] d_in, output [3:0] d_out);' AS head FROM chg0 c JOIN src s ON s.design = c.design AND s.name = c.module WHERE c.change_type IN ('parameter', 'width'))
SELECT design, module, variant, old_text, replace(head, old_text, new_text) AS first_line FROM t""")
def d_patched(spark, sf_dir):
    """The first line of each source after each change of a parameter or width."""
    rtl, modules = _sources(spark, sf_dir)
    made = scratch.table(changes.generate(rtl, modules, 1 << 30).where("change_type in ('parameter', 'width')"), "changes")
    done = changes.apply_changes(made, rtl)
    return done.join(made.select("change_id", "design", "module", "variant", "old_text"), "change_id").select("design", "module", "variant", "old_text", F.split("patched", "\n")[0].alias("first_line"))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {_TRUTH}, {_M}, {_A}, {_D}, sized AS (SELECT run, count(DISTINCT node) AS n FROM truth GROUP BY 1)
SELECT c.change_type, count(*) AS n, round(avg(coalesce(s.n, 0)), 6) AS mean_truth FROM chg0 c LEFT JOIN sized s ON s.run = c.design || '::' || c.module || '/' || c.change_type GROUP BY 1""")
def d_summary(spark, sf_dir):
    """Changes of each kind and how much they truly affect on average."""
    made = scratch.table(changes.generate(*_sources(spark, sf_dir), 1 << 30), "changes")
    node = F.concat_ws("::", "design", "module")
    runs = made.select(F.concat_ws("/", node, "change_type").alias("run"), node.alias("node"), "change_type").distinct()  # the truth of a module's changes of one kind is the same
    sizes = T.truth_sizes(design_graph(spark, sf_dir), runs).withColumnRenamed("n", "n_truth")
    rows = made.select("change_type", F.concat_ws("/", node, "change_type").alias("run")).join(sizes, "run", "left").fillna(0, ["n_truth"])
    out = rows.groupBy("change_type").agg(F.count("*").alias("n"), F.avg("n_truth").alias("mean_truth"))
    return out.select("change_type", "n", F.round("mean_truth", 6).alias("mean_truth"))


@query(f"WITH {_M}, {_A}, {_D} SELECT design, change_type, old_text, new_text, [design || '::' || module] AS modules FROM chg0")
def d_saved(spark, sf_dir):
    """Changes written as JSON with what they affect, and read again."""
    made = scratch.table(changes.generate(*_sources(spark, sf_dir), 1 << 30), "changes")
    truth = made.select(F.col("change_id").alias("run"), F.concat_ws("::", "design", "module").alias("node"), F.lit("Module").alias("artifact_type"), F.lit(1).alias("hop"))
    again = changes.from_json(changes.to_json(made, truth))
    patch = F.col("patches")[0]
    return again.join(made.select("change_id", "design"), "change_id").select("design", "change_type", patch.old_text.alias("old_text"), F.coalesce(patch.new_text, F.lit("")).alias("new_text"), F.col("ground_truth_by_type")["Module"].alias("modules"))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {_walk("'instantiates', 'has_port', 'has_instance', 'depended_by'", 2, "true")},
r AS (SELECT run, node, n.type AS artifact_type, hop FROM reach JOIN nodes n ON n.id = reach.node WHERE hop > 0)
SELECT run, 'type ' || artifact_type AS what, count(*) AS n FROM r GROUP BY 1, 2 UNION ALL SELECT run, 'hop 1', count(*) FROM r WHERE hop = 1 GROUP BY 1 UNION ALL SELECT run, 'top ' || node, rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY hop, node) AS rank FROM r) WHERE rank <= 3
UNION ALL SELECT run, 'ids of ports', count(DISTINCT node) FROM r WHERE artifact_type = 'Port' GROUP BY 1""")
def r_accessors(spark, sf_dir):
    """Of the impact of each module: artifacts by type and at a hop, the three of highest risk, ids of a type."""
    g = design_graph(spark, sf_dir)
    edges = g.edges.where("relation in ('instantiates', 'has_port', 'has_instance', 'depended_by')")
    result = scratch.table(T.bfs(G.Graph(g.nodes, edges), every_module(g), max_depth=2, paths=False), "result")
    one = lambda df, what: df.groupBy("run").agg(F.count("*").alias("n")).select("run", F.lit(what).alias("what"), "n")
    types = results.counts_by_type(result).select("run", F.concat(F.lit("type "), "artifact_type").alias("what"), "n")
    top = results.top_k(result, 3).select("run", F.concat(F.lit("top "), "node").alias("what"), F.col("rank").cast("bigint").alias("n"))
    return types.unionByName(one(results.at_hop(result, 1), "hop 1")).unionByName(top).unionByName(one(results.artifact_ids(result, "Port"), "ids of ports"))


@query(f"""WITH RECURSIVE {GRAPH_SQL}, {_walk("", 3)}, want AS (SELECT s.run, e2.dst AS node FROM seeds s JOIN edges e ON e.src = s.node AND e.relation = 'has_instance' JOIN edges e2 ON e2.src = e.dst)
SELECT DISTINCT w.run, w.node, r.hop FROM want w JOIN reach r ON r.run = w.run AND r.node = w.node WHERE w.node <> w.run""")
def g_ranked_paths(spark, sf_dir):
    """The shortest distance of ranked nodes from their seed."""
    g = design_graph(spark, sf_dir)
    e = g.edges.select("src", "dst", "relation")
    two = every_module(g).join(e.where("relation = 'has_instance'").select(F.col("src").alias("node"), F.col("dst").alias("mid")), "node").join(e.select(F.col("src").alias("mid"), "dst"), "mid")
    ranked = two.select("run", F.col("dst").alias("node")).where("run <> node").distinct().withColumn("score", F.lit(0.5))
    return T.ranked_with_paths(g, every_module(g), ranked, depth=3).select("run", "node", "hop")


@query("""WITH q AS (SELECT question_id, min(question) AS question, min(answer) AS gold, min(design) AS category FROM qa_results WHERE question_id IS NOT NULL AND question IS NOT NULL AND answer IS NOT NULL GROUP BY 1),
r AS (SELECT DISTINCT qa_id, question_id, method_name, answer FROM qa_results),
j AS (SELECT r.*, q.gold, q.category, CASE WHEN length(q.question) > 40 THEN 'hard' ELSE 'easy' END AS difficulty, list_distinct(regexp_extract_all(lower(coalesce(r.answer, '')), '[a-z0-9_]+')) AS a, list_distinct(regexp_extract_all(lower(q.gold), '[a-z0-9_]+')) AS g,
  list_filter(regexp_extract_all(lower(q.gold), '[a-z_][a-z0-9_]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'for', 'are', 'has', 'with', 'that', 'this', 'from', 'not', 'have', 'module', 'modules')) AS ents FROM r JOIN q ON q.question_id = r.question_id),
s AS (SELECT *, len(list_intersect(a, g)) AS c, CASE WHEN len(ents) > 0 THEN len(list_filter(ents, lambda e: contains(lower(coalesce(answer, '')), e))) / len(ents) ELSE 0 END AS er FROM j),
v AS (SELECT *, CASE WHEN c > 0 THEN 2.0 * c / (len(a) + len(g)) ELSE 0 END AS f1 FROM s)
SELECT 'all' AS axis, '' AS label, count(*) AS n, round(avg(f1), 6) AS token_f1, round(avg(er), 6) AS entity_recall FROM v UNION ALL SELECT 'method', method_name, count(*), round(avg(f1), 6), round(avg(er), 6) FROM v GROUP BY 2
UNION ALL SELECT 'category', category, count(*), round(avg(f1), 6), round(avg(er), 6) FROM v GROUP BY 2 UNION ALL SELECT 'difficulty', difficulty, count(*), round(avg(f1), 6), round(avg(er), 6) FROM v GROUP BY 2""")
def m_evaluated(spark, sf_dir):
    """Answers joined with their questions: means over all, by method, category and difficulty."""
    from netquarry.operators import metrics

    rows = load(spark, sf_dir, "qa_results")
    asked = rows.where("question_id is not null and question is not null and answer is not null").groupBy("question_id").agg(F.min("question").alias("question"), F.min("answer").alias("gold"), F.min("design").alias("category"))
    asked = asked.withColumn("difficulty", F.when(F.length("question") > 40, "hard").otherwise("easy")).withColumn("evidence", F.array().cast("array<string>"))
    given = rows.select("qa_id", "question_id", F.col("method_name").alias("method"), "answer").distinct().withColumn("retrieved", F.array().cast("array<string>"))
    out = metrics.answer_summary(results.evaluate(asked, given), ["method", "category", "difficulty"])
    return out.select("axis", "label", "n", F.round("token_f1", 6).alias("token_f1"), F.round("entity_recall", 6).alias("entity_recall"))


@query(f"""WITH {GRAPH_SQL}, asked AS (SELECT DISTINCT 'What ports does module ' || name || ' have?' AS question, lower(name) AS q FROM nodes WHERE type = 'Module' AND name IS NOT NULL),
keys AS (SELECT DISTINCT id, unnest([lower(name), lower(string_split(id, '::')[-1])]) AS key FROM nodes), home AS (SELECT a.question, min(k.id) AS node FROM asked a JOIN keys k ON k.key = a.q GROUP BY 1),
near AS (SELECT question, node, 0 AS hop FROM home UNION SELECT h.question, n.id, 1 FROM home h JOIN (SELECT src, dst FROM edges WHERE relation = 'has_port' UNION SELECT dst, src FROM edges WHERE relation = 'has_port') e ON e.src = h.node JOIN nodes n ON n.id = e.dst AND n.type = 'Port'),
lim AS (SELECT question, node FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY hop, node) AS k FROM near) WHERE k <= 100),
per AS (SELECT l.question, n.type, count(*) AS n, list(n.name ORDER BY n.name, n.id) AS names FROM lim l JOIN nodes n ON n.id = l.node GROUP BY 1, 2)
SELECT question, string_agg(n || ' ' || type || ': ' || array_to_string(names[1:20], ', ') || CASE WHEN n > 20 THEN ' and ' || (n - 20) || ' more' ELSE '' END, '; ' ORDER BY type) AS answer FROM per GROUP BY 1""")
def q_answers(spark, sf_dir):
    """The answers of rules and graph alone to a question about each module's ports."""
    g = design_graph(spark, sf_dir)
    asked = g.nodes.where("type = 'Module' and name is not null").select(F.concat(F.lit("What ports does module "), "name", F.lit(" have?")).alias("question")).distinct()
    return answering.answers(g, asked, ("graph_only",)).select("question", "answer")


@query("""WITH q AS (SELECT DISTINCT question FROM qa_results WHERE question IS NOT NULL), s AS (SELECT question, length(question) % 4 AS k FROM q)
SELECT question, CASE k WHEN 0 THEN 'structural' WHEN 1 THEN 'unknown' WHEN 2 THEN 'unknown' ELSE 'what_if' END AS category, CASE k WHEN 0 THEN 'chain' WHEN 3 THEN 'path' ELSE 'module_context' END AS operation, CASE k WHEN 0 THEN ['a', 'b'] ELSE [] END AS seed_entities,
CASE k WHEN 1 THEN 'no JSON' WHEN 2 THEN 'broken JSON' END AS problem FROM s""")
def q_from_model(spark, sf_dir):
    """Queries read from a model's responses: sound, without JSON, broken and nested."""
    asked = load(spark, sf_dir, "qa_results").select("question").where("question is not null").distinct()
    kinds = ('Here it is: {"category": "structural", "seed_entities": ["a", "b"], "operation": "chain", "params": {"hops": "2"}} as asked', "I do not know.", '{"category": "structural", ', '{"category": "what_if", "operation": "path", "params": {}}')
    said = F.array(*map(F.lit, kinds))
    rows = asked.withColumn("response", F.when(F.length("question") % 4 == 2, F.lit('{"category": "structural", }}')).otherwise(F.get(said, F.length("question") % 4)))
    return answering.parse_model_queries(rows).select("question", "category", "operation", "seed_entities", "problem")
