"""Netlist JSON to tables and graph batches.

A netlist maps module names to ports, nets, parameters and cells; bits are
numbers or constant strings, so they are read as strings.  Everything after the
scan is joins and aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry import scratch
from netquarry.functions import scalars as S

SCHEMA = """modules map<string, struct<
  attributes: map<string,string>, parameter_default_values: map<string,string>,
  ports: map<string, struct<direction: string, bits: array<string>>>,
  netnames: map<string, struct<bits: array<string>, attributes: map<string,string>>>,
  cells: map<string, struct<type: string, attributes: map<string,string>, parameters: map<string,string>,
                            connections: map<string,array<string>>, port_directions: map<string,string>>>>>"""


def read(spark: SparkSession, path: str, design: str) -> dict[str, DataFrame]:
    """The tables of netlist files: modules, parameters, ports, nets, registers, instances, wires, clocks."""
    texts = spark.read.text(path, wholetext=True).select("value")
    return tables(texts, design)


def tables(texts: DataFrame, design: str | None = None) -> dict[str, DataFrame]:
    """As ``read``, for JSON texts in a column ``value``, of one design or of those in a column ``design``.

    The texts are parsed once, whatever number of tables is made of them.
    """
    texts = texts.withColumn("design", F.lit(design)) if design is not None else texts
    parsed = texts.select("design", F.from_json("value", SCHEMA).alias("n")).select("design", F.explode("n.modules").alias("key", "m"))
    base = parsed.withColumn("module_name", S.design_name(F.col("m.attributes")["hdlname"], F.col("key")))
    base = scratch.table(base.withColumn("module_id", F.concat_ws("::", "design", "module_name")), "netlist")
    at = S.source_place(F.col("m.attributes")["src"])
    modules = base.select("module_id", "module_name", F.col("key").alias("yosys_name"), at.file.alias("src_file"), at.first_line.alias("src_start_line"), at.last_line.alias("src_end_line"), (S.binary_value(F.col("m.attributes")["top"]) > 0).alias("is_top"), "design")
    whole = F.when(F.col("raw").rlike("^[01]+$"), S.binary_value(F.col("raw")).cast("string")).otherwise(F.col("raw"))
    parameters = base.select("design", "module_id", F.explode("m.parameter_default_values").alias("name", "raw")).select(F.concat_ws("::", "module_id", "name").alias("id"), "module_id", "name", whole.alias("value"), "design")
    ports = base.select("design", "module_id", F.explode("m.ports").alias("name", "p")).select(F.concat_ws("::", "module_id", "name").alias("id"), "module_id", "name", "p.direction", F.size("p.bits").alias("width"), S.looks_like_clock(F.col("name")).alias("is_clock"), "design")
    named = base.select("design", "module_id", F.posexplode(F.map_entries("m.netnames")).alias("pos", "e")).select("design", "module_id", "pos", F.col("e.key").alias("name"), F.col("e.value.bits").alias("bits"))
    nets = named.select(F.concat_ws("::", "module_id", "name").alias("id"), "module_id", "name", F.size("bits").alias("width"), "design")
    # a bit's name: the net that comes last; constants are no bits
    bits = named.select("module_id", "pos", "name", F.explode("bits").alias("bit")).where(F.col("bit").try_cast("int").isNotNull())
    bits = scratch.table(bits.groupBy("module_id", "bit").agg(F.max_by("name", "pos").alias("net")), "bits")
    cells = scratch.table(base.select("design", "module_id", F.explode("m.cells").alias("cell", "c")).select("design", "module_id", "cell", "c.*"), "cells")
    flops = cells.where(S.is_flip_flop(F.col("type")))

    def first_name(pin) -> DataFrame:
        pins = flops.select("module_id", "cell", F.posexplode(pin).alias("k", "bit"))
        return pins.join(bits, ["module_id", "bit"]).groupBy("module_id", "cell").agg(F.min_by("net", "k").alias("net"))

    q = first_name(F.col("connections")["Q"]).withColumnRenamed("net", "q_net")
    clk = first_name(F.coalesce(F.col("connections")["CLK"], F.col("connections")["C"])).withColumnRenamed("net", "clk_net")
    registers = flops.join(q, ["module_id", "cell"]).join(clk, ["module_id", "cell"], "left")
    reset = S.reset_kind(F.col("parameters"))
    registers = registers.select(F.concat("module_id", F.lit("::reg::"), "q_net").alias("id"), "module_id", F.col("q_net").alias("name"), "clk_net", S.clock_edge(F.col("parameters")).alias("clock_edge"), reset.kind.alias("reset_kind"), reset.active_low.alias("reset_active_low"), F.size(F.col("connections")["Q"]).alias("width"), "design")
    one = Window.partitionBy("id").orderBy("clk_net", "width")
    registers = scratch.table(registers.withColumn("k", F.row_number().over(one)).where("k = 1").drop("k"), "registers")
    known = base.select("design", F.col("key").alias("type"), F.col("module_id").alias("child_module"), F.col("module_name").alias("child_module_name"))
    placed = cells.join(known, ["design", "type"])
    place = S.source_place(F.col("attributes")["src"])
    instances = placed.select(F.concat("module_id", F.lit("::inst::"), "cell").alias("instance_id"), F.col("cell").alias("inst_name"), F.col("module_id").alias("parent_module"), "child_module", "child_module_name", "port_directions", place.file.alias("src_file"), place.first_line.alias("src_start_line"), "design")
    pins = placed.select("design", "module_id", "cell", "child_module", "port_directions", F.explode("connections").alias("port", "wired"))
    pins = pins.select("design", "module_id", "cell", "child_module", "port", F.col("port_directions")[F.col("port")].alias("direction"), F.explode("wired").alias("bit"))
    wires = pins.join(bits, ["module_id", "bit"]).select(F.col("module_id").alias("parent_module"), "cell", "child_module", "port", "direction", "net", "design").distinct()
    clocks = registers.where("clk_net is not null").groupBy(F.concat_ws("::", "design", F.lit("clk"), "clk_net").alias("id"), "design").agg(F.min("clk_net").alias("name"), F.array_sort(F.collect_set("id")).alias("driven_registers"), F.array_sort(F.collect_set("module_id")).alias("driven_modules"))
    made = {"modules": modules, "parameters": parameters, "ports": ports, "nets": nets, "instances": instances, "wires": wires, "clocks": clocks}
    return {"registers": registers} | made


def to_graph(t: dict[str, DataFrame]) -> tuple[list[DataFrame], list[DataFrame]]:
    """Node and edge batches in the order of writing: nets wired to a child replace the ports of the same name."""
    node = lambda df, id_, type_, name: df.select(F.col(id_).alias("id"), F.lit(type_).alias("type"), F.col(name).alias("name"), "design")
    edge = lambda df, src, dst, rel: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(rel).alias("relation"))
    clocked = t["registers"].where("clk_net is not null").withColumn("clock_id", F.concat_ws("::", "design", F.lit("clk"), "clk_net"))
    ports = t["ports"].select(F.col("id").alias("port_id"))
    wires = t["wires"].withColumn("port_id", F.concat_ws("::", "child_module", "port")).withColumn("net_id", F.concat_ws("::", "parent_module", "net"))
    wires = wires.where("direction in ('input', 'output')").join(ports, "port_id", "left_semi")
    nodes = [
        node(t["modules"], "module_id", "Module", "module_name").join(t["modules"].select(F.col("module_id").alias("id"), "is_top"), "id"),
        node(t["parameters"], "id", "Parameter", "name"), node(t["ports"], "id", "Port", "name"),
        node(t["registers"], "id", "Register", "name"), node(t["clocks"], "id", "Clock", "name"), node(t["instances"], "instance_id", "Instance", "inst_name"),
        node(wires.select("net_id", "net", "design").distinct(), "net_id", "Net", "net"),
    ]
    i = t["instances"]
    edges = [
        edge(t["parameters"], "module_id", "id", "has_parameter"), edge(t["parameters"], "id", "module_id", "parameter_of"), edge(t["ports"], "module_id", "id", "has_port"),
        edge(t["registers"], "module_id", "id", "contains_register"), edge(clocked, "id", "clock_id", "clocked_by"),
        edge(i, "parent_module", "child_module", "instantiates"), edge(i, "instance_id", "child_module", "instance_of"), edge(i, "parent_module", "instance_id", "has_instance"),
        edge(wires.where("direction = 'output'"), "port_id", "net_id", "drives").unionByName(edge(wires.where("direction = 'input'"), "net_id", "port_id", "drives")),
        edge(i, "child_module", "parent_module", "depended_by"),
    ]
    return nodes, edges
