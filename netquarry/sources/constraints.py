"""Timing-constraint texts: scan, command parsing, and linking to the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import scalars as S
from netquarry.operators.graph import Graph
from netquarry.operators.skew import ranked
from netquarry.sources.quoted_rows import COMMANDS


def scan(texts: DataFrame, design: str | None = None) -> DataFrame:
    """Commands of whole files: ``texts(file_path, text)`` to constraint rows, of one design or of those in a column ``design``.

    Continued lines are joined, comments and other commands left out;
    ``line_number`` is that of the joined text, ids run by file and line within a
    design.
    """
    texts = texts.withColumn("design", F.lit(design)) if design is not None else texts
    lines = texts.select("design", "file_path", F.posexplode(F.split(S.join_continuations(F.col("text")), r"\r?\n")).alias("pos", "line"))
    lines = lines.select("design", "file_path", (F.col("pos") + 1).alias("line_number"), S.strip_comment(F.col("line")).alias("raw_line"))
    rows = lines.where(S.command(F.col("raw_line")).isin(*COMMANDS))
    rows = ranked(rows, ["design"], [F.col("file_path"), F.col("line_number")], "n")
    digits = F.col("n").cast("string")
    number = F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0"))
    return rows.select(F.concat_ws("::", "design", F.lit("sdc"), number).alias("constraint_id"), "raw_line", "line_number", "file_path", "design")


def _pick(kind: Column, of: tuple[str, ...], value: Column) -> Column:
    return F.when(kind.isin(*of), value)


def parse_commands(rows: DataFrame, short_targets: bool = False) -> DataFrame:
    """The typed arguments of ``rows(raw_line, ...)``; a column is null where a command has no such argument.

    ``short_targets`` keeps the older reading of targets, in which a bus name ends
    at its index.
    """
    line, kind = F.col("raw_line"), S.command(F.col("raw_line"))
    delays = ("set_input_delay", "set_output_delay")
    targets = S.get_targets_short(line) if short_targets else S.get_targets(line)
    number = S.first_number(F.regexp_replace(line, r"\[[^\]]*\]", " "))
    period = S.flag(line, "period").try_cast("double")
    name = F.coalesce(S.flag(line, "name"), F.try_element_at(targets, F.lit(1)))
    bracket = lambda c: F.coalesce(F.try_element_at(S.get_targets(c), F.lit(1)), c)
    return rows.select(
        *rows.columns,
        kind.alias("constraint_type"),
        targets.alias("targets"),
        _pick(kind, ("create_clock",), period).alias("period"),
        _pick(kind, ("create_clock",), F.when(period != 0, 1000 / period)).alias("frequency_mhz"),
        _pick(kind, ("create_clock", "create_generated_clock"), name).alias("clock_name"),
        _pick(kind, ("create_clock", "create_generated_clock"), F.try_element_at(targets, F.lit(-1))).alias("clock_port"),
        _pick(kind, ("create_generated_clock",), bracket(S.flag(line, "source"))).alias("source_clock"),
        _pick(kind, ("create_generated_clock",), S.flag(line, "divide_by").try_cast("int")).alias("divide_by"),
        _pick(kind, ("create_generated_clock",), S.flag(line, "multiply_by").try_cast("int")).alias("multiply_by"),
        _pick(kind, ("create_clock",), F.trim(F.translate(S.flag(line, "waveform"), "{}", "  "))).alias("waveform"),
        _pick(kind, ("create_clock", "create_generated_clock"), S.has_flag(line, "add")).alias("add"),
        _pick(kind, ("create_generated_clock",), S.flag(line, "duty_cycle").try_cast("double")).alias("duty_cycle"),
        _pick(kind, ("create_generated_clock",), bracket(S.flag(line, "master_clock"))).alias("master_clock"),
        _pick(kind, delays, S.has_flag(line, "rise")).alias("rise"),
        _pick(kind, delays, S.has_flag(line, "fall")).alias("fall"),
        _pick(kind, delays, S.has_flag(line, "add_delay")).alias("add_delay"),
        _pick(kind, delays, bracket(S.flag(line, "clock"))).alias("clock"),
        _pick(kind, delays, S.flag(line, "max").try_cast("double")).alias("delay_max"),
        _pick(kind, delays, S.flag(line, "min").try_cast("double")).alias("delay_min"),
        _pick(kind, (*delays, "set_max_delay", "set_min_delay"), number).alias("delay"),
        bracket(S.flag(line, "from")).alias("path_from"),
        bracket(S.flag(line, "to")).alias("path_to"),
        bracket(S.flag(line, "through")).alias("path_through"),
        _pick(kind, ("set_false_path", "set_multicycle_path", "set_clock_uncertainty"), S.has_flag(line, "setup")).alias("setup"),
        _pick(kind, ("set_false_path", "set_multicycle_path", "set_clock_uncertainty"), S.has_flag(line, "hold")).alias("hold"),
        _pick(kind, ("set_multicycle_path",), number.cast("int")).alias("multiplier"),
        _pick(kind, ("set_clock_uncertainty",), number).alias("uncertainty"),
        _pick(kind, ("set_load",), number).alias("load"),
        _pick(kind, ("set_driving_cell",), S.flag(line, "lib_cell")).alias("lib_cell"),
        _pick(kind, ("set_driving_cell",), S.flag(line, "pin")).alias("pin"),
    )


def clock_table(parsed: DataFrame) -> DataFrame:
    """(name, period, frequency_mhz, port, source, divide_by, multiply_by, generated) of the clock commands.

    A generated clock's source that is the port of a primary clock becomes that clock's name.
    """
    if "design" not in parsed.columns:
        return clock_table(parsed.withColumn("design", F.lit(""))).drop("design")
    own = parsed.where(F.col("constraint_type").isin("create_clock", "create_generated_clock"))
    primary = own.where("constraint_type = 'create_clock'").select("design", F.col("clock_port").alias("source_clock"), F.col("clock_name").alias("primary_name")).where("source_clock is not null").groupBy("design", "source_clock").agg(F.min("primary_name").alias("primary_name"))
    out = own.join(primary, ["design", "source_clock"], "left")
    return out.select("design", F.col("clock_name").alias("name"), "period", "frequency_mhz", F.col("clock_port").alias("port"), F.coalesce("primary_name", "source_clock").alias("source"), "divide_by", "multiply_by", (F.col("constraint_type") == "create_generated_clock").alias("generated"))


def to_graph(parsed: DataFrame, nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Node and edge batches that the constraints of designs add to a graph with ``nodes(id, type, name, design)``.

    Targets name a port of any module, an instance (also as ``instance/pin``), a
    clock or a module of the constraint's design.
    """
    clock_id = lambda c: F.concat_ws("::", "design", F.lit("clk"), c)
    clocks = clock_table(parsed).where("name is not null").withColumn("id", clock_id("name"))
    node = lambda df, type_, **c: df.select("id", F.lit(type_).alias("type"), *[F.col(v).alias(k) for k, v in c.items()], "design")
    edge = lambda df, src, dst, rel: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(rel).alias("relation"))
    rows = parsed.withColumn("id", F.col("constraint_id"))
    node_batches = [node(clocks, "Clock", name="name"), node(rows, "Constraint", name="constraint_type", raw_line="raw_line")]
    derived = clocks.where("generated and source is not null").select("id", clock_id("source").alias("source_id"))
    referred = rows.select("id", "design", F.explode(F.array_distinct(F.array_compact(F.array("clock", "source_clock", F.when(F.col("constraint_type").isin("create_generated_clock"), F.col("clock_name")))))).alias("clock"))
    clock_ids = nodes.where("type = 'Clock'").select("id").unionByName(clocks.select("id")).distinct().withColumnRenamed("id", "clock_id")
    referred = referred.withColumn("clock_id", clock_id("clock")).join(clock_ids, "clock_id", "left_semi")
    target = rows.select("id", "design", F.explode("targets").alias("target")).distinct()
    ports = nodes.where("type = 'Port'").select("design", F.col("id").alias("dst"), F.col("name").alias("target"))
    on_port = target.join(ports, ["design", "target"])
    split = target.withColumn("inst", F.split("target", "/")[0]).withColumn("pin", F.when(F.contains("target", F.lit("/")), F.element_at(F.split("target", "/"), -1)))
    instances = nodes.where("type = 'Instance'").select("design", F.col("id").alias("dst"), F.col("name").alias("inst"))
    on_instance = split.join(instances, ["design", "inst"])
    on_clock = target.withColumn("clock_id", clock_id("target")).join(clock_ids, "clock_id", "left_semi")
    modules = nodes.where("type = 'Module'").select("design", F.col("id").alias("dst"), F.col("name").alias("target"))
    on_module = target.join(modules, ["design", "target"])
    applies = edge(on_port, "id", "dst", "applies_to").unionByName(edge(on_instance, "id", "dst", "applies_to")).unionByName(edge(on_clock, "id", "clock_id", "applies_to")).unionByName(edge(on_module, "id", "dst", "applies_to")).distinct()
    edge_batches = [edge(derived, "id", "source_id", "derived_from"), edge(referred, "id", "clock_id", "references_clock").distinct(), applies, edge(on_port, "dst", "id", "constrained_by").distinct()]
    return node_batches, edge_batches


def counts_per_module(graph: Graph) -> DataFrame:
    """(design, module, constraint_type, n): constraints that apply to each module or one of its ports, by type; one that applies to several ports counts for each."""
    modules = graph.nodes.where("type = 'Module'").select("design", F.col("id").alias("module"))
    ported = graph.edges.where("relation = 'has_port'").select(F.col("src").alias("module"), F.col("dst").alias("target"))
    targets = modules.select("module", F.col("module").alias("target")).unionByName(ported)
    applied = graph.edges.where("relation = 'applies_to'").select(F.col("src").alias("id"), F.col("dst").alias("target"))
    kinds = graph.nodes.where("type = 'Constraint'").select("id", F.col("name").alias("constraint_type"))
    return targets.join(applied, "target").join(kinds, "id").join(modules, "module").groupBy("design", "module", "constraint_type").agg(F.count("*").alias("n"))
