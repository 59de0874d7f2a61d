"""Sources of one design: netlist, constraints, assertions, commits; changes and streams."""

import json
import random
import shlex
import subprocess

import pytest
from pyspark.sql import functions as F

from netquarry.functions import scalars as S
from netquarry.operators import answering as W
from netquarry.operators import changes as C
from netquarry.operators import graph as G
from netquarry.operators import metrics as M
from netquarry.operators import questions as Q
from netquarry.operators import results as R
from netquarry.operators import traverse as T
from netquarry.plans import registry
from netquarry.plans.build import Design, build_design
from netquarry.sources import assertions as A
from netquarry.sources import commits as L
from netquarry.sources import constraints as K
from netquarry.streaming import ingest

# module: (parameters, ports as name:direction:width, registers)
UART = {
    "uart_top": ("CLK_FREQ BAUD_RATE DATA_BITS", "clk:input:1 rst_n:input:1 tx_data:input:8 tx_valid:input:1 tx_out:output:1 tx_busy:output:1 rx_in:input:1 rx_data:output:8 rx_valid:output:1 baud_div:input:16", ""),
    "uart_tx": ("DATA_BITS", "clk:input:1 rst_n:input:1 baud_tick:input:1 tx_data:input:8 tx_valid:input:1 tx_out:output:1 tx_busy:output:1", "bit_idx shift_reg state tx_busy tx_out"),
    "uart_rx": ("DATA_BITS", "clk:input:1 rst_n:input:1 baud_tick:input:1 rx_in:input:1 rx_data:output:8 rx_valid:output:1", "bit_idx rx_data rx_valid sample_cnt shift_reg state"),
    "baud_gen": ("CLK_FREQ BAUD_RATE", "clk:input:1 rst_n:input:1 baud_div:input:16 baud_tick:output:1", "baud_tick counter"),
}


def netlist():
    modules = {}
    for name, (parameters, ports, registers) in UART.items():
        bit, nets, port_rows = 2, {}, {}
        for p in ports.split():
            n, direction, width = p.split(":")
            nets[n] = list(range(bit, bit + int(width)))
            bit += int(width)
            port_rows[n] = {"direction": direction, "bits": nets[n]}
        for r in registers.split():
            if r not in nets:
                nets[r] = [bit]
                bit += 1
        cells = {f"$procdff${k}": {"type": "$adff", "parameters": {"ARST_POLARITY": "0", "CLK_POLARITY": "1"}, "connections": {"CLK": nets["clk"], "Q": nets[r], "ARST": nets["rst_n"], "D": ["x", "0"]}} for k, r in enumerate(registers.split())}
        if name == "uart_top":
            nets["baud_tick"] = [bit]
            for child in ("baud_gen", "uart_tx", "uart_rx"):
                pins = [p.split(":") for p in UART[child][1].split()]
                cells[f"u_{child}"] = {"type": child, "attributes": {"src": "uart_top.v:23.3-30.4"}, "connections": {p: nets[p] for p, _, _ in pins}, "port_directions": {p: d for p, d, _ in pins}}
        modules[name] = {"attributes": {"src": f"{name}.v:1.1-60.10", **({"top": "0" * 31 + "1"} if name == "uart_top" else {})}, "parameter_default_values": {p: "0101" for p in parameters.split()}, "ports": port_rows, "netnames": {n: {"bits": b} for n, b in nets.items()}, "cells": cells}
    return json.dumps({"modules": modules})


SDC = """# clocks
create_clock -period 20.0 -name clk_core [get_ports clk]
create_generated_clock -name clk_baud -source [get_ports clk] \\
    -divide_by 434 [get_pins u_baud_gen/baud_tick]
set_input_delay -clock clk_core -max 5.0 [get_ports {rx_in tx_data[*]}]
set_multicycle_path 2 -setup -from [get_cells u_uart_tx] -to [get_clocks clk_core]
set_max_delay 10.0 -from [get_ports baud_tick]  # comment
set_units -time ns
set_false_path -from [get_ports rst_n]
"""
SVA = """module checks;

  a_idle: assert property (@(posedge clk) disable iff (!rst_n)
    (state == 0) |-> tx_out) else $error("line low");
  assume property (@(posedge clk) a);
endmodule
module tb_top;
  uart_top #(.W(1)) dut (.clk(clk));
  initial begin $display("x"); $finish; end
endmodule
"""


def texts(spark, *rows):
    return spark.createDataFrame(rows, "file_path string, text string")


def log(spark):
    rows = [("a" * 40, "A", "a@x", "Initial commit: add UART", ["rtl/uart_top.v", "rtl/uart_tx.v", "x.sdc"], 10, 0), ("b" * 40, "B", "b@x", "Fix baud rate\n\nmore", ["rtl/uart_tx.v"], 1, 1), ("c" * 40, "A", "a@x", "Tighten timing", ["x.sdc"], 1, 1)]
    return spark.createDataFrame([(*r[:3], *r[3:]) for r in rows], "sha string, author string, author_email string, message string, files_changed array<string>, insertions int, deletions int").withColumn("commit_date", F.current_timestamp())


def counts(g):
    return {r[0]: r[1] for r in g.nodes.groupBy("type").count().collect()}, {r[0]: r[1] for r in g.edges.groupBy("relation").count().collect()}


def test_netlist_counts(spark):
    g = build_design(spark, Design("d", spark.createDataFrame([(netlist(),)], "value string")))
    nodes, edges = counts(g)
    assert nodes == {"Module": 4, "Parameter": 7, "Port": 17, "Net": 11, "Register": 13, "Instance": 3, "Clock": 1}
    assert edges == {"has_port": 27, "drives": 17, "contains_register": 13, "clocked_by": 13, "has_parameter": 7, "parameter_of": 7, "instantiates": 3, "instance_of": 3, "has_instance": 3, "depended_by": 3}
    assert sum(nodes.values()) == 56 and sum(edges.values()) == 96


def test_all_sources(spark):
    g = build_design(spark, Design("d", spark.createDataFrame([(netlist(),)], "value string"), texts(spark, ("x.sdc", SDC)), texts(spark, ("c.sv", SVA)), log(spark)))
    nodes, edges = counts(g)
    assert (nodes["Clock"], nodes["Constraint"], nodes["Assertion"], nodes["Test"], nodes["Commit"]) == (3, 6, 2, 1, 3)
    assert (edges["derived_from"], edges["modifies"], edges["modified_by"], edges["covers"], edges["uses_clock"]) == (1, 3, 3, 1, 2)
    found = {(r.src, r.dst) for r in g.edges.where("relation = 'applies_to'").collect()}
    # ports of the top module are nets by then, and a bus loses its index: only the children's ports are met
    assert ("d::sdc::0005", "d::uart_tx::baud_tick") in found and not any("tx_data" in b for _, b in found)
    assert ("d::sdc::0004", "d::uart_top::inst::u_uart_tx") in found and ("d::sdc::0004", "d::clk::clk_core") in found
    impact = {r.node for r in T.weighted_bfs(g, T.seeds_of_modules(g, spark.createDataFrame([("r", "d", "uart_tx")], "run string, design string, name string"))).collect()}
    assert {"d::uart_top", "d::commit::bbbbbbbb"} <= impact
    commit = T.seeds_of_commits(g, spark.createDataFrame([("r", "d::commit::bbbbbbbb")], "run string, commit string"))
    assert [tuple(r) for r in commit.collect()] == [("r", "d::uart_tx")]
    for bad in (lambda: T.seeds_of_modules(g, spark.createDataFrame([("r", "d", "no")], "run string, design string, name string")), lambda: T.seeds_of_commits(g, spark.createDataFrame([("r", "no")], "run string, commit string"))):
        with pytest.raises(ValueError):
            bad()
    asked = spark.createDataFrame([("What registers does module uart_tx have?",), ("Which commits modified module uart_tx?",), ("What clocks drive registers in module uart_rx?",), ("How is uart_tx connected to baud_gen?",)], "question string")
    got = {r.question: r.answer for r in Q.format_answers(g, Q.retrieve(g, Q.parse_questions(asked))).collect()}
    assert "5 Register: bit_idx, shift_reg, state, tx_busy, tx_out" in got["What registers does module uart_tx have?"]
    assert "2 Commit: Fix baud rate, Initial commit: add UART" in got["Which commits modified module uart_tx?"]
    assert "1 Clock: clk;" in got["What clocks drive registers in module uart_rx?"] and "uart_top" in got["How is uart_tx connected to baud_gen?"]
    cross = {(r.kind, r.module): r.gold for r in Q.cross_questions(g).collect()}
    assert cross["clocks", "d::uart_rx"] == ["clk"]
    assert {r.module for r in Q.risk_factors(g).collect()} == {"d::uart_tx", "d::uart_rx", "d::baud_gen", "d::uart_top"} - ({"d::uart_top"} if not g.edges.where("src = 'd::uart_top' and relation = 'depended_by'").count() and g.edges.where("src = 'd::uart_top' and relation = 'has_port'").count() <= 5 else set())


def test_constraint_values(spark):
    p = {r.constraint_id[-4:]: r for r in K.parse_commands(K.scan(texts(spark, ("x.sdc", SDC)), "d")).collect()}
    assert (p["0001"].period, p["0001"].frequency_mhz, p["0001"].clock_name) == (20.0, 50.0, "clk_core")
    assert (p["0002"].divide_by, p["0002"].clock_name, p["0002"].source_clock, p["0002"].line_number) == (434, "clk_baud", "clk", 3)
    assert (p["0003"].delay_max, p["0003"].clock, p["0003"].targets) == (5.0, "clk_core", ["rx_in", "tx_data[*]"])
    assert (p["0004"].multiplier, p["0004"].setup, p["0004"].path_from) == (2, True, "u_uart_tx")
    assert p["0005"].delay == 10.0 and p["0006"].constraint_type == "set_false_path"
    table = {r.name: r for r in K.clock_table(K.parse_commands(K.scan(texts(spark, ("x.sdc", SDC)), "d"))).collect()}
    assert (table["clk_baud"].source, table["clk_baud"].generated) == ("clk_core", True)


def test_assertion_values(spark):
    a = {r.line_number: r for r in A.assertions(texts(spark, ("c.sv", SVA), ("d.sv", None)), "d").collect()}
    assert set(a) == {3, 5}
    assert (a[3].name, a[3].clock_signal, a[3].disable_condition, a[3].error_message, a[3].end_line, a[3].containing_module) == ("a_idle", "clk", "!rst_n", "line low", 4, "checks")
    assert (a[5].name, a[5].assertion_type, a[5].disable_condition) == (None, "assume", None)
    t = A.testbenches(texts(spark, ("c.sv", SVA)), "d").first()
    assert t.modules_instantiated == ["uart_top"]


def test_git_source(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@x", *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    for k, name in enumerate(("uart.v", "b.v")):
        (tmp_path / name).write_text("x\n" * (k + 1))
        run("add", ".")
        run("commit", "-qm", f"Add {name}\n\nbody, with\nlines")
    spark.dataSource.register(L.GitLog)
    rows = spark.read.format("git_log").option("path", str(tmp_path)).load().collect()
    assert sorted((r.message.split("\n")[0], r.files_changed, r.insertions) for r in rows) == [("Add b.v", ["b.v"], 2), ("Add uart.v", ["uart.v"], 1)]
    assert spark.read.format("git_log").option("path", str(tmp_path)).option("limit", "1").load().count() == 1
    d = L.describe(spark.read.format("git_log").option("path", str(tmp_path)).load(), "d", globs=["u*.v"]).first()
    assert (d.change_type, d.modules_modified, d.summary) == ("feature", ["uart"], "Add uart.v")


SOURCE = """module top #(parameter DIV = 50_000_000) (input clk, input [7:0] data, output [7:0] q);
  child #(.N(2)) u_child (.clk(clk), .q(q));
  always @(posedge clk or negedge rst_n) if (!rst_n) x <= 0;
endmodule
"""


def test_changes_apply_and_revert(spark):
    src = texts(spark, ("rtl/top.v", SOURCE)).withColumn("module", F.lit("top")).withColumn("design", F.lit("d"))
    modules = spark.createDataFrame([("d", "child", False, ["q"]), ("e", "top", True, None)], "design string, name string, is_top boolean, outputs array<string>")
    made = C.generate(src, modules, 20).cache()
    assert [r.new_text for r in made.where("variant = 'stub'").collect()] == ["// stub of u_child\nassign q = 0;"]
    assert made.where("change_type = 'parameter'").count() == 3 and C.generate(src, modules, 2).where("change_type = 'parameter'").count() == 2
    assert C.generate(src, modules.limit(0), 20).where("change_type in ('dependency', 'hierarchy')").count() == 0
    kinds = {(r.change_type, r.variant) for r in made.collect()}
    assert {("parameter", "double"), ("parameter", "halve"), ("parameter", "boundary"), ("width", "double"), ("width", "halve"), ("clock", "edge_swap"), ("clock", "rename"), ("reset", "polarity"), ("dependency", "remove"), ("hierarchy", "stub")} == kinds
    double = made.where("change_type = 'parameter' and variant = 'double'").first()
    assert "100_000_000" in double.new_text
    some = made.where("not every")
    done = C.apply_changes(some, src).withColumnRenamed("patched", "text")
    assert {r.text for r in done.collect()}.isdisjoint({SOURCE})
    for r in done.where("file_path is not null").collect()[:6]:
        back = C.apply_changes(some.where(F.col("change_id") == r.change_id), texts(spark, ("elsewhere/top.v", r.text)), revert=True).first()
        assert back.patched == SOURCE
    with pytest.raises(Exception, match="text to replace not found"):
        C.apply_changes(some, texts(spark, ("top.v", "nothing"))).collect()
    truth = spark.createDataFrame([(double.change_id, "b", "Port", 1), (double.change_id, "a", "Port", 1)], "run string, node string, artifact_type string, hop int")
    saved = {r.change_id: r for r in C.from_json(C.to_json(made, truth)).collect()}
    assert saved[double.change_id].ground_truth_by_type == {"Port": ["a", "b"]} and saved[double.change_id].patches[0].old_text == double.old_text
    assert C.summary(made, truth).where("change_type = 'parameter'").first().n == 3


def test_scalars(spark):
    df = spark.createDataFrame([(100, "200"), (100_000_000, "50_000_000"), (1, "50_000_000"), (25_000_000, "50_000_000")], "n int, t string")
    assert [r[0] for r in df.select(S.format_like(F.col("n"), F.col("t"))).collect()] == ["100", "100_000_000", "1", "25_000_000"]
    one = spark.range(1)
    values = one.select(S.binary_value(F.lit("0101")), S.binary_value(F.lit("1x")), S.binary_value(F.lit(None).cast("string")), S.replace_first(F.lit("a.b.b"), F.lit(".b"), F.lit("")), S.replace_first(F.lit("a"), F.lit("b"), F.lit("")), S.relative_path(F.lit("/r/x/y.v"), "/r/"), S.get_kind(F.lit("[get_pins a]")), S.is_flip_flop(F.lit("$_dff_P_")), S.looks_like_clock(F.lit("sys_CK"))).first()
    assert tuple(values) == (5, 0, 0, "a.b", None, "x/y.v", "pins", True, True)
    place = one.select(S.source_place(F.lit("a/b.v:3.1-9.7")).alias("a"), S.source_place(F.lit("b.v:4")).alias("b"), S.source_place(F.lit("b.v")).alias("c")).first()
    assert tuple(place.a) == ("a/b.v", 3, 9) and tuple(place.b) == ("b.v", 4, 4) and tuple(place.c) == ("b.v", None, None)


def test_streams_equal_tables(spark, tmp_path):
    rows = [(k, f"2024-01-0{1 + k % 5} 1{k % 10}:00:00", "a" if k % 3 else "b") for k in range(40)]
    df = spark.createDataFrame(rows, "id int, t string, kind string").withColumn("t", F.to_timestamp("t"))
    df.unionByName(df).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.read_files(spark, str(tmp_path / "in"), "id int, t timestamp, kind string")
    ingest.run_once(ingest.without_repeats(stream, "id", "t", "30 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    counts = ingest.read_files(spark, str(tmp_path / "out"), "id int, t timestamp, kind string").groupBy().count
    assert counts is not None
    ingest.run_once(ingest.activity(ingest.read_files(spark, str(tmp_path / "out"), "id int, t timestamp, kind string"), "t", "kind", delay="0 seconds"), str(tmp_path / "act"), str(tmp_path / "ck2"))
    final = {(str(r.window_start), r.kind): r.n for r in spark.read.parquet(str(tmp_path / "act")).collect()}
    table = {(str(r.window_start), r.kind): r.n for r in ingest.activity(df, "t", "kind").collect()}
    assert final and all(table[k] == v for k, v in final.items())


def test_models_and_their_failures(spark):
    prompts = spark.createDataFrame([("q", "ctx"), ("r", None)], "question string, context string")
    assert {tuple(r) for r in Q.answer(prompts).collect()} == {("q", "ctx", None), ("r", None, None)}
    assert {r.answer for r in Q.answer(prompts, lambda ts: ["ok"] * len(ts)).collect()} == {"ok"}

    def broken(ts):
        raise RuntimeError("down")

    assert {r.error for r in Q.answer(prompts, broken, wait=0.0).collect()} == {"RuntimeError: down"}


def test_changed_texts_are_found_anywhere_in_a_line(spark):
    lines = ["set_load  0.05 [get_ports a]", "create_clock -period 10.0 [get_ports clk]", "  set_load 0.05 [get_ports a]", "# set_load  0.05 [get_ports a]", "x", ""]
    texts = ["0.05 [get_ports a]", "set_load  0.05 [get_ports a]", "clk", "period 10", "x", "none such text", "", "get_port", "set_load 0.05", "get_ports clk"]
    changes = spark.createDataFrame([(f"c{k}", t) for k, t in enumerate(texts)], "change_id string, old_text string")
    rows = spark.createDataFrame([(f"r{k}", t) for k, t in enumerate(lines)] + [("null", None)], "constraint_id string, raw_line string")
    want = {(f"c{i}", f"r{j}") for i, t in enumerate(texts) for j, line in enumerate(lines) if t and t in line}
    for gram in (1, 3, 8, 20):
        assert {tuple(r) for r in C.matching_constraints(changes, rows, gram).collect()} == want


def test_constraint_changes_multiply_numbers(spark):
    got = registry.queries()["c_constraint_changes"](spark, "/root/testdata/sf0.01").collect()
    assert {r.variant for r in got} == {"halve_period", "double_period", "remove", "double_delay"}
    factor = {"halve_period": 0.5, "double_period": 2.0}
    for r in got:
        if r.variant in factor:
            was, now = (float(t.split("-period")[1].split()[0]) for t in (r.old_text, r.new_text))
            assert now == was * factor[r.variant]


def test_shell_words_equal_the_shells(spark):
    rng = random.Random(1)
    lines = ["set_load 1 [get_ports {a b}]", 'a "b c" d', "a 'b \"c' d", "x\\ y z", "# c", "a b # c d", "a#b c", '"un closed', "it's", 'a "b\\"c" d', '""', "", "a\\"]
    lines += ["".join(rng.choice("ab \"'\\#") for _ in range(rng.randrange(1, 14))) for _ in range(800)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in [*lines, None]], "l string").select(S.shell_words(F.col("l"))).collect()]
    for line, words in zip(lines, got):
        try:
            want = shlex.split(line, comments=True)
        except ValueError:
            want = line.split()
        assert words == want, line
    assert got[-1] is None


def test_five_methods_side_by_side(spark):
    nodes = [("d::uart", "Module", "uart", "d", None), ("d::uart::tx", "Port", "tx", "d", None), ("d::spi", "Module", "spi", "d", "serial bus")]
    g = G.Graph(spark.createDataFrame(nodes, "id string, type string, name string, design string, summary string"), spark.createDataFrame([("d::uart", "d::uart::tx", "has_port")], "src string, dst string, relation string"))
    asked = spark.createDataFrame([("What ports does module uart have?",), ("What ports does module uart have?",), (None,)], "question string")
    seen = {(r.method): r for r in W.answers(g, asked, model=lambda ts: [f"{len(t)}" for t in ts], top_k=2).collect()}
    assert set(seen) == set(W.METHODS) and all(r.error is None and r.answer for r in seen.values())
    assert seen["graph_only"].answer == "1 Module: uart; 1 Port: tx" and seen["graph_only"].evidence == ["d::uart", "d::uart::tx"]
    assert seen["model_only"].evidence == [] and "node Module: 2" in seen["model_only"].context
    assert len(seen["vectors_and_model"].evidence) == 2 and "similarity" in seen["vectors_and_model"].context
    assert seen["graph_vectors_and_model"].evidence == ["d::spi", "d::uart", "d::uart::tx"]

    def broken(ts):
        raise RuntimeError("down")

    failed = {r.method: r for r in W.answers(g, asked, model=broken, wait=0.0).collect()}
    assert failed["graph_only"].error is None and failed["graph_and_model"].error == "RuntimeError: down" and failed["graph_and_model"].answer is None
    none = {r.method: r.answer for r in W.answers(g, asked, ("graph_and_model",)).collect()}
    assert "id=d::uart::tx" in none["graph_and_model"]
    bad = spark.createDataFrame([("d::uart", None)], "node string, broken string")
    assert W.answers(g, asked, ("graph_only", "vectors_and_model"), vectors=bad).where("error is not null").count() == 1
    with pytest.raises(ValueError):
        W.answers(g, asked, ("no_such_method",))
    assert "node Module: 2" in W.query_prompts(asked.where("question is not null"), "node Module: 2").first().prompt


def test_hashed_vectors_follow_words(spark):
    df = spark.createDataFrame([("a", "uart tx port"), ("b", "port TX uart"), ("c", "clock"), ("d", None)], "key string, text string")
    v = {r.key: r.embedding for r in W.hashed_vectors(df, "key", "text", 32).collect()}
    assert v["a"] == v["b"] != v["c"] and not any(v["d"]) and len(v["a"]) == 32


def test_questions_and_results_are_saved(spark, tmp_path):
    rows = [("q1", "What?", "structural", "easy", 1, "gold", ["n"], [["a", "b", "r"]], "d"), ("q2", "Why?", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, R.QUESTION_SCHEMA)
    R.save_questions(df, str(tmp_path / "q"))
    got = {r.question_id: r for r in R.load_questions(spark, str(tmp_path / "q")).collect()}
    assert got["q1"].evidence_edges == [["a", "b", "r"]] and (got["q2"].evidence_nodes, got["q2"].design_name) == ([], "")
    (tmp_path / "array.json").write_text(json.dumps([{"question_id": "q3", "question_text": "How?"}]))
    assert [r.question_id for r in R.load_questions(spark, str(tmp_path / "array.json")).collect()] == ["q3"]
    R.save_results(df.select("question_id", "category"), str(tmp_path / "r"), "category")
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    made = spark.createDataFrame([("q1", "m", "gold", ["n", "x"]), ("q9", "m", "x", [])], "question_id string, method string, answer string, retrieved array<string>")
    asked = df.select("question_id", F.col("gold_answer").alias("gold"), F.col("evidence_nodes").alias("evidence"), "category", "difficulty")
    scored = R.evaluate(asked, made).collect()
    assert [(r.question_id, r.token_f1, r.evidence_recall, r.evidence_precision, r.hallucinated) for r in scored] == [("q1", 1.0, 1.0, 0.5, False)]


def test_several_designs_at_once_keep_apart(spark):
    rows = [("a", "f.sdc", "create_clock -period 2 -name c [get_ports p]\n"), ("b", "f.sdc", "# x\ncreate_clock -period 4 -name c [get_ports p]\nset_load 1 [get_ports p]\n")]
    parsed = K.parse_commands(K.scan(spark.createDataFrame(rows, "design string, file_path string, text string")))
    assert {(r.constraint_id, r.line_number) for r in parsed.collect()} == {("a::sdc::0001", 1), ("b::sdc::0001", 2), ("b::sdc::0002", 3)}
    nodes = spark.createDataFrame([("a::m::p", "Port", "p", "a"), ("b::m::p", "Port", "p", "b")], "id string, type string, name string, design string")
    _, edges = K.to_graph(parsed, nodes)
    applied = {tuple(r) for r in edges[2].select("src", "dst").collect()}
    assert applied == {("a::sdc::0001", "a::m::p"), ("b::sdc::0001", "b::m::p"), ("b::sdc::0002", "b::m::p")}


def test_constraints_are_attributed_to_modules(spark):
    nodes = [("m", "Module", "m_name", "d", False), ("n", "Module", "n_name", "d", True), ("p", "Port", "p", "d", None), ("r", "Register", "r", "d", None), ("k", "Clock", "k", "d", None), ("idle", "Clock", "idle", "d", None)]
    nodes += [(f"c{i}", "Constraint", "x", "d", None) for i in range(6)] + [("c6", "Constraint", "x", "empty", None), ("c7", "Constraint", "x", "flat", None), ("f", "Module", "f_name", "flat", False)]
    edges = [("m", "p", "has_port"), ("m", "r", "contains_register"), ("r", "k", "clocked_by"), ("c0", "m", "applies_to"), ("c1", "p", "applies_to"), ("c2", "k", "applies_to"), ("p", "c3", "constrained_by"), ("c4", "idle", "applies_to")]
    g = G.Graph(spark.createDataFrame(nodes, "id string, type string, name string, design string, is_top boolean"), spark.createDataFrame(edges, "src string, dst string, relation string"))
    assert {r.constraint_id: r.module for r in C.constraint_modules(g).collect()} == {**{f"c{i}": "m_name" for i in range(4)}, "c4": "n_name", "c5": "n_name", "c6": "unknown", "c7": "f_name"}


def test_each_design_counts_once_in_a_mean_of_means(spark):
    rows = spark.createDataFrame([("m", "big", 1.0)] * 9 + [("m", "small", 0.0), ("o", "small", 0.5)], "method string, design string, v double")
    assert {tuple(r) for r in M.mean_of_means(rows, ["method"], "design", ["v"]).collect()} == {("m", 2, 0.5), ("o", 1, 0.5)}
