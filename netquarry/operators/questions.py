"""Question answering over the graph: rules that read questions, retrieval, formatted answers, generated questions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.operators import traverse as T
from netquarry.operators.graph import Graph, both_ways, by_type, context_lines

_E = r"[`'\"]?([a-z_][a-z0-9_.:]*)[`'\"]?"
# Rules in order; the first that matches decides: (pattern on the lower-cased question, category, operation, relations, types)
RULES: tuple[tuple[str, str, str, tuple[str, ...], tuple[str, ...]], ...] = (
    (rf"\bports?\b.*\b(?:module|of|belong to|does)\s+(?:module\s+)?{_E}", "structural", "neighborhood", ("has_port",), ("Port",)),
    (rf"\bsubmodules?\b.*\b(?:module|of|does)\s+(?:module\s+)?{_E}", "structural", "neighborhood", ("instantiates",), ("Module",)),
    (rf"\binstantiated (?:by|in)\s+(?:module\s+)?{_E}", "structural", "neighborhood", ("instantiates",), ("Module",)),
    (rf"\bclocks?\b.*\b(?:registers?\s+)?(?:in|of|drive)\s+(?:registers?\s+in\s+)?(?:module\s+)?{_E}", "cross_artifact", "chain", ("contains_register", "clocked_by"), ("Register", "Clock")),
    (rf"\bregisters?\b.*\b(?:module|of|does)\s+(?:module\s+)?{_E}", "structural", "neighborhood", ("contains_register",), ("Register",)),
    (rf"\bparameters?\b.*\b(?:module|of|does)\s+(?:module\s+)?{_E}", "structural", "neighborhood", ("has_parameter",), ("Parameter",)),
    (r"\b(?:list|show|what are) (?:all )?(?:the )?modules\b", "structural", "by_type", (), ("Module",)),
    (r"\b(?:list|show|what are) (?:all )?(?:the )?clocks\b", "structural", "by_type", (), ("Clock",)),
    (r"\b(?:list|show|what are) (?:all )?(?:the )?constraints\b", "structural", "by_type", (), ("Constraint",)),
    (r"\b(?:list|show|what are) (?:all )?(?:the )?assertions\b", "structural", "by_type", (), ("Assertion",)),
    (rf"\bconstraints?\b.*\b(?:apply to|on|for|affect)\s+(?:module\s+)?{_E}", "cross_artifact", "chain", ("has_port", "constrained_by"), ("Port", "Constraint")),
    (rf"\bassertions?\b.*\b(?:verify|for|on|check)\s+(?:module\s+)?{_E}", "cross_artifact", "neighborhood", ("verified_by", "verifies"), ("Assertion",)),
    (rf"\b(?:tests?|testbench(?:es)?)\b.*\b(?:cover|for|of)\s+(?:module\s+)?{_E}", "cross_artifact", "neighborhood", ("covers",), ("Test",)),
    (rf"\b(?:path|relation(?:ship)?|connection) (?:between|from)\s+{_E}\s+(?:and|to)\s+{_E}", "cross_artifact", "path", (), ()),
    (rf"\bhow (?:is|are)\s+{_E}\s+(?:related|connected) to\s+{_E}", "cross_artifact", "path", (), ()),
    (rf"\brequirements?\b.*\b(?:of|for)\s+(?:module\s+)?{_E}", "cross_artifact", "module_context", (), ()),
    (rf"\b(?:who|when)\b.*\bchanged\s+(?:module\s+)?{_E}", "temporal", "neighborhood", ("modifies", "modified_by"), ("Commit",)),
    (rf"\bcommits?\b.*\b(?:modified|changed|touched)\s+(?:module\s+)?{_E}", "temporal", "neighborhood", ("modifies", "modified_by"), ("Commit",)),
    (rf"\bhistory of\s+(?:module\s+)?{_E}", "temporal", "neighborhood", ("modifies", "modified_by"), ("Commit",)),
    (rf"\bwhat (?:happens|would happen|if)\b.*\b(?:change|modify|remove)s?\s+(?:module\s+)?{_E}", "what_if", "module_context", (), ()),
    (rf"\bimpact of (?:changing|modifying|removing)\s+(?:module\s+)?{_E}", "what_if", "module_context", (), ()),
    (rf"\bwhy is\s+(?:module\s+)?{_E}\s+risky\b", "what_if", "module_context", (), ()),
)
FALLBACK_STOP = ("what", "which", "the", "does", "have", "has", "are", "for", "and", "with", "from", "that", "this", "list", "show", "why", "how", "when", "who", "can", "while", "after", "module", "modules", "port", "ports", "register", "registers", "clock", "clocks", "data", "lose", "low", "handle", "reset")


def parse_questions(questions: DataFrame) -> DataFrame:
    """(question, rule_no, category, operation, entity, entity2) of each question; rule 0 and a two-hop neighbourhood without a match.

    The entity of an unmatched question is its first quoted or underscored word,
    else its first word of three letters that is no stop word.
    """
    low = F.lower("question")
    pick: dict[str, Column] = {}
    for name in ("rule_no", "category", "operation", "entity", "entity2"):
        expression = None
        for k, (pattern, category, operation, _, _) in enumerate(RULES, 1):
            groups = pattern.count(_E)
            value = {
                "rule_no": F.lit(k), "category": F.lit(category), "operation": F.lit(operation),
                "entity": F.regexp_extract(low, pattern, 1) if groups else F.lit(None).cast("string"),
                "entity2": F.regexp_extract(low, pattern, 2) if groups > 1 else F.lit(None).cast("string"),
            }[name]
            expression = F.when(low.rlike(pattern), value) if expression is None else expression.when(low.rlike(pattern), value)
        pick[name] = expression
    quoted = F.nullif(F.regexp_extract(low, r"[`'\"]([a-z_][a-z0-9_]+)[`'\"]", 1), F.lit(""))
    joined = F.nullif(F.regexp_extract(low, r"(?<![a-z0-9_])([a-z][a-z0-9]*_[a-z0-9_]+)", 1), F.lit(""))
    plain = F.get(F.filter(F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9]{2,}"), 0), lambda w: ~w.isin(*FALLBACK_STOP)), F.lit(0))
    return questions.select(
        "question",
        F.coalesce(pick["rule_no"], F.lit(0)).alias("rule_no"),
        F.coalesce(pick["category"], F.lit("structural")).alias("category"),
        F.coalesce(pick["operation"], F.lit("neighborhood")).alias("operation"),
        F.coalesce(F.when(pick["rule_no"].isNotNull(), F.rtrim(pick["entity"], F.lit(".:"))), quoted, joined, plain).alias("entity"),
        F.rtrim(pick["entity2"], F.lit(".:")).alias("entity2"),
    )


def retrieve(graph: Graph, parsed: DataFrame) -> DataFrame:
    """(question, node) that each parsed question's operation finds; all questions of a rule run together."""
    named = T.resolve_names(graph, parsed.select(F.col("entity").alias("query"))).select(F.col("query").alias("entity"), "node")
    seeds = parsed.join(named, "entity").select(F.col("question").alias("run"), "rule_no", "operation", "node", "entity2")
    parts = []
    present = {r[0] for r in parsed.select("rule_no").distinct().collect()}
    for k in sorted(present):
        mine = seeds.where(F.col("rule_no") == k).select("run", "node")
        if k == 0:
            parts.append(T.neighborhood(graph, mine, hops=2).select("run", "node"))
            continue
        _, _, operation, relations, types = RULES[k - 1]
        if operation == "neighborhood":
            parts.append(T.neighborhood(graph, mine, 1, relations, types).select("run", "node"))
        elif operation == "chain":
            parts.append(T.chain(graph, mine, list(zip(relations, types))).select("run", "node"))
        elif operation == "module_context":
            parts.append(T.full_context(graph, mine))
        elif operation == "by_type":
            found = [r[0] for r in by_type(graph, types[0]).select("id").collect()]  # at most fifty by definition
            asked = parsed.where(F.col("rule_no") == k).select(F.col("question").alias("run"))
            parts.append(asked.withColumn("node", F.explode(F.array(*map(F.lit, found)).cast("array<string>"))))
        elif operation == "path":
            second = T.resolve_names(graph, parsed.select(F.col("entity2").alias("query"))).select(F.col("query").alias("entity2"), F.col("node").alias("target"))
            pairs = seeds.where(F.col("rule_no") == k).join(second, "entity2").select("run", F.col("node").alias("source"), "target")
            parts.append(T.shortest_paths(graph, pairs).select("run", "node"))
    if not parts:
        return parsed.sparkSession.createDataFrame([], "question string, node string")
    return reduce(DataFrame.unionByName, parts).select(F.col("run").alias("question"), "node").distinct()


def format_answers(graph: Graph, found: DataFrame, most: int = 20) -> DataFrame:
    """(question, answer): the nodes found, grouped by type, at most ``most`` names each and the number of the rest."""
    nodes = graph.nodes.select(F.col("id").alias("node"), "type", "name")
    order = Window.partitionBy("question", "type").orderBy("name", "node")
    rows = found.join(nodes, "node").withColumn("k", F.row_number().over(order))
    per = rows.groupBy("question", "type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "name")))).alias("names"))
    text = F.concat(F.col("n").cast("string"), F.lit(" "), "type", F.lit(": "), F.array_join(F.transform("names", lambda x: x["name"]), ", "), F.when(F.col("n") > most, F.concat(F.lit(" and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise(""))
    return per.select("question", "type", text.alias("text")).groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "text"))), lambda x: x["text"]), "; ").alias("answer"))


def answer(prompts: DataFrame, model: Callable[[list[str]], list[str]] | None = None, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """(question, answer, error) for ``prompts(question, context)`` by a callable over batches; without one, the context is the answer.

    What the model reads is the column ``prompt`` if there is one, else question and
    context.  A batch is tried ``retries`` times, after pauses of ``wait`` seconds
    that double; if it fails each time, its rows carry the error and no answer.
    """
    if model is None:
        return prompts.select("question", F.col("context").alias("answer"), F.lit(None).cast("string").alias("error"))
    own = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nContext:\n"), F.coalesce("context", F.lit("")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["prompt"].tolist()
            error, answers = None, [None] * len(texts)
            for k in range(retries):
                try:
                    answers, error = list(model(texts)), None
                    break
                except Exception as e:  # noqa: BLE001 - whatever a model raises goes to its rows
                    error = f"{type(e).__name__}: {e}"
                    if k + 1 < retries:
                        time.sleep(wait * 2**k)
            yield pd.DataFrame({"question": batch["question"], "answer": answers, "error": error})

    text = F.col("prompt") if "prompt" in prompts.columns else own
    return prompts.select("question", text.alias("prompt")).mapInPandas(run, "question string, answer string, error string")


def contexts(graph: Graph, found: DataFrame, most: int = 200) -> DataFrame:
    """(question, context): the nodes of each question as lines of text, at most ``most``, by id."""
    lines = context_lines(graph).where("part = 0").select(F.col("id").alias("node"), "line")
    order = Window.partitionBy("question").orderBy("node")
    rows = found.join(lines, "node").withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return rows.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("context"))


_STRUCTURAL = (("ports", "has_port"), ("submodules", "instantiates"), ("registers", "contains_register"), ("parameters", "has_parameter"))


def _members(graph: Graph, relation: str, forward: bool = True) -> DataFrame:
    """(design, module, name, id_, member) of each module's partners over a relation."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    edges = graph.edges.where(F.col("relation") == relation).select(F.col(a).alias("module"), F.col(b).alias("id_"))
    modules = graph.nodes.where("type = 'Module'").select(F.col("id").alias("module"), "name", "design")
    return edges.join(modules, "module").join(graph.nodes.select(F.col("id").alias("id_"), F.col("name").alias("member")), "id_")


def structural_questions(graph: Graph) -> DataFrame:
    """(design, module, kind, question_text, gold, evidence) about ports, submodules, registers and parameters."""
    parts = []
    for kind, relation in _STRUCTURAL:
        text = F.concat(F.lit(f"What {kind} does module "), "name", F.lit(" have?"))
        rows = _members(graph, relation).groupBy("design", "module", text.alias("question_text"))
        parts.append(rows.agg(F.array_sort(F.collect_set("member")).alias("gold"), F.array_sort(F.collect_set("id_")).alias("evidence")).withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, parts)


def cross_questions(graph: Graph) -> DataFrame:
    """(design, module, kind, question_text, gold): clocks of a module's registers, its constraints and its assertions."""
    registers = graph.edges.where("relation = 'contains_register'").select(F.col("src").alias("module"), F.col("dst").alias("reg"))
    clocked = registers.join(graph.edges.where("relation = 'clocked_by'").select(F.col("src").alias("reg"), F.col("dst").alias("id_")), "reg").select("module", "id_")
    ported = graph.edges.where("relation = 'has_port'").select(F.col("src").alias("module"), F.col("dst").alias("port"))
    constrained = ported.join(graph.edges.where("relation = 'applies_to'").select(F.col("src").alias("id_"), F.col("dst").alias("port")), "port").select("module", "id_")
    verified = graph.edges.where("relation = 'verified_by'").select(F.col("src").alias("module"), F.col("dst").alias("id_"))
    modules = graph.nodes.where("type = 'Module'").select(F.col("id").alias("module"), "name", "design")
    members = graph.nodes.select(F.col("id").alias("id_"), F.col("name").alias("member"))
    parts = []
    for kind, pairs, text in (("clocks", clocked, "What clocks drive registers in module "), ("constraints", constrained, "What constraints apply to module "), ("assertions", verified, "What assertions verify module ")):
        rows = pairs.join(modules, "module").join(members, "id_").groupBy("design", "module", F.concat(F.lit(text), "name", F.lit("?")).alias("question_text"))
        parts.append(rows.agg(F.array_sort(F.collect_set("member")).alias("gold")).withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, parts).select("design", "module", "kind", "question_text", "gold")


def commit_questions(graph: Graph, most: int = 5) -> DataFrame:
    """(design, module, question_text, gold, n): the first ``most`` commit summaries of each module, and their number."""
    rows = _members(graph, "modified_by")
    text = F.concat(F.lit("Which commits modified module "), "name", F.lit("?"))
    return rows.groupBy("design", "module", text.alias("question_text")).agg(F.slice(F.array_sort(F.collect_set("member")), 1, most).alias("gold"), F.count_distinct("id_").alias("n"))


def what_if_counts(graph: Graph, least: int = 3) -> DataFrame:
    """(module, artifact_type, n) within two steps of each module that has at least ``least`` such nodes."""
    edges = both_ways(graph.edges).select("src", "dst").distinct()
    modules = graph.nodes.where("type = 'Module'").select(F.col("id").alias("module"))
    one = modules.join(edges.select(F.col("src").alias("module"), F.col("dst").alias("node")), "module")
    two = one.unionByName(one.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("far")), "node").select("module", F.col("far").alias("node"))).distinct()
    far = two.where("node <> module")
    typed = far.join(graph.nodes.select(F.col("id").alias("node"), F.col("type").alias("artifact_type")), "node")
    counts = typed.groupBy("module", "artifact_type").agg(F.count("*").alias("n"))
    enough = counts.groupBy("module").agg(F.sum("n").alias("total")).where(F.col("total") >= least).select("module")
    return counts.join(enough, "module", "left_semi")


def risk_factors(graph: Graph) -> DataFrame:
    """(module, parents, factors) of each module that has parents or at least five nodes within two steps.

    Factors: ``parents``, ``ports`` (more than five), ``constraints`` and ``assertions``; modules without a factor are left out.
    """
    per = graph.edges.groupBy(F.col("src").alias("module")).agg(
        F.count_if(F.col("relation") == "has_port").alias("ports"),
        F.count_if(F.col("relation") == "constrained_by").alias("constraints"),
        F.count_if(F.col("relation") == "verified_by").alias("assertions"),
        F.array_sort(F.collect_set(F.when(F.col("relation") == "depended_by", F.col("dst")))).alias("parent_ids"),
    )
    near = what_if_counts(graph, 5).groupBy("module").agg(F.sum("n").alias("affected"))
    rows = graph.nodes.where("type = 'Module'").select(F.col("id").alias("module")).join(per, "module").join(near, "module", "left")
    factors = F.array_compact(F.array(F.when(F.size("parent_ids") > 0, "parents"), F.when(F.col("ports") > 5, "ports"), F.when(F.col("constraints") > 0, "constraints"), F.when(F.col("assertions") > 0, "assertions")))
    out = rows.where((F.size("parent_ids") > 0) | (F.col("affected") >= 5)).select("module", F.slice("parent_ids", 1, 3).alias("parents"), factors.alias("factors"))
    return out.where(F.size("factors") > 0)
