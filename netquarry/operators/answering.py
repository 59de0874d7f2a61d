"""Answering questions by several methods side by side, and reading queries that a language model writes.

A model is any callable over batches of prompts; without one, the retrieved context
is the answer.  Vectors come from any table; the default is feature hashing, which
needs no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry import scratch
from netquarry.functions import scalars as S
from netquarry.operators import questions as Q
from netquarry.operators import traverse as T
from netquarry.operators.graph import Graph, relation_counts

METHODS = ("model_only", "graph_only", "graph_and_model", "vectors_and_model", "graph_vectors_and_model")
Model = Callable[[list[str]], list[str]]


def hashed_vectors(rows: DataFrame, key: str, text: str, size: int = 256) -> DataFrame:
    """(key, embedding) of texts by feature hashing of their words and identifiers' parts; a null text gives zeros."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, size))
            for i, words in enumerate(batch.column("words").to_pylist()):
                for w in words:
                    h = xxhash.xxh64_intdigest(w)
                    out[i, h % size] += 1.0 if h >> 63 else -1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(out), pa.list_(pa.float64()))], names=[key, "embedding"])

    words = S.word_set(F.col(text))
    parts = F.flatten(F.transform(words, lambda w: F.array_distinct(F.array_append(F.split(w, "_"), w))))
    return rows.select(key, F.filter(parts, lambda w: w != "").alias("words")).mapInArrow(run, f"{key} {kind}, embedding array<double>")


def node_texts(graph: Graph) -> DataFrame:
    """(node, text): every node as a line of text, with what it has of the attributes that tell something."""
    names = [c for c in graph.nodes.columns if c not in ("id", "type", "name", "design")]
    attrs = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col(c).cast("string") for c in names])) if names else F.create_map().cast("map<string,string>")
    return graph.nodes.select(F.col("id").alias("node"), S.node_text(F.col("type"), F.col("name"), F.col("id"), attrs).alias("text"))


def schema_text(graph: Graph) -> str:
    """The kinds of nodes and relations with their numbers, as text; a line for each kind."""
    rows = sorted(relation_counts(graph).collect(), key=lambda r: (r.kind != "node", -r.n, r.label))  # a row a kind
    return "\n".join(f"{r.kind} {r.label}: {r.n}" for r in rows)


def prompts_of(parts: list[tuple[str, str]], question: str = "question") -> F.Column:
    """One prompt: instructions, named contexts and the question; a null context is left out."""
    lines = [F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{title}:\n"), F.col(column))) for title, column in parts]
    return F.concat_ws("\n\n", F.lit("Answer from what is given below, name the nodes that show it, and say what is missing."), *lines, F.concat(F.lit("Question: "), F.col(question)))


def answers(graph: Graph, questions: DataFrame, methods: tuple[str, ...] = METHODS, model: Model | None = None, vectors: DataFrame | None = None, top_k: int = 20, extra_k: int = 10, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """(method, question, answer, evidence, context, error) of every question by every method.

    ``model_only`` knows the graph's schema; ``graph_only`` formats what the rules
    retrieve; the others give a model what rules, vectors or both retrieve.  A
    method that fails as a whole gives each question a row with its error, and so
    do questions whose batch a model fails on.  ``vectors(node, embedding)``
    replaces the hashed ones, for nodes and questions alike only if these are of
    the same size.
    """
    asked = scratch.table(questions.select("question").where("question is not null").distinct(), "asked")
    none = F.array().cast("array<string>")
    found = context = None

    def graph_part() -> tuple[DataFrame, DataFrame]:
        nonlocal found, context
        if found is None:
            found = scratch.table(Q.retrieve(graph, Q.parse_questions(asked)), "found")
            context = scratch.table(asked.join(Q.contexts(graph, found), "question", "left"), "contexts")
        return found, context

    def nearest(k: int, leave: DataFrame | None) -> DataFrame:
        texts = node_texts(graph)
        of_nodes = vectors if vectors is not None else hashed_vectors(texts, "node", "text")
        of_questions = hashed_vectors(asked.withColumn("text", F.col("question")), "question", "text")
        wanted = k if leave is None else k + (leave.groupBy("question").count().agg(F.max("count")).first()[0] or 0)
        near = T.vector_top_k(of_nodes.select(F.col("node").alias("vec_id"), "embedding"), of_questions.select(F.col("question").alias("query_id"), "embedding"), wanted)
        near = near.select(F.col("query_id").alias("question"), F.col("vec_id").alias("node"), "similarity", "rank")
        near = near if leave is None else near.join(leave.select("question", "node"), ["question", "node"], "left_anti")
        near = near.groupBy("question").agg(F.slice(F.array_sort(F.collect_list(F.struct("rank", "node", "similarity"))), 1, k).alias("r"))
        return near.select("question", F.posexplode("r").alias("pos", "r")).select("question", "pos", "r.node", "r.similarity")

    def lines_of(near: DataFrame) -> DataFrame:
        texts = node_texts(graph)
        line = F.concat(F.col("text"), F.lit(" (similarity "), F.round("similarity", 3).cast("string"), F.lit(")"))
        rows = near.join(texts, "node").select("question", "pos", "node", line.alias("line"))
        return rows.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "line"))).alias("r")).select("question", F.transform("r", lambda x: x["node"]).alias("near_nodes"), F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("near_text"))

    def evidence() -> DataFrame:
        return graph_part()[0].groupBy("question").agg(F.array_sort(F.collect_set("node")).alias("graph_nodes"))

    def by(method: str) -> DataFrame:
        schema = F.lit(schema_text(graph))
        if method == "graph_only":
            out = asked.join(Q.format_answers(graph, graph_part()[0]), "question", "left").join(evidence(), "question", "left").join(graph_part()[1], "question", "left")
            return out.select("question", "answer", F.coalesce("graph_nodes", none).alias("evidence"), "context", F.lit(None).cast("string").alias("error"))
        rows = asked.withColumn("schema", schema if method != "vectors_and_model" else F.lit(None).cast("string"))
        rows = rows.withColumn("graph_nodes", none).withColumn("graph_text", F.lit(None).cast("string")).withColumn("near_nodes", none).withColumn("near_text", F.lit(None).cast("string"))
        if "graph" in method:
            rows = rows.drop("graph_nodes", "graph_text").join(evidence(), "question", "left").join(graph_part()[1].withColumnRenamed("context", "graph_text"), "question", "left")
        if "vectors" in method:
            near = lines_of(nearest(top_k, None) if "graph" not in method else nearest(extra_k, graph_part()[0]))
            rows = rows.drop("near_nodes", "near_text").join(near, "question", "left")
        retrieved = F.concat_ws("\n", *(["schema"] if method == "model_only" else []), "graph_text", "near_text")
        rows = rows.select("question", prompts_of([("Schema", "schema"), ("Graph", "graph_text"), ("Similar nodes", "near_text")]).alias("prompt"), retrieved.alias("context"), F.array_sort(F.array_union(F.coalesce("graph_nodes", none), F.coalesce("near_nodes", none))).alias("evidence"))
        rows = scratch.table(rows, "prompts")
        said = Q.answer(rows.select("question", "prompt", "context"), model, retries, wait)
        return rows.join(said, "question").select("question", "answer", "evidence", "context", "error")

    parts = []
    for method in methods:
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}")
        try:
            part = scratch.table(by(method), "answers")
        except Exception as e:  # noqa: BLE001 - a method that fails must not take the others with it
            part = asked.select("question", F.lit(None).cast("string").alias("answer"), none.alias("evidence"), F.lit(None).cast("string").alias("context"), F.lit(f"{type(e).__name__}: {e}"[:500]).alias("error"))
        parts.append(part.select(F.lit(method).alias("method"), "question", "answer", "evidence", "context", "error"))
    return reduce(DataFrame.unionByName, parts)


OPERATIONS = ("neighborhood", "path", "by_type", "chain", "module_context")
CATEGORIES = ("structural", "cross_artifact", "temporal", "what_if")


def query_prompts(questions: DataFrame, schema: str) -> DataFrame:
    """(question, prompt) that asks a model for a query as JSON: category, seed_entities, operation, params."""
    form = '{"category": one of ' + "|".join(CATEGORIES) + ', "seed_entities": [names], "operation": one of ' + "|".join(OPERATIONS) + ', "params": {}}'
    text = F.concat(F.lit(f"A graph of a hardware design has\n{schema}\n\nWrite the query that answers the question below, as JSON of the form\n{form}\nand nothing else.\n\nQuestion: "), F.col("question"))
    return questions.select("question", text.alias("prompt"))


def parse_model_queries(responses: DataFrame) -> DataFrame:
    """(question, category, operation, seed_entities, params, problem) of ``responses(question, response)``.

    The JSON may stand within other text and be nested.  Without JSON, or with
    broken JSON, category is ``unknown`` and ``problem`` tells why; an unknown
    category or operation becomes ``unknown`` or ``module_context``.
    """
    body = F.regexp_extract("response", r"\{[\s\S]*\}", 0)
    schema = "category string, seed_entities array<string>, operation string, params map<string,string>, _broken string"
    read = F.from_json(body, schema, {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    rows = responses.select("question", F.when(body != "", read).alias("q"), (F.coalesce(body, F.lit("")) == "").alias("absent"))
    fine = ~F.col("absent") & F.col("q._broken").isNull()
    pick = lambda c, of, other: F.when(fine & F.col(c).isin(*of), F.col(c)).otherwise(other)
    return rows.select(
        "question", pick("q.category", CATEGORIES, "unknown").alias("category"), pick("q.operation", OPERATIONS, "module_context").alias("operation"),
        F.when(fine, F.coalesce("q.seed_entities", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("seed_entities"),
        F.when(fine, F.col("q.params")).alias("params"), F.when(F.col("absent"), "no JSON").when(~fine, "broken JSON").alias("problem"),
    )
