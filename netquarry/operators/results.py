"""What is asked of impact results, and of answers against their questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netquarry.operators import metrics

QUESTION_SCHEMA = (
    "question_id string, question_text string, category string, difficulty string, hops_required int, gold_answer string, "
    "evidence_nodes array<string>, evidence_edges array<array<string>>, design_name string"
)


def of_type(result: DataFrame, *types: str) -> DataFrame:
    """The artifacts of some types."""
    return result.where(F.col("artifact_type").isin(*types))


def at_hop(result: DataFrame, hop: int) -> DataFrame:
    """The artifacts at one distance."""
    return result.where(F.col("hop") == hop)


def top_k(result: DataFrame, k: int = 10, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """The ``k`` artifacts of highest risk of each run, then of smallest distance and id, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("risk"), "hop", "node")
    return result.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def counts_by_type(result: DataFrame, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """How many artifacts of each type a run has."""
    return result.groupBy(*keys, "artifact_type").agg(F.count_distinct("node").alias("n"))


def artifact_ids(result: DataFrame, type_: str | None = None, keys: tuple[str, ...] = ("run",)) -> DataFrame:
    """The distinct ids of each run, of one type or of all."""
    return (result if type_ is None else of_type(result, type_)).select(*keys, "node").distinct()


def evaluate(questions: DataFrame, results: DataFrame) -> DataFrame:
    """Answer scores of ``results(question_id, method, answer, retrieved, ...)`` against ``questions(question_id, gold, evidence, category, difficulty)``.

    Results of unknown questions are left out.
    """
    wanted = questions.select("question_id", "gold", "evidence", "category", "difficulty")
    return metrics.answer_scores(results.join(wanted, "question_id"))


def save_questions(questions: DataFrame, path: str) -> None:
    """Write questions as JSON, a line each, in ``QUESTION_SCHEMA``'s columns."""
    questions.select("question_id", "question_text", "category", "difficulty", "hops_required", "gold_answer", "evidence_nodes", "evidence_edges", "design_name").write.json(path)


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSON lines or of files with one JSON array; absent lists are empty, an absent design is an empty text."""
    rows = spark.read.schema(QUESTION_SCHEMA).json(path, multiLine=True)
    empty = F.array()
    return rows.withColumn("evidence_nodes", F.coalesce("evidence_nodes", empty.cast("array<string>"))).withColumn("evidence_edges", F.coalesce("evidence_edges", empty.cast("array<array<string>>"))).fillna("", ["design_name"])


def save_results(result: DataFrame, path: str, by: str | None = None) -> None:
    """Write results as JSON lines, in one folder per value of ``by`` if it is given."""
    (result.write.partitionBy(by) if by else result.write).json(path)
