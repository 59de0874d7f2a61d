"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquarry.functions import scalars
from netquarry.llm import canonical, contamination, identity, packing, pairs, sentences, topn
from netquarry.scratch import load


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five artifacts of highest risk of each set of changed nodes."""
    rows = load(spark, sf_dir, "impacted_artifacts").where("changed_nodes is not null")
    group = F.array_join(F.array_sort(F.array_distinct(F.array_compact("changed_nodes"))), "|")
    top = topn.top_n(rows, group, F.col("node_id"), F.col("risk_score"), F.col("hop_distance"), 5)
    return top.select("group_key", "rank_no", F.col("identifier").alias("node_id"))


def _typed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(constraint_id, target_pos, value) of every typed target, repeats removed."""
    rows = load(spark, sf_dir, "sdc_constraints")
    every = rows.select("constraint_id", F.posexplode(F.coalesce("targets", scalars.get_targets(F.col("raw_line")))).alias("target_pos", "value"))
    return every.where("constraint_id is not null and value is not null").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference entry of every target that is not written as one."""
    refs = load(spark, sf_dir, "target_names")
    typed = _typed_targets(spark, sf_dir).join(refs.select(F.col("canonical_name").alias("value")), "value", "left_anti")
    found = canonical.match_names(typed, refs).select("value", "ref_id")
    out = typed.join(found, "value", "left")
    return out.select("constraint_id", "target_pos", F.coalesce("ref_id", F.lit(-1).cast("bigint")).alias("ref_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defective question-answer pairs with their defect."""
    rows = load(spark, sf_dir, "qa_results").select(F.col("qa_id").alias("pair_id"), "question", "answer")
    return pairs.first_defects(rows).select(F.col("pair_id").alias("qa_id"), "defect")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of author identities of one person or team."""
    rows = load(spark, sf_dir, "author_identities")
    records = rows.select(F.col("identity_id").alias("identity"), F.col("author").alias("name"), F.col("author_email").alias("mail"))
    return identity.linked_pairs(identity.resolve(records))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every text, filled to the sources' shares of all tokens."""
    return packing.pack_texts(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def p8_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are and how close to the sources' shares, at the beginning, middle and end."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = packing.deviations(packing.pack_texts(docs), docs)
    return out.select("third", "containers", F.round("filled", 4).alias("filled"), F.round("deviation", 4).alias("deviation"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation items that leaked into each document."""
    items = load(spark, sf_dir, "eval_items")
    texts = items.select("item_id", F.explode(F.array("question_text", "gold_answer")).alias("text"))
    return contamination.find_leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), texts)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every document."""
    return sentences.split_sentences(load(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found,
    "p8_packed": p8_packed, "p8_thirds": p8_thirds, "p9_found": p9_found, "p10_found": p10_found,
}

SQL = {
    "p3_found": """
WITH rows AS (
  SELECT array_to_string(list_sort(list_distinct(changed_nodes)), '|') AS group_key, node_id, risk_score, hop_distance
  FROM impacted_artifacts WHERE risk_score IS NOT NULL AND NOT isnan(risk_score) AND node_id IS NOT NULL AND changed_nodes IS NOT NULL),
best AS (
  SELECT group_key, node_id, max(risk_score) AS s, arg_min(hop_distance, (-risk_score, coalesce(hop_distance, 2147483647))) AS hop
  FROM rows GROUP BY 1, 2),
ranked AS (
  SELECT group_key, node_id, row_number() OVER (PARTITION BY group_key ORDER BY s DESC, hop ASC NULLS LAST, node_id) AS rank_no FROM best)
SELECT group_key, CAST(rank_no AS INTEGER) AS rank_no, node_id FROM ranked WHERE rank_no <= 5""",
}
