"""Ranking and answer metrics as grouped aggregations.

Zero denominators give 0 throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netquarry.functions import scalars
from netquarry.operators import skew


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and precision, recall, f1 of ``predicted(*keys, node)`` against ``truth(*keys, node)`` per key.

    Repeats count once; a key that occurs on one side only is kept.
    """
    p = predicted.select(*keys, "node").distinct().withColumn("p", F.lit(1))
    t = truth.select(*keys, "node").distinct().withColumn("t", F.lit(1))
    both = p.join(t, [*keys, "node"], "full")
    out = both.groupBy(*keys).agg(
        F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull()).alias("fn"),
    )
    return with_scores(out)


def with_scores(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn."""
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def ranking(predicted: DataFrame, truth: DataFrame, keys: list[str], cutoffs: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """recall_at_k, ndcg_at_k and mrr per key of ``predicted(*keys, node, risk, hop)``, ranked by risk, hop and id; a key of any size is spread over tasks."""
    ranked = skew.ranked(predicted.select(*keys, "node", "risk", "hop"), keys, [F.desc("risk"), F.col("hop"), F.col("node")], "rank")
    wanted = truth.select(*keys, "node").distinct()
    sizes = wanted.groupBy(*keys).agg(F.count("*").alias("n_truth"))
    hits = ranked.join(wanted.withColumn("rel", F.lit(1)), [*keys, "node"], "left")
    gain = 1 / F.log2(F.col("rank") + 1)
    aggs = [F.coalesce(F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr")]
    for k in cutoffs:
        aggs.append(F.count_if((F.col("rel") == 1) & (F.col("rank") <= k)).alias(f"hits_{k}"))
        aggs.append(F.coalesce(F.sum(F.when((F.col("rel") == 1) & (F.col("rank") <= k), gain)), F.lit(0.0)).alias(f"dcg_{k}"))
    out = sizes.join(hits.groupBy(*keys).agg(*aggs), keys, "left").fillna(0)
    for k in cutoffs:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_truth"), F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        out = out.withColumn(f"recall_at_{k}", ratio(F.col(f"hits_{k}"), F.col("n_truth"))).withColumn(f"ndcg_at_{k}", ratio(F.col(f"dcg_{k}"), ideal)).drop(f"hits_{k}", f"dcg_{k}")
    return out


def per_type(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and f1 per key and artifact type, for the types that the truth has."""
    scored = confusion(predicted, truth, [*keys, "artifact_type"])
    return scored.join(truth.select(*keys, "artifact_type").distinct(), [*keys, "artifact_type"], "left_semi")


def per_hop(predicted: DataFrame, truth: DataFrame, keys: list[str], hops: int = 5) -> DataFrame:
    """The share of the predictions at each hop 1..``hops`` that is true, 0 where there is none."""
    wanted = truth.select(*keys, "node").distinct().withColumn("rel", F.lit(1))
    hit = predicted.select(*keys, "node", "hop").join(wanted, [*keys, "node"], "left")
    rates = hit.groupBy(*keys, "hop").agg(F.avg(F.when(F.col("rel") == 1, 1.0).otherwise(0.0)).alias("rate"))
    every = predicted.select(*keys).distinct().withColumn("hop", F.explode(F.sequence(F.lit(1), F.lit(hops))))
    return every.join(rates, [*keys, "hop"], "left").fillna(0.0, ["rate"])


def macro(scored: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """Means of ``values`` over all rows, and by each prefix of ``groups``, in one pass; null marks a total."""
    return scored.rollup(*groups).agg(F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values])


def mean_of_means(scored: DataFrame, keys: list[str], unit: str, values: list[str]) -> DataFrame:
    """Unweighted means, over the units, of each unit's own means: a large unit counts as much as a small one."""
    per = scored.groupBy(*keys, unit).agg(*[F.avg(v).alias(v) for v in values])
    return per.groupBy(*keys).agg(F.count("*").alias("n_units"), *[F.avg(v).alias(v) for v in values])


def answer_scores(rows: DataFrame) -> DataFrame:
    """Token f1, evidence recall and precision and entity recall of ``answer, gold, evidence, retrieved`` columns.

    No retrieval gives evidence scores of 0; no expected evidence or entity gives a
    recall of 0.  ``hallucinated`` is always false: without a judge nothing can
    tell it.
    """
    a, g = scalars.word_set(F.col("answer")), scalars.word_set(F.col("gold"))
    common = F.size(F.array_intersect(a, g))
    p, r = ratio(common, F.size(a)), ratio(common, F.size(g))
    empty = F.array().cast("array<string>")
    want, got = F.array_distinct(F.coalesce("evidence", empty)), F.array_distinct(F.coalesce("retrieved", empty))
    found = F.size(F.array_intersect(want, got))
    entities = scalars.key_entities(F.col("gold"))
    heard = F.size(F.filter(entities, lambda e: F.contains(F.lower(F.coalesce("answer", F.lit(""))), e)))
    return rows.select(
        "*",
        ratio(2 * p * r, p + r).alias("token_f1"),
        ratio(found, F.size(want)).alias("evidence_recall"),
        ratio(found, F.size(got)).alias("evidence_precision"),
        ratio(heard, F.size(entities)).alias("entity_recall"),
        F.lit(False).alias("hallucinated"),
    )


def answer_summary(scored: DataFrame, by: list[str]) -> DataFrame:
    """Means of the answer scores over all rows and by each of ``by`` alone (grouping sets); ``axis`` names the grouping."""
    values = ["token_f1", "evidence_recall", "evidence_precision", "entity_recall"]
    means = [F.avg(v).alias(v) for v in values]
    out = scored.agg(F.count("*").alias("n"), *means).select(F.lit("all").alias("axis"), F.lit("").alias("label"), "n", *values)
    for c in by:
        part = scored.groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n"), *means)
        out = out.unionByName(part.select(F.lit(c).alias("axis"), "label", "n", *values))
    return out
