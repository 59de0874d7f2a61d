"""Histories of files and modules from commit rows; repeated rows of a commit count once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_history(commits: DataFrame) -> DataFrame:
    """(design, file, n_commits, last_modified, n_authors) of every changed file."""
    rows = commits.select("commit_id", "commit_date", "author", "design", F.explode("files_changed").alias("file"))
    return rows.groupBy("design", "file").agg(F.count_distinct("commit_id").alias("n_commits"), F.max("commit_date").alias("last_modified"), F.count_distinct("author").alias("n_authors"))


def file_lists(commits: DataFrame) -> DataFrame:
    """(design, file, kind, value): the authors and the commits of every changed file, a row each, so that no file's list has to fit anywhere."""
    rows = commits.select("commit_id", "author", "design", F.explode("files_changed").alias("file"))
    authors = rows.where("author is not null").select("design", "file", F.lit("author").alias("kind"), F.col("author").alias("value"))
    return authors.unionByName(rows.select("design", "file", F.lit("commit").alias("kind"), F.col("commit_id").alias("value"))).distinct()


def module_history(commits: DataFrame) -> DataFrame:
    """(design, module, change_frequency, last_modified, num_authors) of every modified module."""
    rows = commits.select("commit_id", "commit_date", "author", "design", F.explode("modules_modified").alias("module"))
    return rows.groupBy("design", "module").agg(F.count_distinct("commit_id").alias("change_frequency"), F.max("commit_date").alias("last_modified"), F.count_distinct("author").alias("num_authors"))


def top_files(commits: DataFrame, n: int = 5) -> DataFrame:
    """(design, file, n_commits): the most changed files of each design, ties by name."""
    rows = commits.select("commit_id", "design", F.explode("files_changed").alias("file")).groupBy("design", "file").agg(F.count_distinct("commit_id").alias("n_commits"))
    order = Window.partitionBy("design").orderBy(F.desc("n_commits"), "file")
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")
