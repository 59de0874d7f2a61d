"""Commit histories: a data source over a git repository, and linking to the graph.

``spark.dataSource.register(GitLog)`` makes ``spark.read.format("git_log")``
available with the options ``path``, ``limit`` (500) and ``branch`` (HEAD).  Where no
repository is at hand the same rows come from any table with its schema.
"""

from __future__ import annotations

import datetime
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from netquarry.functions import scalars as S

SCHEMA = "sha string, author string, author_email string, commit_date timestamp, message string, files_changed array<string>, insertions int, deletions int"
_MARK, _SEP = "\x1e", "\x1f"


def parse_log(text: str) -> Iterator[tuple]:
    """Rows of ``git log`` output in the form that ``GitLogReader`` asks for."""
    for record in text.split(_MARK)[1:]:
        head, _, tail = record.partition(_SEP + "\n")
        sha, author, email, when, message = head.split(_SEP, 4)
        files, added, removed = [], 0, 0
        for line in tail.splitlines():
            parts = line.split("\t")
            if len(parts) == 3:
                added += int(parts[0]) if parts[0].isdigit() else 0
                removed += int(parts[1]) if parts[1].isdigit() else 0
                files.append(parts[2])
        yield sha, author, email, datetime.datetime.fromtimestamp(int(when), datetime.timezone.utc), message.strip(), files, added, removed


class GitLogReader(DataSourceReader):
    """Reads the first-parent differences of the newest commits of a branch."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """A log is one stream, so it is one partition."""
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Rows by date, newest first."""
        form = f"--format={_MARK}%H{_SEP}%an{_SEP}%ae{_SEP}%ct{_SEP}%B{_SEP}"
        argv = ["git", "-C", self.options["path"], "log", "--numstat", "--root", "--first-parent", "-m", f"-n{int(self.options.get('limit', 500))}", form, self.options.get("branch", "HEAD")]
        yield from parse_log(subprocess.run(argv, capture_output=True, text=True, check=True, errors="replace").stdout)


class GitLog(DataSource):
    """The ``git_log`` format."""

    @classmethod
    def name(cls) -> str:
        """Its name."""
        return "git_log"

    def schema(self) -> str:
        """Its columns."""
        return SCHEMA

    def reader(self, schema) -> GitLogReader:
        """Its reader."""
        return GitLogReader(self.options)


def describe(log: DataFrame, design: str | None = None, globs: list[str] | None = None, module_files: DataFrame | None = None) -> DataFrame:
    """Commit rows with ids, summaries, classes and the modules of their files, of one design or of those in a column ``design``.

    ``globs`` keeps commits that touch a matching file; ``module_files(file, module)``
    names the modules of files, others are named by the stem of a source file.
    """
    if globs:
        log = log.where(F.size(S.keep_matching(F.col("files_changed"), globs)) > 0)
    log = log.withColumn("design", F.lit(design)) if design is not None else log
    rows = log.withColumn("short_sha", F.substring("sha", 1, 8)).withColumn("commit_id", F.concat_ws("::", "design", F.lit("commit"), F.substring("sha", 1, 8)))
    rows = rows.withColumn("summary", F.split("message", "\n")[0]).withColumn("change_type", S.commit_class(F.col("message")))
    files = rows.select("commit_id", F.explode("files_changed").alias("file"))
    if module_files is not None:
        files = files.join(module_files.select("file", "module"), "file", "left")
    else:
        files = files.withColumn("module", F.lit(None).cast("string"))
    named = files.select("commit_id", F.coalesce("module", S.module_of_file(F.col("file"))).alias("module")).where("module is not null")
    return rows.join(named.groupBy("commit_id").agg(F.array_sort(F.collect_set("module")).alias("modules_modified")), "commit_id", "left")


def module_file_map(modules: DataFrame) -> DataFrame:
    """(file, module) of modules with a known source."""
    return modules.where("src_file is not null").select(F.col("src_file").alias("file"), F.col("module_name").alias("module")).distinct()


def to_graph(commits: DataFrame, nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Node and edge batches: commits and the modules of their design that they modify, both ways."""
    modules = nodes.where("type = 'Module'").select("design", F.col("id").alias("module_id"), F.col("name").alias("module"))
    touched = commits.select("commit_id", "design", F.explode("modules_modified").alias("module")).join(modules, ["design", "module"])
    edge = lambda src, dst, rel: touched.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(rel).alias("relation")).distinct()
    node = commits.select(F.col("commit_id").alias("id"), F.lit("Commit").alias("type"), F.col("summary").alias("name"), "design", "summary", "message")
    return [node], [edge("commit_id", "module_id", "modifies"), edge("module_id", "commit_id", "modified_by")]
