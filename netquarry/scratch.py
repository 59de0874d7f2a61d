"""Tables written to the folder that all executors share, to cut lineage.

A lost executor never loses such a table, unlike a persisted or locally
checkpointed one.  The folder is the session's ``spark.checkpoint.dir``; only a
session that runs in one process and leaves it unset (tests, a laptop) gets a
temporary folder.  Tables of one application are in a folder of their own:
operators drop what they no longer read, ``clear`` deletes the rest once results
are written.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """Folder for intermediate tables, with a scheme if the session gives one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="netquarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/netquarry-{spark.sparkContext.applicationId}"


def table(df: DataFrame, tag: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder as parquet and return it read back."""
    return parts(df, tag, None)


def parts(df: DataFrame, tag: str, by: str | None) -> DataFrame:
    """As ``table``, in one folder per value of ``by``, so that a filter on it reads only its own part."""
    path = f"{root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete every table that this application has written; results that read them must be written before."""
    if spark.conf.get("spark.checkpoint.dir", None):
        _delete(spark, root(spark))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
