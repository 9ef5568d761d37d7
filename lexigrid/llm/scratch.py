"""Tables written to the shared folder of the cluster, to cut lineage without executor-local state."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lexigrid.workers import reachable  # noqa: F401 - operators import it from here


def folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Where it is unset, a session in one process, as in tests, gets a temporary
    one; a cluster has no folder then that all its machines see, which is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lexigrid-")
        spark.conf.set("spark.checkpoint.dir", path)
    jvm = spark.sparkContext._jvm
    raw = jvm.org.apache.hadoop.fs.Path(path)
    full = raw.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(raw).toString()
    return ("file://" + full[len("file:") :] if full.startswith("file:/") and not full.startswith("file://") else full).rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again; a lost executor costs no recomputation. What a result is read
    from stays until the folder's owner clears it; `discard` deletes what no later step reads."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
