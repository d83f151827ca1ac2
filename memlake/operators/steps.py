"""Cut points of plans that use a result more than once: tables in a folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one of this machine only with a local master, else an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="memlake-"))
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Computed once: written as a table and read again, so that a lost executor costs a re-read.

    The table stays, since frames made from it are lazy; the folder is the cluster's to clean.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
