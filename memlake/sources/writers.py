"""Sinks: partitioned indexes, staging, artifacts, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.operators.steps import cut
from memlake.sources.lake import manifest_of


def overwrite_projects(rows: DataFrame, path: str) -> None:
    """Replace only the partitions of the projects that ``rows`` holds."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def rebuild_index(chunks: DataFrame, path: str, size: int, overlap: int, dims: int) -> DataFrame:
    """Write chunks with vectors, then one manifest row a project, of what the chunks were; the manifest comes last."""
    chunks = cut(chunks)
    overwrite_projects(chunks, f"{path}/chunks")
    manifest = manifest_of(chunks, size, overlap, dims)
    overwrite_projects(manifest, f"{path}/manifest")
    return manifest


def append_entries(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("project_id").parquet(path)


def overwrite_staging(rows: DataFrame, path: str) -> None:
    """Staged entries anew; written whole, since a project may have none left.

    Rows are written apart first: they may be read from the very table that they replace.
    """
    cut(rows).write.mode("overwrite").partitionBy("project_id").parquet(path)


def append_questions(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_telemetry(rows: DataFrame, path: str, batch: int) -> None:
    """Telemetry rows of one batch; a batch that is repeated after a failure replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def write_artifacts(docs: DataFrame, path: str) -> None:
    """Text files, one a document, below ``project_id=.../name=...``; documents of other names stay."""
    rows = docs.select("project_id", "name", F.col("content").alias("value"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "name").text(path)


def clear_consumed(staging: DataFrame, consumed: DataFrame, verified: bool) -> DataFrame:
    """Staging without consumed rows; unchanged unless the rebuild was verified."""
    return staging.join(consumed.select("project_id", "day_sequence"), ["project_id", "day_sequence"], "left_anti") if verified else staging
