"""Statistics of projects, files and cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_stats(entries: DataFrame) -> DataFrame:
    """Bytes, tokens and entries of each project's daily store."""
    return entries.groupBy("project_id").agg(F.sum(F.octet_length("text")).alias("daily_bytes"), F.sum("tokens").alias("daily_tokens"), F.count(F.lit(1)).alias("daily_entries"))


def file_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("project_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size_bytes").alias("storage_bytes"), F.sum("token_count").alias("file_tokens"))


def file_stats(chunks: DataFrame) -> DataFrame:
    """Tokens and highest page of each file."""
    return chunks.groupBy("project_id", "filename").agg(F.sum("tokens").alias("token_count"), F.max("page_number").alias("page_count"))


def project_stats(parts: list[DataFrame]) -> DataFrame:
    """All partial statistics of a project in one row, zeros where a part has none."""
    whole = reduce(lambda a, b: a.join(b, "project_id", "full_outer"), parts)
    return whole.fillna(0)


def active_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("project_id").agg(F.count(F.lit(1)).alias("active_pairs"))


def lake_totals(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count_distinct("project_id").alias("projects"), F.count(F.lit(1)).alias("messages"))


def backfill(files: DataFrame, stats: DataFrame) -> DataFrame:
    """Files with token and page counts of the last rebuild; those it did not see keep their own."""
    fresh = stats.select("project_id", "filename", F.col("token_count").alias("t"), F.col("page_count").alias("p"))
    rows = files.join(fresh, ["project_id", "filename"], "left")
    return rows.withColumn("status", F.when(F.col("t").isNotNull(), "indexed").otherwise(F.col("status"))).withColumn("token_count", F.coalesce("t", "token_count")).withColumn("page_count", F.coalesce("p", "page_count")).drop("t", "p")


def cycle_summary(outcomes: DataFrame) -> DataFrame:
    """Totals of a cycle; one failed project makes it partial."""
    rows = outcomes.agg(F.sum("items_in").alias("items_in"), F.sum("items_out").alias("items_out"), F.count_if(F.col("status") == "done").alias("processed"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"))
    return rows.withColumn("status", F.when(F.col("failed") > 0, "partial").otherwise("complete"))


def expansion_summary(rows: DataFrame) -> DataFrame:
    """Rows by status and method, and how many were cut."""
    return rows.groupBy("status", "method").agg(F.count(F.lit(1)).alias("n"), F.count_if("truncated").alias("truncated"))
