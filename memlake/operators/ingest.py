"""Admission of files, index maintenance and tolerant parsing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.settings import Settings


def admit(files: DataFrame, existing: DataFrame, settings: Settings) -> DataFrame:
    """``reject_reason`` of each uploaded file: kind, file, batch or project limit; null if admitted.

    Sizes are counted once: rejected files use no room, admitted ones add to what the
    project already holds.
    """
    ok_kind = F.lower("filename").rlike(r"\.(txt|md)$")
    first = F.when(~ok_kind, "extension").when(F.col("size_bytes") > settings.max_file_bytes, "file_too_large")
    rows = files.withColumn("reason", first).withColumn("counted", F.when(F.col("reason").isNull(), F.col("size_bytes")).otherwise(0))
    batch = Window.partitionBy("project_id", "batch_id").orderBy("filename").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("batch_bytes", F.sum("counted").over(batch))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("batch_bytes") > settings.max_batch_bytes, "batch_too_large"))).withColumn("counted", F.when(F.col("reason").isNull(), F.col("size_bytes")).otherwise(0))
    held = existing.groupBy("project_id").agg(F.sum("size_bytes").alias("held"))
    project = Window.partitionBy("project_id").orderBy("batch_id", "filename").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(held, "project_id", "left").withColumn("project_bytes", F.sum("counted").over(project) + F.coalesce("held", F.lit(0)))
    return rows.select(*files.columns, F.coalesce("reason", F.when(F.col("project_bytes") > settings.max_project_bytes, "project_full")).alias("reject_reason"))


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in ``gone`` (consumed staging, deleted files)."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def lookup(items: DataFrame, ids: DataFrame, key: str = "item_id") -> DataFrame:
    """Each asked id with its row, nulls where there is none."""
    return ids.select(key).distinct().join(items, key, "left")


def restamp(entries: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Entries of the active model, and entries to embed again under its name."""
    same = F.coalesce(F.col("embedding_model") == model, F.lit(False))
    return entries.where(same), entries.where(~same).withColumn("embedding_model", F.lit(model))


def balanced_json(rows: DataFrame, text: str, out: str = "json") -> DataFrame:
    """First balanced JSON object in noisy text, null if there is none; braces in strings do not count."""

    def find(s: str | None) -> str | None:
        decoder, at = json.JSONDecoder(), 0
        while s is not None and (at := s.find("{", at)) >= 0:
            try:
                return s[at : decoder.raw_decode(s, at)[1]]
            except ValueError:
                at += 1
        return None

    schema = f"{', '.join(f'`{n}` {t}' for n, t in rows.drop(out).dtypes)}, `{out}` string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame[out] = [find(s) for s in frame[text]]
            yield frame

    return rows.drop(out).mapInPandas(run, schema)


def tagger_fields(rows: DataFrame, column: str = "json") -> DataFrame:
    """Typed, defaulted fields of a tagger's JSON answer."""
    schema = "topics string, intent string, type string, semantic_handle string, questions array<struct<question:string,topic:string,resolution:string>>"
    from memlake.functions import text as tx

    j = rows.withColumn("j", F.from_json(column, schema))
    text = lambda c: F.trim(F.coalesce(F.col(f"j.{c}"), F.lit("")))
    empty = F.array().cast("array<struct<question:string,topic:string,resolution:string>>")
    return j.select(*rows.columns, text("topics").alias("topics"), text("intent").alias("intent"), text("type").alias("type"), tx.snake_case(text("semantic_handle")).alias("semantic_handle"), tx.clean_questions(F.coalesce(F.col("j.questions"), empty)).alias("questions"))
