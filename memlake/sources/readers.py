"""Sources: upload trees, JSON-line logs, staged tables, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.operators.steps import cut
from memlake.sources.lake import check_index

#: Names of files to index, in any case of the extension; other files are not opened.
UPLOADS = "*.{[tT][xX][tT],[mM][dD]}"


def plain_path(path: Column) -> Column:
    """A file's path as it is named: escapes of its URI undone (a plus is no escape), forward slashes, no scheme."""
    named = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.replace(F.coalesce(named, path), F.lit("\\"), F.lit("/")), r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")


def doc_id_of(path: Column, root: str) -> Column:
    """Path relative to the upload root, with forward slashes; the path itself where the root is not in it."""
    folder = "/" + root.replace("\\", "/").split(":", 1)[-1].strip("/") + "/"
    plain = plain_path(path)
    at = F.instr(plain, folder)
    return F.when(at > 0, F.substring(plain, at + len(folder), F.char_length(plain))).otherwise(plain)


def read_uploads(spark: SparkSession, root: str) -> DataFrame:
    """Whole ``.txt`` and ``.md`` files below a folder, in any case of the extension."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=UPLOADS)
    path = F.col("_metadata.file_path")
    return files.select(F.regexp_replace("value", "�", "").alias("text"), path.alias("path"), F.col("_metadata.file_size").alias("size_bytes"), doc_id_of(path, root).alias("doc_id"))


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files (file, line_no, value), numbered from 1 in each file, however many splits read it.

    A first pass counts the lines of each split; prefix sums over a file's splits, of which
    there are few, say where each begins; a line's place in its split does the rest.  Both
    passes read the same splits in the same order, as Spark plans them from the files alone.
    """
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    lines = lines.select("value", "_at", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    splits = lines.groupBy("file", "_start").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut(splits.select("file", "_start", "_first", F.coalesce(before, F.lit(0)).alias("_before")))
    numbered = lines.join(starts, ["file", "_start"])
    return numbered.select("file", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "value")


def read_json_lines(spark: SparkSession, path: str, project: str) -> DataFrame:
    """Numbered lines of a project's log for :func:`memlake.operators.questions.parse_log`."""
    return read_numbered_lines(spark, path).select(F.lit(project).alias("project_id"), "file", "line_no", "value")


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """Staged daily entries; the partitions of a project are read alone where it is asked for."""
    return spark.read.parquet(path).withColumn("project_id", F.col("project_id").cast("string"))


def read_messages(table: DataFrame) -> DataFrame:
    """Chat rows with their order in each project by (created_at, id)."""
    return table.withColumn("seq", F.row_number().over(Window.partitionBy("project_id").orderBy("created_at", "id")))


def read_index(spark: SparkSession, path: str, size: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Chunks of the projects whose index is sound, and (project_id, reason) of the projects to rebuild.

    What is on disk is checked against the manifest: rows, documents, dimension, finite
    vectors, gap-free numbers and the settings it was built with.
    """
    chunks, manifest = spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/manifest")
    checked = check_index(chunks, manifest, size, overlap)
    return chunks.join(checked.where("reason is null"), "project_id", "left_semi"), checked.where("reason is not null")
