"""Documents to chunk rows with vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.functions import text as tx
from memlake.operators.scans import MOST, Running, hot_groups, running, same_keys
from memlake.operators.steps import cut


class Embedder(Protocol):
    """What an embedding model must offer; it is made once in each Python worker."""

    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class _Places(dict):
    """Word to place, found once for each distinct word."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, word: str) -> int:
        place = self[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dims
        return place


class HashEmbedder:
    """Word counts hashed into ``dims`` places, scaled to length one; offline and deterministic."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        words, places = [t.lower().split() for t in texts], _Places(self.dims)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(places.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
        out = np.bincount(np.repeat(np.arange(len(words)) * self.dims, lengths) + at, minlength=len(words) * self.dims).reshape(len(words), self.dims).astype(float)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


def with_text(rows: DataFrame) -> DataFrame:
    """Rows whose text to embed (``embed_text``, else ``text``) is not blank."""
    return rows.withColumn("to_embed", F.coalesce(F.nullif("embed_text", F.lit("")), F.col("text"))).where(F.col("to_embed").rlike(r"\S"))


def chunk(docs: DataFrame, size: int, overlap: int, text: str = "text") -> DataFrame:
    """One row for each window, numbered after blank windows are dropped.  No shuffle."""
    return docs.select(*(c for c in docs.columns if c != text), F.posexplode(tx.windows(tx.normalize_lf(F.col(text)), size, overlap)).alias("chunk_index", "chunk"))


def embed(rows: DataFrame, text: str, make: Callable[[], Embedder], vector: str = "vector", keep: bool = True) -> DataFrame:
    """Add a vector column by a model, batch by batch; a change of dimension stops the job.

    Without ``keep`` the text does not come back from Python.
    """
    rows = rows.drop(vector)
    back = [c for c in rows.columns if keep or c != text]
    schema = T.StructType([*(rows.schema[c] for c in back), T.StructField(vector, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or make()
            found = np.asarray(model.embed([t or "" for t in batch.column(text).to_pylist()]), float).reshape(batch.num_rows, -1)
            if batch.num_rows and found.shape[1] != model.dims:
                raise ValueError(f"a vector has {found.shape[1]} places, not {model.dims}")
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * model.dims
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in back), pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def token_batches(rows: DataFrame, by: list[str], order: list[str], tokens: str, budget: int, most: int = MOST) -> DataFrame:
    """Batch number of each row: a new batch starts where the budget would be exceeded.

    A batch that holds no token yet takes any row.  A running sum that resets is no window
    function: rows of a group stream through a task in order and one batch's sum is all
    that is held.  Groups of more than ``most`` rows are batched by :func:`_linked_batches`
    instead, so that none is one task's work.
    """
    rows = rows.drop("batch_id")
    schema = T.StructType([*rows.schema.fields, T.StructField("batch_id", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, number = None, 0, 0
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            ids = []
            for key, n in zip(keys, batch.column(tokens).to_pylist(), strict=True):
                if key != last:
                    last, used, number = key, 0, 0
                elif used + n > budget and used:
                    number, used = number + 1, 0
                used += n
                ids.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=schema.names)

    plain = lambda part: part.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
    hot = hot_groups(rows, by, most)
    if hot is None:
        return plain(rows)
    hot = cut(hot)
    linked = _linked_batches(same_keys(rows, hot, by, "left_semi"), by, order, tokens, budget, most)
    return plain(same_keys(rows, hot, by, "left_anti")).unionByName(linked)


def _linked_batches(rows: DataFrame, by: list[str], order: list[str], tokens: str, budget: int, most: int) -> DataFrame:
    """The same numbers without a task a group.

    With prefix sums, the row that would start the batch after one that starts here is
    found by merging the sums with the sums at which budgets end, in one scan of both.
    The true starts are those on the chain from the first row: each round doubles the
    length of the links, and with them the starts known, so rounds grow with the logarithm
    of a group's rows.
    """
    at = Running(sums={"_pos": F.lit(1), "_upto": F.col(tokens)}, inclusive=True)
    placed = cut(running(rows, by, order[0], at, ties=tuple(order[1:]), most=most))
    before = F.col("_upto") - F.col(tokens)
    # Rows up to a sum come in front of the question that asks for it; it ends up with their number.
    sums = placed.select(*by, F.col("_upto").alias("_sum"), F.lit(0).alias("_asks"), F.lit(None).cast("long").alias("_pos"), F.lit(1).alias("_one"), F.lit(None).cast("long").alias("_before"))
    asked = placed.select(*by, (before + budget).alias("_sum"), F.lit(1).alias("_asks"), "_pos", F.lit(0).alias("_one"), before.alias("_before"))
    merged = running(sums.unionByName(asked), by, "_sum", Running(sums={"_fit": F.col("_one")}, inclusive=True), ties=("_asks",), most=most)
    links = merged.where("_asks = 1").select(*by, "_pos", (F.col("_fit") + 1).alias("_next"), "_before")
    # Where everything from here up to that row is empty, that row still fits, and the one behind it starts.
    sum_before = placed.select(*by, F.col("_pos").alias("_next"), before.alias("_next_before"))
    links = same_keys(links, sum_before, [*by, "_next"], "left").withColumn("_next", F.when(F.col("_next_before").isNull(), None).when(F.col("_next_before") > F.col("_before"), F.col("_next")).otherwise(F.col("_next") + 1))
    links = cut(links.where("_next is not null").select(*by, "_pos", "_next"))
    starts = cut(placed.where("_pos = 1").select(*by, "_pos"))
    while True:
        reached = same_keys(starts, links, [*by, "_pos"], "inner").select(*by, F.col("_next").alias("_pos"))
        more = cut(starts.unionByName(reached).distinct())
        if more.count() == starts.count():
            break
        starts = more
        ahead = links.select(*by, F.col("_pos").alias("_next"), F.col("_next").alias("_after"))
        links = cut(same_keys(links, ahead, [*by, "_next"], "inner").select(*by, "_pos", F.col("_after").alias("_next")))
    marked = same_keys(placed, starts.withColumn("_start", F.lit(1)), [*by, "_pos"], "left")
    numbered = running(marked, by, "_pos", Running(sums={"batch_id": F.coalesce("_start", F.lit(0))}, inclusive=True), most=most)
    return numbered.withColumn("batch_id", F.col("batch_id") - 1).select(*rows.columns, "batch_id")


def rebuild_text(chunks: DataFrame, by: list[str], index: str = "chunk_index", text: str = "chunk") -> DataFrame:
    """A document's text from its chunks, joined by line ends in index order."""
    return chunks.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(index, text))), lambda s: s[text]), "\n").alias("text"))


def neighbours(chunks: DataFrame, by: list[str], index: str, item: str) -> DataFrame:
    """Previous and next item of each document's sequence."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(index)
    return chunks.withColumn("prev_item", F.lag(item).over(w)).withColumn("next_item", F.lead(item).over(w))


def contiguous(chunks: DataFrame, project: str, doc: str, index: str) -> DataFrame:
    """Projects whose documents are all numbered 0..n-1; one gap costs the whole project its neighbours."""
    docs = chunks.groupBy(project, doc).agg(F.min(index).alias("lo"), F.max(index).alias("hi"), F.count(index).alias("n"), F.countDistinct(index).alias("d"))
    return docs.groupBy(project).agg(F.bool_and((F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1) & (F.col("d") == F.col("n"))).alias("expandable"), F.count(F.lit(1)).alias("documents"))


def stale_projects(manifest: DataFrame, size: int, overlap: int, adjacency: DataFrame) -> DataFrame:
    """Projects whose index was built with other settings or has broken adjacency."""
    return manifest.join(adjacency, "project_id", "left").where((F.col("chunk_size") != size) | (F.col("chunk_overlap") != overlap) | ~F.coalesce("expandable", F.lit(False))).select("project_id")
