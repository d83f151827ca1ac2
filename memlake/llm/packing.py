"""Best-fit packing of documents into sequences by length patterns (operator 10).

1. Encode every document, append the end id, cut only what is longer than a
   sequence.  Each task numbers its pieces of each length.
2. The histogram of lengths (at most ``capacity`` numbers) goes to the driver.
   Patterns of one to three lengths that fill a sequence exactly are enumerated
   and repeat counts fitted to the histogram by non-negative least squares
   (accelerated projected gradient), then rounded so that no length is overdrawn.
3. What is left is packed by best fit, longest first, on the histogram.
4. Each pattern is a run of equal sequences, so a piece finds its sequence and
   offset from its length and its rank among pieces of that length.  Runs are
   bounded by the number of patterns, not by the data.

No document data passes through the driver.  Null texts are empty documents (only
the end id); texts of more tokens than a sequence holds are cut into pieces; equal ids and
repeated rows are packed as documents of their own, ties among pieces of a length go by
task and order; an empty table has no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.storage import bounded_batches, materialize
from memlake.llm.tokens import library, slices

#: Steps of the least-squares fit; the fit only guides rounding, best fit packs the rest.
FIT_STEPS = 300
PIECES = T.StructType(
    [T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("task", T.LongType()), ("nth", T.LongType()))]
)


def enumerate_patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """Rows (a >= b >= c, zeros for absent) of lengths that occur and fill ``capacity`` exactly."""
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    rows = [np.array([[capacity, 0, 0]])] if has[capacity] else []
    b = np.arange(1, capacity // 2 + 1)
    b = b[has[b] & has[capacity - b]]
    rows.append(np.stack([capacity - b, b, np.zeros_like(b)], 1))
    small = present[(present > 0) & (present <= capacity // 2)]
    c, b = np.meshgrid(small[small <= capacity // 3], small, indexing="ij")
    c, b = c.ravel(), b.ravel()
    a = capacity - b - c
    ok = (c <= b) & (b <= a)
    ok[ok] = has[a[ok]]
    rows.append(np.stack([a[ok], b[ok], c[ok]], 1))
    return np.concatenate(rows).astype(np.int64)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative least squares: repeats x of the patterns with A x near the histogram.

    Longer lengths weigh more, since short pieces fill gaps more easily.  A is never
    built: a product with it is a sum over the pattern's three lengths.
    """
    size = len(histogram)
    weight = np.linspace(0.1, 1.0, size)
    weight[0] = 0.0
    rows = [patterns[:, k] for k in range(3)]

    def times(x):
        return sum(np.bincount(r, x, size) for r in rows) * weight

    def back(y):
        y = y * weight
        return sum(y[r] for r in rows)

    target = histogram * weight
    v = np.ones(len(patterns))
    for _ in range(12):  # largest eigenvalue, for the step
        v = back(times(v))
        scale = np.linalg.norm(v)
        if not scale:
            return np.zeros(len(patterns))
        v /= scale
    step = 1.0 / (scale * 1.02)
    x = z = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, z - step * back(times(z) - target))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def round_counts(patterns: np.ndarray, fitted: np.ndarray, histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeats that use no length more often than it occurs.

    The fractions of consecutive patterns are carried on, so many patterns with
    small fits are not all rounded to nothing.
    """
    left = histogram.copy()
    carried = np.floor(np.cumsum(fitted) + 0.5).astype(np.int64)
    want = np.diff(np.concatenate([[0], carried]))
    out = []
    for i in np.flatnonzero(want):
        lengths = tuple(int(n) for n in patterns[i] if n)
        need = {n: lengths.count(n) for n in lengths}
        times = min(int(want[i]), *(int(left[n]) // k for n, k in need.items()))
        if times > 0:
            out.append((lengths, times))
            for n, k in need.items():
                left[n] -= k * times
    histogram[:] = left
    return out


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts of lengths; consumes the histogram.

    Opens as many equal sequences as possible at once, so the work depends on the
    number of lengths, not on the number of pieces.
    """
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    rooms = np.zeros(capacity + 1, bool)
    for n in range(capacity, 0, -1):
        todo = int(histogram[n])
        while todo:
            fit = np.flatnonzero(rooms[n:])
            if not len(fit):
                break
            room = n + int(fit[0])
            group = open_[room]
            pattern, times = group.popitem()
            used = min(times, todo)
            if used < times:
                group[pattern] = times - used
            if not group:
                rooms[room] = False
            rest = open_.setdefault(room - n, {})
            rest[(*pattern, n)] = rest.get((*pattern, n), 0) + used
            rooms[room - n] = room > n
            todo -= used
        if todo:
            each = capacity // n
            for k, times in ((each, todo // each), (todo % each, 1)):
                if k and times:
                    group = open_.setdefault(capacity - k * n, {})
                    group[(n,) * k] = group.get((n,) * k, 0) + times
                    rooms[capacity - k * n] = capacity > k * n
        histogram[n] = 0
    return [(p, t) for group in open_.values() for p, t in group.items()]


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with repeats that together hold every piece exactly once: the fitted ones, then best fit for the rest."""
    rest = histogram.astype(np.int64).copy()
    patterns = enumerate_patterns(capacity, np.flatnonzero(rest))
    fitted = round_counts(patterns, fit_counts(patterns, rest.astype(float)), rest) if len(patterns) else []
    return fitted + best_fit(rest, capacity)


def runs(plan_: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length its runs of ranks: first rank, first sequence and offset, sorted for search."""
    next_rank = np.zeros(capacity + 1, np.int64)
    out, sequence = [], 0
    for lengths, times in plan_:
        offset = 0
        for n in lengths:
            out.append((n, int(next_rank[n]), sequence, offset))
            next_rank[n] += times
            offset += n
        sequence += times
    table = np.array(out, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return {"at": table[:, 0] << 44 | table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def token_pieces(docs: DataFrame, tokenizer_json: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents with their CRC, numbered by length within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task = library(tokenizer_json), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in slices(batch, text):
                ids, counts = tok.encode(part.column(text))
                at, rows = 0, []
                for doc_id, n in zip(part.column(key).to_pylist(), counts.tolist(), strict=True):
                    own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for k, start in enumerate(range(0, n + 1, capacity)):
                        cut = own[start : start + capacity]
                        rows.append((doc_id, k, start, len(cut), zlib.crc32(cut.tobytes()), task, int(seen[len(cut)])))
                        seen[len(cut)] += 1
                columns = zip(*rows, strict=True) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for c, n in zip(columns, PIECES.names, strict=True)], names=PIECES.names)

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return bounded_batches(rows).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; see the module text."""
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer_json, capacity, end_id, key, text), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    rows = by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in rows:
        histogram[length] = n
    table = spark.sparkContext.broadcast(runs(plan(histogram, capacity), capacity))
    # Rank of a task's first piece of a length: a running sum over tasks, at most
    # tasks x lengths small rows, dealt by length.
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(first, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    schema = T.StructType([*PIECES.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = table.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "rank"))
            i = np.searchsorted(r["at"], length << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PIECES.names[:5]), pa.array(r["sequence"][i] + rank - r["rank"][i]), pa.array(r["offset"][i])], names=schema.names)

    return ranked.select(*PIECES.names[:5], "rank").mapInArrow(run, schema)
