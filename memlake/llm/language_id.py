"""Language identification by prediction by partial matching (operator 4).

For each language a tree of byte contexts of up to ``ORDER`` bytes holds how often
each byte followed.  A byte is coded in the longest context that the tree knows; if
it never followed there, an escape is paid and the next shorter context is tried,
down to a uniform code.  With n occurrences of d different bytes in a context, a
byte seen c times has probability c / (n + d) and the escape d / (n + d) (method C,
without exclusion).  The statistics are frozen after training, so the code length of
a text under each language is exact, and the shortest wins (ties: smallest name).

Texts are coded space by space: a word's contexts begin at the space before it and
its code ends with the space after it, so words have code lengths of their own and
each distinct word of a slice is coded once.

Training uses at most ``SAMPLE_ROWS`` whole documents of each language, of at most
``SAMPLE_BYTES`` each, the same at every input size; the trees are therefore bounded
and broadcast.  Everything else covers all rows.

Defined results: ``und`` with score 0 for null texts and texts without a letter, or
if there is nothing to learn from; very long texts are coded whole; repeated rows repeat;
an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.bpe import IntMap
from memlake.llm.storage import bounded_batches, fresh
from memlake.llm.tokens import PieceTable, slices, text_sums

ORDER = 4
SAMPLE_ROWS, SAMPLE_BYTES = 400, 1 << 15
UNKNOWN = "und"
#: Words that a task remembers, and bytes of text that it codes at once.
REMEMBERED, SLICE_BYTES = 100_000, 1 << 20


def _cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words between single spaces: codes, number for each text, distinct words."""
    cut = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
    coded = cut.flatten().dictionary_encode()
    return np.asarray(coded.indices, np.int32), np.diff(np.asarray(cut.offsets)), coded.dictionary.to_pylist()


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, each between two spaces, and each byte's place in its word (0: the space before)."""
    flat = np.frombuffer((" " + "  ".join(words) + " ").encode(), np.uint8) if words else np.zeros(0, np.uint8)
    lengths = np.fromiter((len(w) + 2 if w.isascii() else len(w.encode()) + 2 for w in words), np.int64, len(words))
    return flat, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _grams(flat: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that have ``order`` bytes of context, and keys of the contexts there."""
    at = np.flatnonzero(place >= max(order, 1))
    key = np.zeros(len(at), np.int64)
    for k in range(order, 0, -1):
        key = key << 8 | flat[at - k]
    return at, key


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text divisible by five, or no id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _count_grams(sample: DataFrame) -> DataFrame:
    """Counts of (lang, order, context, byte) in the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                codes, _, words = _cut(batch.column("text").filter(pa.array(langs == lang)))
                uses = np.bincount(codes, minlength=len(words))
                flat, place = _coded(words)
                times = np.repeat(uses, np.diff(np.append(np.flatnonzero(place == 0), len(flat))))
                for order in range(ORDER + 1):
                    at, key = _grams(flat, place, order)
                    grams, inverse = np.unique(key << 8 | flat[at], return_inverse=True)
                    n = np.bincount(inverse, times[at], len(grams)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(np.full(len(grams), order, np.int32)), pa.array(grams), pa.array(n)], names=["lang", "depth", "gram", "n"])

    return sample.mapInArrow(run, "lang string, depth int, gram long, n long").groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen context trees of all languages as tables of code lengths in bits."""

    def __init__(self, langs: np.ndarray, depth: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = sorted(set(langs.tolist()))
        which = np.searchsorted(self.langs, langs) if len(langs) else np.zeros(0, np.int64)
        width = len(self.langs)
        self.symbol, self.escape, self.cost, self.paid = [], [], [], []
        for order in range(ORDER + 1):
            own = depth == order
            g, l, c = gram[own], which[own], n[own].astype(float)
            grams, gi = np.unique(g, return_inverse=True)
            contexts, ci = np.unique(g >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, (ci, l), c)
            np.add.at(kinds, (ci, l), 1)
            cost = np.full((len(grams) + 1, width), np.inf, np.float32)
            cost[gi, l] = np.log2((total + kinds)[ci, l] / c)
            paid = np.zeros((len(contexts) + 1, width), np.float32)
            with np.errstate(divide="ignore", invalid="ignore"):
                paid[:-1] = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0)
            self.symbol.append(IntMap(grams, np.arange(len(grams))))
            self.escape.append(IntMap(contexts, np.arange(len(contexts))))
            self.cost.append(cost)
            self.paid.append(paid)

    def code_lengths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of bits under each language, then 1 if the word has a letter."""
        width = len(self.langs)
        flat, place = _coded(words)
        bits = np.zeros((len(flat), width), np.float32)
        open_ = np.repeat(place[:, None] > 0, width, axis=1)
        for order in range(ORDER, -1, -1):
            at, key = _grams(flat, place, order)
            live = open_[at].any(axis=1)
            at, key = at[live], key[live]
            cost = self.cost[order][self.symbol[order].get(key << 8 | flat[at])]
            todo = open_[at]
            seen = todo & np.isfinite(cost)
            pay = self.paid[order][self.escape[order].get(key)]
            bits[at] += np.where(seen, cost, np.where(todo, pay, 0))
            open_[at] = todo & ~seen
        bits += np.where(open_, np.float32(8), 0)
        heads = np.flatnonzero(place == 0)
        rows = np.zeros((len(words), width + 1), np.float32)
        if len(words):
            rows[:, :width] = np.add.reduceat(bits, heads, axis=0)
            rows[:, width] = [any(map(str.isalpha, w)) for w in words]
        return rows.ravel(), np.full(len(words), width + 1, np.int64)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from a bounded sample of the rows that are not held out."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES) & ~held_out(F.col("id")))
    # Thin each language to about one and a half times the bound by a hash, then rank what is left.
    totals = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))
    drawn = rows.withColumn("draw", F.pmod(F.xxhash64("id"), F.lit(1_000_000_007))).join(F.broadcast(totals), "lang").where(F.col("draw") * F.col("total") < 1.5 * SAMPLE_ROWS * 1_000_000_007)
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id"))).where(F.col("rank") <= SAMPLE_ROWS)
    found = _count_grams(ranked.select("lang", "text")).toPandas()
    return Model(*(found[c].to_numpy() for c in ("lang", "depth", "gram", "n")))


def predict(docs: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (the best language's share of probability), or columns of other names.  No shuffle.

    Only the text goes to Python and only the two results come back.  A column that
    already has one of the two names is replaced.
    """
    docs = bounded_batches(docs.drop(lang_pred, score))
    (both,) = fresh(docs, "language")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    result = pa.struct([pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        table = PieceTable(model.code_lengths, REMEMBERED)
        for batch in batches:
            parts = [_predict(model, table, part.column(0)) for part in slices(pa.RecordBatch.from_arrays([batch], names=["t"]), "t", SLICE_BYTES)]
            best, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, object), np.zeros(0))
            yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score)], fields=list(result))

    # Marked so that Spark does not run it once for a filter on the result and once for the result.
    found = docs.withColumn(both, identify.asNondeterministic()(F.col(text).cast("string")))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(both)["lang_pred"].alias(lang_pred), F.col(both)["score"].alias(score))


def _predict(model: Model, table: PieceTable, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text of a slice."""
    width = len(model.langs)
    codes, counts, words = _cut(texts)
    flat, starts, _ = table.rows(words, np.bincount(codes, minlength=len(words)))
    of = lambda k: text_sums(flat[starts + k][codes].astype(float), counts)
    known = of(width) > 0
    if not width:
        return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    lengths = np.stack([of(k) for k in range(width)], 1)
    best = lengths.argmin(axis=1)
    least = lengths[np.arange(len(best)), best][:, None]
    score = 1 / np.exp2(np.maximum(least - lengths, -1000)).sum(axis=1)
    return np.where(known, np.array(model.langs, object)[best], UNKNOWN), np.where(known, score, 0.0)
