"""Quality rules with adaptive thresholds (operator 6), DataFrame functions only.

Fixed cutoffs are replaced by fences that follow what is usual in a document's own
language and source.  Each metric is summarised by a mergeable quantile sketch: a
histogram over whole numbers cut to their ``BITS`` leading bits (relative error below
2**-8).  Sketches of (language, source) merge, by adding counts, into sketches of a
language and of everything.  What a group's sketch says is drawn to what the wider one's
says as if that were ``PRIOR`` documents more, so small groups lean on their language and
the weight of their own grows smoothly with their size.

* Word length, with quartiles a, b, c, must lie in ``b - SPREAD * (b - a) .. b + SPREAD * (c - b)``.
* Symbols and repeated lines are rates, and most texts have none.  A group's *usual rate* is
  the share of its documents that show any, times the lower quartile of the rates that
  those show: how many of them a word of the group brings, told by the moderate ones.  A
  text of n words may have ``RATE_SPREAD * (usual rate * n + 1)``: as many times what its
  group leads to expect, and one more since counts are whole.  The length of a group's texts
  is not in it.  Where less than 1 / ``RATE_SPREAD`` of the documents have many, these are
  over the fence; a source where more have them by nature keeps them.

The sketches see all rows.  They are built by partial counts before one small
shuffle, so a hot source costs no more than others; the thresholds are joined to
the documents by (language, source), null-safe.

Defined results: a null text has no words and fails; null languages and sources are
groups of their own; texts with fewer than ten words fail and are in no sketch; very long
texts are one document each and measured whole; repeated rows count as often as they
occur; a value on a fence is inside; an empty table gives an empty result.  Extra columns
pass through ``verdicts``; those named like its results are replaced, unless other names
are asked for.  5-word windows are compared by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.storage import fresh, materialize

WINDOW, BITS = 5, 9
PRIOR, SPREAD, RATE_SPREAD = 100, 16, 4
#: Metric -> (what, of how many, units a whole, whether it is a rate from zero up).
#: Word length in thousandths of a character; symbols and repeated lines per hundred thousand words.
METRICS = {"word_length": ("word_chars", "n_words", 1000, False), "symbols": ("n_symbols", "n_words", 100_000, True), "dup_lines": ("n_dup_lines", "n_words", 100_000, True)}
_SPACE = "[\\x20\\x09-\\x0D]+"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines"]


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window found twice or more."""

    def covered(starts: Column) -> Column:
        gap = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(gap, F.lit(0), lambda a, g: a + g)

    def repeated(pairs: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(pairs, k)["h"] == x["h"], F.lit(False))
        again = F.filter(pairs, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return _bind(F.sort_array(F.transform(again, lambda x: x["i"])), covered)

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_bind(pairs, repeated))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(_bind(windows, count))


def features(df: DataFrame, text: str = "text", repeats: bool = True, name: str = "_quality") -> DataFrame:
    """Add the column ``_quality`` (or of another name) with n_words, word_chars, n_symbols, n_dup_lines and, if asked, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    symbols = F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols")
    dup = _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")

    def all_of(w: Column) -> Column:
        own = [F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars")]
        more = [_repeated_words(w).cast("long").alias("n_repeat_words")] if repeats else []
        return F.struct(*own, *more)

    df = df.withColumn(name, F.struct(_bind(words, all_of).alias("w"), symbols, dup))
    own = ["n_words", "word_chars", *(["n_repeat_words"] if repeats else [])]
    return df.withColumn(name, F.struct(*(F.col(f"{name}.w.{c}").alias(c) for c in own), *(F.col(f"{name}.{c}").alias(c) for c in ("n_symbols", "n_dup_lines"))))


def _metric(metric: str, row: str) -> Column:
    part, whole, unit, _ = METRICS[metric]
    return F.expr(f"{row}.{part} * {unit} div {row}.{whole}")


def sketches(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts by (lang, source, metric, bucket) of all documents with ten words or more."""
    rows = features(df.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("text")), "text", repeats=False).where("_quality.n_words >= 10")
    values = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), _metric(m, "_quality").alias("v")) for m in METRICS)))
    cut = rows.select("lang", "source", values.alias("m")).select("lang", "source", "m.metric", F.expr(f"m.v - m.v % {_width('m.v')}").alias("bucket"))
    return cut.groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _width(v: str) -> str:
    """Width of the bucket of a whole number, in SQL."""
    return f"shiftleft(1L, greatest(0, length(bin({v})) - {BITS}))"


#: What is drawn from sketches to those of a wider group.
_DRAWN = ("a", "b", "b_end", "c_end", "usual")


def _summary(sketch: DataFrame, by: list[str]) -> DataFrame:
    """n, the quartiles' edges and the usual rate of each metric for each group of merged sketches.

    ``a`` and ``b`` begin the buckets of the first and second quartile, ``b_end`` and
    ``c_end`` end those of the second and third.
    """
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"), F.sum(F.expr("if(bucket > 0, n, 0)")).alias("shown"))
    whole = Window.partitionBy(*by, "metric")
    upto = lambda c: F.sum(c).over(whole.orderBy("bucket")).alias(f"upto_{c}")
    run = merged.select(*by, "metric", "bucket", upto("n"), upto("shown"), F.sum("n").over(whole).alias("all"), F.sum("shown").over(whole).alias("some"))
    at = lambda k: F.min(F.when(F.col("upto_n") * 4 >= F.col("all") * k, F.col("bucket")))
    shown = F.min(F.when((F.col("bucket") > 0) & (F.col("upto_shown") * 4 >= F.col("some")), F.col("bucket"))).alias("rate")
    found = run.groupBy(*by, "metric").agg(F.max("all").alias("n"), F.max("some").alias("some"), shown, *(at(k).alias(c) for k, c in ((1, "a"), (2, "b"), (3, "c"))))
    ends = [F.expr(f"{c} + {_width(c)}").alias(f"{c}_end") for c in "bc"]
    return found.select(*by, "metric", F.struct("n", "a", "b", *ends, F.expr("coalesce(some * rate div n, 0)").alias("usual")).alias("q"))


def _drawn(own: str, wider: str) -> Column:
    """What a group's sketch says with that of a wider group as so many documents more."""
    return F.struct(F.col(f"{own}.n").alias("n"), *(F.expr(f"({own}.n * {own}.{c} + {PRIOR} * {wider}.{c}) div ({own}.n + {PRIOR})").alias(c) for c in _DRAWN))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source): ``low_`` and ``high_`` of word length, ``usual_`` of each rate."""
    every = _summary(sketch, []).withColumnRenamed("q", "e")
    language = _summary(sketch, ["lang"]).join(every, "metric").select(F.col("lang").alias("of"), F.col("metric").alias("same"), _drawn("q", "e").alias("l"))
    rows = _summary(sketch, ["lang", "source"]).join(language, F.col("lang").eqNullSafe(F.col("of")) & (F.col("metric") == F.col("same")))
    rows = rows.select("lang", "source", "metric", _drawn("q", "l").alias("q"))
    low, high = F.expr(f"q.b - (q.b_end - q.a) * {SPREAD}"), F.expr(f"q.b + (q.c_end - q.b) * {SPREAD}")
    pick = lambda value, m: F.max(F.when(F.col("metric") == m, value))
    limits = [pick(F.col("q.usual"), m).alias(f"usual_{m}") if rate else (pick(low, m).alias(f"low_{m}"), pick(high, m).alias(f"high_{m}")) for m, (_, _, _, rate) in METRICS.items()]
    return rows.groupBy("lang", "source").agg(*(c for x in limits for c in (x if isinstance(x, tuple) else (x,))))


def _inside(metric: str, row: str, limits: str) -> Column:
    """Whether a document of one word or more is within the fences of a metric."""
    part, whole, unit, rate = METRICS[metric]
    if rate:
        return F.expr(f"{row}.{part} * {unit} <= {RATE_SPREAD} * ({limits}.usual_{metric} * {row}.{whole} + {unit})")
    return _metric(metric, row).between(F.col(f"{limits}.low_{metric}"), F.col(f"{limits}.high_{metric}"))


def verdicts(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", quality: str = "_quality", base_failed: str = "base_failed", kept: str = "kept") -> DataFrame:
    """All columns of ``df`` with the features ``_quality`` (struct), ``base_failed`` and ``kept``, or of the names given."""
    df = df.drop(quality, base_failed, kept)
    (limits,) = fresh(df, "limits")
    # Written first, so that Spark knows its size and need not shuffle whole texts for a small table.
    known = materialize(thresholds(sketches(df, text, lang, source)), "quality-thresholds").select(F.struct("*").alias(limits))
    rows = features(df, text, name=quality).withColumn(base_failed, F.expr(f"{quality}.n_words < 10 or 100 * {quality}.n_repeat_words > 20 * {quality}.n_words"))
    rows = rows.join(known, F.col(lang).eqNullSafe(F.col(f"{limits}.lang")) & F.col(source).eqNullSafe(F.col(f"{limits}.source")), "left")
    inside = F.lit(True)
    for m in METRICS:
        inside &= F.when(F.col(f"{quality}.n_words") > 0, _inside(m, quality, limits))
    return rows.withColumn(kept, ~F.col(base_failed) & F.coalesce(inside, F.lit(True))).drop(limits)
