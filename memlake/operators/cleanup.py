"""Removal of filler and repetition from assistant responses: front, end, white space, similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as tx

#: Our own default rules, in the form of :func:`memlake.functions.text.prefix_norm`.
FRONT_PREFIXES = ("great question", "sure", "certainly", "of course", "absolutely", "happy to help", "thanks for asking")
END_PREFIXES = ("let me know if", "feel free to", "i hope this helps", "would you like me to")
SENTENCE = r"^\s*[^\s][\s\S]*?[.!?](?=\s|$)\s*"
#: What makes a sentence exact: a digit, or a letter before an underscore, an inner dot or a bracket.
EXACT = r"[0-9]|[A-Za-z](_|\.[A-Za-z]| *\()"


def merge_rules(lists: DataFrame) -> DataFrame:
    """Ordered union of rule lists: rows (at, rule) of rows (list_no, nth, rule); the first mention decides the place.

    The rules are told apart in normal form and combined before they meet; only
    distinct ones are numbered.
    """
    first = lists.where(tx.strip("rule") != "").groupBy(tx.prefix_norm(F.col("rule")).alias("norm")).agg(F.min(F.struct("list_no", "nth", "rule")).alias("f"))
    return first.select((F.row_number().over(Window.orderBy("f")) - 1).alias("at"), "f.rule")


def rule_conflicts(front: list[str], end: list[str]) -> list[str]:
    """Rules that both sides have, or of which one side's begins another's."""
    return sorted({a for a in front for b in end if a.startswith(b) or b.startswith(a)})


def matching_prefix(text: Column, prefixes: tuple[str, ...]) -> Column:
    """First rule that the normal form of the text begins with, else null."""
    return tx.once(tx.prefix_norm(F.trim(text)), lambda n: F.get(F.filter(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(n, p)), F.lit(0)))


def trim_front(rows: DataFrame, column: str, prefixes: tuple[str, ...] = FRONT_PREFIXES, most: int = 3) -> DataFrame:
    """Up to ``most`` leading sentences that begin with a rule go; never all of a text.

    Adds ``front_prefixes`` and ``front_blocked``; the column holds what is left.
    """
    rows = rows.withColumn("front_prefixes", F.array().cast("array<string>")).withColumn("front_blocked", F.lit(False)).withColumn("_go", F.lit(True))
    for _ in range(most):
        rows = rows.withColumn("_s", F.regexp_extract(column, SENTENCE, 0))
        rows = rows.withColumn("_p", F.when(F.col("_go") & (F.col("_s") != "") & ~F.col("_s").rlike(r"^\s*```"), matching_prefix(F.col("_s"), prefixes)))
        rows = rows.withColumn("_rest", F.substring(F.col(column), F.char_length("_s") + 1, F.char_length(column)))
        blocked = F.col("_p").isNotNull() & ~F.col("_rest").rlike(r"\S")
        rows = rows.withColumn("front_blocked", F.col("front_blocked") | blocked).withColumn("_go", F.col("_p").isNotNull() & ~blocked)
        rows = rows.withColumn(column, F.when(F.col("_go"), F.col("_rest")).otherwise(F.col(column))).withColumn("front_prefixes", F.when(F.col("_go"), F.concat("front_prefixes", F.array("_p"))).otherwise(F.col("front_prefixes")))
    return rows.drop("_go", "_s", "_p", "_rest")


def trim_end(rows: DataFrame, column: str, prefixes: tuple[str, ...] = END_PREFIXES) -> DataFrame:
    """Cut from the first of the last two paragraphs that begins with a rule, outside fences and lists.

    Adds ``end_prefix`` and ``end_blocked``.
    """
    parts = F.split(F.col(column), r"\n[ \t]*\n\s*")
    rows = rows.withColumn("_all", parts).withColumn("_full", F.transform(F.filter(F.transform("_all", lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda s: s["p"].rlike(r"\S")), lambda s: s["i"]))
    fences = lambda i: F.aggregate(F.slice("_all", 1, i), F.lit(0), lambda a, p: a + F.size(F.regexp_extract_all(p, F.lit(r"(?m)^\s*```"), F.lit(0))))
    open_ = lambda i: (fences(i) % 2 == 1) | F.get("_all", i).rlike(r"^\s*(```|[-*+] |\d+[.)] |#|\||>)")
    last = F.slice("_full", F.greatest(F.lit(1), F.size("_full") - 1), 2)
    hits = F.filter(last, lambda i: ~open_(i) & matching_prefix(F.get("_all", i), prefixes).isNotNull())
    rows = rows.withColumn("_hit", F.get(hits, F.lit(0)))
    marked = F.array_join(F.slice("_all", 1, F.coalesce(F.col("_hit"), F.lit(0))), "\n\n")
    blocked = F.col("_hit").isNotNull() & ~marked.rlike(r"\S")
    rows = rows.withColumn("end_blocked", blocked).withColumn("end_prefix", F.when(~blocked, matching_prefix(F.get("_all", "_hit"), prefixes)))
    return rows.withColumn(column, F.when(F.col("end_prefix").isNotNull(), F.regexp_replace(marked, r"\s+$", "")).otherwise(F.col(column))).drop("_all", "_full", "_hit")


def compact_whitespace(x: Column) -> Column:
    """Prose lines with single inner spaces and one blank line at most; fenced lines as they are."""
    lines = F.split(x, "\n")

    def step(acc: Column, line: Column) -> Column:
        fence = F.startswith(F.trim(line), F.lit("```"))
        prose = F.regexp_replace(F.regexp_replace(line, r"[ \t\r]+$", ""), r"(?<=\S)[ \t]{2,}", " ")
        blank = ~prose.rlike(r"\S")
        out = F.when(acc["code"] | fence, F.array(line)).when(blank & acc["blank"], F.array().cast("array<string>")).when(blank, F.array(F.lit(""))).otherwise(F.array(prose))
        return F.struct(F.concat(acc["out"], out).alias("out"), F.when(fence, ~acc["code"]).otherwise(acc["code"]).alias("code"), (~acc["code"] & ~fence & blank).alias("blank"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("code"), F.lit(False).alias("blank"))
    return tx.strip(F.aggregate(lines, start, step, lambda a: F.array_join(a["out"], "\n")))


def sentence_list(x: Column) -> Column:
    """Sentences of the prose outside fences; they end at ``.!?`` before white space."""
    prose = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?s)```.*?(```|$)", "")
    return F.filter(F.split(tx.strip(prose), r"(?<=[.!?])\s+"), lambda s: s.rlike(r"\S"))


def sentences(rows: DataFrame, key: str, column: str) -> DataFrame:
    """One numbered row for each sentence."""
    return rows.select(key, F.posexplode(sentence_list(F.col(column))).alias("sentence_no", "sentence"))


def protected(sentence: Column) -> Column:
    """Sentences that name exact things (numbers, identifiers, calls) are never dropped."""
    return sentence.rlike(EXACT)


def _indel(a: str, b: str) -> float:
    """Similarity 0-100 of two strings by insertions and deletions (longest common subsequence, bit-parallel)."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & places.get(c, 0)
        s = (s + u | s - u) & full
    common = len(a) - bin(s).count("1")
    return 200.0 * common / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Best of three ratios over sorted token sets; 100 when one set holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 100.0
    one = " ".join(sorted(x - y))
    two = " ".join(sorted(y - x))
    p, q = (f"{both} {one}".strip(), f"{both} {two}".strip())
    return max(_indel(p, q), _indel(both, p) if both else 0.0, _indel(both, q) if both else 0.0)


Scorer = Callable[[str, str], float]


def _decide(whole: list, threshold: int, scorer: Scorer) -> list[bool]:
    """Which sentences of a text go: similar to an earlier one that stays.

    Whether a sentence goes depends on which were kept before it, so they are decided in
    order.  For the built-in scorer, earlier sentences are pruned by bounds from their
    characters and shared tokens, which lose none.
    """
    kept: list[str] = []
    by_token: dict[str, list[int]] = {}
    bags, lengths, out = np.zeros((len(whole), 64), np.int32), np.zeros(len(whole)), []
    for s in whole:
        norm, drop = s["norm"], False
        tokens = set(norm.split())
        joined = " ".join(sorted(tokens))
        bag, n = np.bincount(np.frombuffer(joined.encode("utf-32-le"), np.uint32) % 64, minlength=64), len(kept)
        if not s["safe"] and n:
            could = np.ones(n, bool)
            if scorer is token_set_ratio:
                shared = np.zeros(n)
                for t in tokens:
                    shared[by_token.get(t, [])] += len(t) + 1
                # No pair can reach the threshold unless its characters or its shared tokens allow it.
                alike = 200.0 * np.minimum(bags[:n], bag).sum(axis=1) >= threshold * (lengths[:n] + len(joined))
                could = alike | ((200.0 - threshold) * shared >= threshold * np.minimum(lengths[:n], len(joined)))
            drop = any(scorer(norm, kept[i]) >= threshold for i in np.flatnonzero(could))
        if not drop:
            for t in tokens:
                by_token.setdefault(t, []).append(n)
            bags[n], lengths[n] = bag, len(joined)
            kept.append(norm)
        out.append(drop)
    return out


def _cells(column: str) -> Column:
    """Numbered sentences of a text with normal form and whether they are exact, cut within its row."""
    return F.transform(sentence_list(F.col(column)), lambda x, i: F.struct(i.alias("sentence_no"), x.alias("sentence"), tx.prefix_norm(x).alias("norm"), protected(x).alias("safe")))


def similar_sentences(rows: DataFrame, key: str, column: str, threshold: int = 90, scorer: Scorer = token_set_ratio) -> DataFrame:
    """Sentences with ``dropped``: similar, by ``scorer`` (0 to 100), to an earlier kept sentence of the same text."""
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(key).dtypes) + ", sentence_no int, sentence string, dropped boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(k, s["sentence_no"], s["sentence"], drop) for k, whole in zip(frame[key], frame["whole"], strict=True) for s, drop in zip(whole, _decide(whole, threshold, scorer), strict=True)]
            yield pd.DataFrame(out, columns=[key, "sentence_no", "sentence", "dropped"])

    return rows.select(key, _cells(column).alias("whole")).mapInPandas(run, schema)


def without_similar(rows: DataFrame, column: str, threshold: int = 90, scorer: Scorer = token_set_ratio) -> DataFrame:
    """The rows, their text without the sentences that repeat an earlier one, nor the white space behind those."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series, cells: pd.Series) -> pd.Series:
        out = []
        for text, whole in zip(texts, cells, strict=True):
            drops = _decide(whole, threshold, scorer) if text else []
            parts, at, gone = [], 0, any(drops)
            if gone:
                for s, drop in zip(whole, drops, strict=True):
                    start = text.find(s["sentence"], at)
                    if start < 0:
                        continue
                    end = start + len(s["sentence"])
                    parts.append(text[at:start] + ("" if drop else s["sentence"]))
                    at = end + (len(text[end:]) - len(text[end:].lstrip()) if drop else 0)
            out.append(("".join(parts) + text[at:]).rstrip() if gone else text)
        return pd.Series(out)

    return rows.withColumn(column, clean(F.col(column), _cells(column)))


@dataclass(frozen=True)
class Pruning:
    """Which stages run, by which rules."""

    front: tuple[str, ...] | None = FRONT_PREFIXES
    end: tuple[str, ...] | None = END_PREFIXES
    whitespace: bool = True
    similarity: bool = True
    threshold: int = 90
    most_chars: int = 200_000


def prune(rows: DataFrame, column: str, how: Pruning | None = None, scorer: Scorer = token_set_ratio) -> DataFrame:
    """All stages in order: front, end, white space, similarity; adds ``result``, the column holds what is left.

    ``result`` is a struct: original, changed, trimmed_side (none, front, end, both), matched
    prefixes of both sides, sentences removed in front, the span (start, stop) of the
    original removed at the end, whether a text was kept from becoming empty, and ``error``:
    ``too_long`` for texts over the limit, which pass as they are, as nulls do.
    """
    how = how or Pruning()
    names = rows.columns
    take = F.col(column).isNotNull() & (F.char_length(column) <= how.most_chars)
    work = rows.withColumns({"_original": F.col(column), "_take": take}).withColumn(column, F.when(take, F.col(column)).otherwise(F.lit("")))
    none = F.array().cast("array<string>")
    work = trim_front(work, column, how.front) if how.front is not None else work.withColumns({"front_prefixes": none, "front_blocked": F.lit(False)})
    work = work.withColumn("_front", F.col(column))
    work = trim_end(work, column, how.end) if how.end is not None else work.withColumns({"end_prefix": F.lit(None).cast("string"), "end_blocked": F.lit(False)})
    work = work.withColumn("_end", F.col(column))
    if how.whitespace:
        work = work.withColumn(column, compact_whitespace(F.col(column)))
    if how.similarity:
        work = without_similar(work, column, how.threshold, scorer)
    front, end = F.size("front_prefixes") > 0, F.col("end_prefix").isNotNull()
    stop = F.char_length("_original")
    start = stop - F.char_length("_front") + F.char_length("_end")
    side = F.when(front & end, "both").when(front, "front").when(end, "end").otherwise("none")
    left = F.when(F.col("_take"), F.col(column)).otherwise(F.col("_original"))
    result = F.struct(
        F.col("_original").alias("original"), (F.col("_take") & (front | end | (F.col(column) != F.col("_end")))).alias("changed"), side.alias("trimmed_side"), F.col("front_prefixes"), F.array_compact(F.array("end_prefix")).alias("end_prefixes"),
        F.size("front_prefixes").alias("front_units_removed"), F.when(end, F.struct(start.alias("start"), stop.alias("stop"))).alias("end_span_removed"), (F.col("front_blocked") | F.coalesce("end_blocked", F.lit(False))).alias("blocked_by_safety"),
        F.when(F.col("_original").isNotNull() & ~F.col("_take"), "too_long").alias("error"),
    )
    return work.withColumn("result", result).withColumn(column, left).select(*names, "result")


def saved_tokens(rows: DataFrame, project: str, before: str, after: str, most: int = 200_000) -> DataFrame:
    """Tokens saved in each project; over-long texts pass unpruned and are counted."""
    long = F.char_length(before) > most
    b, a = tx.count_tokens(F.col(before)), tx.count_tokens(F.when(long, F.col(before)).otherwise(F.col(after)))
    return rows.groupBy(project).agg(F.sum(b).alias("tokens_before"), F.sum(a).alias("tokens_after"), F.count_if(F.col(before) != F.col(after)).alias("changed"), F.count_if(long).alias("too_long"))
