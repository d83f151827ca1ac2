"""Token counts by prefix dynamic programming (operator 8).

The exact token count of *every* prefix of a text is computed once; how long a
text is in tokens, where it must be cut for a budget, and whether it exceeds a
limit are then look-ups that never encode again.

The counts are kept for every code point of every distinct piece of text.  A text is a
row of pieces whose tokens do not depend on each other, so its own prefix counts are the
pieces' rows laid end to end, each raised by the last count before it.  They can be
stored for every code point, or at word ends, an eighth of that; the whole text's count
is the last one stored.

Defined results: a null or empty text has no prefix and zero tokens; the special
strings of the vocabulary count as one token each, as the library has it by
default; very long texts are one row of any length; repeated rows and extra columns
pass through; an empty table gives an empty result.  Counts are at code points (a prefix
cannot end inside a character); a prefix that ends inside a special string counts the
string's own characters.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.bpe import Words, ragged_take, tables
from memlake.llm.storage import bounded_batches
from memlake.llm.tokens import PieceTable, pieces, slices, text_sums

#: Fixed value: how the byte-level vocabularies cut a text before looking for tokens.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUN = regex.compile(r"\s\s")


class PrefixCounter:
    """Prefix token counts under one byte-level vocabulary without word-end symbols."""

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer_json)
        self._bpe = tables(tokenizer_json)
        self.specials = tuple(t.content for t in tok.get_added_tokens_decoder().values())
        self._words = Words(WORDS, tok, False, self.specials)
        self._table = PieceTable(self._rows)

    def _rows(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The count of every prefix of every piece, piece after piece."""
        words, codes, counts = self._words.of(distinct)
        flat, lengths = self._bpe.symbols(words)
        prefix = self._bpe.prefix_counts(flat, lengths)
        # Of the bytes' counts, those at the last byte of each character.
        raw = np.frombuffer("".join(words).encode() + b" ", np.uint8)
        chars = np.fromiter(map(len, words), np.int64, len(words))
        at = prefix[np.flatnonzero((raw[1:] & 0xC0) != 0x80)]
        for i in [i for i, w in enumerate(words) if w in ("'re", "'ve", "'ll")]:  # cut inside: two words
            at[int(chars[:i].sum()) + 1] = 1 + int(self._bpe.prefix_counts(*self._bpe.symbols([words[i][1]]))[-1])
        starts = np.cumsum(chars) - chars
        totals = at[starts + chars - 1][codes] if len(words) else codes
        before = np.cumsum(totals) - totals
        heads = np.cumsum(counts) - counts
        before = before - np.repeat(np.append(before, 0)[heads], counts)
        rows = ragged_take(at, starts[codes], chars[codes]) + np.repeat(before, chars[codes])
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        # Pieces with runs of white space, and special strings, which are no words, are counted one by one.
        odd = [i for i, x in enumerate(distinct) if x in self.specials or _RUN.search(x)]
        if odd:
            parts = np.split(rows, np.cumsum(text_sums(chars[codes], counts))[:-1])
            for i in odd:
                parts[i] = self._plain_prefixes(distinct[i])
                if distinct[i] in self.specials:
                    parts[i][-1] = 1
            rows = np.concatenate(parts)
        return rows.astype(np.int32), sizes

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Prefix counts of all pieces, start, length and last count of each piece of each text, and pieces of each text."""
        codes, counts, distinct = pieces(texts, self.specials)
        flat, starts, lengths = self._table.rows(distinct, np.bincount(codes, minlength=len(distinct)))
        last = np.where(lengths > 0, np.append(flat, 0)[starts + np.maximum(lengths, 1) - 1], 0)
        return flat, starts[codes], lengths[codes], last[codes].astype(np.int64), counts

    def totals(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text: the last of its prefix counts."""
        _, _, _, last, counts = self._pieces(texts)
        return text_sums(last, counts)

    def at_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points and tokens of the prefixes that end with a piece, and how many of these each text has."""
        _, _, lengths, last, counts = self._pieces(texts)
        return _running(lengths, counts), _running(last, counts), counts

    def at_chars(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of every prefix of each text, and how many prefixes each text has."""
        flat, starts, lengths, last, counts = self._pieces(texts)
        return ragged_take(flat, starts, lengths) + np.repeat(_running(last, counts) - last, lengths), text_sums(lengths, counts)

    def prefixes(self, text: str | None) -> np.ndarray:
        """Exact token count of ``text[:1]``, ``text[:2]``, ... up to the whole text."""
        return self.at_chars(pa.array([text or ""]))[0]

    def _plain_prefixes(self, text: str) -> np.ndarray:
        bounds = [m.span() for m in regex.finditer(WORDS, text)]
        words = [text[a:b] for a, b in bounds]
        flat, lengths = self._bpe.symbols(words)
        counts = self._bpe.prefix_counts(flat, lengths)
        at = np.cumsum(lengths) - lengths
        out, done = np.zeros(len(text), np.int64), 0
        for (a, b), s in zip(bounds, at, strict=True):
            ends = np.cumsum([len(c.encode()) for c in text[a:b]]) - 1
            out[a:b] = done + counts[s + ends]
            if text[a:b] in ("'re", "'ve", "'ll"):  # cut inside: two words
                out[a + 1] = done + 1 + int(self._bpe.prefix_counts(*self._bpe.symbols([text[a + 1]]))[-1])
            done = int(out[b - 1])
        # A prefix that ends in white space has the whole run before its end as one word.
        for m in regex.finditer(r"\s\s+", text):
            run = text[m.start() : m.end()]
            c = self._bpe.prefix_counts(*self._bpe.symbols([run]))
            ends = np.cumsum([len(x.encode()) for x in run]) - 1
            before = int(out[m.start() - 1]) if m.start() else 0
            out[m.start() : m.end()] = before + c[ends]
        return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(tokenizer_json: str) -> PrefixCounter:
    if tokenizer_json not in _COUNTERS:
        _COUNTERS[tokenizer_json] = PrefixCounter(tokenizer_json)
    return _COUNTERS[tokenizer_json]


def _running(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Running sums of the values of each text, given how many values each text has."""
    sums = np.cumsum(values)
    heads = np.cumsum(counts) - counts
    return sums - np.repeat(np.append(0, sums)[heads], counts)


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat, pa.int32()))


#: Prefix counts stored for every code point, or at word ends with their code points.
STORED = {"chars": T.ArrayType(T.IntegerType()), "words": T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.ArrayType(T.IntegerType()))])}


def with_token_counts(df: DataFrame, tokenizer_json: str, text: str = "text", n_tokens: str = "n_tokens", prefix: str | None = None, at: str = "chars") -> DataFrame:
    """Add the token count of each text and, if ``prefix`` names a column, its prefix counts (see ``STORED``).

    No shuffle; memory is bounded by one slice of texts.  A column that already has
    one of the new names is replaced.
    """
    new = [n_tokens] + ([prefix] if prefix else [])
    df = bounded_batches(df.drop(*new))
    schema = T.StructType([*df.schema.fields, T.StructField(n_tokens, T.LongType())] + ([T.StructField(prefix, STORED[at])] if prefix else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_json)
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(text)
                if at == "chars" and prefix:
                    flat, counts = count.at_chars(column)
                    stored, tokens = _lists(flat, counts), flat
                else:
                    chars, tokens, counts = count.at_words(column)
                    stored = pa.StructArray.from_arrays([_lists(chars, counts), _lists(tokens, counts)], names=["chars", "tokens"])
                total = np.where(counts > 0, np.append(tokens, 0)[np.cumsum(counts) - 1], 0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total, pa.int64()), *([stored] if prefix else [])], names=[*part.schema.names, *new])

    return df.mapInArrow(run, schema)


def tokens_of(prefix: str) -> Column:
    """Tokens of the whole text, from prefix counts stored at word ends."""
    return F.coalesce(F.try_element_at(F.col(prefix)["tokens"], F.lit(-1)), F.lit(0)).cast("long")


def word_cut(prefix: str, budget: int) -> Column:
    """Code points of the longest run of whole words of at most ``budget`` tokens, from counts stored at word ends."""
    fits = F.size(F.filter(F.col(prefix)["tokens"], lambda c: c <= budget))
    return F.when(fits > 0, F.get(F.col(prefix)["chars"], fits - 1)).otherwise(0).cast("int")


def cut_at(prefix: str, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, from stored prefix counts.

    Counts can fall from one prefix to the next, so the last fitting prefix counts.
    """
    fits = F.array_position(F.reverse(F.transform(prefix, lambda c: c <= budget)), True)
    return F.when(fits > 0, F.size(prefix) - fits + 1).otherwise(0).cast("int")
