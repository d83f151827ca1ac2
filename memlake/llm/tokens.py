"""Tokenising whole columns of text through their distinct pieces.

Every tokenizer used here splits a text at white space before it looks for
tokens, so a text may be cut before each single space, and around each single line
end, that has no other white space beside it, and the pieces encoded apart.  Natural text repeats its pieces, so a
slice of a column is cut and dictionary-encoded by Arrow and only *distinct*
pieces are encoded.  Texts with other white space, separators or special strings
are cut by a slower path with the same result.  Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
import json
import os
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from memlake.llm.bpe import byte_alphabet, ragged_take

#: Bytes of text that are tokenised at once; bounds the memory of a task.
SLICE_BYTES = 4 << 20
#: Pieces that a Python worker remembers between slices, and the characters of the longest of them.
REMEMBERED, LONGEST = 300_000, 64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None
_SEP = "\x1f"
_ODD = r"[\t-\r\x1c-\x20\x{85}\p{Z}][\t-\r\x1c-\x20\x{85}\p{Z}]|\x1f"


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part has much more than ``limit`` bytes of text."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Return freed memory to the system, since idle Python workers keep theirs for the next stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def split_special(text: str, specials: tuple[str, ...]) -> list[str]:
    """The text cut around special strings, which become pieces of their own."""
    if not any(s in text for s in specials):
        return [text]
    return [x for x in re.split("(" + "|".join(map(re.escape, specials)) + ")", text) if x]


def pieces(texts: pa.Array, specials: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Piece codes of all texts, the number of pieces of each text, and the distinct pieces."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = np.asarray(pc.match_substring_regex(texts, _ODD))
    for s in specials:
        odd = odd | np.asarray(pc.match_substring(texts, s))
    plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
    marked = pc.replace_substring(pc.replace_substring(texts.take(pa.array(plain)), " ", _SEP + " "), "\n", f"{_SEP}\n{_SEP}")
    cut = pc.split_pattern(marked, _SEP)
    counts = np.zeros(len(texts), np.int64)
    counts[plain] = np.diff(np.asarray(cut.offsets)) if len(plain) else 0
    flat = cut.flatten()
    if len(rest):
        others = [split_special(t, specials) for t in texts.take(pa.array(rest)).to_pylist()]
        counts[rest] = [len(x) for x in others]
        flat = pa.concat_arrays([flat, pa.array([p for x in others for p in x], pa.large_string())])
    coded = flat.dictionary_encode()
    codes = np.asarray(coded.indices, np.int32)
    if len(rest):
        order = np.concatenate([plain, rest])
        begin = np.empty(len(texts), np.int64)
        ends = np.cumsum(counts[order])
        begin[order] = ends - counts[order]
        codes = ragged_take(codes, begin, counts)
    return codes, counts, coded.dictionary.to_pylist()


class PieceTable:
    """Distinct pieces to rows of numbers (token ids, prefix counts, code lengths).

    The first pieces of ordinary length are remembered for the next slices, up to a
    limit; when they no longer cover most of a slice, remembering starts anew.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = REMEMBERED):
        self._encode, self._limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self._known: dict[str, int] = {}
        self._lengths, self._flat = np.zeros(0, np.int64), None

    def rows(self, distinct: list[str], uses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat numbers with the start and length of each distinct piece's row."""
        get = self._known.get
        at = np.fromiter((get(x, -1) for x in distinct), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        long = np.fromiter((len(distinct[i]) > LONGEST for i in new), bool, len(new))
        new = np.concatenate([new[~long], new[long]])
        full = len(self._known) >= self._limit
        again = full and uses[new].sum() > 0.3 * uses.sum()
        flat, lengths = self._encode([distinct[i] for i in new])
        if self._flat is None:
            self._flat = flat[:0]
        base = len(self._lengths)
        at[new] = base + np.arange(len(new))
        all_flat, all_lengths = np.concatenate([self._flat, flat]), np.concatenate([self._lengths, lengths])
        starts = np.cumsum(all_lengths) - all_lengths
        if again:
            self._clear()
        elif not full:
            keep = min(self._limit - base, len(new) - int(long.sum()))
            self._known.update(zip([distinct[i] for i in new[:keep]], range(base, base + keep), strict=False))
            self._lengths = all_lengths[: base + keep]
            self._flat = all_flat[: int(self._lengths.sum())]
        return all_flat, starts[at], all_lengths[at]


def _latin_word(x: str) -> bool:
    """Letters below U+0250 whose lower case is one letter each."""
    return x.isalpha() and (x.isascii() or (max(x) < "\u0250" and "\u0130" not in x))


class LibraryIds:
    """Token ids of the ``tokenizers`` library for whole texts.

    Distinct pieces go to the library in large groups; see :meth:`_by_size` and
    :meth:`_by_mark` for how their ids are told apart.
    """

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self._tok = Tokenizer.from_file(tokenizer_json)
        self.vocabulary = self._tok.get_vocab_size()
        self._tok.no_truncation()
        self._tok.no_padding()
        self.specials = tuple(sorted((t.content for t in self._tok.get_added_tokens_decoder().values()), key=len, reverse=True))
        self._mark = self.specials[0]
        self._mark_id = self._tok.token_to_id(self._mark)
        lossless = self._tok.normalizer is None and isinstance(self._tok.pre_tokenizer, pre_tokenizers.ByteLevel)
        self._sizes = np.array([len(self._tok.id_to_token(i) or "") for i in range(self._tok.get_vocab_size())]) if lossless else None
        with open(tokenizer_json, encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        self._ends = np.array([(self._tok.id_to_token(i) or "").endswith(suffix) for i in range(self._tok.get_vocab_size())]) if suffix else None
        self._space, self._spell = byte_alphabet()[32], {b: c for b, c in enumerate(byte_alphabet()) if b > 127}
        self._plain = Tokenizer(self._tok.model)
        self._plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._stops = {x: self._tok.encode(x, add_special_tokens=False).ids[0] for x in ".,"}
        self._table = PieceTable(self._encode)

    def _encode(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of pieces from rows of their cores.

        A full stop or comma after an ASCII letter or digit at the end of a piece is a
        word of its own, and vocabularies that fold case and drop spaces do not tell
        pieces apart that differ only in those; so fewer cores than pieces are encoded.
        """
        cores: defaultdict[str, int] = defaultdict(count().__next__)
        at, tail, fold = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.uint32), self._sizes is None
        for i, x in enumerate(distinct):
            if x.isascii():
                if x[-1:] in self._stops and x[-2:-1].isalnum():
                    tail[i], x = self._stops[x[-1]], x[:-1]
                if fold and x not in self.specials:
                    x = x.lower().lstrip(" ")
            at[i] = cores[x]
        ids, lengths = self._encode_cores(list(cores))
        starts = np.cumsum(lengths) - lengths
        # Tail ids are put behind the cores' ids, so that a piece is two runs of one array.
        begin, size = np.repeat(starts[at], 2), np.repeat(lengths[at], 2)
        stopped = tail > 0
        begin[1::2], size[1::2] = len(ids) + np.cumsum(stopped) - stopped, stopped
        return ragged_take(np.concatenate([ids, tail[stopped]]), begin, size), lengths[at] + stopped

    def _encode_cores(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        own = {i: self._tok.token_to_id(x) for i, x in enumerate(distinct) if x in self.specials}
        letters = np.fromiter((_latin_word(x if self._sizes is None or x[:1] != " " else x[1:]) for x in distinct), bool, len(distinct))
        if self._ends is not None:
            safe = np.fromiter((x.isalpha() for x in distinct), bool, len(distinct))
        elif self._sizes is None:
            safe = np.zeros(len(distinct), bool)
        else:
            safe = np.fromiter((len(x) > 1 and x[0] == " " and not x[1].isspace() and not x[-1].isspace() for x in distinct), bool, len(distinct))
        plain = np.ones(len(distinct), bool)
        plain[list(own)] = False
        groups = [np.flatnonzero(g) for g in (plain & letters, plain & safe & ~letters, plain & ~safe & ~letters)]
        ways = [self._by_letters, self._by_size if self._ends is None else self._by_word, self._by_mark]
        parts = [way([distinct[i] for i in g]) for way, g in zip(ways, groups, strict=True)]
        parts.append((np.array(list(own.values()), np.uint32), np.ones(len(own), np.int64)))
        ids, lengths = (np.concatenate([x[k] for x in parts]) for k in (0, 1))
        order = np.empty(len(distinct), np.int64)
        order[np.concatenate([*groups, np.array(list(own), np.int64)])] = np.arange(len(distinct))
        return ragged_take(ids, (np.cumsum(lengths) - lengths)[order], lengths[order]), lengths[order]

    def _run(self, groups: list[str], tok=None) -> np.ndarray:
        found = (tok or self._tok).encode_batch_fast(groups, add_special_tokens=False)
        return np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in found)])

    def _by_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of Latin letters are one word each, already in NFC.

        So they are spelled in the byte alphabet here and go to the library's model split
        at white space only.
        """
        if self._sizes is None:
            words = [x if x.isascii() else x.lower().encode().decode("latin-1").translate(self._spell) for x in words]
        else:
            words = [self._space + x[1:] if x[0] == " " else x for x in (x if x.isascii() else x.encode().decode("latin-1").translate(self._spell) for x in words)]
        ids = self._run([" ".join(words[i : i + 2000]) for i in range(0, len(words), 2000)], self._plain)
        if not words:
            return ids, np.zeros(0, np.int64)
        if self._ends is not None:
            last = np.flatnonzero(self._ends[ids])
        else:
            last = np.searchsorted(np.cumsum(self._sizes[ids]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
        return ids, np.diff(np.concatenate([[-1], last]))

    def _by_mark(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces joined by a special token, whose id tells where each ends."""
        ids = self._run([self._mark.join(words[i : i + 2000]) + self._mark for i in range(0, len(words), 2000)])
        lengths = np.diff(np.concatenate([[-1], np.flatnonzero(ids == self._mark_id)])) - 1
        return ids[ids != self._mark_id], lengths.astype(np.int64)

    def _by_word(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of letters only, joined by spaces; tokens with the word-end mark tell where each ends."""
        ids = self._run([" ".join(words[i : i + 2000]) for i in range(0, len(words), 2000)])
        ends = np.flatnonzero(self._ends[ids]) if len(words) else np.zeros(0, np.int64)
        if len(ends) != len(words):  # letters of another Unicode version
            return self._by_mark(words)
        return ids, np.diff(np.concatenate([[-1], ends]))

    def _by_size(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that start with one space, simply joined; the tokens' bytes tell where each ends."""
        ids = self._run(["".join(words[i : i + 2000]) for i in range(0, len(words), 2000)])
        ends = np.cumsum(np.fromiter((len(w) if w.isascii() else len(w.encode()) for w in words), np.int64, len(words)))
        at = np.cumsum(self._sizes[ids]) if len(words) else ends
        last = np.searchsorted(at, ends)
        if len(words) and not np.array_equal(at[last], ends):
            raise ValueError("a token crosses the end of a piece")
        return ids, np.diff(np.concatenate([[0], last + 1]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        codes, counts, distinct = pieces(texts, self.specials)
        flat, starts, lengths = self._table.rows(distinct, np.bincount(codes, minlength=len(distinct)))
        ids = ragged_take(flat, starts[codes], lengths[codes])
        return ids, text_sums(lengths[codes], counts)


def text_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, given how many values each text has."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


_LIBRARY: dict[str, LibraryIds] = {}


def library(tokenizer_json: str) -> LibraryIds:
    """The library's tokenizer of a file, loaded once in each Python worker."""
    if tokenizer_json not in _LIBRARY:
        _LIBRARY[tokenizer_json] = LibraryIds(tokenizer_json)
    return _LIBRARY[tokenizer_json]
