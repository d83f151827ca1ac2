"""Alignment of two tokenizers' tokens of the same text by divide and conquer at shared cuts.

A byte offset at which a token of both ends is a shared cut.  A stretch of tokens is cut at
the shared cut nearest its middle, found by probing outward from the middle token and
looking each end up among the other tokenizer's ends by bisection; both halves go on the
same way, and a stretch without an inner shared cut is a group.  All texts of a slice are
searched at once: each round probes one candidate of every open stretch.

Links (token pairs whose byte ranges overlap) are counted over the corpus from the distinct
pairs of each slice, and each slice gets the counts of just its own pairs back, so neither
links nor the table of counts are ever sent anywhere whole.  A slice is written as many
small rows, and its counts come back as small rows in front of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from memlake.llm.bpe import byte_alphabet, ragged_take
from memlake.llm.storage import bounded_batches, materialize
from memlake.llm.tokens import LibraryIds, PieceTable, pieces, slices, text_sums

#: Text bytes of a slice; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Tokens whose group text is built at once.
RENDERED = 1 << 20
#: Links, or pairs, of a row of the written slices.  Readers hold thousands of rows at once, so a row must be small.
ROW_LINKS = 1 << 10
#: Bits of an id in a pair.
BITS = 20
#: Stands for the ids of a piece whose tokens do not spell it.
_BAD = np.uint32(0xFFFFFFFF)


class ByteIds(LibraryIds):
    """Ids of a byte-level vocabulary, special strings in texts being ordinary text."""

    def __init__(self, tokenizer_json: str):
        super().__init__(tokenizer_json)
        self._file = tokenizer_json
        of = {c: b for b, c in enumerate(byte_alphabet())}
        spelled = ((self._tok.id_to_token(i) or "") for i in range(self.vocabulary))
        self.spelling = [bytes(of[c] for c in x) if all(c in of for c in x) else x.encode() for x in spelled]

    @cached_property
    def _literal(self):
        """The tokenizer again, for pieces with special strings: few workers meet any."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self._file)
        found.no_truncation()
        found.no_padding()
        found.encode_special_tokens = True
        return found

    def _encode(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        named = np.fromiter((any(s in x for s in self.specials) for x in distinct), bool, len(distinct))
        ids, lengths = super()._encode([x for x, n in zip(distinct, named, strict=True) if not n])
        if not named.any():
            return ids, lengths
        rest = [np.array(e.ids, np.uint32) for e in self._literal.encode_batch_fast([distinct[i] for i in np.flatnonzero(named)], add_special_tokens=False)]
        all_lengths = np.empty(len(distinct), np.int64)
        all_lengths[~named], all_lengths[named] = lengths, [len(x) for x in rest]
        starts = np.empty(len(distinct), np.int64)
        starts[~named] = np.cumsum(lengths) - lengths
        own = all_lengths[named]
        starts[named] = len(ids) + np.cumsum(own) - own
        return ragged_take(np.concatenate([ids, *rest]), starts, all_lengths), all_lengths


class PieceIds:
    """Ids of a sentencepiece model with byte fallback for pieces of texts that begin with a space."""

    def __init__(self, model_file: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.vocabulary = self._model.get_piece_size()
        names = [self._model.id_to_piece(i) for i in range(self.vocabulary)]
        self.spelling = [bytes([int(x[3:5], 16)]) if self._model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError("tokens of this model cross the start of a word")
        self._space = self._model.piece_to_id("▁")

    def _encode(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # The model puts a space in front.  A line end is no part of a longer token: behind one, a piece stands as it does without a space.
        found = self._model.encode([x[1:] if x[:1] == " " else "\n" + x for x in distinct], num_threads=1) if distinct else []
        rows = [[self._space] if x == " " else ids if x[:1] == " " else ids[2:] for x, ids in zip(distinct, found, strict=True)]
        spell = self.spelling
        rows = [r if b"".join([spell[i] for i in r]) == x.encode() else [_BAD] for r, x in zip(rows, distinct, strict=True)]
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.array([i for r in rows for i in r], np.uint32), lengths


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in A, in B) of the tokens that end at shared cuts, for texts laid end to end.

    Ends rise strictly over all texts, and the last ends of a text are equal in both.
    """
    has = a_counts > 0
    a_hi, b_hi = np.cumsum(a_counts)[has], np.cumsum(b_counts)[has]
    a_lo, b_lo = a_hi - a_counts[has], b_hi - b_counts[has]
    cuts_a, cuts_b = [a_hi - 1], [b_hi - 1]
    probe = np.zeros(len(a_lo), np.int64)
    while len(a_lo):
        # One token on a side leaves nothing to cut.
        open_ = (a_hi - a_lo > 1) & (b_hi - b_lo > 1)
        a_lo, a_hi, b_lo, b_hi, probe = (x[open_] for x in (a_lo, a_hi, b_lo, b_hi, probe))
        middle = (a_lo + a_hi - 2) // 2
        at = middle + np.where(probe % 2 == 1, (probe + 1) // 2, -(probe // 2))
        inside = (at >= a_lo) & (at < a_hi - 1)
        end = a_ends[np.where(inside, at, a_lo)]
        there = np.searchsorted(b_ends, end)
        hit = inside & (b_ends[there] == end)
        at, there = at[hit], there[hit]
        cuts_a.append(at)
        cuts_b.append(there)
        # Probes alternate, so both sides are used up once the distance exceeds the longer one.
        more = ~hit & ((probe + 2) // 2 <= np.maximum(middle - a_lo, a_hi - 2 - middle))
        a_lo, a_hi, b_lo, b_hi, probe = (
            np.concatenate(x)
            for x in (
                (a_lo[more], a_lo[hit], at + 1), (a_hi[more], at + 1, a_hi[hit]),
                (b_lo[more], b_lo[hit], there + 1), (b_hi[more], there + 1, b_hi[hit]),
                (probe[more] + 1, np.zeros(2 * len(at), np.int64)),
            )
        )
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


class Alignment:
    """Groups and links of the texts of one slice."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.a, self.b, self.a_counts, self.b_counts = a, b, a_counts, b_counts
        self._a_ends, self._b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
        self.cuts_a, self.cuts_b = shared_cuts(self._a_ends, self._b_ends, a_counts, b_counts)
        edges = np.cumsum(a_counts)
        self.groups = np.searchsorted(self.cuts_a, edges - 1, side="right") - np.searchsorted(self.cuts_a, edges - a_counts)
        self.groups[a_counts == 0] = 0

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and pair (id of A, then of B in ``BITS`` bits) of every overlap: one for each end of either side."""
        both = np.concatenate([self._a_ends << 1, self._b_ends << 1 | 1])
        both.sort(kind="stable")  # two sorted runs: a merge
        ends = both >> 1
        last = np.flatnonzero(np.append(ends[1:] != ends[:-1], True)[: len(ends)])
        of_b = np.cumsum(both & 1)[last]
        # Ends up to the one before are the place of the token that this one is in.
        before = lambda upto: np.concatenate([[0], upto[:-1]])[: len(upto)]
        at_a, at_b = before(last + 1 - of_b), before(of_b)
        text = np.repeat(np.arange(len(self.a_counts)), self.a_counts + self.b_counts - self.groups)
        return text, self.a[at_a].astype(np.int64) << BITS | self.b[at_b].astype(np.int64)

    def grouped(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens group by group, A's before B's: their ids, the mark behind each (0 comma, 1 bar, 2 semicolon, 3 nothing), and how many a text has."""
        of = lambda cuts: np.repeat(2 * np.arange(len(cuts)), np.diff(cuts, prepend=-1))
        order = np.argsort(np.concatenate([of(self.cuts_a), of(self.cuts_b) + 1]), kind="stable")
        mark_a, mark_b = np.zeros(len(self.a), np.int8), np.zeros(len(self.b), np.int8)
        mark_a[self.cuts_a], mark_b[self.cuts_b] = 1, 2
        mark_b[np.cumsum(self.b_counts)[self.b_counts > 0] - 1] = 3
        return np.concatenate([self.a, self.b])[order], np.concatenate([mark_a, mark_b])[order], self.a_counts + self.b_counts


class Aligner:
    """Both tokenizers of a Python worker."""

    def __init__(self, tokenizer_json: str, model_file: str):
        self.a, self.b = ByteIds(tokenizer_json), PieceIds(model_file)
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x.spelling), np.int64, x.vocabulary) for x in (self.a, self.b))
        names = [f"{i}{mark}".encode() for i in range(max(self.a.vocabulary, self.b.vocabulary)) for mark in (",", "|", ";", "")]
        self._name_sizes = np.fromiter(map(len, names), np.int64, len(names))
        self._table = PieceTable(self._encode)
        self._name_starts, self._names = np.cumsum(self._name_sizes) - self._name_sizes, np.frombuffer(b"".join(names), np.uint8)

    def align(self, texts: pa.Array) -> Alignment:
        """Alignment of a column; null and empty texts, and those that either side does not spell exactly, have no tokens."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        codes, counts, distinct = pieces(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())), ())
        good = np.asarray(pc.binary_length(texts)) > 0
        flat, starts, lengths = self._table.rows(distinct, np.bincount(codes, minlength=len(distinct)))
        na = flat[starts].astype(np.int64) if len(starts) else np.zeros(0, np.int64)
        sides = []
        for begin, size in ((starts + 1, na), (starts + 1 + na, lengths - 1 - na)):
            ids, n = ragged_take(flat, begin[codes], size[codes]), text_sums(size[codes], counts)
            good &= text_sums((ids == _BAD).astype(np.int64), n) == 0
            sides.append((ids, n))
        (a, na), (b, nb) = ((ids[np.repeat(good, n)], np.where(good, n, 0)) for ids, n in sides)
        return Alignment(a, b, na, nb, self.a_sizes, self.b_sizes)

    def _encode(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each piece: how many ids A has, those, and B's."""
        (a, na), (b, nb) = self.a._encode(distinct), self.b._encode(distinct)
        ends = np.cumsum(na), np.cumsum(nb)
        begin = np.stack([np.arange(len(distinct)), len(distinct) + ends[0] - na, len(distinct) + len(a) + ends[1] - nb], axis=1).ravel()
        size = np.stack([np.ones(len(distinct), np.int64), na, nb], axis=1).ravel()
        return ragged_take(np.concatenate([na.astype(np.uint32), a.astype(np.uint32), b]), begin, size), 1 + na + nb

    def digests(self, found: Alignment) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each text; without tokens the empty text."""
        ids, marks, counts = found.grouped()
        codes = ids.astype(np.int64) * 4 + marks
        out, at = [], 0
        for n in counts.tolist():
            sha, end = hashlib.sha256(), at + n
            for start in range(at, end, RENDERED):
                part = codes[start : min(end, start + RENDERED)]
                sha.update(ragged_take(self._names, self._name_starts[part], self._name_sizes[part]).tobytes())
            out.append(sha.hexdigest() if n else "")
            at = end
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(tokenizer_json: str, model_file: str) -> Aligner:
    """The aligner of two files, made once in each Python worker."""
    key = (tokenizer_json, model_file)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


Batches = Iterator[pa.RecordBatch]


def _lists(flat: np.ndarray | pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat if isinstance(flat, pa.Array) else pa.array(flat))


def align(df: DataFrame, tokenizer_json: str, model_file: str, text: str = "text", out: str = "groups") -> DataFrame:
    """Add the groups of every text: an array of structs (a, b) of the ids of both tokenizers between two shared cuts.

    Null and empty texts, and texts that either tokenizer does not spell byte for byte
    (they hold U+2581), have no groups; very long texts are aligned whole; there are no
    ties, and repeated rows get equal groups.  A column named ``out`` is replaced, all
    others stay.  No shuffle.
    """
    df = bounded_batches(df.drop(out))
    ids = T.ArrayType(T.IntegerType())
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StructType([T.StructField("a", ids), T.StructField("b", ids)])))])

    def run(batches: Batches) -> Batches:
        both = aligner(tokenizer_json, model_file)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                found = both.align(part.column(text))
                sides = [_lists(x.astype(np.int32), np.diff(np.concatenate([[-1], c]))) for x, c in ((found.a, found.cuts_a), (found.b, found.cuts_b))]
                groups = pa.StructArray.from_arrays(sides, names=["a", "b"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(found.groups)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, groups)], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


#: Numbers of some texts of a slice: each one's links are ``held`` places of pairs and the times they occur.
_TEXTS = "n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digests array<string>, held array<int>, places array<int>, times array<int>"
#: Stands for the place in rows of texts, which hold no pairs.
_NO_PLACE = -1


def _runs(sizes: np.ndarray) -> np.ndarray:
    """How many neighbours make a run each, so that a run has not much more than ``ROW_LINKS``, or is one."""
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // ROW_LINKS)) + 1
    return np.diff(np.concatenate([[0], edges, [len(sizes)]]))


def _sliced(schema: pa.Schema, key: str, text: str, tokenizer_json: str, model_file: str) -> Callable[[Batches], Batches]:
    """Texts to rows of their numbers and rows of each slice's distinct pairs, which its links name by their places."""

    def run(batches: Batches) -> Batches:
        both, task, seq = aligner(tokenizer_json, model_file), TaskContext.get().partitionId(), 0
        kind = schema.field("texts").type
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                found = both.align(part.column(text))
                of, pair = found.links()
                pairs, place = np.unique(pair, return_inverse=True)
                links, times = np.unique(of * len(pairs) + place, return_counts=True)  # distinct pairs of each text
                places = links % max(1, len(pairs))
                held = np.bincount(links // max(1, len(pairs)), minlength=part.num_rows)
                # Rows of texts, then rows of pairs; both have lists of all columns, empty ones where they hold nothing.
                n_texts, n_pairs = _runs(held + 1), _runs(np.ones(len(pairs), np.int64))
                n_pairs = n_pairs[n_pairs > 0]
                texts, of_pairs = np.concatenate([n_texts, 0 * n_pairs]), np.concatenate([0 * n_texts, n_pairs])
                n_held = np.concatenate([text_sums(held, n_texts), 0 * n_pairs])
                values = [(part.column(key), texts), *((x, texts) for x in (found.a_counts, found.b_counts, found.groups, np.bincount(of, minlength=part.num_rows), both.digests(found), held)), (places, n_held), (times, n_held)]
                lists = [_lists(x if isinstance(x, pa.Array) else pa.array(x, f.type.value_type), n).cast(f.type) for (x, n), f in zip(values, kind, strict=True)]
                rows = len(texts)
                begin = np.concatenate([np.full(len(n_texts), _NO_PLACE), np.cumsum(n_pairs) - n_pairs])
                columns = [np.full(rows, task), np.full(rows, seq), begin, pa.StructArray.from_arrays(lists, fields=list(kind)), _lists(pairs, of_pairs), _lists(np.bincount(places, minlength=len(pairs)), of_pairs)]
                seq += 1
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _summed(schema: pa.Schema) -> Callable[[Batches], Batches]:
    """Slice by slice the counts of its pairs, then rows of its texts, to one row a text."""

    def run(batches: Batches) -> Batches:
        now, counted, known = None, [], None
        for batch in batches:
            at = np.stack([np.asarray(batch.column(name)) for name in ("part", "seq")] + [np.asarray(batch.column("place")) == _NO_PLACE], axis=1)
            edges = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, len(at)], strict=True):
                if a == b:
                    continue
                if now != tuple(at[a, :2]):
                    now, counted, known = tuple(at[a, :2]), [], None
                rows = batch.slice(a, b - a)
                if not at[a, 2]:
                    numbers = rows.column("counted").flatten()
                    counted.append([np.asarray(numbers.field(name).cast(pa.int64())) for name in ("place", "n", "best")])
                    continue
                if known is None:  # the slice's counts are all there
                    where, *numbers = (np.concatenate(x) for x in zip(*counted, strict=True)) if counted else np.zeros((3, 0), np.int64)
                    order = np.argsort(where)
                    known, counted = [x[order] for x in numbers], []
                flat = lambda name, texts=rows.column("texts"): texts.field(name).flatten()
                held, places, times = (np.asarray(flat(name)).astype(np.int64) for name in ("held", "places", "times"))
                n, best = (text_sums(times * x[places], held) for x in known)
                columns = [*map(flat, ("keys", "n_a", "n_b", "n_groups", "n_links")), pa.array(best), pa.array(n), flat("digests")]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def link_statistics(df: DataFrame, tokenizer_json: str, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Numbers of tokens, groups and links of every text, and of how many texts of ``df`` hold its links.

    Columns ``key``, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by as
    many texts as any pair of its first id, ties included), count_sum, groups_sha256.
    Texts without tokens (see :func:`align`) have zeros and an empty digest; repeated rows
    count each; a null key stays null; an empty table gives no rows; other columns are not
    read.  Very long texts are slices of their own.
    """
    rows = bounded_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = rows.schema["key"].dataType
    texts = T.StructType([T.StructField("keys", T.ArrayType(kind)), *T.StructType.fromDDL(_TEXTS).fields])
    schema = T.StructType([*T.StructType.fromDDL("part int, seq int, place int").fields, T.StructField("texts", texts), *T.StructType.fromDDL("pairs array<long>, docs array<long>").fields])
    # Written once: what a slice is must not change between its uses.
    sliced = materialize(rows.mapInArrow(_sliced(to_arrow_schema(schema), "key", "text", tokenizer_json, model_file), schema), "alignment")
    own = sliced.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    counts = own.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))
    counts = materialize(counts.withColumn("first", F.shiftright("pair", BITS)), "alignment")
    most = counts.groupBy("first").agg(F.max("n").alias("most"))  # one row an id of the vocabulary
    counts = counts.join(most, "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = sliced.select("part", "seq", "place", F.posexplode("pairs").alias("at", "pair")).withColumn("place", F.col("place") + F.col("at"))
    counted = asked.join(counts, "pair").repartition("part", "seq").groupBy("part", "seq", (F.col("place") - F.col("place") % ROW_LINKS).alias("begin"))
    counted = counted.agg(F.collect_list(F.struct("place", "n", "best")).alias("counted")).withColumnRenamed("begin", "place")
    whole = counted.unionByName(sliced.where(F.col("place") == _NO_PLACE).select("part", "seq", "place", "texts"), allowMissingColumns=True)
    whole = whole.repartition("part", "seq").sortWithinPartitions("part", "seq", F.desc("place"))  # a slice's counts before its texts
    result = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields])
    return whole.mapInArrow(_summed(to_arrow_schema(result)), result)
