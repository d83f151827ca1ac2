"""BPE encoding and decoding by speculate and verify (operator 2).

For each distinct word the longest tokens are proposed greedily, all neighbouring
pairs are tested at once for compatibility, and only words with a failing pair go
through exact merging.  Results equal the ``tokenizers`` library's for the same
file: NFC, white-space runs to one space, lower case, word split, word-end
symbols; special strings of the vocabulary are single ids.

Defined results: null and empty texts have no ids and decode to the empty text;
very long texts are coded whole, slice by slice, and words of over 96 bytes in O(n log n);
repeated rows repeat; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from memlake.llm.bpe import Words, ragged_take, tables
from memlake.llm.storage import bounded_batches
from memlake.llm.tokens import PieceTable, pieces, slices, text_sums

class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(tokenizer_json, encoding="utf-8") as f:
            spec = json.load(f)
        self._tok = Tokenizer.from_file(tokenizer_json)
        self._bpe = tables(tokenizer_json)
        cut = spec["pre_tokenizer"]
        inner = cut.get("pretokenizers", [cut])[0]
        if spec["decoder"] is not None or inner["type"] != "Split":
            raise ValueError("expected a word vocabulary: Split pre-tokenizer, no decoder")
        self._special = {t.content: i for i, t in self._tok.get_added_tokens_decoder().items()}
        self.specials = tuple(self._special)
        self._words = Words(inner["pattern"]["Regex"], self._tok, spec["normalizer"] is not None, self.specials)
        self._strings = [self._tok.id_to_token(i) or "" for i in range(self._tok.get_vocab_size())]
        self._table = PieceTable(self._encode)
        self.words = self.merged = 0

    def _encode(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, codes, counts = self._words.of(distinct)
        flat, lengths = self._bpe.symbols(words)
        ids, n_ids, merged = self._bpe.encode(flat, lengths)
        self.words, self.merged = self.words + len(words), self.merged + merged
        out, out_counts = ragged_take(ids, (np.cumsum(n_ids) - n_ids)[codes], n_ids[codes]), text_sums(n_ids[codes], counts)
        own = [i for i, n in enumerate(counts.tolist()) if not n and distinct[i] in self._special]
        if own:
            out = np.insert(out, (np.cumsum(out_counts) - out_counts)[own], [self._special[distinct[i]] for i in own])
            out_counts[own] = 1
        return out.astype(np.uint32), out_counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        codes, counts, distinct = pieces(texts, self.specials)
        flat, starts, lengths = self._table.rows(distinct, np.bincount(codes, minlength=len(distinct)))
        return ragged_take(flat, starts[codes], lengths[codes]), text_sums(lengths[codes], counts)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens kept: the vocabulary's own spellings, space-joined."""
        return " ".join(map(self._strings.__getitem__, ids.tolist()))


_CODECS: dict[str, Codec] = {}


def codec(tokenizer_json: str) -> Codec:
    if tokenizer_json not in _CODECS:
        _CODECS[tokenizer_json] = Codec(tokenizer_json)
    return _CODECS[tokenizer_json]


Batches = Iterator[pa.RecordBatch]


def encoding(tokenizer_json: str, text: str = "text", ids: str = "ids") -> Callable[[Batches], Batches]:
    """A step that adds the column of token ids to record batches, slice by slice."""

    def run(batches: Batches) -> Batches:
        c = codec(tokenizer_json)
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                flat, counts = c.encode(part.column(text))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, ids])

    return run


def decoding(tokenizer_json: str, ids: str = "ids", text: str = "decoded") -> Callable[[Batches], Batches]:
    """A step that adds the text of an ids column; null ids give the empty text."""

    def run(batches: Batches) -> Batches:
        c = codec(tokenizer_json)
        for batch in batches:
            column = batch.column(ids)
            offsets, flat = np.asarray(column.offsets), np.asarray(column.values)
            texts = [c.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return run


def digesting(key: str = "doc_id", ids: str = "ids", text: str = "decoded") -> Callable[[Batches], Batches]:
    """A step to (key, number of ids, SHA-256 of the ids as little-endian 32-bit integers and of the decoded text)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            column = batch.column(ids)
            offsets, flat = np.asarray(column.offsets), np.asarray(column.values).astype("<u4")
            shas = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            decoded = [hashlib.sha256(t.as_buffer()).hexdigest() for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.diff(offsets), pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_encode(df: DataFrame, tokenizer_json: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the column of token ids (array of int).  No shuffle, memory bounded by a slice."""
    df = bounded_batches(df.drop(ids))
    return df.mapInArrow(encoding(tokenizer_json, text, ids), T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def bpe_decode(df: DataFrame, tokenizer_json: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of an ids column; null ids give the empty text."""
    df = df.drop(text)
    return df.mapInArrow(decoding(tokenizer_json, ids, text), T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))


def round_trip(df: DataFrame, tokenizer_json: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode and digest in one Python stage, so that ids and texts never leave the worker."""
    steps = encoding(tokenizer_json, text), decoding(tokenizer_json), digesting(key)

    def run(batches: Batches) -> Batches:
        for step in steps:
            batches = step(batches)
        return batches

    rows = bounded_batches(df.select(key, text))
    return rows.mapInArrow(run, T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
