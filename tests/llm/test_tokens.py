"""Tokenising operators against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from memlake.llm import bpe, bpe_codec, packing, sstable, token_counts, tokens

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LIB = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}
TEXT = st.text(st.sampled_from(list("aAbstheré .,'’\n\t  -_1²日😀<|> ́İß")), max_size=40)


def ids(path, text):
    return LIB[path].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_library_ids(path):
    rng = random.Random(1)
    texts = [None, "", " ", "don't we'll  we're 'l", "a <|endoftext|> b<|startoftext|>c", "Foo. bar, BAR x.. a_. é. 2. ²,", "x" * 300, "A. a. a"]
    texts += ["".join(rng.choice("abcdé ,.'\n 日") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    lib = tokens.LibraryIds(path)
    for _ in range(2):
        flat, counts = lib.encode(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        assert [flat[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [ids(path, t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_codec_and_counts(texts):
    codec, counter = bpe_codec.codec(WORD), token_counts.counter(BYTE)
    flat, counts = codec.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for t, e, n in zip(texts, ends, counts, strict=True):
        assert flat[e - n : e].tolist() == ids(WORD, t)
        assert codec.decode(flat[e - n : e]) == LIB[WORD].decode(ids(WORD, t), skip_special_tokens=False)
    assert counter.totals(pa.array(texts, pa.string())).tolist() == [len(ids(BYTE, t)) for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXT.filter(lambda t: "<|" not in t))
def test_every_prefix(text):
    want = [len(ids(BYTE, text[:k])) for k in range(1, len(text) + 1)]
    assert token_counts.counter(BYTE).prefixes(text).tolist() == want


def test_long_words_take_the_slow_path():
    t = bpe.tables(BYTE)
    for word in ("ab" * 300, "日本" * 60, "tion" * 50):
        flat, lengths = t.symbols([word])
        assert t.encode(flat, lengths)[0].tolist() == ids(BYTE, word)
        assert t.prefix_counts(flat, lengths)[-1] == len(ids(BYTE, word))


def test_remembering_starts_anew():
    table = tokens.PieceTable(lambda xs: (np.array([len(x) for x in xs], np.int64), np.ones(len(xs), np.int64)), limit=3)
    for words in (["a", "bb"], ["ccc", "bb", "dddd"], ["x" * 9, "y" * 8, "a"], ["q", "bb"]):
        flat, starts, lengths = table.rows(words, np.ones(len(words), np.int64))
        assert flat[starts].tolist() == [len(w) for w in words] and set(lengths) == {1}


def test_round_trip_on_edges(spark, docs, nothing):
    got = bpe_codec.round_trip(docs, WORD).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, hashlib.sha256(np.array(ids(WORD, r.text), "<u4").tobytes()).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256) for r in got) == want
    back = bpe_codec.bpe_decode(bpe_codec.bpe_encode(docs, WORD), WORD).select("doc_id", "text", "decoded").collect()
    assert all(r.decoded == LIB[WORD].decode(ids(WORD, r.text), skip_special_tokens=False) for r in back)
    assert bpe_codec.round_trip(nothing, WORD).count() == 0


def test_counts_on_edges(docs, nothing):
    short = docs.where("length(text) < 1000 or text is null")
    rows = token_counts.with_token_counts(short, BYTE, prefix="p").withColumn("cut", token_counts.cut_at("p", 5)).collect()
    for r in rows:
        assert r.n_tokens == len(ids(BYTE, r.text)) and len(r.p) == len(r.text or "")
        fits = [k for k in range(len(r.text or "") + 1) if k == 0 or r.p[k - 1] <= 5]
        assert r.cut == max(fits)
    assert token_counts.with_token_counts(docs, BYTE).count() == docs.count()
    assert token_counts.with_token_counts(nothing, BYTE).count() == 0


def test_sstables(spark, docs, nothing):
    manifest = sstable.write_sstables(docs, BYTE)
    rows = sstable.read_sstables(manifest, lambda x: (x.tolist(),), [sstable.T.StructField("ids", sstable.T.ArrayType(sstable.T.LongType()))]).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x or 0))
    texts = {r.doc_id: r.text for r in docs.collect()}
    at = 0
    for r in rows:
        assert r.ids == [*ids(BYTE, texts[r.doc_id]), 0] and r.start == at
        at += len(r.ids)
    found = sstable.lookup(manifest, [3, 4, 999, None]).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in found) == [-1, 3, 4, 4, 4]
    none = sstable.write_sstables(nothing, BYTE)
    assert sstable.read_sstables(none, lambda x: (), []).count() == 0


def test_sstable_blocks_and_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 100)
    path = tmp_path / "a.sst"
    with path.open("wb") as f:
        w = sstable.ShardWriter(f, 2)
        for k in range(-50, 50):
            w.add(sstable.key_of(k), np.arange(abs(k), dtype=np.uint32))
        size = w.close()
    r = sstable.ShardReader(str(path), size)
    assert len(r.index) > 10 and r.entries == 100 and [sstable.id_of(k) for k, _ in r] == list(range(-50, 50))
    assert r.get(-7)[0].tolist() == list(range(7)) and r.get(50) == []
    path.write_bytes(path.read_bytes()[:-60] + bytes(60))
    with pytest.raises(ValueError, match="not a whole shard"):
        sstable.ShardReader(str(path), size)


def check_packing(rows, texts, capacity):
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    whole: dict[int, list] = {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r)
    for doc_id, parts in whole.items():
        all_ids = [*ids(WORD, texts[doc_id]), 0]
        for r in parts:
            cut = np.array(all_ids[r.start : r.start + r.length], "<u4")
            assert r.start == r.piece * capacity and len(cut) == r.length and zlib.crc32(cut.tobytes()) == r.ids_crc32
    return len(by_sequence)


def test_packing_on_edges(docs, nothing):
    rows = packing.pack(docs, WORD, capacity=256).collect()
    n = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, 256)
    total = sum(r.length for r in rows)
    assert total == sum(len(ids(WORD, r.text)) + 1 for r in docs.collect()) and n <= -(-total // 256) + 1
    assert packing.pack(nothing, WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_holds_every_piece(lengths):
    histogram = np.bincount(lengths, minlength=65) if lengths else np.zeros(65, np.int64)
    used = np.zeros(65, np.int64)
    sequences = 0
    for pattern, times in packing.plan(histogram, 64):
        assert sum(pattern) <= 64 and times > 0
        sequences += times
        for n in pattern:
            used[n] += times
    assert np.array_equal(used, histogram) and sequences <= max(1, 2 * (sum(lengths) // 64 + 1))


def test_fit_prefers_exact_patterns():
    histogram = np.zeros(101, np.int64)
    histogram[[60, 40, 50, 30, 20]] = [1000, 1000, 500, 300, 300]
    plan = packing.plan(histogram, 100)
    assert sum(t for _, t in plan) == -(-int((np.arange(101) * histogram).sum()) // 100)


def test_cut_at_needs_no_monotone_counts(spark):
    df = spark.createDataFrame([([1, 2, 3, 2, 3],)], "p array<int>")
    assert [df.select(token_counts.cut_at("p", b).alias("v")).first().v for b in (0, 1, 2, 3)] == [0, 1, 4, 5]
    assert spark.createDataFrame([([],)], "p array<int>").select(token_counts.cut_at("p", 3).alias("v")).first().v == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_stored_prefixes(texts):
    c = token_counts.PrefixCounter(BYTE)
    chars, tok, counts = c.at_words(pa.array(texts))
    flat, sizes = c.at_chars(pa.array(texts))
    at = done = 0
    for t, n, size in zip(texts, counts, sizes, strict=True):
        assert size == len(t)
        for a, b in zip(chars[at : at + n], tok[at : at + n], strict=True):
            assert b == len(ids(BYTE, t[:a])) == (flat[done + a - 1] if a else 0)
        at, done = at + n, done + size


def test_long_text_prefixes(spark):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("abcdeé'123.") for _ in range(rng.randrange(1, 12))) + rng.choice(("", "", "\n", "  x")) for _ in range(4000))
    for t in (text, text.replace("  ", " ")):
        got = token_counts.counter(BYTE).prefixes(t)
        assert len(got) == len(t) and all(got[k - 1] == len(ids(BYTE, t[:k])) for k in [*range(1, len(t), 4001), len(t)])
    df = token_counts.with_token_counts(spark.createDataFrame([(text,), (None,), ("",)], "t string"), BYTE, text="t", prefix="p", at="words")
    for r in df.select("t", "n_tokens", token_counts.tokens_of("p").alias("last"), token_counts.word_cut("p", 100).alias("cut")).collect():
        assert r.n_tokens == r.last == len(ids(BYTE, r.t)) and len(ids(BYTE, (r.t or "")[: r.cut])) <= 100
