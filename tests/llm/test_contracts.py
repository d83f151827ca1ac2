"""The registered queries on awkward tables, against plain implementations of their contracts."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from memlake.llm import html_extract, media, queries
from tests.llm.test_quality_language_simhash import base, brute_components, naive_fingerprint

BYTE, WORD = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def ids(tok, text):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids, "<u4")


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs.write.parquet(str(folder / "documents.parquet"))
    pages = [(1, "http://a/1", "<p>one &amp; é"), (2, None, None), (3, "x", ""), (1, "http://a/1", "<p>one &amp; é"), (None, "http://a/2", "<nav>menu</nav><p>two")]
    spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as site", "2 as text", "3 as paths").write.parquet(str(folder / "pages.parquet"))
    return str(folder)


def rows(spark, tables, name):
    return queries.queries()[name](spark, tables).collect()


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_op1(spark, docs, tables):
    got, at, all_texts = sorted(rows(spark, tables, "op1_sstable"), key=lambda r: r.start), 0, texts(docs)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda k: (k is not None, k or 0))
    for r in got:
        own = np.append(ids(BYTE, all_texts[r.doc_id]), np.uint32(0)).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own.tobytes()))
        at += len(own)


def test_op2_op8(spark, docs, tables):
    all_texts = texts(docs)
    for r in rows(spark, tables, "op2_bpe_codec"):
        own = ids(WORD, all_texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(own.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(WORD.decode(own.tolist(), skip_special_tokens=False).encode()).hexdigest()
    got = rows(spark, tables, "op8_token_counts")
    assert len(got) == docs.count()
    for r in got:
        n = len(ids(BYTE, all_texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((all_texts[r.doc_id] or "").encode()), n, n > 512)


def test_op3(spark, docs, tables):
    all_texts, features = texts(docs), {}
    for r in rows(spark, tables, "op3_media"):
        raw = (all_texts[r.doc_id] or "").encode()
        payload = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        data = media.write_avi(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest())
        assert features.setdefault(raw, r.feature) == r.feature


def test_op4_op6(spark, docs, tables):
    all_texts = texts(docs)
    for r in rows(spark, tables, "op4_language_id"):
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, all_texts[r.doc_id] or "")))
    for r in rows(spark, tables, "op6_quality"):
        want = base(all_texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_op5_op9(spark, tables):
    got = rows(spark, tables, "op5_html")
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {(r.page_id, r.text) for r in got} == {(1, "one & é"), (2, ""), (3, ""), (None, "two")}
    archived = rows(spark, tables, "op9_warc")
    assert len(archived) == 5 and sum(r.record_type == "response" for r in archived if r.page_id in (2, 3)) == 1
    assert html_extract.host_of  # the host of a null url is the empty name


def test_op7(spark, docs, tables):
    all_texts = texts(docs)
    known = sorted(k for k in all_texts if k is not None)
    want = dict(zip(known, brute_components(np.array([naive_fingerprint(all_texts[k]) for k in known], np.uint64), known), strict=True))
    for r in rows(spark, tables, "op7_simhash"):
        assert r.fingerprint == f"{naive_fingerprint(all_texts[r.doc_id]):016x}" and r.component_id == want.get(r.doc_id)


def test_op10(spark, docs, tables):
    got, all_texts = rows(spark, tables, "op10_packing"), texts(docs)
    places: dict[int, list] = {}
    for r in got:
        own = np.append(ids(WORD, all_texts[r.doc_id]), np.uint32(0)).astype("<u4")[r.start : r.start + r.length]
        assert r.start == 2048 * r.piece and len(own) == r.length and r.ids_crc32 == zlib.crc32(own.tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in got) == sum(len(ids(WORD, r.text)) + 1 for r in docs.collect())


def test_stages_keep_clashing_columns(spark, docs, tables):
    names = ["_kept", "kept_id", "kept", "base_failed", "_quality", "_limits", "limits", "features", "failed", "passes", "score", "lang_pred", "_language", "language", "found", "sure", "part", "id", "a", "b", "n", "sign", "gram", "text_"]
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    plain = [(k, " ".join(word() for _ in range(40)), "en" if k % 3 else None, "s", 1) for k in range(30)]
    table = spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n_chars long")
    table = table.selectExpr("*", *(f"concat('{n}', doc_id) as `{n}`" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, tables)
        assert out.columns == table.columns
        kept = out.collect()
        assert len(kept) == 30
        for r in kept:
            assert all(r[n] == f"{n}{r.doc_id}" for n in names) and (r.lang in ("en", None)) and r.text == plain[r.doc_id][1]
    assert corpus_pipeline.identify_language(spark, table, tables).where("lang is null").count() == 0
