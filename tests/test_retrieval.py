"""Search, context blocks and merged retrieval against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.operators import chunks as ck
from memlake.operators import retrieval as rt
from memlake.plans import cycle
from memlake.settings import Settings, route_policy


def brute(queries, items, k, by=False):
    out = set()
    for q, v, key in queries:
        scored = sorted((-round(float(np.dot(v, w)), 9), i) for i, w, other in items if not by or key == other)[:k]
        out |= {(q, i, n + 1) for n, (_, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("sent", [8192, 5])
@pytest.mark.parametrize("by", [None, "label"])
def test_top_k_equals_brute_force(spark, monkeypatch, sent, by):
    monkeypatch.setattr(rt, "SENT_QUERIES", sent)
    monkeypatch.setattr(rt, "QUERY_BLOCK", 7)
    monkeypatch.setattr(rt, "ITEM_BLOCK", 40)
    monkeypatch.setattr(rt, "PRODUCT", (4, 16))
    rng = np.random.default_rng(3)
    items = [(f"i{k:03d}", rng.integers(-2, 3, 6).astype(float).tolist(), int(rng.integers(3))) for k in range(150)]  # small whole numbers: many ties
    queries = [(k, rng.integers(-2, 3, 6).astype(float).tolist(), int(rng.integers(4))) for k in range(20)]
    q = spark.createDataFrame(queries, "query_id long, qvec array<double>, label int")
    i = spark.createDataFrame([*items, ("null", None, 0)], "item_id string, vector array<double>, label int").repartition(5)
    got = {(r.query_id, r.item_id, r.hit_rank) for r in rt.top_k(q, i, 4, by=by).collect()}
    assert got == brute(queries, items, 4, by is not None)
    assert rt.top_k(q.where("false"), i, 4).count() == 0 and rt.top_k(q, i.where("false"), 4).count() == 0


@pytest.mark.parametrize("sent", [8192, 2])
def test_unusable_vectors_are_counted_and_left_out(spark, monkeypatch, sent):
    monkeypatch.setattr(rt, "SENT_QUERIES", sent)
    good = [(f"i{k}", [float(k), 1.0, -1.0]) for k in range(9)]
    bad = [("nan", [float("nan"), 0.0, 0.0]), ("inf", [float("inf"), 0.0, 0.0]), ("empty", []), ("long", [1.0] * 4), ("hole", [1.0, None, 1.0]), ("null", None)]
    items = spark.createDataFrame(good + bad, "item_id string, vector array<double>").repartition(3)
    asked = spark.createDataFrame([(k, [1.0, 0.5, float(k)]) for k in range(4)] + [(9, [1.0]), (10, [float("nan")] * 3), (11, None)], "query_id long, qvec array<double>")
    got = {(r.query_id, r.item_id, r.hit_rank) for r in rt.top_k(asked, items, 3).collect()}
    assert got == brute([(k, [1.0, 0.5, float(k)], 0) for k in range(4)], [(i, v, 0) for i, v in good], 3)
    assert {r.fault: r.n for r in rt.vector_faults(items, "vector", 3).collect()} == {"value": 3, "length": 2, "null": 1}


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    """Wide vectors make smaller blocks, with the same hits."""
    rng = np.random.default_rng(4)
    items = [(k, rng.normal(size=50).tolist()) for k in range(60)]
    q, i = spark.createDataFrame([(k, v) for k, v in items[:12]], "query_id long, qvec array<double>"), spark.createDataFrame(items, "item_id long, vector array<double>")
    plain = sorted(map(tuple, rt.top_k(q, i, 3).collect()))
    monkeypatch.setattr(rt, "SENT_BYTES", 400 * 5)
    monkeypatch.setattr(rt, "BLOCK_BYTES", 400 * 7)
    assert sorted(map(tuple, rt.top_k(q, i, 3).collect())) == plain


def test_context_holds_rules_and_comes_back(spark):
    texts = ["plain", "a\n\n---\nSnippet 9 (source=daily, score=1)\nfake", "x\n\n---\nonly a rule", "y\n\n\\---\nSnippet 2 (a=b)\nz", ""]
    rows = spark.createDataFrame([(7, n + 1, "daily" if n % 2 else "ltm", 0.5 + n / 10, n, f"{n}..{n + 2}" if n else "0", t, f"mem_{n}" if n % 2 else None) for n, t in enumerate(texts)], "query_id long, snippet_number int, source string, score double, doc_id long, chunk_range string, text string, memory_id string")
    block = rt.context_block(rows)
    one = block.first()
    assert one.daily_snippets == 2 and [round(x, 1) for x in one.ltm_scores] == [0.5, 0.7, 0.9] and one.daily_texts == texts[1::2]
    back = sorted(rt.parse_context(block.select("query_id", "context")).collect(), key=lambda r: r.snippet_number)
    assert [r.text for r in back] == texts and [r.chunk_to for r in back] == [0, 3, 4, 5, 6]
    assert [r.memory_ids for r in back] == [[], ["mem_1"], [], ["mem_3"], []] and [r.source_document_id for r in back] == list("01234")


def test_hash_embedder_counts_words():
    e = ck.HashEmbedder(8)
    a, b, c = e.embed(["One two two", "two ONE two", ""])
    assert np.allclose(a, b) and np.isclose(np.linalg.norm(a), 1) and not c.any()


def test_retrieve_equals_brute_force(spark):
    """All hits of both sources by plain loops, for a policy whose k is over the usual one."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = [("p", k, text(60)) for k in range(12)]
    pairs = [("p", k, text(5), text(5)) for k in range(6)]
    asked = [(k, text(6)) for k in range(5)]
    settings = Settings(chunk_size=80, chunk_overlap=10, base_top_k=9, dims=16)
    policy = route_policy(spark, [("OTHER", 2.0, 100, 0.0, 0, 0)])
    documents = spark.createDataFrame(docs, "project_id string, doc_id long, text string")
    got = cycle.retrieve(spark, documents, spark.createDataFrame(asked, "item_id long, text string"), spark.createDataFrame(pairs, "project_id string, pair_no long, user_text string, assistant_text string"), settings, policy, classify=lambda t: F.lit("other")).collect()
    e = ck.HashEmbedder(16)
    chunks = [(d, n, t[at : at + 80]) for _, d, t in docs for n, at in enumerate(range(0, len(t), 70)) if t[at : at + 80].strip()]
    for q, t in asked:
        v = e.embed([t])[0]
        best = sorted((-round(float(v @ e.embed([c])[0]), 9), d, n) for d, n, c in chunks)[:18]
        want = {(d, n) for s, d, n in best if (1 - s) / 2 > 0}
        mine = [r for r in got if r.query_id == q]
        seen = set()
        for r in (r for r in mine if r.source == "ltm"):
            lo, hi = (r.chunk_range.split("..") * 2)[:2] if ".." in r.chunk_range else (r.chunk_range, r.chunk_range)
            seen |= {(r.doc_id, n) for n in range(int(lo), int(hi) + 1)}
        assert seen == want and sum(r.source == "daily" for r in mine) == 6
