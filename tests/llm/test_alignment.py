"""Alignment of two tokenizers against both libraries and plain loops over their tokens."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from memlake.llm import alignment as al
from memlake.llm import queries
from memlake.llm.bpe import byte_alphabet

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BYTE_OF = {c: b for b, c in enumerate(byte_alphabet())}


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE)


def tokens(libraries, text):
    """Ids and bytes of both sides, empty where a side does not spell the text."""
    a, b = libraries
    if not text:
        return [], [], [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(BYTE_OF[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    want = (" " + text).encode()
    return (ids_a, ids_b, bytes_a, bytes_b) if b"".join(bytes_a) == want == b"".join(bytes_b) else ([], [], [], [])


def plain(libraries, text):
    """Groups and links of a text."""
    ids_a, ids_b, bytes_a, bytes_b = tokens(libraries, text)
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    shared, groups, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
    for cut in shared:
        x, y = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
        groups.append((ids_a[i:x], ids_b[j:y]))
        i, j = x, y
    links = []
    for n, (x, end) in enumerate(zip(ids_a, ends_a, strict=True)):
        start = end - len(bytes_a[n])
        links += [(x, y) for m, (y, stop) in enumerate(zip(ids_b, ends_b, strict=True)) if stop > start and stop - len(bytes_b[m]) < end]
    return groups, links


def random_texts(n, seed):
    rng = np.random.default_rng(seed)
    alphabet = list("abcdeTHE .,!?'\n\t 0123") + ["the", " of", "ing", "é", "ß", "日本", "😀", "▁", " ", "  ", "<|endoftext|>", "<s>", "<0x41>", "\x00", "\x1f", "Ｆ", "ال", "कि"]
    return ["".join(rng.choice(alphabet, int(rng.integers(0, 40)))) for _ in range(n)]


def test_groups_equal_plain_loops(libraries):
    texts = [None, "", " ", "a ", " a", "\n", "a\nb", "▁", "x▁y", "The quick brown fox <|endoftext|>", *random_texts(1500, 3)]
    found = al.aligner(A_FILE, B_FILE).align(pa.array(texts, pa.string()))
    digests = al.aligner(A_FILE, B_FILE).digests(found)
    of, pair = found.links()
    for k, text in enumerate(texts):
        groups, links = plain(libraries, text)
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        assert digests[k] == (hashlib.sha256(spelled.encode()).hexdigest() if groups else "")
        assert found.groups[k] == len(groups)
        assert [(int(p) >> al.BITS, int(p) & (1 << al.BITS) - 1) for p in pair[of == k]] == links
        assert len(links) == found.a_counts[k] + found.b_counts[k] - len(groups)


def test_cuts_of_long_stretches_without_any(libraries):
    """One text whose ends meet only at its border, beside one where all meet."""
    a, b = np.array([2, 4, 6, 8, 10, 11, 12, 13]), np.array([1, 3, 5, 7, 10, 11, 12, 13])
    cuts = al.shared_cuts(a, b, np.array([5, 0, 3]), np.array([5, 0, 3]))
    assert [c.tolist() for c in cuts] == [[4, 5, 6, 7], [4, 5, 6, 7]]
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(0, n + 1))), n)) for _ in range(2)]
        got = al.shared_cuts(*ends, *(np.array([len(e)]) for e in ends))
        both = np.intersect1d(*ends)
        assert ends[0][got[0]].tolist() == both.tolist() == ends[1][got[1]].tolist()


def statistics(libraries, texts):
    each = [plain(libraries, t) for t in texts]
    held = Counter(p for _, links in each for p in set(links))
    most: dict = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    rows = []
    for text, (groups, links) in zip(texts, each, strict=True):
        ids_a, ids_b, _, _ = tokens(libraries, text)
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(held[p] == most[p[0]] for p in links)
        rows.append((len(ids_a), len(ids_b), len(groups), len(links), best, sum(held[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    return rows


def test_query(spark, docs, libraries, tmp_path):
    short = docs.where("length(text) < 10000 or text is null")
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(random_texts(60, 8))], "doc_id long, text string")
    table = short.unionByName(more, allowMissingColumns=True).selectExpr("*", "1 as part", "2 as seq", "3 as pairs", "4 as keys")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text) for r in table.collect()]
    want = sorted(((k, *s) for (k, _), s in zip(rows, statistics(libraries, [t for _, t in rows]), strict=True)), key=lambda r: (r[0] is not None, r[0] or 0, r))
    got = sorted((tuple(r) for r in queries.op12_token_alignment(spark, str(tmp_path)).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r))
    assert got == want


def test_groups_column_and_empty_table(spark, docs, libraries):
    rows = al.align(docs, A_FILE, B_FILE).select("text", "groups", "kept").collect()
    for r in rows:
        if len(r.text or "") < 10_000:
            assert [(g.a, g.b) for g in r.groups] == plain(libraries, r.text)[0]
        assert r.kept == "x"
    assert al.link_statistics(docs.where("false"), A_FILE, B_FILE).count() == 0


def values(x):
    """Numbers and texts in a row, those in its lists included."""
    return sum(map(values, x)) if isinstance(x, list | tuple) else 1


def test_slices_are_written_in_small_rows(spark, monkeypatch, libraries):
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(3000)])
    texts = [" ".join(rng.choice(words, 300)) for _ in range(60)] + ["", None, *random_texts(40, 4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    written, keep = [], al.materialize
    monkeypatch.setattr(al, "materialize", lambda frame, name: written.append(keep(frame, name)) or written[-1])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = al.link_statistics(df, A_FILE, B_FILE)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a slice's rows come in several batches
        got = sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == [(k, *s) for k, s in enumerate(statistics(libraries, texts))]
    rows = written[0].collect()
    assert sum(map(values, rows)) > 40_000  # one slice
    assert max(map(values, rows)) < 8_000
