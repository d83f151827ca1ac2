"""Quality, language and near-duplicate operators, and the pipeline."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from memlake.llm import language_id, quality, simhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = SPACE.findall(text or "")
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(k, k + 5))
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_rules_on_edges(docs, nothing):
    for r in quality.verdicts(docs).select("text", "_quality.*", "base_failed", "kept").collect():
        want = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.verdicts(nothing).count() == 0


def test_thresholds_follow_their_group(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for k in range(300):
        rows.append((k, " ".join(word(5) for _ in range(30)), "en", "news"))
        rows.append((1000 + k, " ".join(word(5) + "#" for _ in range(30)), "en", "code"))
    rows += [(5000, " ".join(word(5) + "#" for _ in range(30)), "en", "news"), (5001, " ".join(word(40) for _ in range(30)), "en", "news"), (5002, " ".join(word(5) for _ in range(30)), "en", "tiny")]
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[5000] and not got[5001] and got[5002]
    assert all(got[k] for k in range(300)) and all(got[1000 + k] for k in range(300))


def brute_verdicts(rows):
    """doc_id -> kept, by sorted lists in place of sketches of merged counts."""
    bucket = lambda v: v - v % (1 << max(0, v.bit_length() - quality.BITS))
    width = lambda v: 1 << max(0, v.bit_length() - quality.BITS)
    facts = {k: (base(text), lang, source) for k, text, lang, source in rows}

    def summary(group, metric):
        values = sorted(bucket(f[c] * unit // f[0]) for f in group)
        n, some = len(values), sorted(v for v in values if v > 0)
        first = lambda v, q: v[-(-len(v) * q // 4) - 1]
        a, b, end = first(values, 1), first(values, 2), first(values, 3)
        return n, (a, b, b + width(b), end + width(end), len(some) * first(some, 1) // n if some else 0)

    limits = {}
    for lang, source in {f[1:] for f in facts.values()}:
        for metric, c, unit in (("word_length", 1, 1000), ("symbols", 2, 100_000), ("dup_lines", 3, 100_000)):
            fit = [f for f in facts.values() if f[0][0] >= 10]
            groups = [[f[0] for f in fit if want(f)] for want in (lambda f: True, lambda f: f[1] == lang, lambda f: f[1:] == (lang, source))]
            if not groups[2]:
                continue
            _, drawn = summary(groups[0], metric)
            for g in groups[1:]:
                n, own = summary(g, metric)
                drawn = tuple((n * x + quality.PRIOR * y) // (n + quality.PRIOR) for x, y in zip(own, drawn, strict=True))
            limits[lang, source, metric] = drawn

    def kept(k):
        (n, chars, symbols, lines, repeats), lang, source = facts[k]
        if n < 10 or 100 * repeats > 20 * n:
            return False
        a, b, b_end, c_end, _ = limits[lang, source, "word_length"]
        within = b - quality.SPREAD * (b_end - a) <= chars * 1000 // n <= b + quality.SPREAD * (c_end - b)
        usual = lambda m: limits[lang, source, m][4]
        return within and all(x * 100_000 <= quality.RATE_SPREAD * (usual(m) * n + 100_000) for x, m in ((symbols, "symbols"), (lines, "dup_lines")))

    return {k: kept(k) for k in facts}


def test_verdicts_equal_brute_force(spark):
    rng, rows = random.Random(6), []
    for k in range(400):
        n, share = rng.choice([3, 12, 40, 200]), rng.choice([0, 0, 0, 0.1, 1])
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.choice([4, 5, 6, 60 if k % 40 == 0 else 5]))) + ("#" * rng.choice([1, 3]) if rng.random() < share else "") for _ in range(n))
        text += "".join(f"\nx{k} y" for _ in range(rng.choice([0, 0, 0, 2, 30])))
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["news", "news", "code", None])))
    got = {r.doc_id: r.kept for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    want = brute_verdicts(rows)
    assert got == want and 50 < sum(want.values()) < 350


def test_rate_fences_follow_the_rate_not_the_length(spark):
    """Groups of one rate and different lengths have one usual rate; groups of one length and different rates have not."""
    rng, rows, k = random.Random(7), [], 0
    for source, n, every in (("short", 20, 10), ("long", 2000, 10), ("rare", 200, 100), ("often", 200, 5)):
        for d in range(400):
            # One document in four shows symbols.
            rows.append((k := k + 1, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) + ("#" if d % 4 == 0 and w % every == 0 else "") for w in range(n)), source, source))
    found = quality.thresholds(quality.sketches(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()
    usual = {r.source: r.usual_symbols for r in found}
    assert abs(usual["short"] - usual["long"]) <= 0.02 * usual["long"]
    assert usual["rare"] < usual["long"] < usual["often"] and usual["often"] > 3 * usual["rare"]


def test_sketches_merge(spark):
    rows = spark.createDataFrame([(k, " ".join(["abcdefgh"[: 3 + k % 5]] * 12), "en", f"s{k % 3}") for k in range(90)], "doc_id long, text string, lang string, source string")
    s = quality.sketches(rows)
    apart = quality.sketches(rows.where("doc_id < 40")).unionByName(quality.sketches(rows.where("doc_id >= 40")))
    key = lambda d: sorted(map(tuple, quality.thresholds(d).collect()))
    assert key(s) == key(apart)


def brute_code_length(words_of, text, order=language_id.ORDER):
    """Bits of a text under one language's counts, byte by byte."""
    counts: dict[bytes, Counter] = {}
    for word, n in words_of.items():
        coded = b" " + word + b" "
        for i in range(1, len(coded)):
            for k in range(min(order, i) + 1):
                counts.setdefault(coded[i - k : i], Counter())[coded[i]] += n
    bits = 0.0
    for word in text.encode().split(b" "):
        coded = b" " + word + b" "
        for i in range(1, len(coded)):
            for k in range(min(order, i), -1, -1):
                seen = counts.get(coded[i - k : i])
                if seen is None:
                    continue
                n, d = sum(seen.values()), len(seen)
                if coded[i] in seen:
                    bits += np.log2((n + d) / seen[coded[i]])
                    break
                bits += np.log2((n + d) / d)
            else:
                bits += 8
    return bits


def test_code_lengths_equal_brute_force(spark):
    texts = {"en": "the cat and the hat  sat", "de": "der hund und die katze äß"}
    rows = spark.createDataFrame([(k, t) for k, t in texts.items()], "lang string, text string")
    found = language_id._count_grams(rows).toPandas()
    model = language_id.Model(*(found[c].to_numpy() for c in ("lang", "depth", "gram", "n")))
    for text in ("the hund", "", "ß x  katze", "zzz"):
        flat, _ = model.code_lengths(text.split(" "))
        got = flat.reshape(-1, 3)[:, :2].sum(axis=0)
        want = [brute_code_length(Counter(t.encode().split(b" ")), text) for t in (texts["de"], texts["en"])]
        assert np.allclose(got, want, rtol=1e-4)


def test_language_learns_and_holds_out(spark, docs, nothing):
    rng = random.Random(4)
    make = lambda words: " ".join(rng.choice(words) for _ in range(40))
    rows = [(k, make(["the", "and", "house", "water"]) if k % 2 else make(["der", "und", "haus", "wasser"]), "en" if k % 2 else "de") for k in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(train)
    got = language_id.predict(train, model).withColumn("held", language_id.held_out(train.doc_id)).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    edge = language_id.predict(docs, model)
    assert edge.columns[-2:] == ["lang_pred", "score"] and edge.columns.count("score") == 1
    for r in edge.collect():
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or "")))
    assert language_id.predict(nothing, model).count() == 0
    untaught = language_id.predict(docs, language_id.train(nothing)).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}


def naive_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = SPACE.findall(low)
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 2) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(fps))]


@pytest.mark.parametrize("split", [8, 64, 512])
def test_links_equal_brute_force(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = np.random.default_rng(split)
    found = []
    for centre in rng.integers(0, 2**64, 3, dtype=np.uint64):
        x = centre
        for _ in range(250):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                y ^= np.uint64(1) << np.uint64(b)
            found.append(y)
            x = y if rng.random() < 0.3 else x
    fps = np.unique(np.array([*found, *rng.integers(0, 2**64, 200, dtype=np.uint64), 0], np.uint64))
    rng.shuffle(fps)
    nodes = spark.createDataFrame([(int(k), int(f)) for k, f in enumerate(fps.view(np.int64))], "id long, fp long")
    got = {r.id: r.component for r in simhash.components(simhash.links(nodes)).collect()}
    assert [got.get(k, k) for k in range(len(fps))] == brute_components(fps, range(len(fps)))


def test_gray_rank_is_a_gray_order():
    code = np.arange(256, dtype=np.uint64) ^ (np.arange(256, dtype=np.uint64) >> np.uint64(1))
    assert np.array_equal(simhash.gray_rank(code), np.arange(256))


def test_near_duplicates_on_edges(docs, nothing):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = sorted({r.doc_id for r in rows if r.doc_id is not None})
    fps = np.array([naive_fingerprint(texts[k]) for k in known], np.uint64)
    want = dict(zip(known, brute_components(fps, known), strict=True))
    for r in rows:
        assert r.fp == int(np.uint64(naive_fingerprint(texts[r.doc_id])).view(np.int64))
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    kept = [r.doc_id for r in simhash.one_of_each(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(want.values())) and kept.count(None) == 1
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.one_of_each(nothing).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)], "a long, b long")
    assert {r.component for r in simhash.components(edges).collect()} == {0}


def test_pipeline(spark, docs, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rng = random.Random(9)
    make = lambda words, n: " ".join(rng.choice(words) + rng.choice("abcdefgh") for _ in range(n))
    rows = [(100 + k, make(["the", "and", "house", "water"], 60), "en", "s", 1) for k in range(60)]
    rows += [(300 + k, rows[k][1], "en", "s", 1) for k in range(5)] + [(400, "## %% " * 40, "en", "s", 1), (401, "12 34 !!", None, None, 1)]
    clean = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean.unionByName(docs.select(*columns)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in rows}
    assert set(range(100, 160)) <= kept and not kept & {300, 301, 302, 303, 304, 400, 401, 0, 1, 2, 10, 11}
    used: dict[int, int] = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048
    stage = clean.select(*columns)
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == columns
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, clean.where("false"), str(tmp_path)).count() == 0
