"""Chat, question, telemetry and ingest operators against plain loops."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from memlake.operators import artifacts as ar
from memlake.operators import chat, ingest
from memlake.operators import chunks as ck
from memlake.operators import questions as qs
from memlake.operators import retrieval as rt
from memlake.operators import telemetry as tm
from memlake.settings import ROUTE_POLICY, Settings, route_policy

MESSAGE = "project_id string, id long, role string, content string, forget boolean, semantic_handle string"


def make(spark, roles, project="p", forget=()):
    return spark.createDataFrame([(project, k, r, f"t{k}", k in forget, None) for k, r in enumerate(roles)], MESSAGE)


def naive_roll_off(roles, limit):
    rows, action = list(enumerate(roles)), {}
    while True:
        pairs = [i for i in range(len(rows) - 1) if rows[i][1] == "user" and rows[i + 1][1] == "assistant"]
        if len(pairs) <= limit:
            break
        i = pairs[0]
        for k, _ in rows[:i]:
            action[k] = "delete"
        action[rows[i][0]] = action[rows[i + 1][0]] = "roll"
        rows = rows[i + 2 :]
    return {k: action.get(k, "keep") for k, _ in enumerate(roles)}


def test_roll_off_equals_loop(spark):
    rng = random.Random(7)
    for limit in (0, 1, 3):
        cases = [[rng.choice(["user", "assistant", "system"]) for _ in range(rng.randint(0, 14))] for _ in range(40)]
        rows = [(str(c), k, r, "x", False, None) for c, roles in enumerate(cases) for k, r in enumerate(roles)]
        got = {(r.project_id, r.id): r.action for r in chat.roll_off(spark.createDataFrame(rows, MESSAGE), limit).collect()}
        want = {(str(c), k): a for c, roles in enumerate(cases) for k, a in naive_roll_off(roles, limit).items()}
        assert got == want


def test_flush_counts_only_staged(spark):
    roles = ["user", "assistant"] * 5
    got = chat.flush(chat.pairs(make(spark, roles, forget={1, 5})), 2).orderBy("pair_no").collect()
    assert [(r.pair_no, r.staged) for r in got] == [(1, False), (2, True), (3, False), (4, True)]


def test_trimmed_edges(spark):
    got = chat.trimmed_edges(make(spark, ["assistant", "system", "user", "assistant", "user"])).orderBy("id").collect()
    assert [r.id for r in got] == [2, 3]


def naive_select(hits, keep):
    kept, limit = [], keep
    for h in hits:
        if len(kept) >= limit:
            break
        kept.append(h)
        if len(kept) > 1 and kept[-2][1] == h[1] and abs(kept[-2][2] - h[2]) == 1:
            limit += 1
    return kept


def test_selection_equals_loop(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for q in range(80):
        keep = rng.randint(0, 4)
        hits = [(pos, rng.choice("ab"), rng.randint(0, 4)) for pos in range(rng.randint(0, 10))]
        rows += [(q, pos, d, k, keep) for pos, d, k in hits]
        want |= {(q, h[0]) for h in naive_select(hits, keep)}
    df = spark.createDataFrame(rows, "query_id int, pos int, doc_id string, chunk_index int, max_keep int")
    assert {(r.query_id, r.pos) for r in rt.select_with_bonus(df).collect()} == want


def test_tiers(spark):
    df = spark.createDataFrame([(1, p, 3, 5) for p in range(5)], "query_id int, pos int, expansion_before int, expansion_after int")
    assert [(r.before_n, r.after_n) for r in rt.tiers(df).orderBy("pos").collect()] == [(3, 5), (3, 5), (2, 3), (2, 3), (1, 1)]


def test_trim_uses_trimmed_left_text(spark):
    rows = [(1, 0, "d", "abcd"), (1, 1, "d", "cdab"), (1, 2, "d", "abxy"), (1, 3, "e", "xyz"), (1, 4, "e", "xyz")]
    got = rt.trim_overlap(spark.createDataFrame(rows, "query_id int, ord int, doc_id string, t string").withColumn("k", F.lit(1)), 3, "t").orderBy("ord").collect()
    assert [r.t for r in got] == ["abcd", "ab", "xy", "xyz", "xyz"]


def test_collapse(spark):
    rows = [(1, 0, "d", "ltm", 0.9, 0, "a"), (1, 1, "d", "ltm", 0.8, 1, "b"), (1, 2, "d", "ltm", 0.7, 3, "c"), (1, 3, None, "daily", 0.6, None, "k"), (1, 4, None, "daily", 0.5, None, "l")]
    got = rt.collapse(spark.createDataFrame(rows, "query_id int, ord int, doc_id string, source string, score double, idx int, t string"), "t").orderBy("snippet_number").collect()
    assert [(r.chunk_range, r.text) for r in got] == [("0..1", "ab"), ("3", "c"), (None, "k"), (None, "l")]


def test_context_round_trip(spark):
    rows = [(1, 1, "ltm", 0.9, 7, "0..2", 3, "first\ntext"), (1, 2, "daily", 0.8, 8, "4", 1, "second")]
    df = spark.createDataFrame(rows, "query_id int, snippet_number int, source string, score double, doc_id long, chunk_range string, members int, text string")
    back = rt.parse_context(rt.context_block(df)).orderBy("snippet_number").collect()
    assert [(r.source, r.score, r.chunk_range, r.source_document_id, r.text) for r in back] == [("ltm", 0.9, "0..2", "7", "first\ntext"), ("daily", 0.8, "4", "8", "second")]


def test_policy_falls_back_and_validates(spark):
    got = rt.with_policy(spark.createDataFrame([(1, " direct"), (2, None), (3, "x")], "query_id int, route string"), route_policy(spark), 6).orderBy("query_id").collect()
    assert [(r.policy_route, r.per_source_k) for r in got] == [("DIRECT", 6), ("OTHER", 11), ("OTHER", 11)]
    for bad in ([("OTHER", -1.0, 1, 0.5, 0, 0)], ROUTE_POLICY[:2]):
        try:
            route_policy(spark, bad)
        except ValueError:
            continue
        raise AssertionError("a bad policy was accepted")


def test_consolidate_later_ignore_cancels(spark):
    rows = [("p", 1, "1", "Why?", "t", "answer_local"), ("p", 2, "2", "why", "T", "ignore"), ("p", 3, "1", "How", "t", "odd"), ("p", 4, "1", "Who", "t", "answer_remote"), ("p", 5, "0", "who", "t", "answer_local"), ("p", 6, "9", " ", "t", "answer_local")]
    got = qs.consolidate(spark.createDataFrame(rows, "project_id string, line_no long, ts string, question string, topic string, resolution string")).collect()
    assert [(r.question, r.resolution) for r in got] == [("Who", "answer_remote")]


def key_of(text):
    return re.sub("[^a-z0-9]+", " ", re.sub("['\"`“”’]", "", text.lower())).strip()


def same(a, b):
    return bool(a and b) and (a == b or (len(a) >= 24 and b in a) or (len(b) >= 24 and a in b))


def test_fuzzy_matches_equal_brute_force(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
    a, b = [text() for _ in range(40)], [text()[rng.randint(0, 3) :] for _ in range(40)]
    ideas = spark.createDataFrame([("p", k, t) for k, t in enumerate(a)], "project_id string, idea_id long, origin_text string")
    asked = spark.createDataFrame([("p", k, t) for k, t in enumerate(b)], "project_id string, question_no long, question string")
    got = {(r.idea_id, r.question_no) for r in qs.matches(ideas, asked).collect()}
    assert got == {(x, y) for x, s in enumerate(a) for y, t in enumerate(b) if same(key_of(s), key_of(t))}


def test_bridge_matches_injected(spark):
    asked = spark.createDataFrame([("p", 1, "what is the deal with long questions", True), ("p", 2, "deal with long questions", True), ("p", 3, "known idea", True)], "project_id string, question_no long, question string, used_remote_research boolean")
    ideas = spark.createDataFrame([("p", 9, "Known idea")], "project_id string, idea_id long, origin_text string")
    got = {r.question_no: (r.action, r.item) for r in qs.bridge(ideas, asked).collect()}
    assert got == {1: ("injected_synthetic_item", "remote-1"), 2: ("matched_existing_item", "remote-1"), 3: ("matched_existing_item", "9")}


def test_token_batches(spark):
    rows = spark.createDataFrame([("p", k, n) for k, n in enumerate([5, 6, 20, 1, 9, 1])], "p string, k int, n int")
    assert [r.batch_id for r in ck.token_batches(rows, ["p"], ["k"], "n", 10).orderBy("k").collect()] == [0, 1, 2, 3, 3, 4]


def test_monotone_turns(spark):
    rows = spark.createDataFrame([("r", a, t) for a, t in enumerate([1, 3, 2, 3, 5])], "run_id string, arrival int, turn_id int")
    assert [r.turn_id for r in tm.monotone_turns(rows).orderBy("arrival").collect()] == [1, 3, 5]


def test_balanced_json(spark):
    rows = spark.createDataFrame([(1, 'x {"a": {"b": "}"}} y'), (2, "{broken"), (3, None)], "id int, t string")
    assert {r.id: r.json for r in ingest.balanced_json(rows, "t").collect()} == {1: '{"a": {"b": "}"}}', 2: None, 3: None}


def test_admission_limits(spark):
    files = spark.createDataFrame([("p", 1, "a.TXT", 5), ("p", 1, "b.md", 6), ("p", 1, "c.pdf", 1), ("p", 1, "d.txt", 50), ("p", 2, "e.txt", 9)], "project_id string, batch_id int, filename string, size_bytes long")
    none = spark.createDataFrame([], "project_id string, size_bytes long")
    got = {r.filename: r.reject_reason for r in ingest.admit(files, none, Settings(max_file_bytes=20, max_batch_bytes=10, max_project_bytes=13)).collect()}
    assert got == {"a.TXT": None, "b.md": "batch_too_large", "c.pdf": "extension", "d.txt": "file_too_large", "e.txt": "project_full"}


ENTRY = "<!-- begin memory_id={0} -->\n{1}\n<!-- end memory_id={2} -->\n"
A, B = "mem_20240101_000000_abcd", "mem_20240101_000000_abce"


def test_artifact_structure(spark):
    doc = "top\n" + ENTRY.format(A, "x", A) + ENTRY.format(A, "again", A) + ENTRY.format(B, "y", A) + "<!-- begin memory_id=bad -->\n" + f"<!-- begin memory_id={B} -->\nopen"
    docs = spark.createDataFrame([("f", doc), ("g", f"<!-- end memory_id={A} -->\n" + ENTRY.format(A, "ok", A)), ("h", "plain")], "f string, content string")
    found = ar.entries(docs, ["f"], "content").where("f = 'f'").orderBy("start_line").collect()
    assert [(r.memory_id, r.end_id, r.copy, r.text) for r in found] == [(A, A, 1, "x"), (A, A, 2, "again"), (B, A, None, "y")]
    assert doc[found[0].start_offset : found[0].end_offset] == ENTRY.format(A, "x", A)
    kinds = sorted((r.f, r.kind) for r in ar.warnings(docs, ["f"], "content").collect())
    assert kinds == [("f", "begin_without_end"), ("f", "duplicate"), ("f", "invalid_begin"), ("f", "mismatched_end"), ("g", "end_without_begin")]


def test_size_bounded(spark):
    rows = spark.createDataFrame([(1, 'a"b\n' * 100), (2, "short")], "id int, text string")
    got = {r.id: r for r in ar.size_bounded(rows, "text", 120).withColumn("n", F.char_length(F.to_json(F.struct("id", "text")))).collect()}
    assert got[1].truncated and 115 <= got[1].n <= 120 and not got[2].truncated and got[2].text == "short"
