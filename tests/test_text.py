"""Scalar expressions on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from memlake.functions import dates as dt
from memlake.functions import text as tx
from memlake.functions import vectors as vx
from memlake.operators import cleanup as cl


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [("abcdef", 4, 2, ["abcd", "cdef", "ef"]), ("abcdef", 3, 0, ["abc", "def"]), ("abc", 0, 0, []), ("abc", 2, 9, ["ab", "bc", "c"]), ("", 3, 1, []), ("a   b", 2, 0, ["a ", "b"]), (None, 3, 1, [])],
)
def test_windows(spark, text, size, overlap, want):
    assert one(spark, tx.windows(F.lit(text).cast("string"), size, overlap)) == want


def test_pair_text_round_trip(spark):
    pair = tx.compose_pair(F.lit(" hi User: x "), F.lit("yes\r\nno "))
    assert tuple(one(spark, tx.split_pair(pair))) == ("hi User: x", "yes\nno")
    assert tuple(one(spark, tx.split_pair(F.lit("just text ")))) == ("", "just text")


@pytest.mark.parametrize(("a", "b", "want"), [("same", "same", True), ("what is the best way to do it now", "best way to do it", True), ("short one", "one", False), ("", "x", False)])
def test_equivalent(spark, a, b, want):
    assert one(spark, tx.equivalent(tx.text_key(F.lit(a)), tx.text_key(F.lit(b)))) is want


def test_keys_and_labels(spark):
    assert one(spark, tx.question_key(F.lit(" What’s `this`?? "), F.lit("A-B"))) == "whats this||a b"
    assert one(spark, tx.snake_case(F.lit(" Hello, World! "))) == "hello_world"
    assert one(spark, tx.entry_heading(F.lit(None).cast("string"), F.lit("h"))) == "## Memory Entry: h"
    assert one(spark, tx.topics_list(F.lit("a, b;; c "))) == ["a", "b", "c"]
    assert one(spark, tx.capitalize_first(F.lit("  été"))) == "  Été"
    assert one(spark, tx.compact_list(F.array(F.lit("A"), F.lit("a"), F.lit("b"), F.lit("c")))) == ["A", "b"]


def test_middle_cut(spark):
    assert one(spark, F.char_length(tx.middle_cut(F.lit("x" * 1000), 50, 500))) == 500 + len(tx.CUT_NOTICE)
    assert one(spark, tx.middle_cut(F.lit("x" * 150), 90, 100)) == "x" * 150
    assert one(spark, F.char_length(tx.middle_cut(F.lit("x" * 300), 90, 100))) == 200 + len(tx.CUT_NOTICE)


def test_contextual_turn(spark):
    assert one(spark, tx.contextual_turn(F.lit(" q "), F.lit('{"semantic_handle": "h", "intent": " ", "type": "t"}'))) == "q Context: h. Type: t"
    assert one(spark, tx.contextual_turn(F.lit("q"), F.lit("not json"))) == "q"


def test_hash_payload_skips_nulls(spark):
    assert one(spark, tx.hash_payload({"b": F.lit("x\r\ny"), "a": F.lit(None).cast("string"), "c": F.lit("z")})) == "b=x\ny\nc=z"


def test_time_stamps(spark):
    now = F.lit("2001-02-03 04:05:06").cast("timestamp")
    assert one(spark, dt.compact(F.lit("01-02-2024_03:04:05"), now)) == "20240102_030405"
    assert one(spark, dt.compact(F.lit("2024-01-02T03:04:05Z"), now)) == "20240102_030405"
    assert one(spark, dt.compact(F.lit("nonsense"), now)) == "20010203_040506"
    assert one(spark, dt.local_from_iso(F.lit("nonsense"), now)) == "nonsense"
    assert one(spark, dt.dashed(F.lit("1/2"))) == "1-2"


def test_vectors(spark):
    assert one(spark, vx.normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, vx.normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, vx.cosine_from_l2(F.lit(-1.0))) == 0.0
    assert one(spark, vx.cosine_from_l2(F.lit(0.5))) == 0.875


def test_front_trim(spark):
    rows = spark.createDataFrame([(1, "Great question! Sure. Here we go."), (2, "Certainly."), (3, "Plain. Sure."), (4, "It’s fine. Sure, yes.")], "id int, t string")
    got = {r.id: (r.t, r.front_prefixes, r.front_blocked) for r in cl.trim_front(rows, "t").collect()}
    assert got[1] == ("Here we go.", ["great question", "sure"], False)
    assert got[2] == ("Certainly.", [], True)
    assert got[3] == ("Plain. Sure.", [], False)
    assert got[4][1] == []


def test_end_trim(spark):
    fenced = "body\n\n```\nLet me know if x\n```"
    rows = spark.createDataFrame([(1, "body\n\nLet me know if it works."), (2, fenced), (3, "Let me know if so."), (4, "a\n\nFeel free to ask.\n\nend"), (5, "a\n\n- let me know if")], "id int, t string")
    got = {r.id: (r.t, r.end_blocked) for r in cl.trim_end(rows, "t").collect()}
    assert got == {1: ("body", False), 2: (fenced, False), 3: ("Let me know if so.", True), 4: ("a", False), 5: ("a\n\n- let me know if", False)}


def test_whitespace(spark):
    text = "a   b  \n\n\n\nc\n```\nx   y\n\n\n```\nd"
    assert one(spark, cl.compact_whitespace(F.lit(text))) == "a b\n\nc\n```\nx   y\n\n\n```\nd"


def test_similar_sentences(spark):
    text = "The cat sat on the mat today. The cat sat on the mat today! Dogs bark loudly at night. On the mat the cat sat today. Version 2 is out. Version 2 is out."
    got = [r.dropped for r in cl.similar_sentences(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("sentence_no").collect()]
    assert got == [False, True, False, True, False, False]


def test_token_set_ratio():
    assert cl.token_set_ratio("a b c", "c b a") == 100.0
    assert cl.token_set_ratio("", "a") == 0.0
    assert cl.token_set_ratio("new york mets", "new york yankees") < 90
    assert round(cl._indel("abcd", "abxd"), 6) == 75.0
