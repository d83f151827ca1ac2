"""Models as hooks, whole-entry expansion and topic contexts."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.operators import artifacts as ar
from memlake.operators import chat
from memlake.operators import cleanup as cl
from memlake.operators import retrieval as rt
from memlake.operators.hooks import Model, applied
from memlake.plans import cycle
from memlake.settings import Settings, route_policy


def counting(folder: str) -> Callable[[], Callable[[list], list]]:
    """A classifier that leaves a file wherever it is loaded, and remembers what it has seen."""

    def make():
        open(f"{folder}/{os.getpid()}-{os.urandom(4).hex()}", "w").close()
        seen = []

        def run(texts: list) -> list:
            seen.extend(texts)
            return [None if t is None else ("direct " if "?" in t else "no such route") for t in texts]

        return run

    return make


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("text "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, "?").otherwise(""))).alias("text")).repartition(40)
    model = Model(counting(str(tmp_path)), T.StringType())
    got = {r.id: r.route for r in chat.with_route(rows, classify=model).collect()}
    assert got == {k: "DIRECT" if k % 3 and k % 2 == 0 else "OTHER" for k in range(4000)}
    workers = {f.split("-")[0] for f in os.listdir(tmp_path)}
    assert len(os.listdir(tmp_path)) == len(workers) < 40


def test_counter_and_column_hooks(spark):
    rows = spark.createDataFrame([("p", 1, 1, 2, "a b", "c", False)], "project_id string, pair_no int, user_id long, assistant_id long, user_text string, assistant_text string, forget boolean")
    none = spark.createDataFrame([], "project_id string, day_sequence int")
    by_letters = Model(lambda: lambda texts: [len(t) for t in texts], T.IntegerType())
    assert chat.daily_entries(rows, none, F.lit("01-02-2024_03:04:05"), count=by_letters).first().tokens == len("User: a b\nAssistant: c")
    assert chat.daily_entries(rows, none, F.lit("01-02-2024_03:04:05")).first().tokens == 5
    assert applied(rows, "user_text", F.upper, "up").first().up == "A B"


def test_entry_expansion_falls_back_in_order(spark):
    found = spark.createDataFrame([("a.md", "m1", " one "), ("a.md", "m1", "one twice"), ("b/c.md", "m2", "two")], "artifact_path string, memory_id string, text string")
    rebuilt = spark.createDataFrame([("d", "from chunks"), ("e", "")], "doc_id string, text string")
    paths = spark.createDataFrame([("a.md",), ("b/c.md",), ("empty.md",)], "artifact_path string")
    rows = [
        (1, "a.md", "m1", None, None, "own"), (2, "../a.md", "m2", "b\\c.md::memory_id=m2", None, "own"), (3, "a.md", "m2", "b/c.md::memory_id=m2", None, "own"), (4, "empty.md", "m9", None, "d", "own"),
        (5, "gone.md", "m9", "gone.md", "x", "own"), (6, None, "m9", "/abs", "e", ""), (7, "a.md", None, "gone.md", None, None),
    ]
    snippets = spark.createDataFrame(rows, "n int, artifact_path string, memory_id string, source_document_id string, doc_id string, text string")
    got = {r.n: (r.method, r.status, r.expanded, r.reason, r.warning) for r in ar.expand_entries(snippets, found, rebuilt, paths).collect()}
    assert got == {
        1: ("artifact", "expanded", "one", None, None), 2: ("source_document", "expanded", "two", None, None), 3: ("source_document", "expanded", "two", None, "path_mismatch"), 4: ("chunks", "fallback", "from chunks", "entry_not_found", None),
        5: ("original", "fallback", "own", "artifact_unknown", None), 6: ("original", "failed", "", "path_unusable", None), 7: ("original", "failed", "", "artifact_unknown", "path_mismatch"),
    }


def test_topic_context_is_every_topics_own(spark):
    words = [f"w{k}" for k in range(12)]
    documents = spark.createDataFrame([("p", k, " ".join(words[k % 6 :: 2] * 4)) for k in range(8)], "project_id string, doc_id long, text string")
    pairs = spark.createDataFrame([("p", 1, "w1 w3", "w5")], "project_id string, pair_no long, user_text string, assistant_text string")
    texts = spark.createDataFrame([(1, "=== TOPIC: w1 w3 ===\n#topics: w2, w4\nbody\n=== OPEN QUESTIONS ===\n=== TOPIC: w9 ==="), (2, "no topics"), (3, "=== TOPIC: unheard of ===")], "item_id long, text string")
    settings, policy = Settings(chunk_size=40, chunk_overlap=5, dims=16), route_policy(spark, [("EXPLORATORY", 1.0, 5, 0.6, 0, 1), ("OTHER", 0.0, 0, 0.0, 0, 0)])
    got = {r.item_id: r for r in cycle.topic_context(spark, texts, documents, pairs, settings, policy).collect()}
    assert (got[1].topics, got[2].topics, got[2].context) == (3, 0, "=== PROJECT RAG CONTEXT ===\n")
    want = "=== PROJECT RAG CONTEXT ===\n"
    for topic in ("w1 w3", "w2", "w4"):
        asked = spark.createDataFrame([("q", topic)], "item_id string, text string")
        hits = cycle.retrieve(spark, documents, asked, pairs, settings, policy, classify=lambda _: F.lit("EXPLORATORY"))
        block = rt.context_block(hits.withColumn("score", F.round("score", 6))).first()
        want += "" if block is None else f"Topic Query: {topic}\n{block.context}\n\n"
    assert got[1].context == want and got[1].found == want.count("Topic Query: ") > 0
    assert got[3].found == got[3].context.count("Topic Query: ") and (got[3].found or "No relevant" in got[3].context)


def test_latest_summary(spark):
    summaries = spark.createDataFrame([("a", " base "), ("b", "alone"), ("c", None)], "project_id string, text string")
    items = spark.createDataFrame([("a", 1, ["X", "y"]), ("a", 2, ["x", "Z"]), ("c", 1, ["only"])], "project_id string, idea_id int, recommended_research array<string>")
    got = {r.project_id: r.text for r in cycle.latest_summary(summaries, items).collect()}
    assert got == {"a": "base\n\n[RESEARCH]\nTopic: X\n\nTopic: y\n\nTopic: Z\n", "b": "alone", "c": "[RESEARCH]\nTopic: only\n"}


def test_terms_weigh_by_rarity(spark):
    pairs = spark.createDataFrame([("p", 1, "common common alpha", "Why alpha? because."), ("p", 2, "common beta", "x"), ("p", 3, "common", None), ("q", 1, None, None)], "project_id string, pair_no int, user_text string, assistant_text string")
    got = {(r.project_id, r.pair_no): r for r in chat.tag(pairs).collect()}
    assert got["p", 1].topics == ["alpha", "common", "because"] and got["p", 2].topics == ["beta", "common"] and got["q", 1].topics == []
    assert [tuple(q) for q in got["p", 1].questions] == [("Why alpha?", "alpha", "answer_local")] and got["p", 3].questions == []


def test_long_texts_are_marked(spark):
    df = spark.createDataFrame([(1, "Sure. " + "x" * 50), (2, "Sure. Body."), (3, None)], "id int, body string")
    got = {r.id: r.result for r in cl.prune(df, "body", cl.Pruning(most_chars=30)).collect()}
    assert (got[1].error, got[1].changed, got[2].error, got[3].error) == ("too_long", False, None, None)
