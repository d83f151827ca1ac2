"""The consolidation cycle, its artifacts, the bridge and pruning."""

from __future__ import annotations

import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from memlake.operators import artifacts as ar
from memlake.operators import chat
from memlake.operators import cleanup as cl
from memlake.operators import questions as qs
from memlake.operators import telemetry as tm
from memlake.operators.steps import cut
from memlake.plans import cycle
from memlake.settings import Settings, load_policy, load_rules
from memlake.sources import readers, writers
from memlake.sources.lake import Lake
from memlake.streaming import jobs

MESSAGE = "project_id string, id long, role string, content string, forget boolean"


ENTRY = "project_id string, day_sequence int, memory_id string, text string, tokens int"
LOG = "project_id string, line_no long, ts string, question string, topic string, resolution string"


def chat_rows(project, turns):
    return [(project, k, "user" if k % 2 == 0 else "assistant", f"text {k} of {project}" + ("?" if k % 2 else "") + "\ncurrent_scope: daily", False) for k in turns]


def test_cycle_writes_verifies_and_clears(spark, tmp_path):
    rows = [(p, k, r, t, k == 3) for p, k, r, t, _ in chat_rows("a", range(8))]
    rows += [("b", 0, "assistant", "alone", False), ("c", 0, "user", "q", False), ("c", 1, "assistant", "r", False)]
    messages = spark.createDataFrame(rows, MESSAGE)
    projects = spark.createDataFrame([("c", False)], "project_id string, daily_rag_enabled boolean")
    before = spark.createDataFrame([("a", 1, "mem_20230101_000000_abcdef01", "User: old\nAssistant: answer", 4)], ENTRY)
    log = spark.createDataFrame([("a", 1, "1", "What?", "t", "answer_local"), ("a", 2, "2", "what", "t", "ignore"), ("a", 3, "3", "Why?", "t", "answer_local")], LOG)
    made = cycle.consolidate(spark, messages, Settings(), projects, log, before)
    lake = Lake(spark, str(tmp_path))
    got = {r.project_id: r for r in cycle.commit(made, lake, Settings()).collect()}
    a, b, c = (got[k] for k in "abc")
    assert (a.flushed, a.items_out, a.left, a.questions, a.status) == (4, 4, 0, 1 + 3, "done") and a.indexed == a.chunks > 0
    assert (b.status, b.left, c.status, c.left) == ("skipped", 1, "skipped", 2)
    assert lake.read("staging").count() == 0
    text = lake.read("artifacts").where("project_id = 'a'").first().content
    assert text.count("current_scope: ltm") == 4 and text.count("current_scope: daily") == 6 and text.index("old") < text.index("text 0")
    fields = lake.read("chunks").where("memory_id = 'mem_20230101_000000_abcdef01'").first().fields
    assert fields["current_scope"] == "ltm" and fields["doc_id"] == "mem_20230101_000000_abcdef01" and fields["filename"].endswith(".md")
    logged = lake.read("log").orderBy("line_no").first()
    assert (logged.source, logged.pair_id, logged.question_index, logged.question, logged.resolution, logged.ts) == ("tagger_ingest", "0:1", 1, "text 1 of a?", "answer_local", "2024-01-02T03:04:05Z")


def state(lake):
    """What a reader of a lake sees."""
    entry = lambda r: (r.project_id, r.memory_id, r.chunk_index, r.chunk, r.origin)
    found = {"index": sorted(map(str, map(entry, lake.index(600, 80)[0].collect()))), "broken": lake.index(600, 80)[1].count()}
    for name in ("artifacts", "staging", "questions", "consumed", "log"):
        found[name] = sorted(map(str, lake.read(name).drop("version").collect()))
    return found


def test_two_cycles_add_up(spark, tmp_path):
    """Two cycles over the same table of two projects: both cycles' entries stay, also those of the project that had no second one."""
    messages = spark.createDataFrame(chat_rows("a", range(8)) + chat_rows("b", range(2)), MESSAGE)
    lake, few = Lake(spark, str(tmp_path)), Settings(pair_limit=2)
    first = {r.project_id: r for r in cycle.run_cycle(spark, lake, messages, few).collect()}
    assert (first["a"].items_out, first["a"].left, first["b"].items_out) == (2, 4, 1)
    one = state(lake)
    second = {r.project_id: r for r in cycle.run_cycle(spark, lake, messages, few).collect()}
    assert (second["a"].items_out, second["a"].items_in, second["a"].left, second["a"].status) == (2, 4, 0, "done") and "b" not in second or second["b"].status == "skipped"
    two = state(lake)
    assert set(one["artifacts"]) < set(two["artifacts"]) and len(two["artifacts"]) == 3 and set(one["index"]) < set(two["index"]) and two["broken"] == 0
    names = {r.name for r in lake.read("artifacts").where("project_id = 'a'").collect()}
    assert names == {"a_01-02-2024_03-04-05.md", "a_01-02-2024_03-04-05-2.md"}
    body = "".join(r.chunk for r in lake.read("chunks").where("project_id = 'a'").collect())
    assert all(f"text {k} of a" in body for k in range(8)) and len(two["consumed"]) == 10
    assert cycle.run_cycle(spark, lake, messages, few).where("status <> 'skipped'").count() == 0
    gone = lake.vacuum()
    assert gone and state(lake)["index"] == two["index"] and state(lake)["artifacts"] == two["artifacts"]


def test_staged_only_and_staging_off(spark, tmp_path):
    """Staged entries have their turn without a message, and where the project stages no more; its messages stay then."""
    lake = Lake(spark, str(tmp_path))
    staged = spark.createDataFrame([("s", 1, "mem_20230101_000000_abcdef01", "User: old\nAssistant: answer", 4), ("off", 1, "mem_20230101_000000_abcdef02", "User: o\nAssistant: p", 4)], ENTRY)
    messages = spark.createDataFrame(chat_rows("off", range(2)), MESSAGE)
    projects = spark.createDataFrame([("off", False)], "project_id string, daily_rag_enabled boolean")
    got = {r.project_id: r for r in cycle.run_cycle(spark, lake, messages, projects=projects, staged_before=staged).collect()}
    assert (got["s"].items_in, got["s"].items_out, got["s"].status) == (0, 1, "done")
    assert (got["off"].flushed, got["off"].left, got["off"].items_out, got["off"].status) == (0, 2, 1, "done")
    assert lake.read("staging").count() == 0 and lake.read("consumed").count() == 0 and {r.project_id for r in lake.read("chunks").collect()} == {"s", "off"}


def test_killed_between_writes(spark, tmp_path, monkeypatch):
    """A cycle that ends before any of its writes leaves the state of before, and a second try ends as if nothing had been."""
    messages = spark.createDataFrame(chat_rows("a", range(4)), MESSAGE)
    uploads = spark.createDataFrame([("a", "f.txt", "an uploaded file")], "project_id string, doc_id string, text string")
    base, few = Lake(spark, str(tmp_path / "base")), Settings(pair_limit=1)
    cycle.run_cycle(spark, base, messages, few, uploads=uploads)
    before, write, order = state(base), Lake.write, ["artifacts", "uploads", "log", "consumed", "questions", "chunks", "manifest", "staging", "pointers"]
    made = cycle.consolidate(spark, messages, few, lake=base)
    for step, name in enumerate(order):
        shutil.copytree(tmp_path / "base", tmp_path / str(step))
        lake, calls = Lake(spark, str(tmp_path / str(step))), []

        def dies(self, name, version, rows, calls=calls, step=step):
            calls.append(name)
            if len(calls) > step:
                raise RuntimeError("lost")
            write(self, name, version, rows)

        monkeypatch.setattr(Lake, "write", dies)
        with pytest.raises(RuntimeError, match="lost"):
            cycle.commit(made, lake, few)
        monkeypatch.setattr(Lake, "write", write)
        assert calls == order[: step + 1] and lake.versions() == base.versions() and len(lake.pointers().collect()) == 1
        if name in ("artifacts", "chunks", "pointers"):  # before the first, amid, and before the last write
            assert state(lake) == before
    assert cycle.commit(made, lake, few).first().status == "done"
    after = state(lake)
    assert len(after["artifacts"]) == 2 and len(after["consumed"]) == 4 and any("uploaded" in x for x in after["index"])


def test_a_broken_index_is_made_again(spark, tmp_path):
    """Rows that are gone, wrong dimensions and other settings: the next cycle reads all older files again."""
    messages = spark.createDataFrame(chat_rows("a", range(4)), MESSAGE)
    uploads = spark.createDataFrame([("a", "f.txt", "an uploaded file")], "project_id string, doc_id string, text string")
    lake, few = Lake(spark, str(tmp_path)), Settings(pair_limit=1)
    cycle.run_cycle(spark, lake, messages, few, uploads=uploads)
    version, whole = lake.versions()[-1], state(lake)
    rows = cut(lake.read("chunks").drop("version"))
    for broken, reason in ((rows.where("origin = 'artifact'"), "rows"), (rows.withColumn("vector", F.slice("vector", 1, 3)), "dimension"), (rows.where("origin = 'upload'"), "rows"), (rows.withColumn("vector", F.transform("vector", lambda x: F.lit(float("nan")))), "vectors"), (rows.withColumn("doc_id", F.lit("one")), "documents"), (rows.withColumn("chunk_index", F.col("chunk_index") + 1), "gap")):
        lake.write("chunks", version, broken)
        good, bad = lake.index(600, 80)
        assert good.count() == 0 and [r.reason for r in bad.collect()] == [reason]
    assert [r.reason for r in lake.index(500, 80)[1].collect()] == ["settings"]
    assert cycle.run_cycle(spark, lake, messages, few).first().status == "done"
    after = state(lake)
    assert set(whole["index"]) < set(after["index"]) and after["broken"] == 0


def test_failed_index_keeps_staging(spark, tmp_path, monkeypatch):
    """Entries of a project whose index fails stay staged and come into the next cycle's artifact."""
    messages = spark.createDataFrame([("a", 0, "user", "q", False), ("a", 1, "assistant", "r", False)], MESSAGE)
    lake = Lake(spark, str(tmp_path))
    check = cycle.check_index
    monkeypatch.setattr(cycle, "check_index", lambda *x: check(*x).withColumn("reason", F.lit("rows")))
    assert cycle.run_cycle(spark, lake, messages).first().status == "failed"
    assert lake.read("staging").count() == 1 and lake.read("artifacts").count() == 0 and lake.read("chunks").count() == 0
    monkeypatch.setattr(cycle, "check_index", check)
    got = cycle.run_cycle(spark, lake, messages).first()
    assert (got.items_in, got.items_out, got.status) == (0, 1, "done") and lake.read("staging").count() == 0 and lake.read("artifacts").count() == 1


def test_questions_from_tag_to_consolidation(spark, tmp_path):
    """Logged, written as lines, read again, consolidated: the same questions."""
    messages = spark.createDataFrame(chat_rows("p", range(6)), MESSAGE)
    tagged = chat.tag(chat.pairs(messages))
    rows = chat.question_rows(tagged, F.lit("2024-01-01T00:00:00Z"))
    writers.append_questions(rows, str(tmp_path / "log"))
    parsed = qs.parse_log(readers.read_json_lines(spark, str(tmp_path / "log"), "p"))
    got = sorted((r.question, r.topic, r.pair_id) for r in qs.consolidate(parsed).collect())
    assert len(got) == 3 == parsed.count() and got == sorted((r.question, r.topic, r.pair_id) for r in qs.consolidate(rows).collect())


def test_metadata_types_and_warnings(spark):
    text = "## h\n### Metadata\n\n```yaml\nflag: TRUE\nlist:\n  - a\n  - b: c\nbad\n: none\nkey: one\nkey: two\n```\n"
    df = spark.createDataFrame([(1, text), (2, "### Metadata\n```yaml\na: b\n```"), (3, "### Metadata\n\n```yaml\na: b"), (4, "none")], "id int, text string")
    found = {(r.id, r.key): (r.list, r.flag, r.values) for r in ar.metadata(df, ["id"]).select("id", "key", "list", "flag", F.col("values").alias("values")).collect()}
    assert found == {(1, "flag"): (False, True, ["true"]), (1, "list"): (True, None, ["a", "b: c"]), (1, "key"): (False, None, ["two"]), (3, "a"): (False, None, ["b"])}
    warned = {(r.id, r.kind) for r in ar.metadata_warnings(df, ["id"]).collect()}
    assert warned == {(1, "no_colon"), (1, "empty_key"), (2, "fence"), (3, "open_fence")}


def same(a, b):
    return bool(a and b) and (a == b or (len(a) >= 24 and b in a) or (len(b) >= 24 and a in b))


def test_bridge_equals_loop(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta"])
    phrase = lambda n: " ".join(word() for _ in range(n))
    asked = [(p, k, phrase(rng.choice((1, 2, 3, 6, 9))), rng.random() < 0.8) for p in ("p", "q") for k in range(60)]
    ideas = [(p, k, phrase(rng.choice((3, 7)))) for p in ("p", "q") for k in range(4)]
    decisions = qs.bridge(spark.createDataFrame(ideas, "project_id string, idea_id int, origin_text string"), spark.createDataFrame([(p, k, q, r, "answer_remote") for p, k, q, r in asked], "project_id string, question_no long, question string, used_remote_research boolean, resolution string"))
    got = {(r.project_id, r.question_no): (r.action, r.item) for r in decisions.collect()}
    want = {}
    for p in ("p", "q"):
        injected = []
        for _, k, q, remote in (x for x in asked if x[0] == p):
            if not remote:
                continue
            exact = [i for o, i, t in ideas if o == p and t == q]
            hit = exact or [i for o, i, t in ideas if o == p and same(t, q)]
            earlier = next((n for n, t in injected if same(t, q)), None)
            if hit:
                want[p, k] = ("matched_existing_item", str(min(hit)))
            elif earlier is not None:
                want[p, k] = ("matched_existing_item", f"remote-{earlier}")
            else:
                injected.append((k, q))
                want[p, k] = ("injected_synthetic_item", f"remote-{k}")
    assert got == want
    counts = {r.project_id: r for r in qs.bridge_counts(decisions).collect()}
    assert counts["p"].remote_questions == sum(k[0] == "p" for k in want) and counts["p"].seeded_research_topics > 0
    after = {(r.project_id, r.idea_id): r for r in qs.bridged_ideas(spark.createDataFrame(ideas, "project_id string, idea_id int, origin_text string"), decisions).collect()}
    assert len(after) == 8 + sum(a.startswith("inj") for a, _ in want.values())
    assert all(after[p, item].source_resolution == "answer_remote" and after[p, item].recommended_research for (p, _), (_, item) in want.items())


def test_prune_reports_what_it_did(spark):
    rows = [(1, "Sure. The body is here.\n\nLet me know if this helps."), (2, "Sure."), (3, None), (4, "Same words in a line. Same words in a line! Other 1.  Other 1."), (5, "Text  with   gaps.\n\n\n\nEnd.")]
    df = spark.createDataFrame(rows, "id int, body string")
    got = {r.id: r for r in cl.prune(df, "body").collect()}
    assert got[1].body == "The body is here." and got[1].result.trimmed_side == "both" and got[1].result.front_units_removed == 1
    original = rows[0][1]
    assert original[: got[1].result.end_span_removed.start].endswith("The body is here.") and got[1].result.end_span_removed.stop == len(original)
    assert got[2].body == "Sure." and got[2].result.blocked_by_safety and not got[2].result.changed
    assert got[3].body is None and got[3].result.original is None
    assert got[4].body == "Same words in a line. Other 1. Other 1." and got[4].result.changed
    assert got[5].body == "Text with gaps.\n\nEnd."
    off = cl.prune(df, "body", cl.Pruning(front=None, end=None, whitespace=False, similarity=False)).collect()
    assert all(r.body == r.result.original and not r.result.changed for r in off)


def test_policy_and_rules_from_files(spark, tmp_path):
    node = {"retrieval_multiplier": 1, "max_keep": 2, "min_score": 0.5, "expansion": {"max_before": 0, "max_after": 1}}
    (tmp_path / "p.json").write_text(json.dumps({"OTHER": node, "DIRECT": node}))
    assert {r.route for r in load_policy(spark, str(tmp_path / "p.json")).collect()} == {"OTHER", "DIRECT"}
    (tmp_path / "bad.json").write_text(json.dumps({"OTHER": node | {"min_score": 2}}))
    with pytest.raises(ValueError, match="min_score above 1"):
        load_policy(spark, str(tmp_path / "bad.json"))
    (tmp_path / "r1.json").write_text(json.dumps({"_comment": 1, "front": {"prefixes": ["sure", "ok"]}}))
    (tmp_path / "r2.json").write_text(json.dumps({"front": {"prefixes": ["ok", "well"]}, "end": {"prefixes": ["bye"]}}))
    assert load_rules(spark, str(tmp_path / "r1.json"), str(tmp_path / "r2.json")) == {"front": ("sure", "ok", "well"), "end": ("bye",)}
    assert cl.rule_conflicts(["sure", "by"], ["bye"]) == ["by"]


def test_screen_stream_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"r{rng.randrange(3)}", k, rng.choice(["turn", "start", "end", "end", "turn"]) if k != 150 else "run_end", rng.randrange(20), rng.randrange(9)) for k in range(200)]
    schema = "run_id string, arrival long, kind string, turn_id long, invocation_id long"
    df = spark.createDataFrame(rows, schema)
    for n, part in enumerate(("arrival < 90", "arrival >= 90")):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = jobs.screened(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert n < 2
    got = {(r.run_id, r.arrival, r.verdict) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.run_id, r.arrival, r.verdict) for r in tm.screen_calls(df).collect()}
    assert {v for _, _, v in got} == {"accepted", "repeated", "decreasing", "unknown", "late"}
    jobs.appended_telemetry(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 200
