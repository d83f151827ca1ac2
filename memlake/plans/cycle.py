"""Composed plans: retrieval over two sources, and the consolidation cycle of all projects."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions import dates as dt
from memlake.functions import text as tx
from memlake.functions import vectors as vx
from memlake.operators import chat
from memlake.operators import chunks as ck
from memlake.operators import artifacts as ar
from memlake.operators import questions as qs
from memlake.operators import retrieval as rt
from memlake.operators.steps import cut
from memlake.operators.hooks import Model
from memlake.settings import Settings, route_policy
from memlake.sources.lake import SCHEMAS, Lake, check_index, manifest_of


def _embedded(rows: DataFrame, text: str, settings: Settings, keep: bool = True) -> DataFrame:
    return ck.embed(rows, text, lambda: ck.HashEmbedder(settings.dims), keep=keep)


def retrieve(spark: SparkSession, documents: DataFrame, asked: DataFrame, pairs: DataFrame, settings: Settings | None = None, policy: DataFrame | None = None, classify: Model | Callable[[Column], Column] = chat.route_of) -> DataFrame:
    """Snippets of every query from long-term chunks and daily entries.

    Queries (``item_id``, ``text``) are embedded once for both sources.  The search keeps
    texts out: only ids and vectors are scored, and only the documents of the few hits
    are cut again, for their texts and their neighbours'.
    """
    settings, policy = settings or Settings(), policy if policy is not None else route_policy(spark)
    queries = asked.select(F.col("item_id").alias("query_id"), "text")
    queries = chat.with_route(queries, "text", classify)
    queries = rt.retrievable(rt.with_policy(queries, policy, settings.base_top_k))
    vectors = cut(_embedded(queries, "text", settings).select("query_id", F.col("vector").alias("qvec"), "min_score", "max_keep", "expansion_before", "expansion_after", "per_source_k"))
    most = vectors.agg(F.coalesce(F.max("per_source_k"), F.lit(1))).first()[0]
    daily = pairs.select(F.concat(F.lit("d"), F.col("project_id"), F.lit("-"), F.col("pair_no").cast("string")).alias("item_id"), tx.compose_pair(F.col("user_text"), F.col("assistant_text")).alias("chunk"))
    chunks = ck.chunk(documents, settings.chunk_size, settings.chunk_overlap)
    ltm = chunks.select(F.struct("doc_id", "chunk_index").alias("place"), "chunk")
    search = lambda rows, item: rt.top_k(vectors, _embedded(rows.select(F.col(item).alias("item_id"), "chunk"), "chunk", settings, keep=False), most)
    # The place of a chunk as text that sorts as numbers do, so that ties go to the first.
    place = F.concat(F.lpad(F.col("place.doc_id").cast("string"), 20, "0"), F.lit(":"), F.lpad(F.col("place.chunk_index").cast("string"), 10, "0"))
    hits = search(daily, "item_id").withColumn("source", F.lit("daily")).unionByName(search(ltm.withColumn("item", place), "item").withColumn("source", F.lit("ltm")))
    hits = hits.withColumn("score", F.round(vx.cosine_to_01(F.col("ip")), 9)).join(vectors.drop("qvec"), "query_id").where(F.col("hit_rank") <= F.col("per_source_k"))
    hits = cut(hits)  # queries x k rows at most
    known = hits.where("source = 'ltm'").withColumns({"doc_id": F.substring("item_id", 1, 20).cast("long"), "chunk_index": F.substring("item_id", 22, 10).cast("int")})
    near = ck.chunk(documents.join(known.select("doc_id").distinct(), "doc_id", "left_semi"), settings.chunk_size, settings.chunk_overlap)
    found = known.join(near.select("doc_id", "chunk_index", "chunk"), ["doc_id", "chunk_index"])
    hits = found.unionByName(hits.where("source = 'daily'").join(daily, "item_id"), allowMissingColumns=True)
    kept = rt.tiers(rt.select_with_bonus(rt.score_gate(rt.order_hits(hits))))
    centre = kept.where("doc_id is null").withColumns({"idx": F.lit(None).cast("int"), "n_text": F.col("chunk")})
    rows = rt.expand(kept.where("doc_id is not null"), near).unionByName(centre).withColumn("n_text", F.coalesce("n_text", "chunk")).drop("chunk")
    return rt.collapse(rt.trim_overlap(rt.order_documents(rt.dedupe(rows)), settings.chunk_overlap, "n_text"), "n_text")


#: Heading of a text's context, of a topic in it, what stands where nothing was found, and the route of topics.
CONTEXT_HEAD, TOPIC_HEAD, NOTHING, TOPIC_ROUTE = "=== PROJECT RAG CONTEXT ===", "Topic Query: ", "(No relevant long-term memory found.)", "EXPLORATORY"


def topic_context(spark: SparkSession, texts: DataFrame, documents: DataFrame, pairs: DataFrame, settings: Settings | None = None, policy: DataFrame | None = None) -> DataFrame:
    """Context of every text (item_id, text) from the retrieval of each of its section topics, put together in order.

    Topics are the titles and lists of :func:`text.section_topics`; all topics of all texts
    are queries of one search.  Rows (item_id, topics, found, context): topics named, topics
    with a hit, and the text; one without topics has only the heading.
    """
    named = cut(texts.select("item_id", F.posexplode_outer(tx.section_topics(tx.strip_open_questions(F.col("text")))).alias("at", "topic")))
    # A query's id keeps its text and place apart, whatever their sizes.
    asked = named.where("topic is not null").select(F.concat_ws(":", F.col("item_id").cast("string"), F.col("at").cast("string")).alias("item_id"), F.col("topic").alias("text"))
    hits = retrieve(spark, documents, asked, pairs, settings, policy, classify=lambda _: F.lit(TOPIC_ROUTE))
    blocks = rt.context_block(hits.withColumn("score", F.round("score", 6))).select("query_id", "context")
    keyed = named.withColumn("query_id", F.concat_ws(":", F.col("item_id").cast("string"), F.col("at").cast("string")))
    part = F.when(F.col("context").isNotNull(), F.struct("at", F.concat(F.lit(TOPIC_HEAD), "topic", F.lit("\n"), "context", F.lit("\n")).alias("piece")))
    rows = keyed.join(blocks, "query_id", "left").groupBy("item_id").agg(F.count("topic").alias("topics"), F.count("context").alias("found"), F.array_sort(F.collect_list(part)).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["piece"]), "\n")
    text = F.concat(F.lit(f"{CONTEXT_HEAD}\n"), F.when(F.col("topics") == 0, "").when(F.col("found") == 0, NOTHING + "\n").otherwise(F.concat(body, F.lit("\n"))))
    return rows.select("item_id", "topics", "found", text.alias("context"))


def latest_summary(summaries: DataFrame, items: DataFrame) -> DataFrame:
    """Each project's summary (project_id, text) with the distinct research topics of its accepted items below it."""
    topics = qs.research_topics(items).groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("topic_no", "topic"))), lambda t: F.concat(F.lit("Topic: "), t["topic"], F.lit("\n"))), "\n").alias("topics"))
    base = tx.strip(F.coalesce("text", F.lit("")))
    block = F.concat(F.lit("[RESEARCH]\n"), "topics")
    rows = summaries.join(topics, "project_id", "full_outer")
    return rows.select("project_id", F.when(F.col("topics").isNull(), base).when(base == "", block).otherwise(F.concat(base, F.lit("\n\n"), block)).alias("text"))


@dataclass(frozen=True)
class Cycle:
    """What one cycle of all projects makes; nothing is written until :func:`commit`."""

    entries: DataFrame  #: entries staged before, and those of the flushed pairs
    log: DataFrame  #: question rows of the flushed pairs
    questions: DataFrame  #: open questions, newest wins
    uploads: DataFrame  #: files given to this cycle
    artifacts: DataFrame  #: one new document a project, its entries rescoped to long-term memory
    chunks: DataFrame  #: chunk rows with vectors of the new documents and of all the index had or must have again
    consumed: DataFrame  #: ids of the messages that leave the chat
    left: DataFrame  #: messages that stay
    outcome: DataFrame  #: one row a project


def _no_rows(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def _project_ids(*tables: DataFrame | None) -> DataFrame:
    return reduce(DataFrame.unionByName, (t.select("project_id") for t in tables if t is not None)).distinct()


def artifact_chunks(artifacts: DataFrame, settings: Settings, markers: ar.Markers = ar.DEFAULT) -> DataFrame:
    """Chunk rows of artifacts: an entry is a region with its own identity; a document with structural warnings is one region."""
    found = ar.entries(artifacts, ["project_id", "name"], "content", markers).where("copy = 1")
    bad = ar.warnings(artifacts, ["project_id", "name"], "content", markers).select("project_id", "name").distinct()
    sound = found.join(bad, ["project_id", "name"], "left_anti")
    regions = ar.with_metadata(sound, ["project_id", "name", "memory_id"], markers=markers).withColumn("doc_id", F.col("memory_id"))
    whole = artifacts.join(bad, ["project_id", "name"], "left_semi").select("project_id", "name", F.lit(None).cast("string").alias("memory_id"), F.col("content").alias("text"), F.create_map().cast("map<string,string>").alias("meta"), F.col("name").alias("doc_id"))
    rows = regions.unionByName(whole).withColumnRenamed("name", "filename")
    return ar.regions_to_chunks(rows, settings.chunk_size, settings.chunk_overlap).withColumn("origin", F.lit("artifact"))


def upload_chunks(uploads: DataFrame, settings: Settings) -> DataFrame:
    """Chunk rows of uploaded files (project_id, doc_id, text)."""
    rows = uploads.select("project_id", F.col("doc_id").alias("filename"), "doc_id", F.lit(None).cast("string").alias("memory_id"), "text", F.create_map().cast("map<string,string>").alias("meta"))
    return ar.regions_to_chunks(rows, settings.chunk_size, settings.chunk_overlap).withColumn("origin", F.lit("upload"))


def consolidate(
    spark: SparkSession, messages: DataFrame, settings: Settings, projects: DataFrame | None = None, log: DataFrame | None = None, staged_before: DataFrame | None = None, timestamp: str = "01-02-2024_03:04:05",
    lake: Lake | None = None, uploads: DataFrame | None = None, tagger: Callable[[DataFrame], DataFrame] | None = None,
) -> Cycle:
    """One cycle of all projects on top of what a lake holds.

    Pairs are flushed, tagged and staged, their questions logged and all questions
    consolidated; everything staged is rendered into one new artifact a project; the index
    is the sound one of before, or a new one of all older artifacts, and the new artifact's
    entries and the uploads.  Messages that an earlier cycle consumed are not seen again.

    A project that does not stage keeps its messages; what it staged before is consolidated
    all the same.  A project without any entry is skipped; one without messages but with
    entries, questions or uploads has its turn.
    """
    if lake is not None:
        messages = messages.join(lake.read("consumed"), ["project_id", "id"], "left_anti")
        staged_before = _and_more(lake.read("staging").drop("version"), staged_before)
        log = _and_more(lake.read("log").drop("version"), log)
    before = staged_before if staged_before is not None else _no_rows(spark, "staging")
    active = chat.staging_enabled(messages, projects) if projects is not None else messages
    flushed = cut(chat.flush(chat.pairs(active), settings.pair_limit))
    tagged = cut(chat.tag(chat.unforgotten(flushed), tagger))
    when = F.lit(timestamp)
    new = chat.daily_entries(tagged, before, when)
    entries = cut(before.unionByName(new, allowMissingColumns=True).select(*(c for c in new.columns if c not in ("timestamp", "source"))))
    new_log = cut(chat.question_rows(tagged, dt.iso(when)))
    every_log = _and_more(log, new_log) if log is not None else new_log
    questions = cut(qs.consolidate(every_log))
    pair = tx.split_pair(F.col("text"))
    block = ar.metadata_block([("entry_type", F.lit("chat_pair")), ("current_scope", F.lit("daily")), ("day_sequence", F.col("day_sequence"))], [("topics", F.when(F.size("topics") > 0, F.col("topics")))])
    blocks = entries.withColumn("block", ar.render_entry(F.col("memory_id"), F.lit("chat_pair"), F.coalesce("semantic_handle", F.lit("")), block, pair["user"], pair["assistant"]))
    docs = ar.export(blocks, ["project_id"], "day_sequence", "block")
    docs = docs.select("project_id", ar.artifact_name(F.col("project_id"), when).alias("name"), ar.ensure_header(ar.rescope(F.col("content")), F.col("project_id")).alias("content"))
    older = lake.read("artifacts").drop("version") if lake is not None else _no_rows(spark, "artifacts")
    # Only names are compared: a file of a name that is taken gets the next number.
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    rivals = older.select("project_id", F.col("name").alias("taken")).join(docs.select("project_id", stem.alias("stem")), "project_id")
    rivals = rivals.where(F.startswith("taken", "stem") & F.expr("substring(taken, char_length(stem) + 1)").rlike(r"^(-\d+)?\.[^.]*$")).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    numbered = F.when(F.col("n").isNull(), F.col("name")).otherwise(F.concat(stem, F.lit("-"), (F.col("n") + 1).cast("string"), F.lit(".md")))
    artifacts = cut(docs.join(rivals, "project_id", "left").select("project_id", numbered.alias("name"), "content"))
    given = uploads.select("project_id", "doc_id", "text") if uploads is not None else _no_rows(spark, "uploads")
    made = [artifact_chunks(artifacts, settings), upload_chunks(given, settings)]
    kept, broken = [], None
    if lake is not None:
        sound, wrong = lake.index(settings.chunk_size, settings.chunk_overlap)
        broken = cut(wrong.select("project_id"))
        replaced = given.select("project_id", "doc_id", F.lit("upload").alias("origin"))
        changed = _project_ids(artifacts, given)
        kept.append(sound.drop("version").join(changed, "project_id", "left_semi").join(replaced, ["project_id", "doc_id", "origin"], "left_anti"))
        # An index of other settings or with anything missing is made again from all older files.
        made.append(artifact_chunks(older.join(broken, "project_id", "left_semi"), settings))
        made.append(upload_chunks(lake.uploads().join(broken, "project_id", "left_semi").join(given, ["project_id", "doc_id"], "left_anti"), settings))
    touched = _project_ids(artifacts, given, broken)
    embedded = _embedded(reduce(DataFrame.unionByName, made), "chunk", settings)
    chunks = cut(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), kept, embedded))
    consumed = cut(chat.consumed(active, settings.pair_limit))
    left = messages.join(consumed, ["project_id", "id"], "left_anti")
    count = lambda df, name: df.groupBy("project_id").agg(F.count(F.lit(1)).alias(name))
    # Entries of the new artifact that came through; one that is indexed as a whole holds all of its own.
    own = chunks.join(artifacts.select("project_id", F.col("name").alias("filename")), ["project_id", "filename"], "left_semi")
    rendered = own.groupBy("project_id").agg(F.count_distinct("memory_id").alias("rendered"), F.bool_or(F.col("memory_id").isNull()).alias("whole"))
    columns = [count(messages, "items_in"), count(flushed, "flushed"), entries.groupBy("project_id").agg(F.count(F.lit(1)).alias("items_out"), F.sum("tokens").alias("tokens")), rendered, count(chunks, "chunks"), count(questions, "questions"), count(left, "left")]
    everyone = _project_ids(messages, entries, questions, touched)
    rows = reduce(lambda a, b: a.join(b, "project_id", "left"), columns, everyone).fillna(0)
    # Every staged entry must be in the artifact, else the project has failed and keeps its staging.
    whole = F.coalesce("whole", F.lit(False)) | (F.col("rendered") == F.col("items_out"))
    status = F.when((F.col("items_out") == 0) & (F.col("chunks") == 0), "skipped").when(whole, "done").otherwise("failed")
    return Cycle(entries, new_log, questions, given, artifacts, chunks, consumed, left, rows.withColumn("status", status).drop("rendered", "whole"))


def _and_more(rows: DataFrame, more: DataFrame | None) -> DataFrame:
    return rows if more is None else rows.unionByName(more.select(*(c for c in rows.columns if c in more.columns)), allowMissingColumns=True)


def commit(cycle: Cycle, lake: Lake, settings: Settings) -> DataFrame:
    """Write a cycle as a new version of a lake and publish it; the outcome says what counts.

    Everything is written apart from what readers see; the index is read back and checked
    against what the cycle made; the pointers come last.  A project that fails keeps its
    index and artifacts of before, and its entries stay staged for the next cycle.
    """
    version = lake.new_version()
    size, overlap = settings.chunk_size, settings.chunk_overlap
    for name in ("artifacts", "uploads", "log", "consumed", "questions", "chunks"):
        lake.write(name, version, getattr(cycle, name))
    manifest = manifest_of(cycle.chunks, size, overlap, settings.dims)
    lake.write("manifest", version, manifest)
    checked = check_index(lake.written("chunks", version), lake.written("manifest", version), size, overlap)
    wrong = F.col("reason").isNotNull() | ((F.col("chunks") > 0) & ~F.coalesce("listed", F.lit(False)))
    judged = cycle.outcome.join(checked.withColumn("listed", F.lit(True)), "project_id", "left")
    outcome = cut(judged.withColumn("status", F.when((F.col("status") == "done") & wrong, "failed").otherwise(F.col("status"))).withColumn("indexed", F.when(F.coalesce("listed", F.lit(False)) & F.col("reason").isNull(), F.col("chunks")).otherwise(F.lit(0))).drop("reason", "listed"))
    done = outcome.where("status = 'done'")
    lake.write("staging", version, cycle.entries.join(done, "project_id", "left_anti"))
    lake.publish(version, outcome.select("project_id", (F.col("status") == "done").alias("published")))
    return outcome


def run_cycle(spark: SparkSession, lake: Lake, messages: DataFrame, settings: Settings | None = None, **more) -> DataFrame:
    """One cycle from a lake to its next version; ``more`` goes to :func:`consolidate`."""
    settings = settings or Settings()
    return commit(consolidate(spark, messages, settings, lake=lake, **more), lake, settings)
