"""Chat turns: pairs, roll-off and durable daily entries, for all projects at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import dates as dt
from memlake.functions import text as tx
from memlake.operators.hooks import Model, applied
from memlake.operators.scans import Running, running


def ordered(messages: DataFrame) -> DataFrame:
    """Position of each message in its project."""
    return running(messages, ["project_id"], "id", Running(sums={"pos": F.lit(1)}, inclusive=True))


def mark_pairs(messages: DataFrame, *also: str) -> DataFrame:
    """Positions, and ``is_pair`` on each user row that an assistant row follows directly; pairs cannot overlap.

    ``next_`` columns of ``also`` hold the values of the row behind.
    """
    follows = {"_next_role": F.col("role")} | {f"next_{c}": F.col(c) for c in also}
    rows = running(messages, ["project_id"], "id", Running(sums={"pos": F.lit(1)}, inclusive=True, leads=follows, lags={"_prev_role": F.col("role")}))
    return rows.withColumns({"is_pair": F.coalesce((F.col("role") == "user") & (F.col("_next_role") == "assistant"), F.lit(False)), "ends_pair": F.coalesce((F.col("role") == "assistant") & (F.col("_prev_role") == "user"), F.lit(False))}).drop("_next_role", "_prev_role")


def pairs(messages: DataFrame) -> DataFrame:
    """One row a pair with both texts and the pair's number from the oldest."""
    rows = mark_pairs(messages, "id", "content", "forget").where("is_pair")
    found = rows.select("project_id", "pos", F.col("id").alias("user_id"), F.col("next_id").alias("assistant_id"), F.col("content").alias("user_text"), F.col("next_content").alias("assistant_text"), F.coalesce("next_forget", F.lit(False)).alias("forget"))
    return running(found, ["project_id"], "pos", Running(sums={"pair_no": F.lit(1)}, inclusive=True)).withColumn("pair_no", F.col("pair_no").cast("int"))


def unforgotten(all_pairs: DataFrame) -> DataFrame:
    """Pairs whose answer is not to be forgotten; a null counts as not."""
    return all_pairs.where(~F.coalesce("forget", F.lit(False)))


def staging_enabled(all_pairs: DataFrame, projects: DataFrame) -> DataFrame:
    """Pairs of projects that stage; a project without a setting does."""
    off = projects.where(~F.coalesce("daily_rag_enabled", F.lit(True))).select("project_id").distinct()
    return all_pairs.join(off, "project_id", "left_anti")


def resolve_projects(asked: DataFrame, projects: DataFrame, project: str, name: str = "name") -> DataFrame:
    """Project of each asked name, case and outer spaces aside; the first project of a name wins, unknown names go."""
    key = F.lower(F.trim(name))
    first = projects.groupBy(key.alias("known")).agg(F.min(project).alias(project))
    return asked.join(first, key == F.col("known")).drop("known")


def roll_off(messages: DataFrame, limit: int) -> DataFrame:
    """What happens to each message when only the newest ``limit`` pairs stay: keep, roll or delete.

    Rows of older pairs roll; unpaired rows in front of the last rolled pair are deleted.
    """
    begins = F.col("is_pair").cast("int")
    rows = running(mark_pairs(messages), ["project_id"], "id", Running(sums={"_before": begins}, totals={"_pairs": begins}))
    # A pair begins behind ``_before`` others, its second row behind one more; of the older ones, some roll.
    rolling = F.col("_pairs") - limit
    nth = F.when(F.col("ends_pair"), F.col("_before") - 1).otherwise(F.col("_before"))
    action = F.when(nth >= rolling, "keep").when(F.col("is_pair") | F.col("ends_pair"), "roll").otherwise("delete")
    return rows.withColumn("action", action).drop("is_pair", "ends_pair", "_before", "_pairs")


def flush(all_pairs: DataFrame, limit: int) -> DataFrame:
    """Oldest first: a pair is consumed while fewer than ``limit`` unforgotten ones went before."""
    rows = running(all_pairs, ["project_id"], "pair_no", Running(sums={"_before": (~F.col("forget")).cast("int")}))
    return rows.where(F.col("_before") < limit).withColumn("staged", ~F.col("forget")).drop("_before")


def newest(messages: DataFrame, pair_limit: int, message_limit: int) -> DataFrame:
    """The newest max(2 * pairs, messages) rows of each project."""
    n = max(2 * pair_limit, message_limit)
    return messages.withColumn("age", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("id")))).where(F.col("age") <= n)


def trimmed_edges(messages: DataFrame) -> DataFrame:
    """From the first user row to the last assistant row of each project."""
    rows = ordered(messages)
    ends = rows.groupBy("project_id").agg(F.min(F.when(F.col("role") == "user", F.col("pos"))).alias("lo"), F.max(F.when(F.col("role") == "assistant", F.col("pos"))).alias("hi"))
    return rows.join(ends, "project_id").where("pos between lo and hi").drop("lo", "hi")


def with_previous(all_pairs: DataFrame) -> DataFrame:
    """Each pair with the text of the pair before it."""
    text = tx.compose_pair(F.col("user_text"), F.col("assistant_text"))
    return running(all_pairs.withColumn("pair_text", text), ["project_id"], "pair_no", Running(lags={"previous_text": F.col("pair_text")}))


def last_handles(messages: DataFrame) -> DataFrame:
    """Last non-empty semantic handle of each project."""
    handle = tx.strip(F.col("semantic_handle"))
    return messages.where(handle != "").groupBy("project_id").agg(F.max_by(handle, "id").alias("last_handle"))


#: Letters of the shortest term, and terms that a pair is tagged with.
SHORTEST, TERMS = 4, 3


def terms(all_pairs: DataFrame) -> DataFrame:
    """Rows (project_id, pair_no, term, weight): how often a pair says a term, weighted by how few of its project's pairs do."""
    body = F.lower(F.concat_ws(" ", "user_text", "assistant_text"))
    said = all_pairs.select("project_id", "pair_no", F.explode(F.regexp_extract_all(body, F.lit(rf"\p{{L}}{{{SHORTEST},}}"), F.lit(0))).alias("term"))
    often = said.groupBy("project_id", "pair_no", "term").agg(F.count(F.lit(1)).alias("tf"))
    spread = often.groupBy("project_id", "term").agg(F.count(F.lit(1)).alias("df"))
    sizes = all_pairs.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    # A table with a row for each term of a project, and one with a row for each project.
    known = spread.join(sizes, "project_id").withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    return often.join(known, ["project_id", "term"]).select("project_id", "pair_no", "term", F.round(F.col("tf") * F.col("idf"), 9).alias("weight"))


def tag(all_pairs: DataFrame, tagger: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs with topics, intent, semantic_handle and questions (question, topic, resolution), by ``tagger`` or the built-in rules.

    The built-in, deterministic ones take the terms of greatest weight as topics (ties by
    name), and question sentences of the answer as candidates to be answered locally.
    """
    if tagger is not None:
        return tagger(all_pairs)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))), 1, TERMS)
    topics = terms(all_pairs).groupBy("project_id", "pair_no").agg(F.transform(best, lambda s: s["term"]).alias("topics"))
    rows = all_pairs.join(topics, ["project_id", "pair_no"], "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    # Cut behind every end of a sentence: one pass, where a search for the next question mark would start anew at every character.
    sentences = F.filter(F.split(F.coalesce("assistant_text", F.lit("")), r"(?<=[.!?\n])"), lambda x: F.endswith(x, F.lit("?")))
    asked = F.transform(sentences, tx.strip)
    topic = F.coalesce(F.get("topics", F.lit(0)), F.lit(""))
    found = F.transform(F.filter(asked, lambda q: q != ""), lambda q: F.struct(q.alias("question"), topic.alias("topic"), F.lit("answer_local").alias("resolution")))
    return rows.withColumns({"intent": F.when(F.contains(F.coalesce("user_text", F.lit("")), F.lit("?")), "ask").otherwise("tell"), "semantic_handle": tx.snake_case(F.array_join(F.slice("topics", 1, 2), " ")), "questions": found})


def route_of(text: Column) -> Column:
    """Keyword route classifier; anything unknown is OTHER."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.rlike(r"\b(how to|steps?|configure|install)\b"), "PROCEDURAL").when(t.rlike(r"\b(design|plan|trade-?offs?)\b"), "SYNTHESIS").when(t.rlike(r"\b(compare|explore|why)\b"), "EXPLORATORY").when(t.rlike(r"^\s*(hi|hello|thanks?)\b"), "CHITCHAT").when(F.contains(t, F.lit("?")), "DIRECT").otherwise("OTHER")


ROUTES = ("CHITCHAT", "DIRECT", "PROCEDURAL", "EXPLORATORY", "SYNTHESIS", "OTHER")


def with_route(rows: DataFrame, text: str = "text", classify: Model | Callable[[Column], Column] = route_of, out: str = "route") -> DataFrame:
    """Rows with the route of a text by a model or a column function; what is no route is OTHER."""
    named = F.upper(F.trim(F.coalesce(F.col(out), F.lit(""))))
    return applied(rows, text, classify, out).withColumn(out, F.when(named.isin(*ROUTES), named).otherwise("OTHER"))


def category_route(category: Column) -> Column:
    """A known route other than CHITCHAT, else OTHER."""
    c = F.upper(F.trim(F.coalesce(category, F.lit(""))))
    return F.when(c.isin("DIRECT", "PROCEDURAL", "EXPLORATORY", "SYNTHESIS"), c).otherwise("OTHER")


def daily_entries(staged: DataFrame, existing: DataFrame, timestamp: Column, source: str = "chat", count: Model | Callable[[Column], Column] = tx.count_tokens) -> DataFrame:
    """New daily records of a set of pairs: gap-free sequence after the existing ones, deterministic ids, tokens by ``count``; tags are kept."""
    base = existing.groupBy("project_id").agg(F.max("day_sequence").alias("top"))
    rows = staged.withColumn("timestamp", timestamp).join(base, "project_id", "left")
    rows = running(rows, ["project_id"], "pair_no", Running(sums={"_nth": F.lit(1)}, inclusive=True))
    rows = rows.withColumn("day_sequence", (F.col("_nth") + F.coalesce("top", F.lit(0))).cast("int"))
    payload = tx.hash_payload({"project_id": F.col("project_id"), "timestamp": F.col("timestamp"), "source": F.lit(source), "entry_type": F.lit("chat_pair"), "user_text": F.col("user_text"), "assistant_text": F.col("assistant_text")})
    now = F.lit("2000-01-01 00:00:00").cast("timestamp")
    tags = [c for c in ("topics", "intent", "semantic_handle") if c in staged.columns]
    rows = rows.select("project_id", "day_sequence", tx.memory_id(dt.compact(F.col("timestamp"), now), payload).alias("memory_id"), "timestamp", tx.compose_pair(F.col("user_text"), F.col("assistant_text")).alias("text"), *tags)
    return applied(rows, "text", count, "tokens").withColumn("source", F.lit(source))


def question_rows(tagged: DataFrame, timestamp: Column | None = None, namespace: str = "other") -> DataFrame:
    """Question candidates as rows of the question log, with where they come from; numbered from 1 within a pair.

    ``line_no`` orders a project's rows of one time: by pair, then within it.  Unknown
    resolutions are ``ignore``, empty questions go.
    """
    rows = tagged.select(
        "project_id", "pair_no", F.col("user_id").alias("user_message_id"), F.col("assistant_id").alias("assistant_message_id"), F.concat_ws(":", F.col("user_id").cast("string"), F.col("assistant_id").cast("string")).alias("pair_id"),
        F.col("user_text").alias("user_message"), F.coalesce("semantic_handle", F.lit("")).alias("semantic_handle"), F.posexplode(tx.clean_questions(F.col("questions"))).alias("at", "q"),
    )
    ts = timestamp if timestamp is not None else F.lit(None).cast("string")
    rows = rows.withColumns({"ts": ts, "source": F.lit("tagger_ingest"), "namespace": F.lit(namespace or "other"), "question_index": F.col("at") + 1, "question": F.col("q.question"), "topic": F.coalesce("q.topic", F.lit("")), "resolution": F.col("q.resolution")})
    numbered = running(rows, ["project_id"], "pair_no", Running(sums={"line_no": F.lit(1)}, inclusive=True), ties=("question_index",))
    return numbered.drop("at", "q")


def consumed(messages: DataFrame, limit: int) -> DataFrame:
    """Ids (project_id, id) of the rows that a flush of ``limit`` pairs takes away, oldest first.

    Pairs go, also forgotten ones; rows without a partner in front of what is still to
    come go too.  After the last pair that counts, and for a lone last row, nothing goes.
    """
    rows = mark_pairs(messages, "forget", "id")
    staged = (F.col("is_pair") & ~F.coalesce("next_forget", F.lit(False))).cast("int")
    rows = running(rows, ["project_id"], "id", Running(sums={"_before": staged}, lags={"_own": staged}))
    reached = F.when(F.col("ends_pair"), F.col("_before") - F.col("_own") < limit).otherwise((F.col("_before") < limit) & F.col("next_id").isNotNull())
    return rows.where(reached).select("project_id", "id")
