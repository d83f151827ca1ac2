"""Open questions and ideas: latest-wins consolidation, fuzzy joins and the bridge between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as tx
from memlake.operators.scans import Running, running
from memlake.operators.steps import cut

#: Characters by which a contained key meets its container.
GRAM = 8


def consolidate(log: DataFrame) -> DataFrame:
    """Newest row of each question and topic by (ts, line); a newest ``ignore`` removes the question."""
    rows = log.where(tx.strip(F.coalesce("question", F.lit(""))) != "").withColumn("key", tx.question_key(F.col("question"), F.col("topic")))
    rows = rows.withColumn("resolution", F.when(tx.resolution(F.col("resolution")) != "", tx.resolution(F.col("resolution"))).otherwise("ignore"))
    newest = F.row_number().over(Window.partitionBy("project_id", "key").orderBy(F.desc(F.coalesce("ts", F.lit(""))), F.desc("line_no")))
    return rows.withColumn("rn", newest).where("rn = 1 and resolution <> 'ignore'").drop("rn")


def _contained(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left id, right id) of a project where one key is inside the other but not equal.

    A container holds every run of ``GRAM`` characters of what it contains, so a key
    meets its containers in an equi join on the one of its runs that the fewest
    containers of the project have, whole if it is shorter; a filter decides.  Common
    beginnings are therefore no hot keys.
    """

    def within(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
        n = F.char_length("key")
        runs = lambda size: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda i: F.substring(F.col("key"), i, F.lit(size))))
        long = b.where(n >= 24)
        outer = long.select("project_id", b_id, F.col("key").alias("kb"), F.explode(runs(GRAM)).alias("gram"))
        usual = outer.groupBy("project_id", "gram").agg(F.count(F.lit(1)).alias("n"))
        own = a.where(n >= GRAM).select("project_id", a_id, F.col("key").alias("ka"), F.explode(runs(GRAM)).alias("gram"))
        # A key of which any run is in no container has none.
        chosen = own.join(usual, ["project_id", "gram"], "left").groupBy("project_id", a_id, "ka").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0")
        met = chosen.select("project_id", a_id, "ka", F.col("g.gram").alias("gram")).join(outer, ["project_id", "gram"])
        short = a.where(n < GRAM).select("project_id", a_id, F.col("key").alias("ka"), F.col("key").alias("gram"))
        parts = F.array_distinct(F.flatten(F.array(*(runs(size) for size in range(1, GRAM)))))
        small = long.join(short.select("project_id").distinct(), "project_id", "left_semi").select("project_id", b_id, F.col("key").alias("kb"), F.explode(parts).alias("gram"))
        met = met.unionByName(short.join(small, ["project_id", "gram"]))
        return met.where(F.contains("kb", "ka") & (F.col("ka") != F.col("kb"))).select("project_id", a_id, b_id)

    both = within(left, right, "left_id", "right_id").unionByName(within(right, left, "right_id", "left_id").select("project_id", "left_id", "right_id"))
    return both.distinct()


def matches(ideas: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows (project_id, idea_id, question_no, exact) of all equivalent ideas and questions."""
    left = ideas.select("project_id", F.col("idea_id").alias("left_id"), tx.text_key(F.col("origin_text")).alias("key")).where("key <> ''")
    right = questions.select("project_id", F.col("question_no").alias("right_id"), tx.text_key(F.col("question")).alias("key")).where("key <> ''")
    exact = left.join(right, ["project_id", "key"]).select("project_id", "left_id", "right_id", F.lit(True).alias("exact"))
    fuzzy = _contained(left, right).withColumn("exact", F.lit(False))
    return exact.unionByName(fuzzy).withColumnsRenamed({"left_id": "idea_id", "right_id": "question_no"})


def attach_resolution(ideas: DataFrame, questions: DataFrame) -> DataFrame:
    """Resolution of each idea: the last question of its own key, else the first equivalent one."""
    found = matches(ideas, questions).join(questions.select("project_id", "question_no", "resolution"), ["project_id", "question_no"])
    order = Window.partitionBy("project_id", "idea_id").orderBy(F.desc("exact"), F.when(F.col("exact"), -F.col("question_no")).otherwise(F.col("question_no")))
    best = found.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("project_id", "idea_id", F.col("resolution").alias("source_resolution"))
    return ideas.drop("source_resolution").join(best, ["project_id", "idea_id"], "left")


def known_only(ideas: DataFrame, questions: DataFrame) -> DataFrame:
    """Ideas that match some known question."""
    return ideas.join(matches(ideas, questions), ["project_id", "idea_id"], "left_semi")


def _settled(keys: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (project_id, question_no, leader): which of the questions stand, and for the rest the first standing one that is equivalent.

    ``links`` are pairs (earlier, later).  A question stands unless an earlier one that
    stands is equivalent; equivalence is not transitive, so this is settled in rounds,
    each deciding the questions whose earlier ones are all decided.
    """
    state = cut(keys.withColumn("leader", F.lit(None).cast("long")))
    while True:
        open_ = links.join(state.select("project_id", F.col("question_no").alias("earlier"), F.col("leader").alias("of")), ["project_id", "earlier"])
        seen = open_.groupBy("project_id", F.col("later").alias("question_no")).agg(F.min(F.when(F.col("of") == F.col("earlier"), F.col("earlier"))).alias("first"), F.min(F.when(F.col("of").isNull(), F.col("earlier"))).alias("undecided"))
        joined = state.join(seen, ["project_id", "question_no"], "left")
        # The first standing one counts once nothing before it can still turn out to stand.
        sure = F.col("undecided").isNull() | (F.col("first") < F.col("undecided"))
        leader = F.coalesce("leader", F.when(sure, F.coalesce("first", "question_no")))
        state = cut(joined.select("project_id", "question_no", leader.alias("leader")))
        if state.where("leader is null").isEmpty():
            return state


def bridge(ideas: DataFrame, questions: DataFrame) -> DataFrame:
    """Decision for each remote question: matched to an idea, or injected as a new one that later questions can match.

    Rows (project_id, question_no, question, action, item, seeded): ``seeded`` says that
    the question became a research topic of its idea.  Exact keys and ideas are resolved
    by joins first; among the rest, equivalent questions meet by :func:`_contained` and
    their order is settled in rounds.  No project is one task's work.
    """
    remote = questions.where(F.col("used_remote_research") & (tx.strip(F.coalesce("question", F.lit(""))) != "")).select("project_id", "question_no", tx.strip("question").alias("question"), tx.text_key(F.col("question")).alias("key"))
    hits = matches(ideas, questions).groupBy("project_id", "question_no").agg(F.min_by("idea_id", F.struct(~F.col("exact"), "idea_id")).cast("string").alias("idea_id"))
    rows = cut(remote.join(hits, ["project_id", "question_no"], "left"))
    free = rows.where("idea_id is null")
    # Equal keys are one: what the first of them matches, all match.  Blank keys match nothing.
    keys = cut(free.where("key <> ''").groupBy("project_id", "key").agg(F.min("question_no").alias("question_no")))
    side = lambda name: keys.select("project_id", F.col("question_no").alias(name), "key")
    pairs = _contained(side("left_id"), side("right_id"))
    links = cut(pairs.select("project_id", F.least("left_id", "right_id").alias("earlier"), F.greatest("left_id", "right_id").alias("later")).distinct())
    leaders = _settled(keys.select("project_id", "question_no"), links).join(keys, ["project_id", "question_no"]).select("project_id", "key", "leader")
    decided = free.join(leaders, ["project_id", "key"], "left").withColumn("leader", F.coalesce("leader", "question_no"))
    injected = F.col("leader") == F.col("question_no")
    decided = decided.select("project_id", "question_no", "question", F.when(injected, "injected_synthetic_item").otherwise("matched_existing_item").alias("action"), F.concat(F.lit("remote-"), F.col("leader").cast("string")).alias("item"))
    every = rows.where("idea_id is not null").select("project_id", "question_no", "question", F.lit("matched_existing_item").alias("action"), F.col("idea_id").alias("item")).unionByName(decided)
    has = F.col("recommended_research") if "recommended_research" in ideas.columns else F.array().cast("array<string>")
    topics = ideas.select("project_id", F.col("idea_id").cast("string").alias("item"), F.transform(F.coalesce(has, F.array().cast("array<string>")), tx.strip).alias("has"))
    first = F.row_number().over(Window.partitionBy("project_id", "item", "question").orderBy("question_no")) == 1
    every = every.join(topics, ["project_id", "item"], "left").withColumn("seeded", first & ~F.coalesce(F.array_contains("has", F.col("question")), F.lit(False)))
    return every.select("project_id", "question_no", "question", "action", "item", "seeded")


def bridged_ideas(ideas: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ideas after the bridge: matched ones are remote and get the seeded questions as research topics, injected ones are new.

    ``ideas`` has project_id, idea_id, origin_text and, if they have any, source_resolution
    and recommended_research.
    """
    none = F.array().cast("array<string>")
    if "recommended_research" not in ideas.columns:
        ideas = ideas.withColumn("recommended_research", none)
    if "source_resolution" not in ideas.columns:
        ideas = ideas.withColumn("source_resolution", F.lit(None).cast("string"))
    ideas = ideas.select("project_id", F.col("idea_id").cast("string").alias("idea_id"), "origin_text", "source_resolution", F.coalesce("recommended_research", none).alias("recommended_research"))
    seeds = decisions.groupBy("project_id", F.col("item").alias("idea_id")).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("seeded"), F.struct("question_no", "question")))), lambda s: s["question"]).alias("seeds"), F.min_by("question", F.when(F.col("action") != "matched_existing_item", F.col("question_no"))).alias("own"))
    rows = ideas.join(seeds, ["project_id", "idea_id"], "full_outer")
    return rows.select("project_id", "idea_id", F.coalesce("origin_text", "own").alias("origin_text"), F.when(F.col("seeds").isNotNull(), "answer_remote").otherwise(F.col("source_resolution")).alias("source_resolution"), F.concat(F.coalesce("recommended_research", none), F.coalesce("seeds", none)).alias("recommended_research"))


def bridge_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("project_id").agg(F.count(F.lit(1)).alias("remote_questions"), F.count_if(F.col("action") == "matched_existing_item").alias("matched_items"), F.count_if(F.col("action") != "matched_existing_item").alias("injected_items"), F.count_if("seeded").alias("seeded_research_topics"))


REQUIRED = ("id", "agent", "timestamp", "origin_text", "origin_type", "assistant_response", "context_link")


def validate_ideas(items: DataFrame) -> DataFrame:
    """``reject_reason`` of each idea row; null where it is valid."""
    blank = lambda c: tx.strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    reasons = [F.when(blank(c), F.lit(f"missing {c}")) for c in REQUIRED]
    reasons += [F.when(F.col("origin_type") != "Open Question", F.lit("origin_type")), F.when(F.col("metadata").isNull() | F.col("metadata.theme").isNull() | F.col("metadata.confidence").isNull(), F.lit("metadata")), F.when(F.coalesce(F.col("metadata.priority").cast("string").try_cast("int") < 1, F.lit(True)), F.lit("priority"))]
    return items.withColumn("reject_reason", F.coalesce(*reasons))


def researched(research: Column) -> Column:
    """Entries with a topic and a summary."""
    return F.filter(F.coalesce(research, F.array().cast("array<struct<research_topic:string,research_summary:string>>")), lambda r: (tx.strip(F.coalesce(r["research_topic"], F.lit(""))) != "") & (tx.strip(F.coalesce(r["research_summary"], F.lit(""))) != ""))


def without_research(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items to keep, and remote items dropped because they have no valid research."""
    bad = (tx.resolution(F.col("source_resolution")) == "answer_remote") & (F.size(researched(F.col("research"))) == 0)
    return items.where(~bad), items.where(bad)


def memory_pairs(items: DataFrame) -> DataFrame:
    """User and assistant text to persist: one row for each research entry of remote items, else one."""
    remote = tx.resolution(F.col("source_resolution")) == "answer_remote"
    one = F.array(F.struct(F.col("origin_text").alias("user_text"), F.col("assistant_response").alias("assistant_text")))
    many = F.transform(researched(F.col("research")), lambda r: F.struct(r["research_topic"].alias("user_text"), r["research_summary"].alias("assistant_text")))
    rows = items.select("project_id", "idea_id", F.posexplode(F.when(remote, many).otherwise(one)).alias("at", "p")).select("project_id", "idea_id", "at", "p.*")
    return rows.where((tx.strip("user_text") != "") & (tx.strip("assistant_text") != ""))


def research_topics(items: DataFrame, order: str = "idea_id") -> DataFrame:
    """Distinct recommended topics of a project, case aside, first seen first."""
    rows = items.select("project_id", order, F.posexplode("recommended_research").alias("at", "raw")).withColumn("topic", tx.strip("raw")).where("topic <> ''")
    first = F.row_number().over(Window.partitionBy("project_id", F.lower("topic")).orderBy(order, "at"))
    seen = rows.withColumn("rn", first).where("rn = 1").drop("rn")
    numbered = running(seen, ["project_id"], order, Running(sums={"topic_no": F.lit(1)}, inclusive=True), ties=("at",))
    return numbered.select("project_id", F.col("topic_no").cast("int").alias("topic_no"), "topic")


def origin_ids(item_ids: Column, memory_id: Column, metadata_ids: Column) -> Column:
    """Distinct non-empty ids over all fields, in order."""
    ids = F.concat(F.array(item_ids, memory_id), F.coalesce(metadata_ids, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(ids, tx.strip), lambda x: F.coalesce(x, F.lit("")) != ""))


def parse_log(lines: DataFrame) -> DataFrame:
    """Rows of a JSON-lines log; blank, broken and non-object lines are left out.

    ``lines`` has ``project_id``, ``line_no`` and ``value``.
    """
    schema = "ts string, question string, topic string, resolution string, namespace string, semantic_handle string, pair_id string"
    rows = lines.where(F.trim("value").startswith("{")).withColumn("j", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    return rows.where("j is not null").select("project_id", "line_no", "j.*").where("coalesce(trim(question), '') <> ''")


def remembered(items: DataFrame) -> DataFrame:
    """Items that were accepted to be remembered."""
    return items.where(F.coalesce("remember", F.lit(False)))


def pending(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pending items with the new ones behind them."""
    return old.unionByName(new, allowMissingColumns=True)


def research_plan(items: DataFrame) -> DataFrame:
    """One row for each idea and recommended topic."""
    return items.select("project_id", "idea_id", F.posexplode("recommended_research").alias("at", "topic")).where(tx.strip("topic") != "")
