"""Model-call telemetry: rollups, invariants and reporting windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.scans import Running, running

SKIP_REASONS = ("disabled_by_route", "budget_zero", "retrieval_error", "no_candidates")


def turn_rollup(invocations: DataFrame, *more: Column) -> DataFrame:
    """Tokens and latency of each turn, main against helper calls, by usage source.

    The turn total is the main total plus the helpers' prompt tokens only.  ``more`` are
    further grouping columns.
    """
    main = F.col("purpose") == "main"
    part = lambda cond, c: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    rows = invocations.groupBy("run_id", "turn_id", *more).agg(
        F.count(F.lit(1)).alias("invocations"), F.count_if(main).alias("main_count"), F.count_if(~main).alias("helper_count"),
        part(main, "total_tokens").alias("main_total"), part(~main, "prompt_tokens").alias("helper_prompt"), part(~main, "completion_tokens").alias("helper_completion"),
        part(F.col("usage_source") == "provider", "total_tokens").alias("provider_tokens"), part(F.col("usage_source") == "estimate", "total_tokens").alias("estimated_tokens"), part(F.col("usage_source") == "zero_fallback", "total_tokens").alias("zero_tokens"),
        F.max_by(F.when(main, F.col("ttlt_ms")), F.when(main, F.col("invocation_id"))).alias("main_ttlt_ms"),
    )
    source = F.when(F.col("estimated_tokens") > 0, "estimate").when(F.col("zero_tokens") > 0, "zero_fallback").otherwise("provider")
    return rows.withColumn("turn_total", F.col("main_total") + F.col("helper_prompt")).withColumn("turn_usage_source", source)


def violations(turns: DataFrame) -> DataFrame:
    """``violations`` of each turn: names of the invariants that do not hold."""
    off = ~F.col("rag_enabled")
    counters = F.col("retrieved_count") + F.col("kept_count") + F.col("expanded_count") + F.col("prompt_rag")
    tests = {
        "main_count": F.col("main_count") != 1,
        "invocations": F.col("invocations") != F.col("main_count") + F.col("helper_count"),
        "kept_over_retrieved": F.col("kept_count") > F.col("retrieved_count"),
        "negative": (F.col("retrieved_count") < 0) | (F.col("kept_count") < 0) | (F.col("expanded_count") < 0),
        "prompt_sum": F.col("prompt_parts") != F.col("context_estimate"),
        "skip_reason": off & ~F.coalesce(F.col("rag_skip_reason").isin(*SKIP_REASONS), F.lit(False)),
        "rag_off_counters": off & (counters != 0),
    }
    return turns.withColumn("violations", F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))).withColumn("valid", F.size("violations") == 0)


def models_by_purpose(invocations: DataFrame) -> DataFrame:
    return invocations.groupBy("purpose").agg(F.array_sort(F.collect_set("model")).alias("models"))


def run_projects(rows: DataFrame) -> DataFrame:
    """Projects seen in a run, the first of them, and whether there are several."""
    return rows.groupBy("run_id").agg(F.array_sort(F.collect_set("project_id")).alias("projects"), F.min_by("project_id", F.struct("ts", "project_id")).alias("first_project"), (F.count_distinct("project_id") > 1).alias("multi_project"))


def completeness(records: DataFrame, fields: list[str]) -> DataFrame:
    """``missing_fields`` and ``completeness`` (full or partial) of benchmark records."""
    rows = records.withColumn("missing_fields", F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields))))
    return rows.withColumn("completeness", F.when(F.size("missing_fields") == 0, "full").otherwise("partial"))


def with_scores(results: DataFrame, scores: DataFrame) -> DataFrame:
    """Benchmark results with their judge scores; results without one stay."""
    return results.join(scores, "case_id", "left")


def monotone_turns(turns: DataFrame) -> DataFrame:
    """Turns whose id exceeds every id that arrived before it in the run."""
    return running(turns, ["run_id"], "arrival", Running(maxima={"_top": F.col("turn_id")})).where("_top is null or turn_id > _top").drop("_top")


def screen_calls(events: DataFrame) -> DataFrame:
    """``verdict`` of each telemetry event of a run in order of arrival.

    ``events`` has run_id, arrival, kind (turn, start, end, run_end), turn_id and
    invocation_id.  Turns must rise (``repeated`` or ``decreasing`` ones are skipped),
    calls end after they started (``unknown``) and once (``repeated``), and nothing counts
    after the run's end (``late``); the rest is ``accepted``.
    """
    kind = lambda k: F.col("kind") == k
    call = Window.partitionBy("run_id", "invocation_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    rows = running(events, ["run_id"], "arrival", Running(maxima={"_top": F.when(kind("turn"), F.col("turn_id")), "_over": kind("run_end")}))
    rows = rows.withColumn("_over", F.coalesce("_over", F.lit(False)))
    rows = rows.withColumn("_start", F.min(F.when(kind("start"), F.col("arrival"))).over(call)).withColumn("_end", F.max(F.when(kind("end"), F.col("arrival"))).over(call))
    rows = rows.withColumn("_began", F.col("_start").isNotNull()).withColumn("_ended", F.coalesce(F.col("_end") > F.col("_start"), F.lit(False)))
    verdict = (
        F.when(F.col("_over"), "late").when(kind("turn") & (F.col("turn_id") == F.col("_top")), "repeated").when(kind("turn") & (F.col("turn_id") < F.col("_top")), "decreasing")
        .when((kind("start") & F.col("_began")) | (kind("end") & F.col("_ended")), "repeated").when(kind("end") & ~F.col("_began"), "unknown").otherwise("accepted")
    )
    return rows.withColumn("verdict", verdict).drop("_top", "_over", "_start", "_end", "_began", "_ended")


def cumulative(turns: DataFrame, values: list[str]) -> DataFrame:
    """Running sums by turn within each run."""
    return running(turns, ["run_id"], "turn_id", Running(sums={f"cum_{v}": F.col(v) for v in values}, inclusive=True))


def volumes(invocations: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Calls and tokens of each purpose in tumbling windows."""
    w = F.window("ts", width)
    return invocations.groupBy(w.alias("w"), "purpose").agg(F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("tokens")).select(F.col("w.start").alias("window_start"), "purpose", "calls", "tokens")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each run: calls until a gap of silence."""
    w = F.session_window("ts", gap)
    return events.groupBy(w.alias("w"), "run_id").agg(F.count(F.lit(1)).alias("calls")).select("run_id", F.col("w.start").alias("session_start"), "calls")
