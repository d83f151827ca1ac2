"""The incremental paths as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from memlake.functions import text as tx
from memlake.operators import chunks as ck
from memlake.operators import questions as qs
from memlake.operators import telemetry as tm
from memlake.sources.writers import append_telemetry

ROLLED = "project_id string, user_id long, assistant_id long, user_text string, assistant_text string"
#: Folders of a question table, by hash of the project.  Tables that exist hold the number: another one needs a new table.
QUESTION_BUCKETS = 256
_STATE = T.StructType([T.StructField("id", T.LongType()), T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])


class RollOff(StatefulProcessor):
    """Keeps the newest pairs of a project as state and emits older ones.

    A project's messages arrive in the order of their ids.  State holds the kept pairs
    and the last message if it may still begin one: 2 * limit + 1 rows a project; what
    can no longer be in a pair is dropped.
    """

    def __init__(self, limit: int):
        self._limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getListState("held", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self._held.get()]
        for frame in rows:
            held += list(frame[["id", "role", "content"]].itertuples(index=False, name=None))
        held.sort(key=lambda r: r[0])
        starts = [i for i in range(len(held) - 1) if held[i][1] == "user" and held[i + 1][1] == "assistant"]
        rolled = starts[: max(0, len(starts) - self._limit)]
        out = [(key[0], int(held[i][0]), int(held[i + 1][0]), held[i][2], held[i + 1][2]) for i in rolled]
        kept = [r for i in starts[len(rolled) :] for r in held[i : i + 2]]
        kept += held[-1:] if held and held[-1][1] == "user" else []
        self._held.put([(int(a), b, c) for a, b, c in kept])
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in ROLLED.split(", ")])

    def close(self) -> None:
        pass


def rolled_pairs(messages: DataFrame, limit: int) -> DataFrame:
    """Stream of messages (project_id, id, role, content) to the pairs that roll off."""
    return messages.groupBy("project_id").transformWithStateInPandas(statefulProcessor=RollOff(limit), outputStructType=ROLLED, outputMode="Update", timeMode="None")


def consolidated_questions(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Question log to a latest-wins table: each batch is merged with the kept newest rows of its projects.

    ``log`` has project_id, line_no, ts, question, topic, resolution.  The table keeps
    newest rows also where they are ``ignore``, so that they go on cancelling.  It lies in
    ``QUESTION_BUCKETS`` folders, of which a batch rewrites those of its projects: its files
    follow their bytes and not the number of projects.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("project_id"), F.lit(QUESTION_BUCKETS)).cast("int")
        rows = batch.withColumns({"key": tx.question_key(F.col("question"), F.col("topic")), "bucket": bucket})
        try:
            before = spark.read.schema(rows.schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # the first batch finds no table
                raise
        else:
            touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
            rows = rows.unionByName(before.where(F.col("bucket").isin(touched)))
        newest = Window.partitionBy("project_id", "key").orderBy(F.desc("ts"), F.desc("line_no"))
        kept = rows.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")
        # Written apart first: a table is never overwritten from itself, and a batch that fails between can be repeated.
        aside = f"{path.rstrip('/')}_batches/{number}"
        kept.hint("rebalance", "bucket").write.mode("overwrite").parquet(aside)  # a bucket's rows side by side, a large bucket's in several files
        spark.read.schema(kept.schema).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}_batches")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def open_questions(spark: SparkSession, path: str) -> DataFrame:
    """The consolidated view of the table that :func:`consolidated_questions` keeps."""
    return qs.consolidate(spark.read.parquet(path).drop("bucket"))


def appended_chunks(documents: DataFrame, path: str, checkpoint: str, size: int, overlap: int, dims: int) -> StreamingQuery:
    """New documents (project_id, doc_id, text) to chunk rows with vectors, appended."""
    rows = ck.embed(ck.chunk(documents, size, overlap), "chunk", lambda: ck.HashEmbedder(dims))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("project_id").trigger(availableNow=True).start()


TURN = "run_id string, turn_id long, invocations long, main_count long, helper_count long, main_total long, helper_prompt long, helper_completion long, provider_tokens long, estimated_tokens long, zero_tokens long, main_ttlt_ms long, turn_total long, turn_usage_source string"
_CALL = ("invocation_id", "purpose", "total_tokens", "prompt_tokens", "completion_tokens", "usage_source", "ttlt_ms")
_CALL_STATE = T.StructType([T.StructField(n, T.StringType() if n in ("purpose", "usage_source") else T.LongType()) for n in ("turn_id", "at", *_CALL)])


def _rollup(run: str, turn: int, calls: list[tuple]) -> tuple:
    """The numbers of ``telemetry.turn_rollup`` for the calls of one turn."""
    rows = [dict(zip(_CALL, c[2:], strict=True)) for c in calls]
    main, rest = [r for r in rows if r["purpose"] == "main"], [r for r in rows if r["purpose"] != "main"]
    total = lambda part, name: int(sum(r[name] or 0 for r in part))
    source = {s: total([r for r in rows if r["usage_source"] == s], "total_tokens") for s in ("provider", "estimate", "zero_fallback")}
    last = max(main, key=lambda r: r["invocation_id"])["ttlt_ms"] if main else None
    used = "estimate" if source["estimate"] > 0 else "zero_fallback" if source["zero_fallback"] > 0 else "provider"
    known, prompt = total(main, "total_tokens"), total(rest, "prompt_tokens")
    return run, turn, len(rows), len(main), len(rest), known, prompt, total(rest, "completion_tokens"), source["provider"], source["estimate"], source["zero_fallback"], last, known + prompt, used


class Turns(StatefulProcessor):
    """Keeps the calls of a run's open turn; a turn comes out when the next one begins, or when its timer fires.

    Repeated calls count once.  Calls of a turn that has come out are dropped.  State is
    one turn's calls a run and the number of the last turn, and goes with a second timer.
    """

    def __init__(self, idle_ms: int, keep_ms: int):
        self._idle, self._keep = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._calls = handle.getListState("calls", _CALL_STATE)
        self._last = handle.getValueState("last", T.StructType([T.StructField("turn_id", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        calls = [tuple(c) for c in self._calls.get()]
        last = self._last.get()[0] if self._last.exists() else None
        frame = pd.concat(rows).sort_values(["ts", "invocation_id"])
        seen, out = {c[2] for c in calls}, []
        at = frame["ts"].astype("datetime64[ms]").astype("int64")
        for turn, ms, *call in zip(frame["turn_id"], at, *(frame[c] for c in _CALL), strict=True):
            turn = int(turn)
            if calls and turn > calls[0][0]:
                last = calls[0][0]
                out.append(_rollup(key[0], last, calls))
                calls, seen = [], set()
            if (last is not None and turn <= last) or (calls and turn < calls[0][0]) or call[0] in seen:
                continue
            seen.add(call[0])
            calls.append((turn, int(ms), *(x if isinstance(x, str) else None if pd.isna(x) else int(x) for x in call)))
        self._store(calls, last)
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        # Whatever the batch held, the open turn waits from its newest call on.
        self._handle.registerTimer((max(c[1] for c in calls) if calls else int(at.max())) + (self._idle if calls else self._keep))
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in TURN.split(", ")])

    def _store(self, calls: list[tuple], last: int | None) -> None:
        if calls:
            self._calls.put(calls)
        else:
            self._calls.clear()
        if last is not None:
            self._last.update((last,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        calls = [tuple(c) for c in self._calls.get()]
        if calls:
            self._store([], calls[0][0])
            self._handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self._keep)
            yield pd.DataFrame([_rollup(key[0], calls[0][0], calls)], columns=[f.split()[0] for f in TURN.split(", ")])
        else:
            self._last.clear()  # a run that has been silent for so long is forgotten

    def close(self) -> None:
        pass


def turn_totals(invocations: DataFrame, late: str = "10 minutes", idle_ms: int = 3_600_000, keep_ms: int = 86_400_000) -> DataFrame:
    """The rollup of each turn (see ``telemetry.turn_rollup``), once, however many hours it lasts.

    A turn closes when its run's next turn begins or ``idle_ms`` of event time after its last
    call; a run's last turn number is kept for ``keep_ms`` more.  Numbers are longs.
    """
    columns = ["run_id", "turn_id", "ts", *_CALL]
    kinds = {"run_id": "string", "purpose": "string", "usage_source": "string", "ts": "timestamp"}
    rows = invocations.select(*(F.col(c).cast(kinds.get(c, "long")).alias(c) for c in columns)).withWatermark("ts", late)
    return rows.groupBy("run_id").transformWithStateInPandas(statefulProcessor=Turns(idle_ms, keep_ms), outputStructType=TURN, outputMode="Append", timeMode="EventTime")


class Screen(StatefulProcessor):
    """Telemetry events with verdicts, as ``telemetry.screen_calls`` gives them, over batches.

    With ``idle_ms``, a run that has been silent for so long is over: its calls go and a
    tombstone stays, for which every further event is late; so does an ended run's.  After
    ``keep_ms`` more the tombstone goes too.
    """

    def __init__(self, idle_ms: int | None = None, keep_ms: int = 0):
        self._idle, self._keep = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._run = handle.getValueState("run", T.StructType([T.StructField("top", T.LongType()), T.StructField("over", T.BooleanType())]))
        self._calls = handle.getMapState("calls", T.StructType([T.StructField("invocation_id", T.LongType())]), T.StructType([T.StructField("ended", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        top, over = self._run.get() if self._run.exists() else (None, False)
        was_over = over
        frame = pd.concat(rows).sort_values("arrival")
        verdicts = []
        for kind, turn, call in zip(frame["kind"], frame["turn_id"], frame["invocation_id"], strict=True):
            verdict = "late" if over else "accepted"
            if not over and kind == "turn":
                turn = int(turn)
                verdict = "repeated" if turn == top else "decreasing" if top is not None and turn < top else "accepted"
                top = turn if top is None else max(top, turn)
            elif not over and kind in ("start", "end"):
                known = self._calls.getValue((int(call),)) if self._calls.containsKey((int(call),)) else None
                if kind == "start":
                    verdict = "repeated" if known else "accepted"
                    if not known:
                        self._calls.updateValue((int(call),), (False,))
                else:
                    verdict = "unknown" if not known else "repeated" if known[0] else "accepted"
                    if known:
                        self._calls.updateValue((int(call),), (True,))
            elif kind == "run_end":
                over = True
            verdicts.append(verdict)
        yield pd.DataFrame({"run_id": key[0], "arrival": frame["arrival"], "kind": frame["kind"], "verdict": verdicts})
        self._run.update((top, over))
        if over:
            self._calls.clear()  # nothing counts any more
        if self._idle is not None and not was_over:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            newest = int(frame["ts"].astype("datetime64[ms]").astype("int64").max())
            self._handle.registerTimer(newest + (self._keep if over else self._idle))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._run.exists() and not self._run.get()[1]:
            self._run.update((self._run.get()[0], True))
            self._calls.clear()
            self._handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self._keep)
        else:
            self._run.clear()
        return iter(())

    def close(self) -> None:
        pass


def screened(events: DataFrame, idle_ms: int | None = None, keep_ms: int = 86_400_000, late: str = "10 minutes") -> DataFrame:
    """Stream of telemetry events to rows (run_id, arrival, kind, verdict); a batch's events are in order of arrival.

    With ``idle_ms``, events have a time ``ts``, and state of runs that never end goes (see :class:`Screen`).
    """
    schema = "run_id string, arrival long, kind string, verdict string"
    if idle_ms is None:
        return events.groupBy("run_id").transformWithStateInPandas(statefulProcessor=Screen(), outputStructType=schema, outputMode="Append", timeMode="None")
    timed = events.withWatermark("ts", late)
    return timed.groupBy("run_id").transformWithStateInPandas(statefulProcessor=Screen(idle_ms, keep_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def appended_telemetry(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Telemetry rows appended batch by batch; a batch that is repeated replaces itself."""
    return rows.writeStream.foreachBatch(lambda batch, number: append_telemetry(batch, path, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def volumes(invocations: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    return tm.volumes(invocations.withWatermark("ts", late), width)
