"""Repair of the turn structure of conversations by Four-Russians block tables.

A conversation is a string of symbols, one a row: the initial of its role and whether its
text is cut off, or that it must go.  The cheapest edits to a legal order are found by a
dynamic program whose column is a vector of four costs (one a state of the order's
automaton: start, after system, after user, after assistant).  Normalised by its least
cost, only a few dozen vectors exist, so the step of *every* block of ``BLOCK`` symbols is
a table from vector to vector and offset.  Vectors hold the cost of what is still to come
and are looked up from the last block to the first; each block is then expanded backward
into its inner vectors and traced forward, so the least letter that keeps the cost is
always the right one among ties.

Rows are range-partitioned and sorted.  A conversation that lies inside a task and is no
longer than a segment is repaired there.  All others are cut into segments of bounded size;
a segment's table step for all vectors is a short row, those rows are chained for each
conversation, and the segments are traced wherever they lie.  Only the chains, the audit
and the digest of one conversation are one task's work, over rows of whole segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from memlake.llm.storage import bounded_batches, materialize

#: Symbols of a block, rows and text bytes of a segment.
BLOCK, SEGMENT_ROWS, SEGMENT_BYTES = 4, 4096, 2 << 20
#: Costs of the edits, and of a row that is kept although its text is cut off.
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Symbols: 2 * kind of role (system, user, assistant, other) + cut off, and one for rows that must go.
SYSTEM, USER, ASSISTANT, OTHER, GONE, SYMBOLS = 0, 1, 2, 3, 8, 9
#: State after the message that may follow a state: user after start, system and assistant, else assistant.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
#: What tells segments apart.
_KEY = ["conv", "part", "seq"]

Vector = tuple[int, ...]


def _with_inserts(costs: list[int]) -> Vector:
    for _ in range(3):
        costs = [min(costs[s], INSERT + costs[NEXT[s]]) for s in range(4)]
    return tuple(costs)


def _kept(state: int, symbol: int) -> int | None:
    """State after a row is kept, None where its role may not stand there."""
    if state == 0 and symbol // 2 == SYSTEM:
        return 1
    return NEXT[state] if symbol // 2 == (ASSISTANT if state == 2 else USER) else None


def _before(after: Vector, symbol: int) -> Vector:
    """Costs to go before a row, inserts in front of it included."""
    costs = [DELETE + c for c in after]
    if symbol != GONE:
        extra = CUT_OFF * (symbol % 2)
        for s in range(4):
            costs[s] = min(costs[s], REROLE + extra + after[NEXT[s]])
            if (t := _kept(s, symbol)) is not None:
                costs[s] = min(costs[s], extra + after[t])
    return _with_inserts(costs)


class BlockTables:
    """Steps of all normalised vectors over all single symbols and all blocks."""

    def __init__(self) -> None:
        inf = 1 << 20
        end = _with_inserts([0, inf, inf, 0])
        self.vectors: list[Vector] = [end]
        known, steps = {end: 0}, []
        for v in self.vectors:  # grows while it is read
            row = []
            for symbol in range(SYMBOLS):
                raw = _before(v, symbol)
                least = min(raw)
                new = tuple(c - least for c in raw)
                if new not in known:
                    known[new] = len(self.vectors)
                    self.vectors.append(new)
                row.append((known[new], least))
            steps.append(row)
        self.one = np.array(steps, np.int64)  # (vector, symbol) to (vector, offset)
        to, cost = self.one[:, :, 0], self.one[:, :, 1]
        for _ in range(BLOCK - 1):
            # A symbol in front of the blocks so far: first their step, then its own.
            inner, spent = to, cost
            to = np.concatenate([self.one[inner, c, 0] for c in range(SYMBOLS)], axis=1)
            cost = np.concatenate([spent + self.one[inner, c, 1] for c in range(SYMBOLS)], axis=1)
        self.to, self.cost = to, cost
        self._traced: dict[tuple[int, int, int], tuple[str, int]] = {}
        self._rows: dict[tuple[int, int, int], tuple[str, int]] = {}
        self._place = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)

    def blocks(self, symbols: bytes) -> tuple[bytes, list[int]]:
        """The symbols that fill no block, which stand in front, and the numbers of the blocks."""
        head = len(symbols) % BLOCK
        return symbols[:head], (np.array(list(symbols[head:]), np.int64).reshape(-1, BLOCK) @ self._place).tolist()

    def all_vectors(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind the symbols: the vector before them, and what they cost."""
        at, spent = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        head, blocks = self.blocks(symbols)
        for b in reversed(blocks):
            at, spent = self.to[at, b], spent + self.cost[at, b]
        for c in reversed(head):
            at, spent = self.one[at, c, 0], spent + self.one[at, c, 1]
        return at, spent

    def trace(self, symbols: bytes, behind: int, state: int) -> tuple[str, int]:
        """Letters of the cheapest edits, the least among equals, and the state after them."""
        head, blocks = self.blocks(symbols)
        rights = []
        for b in reversed(blocks):
            rights.append(behind)
            behind = int(self.to[behind, b])
        inner = []
        for c in reversed(head):
            inner.append(behind)
            behind = int(self.one[behind, c, 0])
        letters = []
        for c in head:
            text, state = self._row(inner.pop(), c, state)
            letters.append(text)
        for b in blocks:
            text, state = self._block(rights.pop(), b, state)
            letters.append(text)
        return "".join(letters), state

    def _block(self, behind: int, block: int, state: int) -> tuple[str, int]:
        key = (behind, block, state)
        if key not in self._traced:
            symbols = [int(block // p % SYMBOLS) for p in self._place]
            inner = [behind]
            for c in symbols[:0:-1]:  # expanded backward
                inner.append(int(self.one[inner[-1], c, 0]))
            letters = ""
            for c in symbols:
                text, state = self._row(inner.pop(), c, state)
                letters += text
            self._traced[key] = letters, state
        return self._traced[key]

    def _row(self, behind: int, symbol: int, state: int) -> tuple[str, int]:
        key = (behind, symbol, state)
        if key not in self._rows:
            self._rows[key] = self._edits(behind, symbol, state)
        return self._rows[key]

    def _edits(self, behind: int, symbol: int, state: int) -> tuple[str, int]:
        """The row's letter with the inserts in front of it: the least that keep the cost (D, I, K, R)."""
        after, letters = self.vectors[behind], ""
        before, extra = _before(after, symbol), CUT_OFF * (symbol % 2)
        while True:
            if DELETE + after[state] == before[state]:
                return letters + "D", state
            if INSERT + before[NEXT[state]] == before[state]:
                letters, state = letters + "I", NEXT[state]
                continue
            if symbol != GONE and (t := _kept(state, symbol)) is not None and extra + after[t] == before[state]:
                return letters + "K", t
            return letters + "R", NEXT[state]

    def tail(self, state: int) -> str:
        """Inserts behind the last row."""
        return {1: "II", 2: "I"}.get(state, "")


@cache
def tables() -> BlockTables:
    """The tables, made once in each Python worker."""
    return BlockTables()


def repaired(letters: str, symbols: bytes, roles: list[str], texts: list[str], state: int) -> Iterator[str]:
    """``role:text`` of the messages that the letters leave, from a state on."""
    at = 0
    for x in letters:
        if x == "I":
            state = NEXT[state]
            yield f"{ROLE[state]}:"
            continue
        if x == "K":
            state = _kept(state, symbols[at])
            yield f"{roles[at]}:{texts[at]}"
        elif x == "R":
            state = NEXT[state]
            yield f"{ROLE[state]}:{texts[at]}"
        at += 1


class _Segment:
    """Rows of one conversation that stand together."""

    def __init__(self) -> None:
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.symbols, self.digests, self.bytes = bytearray(), bytearray(), 0
        self.blank = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        kind = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(role[:1], OTHER)
        self.blank += fault == 1
        self.truncated += fault == 2
        self.symbols.append(GONE if fault == 1 else 2 * kind + (fault == 2))
        # Role and text are told apart by their lengths; 16 bytes of SHA-256 stand for both.
        self.digests += hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
        self.roles.append(role)
        self.texts.append(text)
        self.bytes += len(text)

    def full(self, rows: int) -> bool:
        return len(self.roles) >= rows or self.bytes >= SEGMENT_BYTES

    def drop(self, repeated: list[int]) -> tuple[bytes, int, int]:
        """Symbols in which repeated rows must go, the number of those, and the cut-off rows among them."""
        return drop(bytes(self.symbols), repeated)


def drop(symbols: bytes, repeated: list[int]) -> tuple[bytes, int, int]:
    """Symbols in which repeated rows must go (blank ones do so already), how many those are, and the cut-off ones among them."""
    out = bytearray(symbols)
    hit = [i for i in repeated if symbols[i] != GONE]
    for i in hit:
        out[i] = GONE
    return bytes(out), len(hit), sum(symbols[i] % 2 for i in hit)


_DONE = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PART = "part int, seq int, symbols binary, digests binary, low long, high long, turns long, first string, last string, seg_blank long, seg_truncated long, seg_illegal long, roles array<string>, texts array<string>"


def _finished(segment: _Segment) -> tuple:
    """Result of a conversation that is one whole segment."""
    seen, again = set(), []
    for i in range(len(segment.roles)):
        digest = bytes(segment.digests[16 * i : 16 * i + 16])
        if digest in seen:
            again.append(i)
        seen.add(digest)
    symbols, double, cut = segment.drop(again)
    t = tables()
    at, spent = t.all_vectors(symbols)
    letters, state = t.trace(symbols, 0, 0)
    letters += t.tail(state)
    body = "\n".join(repaired(letters, symbols, segment.roles, segment.texts, 0))
    gaps = 0 if segment.low is None else segment.high - segment.low + 1 - segment.turns
    cost = int(spent[0]) + t.vectors[int(at[0])][0]
    return gaps, segment.blank, double, segment.truncated - cut, segment.illegal, cost, letters, hashlib.sha256(body.encode()).hexdigest()


def _first_pass(schema: pa.Schema, segment_rows: int):
    """Sorted rows to results of conversations that lie inside the task, and to segments of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, held = TaskContext.get().partitionId(), [], 0
        segment, conv, seq, first = None, None, 0, True

        def flush(whole: bool) -> tuple:
            if whole:
                return (conv, *_finished(segment), *[None] * 14)
            s = segment
            ends = (s.roles[0][:1], s.roles[-1][:1]) if s.roles else (None, None)
            return (conv, *[None] * 8, part, seq, bytes(s.symbols), bytes(s.digests), s.low, s.high, s.turns, *ends, s.blank, s.truncated, s.illegal, s.roles, s.texts)

        def batch() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for b in batches:
            for row_conv, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if segment is None or row_conv != conv:
                    if segment is not None:
                        # The first conversation of a task may have begun in another one.
                        out.append(flush(not first and seq == 0))
                        held, first = held + segment.bytes, False
                    segment, conv, seq = _Segment(), row_conv, 0
                for _ in range(copies):
                    if segment.full(segment_rows):
                        out.append(flush(False))
                        held += segment.bytes
                        segment, seq = _Segment(), seq + 1
                    segment.add(turn, role, text, fault)
                if held > SEGMENT_BYTES or len(out) > 4096:
                    if out:
                        yield batch()
                    out, held = [], 0
        if segment is not None:
            out.append(flush(False))
        if out:
            yield batch()

    return run


def _stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A segment's symbols without its repeated rows, and its step for all vectors."""
    for batch in batches:
        cols = {n: batch.column(n) for n in ("symbols", "firsts")}
        rows = []
        for symbols, firsts in zip(cols["symbols"].to_pylist(), cols["firsts"].to_pylist(), strict=True):
            keep = set(firsts or ())
            rows.append(drop(symbols, [i for i in range(len(symbols)) if i not in keep]))
        steps = [tables().all_vectors(r[0]) for r in rows]
        columns = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
        columns += [pa.array([s[k].tolist() for s in steps], pa.list_(pa.int64())) for k in (0, 1)]
        kept = [n for n in batch.schema.names if n not in ("symbols", "firsts")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns], names=[*kept, "symbols", "double", "cut", "to", "spent"])


def _suffix_chain(conv: str):
    """Last segment first: the vector behind each segment, and the conversation's cost before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, last, behind, total, started = tables(), None, 0, 0, False
        for batch in batches:
            out = []
            for c, to, spent in zip(*(batch.column(n).to_pylist() for n in (conv, "to", "spent")), strict=True):
                final = not started or c != last
                if final:
                    last, behind, total, started = c, 0, 0, True
                total += spent[behind]
                out.append((behind, final, total + t.vectors[to[behind]][0]))
                behind = to[behind]
            kept = [conv, "part", "seq", "symbols"]
            columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.bool_(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns], names=[*kept, "behind", "final", "cost_from"])

    return run


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State after a segment for each state before it."""
    for batch in batches:
        t = tables()
        rows = [[t.trace(s, v, state)[1] for state in range(4)] for s, v in zip(batch.column("symbols").to_pylist(), batch.column("behind").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int64()))], names=[*batch.schema.names, "exits"])


def _prefix_chain(conv: str):
    """First segment first: the state before each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, started = None, 0, False
        for batch in batches:
            out = []
            for c, exits in zip(batch.column(conv).to_pylist(), batch.column("exits").to_pylist(), strict=True):
                if not started or c != last:
                    last, state, started = c, 0, True
                out.append(state)
                state = exits[state]
            kept = [conv, "part", "seq", "symbols", "behind", "final", "cost_from"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out, pa.int64())], names=[*kept, "state"])

    return run


def _rendered(keep: list[str]):
    """Audit letters and repaired text of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, letters, bodies = tables(), [], []
            names = ("symbols", "behind", "state", "final", "roles", "texts")
            for symbols, behind, state, final, roles, texts in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                found, after = t.trace(symbols, behind, state)
                found += t.tail(after) if final else ""
                rows = list(repaired(found, symbols, roles, texts, state))
                letters.append(found)
                bodies.append("\n".join(rows).encode() if rows else None)  # null: no message, not an empty one
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(letters, pa.string()), pa.array(bodies, pa.binary())], names=[*keep, "letters", "body"])

    return run


def _gathered(conv: str, schema: pa.Schema):
    """Sorted segments to one row a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, state = False, None

        def row() -> tuple:
            c, counts, letters, digest, low, high, turns = state["conv"], state["counts"], state["letters"], state["digest"], state["low"], state["high"], state["turns"]
            gaps = 0 if low is None else high - low + 1 - turns
            return (c, gaps, counts[0], counts[1], counts[2], counts[3], state["cost"], "".join(letters), digest.hexdigest())

        for batch in batches:
            out = []
            names = (conv, "low", "high", "turns", "first", "last", "seg_blank", "double", "seg_truncated", "cut", "seg_illegal", "cost_from", "letters", "body")
            for c, low, high, turns, first, last, blank, double, truncated, cut, illegal, cost, letters, body in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if not have or c != state["conv"]:
                    if have:
                        out.append(row())
                    have, state = True, {"conv": c, "counts": [0] * 4, "letters": [], "digest": hashlib.sha256(), "any": False, "low": None, "high": None, "turns": 0, "last": None, "cost": cost}
                n = state["counts"]
                crossing = state["last"] is not None and first is not None and state["last"] + first not in LEGAL
                n[0], n[1], n[2], n[3] = n[0] + blank, n[1] + double, n[2] + truncated - cut, n[3] + illegal + crossing
                if low is not None:
                    state["turns"] += turns - (state["high"] == low)
                    state["low"], state["high"] = low if state["low"] is None else state["low"], high
                state["last"] = last if last is not None else state["last"]
                state["letters"].append(letters)
                if body is not None:
                    state["digest"].update((b"\n" if state["any"] else b"") + body)
                    state["any"] = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if have:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row(), schema, strict=True)], schema=schema)

    return run


def fault(text: Column) -> Column:
    """1 for a blank text, 2 for one whose last character that is no white space ends no sentence, else 0."""
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), 1).when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), 2).otherwise(0)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired messages of every conversation.

    Adds to ``conv``: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256.  With ``copies`` a row stands that many times; one with 0 only names
    its conversation.  Null roles and texts are one space; a null turn comes first; a null
    conversation is one of its own; rows of one turn (ties) are ordered by role, then by a
    hash of the text, and equal rows are interchangeable.  Very long texts are read whole.
    A conversation without rows has zeros, no edits and the digest of the empty text; an
    empty table gives no rows.  Other columns are not read, whatever they are called.
    """
    clean = lambda c: F.coalesce(F.col(c), F.lit(" "))
    table = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), clean(role).alias("role"), clean(text).alias("text"), (F.col(copies) if copies else F.lit(1)).cast("int").alias("copies"))
    table = table.select("*", fault(F.col("text")).alias("fault"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("nth"))
    # Keys end in the hash and the place of a row, so that neither one conversation nor equal rows are one task's work.
    keys = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "h", "nth")]
    dealt = bounded_batches(table.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("h", "nth"))
    kind = table.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), *T.StructType.fromDDL(_DONE).fields, *T.StructType.fromDDL(_PART).fields])
    passed = materialize(dealt.mapInArrow(_first_pass(to_arrow_schema(schema), segment_rows), schema), "conversations")
    done = passed.where("part is null").select("conv", *_names(_DONE))
    segments = passed.where("part is not null")
    # First place of every role and text; the rest are repeats.
    n = F.octet_length("digests") / 16
    places = segments.select(*_KEY, "digests", F.explode(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))).alias("i"))
    places = places.select(*_KEY, "i", F.expr("substring(digests, i * 16 + 1, 16)").alias("digest"))
    firsts = places.groupBy("conv", "digest").agg(F.min(F.struct("part", "seq", "i")).alias("at")).groupBy("conv", "at.part", "at.seq").agg(F.collect_list("at.i").alias("firsts"))
    base = T.StructType([schema[c] for c in _KEY])
    more = lambda df, ddl: T.StructType([*df.fields, *T.StructType.fromDDL(ddl).fields])
    short = _matched(segments.select(*_KEY, "symbols"), firsts)
    stepped = materialize(short.mapInArrow(_stepped, more(base, "symbols binary, double long, cut long, to array<long>, spent array<long>")), "conversations")
    order = lambda way: [F.col("conv").asc_nulls_first(), way("part"), way("seq")]
    behind = stepped.repartition("conv").sortWithinPartitions(*order(F.desc)).mapInArrow(_suffix_chain("conv"), more(base, "symbols binary, behind long, final boolean, cost_from long"))
    exits = behind.repartition(*_KEY).mapInArrow(_exits, more(behind.schema, "exits array<long>"))
    states = exits.repartition("conv").sortWithinPartitions(*order(F.asc)).mapInArrow(_prefix_chain("conv"), more(behind.schema, "state long"))
    whole = _matched(_matched(states, stepped.select(*_KEY, "double", "cut")), segments.drop("symbols", "digests", *_names(_DONE)))
    keep = [*_KEY, "low", "high", "turns", "first", "last", "seg_blank", "double", "seg_truncated", "cut", "seg_illegal", "cost_from"]
    rendered = whole.mapInArrow(_rendered(keep), more(T.StructType([whole.schema[c] for c in keep]), "letters string, body binary"))
    result = T.StructType([schema["conv"], *T.StructType.fromDDL(_DONE).fields])
    long = rendered.repartition("conv").sortWithinPartitions(*order(F.asc)).mapInArrow(_gathered("conv", to_arrow_schema(result)), result)
    return done.unionByName(long).withColumnRenamed("conv", conv)


def _matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` with those of ``right`` of the same segment; null conversations are equal."""
    right = right.withColumnsRenamed({"conv": "_c", "part": "_p", "seq": "_s"})
    return left.join(right, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s")), "left").drop("_c", "_p", "_s")


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]
