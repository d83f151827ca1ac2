"""Conversation repair against a search without tables, blocks or segments."""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pytest

from memlake.llm import conversations as cv
from memlake.llm import queries

ROLES = ["system", "user", "assistant", "tool", "unknown", "", " "]


def naive(rows: list[tuple]) -> tuple:
    """Result of the rows (turn, role, text) of one conversation, in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        faults.append(kind)
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    turns = [t for t, _, _ in rows if t is not None]
    after = {"": "u", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i: int, last: str, inserts: int) -> tuple:
        options = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserts < 3:
            role = after[last]
            c, letters, out = best(i, role, inserts + 1)
            options.append((3 + c, "I" + letters, (("user:" if role == "u" else "assistant:"), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            c, letters, out = best(i + 1, last, 0)
            options.append((4 + c, "D" + letters, out))
            if faults[i] not in ("blank", "duplicate"):
                extra, first = 3 * (faults[i] == "truncated"), role[:1]
                if first == after[last] or (first == "s" and last == ""):
                    c, letters, out = best(i + 1, first, 0)
                    options.append((extra + c, "K" + letters, (f"{role}:{text}", *out)))
                c, letters, out = best(i + 1, after[last], 0)
                options.append((3 + extra + c, "R" + letters, (f"{'user' if after[last] == 'u' else 'assistant'}:{text}", *out)))
        return min(options, default=(1 << 30, "", ()))

    cost, letters, out = best(0, "", 0)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = faults.count
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest()


def results(frame) -> dict:
    found = frame.collect()
    got = {r.conv_id: tuple(r)[1:] for r in found}
    assert len(got) == len(found)
    return got


def sample(n: int, longest: int, seed: int) -> list[tuple]:
    rng, rows = np.random.default_rng(seed), []
    for conv in range(n):
        for turn in range(int(rng.integers(0, longest))):
            text = str(rng.choice(["", " \t", "done.", "cut off", "why?  ", "one\ntwo", f"t{turn}.", "e "]))
            rows.append((conv, turn + int(rng.integers(0, 2)) * 100 * turn, str(rng.choice(ROLES)), text))
    return rows


def expected(rows: list[tuple]) -> dict:
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role, text))
    return {c: naive(sorted(r, key=lambda x: x[0])) for c, r in by.items()}


@pytest.mark.parametrize(("n", "longest", "segment"), [(120, 12, 4096), (40, 30, 3), (3, 90, 5)])
def test_equals_search(spark, n, longest, segment):
    """Also where conversations are cut into segments and lie in several tasks."""
    rows = sample(n, longest, n)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert results(cv.repair(frame, segment_rows=segment)) == expected(rows)


def test_block_tables_are_exact():
    t, rng = cv.tables(), np.random.default_rng(5)
    assert len(t.vectors) < 200
    for _ in range(300):
        symbols = bytes(rng.integers(0, cv.SYMBOLS, int(rng.integers(0, 14))).tolist())
        vector = t.vectors[0]
        for c in reversed(symbols):
            vector = cv._before(vector, c)
        at, spent = t.all_vectors(symbols)
        assert tuple(int(spent[0]) + x for x in t.vectors[at[0]]) == vector


def test_awkward_rows(spark):
    rows = [(None, None, None, None, 1), (None, 3, "user", "a.", 1), (1, 5, "user", "x.", 0), (2, None, "user", "x.", 2), (2, None, "user", "x.", 1), (3, 1, "assistant", "long. " * 50_000, 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int").selectExpr("*", "1 as conv", "2 as part", "3 as seq", "4 as symbols")
    got = results(cv.repair(frame, copies="copies"))
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1] == (0, 0, 0, 0, 0, 0, "", empty)
    assert got[None] == naive([(None, " ", " "), (3, "user", "a.")])
    assert got[2] == naive([(None, "user", "x.")] * 3)
    assert got[3] == naive([(1, "assistant", "long. " * 50_000)])
    assert cv.repair(frame.where("false"), copies="copies").count() == 0


def test_query(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(k % 9, k // 9, ("user", "assistant")[k // 9 % 2], f"text {rng.integers(0, 40)}" + str(rng.choice(["", ".", "!? "]))) for k in range(600)]
    rows += [(50, t, "user", "only.") for t in range(4000) if zlib.crc32(f"50:{t}".encode()) % 20 == 0][:1]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    after = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        after += [row] * {0: 0, 3: 2}.get(kind, 1)
    want = expected(after)
    want[50] = naive([])
    assert results(queries.op13_conversation_repair(spark, str(tmp_path))) == want
