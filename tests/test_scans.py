"""Running values of hot groups equal plain windows, and no task holds a hot group."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.operators import chunks as ck
from memlake.operators import scans


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])), k * 3 - 500, rng.choice([None, 1, 2, 5]), f"t{k}") for k in range(3000)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, at long, v long, t string")


@pytest.mark.parametrize("inclusive", [False, True])
def test_blocks_equal_windows(spark, rows, inclusive):
    want = scans.Running(sums={"s": F.col("v"), "n": F.lit(1)}, maxima={"m": F.col("v")}, inclusive=inclusive, leads={"next": F.col("t"), "next_v": F.col("v")}, lags={"prev": F.col("t")}, totals={"all": F.col("v")})
    got = scans.running(rows, ["k"], "at", want, most=100, blocks=16)
    plain = scans.running(rows, ["k"], "at", want)
    assert got.columns == plain.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    w = Window.partitionBy("k").orderBy("at")
    assert plain.where("n <> r").count() == 0 if "r" in plain.columns else True
    numbered = plain.withColumn("r", F.row_number().over(w) - (0 if inclusive else 1))
    assert numbered.where("n <> r").count() == 0


def test_a_hot_group_is_spread(spark, rows):
    dealt = scans.blocks_of(rows, ["k"], "at", most=100, blocks=16)
    sizes = {(r.k, r._block): r.n for r in dealt.groupBy("k", "_block").agg(F.count(F.lit(1)).alias("n")).collect()}
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert len(hot) == 16 and max(hot) < 2 * sum(hot) / 16
    assert scans.blocks_of(rows, ["k"], "at") is None
    plan = scans.running(rows, ["k"], "at", scans.Running(sums={"s": F.col("v")}), most=100, blocks=16)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_block" in plan


def test_empty(spark, rows):
    assert scans.running(rows.where("false"), ["k"], "at", scans.Running(sums={"s": F.col("v")}), most=0).count() == 0


def loop_batches(tokens, budget):
    out, used, number = [], 0, 0
    for k, n in enumerate(tokens):
        if k and used + n > budget and used:
            number, used = number + 1, 0
        used += n
        out.append(number)
    return out


def test_linked_batches_equal_the_loop(spark):
    rng = random.Random(8)
    groups = {f"g{k}": [rng.choice([0, 0, 1, 3, 7, 20, 60]) for _ in range(rng.randint(1, 400))] for k in range(4)} | {"zeros": [0] * 60 + [99, 0, 99], "one": [500]}
    rows = spark.createDataFrame([(g, k * 2, n) for g, ns in groups.items() for k, n in enumerate(ns)], "g string, at long, tokens long")
    want = {(g, k * 2): b for g, ns in groups.items() for k, b in enumerate(loop_batches(ns, 25))}
    for most in (10**6, 50, 0):
        got = {(r.g, r.at): r.batch_id for r in ck.token_batches(rows, ["g"], ["at"], "tokens", 25, most=most).collect()}
        assert got == want
