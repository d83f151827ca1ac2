"""Running values of groups of any size.

A window gives a group to one task.  Where a group has more than ``MOST`` rows, its order
is cut into blocks at quantiles instead: each block is summed up, the few rows of block
sums are scanned, and every row adds what its block's predecessors hold to what a window
within the block gives.  The rows move once, dealt by group and block.  Without such a
group the plain window is the same thing with one block a group.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.steps import cut

#: Rows of a group that one task may order, and blocks that a larger group is cut into.
MOST, BLOCKS = 1_000_000, 1024
#: Bytes of a row at least, as Spark expects a plan's size.
ROW_BYTES = 16


@dataclass(frozen=True)
class Running:
    """What to add to rows: for each new column an expression, summed or maximised over the rows before (and with) the own one."""

    sums: dict[str, Column] = field(default_factory=dict)
    maxima: dict[str, Column] = field(default_factory=dict)
    inclusive: bool = False
    #: Expressions of the next and the previous row of the group.
    leads: dict[str, Column] = field(default_factory=dict)
    lags: dict[str, Column] = field(default_factory=dict)
    #: Expressions summed over the whole group.
    totals: dict[str, Column] = field(default_factory=dict)


def hot_groups(rows: DataFrame, by: list[str], most: int) -> DataFrame | None:
    """Groups of more than ``most`` rows, None if there is none; not counted where Spark expects less than that altogether."""
    if rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= most * ROW_BYTES:
        return None
    hot = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*by)
    return None if hot.isEmpty() else hot


def same_keys(left: DataFrame, right: DataFrame, by: list[str], how: str) -> DataFrame:
    """Join on equal keys, where null equals null; the right keys go."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in by]
    return left.join(right, on, how).drop(*(f"_right_{c}" for c in by))


def blocks_of(rows: DataFrame, by: list[str], order: str, most: int = MOST, blocks: int = BLOCKS) -> DataFrame | None:
    """Rows with ``_block``, which rises with ``order`` within a group; None if every group is small.

    Quantiles of the order of the hot groups only are gathered (``blocks`` numbers a group)
    and written, so that both uses see the same.  Equal orders share a block.
    """
    hot = hot_groups(rows, by, most)
    if hot is None:
        return None
    share = F.array(*(F.lit(k / blocks) for k in range(1, blocks)))
    keyed = rows.select(*by, F.col(order).alias("_order"))
    edges = cut(same_keys(keyed, hot, by, "left_semi").groupBy(*by).agg(F.array_distinct(F.percentile_approx("_order", share, 10 * blocks)).alias("_edges")))
    # Edges rise, so the number below an order is found by halving; the array is short.
    placed = same_keys(rows, edges, by, "left")
    below = F.coalesce(F.size(F.filter("_edges", lambda e: e < F.col(order))), F.lit(0))
    return placed.withColumn("_block", F.greatest(below, F.lit(0))).drop("_edges")


def running(rows: DataFrame, by: list[str], order: str, want: Running, ties: tuple[str, ...] = (), most: int = MOST, blocks: int = BLOCKS) -> DataFrame:
    """Rows with the columns that ``want`` names; ``order`` is a number or time, ``ties`` order rows within it.

    Sums and maxima over no row are 0 and null.
    """
    dealt = blocks_of(rows, by, order, most, blocks)
    keys = [*by, "_block"] if dealt is not None else by
    frame = dealt if dealt is not None else rows
    ordered = Window.partitionBy(*keys).orderBy(order, *ties)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow if want.inclusive else -1)
    whole = Window.partitionBy(*keys)
    local = {n: F.coalesce(F.sum(e).over(upto), F.lit(0)) for n, e in want.sums.items()} | {n: F.max(e).over(upto) for n, e in want.maxima.items()}
    local |= {n: F.lead(e).over(ordered) for n, e in want.leads.items()} | {n: F.lag(e).over(ordered) for n, e in want.lags.items()}
    if dealt is None:
        return rows.withColumns(local | {n: F.coalesce(F.sum(e).over(whole), F.lit(0)) for n, e in want.totals.items()})
    edge = {"_last": F.lead(F.lit(1)).over(ordered).isNull(), "_first": F.lag(F.lit(1)).over(ordered).isNull()}
    place = F.struct(order, *ties)
    parts = {f"_s_{n}": F.coalesce(F.sum(e), F.lit(0)) for n, e in (want.sums | want.totals).items()} | {f"_m_{n}": F.max(e) for n, e in want.maxima.items()}
    parts |= {f"_f_{n}": F.min_by(F.struct(e.alias("v")), place) for n, e in want.leads.items()} | {f"_l_{n}": F.max_by(F.struct(e.alias("v")), place) for n, e in want.lags.items()}
    sums = cut(dealt.groupBy(*keys).agg(*(e.alias(n) for n, e in parts.items())) if parts else dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    # A row a block: at most ``blocks`` rows a group.
    order_ = Window.partitionBy(*by).orderBy("_block")
    before, all_ = order_.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    carried = {f"_b_{n}": F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)) for n in want.sums} | {f"_b_{n}": F.max(f"_m_{n}").over(before) for n in want.maxima}
    carried |= {f"_b_{n}": F.lead(f"_f_{n}").over(order_) for n in want.leads} | {f"_b_{n}": F.lag(f"_l_{n}").over(order_) for n in want.lags} | {f"_t_{n}": F.sum(f"_s_{n}").over(all_) for n in want.totals}
    scanned = sums.select(*keys, *(e.alias(n) for n, e in carried.items()))
    found = same_keys(frame.withColumns(local | edge), scanned, keys, "left")
    final = {n: F.col(n) + F.col(f"_b_{n}") for n in want.sums} | {n: F.greatest(n, f"_b_{n}") for n in want.maxima}
    final |= {n: F.when(F.col("_last"), F.col(f"_b_{n}")["v"]).otherwise(F.col(n)) for n in want.leads} | {n: F.when(F.col("_first"), F.col(f"_b_{n}")["v"]).otherwise(F.col(n)) for n in want.lags}
    final |= {n: F.col(f"_t_{n}") for n in want.totals}
    return found.withColumns(final).select(*rows.columns, *(n for n in [*want.sums, *want.maxima, *want.leads, *want.lags, *want.totals] if n not in rows.columns))
