"""SimHash near-duplicates through a Gray-order hierarchical index (operator 7).

Fingerprints that differ in at most two of 64 bits are linked.  Equal fingerprints
are one node.  Nodes are searched as follows.

* *Upper nodes.*  The bits are divided in three; two fingerprints that differ in
  two bits agree in at least one third, so each fingerprint is put under three
  upper nodes, each a masked bit pattern.  A node that holds more than ``SPLIT``
  fingerprints is factored again: its free bits are divided in three and the
  pattern grows.  Free bits shrink by a third each time (64, 43, 29, 20, 14, 10),
  so a node that can no longer be split holds at most 2**10 fingerprints.  No
  bucket is capped and none is unbounded.
* *Within an upper node* the fingerprints are sorted by Gray rank, so that neighbours
  share long patterns, and a tree is put over them: each tree node stands for ``FAN``
  nodes below it and has the mask and bits on which they all agree.  The tree is walked
  against itself from its root.  Going down, a pair of nodes adds the differences in the
  bits that only now are known on both sides to those of the pair above; pairs with more
  than two are pruned with all that stands below them, and at the leaves all 64 bits
  have been added.  Many upper nodes are walked at once.
* A node emits links as a spanning forest of its own near pairs, which loses no
  connection and grows with the number of fingerprints, not of pairs.

Components come from alternating large-star and small-star steps on the links.

Defined results: a null, empty or blank text has fingerprint zero and is linked
like any other; very long texts are hashed whole, in steps of bounded memory; a set bit
needs over half, so ties give 0.  Each row gets the component of its own text, so rows
that repeat an id and a text repeat the result, and rows that repeat an id with other
texts have each their text's.  Rows with null ids have a null component and name none.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.storage import bounded_batches, fresh, materialize, workspace
from memlake.llm.tokens import slices

Keep = Callable[[DataFrame, str], DataFrame]
SHINGLE, SEED, RADIUS = 3, 42, 2
SPLIT, FAN = 512, 4
#: Fingerprints that are walked at once, which bounds the pairs that a task holds.
AT_ONCE = 8192
#: Free bits below which an upper node is not split again.
LEAST_FREE = 10


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text: bit set where over half the shingles' hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    return majority(np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8))


def majority(hashes: np.ndarray) -> int:
    """64-bit SimHash of hashes, given as rows of eight bytes, highest first: zero where there are none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fp): the fingerprint as a signed 64-bit integer.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = np.fromiter((fingerprint(t) for t in part.column("text").to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return bounded_batches(rows).mapInArrow(run, "doc_id long, fp long")


# -- one upper node ----------------------------------------------------------------


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Position of each 64-bit pattern in the reflected Gray order."""
    rank = bits.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


def _tree(f: np.ndarray, heads: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels (bits, mask, first child) of one tree for each run of fingerprints, leaves first, roots last.

    A node has the bits on which all below it agree; ``heads`` are the runs' first places.
    """
    bits, mask = f, np.full(len(f), ~np.uint64(0))
    levels = [(bits, mask, np.arange(len(f) + 1))]
    while len(bits) > len(heads):
        nth = np.arange(len(bits)) - np.repeat(heads, np.diff(np.append(heads, len(bits))))
        first = np.flatnonzero(nth % FAN == 0)
        low, high = np.bitwise_and.reduceat(bits, first), np.bitwise_or.reduceat(bits, first)
        mask = np.bitwise_and.reduceat(mask, first) & ~(low ^ high)
        bits = low & mask
        heads = np.searchsorted(first, heads)
        levels.append((bits, mask, np.append(first, len(nth))))
    return levels


def near_pairs(fps: np.ndarray, run: np.ndarray | None = None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of distinct fingerprints within the radius, of the same run (upper node) each."""
    run = np.zeros(len(fps), np.int64) if run is None else run
    order = np.lexsort((gray_rank(fps), run))
    levels = _tree(fps[order], np.flatnonzero(np.diff(run[order], prepend=-1)))
    u = v = np.arange(len(levels[-1][0]))
    apart = np.zeros(len(u), np.int64)
    for (bits, mask, _), (_, above, first) in zip(levels[-2::-1], levels[:0:-1], strict=True):
        many, other = np.diff(first)[u], np.diff(first)[v]
        pair = np.repeat(np.arange(len(u)), many * other)
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(many * other) - many * other, many * other)
        known = (above[u] & above[v])[pair]
        u, v = first[u][pair] + nth // other[pair], first[v][pair] + nth % other[pair]
        once = u <= v
        u, v, pair, known = u[once], v[once], pair[once], known[once]
        apart = apart[pair] + np.bitwise_count((bits[u] ^ bits[v]) & mask[u] & mask[v] & ~known)
        close = apart <= radius
        u, v, apart = u[close], v[close], apart[close]
    return order[u[u < v]], order[v[u < v]]


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index of each index's connected part, by repeated minimum and jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _third(free: int, part: int) -> int:
    """The part-th third of the set bits of ``free``, from the highest bit down."""
    at = [b for b in range(63, -1, -1) if free >> b & 1]
    size = -(-len(at) // 3)
    return sum(1 << b for b in at[part * size : (part + 1) * size])


def upper_masks(depth: int) -> list[tuple[str, int]]:
    """Paths (one digit a level) and masks of all upper nodes' shapes of a depth."""
    shapes = [("", 0)]
    for _ in range(depth):
        shapes = [(path + str(k), mask | _third(~mask & (1 << 64) - 1, k)) for path, mask in shapes for k in range(3)]
    return shapes


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, keep: Keep = materialize) -> DataFrame:
    """Spanning links (a, b) between ids of nodes (id, fp) with distinct, near fingerprints."""
    out, todo, depth = None, nodes.select("id", "fp"), 0
    shapes = [("", 0)]
    while True:
        # Deal the fingerprints under the nodes of this level; ``path`` names the mask.
        nexts = {}
        for path, mask in shapes:
            free = ~mask & (1 << 64) - 1
            nexts[path] = [(path + str(k), mask | _third(free, k)) for k in range(3)]
        if depth == 0:
            dealt = todo.select("id", "fp", F.explode(_children(nexts[""])).alias("c"))
        else:
            choice = F.create_map(*(x for p, cs in nexts.items() for x in (F.lit(p), _children(cs))))
            dealt = todo.select("id", "fp", F.explode(F.element_at(choice, F.col("path"))).alias("c"))
        dealt = dealt.select("id", "fp", F.col("c.path").alias("path"), F.col("fp").bitwiseAND(F.col("c.mask")).alias("bits"))
        shapes = [c for cs in nexts.values() for c in cs]
        depth += 1
        free_bits = min(bin(~m & (1 << 64) - 1).count("1") for _, m in shapes)
        last = free_bits <= LEAST_FREE
        dealt = keep(dealt, "simhash-nodes")
        sizes = dealt.groupBy("path", "bits").agg(F.count(F.lit(1)).alias("n"))
        if last:
            small, large = sizes.where("n > 1"), None
        else:
            large = keep(sizes.where(F.col("n") > SPLIT), "simhash-large")
            small = sizes.where((F.col("n") > 1) & (F.col("n") <= SPLIT))
        found = _search(dealt.join(small.select("path", "bits"), ["path", "bits"], "left_semi"))
        out = found if out is None else out.unionByName(found)
        if large is None or large.isEmpty():
            return out
        todo = dealt.join(large.select("path", "bits"), ["path", "bits"], "left_semi").select("id", "fp", "path")


def _children(children: list[tuple[str, int]]):
    return F.array(*(F.struct(F.lit(p).alias("path"), F.lit(_signed(m)).alias("mask")) for p, m in children))


def _search(dealt: DataFrame) -> DataFrame:
    """Links within each upper node of bounded size; nodes stream through a task in order."""

    def walk(table: pa.Table) -> pa.RecordBatch:
        path = np.asarray(table.column("path").combine_chunks().dictionary_encode().indices)
        bits, ids, fps = (table.column(c).to_numpy() for c in ("bits", "id", "fp"))
        node = np.cumsum(np.append(False, (path[1:] != path[:-1]) | (bits[1:] != bits[:-1])))
        left, right = near_pairs(fps.view(np.uint64), node)
        root = forest(len(ids), left, right)
        child = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[root[child]])], names=["a", "b"])

    return by_node(dealt.select("path", "bits", "id", "fp"), ["path", "bits"], walk, "a long, b long")


def by_node(rows: DataFrame, node: list[str], walk: Callable[[pa.Table], pa.RecordBatch], schema: str, at_once: int = AT_ONCE) -> DataFrame:
    """What ``walk`` makes of the rows of whole nodes, about ``at_once`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = pa.Table.from_batches([batch.slice(at, at_once)])
                held = part if held is None else pa.concat_tables([held, part])
                # The last node may go on in the next part.
                same = np.logical_and.reduce([np.asarray(pc.equal(held.column(c), held.column(c)[-1])) for c in node])
                whole = len(same) - int(same[::-1].argmin()) if not same.all() else 0
                if whole:
                    yield walk(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield walk(held)

    return rows.repartition(*node).sortWithinPartitions(*node).mapInArrow(run, schema)


# -- components --------------------------------------------------------------------


def components(edges: DataFrame, keep: Keep = materialize) -> DataFrame:
    """Rows (id, component) of all ids in links: the smallest id reachable.

    Alternates large-star and small-star steps until the links are stars around the
    smallest ids.  Each step is a combined minimum by id and a join that AQE may
    split, so one id with very many links is no single task's work.  Each round's
    links are written to the shared folder.
    """

    def stars(both: DataFrame, keep) -> DataFrame:
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(low, "u").where(keep)

    edges = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "simhash-links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stars(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        pairs = large
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        small = pairs.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = keep(small, "simhash-links")
        now = edges.agg(F.count(F.lit(1)), F.sum("v"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
        before = now


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of ``df``.

    ``component_id`` is the smallest id reachable over links, the id itself included.
    """
    prints = materialize(fingerprints(df, key, text), "simhash-fingerprints")
    with workspace(df.sparkSession, "simhash") as keep:
        nodes = keep(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
        found = components(links(nodes, keep), keep)
        named = materialize(nodes.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id")), "simhash-components")
    return prints.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", near: Callable[..., DataFrame] = near_duplicates) -> DataFrame:
    """The rows of ``df`` that stand for their component by ``near``: those with its smallest id.

    Of rows that repeat an id one is kept; rows with null ids, which cannot be told
    apart, are all kept.  Only repeated ids cost a grouping of whole rows.
    """
    (kept,) = fresh(df, "kept_id")
    found = near(df, key, text)
    keep = materialize(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(kept)).agg(F.count(F.lit(1)).alias("copies")), "simhash-kept")
    once, twice = keep.where("copies = 1").select(kept), keep.where("copies > 1").select(kept)
    # The kept ids grow with the documents, so they are never broadcast, at any size.
    rows = df.join(once.hint("shuffle_hash"), F.col(key) == F.col(kept), "left_semi")
    if not twice.isEmpty():
        rows = rows.unionByName(df.join(twice, F.col(key) == F.col(kept), "left_semi").dropDuplicates([key]))
    return rows.unionByName(df.where(F.col(key).isNull()))
