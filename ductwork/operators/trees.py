"""Hierarchies as parent tables: sums below a node, checks, runs, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductwork.storage import stored


def subtree_sums(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """node, total: the sum of value over the node and everything below it. edges: node, parent (null at a root), value.

    Pointer doubling: each round adds to a node what the nodes that point to it have gathered, then doubles the pointers, so a
    tree of depth d takes log2(d) rounds, each a join on the pointer."""
    state = stored(edges.select("node", F.col("parent").alias("up"), F.col("value").alias("total")))
    for _ in range(rounds):
        if state.where("up is not null").limit(1).count() == 0:
            return state.select("node", "total")
        gained = state.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("total").alias("more"))
        hop = state.select(F.col("node").alias("up"), F.col("up").alias("next"))
        state = stored(state.join(gained, "node", "left").join(hop, "up", "left").select("node", F.col("next").alias("up"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")), state)
    raise ValueError("the parents form a cycle")


def tree_faults(edges: DataFrame, root: int) -> DataFrame:
    """Edges that a tree can't have: fault, node, n. edges: node, parent.

    duplicate: an edge given twice; parents: several parents; root: an edge into the root; orphan: a parent that no edge reaches."""
    pairs = edges.groupBy("node", "parent").agg(F.count(F.lit(1)).alias("n"))
    duplicate = pairs.where("n > 1").select(F.lit("duplicate").alias("fault"), "node", "n")
    parents = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("parents").alias("fault"), "node", "n")
    into_root = pairs.where(F.col("node") == root).groupBy("node").agg(F.count(F.lit(1)).alias("n")).select(F.lit("root").alias("fault"), "node", "n")
    known = pairs.select(F.col("node").alias("parent")).distinct()
    orphan = pairs.where(F.col("parent") != root).join(known, "parent", "left_anti").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphan").alias("fault"), "node", "n")
    return duplicate.union(parents).union(into_root).union(orphan)


def below(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node: every node at or below the nodes of start. edges: node, parent. Pointers double, so a tree of depth d takes log2(d) rounds; cycles reach nothing but themselves."""
    state = stored(edges.join(start.select("node", F.lit(True).alias("hit")), "node", "left").select("node", F.col("parent").alias("up"), F.coalesce("hit", F.lit(False)).alias("hit")))
    steps, size = 1, state.count()
    while steps < 2 * size and state.where("not hit and up is not null").limit(1).count():
        hop = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("hit").alias("above"))
        state = stored(state.join(hop, "up", "left").select("node", F.when(~F.col("hit"), F.col("next")).alias("up"), (F.col("hit") | F.coalesce("above", F.lit(False))).alias("hit")), state)
        steps *= 2
    return state.where("hit").select("node")


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """node, cycle (its smallest node) for every node on a cycle of parent pointers. edges: node, parent, one row a node.

    After 2^k >= n doubled steps a pointer still set stands on a cycle, and every node of a cycle is some pointer's target."""
    state = stored(edges.where("parent is not null").select("node", F.col("parent").alias("up")))
    steps, size = 1, state.count()
    while steps < size and state.limit(1).count():
        hop = state.select(F.col("node").alias("up"), F.col("up").alias("next"))
        state, steps = stored(state.join(hop, "up").select("node", F.col("next").alias("up")), state), 2 * steps
    on = stored(state.select(F.col("up").alias("node")).distinct())
    links = edges.join(on, "node").select(F.col("node").alias("a"), F.col("parent").alias("b"))
    loops = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("cycle"))
    return components(links).select("node", F.col("comp").alias("cycle")).unionByName(loops)


def runs_to_root(edges: DataFrame, rounds: int = 500) -> DataFrame:
    """node, run: the length from a node towards the root over edges of the same kind as its own. edges: node, parent, kind, length.

    Pointer doubling within a kind: a pointer stops where the kind changes."""
    kinds = edges.select(F.col("node").alias("parent"), F.col("kind").alias("above"))
    start = edges.join(kinds, "parent", "left").select("node", F.when(F.col("kind") == F.col("above"), F.col("parent")).alias("up"), F.col("length").alias("run"))
    state = stored(start)
    for _ in range(rounds):
        if state.where("up is not null").limit(1).count() == 0:
            return state.select("node", "run")
        hop = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("run").alias("more"))
        state = stored(state.join(hop, "up", "left").select("node", F.col("next").alias("up"), (F.col("run") + F.coalesce("more", F.lit(0))).alias("run")), state)
    raise ValueError("the parents form a cycle")


def rollup_tree(levels: list[DataFrame]) -> DataFrame:
    """One table of sums per level, each with level, node, total and n."""
    out = levels[0]
    for df in levels[1:]:
        out = out.unionByName(df)
    return out


def local_stars(edges: DataFrame) -> DataFrame:
    """The edges (hi, lo) of each partition as one star for each of its own components: far fewer, with the same reach.

    Edges become stars as they come, ONE_TASK or twice the stars so far at a time, so a task holds its nodes and never all its edges."""

    def stars(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
        a, b = at[: len(at) // 2], at[len(at) // 2 :]
        least = np.arange(len(names))
        while True:
            before = least.copy()
            low = np.minimum(least[a], least[b])
            for side in (a, b):
                np.minimum.at(least, side, low)
                np.minimum.at(least, before[side], low)  # a label's own node follows
            while (least != least[least]).any():
                least = least[least]
            if (least == before).all():
                break
        moved = np.flatnonzero(least != np.arange(len(names)))
        return names[moved], names[least[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, kept, schema = [], 0, 0, None
        for batch in batches:
            schema = batch.schema
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            waiting += batch.num_rows
            if waiting >= max(ONE_TASK, 2 * kept):
                held = [stars(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                waiting, kept = 0, len(held[0][0])
        if held:
            found = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, schema, strict=True)], schema=schema)

    return edges.mapInArrow(run, edges.schema)


#: Edges that one task turns into stars at once: 16 bytes each, about 100 MB with all that the kernel holds.
ONE_TASK = 1 << 20


def components(edges: DataFrame, rounds: int = 100, one_task: int = ONE_TASK) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of the edges (a, b).

    Each partition first reduces its edges to stars. If few are left (counted), one task makes stars of them, which is the result. Else, by
    alternating stars, every node hands its larger neighbours, then its smaller ones, on to the smallest node it knows, until
    each component is one star around its smallest node. Paths shrink by halves, edges never grow in number, and a hub's
    smallest neighbour is found by pre-aggregation. Every round is kept in the shared folder until the next one stands."""
    done = lambda star: star.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(star.select("lo", "lo").distinct())
    star = stored(local_stars(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo")))
    if star.count() <= one_task:
        return done(stored(local_stars(star.coalesce(1)), star))
    star = stored(star.distinct(), star)
    seen = fingerprint(star)
    for _ in range(rounds):
        both = star.union(star.select("lo", "hi")).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("hi"), F.col("least").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        joined = large.join(least, "hi")
        star = stored(joined.select("hi", F.col("least").alias("lo")).union(joined.select("lo", "least").where("lo <> least")).distinct(), star)
        before, seen = seen, fingerprint(star)
        if seen == before:
            return done(star)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def fingerprint(edges: DataFrame) -> tuple:
    """Number of distinct rows and sum of their hashes: equal sets have equal ones."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)"))).first())
