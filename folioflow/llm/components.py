"""Connected components of a table of links, by alternating star contractions.

First every task makes a forest of the links that it holds, a bounded number at a time: each node is linked to the
smallest one that it reaches there, so the links become at most as many as the nodes. Then rounds follow.
Each round turns every node's larger neighbours to its smallest one (large star) and then every
node's smaller neighbours to the smallest (small star); links become stars whose centres are the
components' smallest ids, in a number of rounds that grows with the logarithm of the largest
component. Smallest neighbours are aggregated before the shuffle, a hot centre only meets its own
row in the join, and each round is written to the shared folder, so lost executors cost a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._store import remove, tidy, work_dir, written
from ._text import settle

#: Links of which a task makes a forest at once.
FOREST = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some links that aren't the smallest of their component there, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _forests(batches):
    """u, v of forests, and the number of the task's and of the forest that a link is in."""
    held, n, part = [], 0, TaskContext.get().partitionId() << 32

    def out():
        u, v = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), part, np.int64))], names=["u", "v", "part"])

    for batch in batches:
        for lo in range(0, batch.num_rows, FOREST):
            piece = batch.slice(lo, FOREST)
            held.append((piece.column(0).to_numpy(), piece.column(1).to_numpy()))
            n += piece.num_rows
            if n >= FOREST:
                yield out()
                held, n, part = [], 0, part + 1
    if held:
        yield out()
    settle()


def _step(edges: DataFrame, path: str, *more) -> tuple[DataFrame, tuple]:
    """The written links, and their number, the sum of their hashes and what else is asked for, seen while they are written."""
    seen = Observation()
    asked = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))} | {f"m{k}": c for k, c in enumerate(more)}
    out = written(edges.observe(seen, *(c.alias(n) for n, c in asked.items())), path)
    return out, tuple(seen.get[n] for n in asked)


def components(edges: DataFrame) -> DataFrame:
    """edges: columns u, v (longs). Returns node, component (the smallest id reachable), for nodes with a link to another."""
    spark = edges.sparkSession
    path = work_dir(spark, "components")
    links = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, (*state, first, last) = _step(links.hint("rebalance").mapInArrow(_forests, "u long, v long, part long"), f"{path}/0", F.min("part"), F.max("part"))
    now, state = now.select("u", "v"), tuple(state)
    k = 0
    while state[0] and first != last:  # one forest of all links is the result
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        k += 1
        before = state
        now, state = _step(small.distinct(), f"{path}/{k}")
        remove(spark, f"{path}/{k - 1}")
        if state == before:
            break
    tidy(spark)
    tops = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
