"""Mixing sources to target weights by Pfair scheduling.

A source's documents are ordered by a hash of their ids and cut into blocks. With weight w, the k-th
block of a source (from 0) is released at floor(k / w) and due at ceil((k + 1) / w); each slot takes the
released block with the earliest deadline. On one "processor" (the output sequence) that meets every
deadline, so after any number of slots each source has got its weight's share to within less than one
block. Weights count as they are written (7.3 is 73/10) and are scaled to the smallest whole numbers of the
same proportions; the schedule repeats after as many slots as these sum to. The driver works out one period,
or the slots of the phase where these are fewer, and every block finds its slot by arithmetic. Periods of
usual weights are short and do not depend on the data; weights of many digits have long ones, for which the
driver does work, and sends out 8 bytes, for each block. When a source runs out, the others' weights are scaled
up and a new phase begins; its first slot continues the sequence. There are at most as many phases as sources.

The place of a document within its source is found without sorting a source in one task: ids hash into
cells, cell sizes are counted, running sums over groups of cells and inside each group give each cell's first place, and
only rows of one cell are ranked together. The number of cells grows with the largest source.

Defined results: a null source is a source of its own, named ""; a source without a given weight gets
``default``; sources with a weight of 0 follow at the end in order of their names, as phases of their own;
documents are ordered by a hash of their whole rows, so null and repeated ids are dealt like all others;
rows that are equal in all columns are alike, whichever of their places they take; an
empty table gives an empty result; all other columns are passed on, but for such with the new ones' names.
"""

from __future__ import annotations

import heapq
import math
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._store import work_dir, written
from ._text import map_arrow

BLOCK_ROWS = 16
#: Columns that the operator adds; columns of the input with these names are replaced.
NEW = ("mix_block", "mix_slot", "mix_release", "mix_due")
#: Rows that one ranking cell holds on average, and bits of the number of cells whose sizes are summed up together.
CELL_ROWS, GROUP_BITS = 500, 10


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The smallest whole numbers in the proportions of positive weights, these read as decimals."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*out.values())
    return {s: n // common for s, n in out.items()}


def shares(weights: dict[str, float], units: int) -> dict[str, int]:
    """Weights rounded to whole units that sum to ``units``, each at least 1, by largest remainders."""
    total = sum(weights.values())
    units = max(units, len(weights))
    exact = {s: max(1.0, w / total * units) for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (out[s] - exact[s], s))
    k = 0
    while sum(out.values()) < units:
        out[order[k % len(order)]] += 1
        k += 1
    while sum(out.values()) > units:
        big = max(out, key=lambda s: (out[s], s))
        out[big] -= 1
    return out


def period(units: dict[str, int]):
    """One period of the schedule, slot by slot: the source and its block number within the period."""
    total = sum(units.values())
    release = lambda s, k: k * total // units[s]
    due = lambda s, k: -(-(k + 1) * total // units[s])
    waiting = [(0, s, 0) for s in sorted(units)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, k), s, k))
        d, s, k = heapq.heappop(ready)
        assert d > t
        yield s, k
        if k + 1 < units[s]:
            heapq.heappush(waiting, (release(s, k + 1), s, k + 1))


class Phase:
    """A stretch of the sequence with fixed sources and weights, up to the last block of one of them."""

    def __init__(self, start: int, first: dict[str, int], units: dict[str, int], left: dict[str, int]):
        self.start, self.first, self.units, self.slots = start, first, units, 0
        self.total = sum(units.values())
        at: dict[str, list[int]] = {s: [] for s in units}
        for t, (s, k) in enumerate(period(units)):
            at[s].append(t)
            if k + 1 == left[s]:
                self.slots = t + 1
                break
        self.at = {s: np.array(x, np.int64) for s, x in at.items()}
        if not self.slots:  # no source ends in the first period
            self.slots = min(int(self.slot(s, np.array([first[s] + left[s] - 1]))[0]) for s in units) - start + 1

    def taken(self, source: str, slots: int) -> int:
        """Blocks of a source among the phase's first slots."""
        whole, rest = divmod(slots, self.total)
        return whole * self.units[source] + int(np.searchsorted(self.at[source], rest))

    def slot(self, source: str, blocks: np.ndarray) -> np.ndarray:
        k = blocks - self.first[source]
        if self.units[source] > len(self.at[source]):  # the phase ends within the period
            return self.start + self.at[source][k]
        return self.start + k // self.units[source] * self.total + self.at[source][k % self.units[source]]


def plan(blocks: dict[str, int], weights: dict[str, float], default: float = 1.0, units: int | None = None) -> list[Phase]:
    """Phases that place all blocks of all sources, by the weights or, if asked, these rounded to 1/units."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    weight = {s: max(0.0, float(weights.get(s, default))) for s in left}
    phases, start = [], 0
    while left:
        active = {s: weight[s] for s in left if weight[s] > 0} or {min(left): 1.0}
        phase = Phase(start, {s: done[s] for s in active}, shares(active, units) if units else whole(active), left)
        for s in active:
            n = phase.taken(s, phase.slots)
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
        phases.append(phase)
        start += phase.slots
    return phases


def place(phases: list[Phase], source: str, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot, release and deadline of a source's blocks."""
    slot, release, due = (np.full(len(blocks), -1, np.int64) for _ in range(3))
    for p in phases:
        if source in p.first:
            lo = p.first[source]
            own = (blocks >= lo) & (blocks < lo + p.taken(source, p.slots))
            if own.any():
                k, n = blocks[own] - lo, p.units[source]
                if (int(k.max()) + 1) * p.total >= 1 << 63:
                    k = k.astype(object)
                slot[own] = p.slot(source, blocks[own])
                release[own] = p.start + k * p.total // n
                due[own] = p.start - (-(k + 1) * p.total // n)
    return slot, release, due


def deviation(phases: list[Phase], source: str, weights: dict[str, float] | None = None) -> Fraction:
    """Largest distance between a source's share, by the phases' or given weights, and its blocks, over all slots of its phases; for tests."""
    worst = Fraction(0)
    for p in phases:
        if source in p.first:
            given = p.units if weights is None else {s: Fraction(str(weights[s])) for s in p.units}
            share = Fraction(given[source]) / sum(given.values())
            for t in range(p.slots + 1):
                worst = max(worst, abs(share * t - p.taken(source, t)))
    return worst


def mix(df: DataFrame, weights: dict[str, float] | None = None, source: str = "source", default: float = 1.0, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS, key: Column | None = None) -> DataFrame:
    """All columns of ``df`` with mix_block, mix_slot (the block's place in the sequence), mix_release and mix_due.

    key: the 64-bit number, taken as unsigned, by which a source's documents are ordered; a hash of the whole row if not given."""
    spark, name = df.sparkSession, F.coalesce(F.col(source).cast("string"), F.lit(""))
    whole_row = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if re.search("map<|variant", df.schema[c].dataType.simpleString()) else F.col(c) for c in df.columns]
    key = F.xxhash64(F.lit("mix"), *whole_row) if key is None else key
    path = work_dir(spark, "mix")
    light = df.select(name.alias("s"), key.alias("h"))
    sizes = {r["s"]: r["n"] for r in light.groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each source
    bits = max(0, (max(sizes.values(), default=1) // cell_rows).bit_length())
    cell = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    counts = written(light.groupBy("s", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")), f"{path}/cells")
    # running sums in two levels, so that no task runs through all cells of a large source
    sofar = lambda *by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("group", F.shiftright("cell", GROUP_BITS))
    groups = counts.groupBy("s", "group").agg(F.sum("n").alias("n"))
    groups = groups.select("s", "group", sofar("s", order="group").alias("base"))
    counts = counts.select("s", "group", "cell", sofar("s", "group", order="cell").alias("inner")).join(groups, ["s", "group"])
    counts = counts.select("s", "cell", (F.col("base") + F.col("inner")).alias("before"))
    phases = plan({s: -(-n // block_rows) for s, n in sizes.items()}, weights or {}, default)
    sent = spark.sparkContext.broadcast(phases)  # of each at most a period
    # the whole row travels in one column, so no column of df can clash with these
    rows = df.select(F.struct(*df.columns).alias("row"), name.alias("s"), key.alias("h"))
    rows = rows.withColumn("cell", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("s", "cell").orderBy(F.col("h") < 0, "h")))
    rows = rows.join(counts, ["s", "cell"]).select("row", "s", F.floor((F.col("before") + F.col("rank") - 1) / block_rows).cast("long").alias("block"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), *(T.StructField(c, T.LongType()) for c in NEW)])

    def run(batch: pa.RecordBatch):
        blocks = batch.column(2).to_numpy()
        names = np.array(batch.column(1).to_pylist(), object)
        out = np.empty((3, len(blocks)), np.int64)
        for s in set(names):
            own = names == s
            out[:, own] = place(sent.value, s, blocks[own])
        return [batch.column(0), pa.array(blocks), *(pa.array(x) for x in out)]

    return map_arrow(rows, run, schema).select(*(F.col("row")[c].alias(c) for c in df.columns if c not in NEW), *NEW)
