"""Mixing by Pfair scheduling, and exact top-k."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import mixing, topk


def test_schedule():
    r = random.Random(1)
    for _ in range(40):
        sizes = {f"s{k}": r.randint(0, 400) for k in range(r.randint(1, 6))}
        weights = {s: r.choice([0, 0.5, 1, 3, 7.3]) for s in sizes}
        phases, slots = mixing.plan(sizes, weights, units=97), []
        for s, n in sizes.items():
            slot, release, due = mixing.place(phases, s, np.arange(n))
            assert (np.diff(slot) > 0).all() and ((release <= slot) & (slot < due)).all()
            assert mixing.deviation(phases, s) < 1
            slots += slot.tolist()
        assert sorted(slots) == list(range(sum(sizes.values())))


@pytest.mark.parametrize(("sizes", "weights"), [
    ({f"s{k}": 40 if k == 0 else 700 for k in range(20)}, {"s0": 4.0, "s1": 2.0, "s2": 2.0}),  # after s0 the shares are 1/21 and 2/21
    ({f"s{k}": 5 for k in range(300)}, {"s0": 40.0, "s1": 7.0}),
    ({"a": 300, "b": 200, "c": 90}, {"a": 0.3333333333333333, "b": 0.123456789012345, "c": 1e-7}),
])
def test_schedule_keeps_the_given_weights(sizes, weights):
    phases, slots = mixing.plan(sizes, weights), []
    given = {s: weights.get(s, 1.0) for s in sizes}
    for s, n in sizes.items():
        slot, release, due = mixing.place(phases, s, np.arange(n))
        assert (np.diff(slot) > 0).all() and ((release <= slot) & (slot < due)).all()
        slots += slot.tolist()
    assert sorted(slots) == list(range(sum(sizes.values())))
    for s in list(sizes)[:3]:
        assert mixing.deviation(phases, s, given) < 1


@pytest.mark.parametrize(("sizes", "weights"), [
    ({f"src{k}": 20_000 for k in range(20)}, {"src0": 4.0, "src1": 2.0, "src2": 2.0}),
    ({f"src{k}": 2000 + 7 * k for k in range(23)}, {"src0": 4.0, "src1": 2.0, "src2": 2.0}),
    ({f"s{k}": 30 if k else 3000 for k in range(1500)}, {"s0": 1000.0}),
])
def test_large_mixtures_stay_within_a_block(sizes, weights):
    """At every slot of every phase each source has its target share to within less than one block."""
    phases = mixing.plan(sizes, weights)
    assert sum(p.slots for p in phases) == sum(sizes.values())
    given = {s: Fraction(str(weights.get(s, 1.0))) for s in sizes}
    for p in phases:
        total = sum(given[s] for s in p.units)
        for s in p.units:
            share = given[s] / total
            n, d = share.numerator, share.denominator
            slots = p.slot(s, np.arange(p.first[s], p.first[s] + p.taken(s, p.slots))) - p.start
            taken = np.searchsorted(slots, np.arange(p.slots + 1))
            assert (np.abs(n * np.arange(p.slots + 1) - d * taken) < d).all()


@pytest.mark.parametrize("bits", [10, 1])
def test_mix(spark, monkeypatch, bits):
    monkeypatch.setattr(mixing, "GROUP_BITS", bits)
    sources = ["a"] * 700 + ["b"] * 100 + [None] * 50
    rows = [(k, f"t{k}", s, 0, 9) for k, s in enumerate(sources)] + [(None, None, "a", 0, 9), (3, "t3", "a", 0, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, before int, mix_slot int").repartition(4)
    out = mixing.mix(df, {"a": 2.0}, block_rows=10, cell_rows=64).collect()
    assert len(out) == len(rows) and out[0].__fields__ == ["doc_id", "text", "source", "before", *mixing.NEW]
    blocks = {}
    for r in out:
        blocks.setdefault((r["source"], r["mix_block"]), []).append(r)
    slots = sorted(b[0]["mix_slot"] for b in blocks.values())
    assert slots == list(range(len(blocks))) == list(range(71 + 10 + 5))
    assert all(len({x["mix_slot"] for x in b}) == 1 and b[0]["mix_release"] <= b[0]["mix_slot"] < b[0]["mix_due"] for b in blocks.values())
    assert sorted(len(b) for b in blocks.values())[1:] == [10] * 85 and min(map(len, blocks.values())) == 2
    # while all run, "a" gets half of the slots to within a block
    first = [s for s, _ in sorted(blocks, key=lambda b: blocks[b][0]["mix_slot"])][:16]
    assert all(abs(first[:n].count("a") - n / 2) < 1 for n in range(17))
    assert mixing.mix(df.limit(0)).count() == 0


def brute(rows, k):
    out = []
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good = sorted(set((i, tuple(v)) for i, v in good))
    for q, v in {i: v for i, v in reversed(good)}.items():
        if q % 10 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 32768])
def test_top_k(spark, block):
    r = np.random.default_rng(2)
    rows = [(k, [float(x) for x in r.normal(0, 0.1, 8).astype(np.float32)]) for k in range(150)]
    rows += [(160, rows[3][1]), (161, rows[3][1]), (170, None), (171, [None] * 8), (172, [float("nan")] * 8), (173, [float("inf")] + [0.0] * 7), (None, rows[0][1]), (180, [0.0] * 8), (190, [1.0, 2.0]), (191, [3.0, 1.0]), (200, []), rows[5]]
    df = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, embedding array<float>, score string")
    v = topk.integer_vectors(df)
    got = topk.top_k(v, v.where(F.col("vec_id") % 10 == 0), 10, block=block).collect()
    assert sorted(map(tuple, got)) == brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 10)


def test_block_stops_on_proof_only(tmp_path):
    r = np.random.default_rng(0)
    for t in range(120):
        n = int(r.integers(1, 400))
        v, ids, q = r.integers(-600, 600, (n, 16)), r.permutation(n * 2)[:n], r.integers(-600, 600, (5, 16))
        if t % 3 == 0:
            v, q = v // 200, q // 200
        if t % 7 == 0:
            v[:, 3], q[0] = 0, 0
        block = topk.Block.of(ids, v)
        block.save(f"file://{tmp_path}/b")
        block = topk.Block.load(f"file://{tmp_path}/b")
        for query, own in zip(q, r.choice(ids, 5), strict=True):
            found, score = block.top(query, 10, own)
            want = sorted((-int(a @ query), int(i)) for i, a in zip(ids, v, strict=True) if i != own)[:10]
            assert [(-a, b) for a, b in want] == [(int(a), int(b)) for a, b in zip(score, found, strict=True)]
            if len(want) > 3:  # with a score to reach, whatever reaches it is found
                least = -want[3][0]
                found, score = block.top(query, 10, own, float(least))
                assert [(-a, b) for a, b in want if -a >= least] == [(int(a), int(b)) for a, b in zip(score, found, strict=True) if a >= least]


def test_postings_are_in_order_of_impact():
    r = np.random.default_rng(5)
    v = r.integers(-5000, 5000, (300, 6))
    block = topk.Block.of(np.arange(300), v)
    for d in range(6):
        lo, hi = block.cuts[2 * topk.LEVELS * d], block.cuts[2 * topk.LEVELS * (d + 1)]
        posts = block.posts[lo:hi]
        assert sorted(posts.tolist()) == list(range(300))
        level = (np.abs(v[posts, d]) // block.step[d]).astype(int)
        assert (np.diff(level) <= 0).all()


def test_scores_beyond_64_bits(spark):
    big = [1e30, -1e30, 3.0]
    df = spark.createDataFrame([(0, big), (1, big), (2, [-1e30, 1e30, 3.0]), (3, [0.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    v = topk.integer_vectors(df)
    got = sorted(map(tuple, topk.top_k(v, v.where("vec_id = 0"), 10).collect()))
    assert got == [(0, 1, 1, (1 << 63) - 1), (0, 2, 3, 3 * 1024 * 1024), (0, 3, 2, -(1 << 63))]


def test_empty(spark):
    df = topk.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert topk.top_k(df, df).count() == 0
