"""Which pairs near copies compare: those of SimHash first, and no dissimilar ones of a large cell."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from breakline.llm import near_copies as N
from breakline.llm import simhash


def test_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (0, 1, 30, 500, 5000):
        a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate((b[: n // 3], a[n // 3 :])))
        x, y = (np.frombuffer(N.parities(s), np.uint64) for s in (a, b))
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_a_large_cell_gives_no_dissimilar_pairs():
    """300 sets that share a half, and one similar pair."""
    rng = np.random.default_rng(2)
    half = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate((half, rng.integers(0, 1 << 62, 60).astype(np.uint64)))) for _ in range(300)]
    sets.append(np.unique(np.concatenate((sets[0][1:], half[:1] + np.uint64(1)))))
    n, who = pa.array([len(s) for s in sets], pa.int64()), pa.array(range(len(sets)), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array([7] * len(sets), pa.int64()), who, n, who, pa.array(map(N.parities, sets), pa.binary())], names=["g", "fp", "n", "root", "bits"])
    order = np.argsort(n.to_numpy(), kind="stable")
    got = [(a, b) for x in N._across(iter([batch.take(pa.array(order))])) for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    assert (0, 300) in got and len(got) < 50


def test_simhash_gives_the_first_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(9999)}" for _ in range(900)]
    texts = [base, [*base, "end"], [f"v{rng.randrange(9999)}" for _ in range(300)]]
    assert (simhash.fingerprint(" ".join(texts[0]).encode()) ^ simhash.fingerprint(" ".join(texts[1]).encode())).bit_count() <= simhash.BITS
    compared = []
    verified = N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *more: compared.append(pairs.count()) or verified(pairs, *more))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.grouped(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2} and compared[:2] == [1, 0]
