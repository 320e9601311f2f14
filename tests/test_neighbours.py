"""Chosen neighbours against all pairs, and how many pairs are made where breakends are dense."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from breakline.operators import links
from breakline.operators.neighbours import chosen

SCHEMA = "id long, sample int, ref int, dir string, start int, end int, qual double, event long, mate_start int, mate_end int"


def odd_rows(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randrange(-300, 25_000) if i % 3 else rng.randrange(200)
        long = rng.choice([0, 0, 2, 40, 3000, 15_000])
        mate = start + rng.randrange(400)
        qual = rng.choice([None, float("nan"), 1.0, 2.0, 2.0, 3.0, float(i)])
        out.append((i, rng.choice([1, 2, None]), rng.randrange(2), rng.choice(["+", "-", None]) if i % 5 == 0 else "+-"[i % 2], start, start + long, qual, rng.choice([None, i % 7, i]), mate, mate + 5))
    return out


def top(q):
    return (q is not None, q is not None and q != q, 0 if q is None or q != q else q)


def all_pairs(rows, gap, event=False, mates=False):
    for q in rows:
        for s in rows:
            if None in (q[1], q[3], s[3]) or q[1:3] != s[1:3] or q[3] == s[3] or q[4] - gap - 1 > s[5] or s[4] > q[5] + gap + 1:
                continue
            if event and (None in (q[7], s[7]) or q[7] == s[7]) or mates and (q[8] - gap - 1 > s[9] or s[8] > q[9] + gap + 1):
                continue
            yield q, s


def choose(pairs, key, side):
    best = {}
    for p in pairs:
        best[p[side][0]] = max(best.get(p[side][0], key(p)), key(p))
    return [p for p in pairs if key(p) == best[p[side][0]]]


def both_best(pairs):
    return choose(choose(pairs, lambda p: top(p[1][6]), 0), lambda p: top(p[0][6]), 1)


def ids(pairs):
    return sorted((q[0], s[0]) for q, s in pairs if q[0] < s[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_choices_equal_those_among_all_pairs(spark, seed):
    rows = odd_rows(260, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = lambda d: sorted(tuple(r) for r in d.collect())
    best = both_best(list(all_pairs(rows, 35)))
    there = {(q[0], s[0]) for q, s in best}
    assert got(links.breakend_insertions(df, 35)) == [p for p in ids(best) if p[::-1] in there]
    assert got(links.simple_inversions(df, 35)) == ids(both_best(list(all_pairs(rows, 35, mates=True))))
    left, right = [r for r in rows if r[0] % 2], [r for r in rows if r[0] % 3]
    want = both_best([(q, s) for q, s in all_pairs(rows, 35) if q[0] % 2 and s[0] % 3])
    assert got(links.breakpoint_insertions(df.where("id % 2 = 1"), df.where("id % 3 > 0"), 35)) == sorted((q[0], s[0]) for q, s in want)
    pairs = list(all_pairs(rows, 35, event=True))
    assert got(links.linked_neighbours(df, 35, "best")) == ids(both_best(pairs))
    near = lambda p: -abs(p[0][4] - p[1][4])
    closest = set(ids(choose(pairs, near, 0))) & set(ids(choose(pairs, near, 1)))
    assert got(links.linked_neighbours(df, 35, "closest")) == sorted(closest)
    alone = [p for p in pairs if sum(x[0][0] == p[0][0] for x in pairs) == 1 and sum(x[1][0] == p[1][0] for x in pairs) == 1]
    assert got(links.linked_neighbours(df, 35)) == ids(alone)


def test_dense_places_cost_some_pairs_a_breakend(spark):
    """4000 breakends within one gap have 8 million pairs."""
    n = 4000
    df = spark.range(n).select("id", F.lit(1).alias("sample"), F.lit(1).alias("ref"), F.when(F.col("id") % 2 == 0, "+").otherwise("-").alias("dir"), (F.col("id") * 7 % 1000).alias("start"), (F.col("id") * 7 % 1000).alias("end"), (F.col("id") * 37 % 4001).alias("qual"), F.col("id").alias("event"))
    for how in ("best", "two", "closest"):
        got = chosen(df, df, 1000, how)
        assert n <= got.count() <= 8 * n and got.select("q_id").distinct().count() == n
