"""Each breakend's chosen neighbours, without a table of all pairs.

Where breakends are dense, pairs grow with the square of the depth, and a choice among them (the best, the closest, the only
one) keeps about one of each. So breakends are dealt into bins, and a kernel finds in a bin what a choice can need: candidates are
tried in the order of the choice, and a breakend leaves at its first hit. What it gives is a subset of the pairs that holds all
chosen ones; windows over it then choose as they would over all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .intervals import bins

#: Pairs that the kernel tests at once, and the candidates it tries first.
_BLOCK, _STEP = 1 << 21, 64


def _best(who, others, test, level):
    """The pairs of each row's first level with a hit; ``others`` come in order of ``level``, equal quality has one level."""
    at = 0
    while len(who) and at < len(others):
        step = max(_STEP, _BLOCK // 4 // len(who))
        # levels are never cut
        end = int(np.searchsorted(level, level[min(at + step, len(others)) - 1], "right"))
        rest, rows = [], max(1, _BLOCK // (end - at))
        for k in range(0, len(who), rows):
            some = who[k : k + rows]
            ok = test(some[:, None], others[None, at:end])
            first = level[at + ok.argmax(axis=1)]
            x, y = np.nonzero(ok & (level[None, at:end] == first[:, None]))
            yield some[x], others[at + y]
            rest.append(some[~ok.any(axis=1)])
        who, at = np.concatenate(rest), end


def _two(who, others, test):
    """Two pairs of each row that has as many, else its one."""
    at, had = 0, np.zeros(len(who), np.int64)
    while len(who) and at < len(others):
        end = min(len(others), at + max(_STEP, _BLOCK // 4 // len(who)))
        rest, rows = [], max(1, _BLOCK // (end - at))
        for k in range(0, len(who), rows):
            some = who[k : k + rows]
            ok = test(some[:, None], others[None, at:end])
            n = np.cumsum(ok, axis=1) + had[k : k + rows, None]
            x, y = np.nonzero(ok & (n <= 2))
            yield some[x], others[at + y]
            rest.append((some[n[:, -1] < 2], n[n[:, -1] < 2, -1]))
        who, had, at = np.concatenate([r[0] for r in rest]), np.concatenate([r[1] for r in rest]), end


def _closest(who, others, test, start, reach):
    """The pairs of each row whose starts are closest; ``others`` come in order of start, ``reach`` is how far off one can be."""
    place, own = start[others], start[who]
    least = np.full(len(who), np.iinfo(np.int64).max)
    found = []
    middle = np.searchsorted(place, own)
    for step, begin in ((1, middle), (-1, middle - 1)):
        at, live = begin.copy(), np.arange(len(who))
        while len(live):
            live = live[(at[live] >= 0) & (at[live] < len(others))]
            d = np.abs(place[at[live]] - own[live])
            go = (d <= reach[who[live]]) & (d <= least[live])
            live, d = live[go], d[go]
            ok = test(who[live], others[at[live]])
            least[live[ok]] = d[ok]
            found.append((live[ok], at[live[ok]], d[ok]))
            at[live] += step
    x, y, d = (np.concatenate(c) for c in zip(*found, strict=True)) if found else np.zeros((3, 0), np.int64)
    ok = d == least[x]
    yield who[x[ok]], others[y[ok]]


def _cell(t: pa.Table, how: str, gap: int, width: int, differ: tuple[str, ...], meet: tuple[tuple[str, str], ...]) -> tuple[np.ndarray, np.ndarray]:
    col = {c: t[c].to_numpy() for c in {"_bin", "_q", "_s", "start", "end", *sum(meet, ())}}
    start, end, here = col["start"], col["end"], col["_bin"][0]
    low, high = start - gap - 1, end + gap + 1
    codes = [t[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in differ]

    def test(i, j):
        ok = (low[i] <= end[j]) & (start[j] <= high[i]) & (np.maximum(low[i], start[j]) // width == here)
        for c in codes:
            ok &= c[i] != c[j]
        for a, b in meet:
            ok &= (col[a][i] - gap - 1 <= col[b][j]) & (col[a][j] <= col[b][i] + gap + 1)
        return ok

    who, others = np.flatnonzero(col["_q"]), np.flatnonzero(col["_s"])
    if how == "best":
        q = t["qual"].combine_chunks()
        order = pc.sort_indices(q, sort_keys=[("", "descending")], null_placement="at_end").to_numpy()
        if pa.types.is_floating(q.type):  # as in Spark, NaN is the highest
            nan = pc.fill_null(pc.is_nan(q), False).to_numpy(zero_copy_only=False)[order]
            order = np.concatenate((order[nan], order[~nan]))
        level = np.empty(len(order), np.int64)
        kind = q.dictionary_encode("encode").indices.to_numpy()[order]
        level[order] = np.cumsum(np.concatenate(([0], kind[1:] != kind[:-1])))
        order = order[col["_s"][order]]
        got = _best(who, order, test, level[order])
    elif how == "two":
        got = _two(who, others, test)
    else:
        others = others[np.argsort(start[others], kind="stable")]
        # one to the left can begin before the gap and reach into it
        longest = int((end[others] - start[others]).max(initial=0))
        got = _closest(who, others, test, start, np.maximum(high - start, start - low + longest))
    got = list(got)
    return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 2


def chosen(left: DataFrame, right: DataFrame, gap: int, how: str, differ: tuple[str, ...] = ("dir",), meet: tuple[tuple[str, str], ...] = (), width: int = 10_000) -> DataFrame:
    """Of the pairs of ``links.near`` (q_id, s_id and both start and qual) those that a choice can need.

    ``how``: ``best`` (all of each q's highest s_qual), ``closest`` (all of its least distance of starts), ``two`` (one if it has
    one, else two or more); a bin tells for itself, so some others may be among them. ``differ`` names columns whose values must be
    known and differ, ``meet`` further intervals that must be as near as the first.
    """
    width = max(width, 2 * gap + 2)
    extra = list(dict.fromkeys([*differ, *sum(meet, ())]))
    places = {"start", "end", *sum(meet, ())}

    def rows(df: DataFrame) -> DataFrame:
        known = df.select("ref", "sample", "id", "qual", *[F.col(c).cast("long").alias(c) if c in places else F.col(c) for c in ("start", "end", *extra)])
        return known.na.drop(subset=["ref", "sample", "start", "end", *extra])

    def dealt(df: DataFrame, q: Column, s: Column, pad: int) -> DataFrame:
        return df.withColumn("_bin", F.explode(bins(F.col("start") - pad, F.col("end") + pad, width))).withColumns({"_q": q, "_s": s})

    here = F.col("_bin").between(F.floor(F.col("start") / width), F.floor(F.col("end") / width))
    if left is right:
        every = dealt(rows(left), F.lit(True), here, gap + 1)
    else:
        every = dealt(rows(left), F.lit(True), F.lit(False), gap + 1).unionByName(dealt(rows(right), F.lit(False), F.lit(True), 0))
    given = ("id", "start", "qual")
    schema = StructType([StructField(f"{side}_{c}", every.schema[c].dataType) for side in "qs" for c in given])

    def run(t: pa.Table) -> pa.Table:
        q, s = _cell(t, how, gap, width, differ, meet)
        return pa.table({f"{side}_{c}": t[c].take(pa.array(i)) for side, i in (("q", q), ("s", s)) for c in given})

    return every.groupBy("ref", "sample", "_bin").applyInArrow(run, schema)
