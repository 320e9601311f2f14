"""Smith-Waterman alignment in numpy, for sequences as long as a read and its reference window."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores of a match, a mismatch, opening a gap and making it longer.
MATCH, MISMATCH, OPEN, EXTEND = 1, -4, 6, 1


def local_alignment(query: str, ref: str, match: int = MATCH, mismatch: int = MISMATCH, gap_open: int = OPEN, gap_extend: int = EXTEND) -> tuple[int, int, str]:
    """(score, 0-based start in ref, CIGAR with soft clips) of the best local alignment; ties go to the first end in the query, then in the reference.

    Rows of the table are computed at once; gaps along a row, which depend on their left neighbour, by a running maximum.
    """
    n, m = len(query), len(ref)
    if not n or not m:
        return 0, 0, f"{n}S" if n else "*"
    q, r = (np.frombuffer(s.upper().encode("ascii", "replace"), np.uint8) for s in (query, ref))
    low = -(10**9)
    h = np.zeros((n + 1, m + 1), np.int64)
    f = np.full((n + 1, m + 1), low, np.int64)  # a gap in the reference: query bases inserted
    e = np.full((n + 1, m + 1), low, np.int64)  # a gap in the query: reference bases deleted
    at = np.arange(m + 1)
    for i in range(1, n + 1):
        f[i] = np.maximum(f[i - 1] - gap_extend, h[i - 1] - gap_open)
        diagonal = h[i - 1, :-1] + np.where((r == q[i - 1]) & (r != ord("N")), match, mismatch)
        best = np.maximum(np.concatenate(([0], diagonal)), np.maximum(f[i], 0))
        # e[j] = max over k < j of best[k] - open - (j - k - 1) * extend
        opened = np.maximum.accumulate(best + at * gap_extend)
        e[i, 1:] = opened[:-1] - gap_open - (at[1:] - 1) * gap_extend
        h[i] = np.maximum(best, e[i])
    i, j = np.unravel_index(int(np.argmax(h)), h.shape)
    score, end = int(h[i, j]), n - i
    if score <= 0:
        return 0, 0, f"{n}S"
    ops: list[str] = []
    state = "M"
    while True:
        if state == "M":
            if h[i, j] == 0:
                break
            step = match if r[j - 1] == q[i - 1] and r[j - 1] != ord("N") else mismatch
            if i and j and h[i, j] == h[i - 1, j - 1] + step:
                ops.append("M")
                i, j = i - 1, j - 1
            elif h[i, j] == e[i, j]:
                state = "D"
            else:
                state = "I"
        elif state == "D":
            ops.append("D")
            if e[i, j] == h[i, j - 1] - gap_open:
                state = "M"
            j -= 1
        else:
            ops.append("I")
            if f[i, j] == h[i - 1, j] - gap_open:
                state = "M"
            i -= 1
    out, run = [f"{i}S"] if i else [], 0
    ops.reverse()
    for k, op in enumerate(ops):
        run += 1
        if k + 1 == len(ops) or ops[k + 1] != op:
            out.append(f"{run}{op}")
            run = 0
    if end:
        out.append(f"{end}S")
    return score, int(j), "".join(out)


def aligned(df: DataFrame, query: str, ref: str) -> DataFrame:
    """``df`` with ``score``, ``at`` and ``aln``: an Arrow batch at a time, no shuffle."""

    @F.pandas_udf("score int, at int, aln string")
    def run(q: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([local_alignment(a or "", b or "") for a, b in zip(q, r, strict=True)], columns=["score", "at", "aln"])

    return df.withColumn("_a", run(F.col(query), F.col(ref))).select("*", "_a.score", "_a.at", "_a.aln").drop("_a")


def inexact_homology(breakend: str, local: str, remote: str) -> tuple[int, int]:
    """How many bases of the breakend's sequence align over the local and over the remote side of the breakpoint.

    The sequence runs from the local anchor across the breakpoint; ``local`` goes on along the local reference, ``remote`` comes in along the remote one.
    """

    def reach(seq: str, ref: str) -> int:
        score, start, cig = local_alignment(seq, ref)
        if score <= 0:
            return 0
        n, length = "", 0
        for c in cig:
            if c.isdigit():
                n += c
            else:
                length += int(n) if c in "MI" else 0
                n = ""
        return length

    return reach(breakend, local), reach(breakend, remote)


def with_inexact_homology(df: DataFrame, breakend: Column, local: Column, remote: Column) -> DataFrame:
    """``df`` with ihompos_low (0 or less) and ihompos_high."""

    @F.pandas_udf("lo int, hi int")
    def run(b: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [inexact_homology(s or "", p or "", q or "") for s, p, q in zip(b, x, y, strict=True)]
        return pd.DataFrame([(-p, q) for q, p in rows], columns=["lo", "hi"])

    return df.withColumn("_h", run(breakend, local, remote)).select("*", F.col("_h.lo").alias("ihompos_low"), F.col("_h.hi").alias("ihompos_high")).drop("_h")
