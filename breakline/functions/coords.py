"""Coordinates, breakend geometry, phred arithmetic: column expressions without shuffles or UDFs.

Positions are 1-based and closed. A breakend is (ref, dir, start, end[, nominal]); ``dir`` is '+' (forward: the breakpoint is after the
position) or '-' (backward). A breakpoint has a second breakend with the suffix 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed-point scale of weights, so that sums don't depend on their order.
WEIGHT_BITS = 20


def phred_to_pr(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def pr_to_phred(p: Column) -> Column:
    """-10 log10(p); a probability of 0 gives 0."""
    return F.when(p == 0, F.lit(0.0)).otherwise(-10.0 * F.log10(p))


def phred_or(*q: Column) -> Column:
    """Phred of the probability that any of the independent events happens."""
    none = F.lit(1.0)
    for x in q:
        none = none * (1.0 - phred_to_pr(x))
    return pr_to_phred(1.0 - none)


def mean_int(*xs: Column) -> Column:
    """Mean, truncated to an integer."""
    total = sum(xs[1:], xs[0])
    return (total / F.lit(len(xs))).cast("int")


def scale_weight(q: Column) -> Column:
    return (q * F.lit(1 << WEIGHT_BITS)).cast("long")


def unscale_weight(w: Column) -> Column:
    return w / F.lit(float(1 << WEIGHT_BITS))


def linear_offsets(contigs: DataFrame, padding: int = 0, ref: str = "ref", length: str = "length") -> DataFrame:
    """``contigs`` with ``offset``: what to add to a position to get a coordinate along all contigs. One row per contig."""
    before = Window.orderBy(ref).rowsBetween(Window.unboundedPreceding, -1)
    return contigs.withColumn("offset", F.coalesce(F.sum(F.col(length) + F.lit(2 * padding)).over(before), F.lit(0)).cast("long") + F.lit(padding).cast("long"))


def to_linear(df: DataFrame, offsets: DataFrame, ref: str = "ref", pos: str = "pos") -> DataFrame:
    """``linear`` of each row; contigs are a dimension of fixed size."""
    dim = F.broadcast(offsets.select(F.col("ref").alias("_ref"), F.col("offset").alias("_offset")))
    return df.join(dim, F.col(ref) == F.col("_ref")).withColumn("linear", F.col("_offset") + F.col(pos)).drop("_ref", "_offset")


def from_linear(df: DataFrame, offsets: DataFrame, linear: str = "linear") -> DataFrame:
    """``ref`` and ``pos`` back from ``linear``: the last contig that begins before it."""
    per = F.broadcast(offsets.agg(F.array_sort(F.collect_list(F.struct("offset", "ref"))).alias("_all")))
    hit = F.element_at(F.filter("_all", lambda x: x["offset"] < F.col(linear)), -1)
    return df.crossJoin(per).withColumn("_at", hit).withColumn("ref", F.col("_at.ref")).withColumn("pos", F.col(linear) - F.col("_at.offset")).drop("_all", "_at")


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def overlap_width(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2) + 1, F.lit(0))


def pad(start: Column, end: Column, by: Column | int, length: Column | None = None) -> tuple[Column, Column]:
    """An interval widened on both sides and clipped to its contig."""
    by = F.lit(by) if isinstance(by, int) else by
    hi = end + by
    return F.greatest(start - by, F.lit(1)), F.least(hi, length) if length is not None else hi


def advance(pos: Column, direction: Column, by: int) -> Column:
    """A position moved into the breakend: forwards for '+', backwards for '-'."""
    return F.when(direction == "+", pos + by).otherwise(pos - by)


def adjust(start: Column, end: Column, direction: Column, into_anchor: int, away: int) -> tuple[Column, Column]:
    """Bounds widened towards the anchor and away from it."""
    fwd = direction == "+"
    return F.when(fwd, start - into_anchor).otherwise(start - away), F.when(fwd, end + away).otherwise(end + into_anchor)


def compress(start: Column, end: Column, by: int, up: bool = False) -> tuple[Column, Column]:
    """Bounds narrowed on both sides; where nothing is left, the middle, rounded as told."""
    too_small = end - start < 2 * by
    middle = F.ceil((start + end) / 2) if up else F.floor((start + end) / 2)
    middle = middle.cast("int")
    return F.when(too_small, middle).otherwise(start + by), F.when(too_small, middle).otherwise(end - by)


def is_low(ref1: Column, s1: Column, e1: Column, ref2: Column, s2: Column, e2: Column) -> Column:
    """Whether the first breakend is the lower one."""
    return F.when(ref1 != ref2, ref1 < ref2).when(s1 != s2, s1 < s2).otherwise(e1 < e2)


def event_size(ref1: Column, dir1: Column, s1: Column, ref2: Column, dir2: Column, s2: Column) -> Column:
    """Size of a simple event; null between contigs. Same direction: the distance; deletion-like: one less; duplication-like: one more."""
    gap = F.abs(s2 - s1)
    away = ((s1 < s2) & (dir1 == "+")) | ((s2 < s1) & (dir1 == "-"))
    return F.when(ref1 != ref2, F.lit(None).cast("int")).when(dir1 == dir2, gap).when(away, gap - 1).otherwise(gap + 1)


def could_be_deletion(ref1, dir1, s1, e1, ref2, dir2, s2, e2, least: int, most: int) -> Column:
    """Whether some position within the bounds is a deletion of ``least`` to ``most`` bases."""
    fwd = dir1 == "+"
    lo = F.when(fwd, s2 - e1).otherwise(s1 - e2) - 1
    hi = F.when(fwd, e2 - s1).otherwise(e1 - s2) - 1
    return F.when((ref1 != ref2) | (dir1 == dir2), F.lit(False)).otherwise(overlaps(lo, hi, F.lit(least), F.lit(most)))


def centre_aligned(dir1, s1, e1, dir2, s2, e2, low: Column) -> tuple[Column, Column]:
    """Nominal positions in the middle. Where both sides have one direction, the low side rounds down and the high side up."""
    a, b = (s1 + e1) / 2, (s2 + e2) / 2
    same = dir1 == dir2
    up1, up2 = same & ~low, same & low
    return F.when(up1, F.ceil(a)).otherwise(F.floor(a)).cast("int"), F.when(up2, F.ceil(b)).otherwise(F.floor(b)).cast("int")


def call_margin(same_ref: Column, least_size: Column, margin: int = 10) -> Column:
    """How far bounds widen when evidence meets calls: less for events smaller than twice the margin, so that they don't turn into the reference."""
    return F.when(same_ref & (least_size < 2 * margin), F.floor(least_size / 2).cast("int")).otherwise(F.lit(margin))


def fragment_size(fwd: Column, start: Column, end: Column, mate_start: Column, mate_end: Column, usable: Column) -> Column:
    """Unclipped outer distance of a pair that faces each other; 0 if it can't be told."""
    return F.when(~usable, F.lit(0)).when(fwd, mate_end - start + 1).otherwise(end - mate_start + 1)


def dovetails(start, end, mate_start, mate_end, opposite: Column, clipped: Column, margin: int = 4) -> Column:
    """Reads that run past each other's start by no more than the margin."""
    near = (F.abs(start - mate_start) <= margin) & (F.abs(end - mate_end) <= margin)
    return opposite & near & overlaps(start, end, mate_start, mate_end) & (clipped <= margin)


def effective_mapq(mapq: Column, fallback: int = 20) -> Column:
    """255 means unknown."""
    return F.when(mapq == 255, F.lit(fallback)).otherwise(mapq)


def flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def segment_index(flags: Column) -> Column:
    """0 for the first or only read of a template, 1 for the second."""
    return F.when(flag(flags, 0x1) & flag(flags, 0x80), F.lit(1)).otherwise(F.lit(0))
