"""Calls as maximal cliques of mutually overlapping evidence.

In two dimensions evidence is a box (both breakends' intervals) and a maximal clique is a maximal set of boxes with a common
point: the boxes that hold the corner (a, b), where a and b are the largest starts among them, provided that no other box
overlaps their intersection. In one dimension a clique is [last start, first end] wherever the next start lies beyond
that end; two running sums and two neighbouring values tell all, without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import CHUNK, bins

BOX_KEYS = ["ref1", "dir1", "ref2", "dir2"]


def merge_boxes(ev: DataFrame, exact: Column | None = None) -> DataFrame:
    """Equal boxes as one with summed weight, and the summed weight of exact evidence."""
    ew = F.sum(F.when(exact, F.col("qs")).otherwise(F.lit(0)) if exact is not None else F.col("qs"))
    return ev.groupBy(*BOX_KEYS, "start1", "end1", "start2", "end2").agg(F.sum("qs").alias("w"), ew.alias("exact_w"))


def low_side(ev: DataFrame) -> DataFrame:
    """The rows whose first breakend is the lower one; their mirror images say the same."""
    low = (F.col("ref1") < F.col("ref2")) | ((F.col("ref1") == F.col("ref2")) & (F.col("start1") <= F.col("start2")))
    return ev.where(low)


def maximal_cliques(boxes: DataFrame, width: int, keys: list[str] | None = None) -> DataFrame:
    """Maximal cliques of weighted boxes (keys, start1, end1, start2, end2, w, exact_w).

    ``width`` is the bin, best about as wide as the widest box. Boxes stand in every bin that they touch; corners and the
    boxes over them meet in the corner's bin.
    """
    keys = keys or BOX_KEYS
    box = boxes.withColumn("_bx", F.explode(bins(F.col("start1"), F.col("end1"), width))).withColumn("_by", F.explode(bins(F.col("start2"), F.col("end2"), width)))
    cell = [*keys, "_bx", "_by"]
    # candidate corners: a start on either axis that lies in the other's range
    xs = box.where(F.floor(F.col("start1") / width) == F.col("_bx")).select(*cell, F.col("start1").alias("a"), F.col("start2").alias("_s2"), F.col("end2").alias("_e2")).distinct()
    ys = box.where(F.floor(F.col("start2") / width) == F.col("_by")).select(*cell, F.col("start2").alias("b"), F.col("start1").alias("_s1"), F.col("end1").alias("_e1")).distinct()
    corner = xs.join(ys, cell).where(F.col("b").between(F.col("_s2"), F.col("_e2")) & F.col("a").between(F.col("_s1"), F.col("_e1"))).select(*cell, "a", "b").distinct()
    held = corner.join(box, cell).where(F.col("a").between(F.col("start1"), F.col("end1")) & F.col("b").between(F.col("start2"), F.col("end2")))
    clique = held.groupBy(*cell, "a", "b").agg(F.max("start1").alias("_ma"), F.max("start2").alias("_mb"), F.min("end1").alias("e1"), F.min("end2").alias("e2"), F.sum("w").alias("weight"), F.sum("exact_w").alias("exact_weight"))
    clique = clique.where((F.col("_ma") == F.col("a")) & (F.col("_mb") == F.col("b"))).drop("_ma", "_mb", "_bx", "_by")
    area = clique.withColumn("_bx", F.explode(bins(F.col("a"), F.col("e1"), width))).withColumn("_by", F.explode(bins(F.col("b"), F.col("e2"), width)))
    other = box.select(*cell, F.col("start1").alias("_s1"), F.col("end1").alias("_e1"), F.col("start2").alias("_s2"), F.col("end2").alias("_e2"))
    meets = (F.col("_s1") <= F.col("e1")) & (F.col("a") <= F.col("_e1")) & (F.col("_s2") <= F.col("e2")) & (F.col("b") <= F.col("_e2"))
    outside = ~(F.col("a").between(F.col("_s1"), F.col("_e1")) & F.col("b").between(F.col("_s2"), F.col("_e2")))
    larger = area.join(other, cell).where(meets & outside).select(*keys, "a", "b").distinct()
    kept = clique.join(larger, [*keys, "a", "b"], "left_anti")
    return kept.select(*keys, F.col("a").alias("start1"), F.col("e1").alias("end1"), F.col("b").alias("start2"), F.col("e2").alias("end2"), "weight", "exact_weight")


def interval_cliques(be: DataFrame, keys: list[str], weight: str = "qs", chunk: int = CHUNK, most_wide: int | None = None) -> DataFrame:
    """Maximal cliques (start, end, weight) of weighted intervals (keys, start, end).

    Each chunk also sees the intervals that begin within ``most_wide`` (the widest interval, measured if not told) after it.
    """
    if most_wide is None:
        most_wide = be.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    spread = be.withColumn("_chunk", F.explode(bins(F.col("start") - F.lit(most_wide), F.col("end"), chunk)))
    by = [*keys, "_chunk"]
    at_start = spread.groupBy(*by, F.col("start").cast("long").alias("pos")).agg(F.sum(weight).alias("_in"), F.lit(True).alias("_s"))
    at_end = spread.groupBy(*by, F.col("end").cast("long").alias("pos")).agg(F.sum(weight).alias("_out"), F.lit(True).alias("_e"))
    marks = at_start.join(at_end, [*by, "pos"], "full")
    w = Window.partitionBy(*by).orderBy("pos")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.select(
        *by,
        F.col("pos").alias("start"),
        F.coalesce("_s", F.lit(False)).alias("_s"),
        (F.coalesce(F.sum("_in").over(upto), F.lit(0)) - F.coalesce(F.sum("_out").over(before), F.lit(0))).alias("weight"),
        F.min(F.when(F.col("_e"), F.col("pos"))).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("end"),
        F.min(F.when(F.col("_s"), F.col("pos"))).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_next"),
    )
    own = F.floor(F.col("start") / chunk) == F.col("_chunk")
    return seen.where(F.col("_s") & own & (F.col("_next").isNull() | (F.col("_next") > F.col("end")))).select(*keys, "start", "end", "weight")


def best_interval(be: DataFrame, keys: list[str], weight: str = "qs") -> DataFrame:
    """The heaviest clique of each key; ties to the first."""
    got = interval_cliques(be, keys, weight)
    best = got.groupBy(*keys).agg(F.max(F.struct("weight", (-F.col("start")).alias("s"), F.col("end").alias("e"))).alias("b"))
    return best.select(*keys, (-F.col("b.s")).alias("start"), F.col("b.e").alias("end"), F.col("b.weight").alias("weight"))


def call_records(cliques: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Two rows per call, the low and the high breakend, named alike and linked: event, id, mate_id."""
    keys = keys or BOX_KEYS
    named = cliques.withColumn("event", F.concat_ws("_", *[F.col(c).cast("string") for c in [*keys, "start1", "start2"]]))
    both = named.withColumn("side", F.explode(F.array(F.lit("o"), F.lit("h"))))
    low = F.col("side") == "o"
    return both.select("event", F.concat("event", "side").alias("id"), F.concat("event", F.when(low, "h").otherwise("o")).alias("mate_id"), "weight",
        *[F.when(low, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(c) for c in ("ref", "dir", "start", "end")],
        *[F.when(low, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(f"mate_{c}") for c in ("ref", "dir", "start", "end")])
