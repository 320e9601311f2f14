"""Panel of normals: breakpoints and breakends seen in normal samples, merged where they overlap or touch, with counts."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calling import BOX_KEYS
from .intervals import _islands, box_join
from .tables import written as _written


def normal_calls(genotypes: DataFrame, keys: list[str], least_qual: float = 75, least_bq: float = 428) -> DataFrame:
    """Calls with the number of normal samples that support them (genotypes: keys, qual, bq, imprecise)."""
    ok = ~F.col("imprecise") & ((F.col("qual") >= least_qual) | ((F.col("qual") == 0) & (F.col("bq") >= least_bq)))
    return genotypes.where(ok).groupBy(*keys).agg(F.count(F.lit(1)).cast("long").alias("n"))


def merge_breakends(be: DataFrame, keys: tuple[str, ...] = ("ref", "dir"), margin: int = 1) -> DataFrame:
    """Breakends (keys, start, end, n) that overlap or touch become one, with their counts summed."""
    exact = be.groupBy(*keys, "start", "end").agg(F.sum("n").cast("long").alias("_n"))
    return _islands(exact, list(keys), margin, [F.sum("_n").cast("long").alias("n")])


def merge_breakpoints(bp: DataFrame, width: int, margin: int = 1) -> DataFrame:
    """Breakpoints (ref1, dir1, start1, end1, ref2, ..., n) that overlap or touch on both sides become one box, until no two boxes do.

    A round finds the overlaps by a binned join, spreads the smallest id along them and merges; merged boxes can meet others, so
    rounds go on until nothing changes; each makes the boxes fewer.
    """
    low = (F.col("ref1") < F.col("ref2")) | ((F.col("ref1") == F.col("ref2")) & (F.col("start1") <= F.col("start2")))
    box = ["start1", "end1", "start2", "end2"]
    cur = bp.where(low).groupBy(*BOX_KEYS, *box).agg(F.sum("n").cast("long").alias("n"))
    cur = _written(cur.withColumn("id", F.concat_ws("_", *[F.col(c).cast("string") for c in [*BOX_KEYS, *box]])), "boxes")
    n = cur.count()
    for k in itertools.count():
        wide = cur.select(*[F.col(c).alias(f"l_{c}") for c in [*BOX_KEYS, *box, "id"]]).withColumns({"l_start1": F.col("l_start1") - margin, "l_end1": F.col("l_end1") + margin, "l_start2": F.col("l_start2") - margin, "l_end2": F.col("l_end2") + margin})
        near = box_join(wide, cur, [(f"l_{c}", c) for c in BOX_KEYS], ("l_start1", "l_end1", "l_start2", "l_end2"), tuple(box), width)
        label = near.groupBy("id").agg(F.min("l_id").alias("to"))
        merged = cur.join(label, "id").groupBy(*BOX_KEYS, "to").agg(F.min("start1").alias("start1"), F.max("end1").alias("end1"), F.min("start2").alias("start2"), F.max("end2").alias("end2"), F.sum("n").cast("long").alias("n")).withColumnRenamed("to", "id")
        cur = _written(merged.select(*BOX_KEYS, *box, "n", "id"), f"round-{k}")
        if (left := cur.count()) == n:
            return cur.drop("id")
        n = left


def in_panel(calls: DataFrame, panel: DataFrame, width: int, gap: int = 4, least: int = 1) -> DataFrame:
    """Breakpoint calls (call_id, ...) that the panel holds within ``gap``."""
    box = ["start1", "end1", "start2", "end2"]
    p = panel.where(F.col("n") >= least).select(*[F.col(c).alias(f"p_{c}") for c in [*BOX_KEYS, *box]]).withColumns({f"p_{c}": F.col(f"p_{c}") + (gap if "end" in c else -gap) for c in box})
    return box_join(calls, p, [(c, f"p_{c}") for c in BOX_KEYS], tuple(box), tuple(f"p_{c}" for c in box), width).select("call_id").distinct()
