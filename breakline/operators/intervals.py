"""Closed intervals: joins, unions, coverage.

Joins deal intervals into bins of the genome and join on (keys, bin), so the planner sees an equi-join that it can shuffle, broadcast or split
where it is skewed. Sweeps run per chunk of the genome, never per contig, so no task holds a chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a chunk that one task sweeps at once.
CHUNK = 10_000_000


def bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))


def interval_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], l: tuple[str, str], r: tuple[str, str], width: int, how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Pairs whose closed intervals overlap and whose keys agree. Column names must be disjoint.

    Each pair is found once, in the bin where the later of the two starts. ``left_semi`` and ``left_anti`` return the left
    side; ``left_anti`` needs a unique row on the left, as it is taken from all columns.
    """
    a = left.withColumn("_bin_l", F.explode(bins(F.col(l[0]), F.col(l[1]), width)))
    b = right.withColumn("_bin_r", F.explode(bins(F.col(r[0]), F.col(r[1]), width)))
    cond = F.col("_bin_l") == F.col("_bin_r")
    for x, y in on:
        cond = cond & (F.col(x) == F.col(y))
    meets = (F.col(l[0]) <= F.col(r[1])) & (F.col(r[0]) <= F.col(l[1]))
    if extra is not None:
        meets = meets & extra
    if how == "inner":
        once = F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / width) == F.col("_bin_l")
        return a.join(b, cond & meets & once).drop("_bin_l", "_bin_r")
    hit = a.join(b, cond & meets, "left_semi").drop("_bin_l").distinct()
    if how == "left_semi":
        return hit
    if how == "left_anti":
        return left.join(hit, [left[c].eqNullSafe(hit[c]) for c in left.columns], "left_anti")
    raise ValueError(how)


def box_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], l: tuple[str, str, str, str], r: tuple[str, str, str, str], width: int) -> DataFrame:
    """Pairs whose two closed intervals overlap on both sides: binned on the first side and on the second."""
    a = left.withColumn("_bx_l", F.explode(bins(F.col(l[0]), F.col(l[1]), width))).withColumn("_by_l", F.explode(bins(F.col(l[2]), F.col(l[3]), width)))
    b = right.withColumn("_bx_r", F.explode(bins(F.col(r[0]), F.col(r[1]), width))).withColumn("_by_r", F.explode(bins(F.col(r[2]), F.col(r[3]), width)))
    cond = (F.col("_bx_l") == F.col("_bx_r")) & (F.col("_by_l") == F.col("_by_r"))
    for x, y in on:
        cond = cond & (F.col(x) == F.col(y))
    meets = (F.col(l[0]) <= F.col(r[1])) & (F.col(r[0]) <= F.col(l[1])) & (F.col(l[2]) <= F.col(r[3])) & (F.col(r[2]) <= F.col(l[3]))
    once = (F.floor(F.greatest(F.col(l[0]), F.col(r[0])) / width) == F.col("_bx_l")) & (F.floor(F.greatest(F.col(l[2]), F.col(r[2])) / width) == F.col("_by_l"))
    return a.join(b, cond & meets & once).drop("_bx_l", "_by_l", "_bx_r", "_by_r")


def clip_to_chunks(df: DataFrame, start: str = "start", end: str = "end", chunk: int = CHUNK) -> DataFrame:
    """Intervals cut at chunk borders, with ``_chunk``."""
    cut = df.withColumn("_chunk", F.explode(bins(F.col(start), F.col(end), chunk)))
    lo, hi = F.col("_chunk") * chunk, F.col("_chunk") * chunk + (chunk - 1)
    return cut.withColumn(start, F.greatest(F.col(start).cast("long"), lo)).withColumn(end, F.least(F.col(end).cast("long"), hi))


def _islands(df: DataFrame, keys: list[str], gap: int, aggs: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *aggs).drop("_island")


def merge_intervals(df: DataFrame, keys: list[str], gap: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Union of intervals (start, end): neighbours no more than ``gap`` apart are one (1: they touch, 0: they share a position).

    First within chunks, then, over what is left, across them.
    """
    own = df.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    if gap >= 1:
        own = _islands(clip_to_chunks(own, chunk=chunk), [*keys, "_chunk"], gap, []).drop("_chunk")
    return _islands(own, keys, gap, [])


def count_merged(df: DataFrame, keys: list[str], gap: int = 1, weight: Column | None = None) -> DataFrame:
    """Islands with ``n``, the weight of the intervals in each."""
    n = (weight if weight is not None else F.lit(1)).cast("long")
    own = df.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), n.alias("_n"))
    exact = own.groupBy(*keys, "start", "end").agg(F.sum("_n").alias("_n"))
    return _islands(exact, keys, gap, [F.sum("_n").alias("n")])


def subtract(df: DataFrame, exclude: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """What of the union of ``df`` isn't in ``exclude``."""
    marks = segments(df.select(*keys, "start", "end", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(exclude.select(*keys, "start", "end", F.lit(0).alias("_a"), F.lit(1).alias("_b"))), keys, {"a": "_a", "b": "_b"}, chunk)
    return merge_intervals(marks.where((F.col("a") > 0) & (F.col("b") == 0)), keys, 1, chunk)


def segments(df: DataFrame, keys: list[str], sums: dict[str, str], chunk: int = CHUNK) -> DataFrame:
    """Stretches (start, end) of constant sums over the intervals that cover them; borders of chunks part stretches."""
    cut = clip_to_chunks(df.select(*keys, "start", "end", *set(sums.values())), chunk=chunk)
    up = cut.select(*keys, "_chunk", F.col("start").alias("pos"), *[F.col(v).alias(k) for k, v in sums.items()])
    down = cut.select(*keys, "_chunk", (F.col("end") + 1).alias("pos"), *[(-F.col(v)).alias(k) for k, v in sums.items()])
    by = [*keys, "_chunk"]
    steps = up.unionByName(down).groupBy(*by, "pos").agg(*[F.sum(k).alias(k) for k in sums])
    w = Window.partitionBy(*by).orderBy("pos")
    run = steps.select(*by, F.col("pos").alias("start"), (F.lead("pos").over(w) - 1).alias("end"), *[F.sum(k).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k in sums])
    covered = F.lit(False)
    for k in sums:
        covered = covered | (F.col(k) != 0)
    return run.where(F.col("end").isNotNull() & covered).drop("_chunk")


def coverage(df: DataFrame, keys: list[str], chunk: int = CHUNK) -> DataFrame:
    """Stretches of constant depth."""
    return segments(df.withColumn("_one", F.lit(1).cast("long")), keys, {"depth": "_one"}, chunk)


def threshold_regions(df: DataFrame, keys: list[str], least: int, chunk: int = CHUNK) -> DataFrame:
    """Maximal regions with at least ``least`` intervals over each position."""
    return merge_intervals(coverage(df, keys, chunk).where(F.col("depth") >= least), keys, 1, chunk)


def depth_at(points: DataFrame, df: DataFrame, keys: list[str], pos: str = "pos", name: str = "depth", chunk: int = CHUNK) -> DataFrame:
    """``points`` with the number of intervals over each position, by a running sum over points and borders together."""
    cut = clip_to_chunks(df.select(*keys, "start", "end"), chunk=chunk)
    up = cut.select(*keys, "_chunk", F.col("start").alias("_pos"), F.lit(0).alias("_order"), F.lit(1).alias("_step"))
    down = cut.select(*keys, "_chunk", (F.col("end") + 1).alias("_pos"), F.lit(0).alias("_order"), F.lit(-1).alias("_step"))
    marks = up.unionByName(down).groupBy(*keys, "_chunk", "_pos", "_order").agg(F.sum("_step").alias("_step"))
    asked = points.withColumn("_chunk", F.floor(F.col(pos) / chunk).cast("long")).withColumn("_pos", F.col(pos).cast("long")).withColumn("_order", F.lit(1)).withColumn("_step", F.lit(0).cast("long"))
    every = asked.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_pos", "_order")
    return every.withColumn(name, F.sum("_step").over(w)).where(F.col("_order") == 1).drop("_chunk", "_pos", "_order", "_step")


def binned_coverage(df: DataFrame, keys: list[str], width: int, weight: Column | None = None) -> DataFrame:
    """Mean depth of each touched bin: overlap times weight over the bin's width. Partial sums, one row per bin."""
    own = df.withColumn("_w", weight if weight is not None else F.lit(1).cast("long")).withColumn("bin", F.explode(bins(F.col("start") - 1, F.col("end") - 1, width)))
    lo = F.col("bin") * width + 1
    part = (F.least(F.col("end").cast("long"), lo + (width - 1)) - F.greatest(F.col("start").cast("long"), lo) + 1) * F.col("_w")
    return own.withColumn("_part", part).groupBy(*keys, "bin").agg(F.sum("_part").alias("covered")).select(*keys, (F.col("bin") * width + 1).alias("start"), (F.col("bin") * width + width).alias("end"), "covered", (F.col("covered") / F.lit(width)).alias("mean_depth"))


def split_bins(bins_df: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Bins (start, end) cut after each position in ``cuts`` (pos) that lies inside one."""
    inside = interval_join(bins_df.withColumnsRenamed({"start": "_s", "end": "_e"}), cuts.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("pos").alias("_p"), F.col("pos").alias("_q")), [(k, f"_c_{k}") for k in keys], ("_s", "_e"), ("_p", "_q"), 10_000)
    ends = inside.where(F.col("_p") < F.col("_e")).select(*keys, F.col("_s"), F.col("_e"), F.col("_p").alias("end")).distinct()
    every = ends.unionByName(bins_df.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("end").cast("long").alias("end")).withColumn("end", F.col("end")))
    w = Window.partitionBy(*keys, "_s").orderBy("end")
    return every.select(*keys, F.coalesce(F.lag("end").over(w) + 1, F.col("_s")).alias("start"), "end")


def best_by_position(df: DataFrame, keys: list[str], score: str, ident: str) -> DataFrame:
    """Stretches with the best interval over each: the highest score, ties to the smaller id. Each border asks a binned join."""
    edges = df.select(*keys, F.col("start").alias("at")).unionByName(df.select(*keys, (F.col("end") + 1).alias("at"))).distinct()
    w = Window.partitionBy(*keys).orderBy("at")
    parts = edges.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("at").alias("_s"), (F.lead("at").over(w) - 1).alias("_e")).where(F.col("_e").isNotNull())
    met = interval_join(parts, df.select(*keys, "start", "end", score, ident), [(f"_k_{k}", k) for k in keys], ("_s", "_e"), ("start", "end"), 100)
    best = met.groupBy(*keys, "_s", "_e").agg(F.min(F.struct((-F.col(score)).alias("n"), F.col(ident).alias("i"))).alias("b"))
    return best.select(*keys, F.col("_s").alias("start"), F.col("_e").alias("end"), F.col("b.i").alias(ident), (-F.col("b.n")).alias(score))


def chunks(contigs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks (ref, chunk, start, end) of contigs (ref, length)."""
    n = F.greatest(F.ceil(F.col("length") / size).cast("int"), F.lit(1))
    each = contigs.select("ref", "length", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return each.select("ref", "chunk", (F.col("chunk") * size + 1).alias("start"), F.least(F.col("chunk") * size + size, F.col("length")).alias("end"))


def density_throttle(df: DataFrame, keys: list[str], pos: str, ident: Column, window: int, accept: float, target: float) -> DataFrame:
    """Thin out dense places: a row stays if the trailing window holds fewer than ``accept * window`` rows, else if a hash of
    its id is below exp(-x), where x is the excess relative to ``target``. Deterministic: it depends on the rows in the window,
    not on those that stayed."""
    # chunks overlap by one window, so that each row sees its whole trailing window in its own chunk
    own = df.withColumn("_own", F.floor(F.col(pos) / CHUNK).cast("long"))
    spread = own.withColumn("_chunk", F.explode(F.array_distinct(F.array(F.col("_own"), F.floor((F.col(pos) + window) / CHUNK).cast("long")))))
    w = Window.partitionBy(*keys, "_chunk").orderBy(F.col(pos).cast("long")).rangeBetween(-(window - 1), 0)
    counted = spread.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_own") == F.col("_chunk"))
    density = F.col("_n") / F.lit(float(window))
    chance = F.exp(-(density - accept) / (target - accept))
    unit = F.conv(F.substring(F.md5(ident.cast("string").cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    return counted.where((density < accept) | (unit < chance)).drop("_own", "_chunk", "_n")
