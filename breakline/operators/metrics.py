"""Library metrics: counters, histograms and the tables that scores are read from. Every one is a single partial aggregation; tables that
follow are as long as a read or a fragment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions.coords import flag, pr_to_phred


def library_counters(reads: DataFrame) -> DataFrame:
    """One row of counters over reads (flag, cigar, fragment, has_sa); pairs are counted at their first read."""
    f = F.col("flag")
    mapped, mate_mapped = ~flag(f, 0x4), ~flag(f, 0x8)
    primary = ~flag(f, 0x100) & ~flag(f, 0x800)
    first = flag(f, 0x1) & flag(f, 0x40) & primary

    def n(c: Column) -> Column:
        return F.sum(c.cast("long"))

    proper = F.when(flag(f, 0x2) & primary & (F.col("fragment") > 0), F.col("fragment"))
    return reads.agg(
        F.max(C.read_length(F.col("cigar"))).alias("max_read_length"),
        F.max(F.when(mapped, C.reference_length(F.col("cigar")))).alias("max_mapped_length"),
        F.min(proper).alias("min_proper_fragment"),
        F.max(proper).alias("max_proper_fragment"),
        n(primary).alias("reads"),
        n(primary & mapped).alias("mapped_reads"),
        n(first).alias("read_pairs"),
        n(first & mapped & mate_mapped).alias("pairs_both_mapped"),
        n(first & (mapped != mate_mapped)).alias("pairs_one_mapped"),
        n(first & ~mapped & ~mate_mapped).alias("pairs_zero_mapped"),
        n(flag(f, 0x100) & ~F.col("has_sa")).alias("secondary_not_split"),
    )


def cigar_histogram(reads: DataFrame, ops=("M", "I", "D", "N", "S", "H")) -> DataFrame:
    """(op, length, n), dense from 0 to the longest of each operator. A read without I, D or N adds a length of 0 to it; clips count at either end, 0 where there is none."""
    c = F.col("cigar")
    clip = {"S": (C.start_clip(c, False), C.end_clip(c, False))}
    inner = F.filter(c, lambda x: ~x["op"].isin("S", "H"))
    absent = F.transform(F.array(*[F.lit(o) for o in ops if o not in "SH"]), lambda o: F.struct(F.lit(0).alias("len"), o.alias("op")))
    absent = F.filter(absent, lambda a: ~F.exists(inner, lambda x: x["op"] == a["op"]))
    hard = [F.aggregate(F.filter(F.slice(x, 1, 1), lambda y: y["op"] == "H"), F.lit(0), lambda a, y: a + y["len"]) for x in (c, F.reverse(c))]
    ends = F.array(*[F.struct(v.alias("len"), F.lit("S").alias("op")) for v in clip["S"]], *[F.struct(v.alias("len"), F.lit("H").alias("op")) for v in hard])
    each = reads.select(F.explode(F.concat(inner, absent, ends)).alias("x")).select(F.col("x.op").alias("op"), F.col("x.len").alias("length"))
    n = each.groupBy("op", "length").agg(F.count(F.lit(1)).alias("n"))
    dense = n.groupBy("op").agg(F.max("length").alias("m")).select("op", F.explode(F.sequence(F.lit(0), "m")).alias("length"))
    return dense.join(n, ["op", "length"], "left").select("op", "length", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def tail_phred(hist: DataFrame, key: str = "op", x: str = "length", n: str = "n") -> DataFrame:
    """Phred of a value at least as large: -10 log10(sum from here / sum of all); where nothing is left, the last value before."""
    w = Window.partitionBy(key).orderBy(x)
    rest = F.sum(n).over(w.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum(n).over(Window.partitionBy(key))
    own = hist.withColumn("_p", F.when(rest > 0, -10.0 * F.log10(rest / total)))
    carried = F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("phred", F.coalesce(carried, F.lit(0.0)) + 0.0).drop("_p")


def mapq_metrics(reads: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """max, min, mapped, unknown (255) and zero MAPQ of mapped reads, per level (a key column each) and over all, by grouping sets."""
    mapped = ~flag(F.col("flag"), 0x4)
    known = mapped & (F.col("mapq") != 255)
    aggs = [
        F.max(F.when(known, F.col("mapq"))).alias("max_mapq"),
        F.min(F.when(known, F.col("mapq"))).alias("min_mapq"),
        F.sum(mapped.cast("long")).alias("mapped"),
        F.sum((mapped & (F.col("mapq") == 255)).cast("long")).alias("unknown"),
        F.sum((mapped & (F.col("mapq") == 0)).cast("long")).alias("zero"),
    ]
    if not levels:
        return reads.agg(*aggs)
    cols = [F.col(c) for c in levels]
    return reads.groupingSets([[], *[cols[: k + 1] for k in range(len(cols))]], *cols).agg(F.grouping_id().cast("long").alias("level"), *aggs)


def mapq_histogram(reads: DataFrame) -> DataFrame:
    return reads.where(~flag(F.col("flag"), 0x4)).groupBy("mapq").agg(F.count(F.lit(1)).alias("n"))


def tag_counts(reads: DataFrame, tags: str = "tags") -> DataFrame:
    return reads.select(F.explode(F.map_keys(tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def distribution(hist: DataFrame, x: str = "x", n: str = "n") -> DataFrame:
    """pdf, cdf and descending cdf of a histogram; it is as long as a fragment, so one window is enough."""
    w = Window.partitionBy(F.lit(0)).orderBy(x)
    total = F.sum(n).over(Window.partitionBy(F.lit(0)))
    up = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.sum(n).over(w.rowsBetween(0, Window.unboundedFollowing))
    return hist.select(x, n, (F.col(n) / total).alias("pdf"), (up / total).alias("cdf"), (down / total).alias("tail"))


def inverse_cdf(hist: DataFrame, p: list[float], x: str = "x", n: str = "n") -> DataFrame:
    """The smallest value whose cdf reaches p, for each p."""
    cdf = distribution(hist, x, n)
    return cdf.agg(*[F.min(F.when(F.col("cdf") >= v, F.col(x))).alias(f"p{k}") for k, v in enumerate(p)])


def read_pair_phred(hist: DataFrame, both_mapped: int | Column, x: str = "x", n: str = "n") -> DataFrame:
    """Phred of a fragment at least as extreme: the folded cdf of the fragments that follow the distribution, plus all pairs that don't."""
    cdf = distribution(hist, x, n)
    total = F.sum(n).over(Window.partitionBy(F.lit(0)))
    pairs = F.lit(both_mapped) if isinstance(both_mapped, int) else both_mapped
    folded = F.least(F.col("tail"), F.col("cdf")) * total
    p = F.least(F.lit(1.0), (pairs - total + folded) / pairs)
    return cdf.select(x, n, "cdf", (pr_to_phred(p) + 0.0).alias("phred"))


def gc_histogram(frags: DataFrame, levels: list[str]) -> DataFrame:
    """Fragments by GC percent, over all and per level."""
    cols = [F.col(c) for c in levels]
    g = F.col("gc")
    return frags.groupingSets([[g], *[[*cols[: k + 1], g] for k in range(len(cols))]], *cols, g).agg(F.count(F.lit(1)).alias("n"))


def gc_multiplier(hist: DataFrame, gc: str = "gc", n: str = "n", expected: str = "expected") -> DataFrame:
    """What to multiply a fragment of each GC percent with, so that all percents weigh as expected."""
    whole = Window.partitionBy(F.lit(0))
    share, due = F.col(n) / F.sum(n).over(whole), F.col(expected) / F.sum(expected).over(whole)
    return hist.select(gc, F.when(F.col(n) > 0, due / share).otherwise(F.lit(0.0)).alias("multiplier"))


def asymmetric_pairs(evidence: DataFrame, pair: str = "pair_id", score: str = "qs") -> DataFrame:
    """Breakpoint evidence whose two sides don't agree in score, or that has but one side."""
    got = evidence.groupBy(pair).agg(F.count(F.lit(1)).alias("sides"), F.min(score).alias("least"), F.max(score).alias("most"))
    return got.where((F.col("sides") != 2) | (F.col("least") != F.col("most")))
