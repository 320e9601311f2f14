"""What supports a call: counts, qualities, fragments, positions. Conditional sums per call and category, all in one partial aggregation;
weights are fixed-point numbers, so results don't depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import depth_at, interval_join


def support(assigned: DataFrame, by: list[str]) -> DataFrame:
    """Counts and summed weights per kind of evidence (SR, IC, RP, SC, UM), quality totals, mapq and strand bias.

    ``assigned``: call_id, category, kind, qs, mapq1, mapq2, strand, fragment_id.
    """

    def n(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, 1).otherwise(0)).cast("long")

    def q(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("qs")).otherwise(0)).cast("long")

    both = ((F.col("mapq1") + F.col("mapq2")) / 2).cast("int")
    names = {"SR": "sr", "IC": "ic", "RP": "rp", "SC": "bsc", "UM": "bum"}
    kinds = [x for k, c in names.items() for x in (n(k).alias(c), q(k).alias(f"{c}q"))]
    breakend = F.col("kind").isin("SC", "UM")
    return assigned.groupBy(*by).agg(
        *kinds,
        F.sum(F.when(breakend, 0).otherwise(F.col("qs"))).cast("long").alias("qual"),
        F.sum(F.when(breakend, F.col("qs")).otherwise(0)).cast("long").alias("bq"),
        F.min(both).alias("min_mapq"),
        F.max(both).alias("max_mapq"),
        F.sum(both).cast("long").alias("sum_mapq"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(F.col("kind").isin("SR", "SC"), F.when(F.col("strand") == "+", 1).otherwise(0))).cast("long").alias("fwd_reads"),
        F.sum(F.when(F.col("kind").isin("SR", "SC"), 1)).cast("long").alias("strand_reads"),
    )


def fragments(assigned: DataFrame, by: list[str]) -> DataFrame:
    """Distinct fragments with breakpoint support (vf), and with breakend support alone (bvf)."""
    breakend = F.col("kind").isin("SC", "UM")
    each = assigned.groupBy(*by, "fragment_id").agg(F.max(F.when(breakend, 0).otherwise(1)).alias("bp"))
    return each.groupBy(*by).agg(F.sum("bp").cast("long").alias("vf"), F.sum(1 - F.col("bp")).cast("long").alias("bvf"))


def assembly_share(rows: DataFrame) -> DataFrame:
    """An assembly's quality over the categories, in proportion to what they put into it; nothing where nothing was put in.

    ``rows``: assembly_id, category, qs, assembly_qs.
    """
    per = rows.groupBy("assembly_id", "category").agg(F.sum("qs").cast("long").alias("cat_qs"), F.max("assembly_qs").cast("long").alias("assembly_qs"))
    total = F.sum("cat_qs").over(Window.partitionBy("assembly_id"))
    return per.select("assembly_id", "category", "cat_qs", F.when(total == 0, F.lit(0.0)).otherwise(F.col("assembly_qs") * (F.col("cat_qs") / total)).alias("share"))


def offset_quality(parts: DataFrame) -> DataFrame:
    """Where in an assembly the summed quality of the supporting rows (assembly_id, off_start, off_end, qs) is least and most; the first offset wins.

    Rows are swept as steps up and down, so an assembly's offsets aren't enumerated.
    """
    up = parts.select("assembly_id", F.col("off_start").alias("off"), F.col("qs").alias("d"))
    down = parts.select("assembly_id", (F.col("off_end") + 1).alias("off"), (-F.col("qs")).alias("d"))
    steps = up.unionByName(down).groupBy("assembly_id", "off").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("assembly_id").orderBy("off")
    run = steps.select("assembly_id", "off", F.sum("d").over(w).cast("long").alias("q"), F.lead("off").over(w).alias("_next")).where(F.col("_next").isNotNull())
    return run.groupBy("assembly_id").agg(F.min_by("off", F.struct("q", "off")).alias("least_at"), F.min("q").alias("least"), F.min_by("off", F.struct(-F.col("q"), F.col("off"))).alias("most_at"), F.max("q").alias("most"))


def support_at(parts: DataFrame, at: DataFrame) -> DataFrame:
    """Rows and fragments per assembly and category that touch the assembly's ``at`` offset."""
    hit = parts.join(at, "assembly_id").where(F.col("at").between(F.col("off_start"), F.col("off_end")))
    return hit.groupBy("assembly_id", "category").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("fragment_id").alias("n_fragments"), F.sum("qs").cast("long").alias("qs"))


def not_supporting(reads: DataFrame, call_assemblies: DataFrame) -> DataFrame:
    """Assembled reads of a call (call_id, assembly_id, kind, qs) whose assembly isn't among the call's."""
    rest = reads.join(call_assemblies, ["call_id", "assembly_id"], "left_anti")
    return rest.groupBy("call_id").agg(*[x for k in ("RP", "SR") for x in (F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("long").alias(f"an{k.lower()}"), F.sum(F.when(F.col("kind") == k, F.col("qs")).otherwise(0)).cast("long").alias(f"an{k.lower()}q"))])


def nominal(assigned: DataFrame) -> DataFrame:
    """The evidence that names a call's position: exact first, assemblies first, best weight, smallest id."""
    order = F.struct(F.when(F.col("exact"), 0).otherwise(1).alias("a"), F.when(F.col("is_assembly"), 0).otherwise(1).alias("b"), (-F.col("qs")).alias("c"), F.col("evidence_id").alias("d"))
    got = assigned.groupBy("call_id").agg(F.min(F.struct(order.alias("o"), F.col("start1").alias("p"))).alias("x"))
    return got.select("call_id", F.col("x.o.d").alias("evidence_id"), F.col("x.p").alias("pos"))


def names(assigned: DataFrame, column: str = "fragment_id") -> DataFrame:
    """Distinct supporting names per call, sorted."""
    return assigned.groupBy("call_id").agg(F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), ",").alias("names"))


def assembly_lists(rows: DataFrame) -> DataFrame:
    """Assemblies of a call with the offsets of its low and high side, in order of the name."""
    got = rows.groupBy("call_id").agg(F.array_sort(F.collect_set(F.struct("assembly_id", "low", "high"))).alias("a"))
    return got.select("call_id", *[F.array_join(F.col(f"a.{c}").cast("array<string>"), ",").alias(n) for c, n in (("assembly_id", "beid"), ("low", "beidl"), ("high", "beidh"))])


def allele_fraction(var: Column, ref: Column, ref_pair: Column, small: Column) -> Column:
    """Share of the variant; read pairs don't tell small events from the reference."""
    rest = ref + F.when(small, F.lit(0)).otherwise(ref_pair)
    return F.when(var + rest > 0, var / (var + rest)).otherwise(F.lit(0.0))


def reference_support(calls: DataFrame, reads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reads and pairs of each category that span a call's position, the least over its interval.

    ``calls``: call_id, ref, start, end; ``reads``: ref, start, end, category (a read counts at start <= p < end); ``pairs``: ref,
    end1, start2, category (end1 <= p < start2). Depth changes only where a read begins or ends, so the least over an
    interval is taken at its start and at the borders inside.
    """

    def least(spans: DataFrame, name: str) -> DataFrame:
        # spans are closed: start .. end - 1
        own = spans.where(F.col("end") >= F.col("start"))
        cats = F.broadcast(calls_categories(reads, pairs))
        borders = own.select("ref", F.col("start").alias("pos")).unionByName(own.select("ref", (F.col("end") + 1).alias("pos"))).distinct()
        asked = calls.select("call_id", F.col("ref").alias("_ref"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        inside = interval_join(asked, borders.withColumn("_p2", F.col("pos")), [("_ref", "ref")], ("_s", "_e"), ("pos", "_p2"), 1000).select("call_id", F.col("_ref").alias("ref"), "pos")
        points = inside.unionByName(calls.select("call_id", "ref", F.col("start").alias("pos"))).distinct().crossJoin(cats)
        got = depth_at(points, own, ["ref", "category"], "pos", "n")
        return got.groupBy("call_id", "category").agg(F.min("n").cast("long").alias(name))

    a = least(reads.select("ref", "category", "start", (F.col("end") - 1).alias("end")), "ref_reads")
    b = least(pairs.select("ref", "category", F.col("end1").alias("start"), (F.col("start2") - 1).alias("end")), "ref_pairs")
    return a.join(b, ["call_id", "category"], "full").select("call_id", "category", F.coalesce("ref_reads", F.lit(0)).cast("long").alias("ref_reads"), F.coalesce("ref_pairs", F.lit(0)).cast("long").alias("ref_pairs"))


def calls_categories(*frames: DataFrame) -> DataFrame:
    """The samples: as many as there are inputs, a handful."""
    every = frames[0].select("category")
    for f in frames[1:]:
        every = every.unionByName(f.select("category"))
    return every.distinct()
