"""Taxonomy: closure of the tree, ranking of taxa, filtering of per-read classifications, best reference contigs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written


def closure(nodes: DataFrame) -> DataFrame:
    """All (taxid, ancestor, steps), each taxon its own ancestor at 0 steps. ``nodes``: taxid, parent, the root its own parent.

    Pairs double their reach in each round until a round finds no more, so a tree of depth d takes log2(d) + 1 joins. Rounds are written.
    """
    edges = nodes.where(F.col("taxid") != F.col("parent"))
    reach = nodes.select("taxid", F.col("taxid").alias("ancestor"), F.lit(0).alias("steps")).unionByName(edges.select("taxid", F.col("parent").alias("ancestor"), F.lit(1).alias("steps")))
    reach = written(reach.groupBy("taxid", "ancestor").agg(F.min("steps").alias("steps")), "closure")
    n = reach.count()
    while True:
        far = reach.select(F.col("taxid").alias("ancestor"), F.col("ancestor").alias("_up"), F.col("steps").alias("_more"))
        reach = written(reach.join(far, "ancestor").groupBy("taxid", F.col("_up").alias("ancestor")).agg(F.min(F.col("steps") + F.col("_more")).alias("steps")), "closure")
        if (found := reach.count()) == n:
            return reach
        n = found


def descendants(nodes: DataFrame, roots: list[int]) -> DataFrame:
    """Taxa at or below any of the roots."""
    return closure(nodes).where(F.col("ancestor").isin(*roots)).select("taxid").distinct()


def tree_sums(direct: DataFrame, nodes: DataFrame) -> DataFrame:
    """Reads of each taxon and all below it (direct: taxid, reads)."""
    return direct.join(closure(nodes), "taxid").groupBy(F.col("ancestor").alias("taxid")).agg(F.sum("reads").cast("long").alias("tree_reads"))


def rank_taxa(report: DataFrame, nodes: DataFrame, level: str, least_reads: int, per_group: int, most: int) -> DataFrame:
    """The best taxa, no more than ``per_group`` below one ancestor at ``level``: (taxid, group, tree_reads, direct_reads).

    ``report``: taxid, tree_reads, direct_reads, has_sequence; ``nodes`` has ``rank``. A taxon without such an ancestor is its own group.
    """
    up = closure(nodes).join(nodes.select(F.col("taxid").alias("ancestor"), "rank"), "ancestor").where(F.col("rank") == level)
    group = up.groupBy("taxid").agg(F.min_by("ancestor", F.struct("steps", "ancestor")).alias("group"))
    ok = report.where(F.col("has_sequence") & (F.col("tree_reads") >= least_reads)).join(group, "taxid", "left").withColumn("group", F.coalesce("group", "taxid"))
    order = [F.desc("direct_reads"), F.desc("tree_reads"), F.asc("taxid")]
    inside = ok.withColumn("_r", F.row_number().over(Window.partitionBy("group").orderBy(*order))).where(F.col("_r") <= per_group).drop("_r")
    return inside.orderBy(*order).limit(most).select("taxid", "group", "tree_reads", "direct_reads")


def first_source(found: DataFrame) -> DataFrame:
    """The sequence of each taxon from the first reference that has one (taxid, source_order, seq_id); in it the smallest name."""
    return found.groupBy("taxid").agg(F.min(F.struct("source_order", "seq_id")).alias("b")).select("taxid", "b.source_order", "b.seq_id")


def keep_classified(reads: DataFrame, wanted: DataFrame, neutral: DataFrame) -> DataFrame:
    """Reads to keep: the overall taxon is wanted, or from either end of a k-mer list a wanted taxon comes before any that isn't wanted or neutral.

    ``reads``: read, taxid, kmers array<struct<taxid, count>>; ``neutral``: ancestors of the wanted taxa (and ids for ambiguous).
    """
    kinds = wanted.select("taxid", F.lit(1).alias("good")).unionByName(neutral.select("taxid", F.lit(0).alias("good"))).groupBy("taxid").agg(F.max("good").alias("good"))
    each = reads.select("read", F.posexplode("kmers").alias("pos", "k")).select("read", "pos", F.col("k.taxid").alias("taxid")).join(kinds, "taxid", "left")
    good, bad = F.col("good") == 1, F.col("good").isNull()
    ends = each.groupBy("read").agg(F.min(F.when(good, F.col("pos"))).alias("g1"), F.min(F.when(bad, F.col("pos"))).alias("b1"), F.max(F.when(good, F.col("pos"))).alias("g2"), F.max(F.when(bad, F.col("pos"))).alias("b2"))
    either = F.col("g1").isNotNull() & (F.col("b1").isNull() | (F.col("g1") < F.col("b1")) | (F.col("g2") > F.col("b2")))
    by_list = ends.where(either).select("read")
    by_taxon = reads.join(wanted, "taxid", "left_semi").select("read")
    return by_list.unionByName(by_taxon).distinct()


def contig_hits(reads: DataFrame, contigs: DataFrame, k: int, stride: int) -> DataFrame:
    """K-mers of reads that equal a sampled k-mer of a contig or its reverse complement: (contig, hits). Each contig counts a k-mer once per occurrence in the reads.

    ``reads``: seq; ``contigs``: contig, seq. Equal k-mers of the reads are counted before they meet the contigs.
    """
    from ..functions.seq import reverse_complement
    from .kmers import kmer_rows

    ref = kmer_rows(contigs, k, ("contig",)).where(F.col("off") % stride == 0).select("contig", "kmer")
    ref = ref.unionByName(ref.select("contig", reverse_complement(F.col("kmer")).alias("kmer"))).distinct()
    asked = kmer_rows(reads, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(ref, "kmer").groupBy("contig").agg(F.sum("n").cast("long").alias("hits"))


def best_contigs(hits: DataFrame, taxa: DataFrame, per_taxon: int) -> DataFrame:
    """The contigs with most hits of each taxon (taxa: contig, taxid)."""
    w = Window.partitionBy("taxid").orderBy(F.desc("hits"), "contig")
    return hits.join(taxa, "contig").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_taxon)


def with_classification(calls: DataFrame, classified: DataFrame) -> DataFrame:
    """Calls with the taxon of their inserted sequence (call_id, taxid)."""
    return calls.join(classified.select("call_id", F.col("taxid").alias("instaxid")), "call_id", "left")


def host_pairs(calls: DataFrame, taxids: list[int], host_overlap: Column, repeat_overlap: Column, least_host: float = 0.5, most_repeat: float = 1.0) -> DataFrame:
    """Single breakends of the wanted viruses whose insert lies in the host, as two linked rows."""
    ok = F.col("is_single") & F.col("taxid").isin(*taxids) & (host_overlap >= least_host) & (repeat_overlap <= most_repeat)
    both = calls.where(ok).withColumn("side", F.explode(F.array(F.lit("v"), F.lit("h"))))
    return both.withColumn("id", F.concat("call_id", F.lit("_"), "side")).withColumn("mate_id", F.concat("call_id", F.lit("_"), F.when(F.col("side") == "v", "h").otherwise("v")))
