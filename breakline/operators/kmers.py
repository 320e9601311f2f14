"""K-mers of reads and their graph, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import is_ambiguous, kmer_code


#: Bases of a piece; a substring costs its offset, so k-mers are cut from short pieces and never from a whole sequence.
PIECE = 64


def kmer_rows(seqs: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, off, kmer) of all unambiguous k-mers.

    Offsets are exploded and the k-mers cut by a plain projection, which is compiled; a lambda over an array is interpreted.
    """
    starts = F.when(F.length("seq") >= k, F.sequence(F.lit(0), F.length("seq") - k, F.lit(PIECE)))
    pieces = seqs.select(*keep, "seq", F.explode(starts).alias("_o"))
    pieces = pieces.select(*keep, "_o", F.substring(F.col("seq"), F.col("_o") + 1, F.lit(PIECE + k - 1)).alias("_p"))
    pieces = pieces.select(*keep, "_o", "_p", is_ambiguous(F.col("_p")).alias("_a"))
    rows = pieces.select(*keep, "_o", "_p", "_a", F.explode(F.sequence(F.lit(0), F.length("_p") - k)).alias("_i"))
    rows = rows.select(*keep, (F.col("_o") + F.col("_i")).alias("off"), F.substring(F.col("_p"), F.col("_i") + 1, F.lit(k)).alias("kmer"), "_a")
    return rows.where(~(F.col("_a") & is_ambiguous(F.col("kmer")))).drop("_a")


def count_kmers(seqs: DataFrame, k: int, per_read: bool = False, read: str = "read") -> DataFrame:
    """(kmer, n); ``per_read`` counts a k-mer once in each read. Counts are summed before the shuffle."""
    rows = kmer_rows(seqs, k, (read,) if per_read else ())
    if per_read:
        rows = rows.select(read, "kmer").distinct()
    return rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def support_nodes(seqs: DataFrame, k: int) -> DataFrame:
    """Reads (evidence_id, seq, start, end: interval of the first base, weight, anchored) to k-mers with the interval of their position.

    A read whose place is an interval drops k-mers that occur in it twice, as they would follow themselves.
    """
    rows = kmer_rows(seqs, k, ("evidence_id", "start", "end", "weight", "anchored")).withColumn("code", kmer_code(F.col("kmer")))
    n = F.count(F.lit(1)).over(Window.partitionBy("evidence_id", "code"))
    rows = rows.withColumn("_n", n).where((F.col("start") == F.col("end")) | (F.col("_n") == 1))
    return rows.select("evidence_id", "off", "kmer", "code", (F.col("start") + F.col("off")).alias("start"), (F.col("end") + F.col("off")).alias("end"), "weight", F.col("anchored").alias("is_ref"))


def aggregate_nodes(nodes: DataFrame) -> DataFrame:
    """Support summed per k-mer over stretches of positions where it doesn't change: (code, start, end, weight, is_ref)."""
    ref = F.col("is_ref").cast("long")
    up = nodes.select("code", F.col("start").alias("pos"), F.col("weight").cast("long").alias("d"), ref.alias("r"), F.lit(1).alias("c"))
    down = nodes.select("code", (F.col("end") + 1).alias("pos"), (-F.col("weight")).cast("long").alias("d"), (-ref).alias("r"), F.lit(-1).alias("c"))
    steps = up.unionByName(down).groupBy("code", "pos").agg(F.sum("d").alias("d"), F.sum("r").alias("r"), F.sum("c").alias("c"))
    w = Window.partitionBy("code").orderBy("pos")
    run = steps.select("code", F.col("pos").alias("start"), (F.lead("pos").over(w) - 1).alias("end"), F.sum("d").over(w).alias("weight"), (F.sum("r").over(w) > 0).alias("is_ref"), F.sum("c").over(w).alias("_c"))
    return run.where((F.col("_c") > 0) & F.col("end").isNotNull()).drop("_c")


def adjacency(nodes: DataFrame, k: int) -> DataFrame:
    """Pairs of nodes (kmer, start, end) where the second goes on by one base at the next position: equal k-1 bases and overlapping places."""
    a = nodes.select(F.col("kmer").alias("a_kmer"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.substring("kmer", 2, k - 1).alias("mid"))
    b = nodes.select(F.col("kmer").alias("b_kmer"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.substring("kmer", 1, k - 1).alias("mid"))
    return a.join(b, "mid").where((F.col("a_start") + 1 <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end") + 1)).drop("mid")


def read_overlaps(seqs: DataFrame, k: int, least: int, most_mismatch: int = 0) -> DataFrame:
    """Suffix-prefix overlaps of reads (read, seq): the prefix seed of one is looked up in the other, then the whole overlap is compared."""
    seeds = seqs.where(F.length("seq") >= k).select(F.col("read").alias("b"), F.col("seq").alias("b_seq"), F.substring("seq", 1, k).alias("kmer"))
    spots = kmer_rows(seqs, k, ("read",)).where(F.col("off") > 0).select(F.col("read").alias("a"), "off", "kmer")
    # sequences follow the few spots that meet a seed, not all of them
    pairs = spots.join(seeds, "kmer").where(F.col("a") != F.col("b")).join(seqs.select(F.col("read").alias("a"), F.col("seq").alias("a_seq")), "a")
    n = F.length("a_seq") - F.col("off")
    pairs = pairs.withColumn("len", n).where((F.col("len") >= least) & (F.col("len") <= F.length("b_seq")))
    x, y = F.substring(F.col("a_seq"), F.col("off") + 1, F.col("len")), F.substring(F.col("b_seq"), F.lit(1), F.col("len"))
    same = x == y if most_mismatch == 0 else F.size(F.filter(F.sequence(F.lit(1), F.col("len")), lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1)))) <= most_mismatch
    return pairs.where(same).select("a", "b", "off", F.col("len").cast("int").alias("len")).distinct()


def transitive_reduction(edges: DataFrame) -> DataFrame:
    """Overlap edges (a, b, off) without those that two others explain: a to c to b with offsets that add up."""
    one = edges.select("a", F.col("b").alias("c"), F.col("off").alias("o1"))
    two = edges.select(F.col("a").alias("c"), "b", F.col("off").alias("o2"))
    explained = one.join(two, "c").where(F.col("a") != F.col("b")).select("a", "b", (F.col("o1") + F.col("o2")).alias("off")).distinct()
    return edges.join(explained, ["a", "b", "off"], "left_anti")


def corrections(counts: DataFrame, multiple: int = 10) -> DataFrame:
    """K-mers (kmer, n) to what replaces them: a neighbour at one base with at least ``multiple`` times the count, the most frequent, then the smallest.

    Neighbours meet by their sequence with one base blanked, so each k-mer sends k rows and never meets all others.
    """
    k = F.length("kmer")
    blanks = F.transform(F.sequence(F.lit(1), k), lambda i: F.concat(F.substring(F.col("kmer"), F.lit(1), i - 1), F.lit("."), F.substring(F.col("kmer"), i + 1, k)))
    each = counts.select("kmer", "n", F.explode(blanks).alias("blank"))
    # of each blank only the most frequent can replace, and the runner-up the most frequent itself
    best = each.groupBy("blank").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("kmer").alias("to"))).alias("b"))
    pairs = each.join(best, "blank").where((F.col("b.to") != F.col("kmer")) & (-F.col("b.m") >= F.col("n") * multiple))
    got = pairs.groupBy("kmer").agg(F.min("b").alias("b"))
    return got.select("kmer", F.col("b.to").alias("to"), (-F.col("b.m")).alias("n_to"))
