"""Reads as a table: interval scans, lookups, mates, exclusion, filters of evidence before it is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import coords, seq
from ..functions.coords import flag
from .intervals import interval_join
from .tables import written


def scan_regions(reads: DataFrame, regions: DataFrame, pad: int, exclude: DataFrame | None = None, width: int = 10_000) -> DataFrame:
    """Reads (ref, start, end, ...) that overlap any region (ref, start, end), widened by ``pad`` and less what is excluded. Each read once."""
    from .intervals import subtract

    wide = regions.select("ref", F.greatest(F.col("start") - pad, F.lit(1)).alias("start"), (F.col("end") + pad).alias("end"))
    if exclude is not None:
        wide = subtract(wide, exclude.select("ref", "start", "end"), ["ref"])
    r = wide.select(F.col("ref").alias("_r"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return interval_join(reads, r, [("ref", "_r")], ("start", "end"), ("_s", "_e"), width, "left_semi")


def fragments(reads: DataFrame) -> DataFrame:
    """All alignments of a fragment in one row, by segment, primary first."""
    order = F.struct(coords.segment_index(F.col("flag")).alias("segment"), F.when(flag(F.col("flag"), 0x100) | flag(F.col("flag"), 0x800), 1).otherwise(0).alias("rest"), "ref", "pos", "flag", "mapq")
    return reads.groupBy("read_name").agg(F.array_sort(F.collect_list(order)).alias("alignments"))


def lookup(reads: DataFrame, wanted: DataFrame) -> DataFrame:
    """All alignments of the reads of interest."""
    return reads.join(wanted.select("read_name").distinct(), "read_name", "left_semi")


def missing_from(reads: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one table that the other lacks."""
    return reads.join(other.select(*keys).distinct(), keys, "left_anti")


def joint(*inputs: DataFrame) -> DataFrame:
    """Several inputs as one, each with its number as ``category``."""
    out = inputs[0].withColumn("category", F.lit(0))
    for k, df in enumerate(inputs[1:], 1):
        out = out.unionByName(df.withColumn("category", F.lit(k)))
    return out


def with_mates(reads: DataFrame) -> DataFrame:
    """Primary alignments with their mate's fields, from the table itself: mate_ref, mate_pos, mate_cigar, mate_mapq, mate_seq."""
    own = reads.where(~flag(F.col("flag"), 0x100) & ~flag(F.col("flag"), 0x800)).withColumn("_seg", coords.segment_index(F.col("flag")))
    mate = own.select("read_name", (1 - F.col("_seg")).alias("_seg"), *[F.col(c).alias(f"_m_{c}") for c in ("ref", "pos", "cigar", "mapq", "seq")])
    got = own.join(mate, ["read_name", "_seg"], "left").drop("_seg")
    return got.withColumns({f"mate_{c}": F.col(f"_m_{c}") for c in ("ref", "pos", "cigar", "mapq", "seq")}).drop(*[f"_m_{c}" for c in ("ref", "pos", "cigar", "mapq", "seq")])


def apply_blacklist(reads: DataFrame, exclude: DataFrame, width: int = 10_000) -> DataFrame:
    """Reads that overlap an excluded region count as unmapped, mates that do as unmapped mates, and such alignments leave SA.

    ``reads``: read_id, flag, ref, start, end, mate_ref, mate_start, mate_end, sa.
    """
    x = exclude.select(F.col("ref").alias("_r"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    own = interval_join(reads.select("read_id", F.col("ref").alias("_a"), F.col("start").alias("_b"), F.col("end").alias("_c")), x, [("_a", "_r")], ("_b", "_c"), ("_s", "_e"), width).select("read_id").distinct().withColumn("_own", F.lit(True))
    mate = interval_join(reads.select("read_id", F.col("mate_ref").alias("_a"), F.col("mate_start").alias("_b"), F.col("mate_end").alias("_c")).where("_b is not null"), x, [("_a", "_r")], ("_b", "_c"), ("_s", "_e"), width).select("read_id").distinct().withColumn("_mate", F.lit(True))
    parts = reads.select("read_id", F.posexplode(C.parse_sa(F.col("sa"))).alias("_i", "_x"))
    parts = parts.select("read_id", "_i", F.col("_x.rname").alias("_a"), F.col("_x.pos").alias("_b"), (F.col("_x.pos") + F.greatest(C.reference_length(C.parse(F.col("_x.cigar"))), F.lit(1)) - 1).alias("_c"))
    gone = interval_join(parts, x.withColumn("_r", F.col("_r").cast("string")), [("_a", "_r")], ("_b", "_c"), ("_s", "_e"), width).groupBy("read_id").agg(F.collect_set("_i").alias("_gone"))
    j = reads.join(own, "read_id", "left").join(mate, "read_id", "left").join(gone, "read_id", "left")
    texts = F.filter(F.split(F.coalesce("sa", F.lit("")), ";"), lambda t: t != "")
    kept = F.filter(F.transform(texts, lambda t, i: F.when(F.array_contains("_gone", i), F.lit(None)).otherwise(t)), lambda t: t.isNotNull())
    return (
        j.withColumn("flag", F.col("flag").bitwiseOR(F.when(F.col("_own"), 4).otherwise(0)).bitwiseOR(F.when(F.col("_mate"), 8).otherwise(0)))
        .withColumn("sa", F.when(F.col("_gone").isNull(), F.col("sa")).otherwise(F.array_join(F.transform(kept, lambda t: F.concat(t, F.lit(";"))), "")))
        .drop("_own", "_mate", "_gone")
    )


def usable_evidence(ev: DataFrame, exclude: DataFrame, lengths: DataFrame, width: int = 10_000) -> DataFrame:
    """Evidence that isn't within one base of an excluded region on either side and lies on its contigs."""
    x = exclude.select(F.col("ref").cast("string").alias("_r"), (F.col("start") - 1).alias("_s"), (F.col("end") + 1).alias("_e"))
    bad = None
    for s in ("1", "2"):
        side = ev.where(F.col(f"ref{s}").isNotNull()).select("evidence_id", F.col(f"ref{s}").cast("string").alias("_a"), F.col(f"start{s}").alias("_b"), F.col(f"end{s}").alias("_c"))
        hit = interval_join(side, x, [("_a", "_r")], ("_b", "_c"), ("_s", "_e"), width).select("evidence_id")
        bad = hit if bad is None else bad.unionByName(hit)
    n = F.broadcast(lengths.select(F.col("ref").cast("string").alias("_n"), F.col("length").alias("_len")))
    own = ev.join(n, F.col("ref1").cast("string") == F.col("_n")).where((F.col("start1") >= 1) & (F.col("end1") <= F.col("_len"))).drop("_n", "_len")
    return own.join(bad.distinct(), "evidence_id", "left_anti")


def owned_by_chunk(calls: DataFrame, chunk_size: int) -> DataFrame:
    """Calls with the chunk that owns them: the one in which their lower breakend starts."""
    return calls.withColumn("chunk", F.floor((F.least("start1", "start2") - 1) / chunk_size).cast("long"))


def chromosome_pairs(ev: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Evidence between the given contigs, in either direction."""
    ok = F.lit(False)
    for a, b in pairs:
        x, y = F.col("ref1").cast("string"), F.col("ref2").cast("string")
        ok = ok | ((x == str(a)) & (y == str(b))) | ((x == str(b)) & (y == str(a)))
    return ev.where(ok)


def dedup_evidence(ev: DataFrame) -> DataFrame:
    return ev.dropDuplicates(["evidence_id"])


def merged_in_order(by: list[str], *inputs: DataFrame) -> DataFrame:
    """Several sorted inputs as one, equal keys in order of the inputs."""
    out = None
    for k, df in enumerate(inputs):
        one = df.withColumn("ordinal", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(*by, "ordinal")


ORDERS = {
    "start_end": ["ref1", "start1", "end1"],
    "end_start": ["ref1", "end1", "start1"],
    "start_start2_end_end2": ["ref1", "start1", "ref2", "start2", "end1", "end2"],
    "natural": ["ref1", "start1", "end1", "dir1", "ref2", "start2", "end2", "dir2"],
}


def evidence_order(ev: DataFrame, kind: str = "natural") -> DataFrame:
    return ev.orderBy(*ORDERS[kind], "evidence_id")


def low_high_order(ev: DataFrame) -> DataFrame:
    low = coords.is_low(F.col("ref1"), F.col("start1"), F.col("end1"), F.col("ref2"), F.col("start2"), F.col("end2"))
    return ev.orderBy(*[F.when(low, F.col(f"{c}1")).otherwise(F.col(f"{c}2")) for c in ("ref", "start", "end")], *[F.when(low, F.col(f"{c}2")).otherwise(F.col(f"{c}1")) for c in ("ref", "start", "end")], "evidence_id")


def exact_homology(df: DataFrame, local_ref: str, remote_ref: str, local_read: str, remote_read: str) -> DataFrame:
    """``df`` with hom_left and hom_right: how far the breakpoint can move either way without changing the sequence.

    To the right the remote part of the read equals the local reference beyond the breakpoint; to the left the local part of the read,
    from its end, equals the remote reference before its breakpoint. N equals nothing.
    """
    right = seq.common_prefix(F.translate(F.col(remote_read), "N", "-"), F.col(local_ref))
    left = seq.common_suffix(F.translate(F.col(local_read), "N", "-"), F.col(remote_ref))
    return df.withColumns({"hom_left": left, "hom_right": right})


def widened_by_homology(ev: DataFrame) -> DataFrame:
    """Breakpoint bounds widened by homology (hom_left towards the local anchor, hom_right away from it); the remote side moves with it."""
    s1, e1 = coords.adjust(F.col("start1"), F.col("end1"), F.col("dir1"), F.col("hom_left"), F.col("hom_right"))
    s2, e2 = coords.adjust(F.col("start2"), F.col("end2"), F.col("dir2"), F.col("hom_right"), F.col("hom_left"))
    return ev.withColumns({"start1": s1, "end1": e1, "start2": s2, "end2": e2})


def homology_sequence(read: Column, anchor_end: Column, left: Column, right: Column) -> Column:
    """The bases over which the breakpoint can move: ``left`` before the anchor's end and ``right`` after it."""
    return F.substring(read, anchor_end - left + 1, left + right)


def untemplated_sequence(read: Column, anchor_end: Column, remote_start: Column) -> Column:
    """Bases between the two aligned parts."""
    return F.when(remote_start > anchor_end, F.substring(read, anchor_end + 1, remote_start - anchor_end)).otherwise(F.lit(""))


def anchor_cigar(support: DataFrame) -> DataFrame:
    """A CIGAR per call from the union of its supporting anchors (call_id, dir, start, end): M where any anchor lies, N between, an X at the breakend."""
    from .intervals import _islands

    isl = _islands(support.select("call_id", "dir", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), ["call_id", "dir"], 1, [])
    w = Window.partitionBy("call_id").orderBy("start")
    each = isl.withColumn("_gap", F.col("start") - F.lag("end").over(w) - 1)
    text = F.concat(F.when(F.col("_gap") > 0, F.concat(F.col("_gap").cast("string"), F.lit("N"))).otherwise(""), (F.col("end") - F.col("start") + 1).cast("string"), F.lit("M"))
    got = each.groupBy("call_id", "dir").agg(F.min("start").alias("pos"), F.array_sort(F.collect_list(F.struct("start", text.alias("t")))).alias("x"))
    body = F.array_join(F.col("x.t"), "")
    return got.select("call_id", "pos", F.when(F.col("dir") == "+", F.concat(body, F.lit("1X"))).otherwise(F.concat(F.lit("1X"), body)).alias("cigar"))


def best_repeat(inserts: DataFrame, repeats: DataFrame, width: int = 1000) -> DataFrame:
    """The repeat with the largest overlap of each aligned insert: (call_id, repeat, class, strand, fraction).

    ``inserts``: call_id, ref, start, end of alignments; ``repeats``: ref, start, end, repeat, class, strand.
    """
    # alignments at one place have one best repeat, so places meet; names are numbers in their order, as aggregates of numbers need no sort
    said = ["repeat", "class", "strand"]
    names = written(repeats.select(*said).distinct().orderBy(*said).select(*[F.col(c).alias(f"_{c}") for c in said], F.monotonically_increasing_id().alias("_name")), "repeat-names")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in said]
    own = repeats.join(names, same).groupBy("ref", "start", "end").agg(F.min("_name").alias("_name"))
    place = ["_a", "_b", "_c"]
    each = inserts.select("call_id", F.col("ref").alias("_a"), F.col("start").alias("_b"), F.col("end").alias("_c"))
    wide = coords.overlap_width(F.col("_b"), F.col("_c"), F.col("start"), F.col("end"))

    def meet(left: DataFrame, extra: Column | None = None) -> DataFrame:
        return interval_join(left, own, [("_a", "ref")], ("_b", "_c"), ("start", "end"), width, extra=extra)

    most = meet(each.select(*place).distinct()).groupBy(*place).agg(F.max(wide).alias("_most"))
    first = meet(most, wide == F.col("_most")).groupBy(*place, "_most").agg(F.min("_name").alias("_name"))
    part = F.col("_most") / (F.col("_c") - F.col("_b") + 1)
    best = each.join(first, place).groupBy("call_id").agg(F.min(F.struct((-part).alias("n"), "_name")).alias("x"))
    got = best.join(names, F.col("x._name") == F.col("_name"))
    return got.select("call_id", *[F.col(f"_{c}").alias(c) for c in said], (-F.col("x.n")).alias("fraction"))


def with_alignments(calls: DataFrame, aligned: DataFrame, mode: str = "APPEND") -> DataFrame:
    """Calls with alignments of their inserted sequence (call_id, aln). APPEND adds to what is there, REPLACE drops it, ADD_MISSING fills only what is empty, SKIP changes nothing."""
    if mode == "SKIP":
        return calls
    new = aligned.groupBy("call_id").agg(F.array_sort(F.collect_set("aln")).alias("_new"))
    j = calls.join(new, "call_id", "left")
    old, got = F.coalesce("bealn", F.array().cast("array<string>")), F.coalesce("_new", F.array().cast("array<string>"))
    value = {"REPLACE": got, "APPEND": F.array_distinct(F.concat(old, got)), "ADD_MISSING": F.when(F.size(old) > 0, old).otherwise(got)}[mode]
    return j.withColumn("bealn", value).drop("_new")


def breakpoint_strand_bias(support: DataFrame) -> DataFrame:
    """Share of forward reads per call, weighted by reads (call_id, bias, reads); null without reads."""
    n = F.sum("reads")
    return support.groupBy("call_id").agg(F.when(n > 0, F.sum(F.col("bias") * F.col("reads")) / n).alias("sb"))


def sample_sums(genotypes: DataFrame, columns: list[str], samples: list[int]) -> DataFrame:
    """Sums over some samples per call."""
    ok = F.col("category").isin(*samples)
    return genotypes.groupBy("call_id").agg(*[F.sum(F.when(ok, F.col(c)).otherwise(0)).cast("long").alias(c) for c in columns])


def reads_to_bedpe(ev: DataFrame, least_size: int = 50, least_mapq: int = 0) -> DataFrame:
    """Split reads and indels of at least ``least_size`` as BEDPE lines, once each."""
    size = coords.event_size(F.col("ref1"), F.col("dir1"), F.col("start1"), F.col("ref2"), F.col("dir2"), F.col("start2"))
    low = coords.is_low(F.col("ref1"), F.col("start1"), F.col("end1"), F.col("ref2"), F.col("start2"), F.col("end2"))
    ok = F.col("kind").isin("SR", "IC") & low & (size.isNull() | (size >= least_size)) & (F.least("mapq1", "mapq2") >= least_mapq)
    t = [F.col("ref1").cast("string"), (F.col("start1") - 1).cast("string"), F.col("end1").cast("string"), F.col("ref2").cast("string"), (F.col("start2") - 1).cast("string"), F.col("end2").cast("string"), F.col("fragment_id").cast("string"), F.least("mapq1", "mapq2").cast("string"), F.col("dir1"), F.col("dir2")]
    return ev.where(ok).select(F.concat_ws("\t", *t).alias("value"))


def evidence_csv(ev: DataFrame, columns: list[str]) -> DataFrame:
    return ev.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))
