"""Reads to evidence rows, and their scores.

``reads``: read_name, flag, ref, pos, mapq, cigar (array), seq, sa (text), nm, mate_ref, mate_pos, mate_cigar (array), category. Every kind of evidence is a
projection of a read's own row (and its mate's fields), so no shuffle happens until scores or calls are joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import coords, seq
from ..functions.coords import flag

COLUMNS = ["evidence_id", "kind", "category", "fragment_id", "ref1", "dir1", "start1", "end1", "ref2", "dir2", "start2", "end2", "size", "op", "mapq1", "mapq2", "exact", "strand"]


def _measured(df: DataFrame, cigar: str, prefix: str) -> DataFrame:
    """What a CIGAR tells, once per read, as plain columns: later expressions use them many times."""
    c = F.col(cigar)
    tells = {"start": C.start_clip(c), "end": C.end_clip(c), "soft_start": C.start_clip(c, False), "soft_end": C.end_clip(c, False), "ref": C.reference_length(c), "len": C.read_length(c, True)}
    return df.withColumns({f"{prefix}{k}": v for k, v in tells.items()})


def _offsets(prefix: str, negative: Column) -> tuple[Column, Column]:
    """First and last aligned base, in the order in which the read was sequenced."""
    a, b, n = (F.col(f"{prefix}{k}") for k in ("start", "end", "len"))
    return F.when(negative, b).otherwise(a), n - 1 - F.when(negative, a).otherwise(b)


def _rows(df: DataFrame, e: str) -> DataFrame:
    return df.select(*[F.col(f"{e}.{c}").alias(c) for c in COLUMNS])


def _event(kind: str, ident: Column, ref1, dir1, start1, end1, ref2, dir2, start2, end2, size, op, mapq2, exact=True) -> Column:
    i, s = "int", "string"
    return F.struct(
        ident.alias("evidence_id"), F.lit(kind).alias("kind"), F.col("category").alias("category"), F.col("read_name").alias("fragment_id"),
        ref1.cast(s).alias("ref1"), dir1.cast(s).alias("dir1"), start1.cast(i).alias("start1"), end1.cast(i).alias("end1"),
        ref2.cast(s).alias("ref2"), dir2.cast(s).alias("dir2"), start2.cast(i).alias("start2"), end2.cast(i).alias("end2"),
        size.cast(i).alias("size"), op.cast(s).alias("op"), F.col("mapq").cast(i).alias("mapq1"), mapq2.cast(i).alias("mapq2"), F.lit(exact).alias("exact"),
        F.when(flag(F.col("flag"), 0x10), "-").otherwise("+").alias("strand"),
    )


def _ident(tag: str, *extra: Column) -> Column:
    return seq.evidence_id(F.lit(tag), F.col("read_name"), F.col("flag"), F.col("ref"), F.col("pos"), *extra)


def indels(reads: DataFrame, least: int = 1) -> DataFrame:
    """Two rows per run of indel operators of at least ``least`` bases inside a mapped read: the breakpoint from either side."""
    c = F.col("cigar")
    ok = reads.where(~flag(F.col("flag"), 0x4) & (C.imprecision_width(c) == 0))
    run = ok.select("*", F.explode(F.filter(C.indel_runs(c), lambda r: r["size"] >= least)).alias("r"))
    left, right = F.col("pos") + F.col("r.ref_off") - 1, F.col("pos") + F.col("r.ref_off") + F.col("r.ref_len")
    ids = _ident("IC", F.col("r.read_off"))
    size, op = F.col("r.longest"), F.col("r.longest_op")
    a = _event("IC", F.concat(ids, F.lit("f")), F.col("ref"), F.lit("+"), left, left, F.col("ref"), F.lit("-"), right, right, size, op, F.col("mapq"))
    b = _event("IC", F.concat(ids, F.lit("b")), F.col("ref"), F.lit("-"), right, right, F.col("ref"), F.lit("+"), left, left, size, op, F.col("mapq"))
    return _rows(run.select(F.explode(F.array(a, b)).alias("e")), "e")


def _other_alignments() -> Column:
    """The alignments of SA with their first and last aligned base and their last position, in the order of the first base."""
    parts = F.transform(C.parse_sa(F.col("sa")), lambda a: F.struct(a["rname"].alias("rname"), a["pos"].alias("pos"), (a["strand"] == "-").alias("neg"), C.parse(a["cigar"]).alias("c"), a["mapq"].alias("mapq")))
    return F.transform(parts, lambda a: F.struct(C.first_aligned_offset(a["c"], a["neg"]).alias("first"), C.last_aligned_offset(a["c"], a["neg"]).alias("last"), a["rname"].alias("rname"), a["pos"].alias("pos"), a["neg"].alias("neg"), (a["pos"] + C.reference_length(a["c"]) - 1).alias("end"), a["mapq"].alias("mapq")))


def _leaves(pos: Column, end: Column, negative: Column) -> Column:
    """Where a read goes on after an alignment: struct (dir, pos)."""
    return F.struct(F.when(negative, F.lit("-")).otherwise(F.lit("+")).alias("dir"), F.when(negative, pos).otherwise(end).alias("pos"))


def _enters(pos: Column, end: Column, negative: Column) -> Column:
    return F.struct(F.when(negative, F.lit("+")).otherwise(F.lit("-")).alias("dir"), F.when(negative, end).otherwise(pos).alias("pos"))


def split_reads(reads: DataFrame) -> DataFrame:
    """Up to two rows per alignment: to the nearest alignment of the read before it and after it, in the order of the read's bases."""
    neg = flag(F.col("flag"), 0x10)
    ok = _measured(reads.where(~flag(F.col("flag"), 0x4) & (F.coalesce(F.col("sa"), F.lit("")) != "")), "cigar", "_c_")
    first, last = _offsets("_c_", neg)
    ok = ok.withColumns({"_first": first, "_last": last, "_o": _other_alignments()})
    ok = ok.withColumns({"_pre": F.array_max(F.filter("_o", lambda a: a["first"] < F.col("_first"))), "_post": F.array_min(F.filter("_o", lambda a: a["first"] > F.col("_first")))})
    pos, end = F.col("pos"), F.col("pos") + F.col("_c_ref") - 1

    def side(tag: str, other: str, own: Column, far: Column, overlap: Column) -> Column:
        w = F.greatest(overlap, F.lit(0))

        def bounds(b: Column):
            return b["pos"] - F.when(b["dir"] == "+", w).otherwise(0), b["pos"] + F.when(b["dir"] == "-", w).otherwise(0)

        (s1, e1), (s2, e2) = bounds(own), bounds(far)
        clip = F.col("_first") if tag == "pre" else F.col("_c_len") - 1 - F.col("_last")
        row = _event("SR", _ident("SR", F.lit(tag)), F.col("ref"), own["dir"], s1, e1, F.col(f"{other}.rname"), far["dir"], s2, e2, clip, F.lit("S"), F.col(f"{other}.mapq"))
        return F.when(F.col(other).isNotNull(), row)

    pre = side("pre", "_pre", _enters(pos, end, neg), _leaves(F.col("_pre.pos"), F.col("_pre.end"), F.col("_pre.neg")), F.col("_pre.last") + 1 - F.col("_first"))
    post = side("post", "_post", _leaves(pos, end, neg), _enters(F.col("_post.pos"), F.col("_post.end"), F.col("_post.neg")), F.col("_last") + 1 - F.col("_post.first"))
    return _rows(ok.select(F.explode(F.array_compact(F.array(pre, post))).alias("e")), "e")


def soft_clips(reads: DataFrame, least: int = 1) -> DataFrame:
    """A row per clipped end that no other alignment of the read explains."""
    neg = flag(F.col("flag"), 0x10)
    ok = _measured(reads.where(~flag(F.col("flag"), 0x4)), "cigar", "_c_")
    start, end = F.col("_c_soft_start"), F.col("_c_soft_end")
    ok = ok.where((start >= least) | (end >= least)).withColumn("_f", F.transform(_other_alignments(), lambda a: a["first"]))
    own_first, _ = _offsets("_c_", neg)
    before, after = F.exists("_f", lambda x: x < own_first), F.exists("_f", lambda x: x > own_first)
    explained_start, explained_end = F.when(neg, after).otherwise(before), F.when(neg, before).otherwise(after)
    null, last = F.lit(None), F.col("pos") + F.col("_c_ref") - 1
    a = _event("SC", _ident("SC", F.lit("b")), F.col("ref"), F.lit("-"), F.col("pos"), F.col("pos"), null, null, null, null, start, F.lit("S"), null)
    b = _event("SC", _ident("SC", F.lit("f")), F.col("ref"), F.lit("+"), last, last, null, null, null, null, end, F.lit("S"), null)
    both = F.array_compact(F.array(F.when((start >= least) & ~explained_start, a), F.when((end >= least) & ~explained_end, b)))
    return _rows(ok.select(F.explode(both).alias("e")), "e")


def read_pairs(reads: DataFrame, most: int, concordant: Column) -> DataFrame:
    """Discordant pairs (DP) and mapped reads of an unmapped mate (UM): where the breakend can lie, given the largest fragment ``most``."""
    f = F.col("flag")
    neg, mate_neg = flag(f, 0x10), flag(f, 0x20)
    ok = reads.where(flag(f, 0x1) & ~flag(f, 0x4) & ~flag(f, 0x100) & ~flag(f, 0x800) & ~concordant)
    ok = _measured(_measured(ok, "cigar", "_c_"), "mate_cigar", "_m_")
    mapped = ~flag(f, 0x8)
    end, mate_end = F.col("pos") + F.col("_c_ref") - 1, F.col("mate_pos") + F.col("_m_ref") - 1

    def toward(p: str, back: Column) -> Column:
        return F.when(back, F.col(f"{p}start")).otherwise(F.col(f"{p}end"))

    def interval(p: str, pos: Column, last: Column, back: Column, mate_part: Column) -> tuple[Column, Column]:
        width = F.lit(most) - F.col(f"{p}len") + toward(p, back) - mate_part
        return F.when(back, pos - width).otherwise(last), F.when(back, pos).otherwise(last + width)

    mate_len, own_len = F.col("_m_len") - toward("_m_", mate_neg), F.col("_c_len") - toward("_c_", neg)
    facing = (F.col("ref") == F.col("mate_ref")) & (neg != mate_neg)
    gap = F.when(facing & ~neg & (F.col("mate_pos") > end), F.col("mate_pos") - end - 1).when(facing & neg & (F.col("pos") > mate_end), F.col("pos") - mate_end - 1)
    s1, e1 = interval("_c_", F.col("pos"), end, neg, F.when(mapped, mate_len).otherwise(1))
    s2, e2 = interval("_m_", F.col("mate_pos"), mate_end, mate_neg, own_len)
    # reads that face each other on one contig: no further than the gap between them
    near = gap.isNotNull()
    e1, s1 = F.when(~neg & near, F.least(e1, end + gap)).otherwise(e1), F.when(neg & near, F.greatest(s1, F.col("pos") - gap)).otherwise(s1)
    e2, s2 = F.when(~mate_neg & near, F.least(e2, mate_end + gap)).otherwise(e2), F.when(mate_neg & near, F.greatest(s2, F.col("mate_pos") - gap)).otherwise(s2)
    d1, d2 = F.when(neg, "-").otherwise("+"), F.when(mate_neg, "-").otherwise("+")
    frag = coords.fragment_size(~neg, F.col("pos") - F.col("_c_start"), end + F.col("_c_end"), F.col("mate_pos") - F.col("_m_start"), mate_end + F.col("_m_end"), facing)
    null = F.lit(None)
    dp = _event("RP", _ident("RP"), F.col("ref"), d1, s1, e1, F.col("mate_ref"), d2, s2, e2, frag, null, F.col("mate_mapq"), False)
    um = _event("UM", _ident("UM"), F.col("ref"), d1, s1, e1, null, null, null, null, null, null, null, False)
    row = F.when(mapped & (s1 <= e1) & (s2 <= e2), dp).when(~mapped & (s1 <= e1), um)
    return _rows(ok.select(row.alias("e")).where(F.col("e").isNotNull()), "e")


def all_evidence(reads: DataFrame, most: int, concordant: Column, least_clip: int = 1, least_indel: int = 1) -> DataFrame:
    """Split reads, then clips that they don't explain, then indels, then pairs."""
    return split_reads(reads).unionByName(soft_clips(reads, least_clip)).unionByName(indels(reads, least_indel)).unionByName(read_pairs(reads, most, concordant))


# --- scores: strategies that return a column; the tables they need are joined as columns phred (of the size), phred0 (of size 0) and one_mapped

Score = Callable[[], Column]


def _q2() -> Column:
    return F.coalesce(F.col("mapq2"), F.col("mapq1"))


def score_fast() -> Column:
    """The smallest of the size's phred and the mapping qualities; the default."""
    size = F.when(F.col("kind") == "UM", F.col("one_mapped_phred")).otherwise(F.col("phred"))
    return F.least(size, F.col("mapq1"), _q2()).cast("double")


def score_reference_likelihood() -> Column:
    """Phred of the size being chance or either mapping being wrong."""
    size = F.when(F.col("kind") == "UM", F.col("one_mapped_phred")).otherwise(F.col("phred"))
    two = coords.phred_or(size, F.col("mapq1"), F.col("mapq2"))
    return F.when(F.col("mapq2").isNull() | (F.col("kind") == "IC"), coords.phred_or(size, F.col("mapq1"))).otherwise(two)


def score_llr() -> Column:
    """Log10 of the likelihood ratio of the variant, weighed with the probability that the mappings are right."""
    ref = F.when(F.col("kind") == "UM", F.col("one_mapped")).otherwise(coords.phred_to_pr(F.col("phred")))
    var = F.when(F.col("kind") == "UM", 0.5 * F.col("both_mapped")).when(F.col("kind") == "RP", F.lit(0.5)).otherwise(coords.phred_to_pr(F.col("phred0")))
    one, two = coords.phred_or(F.col("mapq1")), coords.phred_or(F.col("mapq1"), F.col("mapq2"))
    right = 1 - coords.phred_to_pr(F.when(F.col("mapq2").isNull() | (F.col("kind") == "IC"), one).otherwise(two))
    return F.log10((ref + right * (var - ref)) / ref)


def score_mapq() -> Column:
    return F.when(F.col("mapq2").isNull() | (F.col("kind") == "IC"), coords.phred_or(F.col("mapq1"))).otherwise(coords.phred_or(F.col("mapq1"), F.col("mapq2")))


def score_count() -> Column:
    return F.lit(1.0)


def score_by_name(pattern: str) -> Score:
    """The number that the pattern's first group finds in the whole read name; 1 without one."""

    def score() -> Column:
        got = F.regexp_extract(F.col("fragment_id"), f"^(?:{pattern})$", 1)
        return F.when(got == "", 1.0).otherwise(got.cast("double"))

    return score


def excluding(score: Score, kinds: list[str]) -> Score:
    """Another score, 0 for evidence of some kinds."""
    return lambda: F.when(F.col("kind").isin(*kinds), 0.0).otherwise(score())


def assembly_score(pairs: Column, clips: Column, pair_qual: Column, clip_qual: Column, local_mapq: Column, remote_mapq: Column | None = None) -> Column:
    """The supporting reads' quality, but not more than their number times either mapping quality."""
    n = pairs + clips
    caps = [local_mapq * n] + ([remote_mapq * n] if remote_mapq is not None else [])
    return F.least(*caps, pair_qual + clip_qual).cast("double")


MODELS: dict[str, Score] = {"FastEmpiricalReferenceLikelihood": score_fast, "EmpiricalReferenceLikelihood": score_reference_likelihood, "EmpiricalLlr": score_llr, "Mapq": score_mapq, "ReadCount": score_count}


def scored(ev: DataFrame, clip_phred: DataFrame, pair_phred: DataFrame, one_mapped: float, both_mapped: float = 0.0, model: str | Score = "FastEmpiricalReferenceLikelihood") -> DataFrame:
    """``ev`` with ``score`` and ``qs``. ``clip_phred``: op, length, phred; ``pair_phred``: x, phred: tables as long as a read or a fragment."""
    c = F.broadcast(clip_phred.select(F.col("op").alias("_op"), F.col("length").alias("_len"), F.col("phred").alias("_cp")))
    zero = F.broadcast(clip_phred.where(F.col("length") == 0).select(F.col("op").alias("_op0"), F.col("phred").alias("phred0")))
    p = F.broadcast(pair_phred.select(F.col("x").alias("_x"), F.col("phred").alias("_pp")))
    most = pair_phred.agg(F.max("phred").alias("_most"))
    j = ev.join(c, (F.col("op") == F.col("_op")) & (F.col("size") == F.col("_len")), "left").join(zero, F.col("op") == F.col("_op0"), "left")
    j = j.join(p, (F.col("kind") == "RP") & (F.col("size") == F.col("_x")), "left").crossJoin(F.broadcast(most))
    j = j.withColumns({"phred": F.when(F.col("kind") == "RP", F.coalesce("_pp", "_most")).otherwise(F.coalesce("_cp", F.lit(0.0))), "one_mapped": F.lit(one_mapped), "both_mapped": F.lit(both_mapped), "one_mapped_phred": coords.pr_to_phred(F.lit(one_mapped))})
    f = MODELS[model] if isinstance(model, str) else model
    return j.withColumn("score", f()).withColumn("qs", coords.scale_weight(F.col("score"))).select(*ev.columns, "score", "qs")


# --- fragments: tags that need all of a read's alignments

def fragment_tags(reads: DataFrame) -> DataFrame:
    """Reads with tags made anew from their fragment: TC (segments), FI (own segment), R2 and Q2 (mate's bases and quals), MC, MQ, SA.

    ``reads`` also has qual and strand; alignments of one segment share read_name and segment.
    """
    own = reads.withColumn("segment", coords.segment_index(F.col("flag")))
    primary = ~flag(F.col("flag"), 0x100) & ~flag(F.col("flag"), 0x800)
    text = C.render(F.col("cigar"))
    aln = F.struct(F.when(primary, 0).otherwise(1).alias("o"), F.concat_ws(",", F.col("ref").cast("string"), F.col("pos").cast("string"), F.when(flag(F.col("flag"), 0x10), "-").otherwise("+"), text, F.col("mapq").cast("string"), F.coalesce(F.col("nm"), F.lit(0)).cast("string")).alias("t"))
    seg = own.groupBy("read_name", "segment").agg(
        F.array_sort(F.collect_list(F.when(~flag(F.col("flag"), 0x4), aln))).alias("_alns"),
        F.max(F.when(primary, F.struct("seq", "qual", text.alias("cig"), "mapq"))).alias("_primary"),
    )
    n = seg.groupBy("read_name").agg(F.count(F.lit(1)).alias("tc"))
    mate = seg.select(F.col("read_name"), (1 - F.col("segment")).alias("segment"), F.col("_primary").alias("_mate"))
    j = own.join(seg.select("read_name", "segment", "_alns"), ["read_name", "segment"]).join(mate, ["read_name", "segment"], "left").join(n, "read_name")
    sa = F.array_join(F.transform(F.filter("_alns", lambda a: a["t"] != aln["t"]), lambda a: F.concat(a["t"], F.lit(";"))), "")
    return j.withColumns({"fi": F.col("segment"), "r2": F.col("_mate.seq"), "q2": F.col("_mate.qual"), "mc": F.col("_mate.cig"), "mq": F.col("_mate.mapq"), "sa": F.when(flag(F.col("flag"), 0x4), "").otherwise(sa)}).drop("_alns", "_mate", "segment")


def changes(before: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """How many rows differ in each column between two versions of a table."""
    b = before.select(*key, *[F.col(c).alias(f"_b_{c}") for c in columns])
    diff = [F.sum((~F.col(c).eqNullSafe(F.col(f"_b_{c}"))).cast("long")).alias(c) for c in columns]
    wide = after.join(b, key).agg(*diff)
    return wide.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.coalesce(c, F.lit(0)) for c in columns]))).alias("field", "n"))


def sv_reads(reads: DataFrame, keep: Column, pair_keep: Column, concordant: Column, fully_mapped: Column) -> DataFrame:
    """Reads of fragments that may hold a variant: a segment none of whose alignments is whole and one of whose alignments passes
    ``keep``; or a fragment without a concordant pairing, one of whose rows passes ``pair_keep``."""
    own = reads.withColumn("_seg", coords.segment_index(F.col("flag"))).withColumns({"_keep": keep, "_pair": pair_keep, "_conc": concordant, "_full": fully_mapped})
    seg = own.groupBy("read_name", "_seg").agg(F.bool_or("_keep").alias("k"), F.bool_or("_full").alias("f"), F.bool_or("_pair").alias("p"), F.bool_or("_conc").alias("c"))
    frag = seg.groupBy("read_name").agg(F.bool_or("p").alias("fp"), F.bool_or("c").alias("fc"))
    wanted = seg.join(frag, "read_name").where((F.col("k") & ~F.col("f")) | (F.col("fp") & ~F.col("fc"))).select("read_name", "_seg")
    return own.join(wanted, ["read_name", "_seg"], "left_semi").drop("_seg", "_keep", "_pair", "_conc", "_full")


def clips_to_realign(reads: DataFrame, least: int) -> DataFrame:
    """Clipped ends as sequences for an aligner, in the direction of the read: (name, seq), the name telling where they come from."""
    c, neg = F.col("cigar"), flag(F.col("flag"), 0x10)
    a, b = C.start_clip(c, False), C.end_clip(c, False)
    n = F.length("seq")

    def part(off: Column, size: Column) -> Column:
        s = F.substring(F.col("seq"), off + 1, size)
        read_off = F.when(neg, n - off - size).otherwise(off)
        return F.struct(_ident("CL", read_off).alias("name"), F.when(neg, seq.reverse_complement(s)).otherwise(s).alias("seq"))

    both = F.array_compact(F.array(F.when(a >= least, part(F.lit(0), a)), F.when(b >= least, part(n - b, b))))
    return reads.where(~flag(F.col("flag"), 0x4)).select(F.explode(both).alias("x")).select("x.name", "x.seq")


def attach_realigned(reads: DataFrame, aligned: DataFrame) -> DataFrame:
    """Reads with the alignments of their clips (name, ref, pos, strand, cigar, mapq) put into SA; unaligned clips change nothing."""
    names = reads.withColumn("_row", _ident("", F.lit(""))).withColumn("_names", F.array(*[_ident("CL", x) for x in (F.lit(0), F.length("seq") - F.when(flag(F.col("flag"), 0x10), C.start_clip(F.col("cigar"), False)).otherwise(C.end_clip(F.col("cigar"), False)))]))
    each = names.select("_row", F.explode("_names").alias("name")).distinct().join(aligned, "name")
    text = F.concat_ws(",", "ref", F.col("pos").cast("string"), "strand", "cigar", F.col("mapq").cast("string"), F.lit("0"))
    sa = each.groupBy("_row").agg(F.array_join(F.array_sort(F.collect_set(F.concat(text, F.lit(";")))), "").alias("_sa"))
    return names.join(sa, "_row", "left").withColumn("sa", F.concat(F.coalesce("sa", F.lit("")), F.coalesce("_sa", F.lit("")))).drop("_row", "_names", "_sa")
