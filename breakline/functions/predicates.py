"""Filters as boolean columns, with the default thresholds of the engine's configuration."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import seq
from .cigar import end_clip, has_large_indel, start_clip
from .coords import flag


def any_of(*keep: Column) -> Column:
    """Keep what any filter keeps."""
    return functools.reduce(operator.or_, keep)


def is_clipped(cigar: Column, least: int = 1) -> Column:
    return (start_clip(cigar) >= least) | (end_clip(cigar) >= least)


def is_split(sa: Column) -> Column:
    return F.coalesce(sa, F.lit("")) != ""


def has_indel(cigar: Column, least: int = 1) -> Column:
    return has_large_indel(cigar, least)


def one_end_anchored(flags: Column) -> Column:
    return flag(flags, 0x1) & (flag(flags, 0x4) != flag(flags, 0x8))


def concordant_fixed(flags: Column, same_ref: Column, size: Column, least: int, most: int) -> Column:
    """Both mapped to one contig on opposite strands with a fragment size in range."""
    both = flag(flags, 0x1) & ~flag(flags, 0x4) & ~flag(flags, 0x8)
    return both & same_ref & (flag(flags, 0x10) != flag(flags, 0x20)) & size.between(least, most)


def concordant_flag(flags: Column) -> Column:
    return flag(flags, 0x1) & flag(flags, 0x2)


def concordance(flags: Column, same_ref: Column, size: Column, fixed: tuple[int, int] | None = None, percent_bounds: tuple[int, int] | None = None, limit: int = 200_000) -> Column:
    """The first that is given of: fixed bounds, bounds from a percentage of the distribution, the aligner's flag; never beyond ``limit``."""
    if fixed:
        kind = concordant_fixed(flags, same_ref, size, *fixed)
    elif percent_bounds:
        kind = concordant_fixed(flags, same_ref, size, *percent_bounds)
    else:
        kind = concordant_flag(flags)
    return kind & (F.abs(size) <= limit)


def usable_read(flags: Column, mapq: Column, interesting: Column, concordant: Column, least_mapq: int = 20) -> Column:
    """Mapped, unique enough, no duplicate, and either clipped or with an indel, or of a pair that isn't concordant."""
    pair = flag(flags, 0x1) & ~concordant
    return ~flag(flags, 0x4) & (mapq >= least_mapq) & ~flag(flags, 0x400) & (interesting | pair)


def within_contig(start: Column, end: Column, length: Column) -> Column:
    return (start >= 1) & (end <= length) & (start <= end)


def usable_clip(length: Column, mean_quality: Column, identity: Column, anchor_entropy: Column, adapter: Column) -> Column:
    return (length >= 5) & (mean_quality >= 5) & (identity >= 0.95) & (anchor_entropy >= 0.5) & ~adapter


def usable_pair(supplementary: Column, anchor_entropy: Column, mapq: Column, dovetail: Column, adapter: Column, concordant: Column, separation: Column, same_read: Column) -> Column:
    return ~supplementary & (anchor_entropy >= 0.5) & (mapq >= 20) & ~dovetail & ~adapter & ~concordant & (separation >= 0) & ~same_read


def passes_hard_filter(qual: Column, imprecise: Column, maybe_deletion: Column, least: float = 50) -> Column:
    """What is annotated at all: enough quality, and no imprecise call that may be a small deletion."""
    return (qual >= least) & ~(imprecise & maybe_deletion)


def _named(*pairs: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs]))


def breakpoint_filters(event_size: Column, could_be_ref: Column, qual: Column, fragments: Column, assemblies: Column, least_size: int = 10, least_score: float = 50, least_reads: int = 2) -> Column:
    return _named(
        ("SMALL_EVENT", F.coalesce(event_size < least_size, F.lit(False))),
        ("REF", could_be_ref),
        ("INSUFFICIENT_SUPPORT", qual < least_score),
        ("SINGLE_SUPPORT", fragments < least_reads),
        ("NO_ASSEMBLY", assemblies == 0),
    )


def breakend_filters(qual: Column, fragments: Column, assemblies: Column, least_score: float = 50, least_reads: int = 2) -> Column:
    return _named(("NO_ASSEMBLY", assemblies == 0), ("INSUFFICIENT_SUPPORT", qual < least_score), ("SINGLE_SUPPORT", fragments < least_reads))


def breakpoint_confidence(local: Column, remote: Column, direct: Column, qual: Column, low: float = 500) -> Column:
    """Counts of assemblies on this side and the other, and of direct support."""
    none = (local == 0) & (remote == 0)
    single = ~none & ((local == 0) | (remote == 0))
    only = ~none & ~single & (direct == 0)
    return _named(("NO_ASSEMBLY", none), ("SINGLE_ASSEMBLY", single), ("ASSEMBLY_ONLY", only), ("LOW_QUAL", qual < low))


def breakend_confidence(assemblies: Column, qual: Column, assembly_qual: Column, direct_qual: Column, clips: Column, pairs: Column, low: float = 1500, bias: float = 0.5) -> Column:
    total = assembly_qual + direct_qual
    lean = F.when(total > 0, F.abs(assembly_qual - direct_qual) / total).otherwise(F.lit(0.0))
    return _named(("NO_ASSEMBLY", assemblies == 0), ("LOW_QUAL", qual < low), ("ASSEMBLY_BIAS", lean > bias), ("NO_SR", clips == 0), ("NO_RP", pairs == 0))


def survives_allocation(filters: Column, qual: Column, fragments: Column, write_filtered: bool = False, least_score: float = 50, least_reads: int = 2) -> Column:
    return F.lit(True) if write_filtered else (F.size(filters) == 0) & (qual >= least_score) & (fragments >= least_reads)


def passes(filters: Column) -> Column:
    return (F.size(filters) == 0) | F.array_contains(filters, "PASS")


def usable_assembly(breakends: Column, breakend_length: Column, fragment: Column, fragments: Column, anchored: Column, read_length: Column, multiple: float = 1.5, least: int = 3) -> Column:
    return (breakends > 0) & (breakend_length <= fragment * multiple) & (fragments >= least) & (anchored | (breakend_length > read_length))


def normal_counts(genotype_qual: Column, genotype_bq: Column, imprecise: Column, least_qual: float = 75, least_bq: float = 428) -> Column:
    """Whether a normal sample supports a call for the panel of normals."""
    return ~imprecise & ((genotype_qual >= least_qual) | ((genotype_qual == 0) & (genotype_bq >= least_bq)))


# --- somatic filters: columns per call, sums over the normal (n_) and over all (t_ tumour) samples

SHORT_EVENT = 1000


def is_short_deldup(c) -> Column:
    return c("is_bp") & (c("dir1") != c("dir2")) & (c("ref1") == c("ref2")) & (F.abs(c("start1") - c("start2")) < SHORT_EVENT)


def is_short_dup(c) -> Column:
    first = ((c("start1") <= c("start2")) & (c("dir1") == "-")) | ((c("start1") >= c("start2")) & (c("dir1") == "+"))
    return is_short_deldup(c) & first


def event_type(c) -> Column:
    """BE, ITX, INS, INV, DEL, DUP, in this precedence."""
    gap = F.abs(c("start1") - c("start2"))
    forwards = (c("start1") < c("start2")) != (c("dir1") == "-")
    return (
        F.when(~c("is_bp"), "BE").when(c("ref1") != c("ref2"), "ITX").when(c("ins_len") >= gap * 0.7, "INS").when(c("dir1") == c("dir2"), "INV").when(forwards, "DEL").otherwise("DUP")
    )


def ligation_artefact(c, least: int = 100, most: int = 800, homology: int = 6) -> Column:
    return (event_type(c) == "DEL") & F.abs(c("start1") - c("start2")).between(least, most) & (c("ihomlen") >= homology)


def small_inversion(c, homology: int = 6, most: int = 40) -> Column:
    return (event_type(c) == "INV") & (F.abs(c("start1") - c("start2")) <= most) & (c("homlen") >= homology)


def too_small(c, least: int = 8) -> Column:
    size = F.abs(c("start1") - c("start2")) + c("ins_len") + F.when(event_type(c).isin("DEL", "INS"), -1).otherwise(1)
    return event_type(c).isin("DEL", "DUP", "INS") & (size < least)


def replacement_artefact(c, ref_seq: Column, ins_seq: Column, delta: int = 5, least_edit: float = 0.5, most_inverted: float = 0.2) -> Column:
    """A short deletion replaced by as many bases, unless these are the inverted deletion."""
    n = F.greatest(F.length(ins_seq), F.lit(1))
    forward, inverted = F.levenshtein(ins_seq, ref_seq) / n, F.levenshtein(ins_seq, seq.reverse_complement(ref_seq)) / n
    wanted = is_short_deldup(c) & ~is_short_dup(c) & (F.abs(F.abs(c("start1") - c("start2")) - F.length(ins_seq)) < delta)
    return wanted & ~((forward > least_edit) & (inverted < most_inverted))


def somatic_breakpoint_filters(c, in_pon: Column, has_no_assembly: Column, ref_seq: Column | None = None, ins_seq: Column | None = None) -> Column:
    """Names of the filters that a call fails. The replaced reference and the inserted sequence, where known, tell replacement artefacts."""
    short = is_short_deldup(c)
    bias = F.greatest(c("sb"), 1 - c("sb"))
    replaced = F.coalesce(replacement_artefact(c, ref_seq, ins_seq), F.lit(False)) if ref_seq is not None and ins_seq is not None else F.lit(False)
    return _named(
        ("PON", in_pon),
        ("strand_bias", c("sb").isNotNull() & short & (bias > 0.95)),
        ("af", c("t_af") < 0.005),
        ("minRead", c("n_rp") + c("t_rp") + c("n_sr") + c("t_sr") < 1),
        ("noAssembly", has_no_assembly & (c("n_vf") + c("t_vf") < 100)),
        ("homlen", c("homlen") > 50),
        ("ihomlen", (c("ihomlen") > 50) & ~is_short_dup(c)),
        ("largeNoRP", ~short & (c("n_rp") + c("t_rp") + c("n_asrp") + c("t_asrp") == 0)),
        ("smallNoSR", short & (c("n_sr") + c("t_sr") == 0)),
        ("small.del.ligation.fp", ligation_artefact(c)),
        ("small.inv.hom.fp", small_inversion(c)),
        ("small.replacement.fp", replaced),
        ("cohortMinSize", too_small(c)),
        ("normalSupport", c("n_vf") > 0.03 * c("t_vf")),
        ("SRNormalSupport", short & (c("n_sr") != 0)),
        ("normalCoverage", c("n_ref") + c("n_refpair") + c("n_vf") < 8),
    )


def somatic_breakend_filters(c, in_pon: Column, has_no_assembly: Column, ins_seq: Column) -> Column:
    return _named(
        ("PON", in_pon),
        ("af", c("t_af") < 0.005),
        ("imprecise", c("imprecise")),
        ("NO_ASSEMBLY", has_no_assembly),
        ("NoAssembledRP", c("basrp") == 0),
        ("LongPolyC", seq.poly_run(ins_seq)),
        ("normalSupport", c("n_bvf") > 0.03 * c("t_bvf")),
        ("normalCoverage", c("n_ref") + c("n_refpair") + c("n_bvf") < 8),
    )


VERY_HARD = ("normalSupport", "SRNormalSupport")
SOFT = ("PON",)


def passes_very_hard(filters: Column) -> Column:
    return ~F.arrays_overlap(filters, F.array(*map(F.lit, VERY_HARD)))


def passes_soft(filters: Column) -> Column:
    return F.size(F.array_except(filters, F.array(*map(F.lit, (*SOFT, "PASS"))))) == 0


def passes_final(filters: Column, qual: Column, is_bp: Column, least: float = 350, breakend_multiple: float = 1000 / 350) -> Column:
    return passes(filters) & (qual >= F.when(is_bp, least).otherwise(least * breakend_multiple))


def somatic_llr(n_ref: Column, n_var: Column, is_bp: Column, contamination: float = 0.03, ploidy: int = 2) -> Column:
    """Log-likelihood ratio of contamination against a germline heterozygote; the binomial coefficients cancel."""
    het = F.when(is_bp, 1 / (1 + 2 * (ploidy - 1))).otherwise(1 / ploidy)
    c = F.lit(contamination)
    return n_var * F.ln(c / het) + n_ref * F.ln((1 - c) / (1 - het))


def shadow(short_event: Column, overlap_qual: Column, qual: Column, anrpq: Column, asq: Column, multiple: float = 3) -> Column:
    return ~short_event & (overlap_qual > multiple * qual) & (anrpq + anrpq > asq)

