"""The programs: what a user runs, as functions from tables to tables. Each composes operators and leaves execution to one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import coords
from ..functions import predicates as P
from ..operators import allocate, annotate, assembly, calling, evidence, intervals, kmers, links, metrics, pon, reads, taxonomy
from ..operators.tables import written
from ..sources import sinks
from ..sources.config import Config


def collect_metrics(rows: DataFrame) -> dict[str, DataFrame]:
    """All metric tables of a read table; they share one scan if the caller caches it."""
    hist = rows.where(coords.flag(F.col("flag"), 0x2) & (F.col("fragment") > 0)).groupBy(F.col("fragment").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    cig = metrics.cigar_histogram(rows)
    return {"library": metrics.library_counters(rows), "cigar": cig, "clip_phred": metrics.tail_phred(cig), "mapq": metrics.mapq_metrics(rows), "tags": metrics.tag_counts(rows), "insert_size": hist}


def extract_sv_reads(rows: DataFrame, config: Config | None = None) -> DataFrame:
    config = config or Config()
    conc = P.concordant_flag(F.col("flag"))
    keep = P.any_of(P.is_clipped(F.col("cigar"), config.soft_clip.min_length), P.has_indel(F.col("cigar"), config.calling.min_size), P.is_split(F.col("sa")))
    pair = P.any_of(P.one_end_anchored(F.col("flag")), coords.flag(F.col("flag"), 0x1) & ~conc)
    whole = ~P.is_clipped(F.col("cigar")) & ~P.has_indel(F.col("cigar"))
    return evidence.sv_reads(rows, keep, pair, conc, whole)


def extract_evidence(rows: DataFrame, most_fragment: int, tables: dict[str, DataFrame], one_mapped: float, config: Config | None = None) -> DataFrame:
    """Scored evidence of usable reads."""
    config = config or Config()
    conc = P.concordant_flag(F.col("flag"))
    interesting = P.any_of(P.is_clipped(F.col("cigar")), P.has_indel(F.col("cigar")))
    ok = rows.where(P.usable_read(F.col("flag"), F.col("mapq"), interesting, conc, config.min_mapq))
    ev = evidence.all_evidence(ok, most_fragment, conc, config.soft_clip.min_length, config.calling.min_size)
    pairs = metrics.read_pair_phred(tables["insert_size"], tables["library"].first()["pairs_both_mapped"] or 1)
    return evidence.scored(ev, tables["clip_phred"], pairs, one_mapped, model=config.scoring_model)


def identify_variants(ev: DataFrame, bin_width: int, config: Config | None = None) -> DataFrame:
    """Raw breakpoint calls: maximal cliques with enough quality that aren't imprecise small deletions."""
    config = config or Config()
    c = calling.maximal_cliques(calling.merge_boxes(calling.low_side(ev.where(F.col("ref2").isNotNull())), F.col("exact")), bin_width)
    maybe = coords.could_be_deletion(*[F.col(k) for k in ("ref1", "dir1", "start1", "end1", "ref2", "dir2", "start2", "end2")], 0, config.calling.ignore_missing_deletions)
    return c.where(P.passes_hard_filter(coords.unscale_weight(F.col("weight")), F.col("exact_weight") == 0, maybe, config.calling.min_score))


def identify_breakends(ev: DataFrame) -> DataFrame:
    """Raw single-breakend calls."""
    one = ev.where(F.col("ref2").isNull()).select(F.col("ref1").alias("ref"), F.col("dir1").alias("dir"), F.col("start1").alias("start"), F.col("end1").alias("end"), "qs")
    return calling.interval_cliques(one, ["ref", "dir"])


def allocate_evidence(ev: DataFrame, calls: DataFrame, bin_width: int, config: Config | None = None, write_filtered: bool = True) -> DataFrame:
    """Calls with the counts and qualities of the evidence that supports each best, the assemblies among it (``is_assembly``, where ``ev`` tells), and their filters.

    Without ``write_filtered`` calls that fail any go.
    """
    config = config or Config()
    got = ev.join(allocate.assign_unique(ev, calls, bin_width, config.calling.breakend_margin).select("evidence_id", "call_id"), "evidence_id")
    s = annotate.support(got, ["call_id"]).join(annotate.fragments(got, ["call_id"]), "call_id")
    known = "is_assembly" in ev.columns
    made = got.groupBy("call_id").agg(F.count_if(F.col("is_assembly") if known else F.lit(False)).alias("assemblies"))
    j = calls.join(s, "call_id", "left").join(made, "call_id", "left").na.fill(0, ["qual", "vf", "assemblies"])
    size = coords.event_size(F.col("ref1"), F.col("dir1"), F.col("start1"), F.col("ref2"), F.col("dir2"), F.col("start2"))
    q = coords.unscale_weight(F.col("qual"))
    f = P.breakpoint_filters(size, F.coalesce(size == 0, F.lit(False)), q, F.col("vf"), F.col("assemblies") if known else F.lit(1), config.calling.min_size, config.calling.min_score, config.calling.min_reads)
    out = j.withColumn("filters", f)
    return out.where(P.survives_allocation(F.col("filters"), q, F.col("vf"), write_filtered, config.calling.min_score, config.calling.min_reads))


def annotate_reference_coverage(calls: DataFrame, spans: DataFrame, pairs: DataFrame) -> DataFrame:
    return annotate.reference_support(calls, spans, pairs)


def annotate_allele_fraction(calls: DataFrame, small_event: int) -> DataFrame:
    """``calls`` with vf, ref_reads, ref_pairs gain af."""
    small = F.coalesce(coords.event_size(F.col("ref1"), F.col("dir1"), F.col("start1"), F.col("ref2"), F.col("dir2"), F.col("start2")) < small_event, F.lit(False))
    return calls.withColumn("af", annotate.allele_fraction(F.col("vf"), F.col("ref_reads"), F.col("ref_pairs"), small))


def assemble_breakends(ev: DataFrame, config: Config | None = None) -> DataFrame:
    """Error-corrected evidence to assembled contigs as synthetic reads."""
    config = config or Config()
    k = config.assembly.error_correction_k
    fixes = kmers.corrections(kmers.count_kmers(ev, k), config.assembly.error_correction_multiple)
    got = assembly.assemble(assembly.corrected(ev, fixes, k), config.assembly.k, config.chunk_size, config.assembly.anchor_length * 2, config.assembly.min_reads)
    return assembly.assembly_records(got)


def generate_pon(genotypes: DataFrame, bin_width: int) -> tuple[DataFrame, DataFrame]:
    """Breakpoint and breakend panels of normal calls (genotypes: coordinates, qual, bq, imprecise)."""
    box = ["ref1", "dir1", "start1", "end1", "ref2", "dir2", "start2", "end2"]
    bp = pon.normal_calls(genotypes.where(F.col("ref2").isNotNull()), box)
    be = pon.normal_calls(genotypes.where(F.col("ref2").isNull()).select(F.col("ref1").alias("ref"), F.col("dir1").alias("dir"), F.col("start1").alias("start"), F.col("end1").alias("end"), "qual", "bq", "imprecise"), ["ref", "dir", "start", "end"])
    return pon.merge_breakpoints(bp, bin_width), pon.merge_breakends(be)


def report_threshold_coverage(spans: DataFrame, least: int) -> DataFrame:
    return intervals.threshold_regions(spans, ["ref"], least)


def compute_coverage(spans: DataFrame, width: int, gc: DataFrame | None = None) -> DataFrame:
    """Mean depth per bin; with multipliers by GC percent (gc, multiplier) also the adjusted one."""
    if gc is None:
        return intervals.binned_coverage(spans, ["ref"], width)
    w = spans.join(F.broadcast(gc), "gc", "left").withColumn("_w", F.coalesce("multiplier", F.lit(1.0)))
    return intervals.binned_coverage(w, ["ref"], width, F.col("_w"))


def compute_sam_tags(rows: DataFrame) -> DataFrame:
    return evidence.fragment_tags(rows)


def soft_clips_to_split_reads(rows: DataFrame, align, least: int) -> DataFrame:
    """Clipped ends to an aligner (a function from (name, seq) to alignments), and what it finds back into SA."""
    return evidence.attach_realigned(rows, align(evidence.clips_to_realign(rows, least)))


def fragments_to_fastq(rows: DataFrame, names: DataFrame) -> DataFrame:
    return sinks.fragments_to_fastq(rows, names)


def identify_viral_taxa(report: DataFrame, nodes: DataFrame, with_sequence: DataFrame, viruses: int, level: str = "genus", least_reads: int = 50, per_group: int = 1, most: int = 10) -> DataFrame:
    """The best viral taxa of a classification report."""
    wanted = taxonomy.descendants(nodes, [viruses])
    rows = report.join(wanted, "taxid", "left_semi").join(with_sequence.select("taxid", F.lit(True).alias("has_sequence")).distinct(), "taxid", "left").na.fill(False, ["has_sequence"])
    return taxonomy.rank_taxa(rows, nodes, level, least_reads, per_group, most)


def extract_best_viral_reference(rows: DataFrame, contigs: DataFrame, taxa: DataFrame, k: int = 15, stride: int = 16, per_taxon: int = 1) -> DataFrame:
    return taxonomy.best_contigs(taxonomy.contig_hits(rows, contigs, k, stride), taxa, per_taxon)


def subset_to_taxonomy(classified: DataFrame, nodes: DataFrame, taxids: list[int]) -> DataFrame:
    up = taxonomy.closure(nodes)
    wanted = up.where(F.col("ancestor").isin(*taxids)).select("taxid").distinct()
    neutral = up.where(F.col("taxid").isin(*taxids)).select(F.col("ancestor").alias("taxid")).distinct()
    return taxonomy.keep_classified(classified, wanted, neutral)


def virus_integrations(calls: DataFrame, taxids: list[int], host: Column, repeat: Column) -> DataFrame:
    return taxonomy.host_pairs(calls, taxids, host, repeat)


def somatic_filter(calls: DataFrame, panel: DataFrame, bin_width: int) -> DataFrame:
    """Calls with somatic filters, links left to ``link_calls``."""
    hit = pon.in_panel(calls, panel, bin_width).withColumn("_pon", F.lit(True))
    j = calls.join(hit, "call_id", "left").withColumn("in_pon", F.coalesce("_pon", F.lit(False))).drop("_pon")
    return j.withColumn("filters", P.somatic_breakpoint_filters(F.col, F.col("in_pon"), F.col("no_assembly"))).where(P.passes_very_hard(F.col("filters")))


def link_calls(ends: DataFrame, singles: DataFrame, gap: int = 35) -> DataFrame:
    """All links among breakends: (a, b, kind)."""
    dsb = links.linked_neighbours(ends, gap).select(F.col("q_id").alias("a"), F.col("s_id").alias("b"), F.lit("dsb").alias("kind"))
    be = links.breakend_insertions(singles, gap).select(F.col("q_id").alias("a"), F.col("s_id").alias("b"), F.lit("bebeins").alias("kind"))
    bp = links.breakpoint_insertions(ends, singles, gap).select(F.col("q_id").alias("a"), F.col("s_id").alias("b"), F.lit("bpbeins").alias("kind"))
    return dsb.unionByName(be).unionByName(bp)


def sanity_check(ev: DataFrame) -> DataFrame:
    return metrics.asymmetric_pairs(ev)


def gap_free_mapped(rows: DataFrame) -> DataFrame:
    """Reads that support the reference: mapped whole, without clips, indels or mismatches."""
    c = F.col("cigar")
    return rows.where(~coords.flag(F.col("flag"), 0x4) & ~P.is_clipped(c) & ~P.has_indel(c) & (F.coalesce("nm", F.lit(0)) == 0) & (C.mapped_bases(c) > 0))


def simulate_deletions(contig_length: int, size: int, spacing: int, spark) -> DataFrame:
    """Deletions every ``spacing`` bases as breakpoint calls, for fixtures."""
    n = max((contig_length - size) // spacing, 0)
    pos = (F.col("id") + 1) * spacing
    return spark.range(n).select(F.col("id").alias("call_id"), F.lit(0).alias("ref1"), F.lit("+").alias("dir1"), pos.cast("int").alias("start1"), pos.cast("int").alias("end1"), F.lit(0).alias("ref2"), F.lit("-").alias("dir2"), (pos + size + 1).cast("int").alias("start2"), (pos + size + 1).cast("int").alias("end2"))


def simulate_variants(contig_length: int, size: int, spacing: int, spark) -> DataFrame:
    """A deletion, a duplication, an inversion and an insertion in turn every ``spacing`` bases, as breakpoint calls with the inserted length."""
    n = max((contig_length - size) // spacing, 0)
    at, kind = ((F.col("id") + 1) * spacing).cast("int"), F.element_at(F.array(*map(F.lit, ("DEL", "DUP", "INV", "INS"))), (F.col("id") % 4 + 1).cast("int"))
    far = F.when(kind == "INS", at + 1).otherwise(at + size + 1)
    return spark.range(n).select(F.col("id").alias("call_id"), kind.alias("kind"), F.when(kind == "DUP", "-").otherwise("+").alias("dir1"), at.alias("pos1"), F.when(kind.isin("DUP", "INV"), "+").otherwise("-").alias("dir2"), far.cast("int").alias("pos2"), F.when(kind == "INS", size).otherwise(0).alias("ins_len"))


INSERTED_MODES = ("APPEND", "REPLACE", "ADD_MISSING", "SKIP")


def annotate_inserted_sequence(calls: DataFrame, aligned: DataFrame, mode: str = "APPEND") -> DataFrame:
    """Calls (call_id, alignments array<string>) with the alignments of their inserted sequences (call_id, ref, pos, strand, cigar, mapq), best mapping quality first.

    APPEND adds to what a call has, REPLACE drops that, ADD_MISSING touches calls without any alone, SKIP leaves all as they are.
    """
    if mode not in INSERTED_MODES:
        raise ValueError(f"{mode!r} is none of {INSERTED_MODES}")
    if mode == "SKIP":
        return calls
    text = F.concat(F.col("ref").cast("string"), F.lit(":"), F.col("pos").cast("string"), F.lit("|"), "strand", F.lit("|"), "cigar", F.lit("|"), F.col("mapq").cast("string"))
    new = aligned.groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("mapq")).alias("q"), text.alias("t")))), lambda x: x["t"]).alias("_new"))
    own, fresh = F.coalesce("alignments", F.array().cast("array<string>")), F.coalesce("_new", F.array().cast("array<string>"))
    got = {"APPEND": F.concat(own, fresh), "REPLACE": fresh, "ADD_MISSING": F.when(F.size(own) > 0, own).otherwise(fresh)}[mode]
    return calls.join(new, "call_id", "left").withColumn("alignments", got).drop("_new")


def collect_metrics_and_extract_sv_reads(rows: DataFrame, **options) -> tuple[dict, DataFrame]:
    """Both from one scan: the reads are written once in the shared folder and read from there."""
    held = written(rows, "reads")
    return collect_metrics(held), extract_sv_reads(held, **options)


PROGRAMS = {
    "CollectMetrics": collect_metrics, "ExtractSVReads": extract_sv_reads, "ExtractEvidence": extract_evidence, "IdentifyVariants": identify_variants, "IdentifyBreakends": identify_breakends, "AllocateEvidence": allocate_evidence,
    "AnnotateReferenceCoverage": annotate_reference_coverage, "AnnotateAlleleFraction": annotate_allele_fraction, "AssembleBreakends": assemble_breakends, "GeneratePon": generate_pon, "ReportThresholdCoverage": report_threshold_coverage,
    "ComputeCoverage": compute_coverage, "ComputeSamTags": compute_sam_tags, "SoftClipsToSplitReads": soft_clips_to_split_reads, "FragmentsToFastq": fragments_to_fastq, "IdentifyViralTaxa": identify_viral_taxa,
    "ExtractBestViralReference": extract_best_viral_reference, "SubsetToTaxonomy": subset_to_taxonomy, "VirusIntegrations": virus_integrations, "SomaticFilter": somatic_filter, "LinkCalls": link_calls, "SanityCheck": sanity_check, "SimulateDeletions": simulate_deletions, "SimulateVariants": simulate_variants, "AnnotateInsertedSequence": annotate_inserted_sequence, "CollectMetricsAndExtractSVReads": collect_metrics_and_extract_sv_reads,
    "ReadsToBedpe": reads.reads_to_bedpe, "EvidenceToCsv": reads.evidence_csv, "SubsetToMissing": reads.missing_from, "InsertedSequencesToFasta": sinks.inserted_sequences, "UnmappedSequencesToFastq": sinks.unmapped_sequences, "ExtractOverlappingFragments": sinks.overlapping_fragments, "ReadPairs": sinks.read_pair_rows, "DumpReadSupport": sinks.read_support,
}
