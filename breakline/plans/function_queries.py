"""Queries of scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import coords
from ..functions import predicates as P
from ..functions import seq as S
from ..sources import sinks
from . import adapters as A
from .registry import query


def _n(b: str) -> str:
    return f"(length(seq) - length(replace(seq, '{b}', '')))"


_TOTAL = "(" + " + ".join(_n(b) for b in "ACGT") + ")::DOUBLE"
_ENTROPY = " + ".join(f"CASE WHEN {_n(b)} > 0 THEN -({_n(b)} / {_TOTAL}) * log2({_n(b)} / {_TOTAL}) ELSE 0 END" for b in "ACGT")


@query(f"SELECT read, round(CASE WHEN {_TOTAL} > 0 THEN {_ENTROPY} ELSE 0 END, 9) AS entropy, CAST(CASE WHEN {_TOTAL} > 0 THEN floor(100 * ({_n('G')} + {_n('C')}) / {_TOTAL}) ELSE 50 END AS INTEGER) AS gc, md5(reverse(translate(seq, 'ACGTacgt', 'TGCAtgca'))) AS rc_md5, contains(seq, repeat('C', 16)) OR contains(seq, repeat('G', 16)) AS poly FROM seqs", seqs=A.SEQS)
def f1_sequence_functions(spark, d):
    s = F.col("seq")
    return A.view(spark, d, A.SEQS).select("read", F.round(S.entropy(s), 9).alias("entropy"), S.gc_percent(s).alias("gc"), F.md5(S.reverse_complement(s).cast("binary")).alias("rc_md5"), S.poly_run(s).alias("poly"))


@query(
    "SELECT read, "
    + " OR ".join(f"contains(seq, '{x}')" for a in S.ADAPTERS for x in (a, a.translate(str.maketrans("ACGT", "TGCA"))[::-1]))
    + " AS adapter FROM seqs",
    seqs=A.SEQS,
)
def f7_adapters(spark, d):
    return A.view(spark, d, A.SEQS).select("read", S.contains_adapter(F.col("seq")).alias("adapter"))


@query(
    """, p AS (SELECT a.read AS a, b.read AS b, a.seq AS x, b.seq AS y, CAST(least(length(a.seq), length(b.seq)) AS INTEGER) AS n FROM seqs a JOIN seqs b ON b.read = a.read + 1)
SELECT a, b, CAST(coalesce((SELECT max(i) FROM range(0, n + 1) r(i) WHERE substr(x, 1, i) = substr(y, 1, i)), 0) AS INTEGER) AS lcp FROM p""",
    seqs=A.ITEMS,
)
def f15_common_prefix(spark, d):
    s = A.view(spark, d, A.ITEMS)
    p = s.select(F.col("read").alias("a"), F.col("seq").alias("x")).join(s.select(F.col("read").alias("b"), F.col("seq").alias("y")), F.col("b") == F.col("a") + 1)
    return p.select("a", "b", S.common_prefix(F.col("x"), F.col("y")).cast("int").alias("lcp"))


@query(
    """, k AS (SELECT read, unnest(list_transform(range(1, greatest(length(seq) - 11, 0) + 1), lambda i: substr(seq, i, 12))) AS kmer FROM seqs)
SELECT kmer, list_sum(list_transform(range(1, 13), lambda i: CAST((instr('TCAG', substr(kmer, i, 1)) - 1) * pow(4, 12 - i) AS BIGINT)))::BIGINT AS code, kmer AS back FROM (SELECT DISTINCT kmer FROM k)""",
    seqs=A.ITEMS,
)
def f4_kmer_codes(spark, d):
    k = A.view(spark, d, A.ITEMS).select(F.explode(S.kmers(F.col("seq"), 12)).alias("kmer")).distinct()
    return k.select("kmer", S.kmer_code(F.col("kmer")).alias("code"), S.code_kmer(S.kmer_code(F.col("kmer")), 12).alias("back"))


_GEO = """c AS (SELECT *, CASE WHEN ref1 <> ref2 THEN ref1 < ref2 WHEN start1 <> start2 THEN start1 < start2 ELSE end1 < end2 END AS low FROM ev)"""


@query(
    f""", {_GEO} SELECT evidence_id, low,
CASE WHEN ref1 <> ref2 THEN NULL WHEN dir1 = dir2 THEN abs(start2 - start1) WHEN (start1 < start2 AND dir1 = '+') OR (start2 < start1 AND dir1 = '-') THEN abs(start2 - start1) - 1 ELSE abs(start2 - start1) + 1 END AS size,
CASE WHEN ref1 <> ref2 OR dir1 = dir2 THEN FALSE ELSE CASE WHEN dir1 = '+' THEN start2 - end1 ELSE start1 - end2 END - 1 <= 500 AND 0 <= CASE WHEN dir1 = '+' THEN end2 - start1 ELSE end1 - start2 END - 1 END AS maybe_deletion,
CAST(CASE WHEN dir1 = dir2 AND NOT low THEN ceil((start1 + end1) / 2.0::DOUBLE) ELSE floor((start1 + end1) / 2.0::DOUBLE) END AS INTEGER) AS nominal1, CAST(CASE WHEN dir1 = dir2 AND low THEN ceil((start2 + end2) / 2.0::DOUBLE) ELSE floor((start2 + end2) / 2.0::DOUBLE) END AS INTEGER) AS nominal2 FROM c""",
    ev=A.EV,
)
def f45_breakpoint_geometry(spark, d):
    c = {k: F.col(k) for k in ("ref1", "dir1", "start1", "end1", "ref2", "dir2", "start2", "end2")}
    low = coords.is_low(c["ref1"], c["start1"], c["end1"], c["ref2"], c["start2"], c["end2"])
    n1, n2 = coords.centre_aligned(c["dir1"], c["start1"], c["end1"], c["dir2"], c["start2"], c["end2"], low)
    size = coords.event_size(c["ref1"], c["dir1"], c["start1"], c["ref2"], c["dir2"], c["start2"])
    return A.view(spark, d, A.EV).select("evidence_id", low.alias("low"), size.alias("size"), coords.could_be_deletion(*c.values(), 0, 500).alias("maybe_deletion"), n1.alias("nominal1"), n2.alias("nominal2"))


@query(
    """SELECT evidence_id, round(CASE WHEN p = 0 THEN 0 ELSE -10 * log10(p) END, 6) + 0.0 AS phred_or, m FROM (SELECT evidence_id, 1 - (1 - pow(10, -mapq1 / 10.0::DOUBLE)) * (1 - pow(10, -mapq2 / 10.0::DOUBLE)) AS p, CAST(floor((mapq1 + mapq2) / 2.0::DOUBLE) AS INTEGER) AS m FROM ev)""",
    ev=A.EV,
)
def f40_phred(spark, d):
    a, b = F.col("mapq1"), F.col("mapq2")
    return A.view(spark, d, A.EV).select("evidence_id", (F.round(coords.phred_or(a, b), 6) + 0.0).alias("phred_or"), coords.mean_int(a, b).alias("m"))


def _len(ops: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar_text, '(\\d+)[{ops}]', 1), lambda x: CAST(x AS INTEGER))), 0) AS INTEGER)"


@query(
    f"""SELECT read_id, {_len('MIS=X')} AS read_len, {_len('MDN=X')} AS ref_len, {_len('M=X')} AS mapped, CAST(coalesce(nullif(regexp_extract(cigar_text, '^(\\d+)S', 1), ''), '0') AS INTEGER) AS start_clip,
CAST(coalesce(nullif(regexp_extract(cigar_text, '(\\d+)S$', 1), ''), '0') AS INTEGER) AS end_clip, CAST(len(regexp_extract_all(cigar_text, '\\d+[ID]')) AS INTEGER) AS indels, cigar_text AS rendered FROM reads""",
    reads=A.READS,
)
def f20_cigar_functions(spark, d):
    c = C.parse(F.col("cigar_text"))
    return A.view(spark, d, A.READS).select("read_id", C.read_length(c).alias("read_len"), C.reference_length(c).alias("ref_len"), C.mapped_bases(c).alias("mapped"), C.start_clip(c).alias("start_clip"), C.end_clip(c).alias("end_clip"), C.count_indels(c).alias("indels"), C.render(C.clean(c)).alias("rendered"))


_BND = """SELECT CAST(call_id AS BIGINT) AS call_id, dir1, CASE WHEN score % 3 = 0 THEN '' ELSE 'ACGTTGCA' END AS ins, concat('chr', CAST(ref2 AS STRING)) AS chrom2, start2 AS pos2, dir2, CASE WHEN score % 5 = 0 THEN 'N' WHEN score % 2 = 0 THEN 'A' ELSE 'G' END AS base FROM (""" + A.CALLS + ") x"


@query(
    """, t AS (SELECT *, CASE WHEN dir2 = '+' THEN ']' ELSE '[' END || chrom2 || ':' || CAST(pos2 AS VARCHAR) || CASE WHEN dir2 = '+' THEN ']' ELSE '[' END AS place FROM bnd)
SELECT call_id, CASE WHEN dir1 = '+' THEN base || ins || place ELSE place || ins || base END AS alt, CASE WHEN dir1 = '+' THEN base || ins || '.' ELSE '.' || ins || base END AS single, dir1 AS p_dir1, ins AS p_ins, chrom2 AS p_chrom2, pos2 AS p_pos2, dir2 AS p_dir2 FROM t""",
    bnd=_BND,
)
def f13_breakend_alleles(spark, d):
    b = A.view(spark, d, _BND)
    alt = S.breakend_allele(F.col("base"), F.col("dir1"), F.col("ins"), F.col("chrom2"), F.col("pos2"), F.col("dir2"))
    got = b.select("call_id", alt.alias("alt"), S.breakend_allele(F.col("base"), F.col("dir1"), F.col("ins")).alias("single")).withColumn("_p", S.parse_breakend_allele(F.col("alt")))
    return got.select("call_id", "alt", "single", F.col("_p.dir1").alias("p_dir1"), F.col("_p.inserted").alias("p_ins"), F.col("_p.chrom2").alias("p_chrom2"), F.col("_p.pos2").alias("p_pos2"), F.col("_p.dir2").alias("p_dir2"))


@query("SELECT read_id FROM reads WHERE flag & 4 = 0 AND mapq >= 20 AND flag & 1024 = 0 AND (regexp_matches(cigar_text, '[SID]') OR (flag & 1 > 0 AND NOT (flag & 3 = 3 AND abs(fragment) <= 200000)))", reads=A.READS)
def p1_usable_reads(spark, d):
    r = A.view(spark, d, A.READS).withColumn("c", C.parse(F.col("cigar_text")))
    conc = P.concordance(F.col("flag"), F.lit(True), F.col("fragment"))
    keep = P.usable_read(F.col("flag"), F.col("mapq"), P.any_of(P.is_clipped(F.col("c")), P.has_indel(F.col("c"))), conc)
    return r.where(keep).select("read_id")


@query("SELECT read_id FROM reads WHERE flag & 1 > 0 AND flag & 12 = 0 AND ((flag & 16 > 0) <> (flag & 32 > 0)) AND fragment BETWEEN 100 AND 300 AND abs(fragment) <= 200000", reads=A.READS)
def p7_fixed_concordance(spark, d):
    return A.view(spark, d, A.READS).where(P.concordance(F.col("flag"), F.lit(True), F.col("fragment"), (100, 300))).select("read_id")


def _agg(pairs) -> str:
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + ")"


_SIZE = "CASE WHEN ref1 <> ref2 THEN NULL WHEN dir1 = dir2 THEN abs(start2 - start1) WHEN (start1 < start2 AND dir1 = '+') OR (start2 < start1 AND dir1 = '-') THEN abs(start2 - start1) - 1 ELSE abs(start2 - start1) + 1 END"


@query(
    f"SELECT evidence_id, {_agg([('SMALL_EVENT', f'coalesce({_SIZE} < 10, FALSE)'), ('REF', 'exact AND ' + _SIZE + ' = 0'), ('INSUFFICIENT_SUPPORT', 'mapq1 < 50'), ('SINGLE_SUPPORT', 'mapq2 < 2'), ('NO_ASSEMBLY', 'NOT is_assembly')])} AS bp, {_agg([('NO_ASSEMBLY', 'NOT is_assembly'), ('INSUFFICIENT_SUPPORT', 'mapq1 < 50'), ('SINGLE_SUPPORT', 'mapq2 < 2')])} AS be FROM ev",
    ev=A.EV,
)
def p14_call_filters(spark, d):
    size = coords.event_size(F.col("ref1"), F.col("dir1"), F.col("start1"), F.col("ref2"), F.col("dir2"), F.col("start2"))
    asm = F.col("is_assembly").cast("int")
    bp = P.breakpoint_filters(size, F.coalesce(F.col("exact") & (size == 0), F.lit(False)), F.col("mapq1"), F.col("mapq2"), asm)
    return A.view(spark, d, A.EV).select("evidence_id", F.array_join(bp, ";").alias("bp"), F.array_join(P.breakend_filters(F.col("mapq1"), F.col("mapq2"), asm), ";").alias("be"))


@query(
    f"""SELECT evidence_id, {_agg([('NO_ASSEMBLY', 'l = 0 AND r = 0'), ('SINGLE_ASSEMBLY', '(l = 0) <> (r = 0)'), ('ASSEMBLY_ONLY', 'l > 0 AND r > 0 AND dd = 0'), ('LOW_QUAL', 'q < 500')])} AS bp,
{_agg([('NO_ASSEMBLY', 'l = 0'), ('LOW_QUAL', 'q < 1500'), ('ASSEMBLY_BIAS', 'mapq1 + mapq2 > 0 AND abs(mapq1 - mapq2) / (mapq1 + mapq2)::DOUBLE > 0.5'), ('NO_SR', 'r = 0'), ('NO_RP', 'dd = 0')])} AS be FROM (SELECT *, ref1 AS l, ref2 AS r, start1 % 3 AS dd, start2 AS q FROM ev)""",
    ev=A.EV,
)
def p16_confidence_filters(spark, d):
    bp = P.breakpoint_confidence(F.col("ref1"), F.col("ref2"), F.col("start1") % 3, F.col("start2"))
    be = P.breakend_confidence(F.col("ref1"), F.col("start2"), F.col("mapq1"), F.col("mapq2"), F.col("ref2"), F.col("start1") % 3)
    return A.view(spark, d, A.EV).select("evidence_id", F.array_join(bp, ";").alias("bp"), F.array_join(be, ";").alias("be"))


_GAP = "abs(start1 - start2)"
_SHORT = f"(is_bp AND dir1 <> dir2 AND ref1 = ref2 AND {_GAP} < 1000)"
_DUP = f"({_SHORT} AND ((start1 <= start2 AND dir1 = '-') OR (start1 >= start2 AND dir1 = '+')))"
_TYPE = f"CASE WHEN NOT is_bp THEN 'BE' WHEN ref1 <> ref2 THEN 'ITX' WHEN ins_len >= {_GAP} * 0.7::DOUBLE THEN 'INS' WHEN dir1 = dir2 THEN 'INV' WHEN (start1 < start2) <> (dir1 = '-') THEN 'DEL' ELSE 'DUP' END"
_FILTERS = [
    ("PON", "in_pon"), ("strand_bias", f"sb IS NOT NULL AND {_SHORT} AND greatest(sb, 1 - sb) > 0.95"), ("af", "t_af < 0.005"), ("minRead", "n_rp + t_rp + n_sr + t_sr < 1"), ("noAssembly", "no_assembly AND n_vf + t_vf < 100"), ("homlen", "homlen > 50"),
    ("ihomlen", f"ihomlen > 50 AND NOT {_DUP}"), ("largeNoRP", f"NOT {_SHORT} AND n_rp + t_rp + n_asrp + t_asrp = 0"), ("smallNoSR", f"{_SHORT} AND n_sr + t_sr = 0"), ("small.del.ligation.fp", f"etype = 'DEL' AND {_GAP} BETWEEN 100 AND 800 AND ihomlen >= 6"),
    ("small.inv.hom.fp", f"etype = 'INV' AND {_GAP} <= 40 AND homlen >= 6"), ("cohortMinSize", f"etype IN ('DEL', 'DUP', 'INS') AND {_GAP} + ins_len + CASE WHEN etype IN ('DEL', 'INS') THEN -1 ELSE 1 END < 8"),
    ("normalSupport", "n_vf > 0.03::DOUBLE * t_vf"), ("SRNormalSupport", f"{_SHORT} AND n_sr <> 0"), ("normalCoverage", "n_ref + n_refpair + n_vf < 8"),
]


@query(f", t AS (SELECT *, {_TYPE} AS etype FROM som) SELECT id, etype, {_agg(_FILTERS)} AS filters FROM t", som=A.SOMATIC)
def p25_somatic_filters(spark, d):
    return A.view(spark, d, A.SOMATIC).select("id", P.event_type(F.col).alias("etype"), F.array_join(P.somatic_breakpoint_filters(F.col, F.col("in_pon"), F.col("no_assembly")), ";").alias("filters"))


_BEF = [("PON", "in_pon"), ("af", "t_af < 0.005"), ("imprecise", "homlen > 30"), ("NO_ASSEMBLY", "no_assembly"), ("NoAssembledRP", "n_asrp = 0"), ("LongPolyC", "ins_len > 15"), ("normalSupport", "n_vf > 0.03::DOUBLE * t_vf"), ("normalCoverage", "n_ref + n_refpair + n_vf < 8")]


@query(f"SELECT id, {_agg(_BEF)} AS filters, NOT (n_vf > 0.03::DOUBLE * t_vf) AS very_hard FROM som", som=A.SOMATIC)
def p26_somatic_breakend_filters(spark, d):
    names = {"basrp": F.col("n_asrp"), "n_bvf": F.col("n_vf"), "t_bvf": F.col("t_vf"), "imprecise": F.col("homlen") > 30}
    f = P.somatic_breakend_filters(lambda n: names.get(n, F.col(n)), F.col("in_pon"), F.col("no_assembly"), F.repeat(F.lit("C"), F.col("ins_len")))
    return A.view(spark, d, A.SOMATIC).withColumn("f", f).select("id", F.array_join("f", ";").alias("filters"), P.passes_very_hard(F.col("f")).alias("very_hard"))


@query(
    """SELECT id, round(n_vf * ln(0.03::DOUBLE / p) + n_ref * ln(0.97::DOUBLE / (1 - p)), 6) + 0.0 AS llr, NOT in_pon AND qual >= CASE WHEN is_bp THEN 350 ELSE 350 * (1000 / 350.0::DOUBLE) END AS final FROM (SELECT *, CASE WHEN is_bp THEN 1 / 3.0::DOUBLE ELSE 0.5::DOUBLE END AS p FROM som)""",
    som=A.SOMATIC,
)
def f56_somatic_llr(spark, d):
    f = F.array_compact(F.array(F.when(F.col("in_pon"), F.lit("PON"))))
    return A.view(spark, d, A.SOMATIC).select("id", (F.round(P.somatic_llr(F.col("n_ref"), F.col("n_vf"), F.col("is_bp")), 6) + 0.0).alias("llr"), P.passes_final(f, F.col("qual"), F.col("is_bp")).alias("final"))


@query(
    f""", q AS (SELECT *, start1 + ins_len AS oq FROM som) SELECT id, NOT (ref1 = ref2 AND {_GAP} < 1000) AND oq > 3 * qual AND 2 * t_rp > n_ref AS shadow FROM q""",
    som=A.SOMATIC,
)
def p28_shadow(spark, d):
    short = (F.col("ref1") == F.col("ref2")) & (F.abs(F.col("start1") - F.col("start2")) < 1000)
    return A.view(spark, d, A.SOMATIC).select("id", P.shadow(short, F.col("start1") + F.col("ins_len"), F.col("qual"), F.col("t_rp"), F.col("n_ref")).alias("shadow"))


@query("""SELECT concat_ws(chr(9), 'chr' || CAST(ref AS VARCHAR), CAST(start - 1 AS VARCHAR), CAST("end" AS VARCHAR), CAST(region_id AS VARCHAR), CAST(score AS VARCHAR)) AS value FROM reg""", reg=A.REGIONS)
def k4_bed_lines(spark, d):
    r = A.view(spark, d, A.REGIONS).withColumn("chrom", F.concat(F.lit("chr"), F.col("ref").cast("string")))
    return sinks.bed_lines(r, F.col("region_id").cast("string"), F.col("score"))


@query("SELECT '>' || CAST(call_id AS VARCHAR) || chr(10) || ins AS value FROM bnd WHERE length(ins) >= 5", bnd=_BND)
def k9_inserted_sequences(spark, d):
    b = A.view(spark, d, _BND)
    alt = S.breakend_allele(F.col("base"), F.col("dir1"), F.col("ins"), F.col("chrom2"), F.col("pos2"), F.col("dir2"))
    return sinks.inserted_sequences(b.select(F.col("call_id").cast("string").alias("id"), alt.alias("alt")), 5)
