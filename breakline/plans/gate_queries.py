"""Queries of geometry, gates, CIGAR surgery and links that programs use."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import coords
from ..functions import predicates as P
from ..functions import seq as S
from ..operators import evidence, intervals, links, reads, taxonomy
from ..operators.tables import shared_root
from ..sources import sinks
from ..streaming import events as E
from . import adapters as A
from . import programs
from .graph_queries import _NEAR
from .registry import query

_C = F.col


@query('SELECT region_id, greatest(start - 150, 1) AS start, least("end" + 150, 20000) AS "end" FROM regions', regions=A.REGIONS)
def s7_padded_regions(spark, d):
    s, e = coords.pad(_C("start"), _C("end"), 150, F.lit(20000))
    return A.view(spark, d, A.REGIONS).select("region_id", s.alias("start"), e.alias("end"))


@query("SELECT evidence_id, start1 <= end2 AND start2 <= end1 AS meets, greatest(least(end1, end2) - greatest(start1, start2) + 1, 0) AS width FROM ev", ev=A.EV)
def f43_overlaps(spark, d):
    box = [_C(c) for c in ("start1", "end1", "start2", "end2")]
    return A.view(spark, d, A.EV).select("evidence_id", coords.overlaps(*box).alias("meets"), coords.overlap_width(*box).alias("width"))


@query(
    """SELECT evidence_id, CASE WHEN dir1 = '+' THEN start1 + 7 ELSE start1 - 7 END AS moved, CASE WHEN dir1 = '+' THEN start1 - 3 ELSE start1 - 5 END AS wide_start, CASE WHEN dir1 = '+' THEN end1 + 5 ELSE end1 + 3 END AS wide_end,
CAST(CASE WHEN end1 - start1 < 20 THEN floor((start1 + end1) / 2.0::DOUBLE) ELSE start1 + 10 END AS INTEGER) AS narrow_start, CAST(CASE WHEN end1 - start1 < 20 THEN ceil((start1 + end1) / 2.0::DOUBLE) ELSE end1 - 10 END AS INTEGER) AS narrow_end FROM ev""",
    ev=A.EV,
)
def f44_breakend_geometry(spark, d):
    s, e = coords.adjust(_C("start1"), _C("end1"), _C("dir1"), 3, 5)
    lo, hi = coords.compress(_C("start1"), _C("end1"), 10)[0], coords.compress(_C("start1"), _C("end1"), 10, True)[1]
    return A.view(spark, d, A.EV).select("evidence_id", coords.advance(_C("start1"), _C("dir1"), 7).alias("moved"), s.alias("wide_start"), e.alias("wide_end"), lo.alias("narrow_start"), hi.alias("narrow_end"))


@query("SELECT evidence_id, CASE WHEN ref1 = ref2 AND mapq2 < 20 THEN CAST(floor(mapq2 / 2) AS INTEGER) ELSE 10 END AS margin FROM ev", ev=A.EV)
def f46_call_margin(spark, d):
    return A.view(spark, d, A.EV).select("evidence_id", coords.call_margin(_C("ref1") == _C("ref2"), _C("mapq2")).alias("margin"))


@query(
    "SELECT evidence_id, CASE WHEN ref1 <> ref2 THEN 0 WHEN dir1 = '+' THEN end2 - start1 + 1 ELSE end1 - start2 + 1 END AS fragment, dir1 <> dir2 AND abs(start1 - start2) <= 40 AND abs(end1 - end2) <= 40 AND start1 <= end2 AND start2 <= end1 AND mapq1 <= 40 AS dovetail FROM ev",
    ev=A.EV,
)
def f48_pair_geometry(spark, d):
    size = coords.fragment_size(_C("dir1") == "+", _C("start1"), _C("end1"), _C("start2"), _C("end2"), _C("ref1") == _C("ref2"))
    dove = coords.dovetails(_C("start1"), _C("end1"), _C("start2"), _C("end2"), _C("dir1") != _C("dir2"), _C("mapq1"), 40)
    return A.view(spark, d, A.EV).select("evidence_id", size.alias("fragment"), dove.alias("dovetail"))


@query("SELECT evidence_id, CAST(mapq1 * 0.37::DOUBLE * 1048576 AS BIGINT) AS w FROM (SELECT evidence_id, mapq1 FROM ev) WHERE mapq1 % 25 = 0", ev=A.EV)
def f41_weights(spark, d):
    e = A.view(spark, d, A.EV).where("mapq1 % 25 = 0")
    return e.select("evidence_id", F.round(coords.unscale_weight(coords.scale_weight(_C("mapq1") * 0.37)) * (1 << 20)).cast("long").alias("w"))


@query("SELECT read, rpad(substr(seq, 1, 20), 30, 'N') AS at_end, lpad(substr(seq, 1, 20), 30, 'N') AS at_start FROM seqs", seqs=A.SEQS)
def f9_anchor_with_n(spark, d):
    s = F.substring("seq", 1, 20)
    return A.view(spark, d, A.SEQS).select("read", S.anchor_with_n(s, 30, False).alias("at_end"), S.anchor_with_n(s, 30, True).alias("at_start"))


@query(
    "SELECT read, substr(seq, 20 - n + 1, n + 4) AS homology, CASE WHEN 20 + n - 3 > 20 THEN substr(seq, 21, n - 3) ELSE '' END AS untemplated FROM (SELECT read, seq, CAST(read % 7 AS INTEGER) AS n FROM seqs)",
    seqs=A.SEQS,
)
def f12_homology_sequences(spark, d):
    n = (_C("read") % 7).cast("int")
    return A.view(spark, d, A.SEQS).select("read", reads.homology_sequence(_C("seq"), F.lit(20), n, F.lit(4)).alias("homology"), reads.untemplated_sequence(_C("seq"), F.lit(20), n + 17).alias("untemplated"))


@query("SELECT evidence_id, concat_ws('#', evidence_id, CAST(ref1 AS VARCHAR), dir1) AS name, substr(sha256(evidence_id), 1, 32) AS hashed FROM ev", ev=A.EV)
def f14_identifiers(spark, d):
    return A.view(spark, d, A.EV).select("evidence_id", S.evidence_id(_C("evidence_id"), _C("ref1"), _C("dir1")).alias("name"), S.hashed_id(_C("evidence_id")).alias("hashed"))


def _sum(ops: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform(regexp_extract_all(cigar_text, '(\\d+)[{ops}]', 1), lambda x: CAST(x AS INTEGER))), 0) AS INTEGER)"


_HEAD = "CAST(coalesce(nullif(regexp_extract(cigar_text, '^(\\d+)S', 1), ''), '0') AS INTEGER)"
_TAIL = "CAST(coalesce(nullif(regexp_extract(cigar_text, '(\\d+)S$', 1), ''), '0') AS INTEGER)"


def _cigars(spark, d):
    return A.view(spark, d, A.READS).withColumn("c", C.parse(_C("cigar_text")))


@query(f"SELECT read_id, {_sum('IDX')} AS edits, {_sum('IDX')} + 2 AS with_nm, round(1 - 2.0::DOUBLE / {_sum('M=X')}, 9) AS identity FROM reads", reads=A.READS)
def f50_edit_distance(spark, d):
    nm = C.length_of(_C("c"), ("I", "D")) + 2
    none = F.lit(None).cast("int")
    return _cigars(spark, d).select("read_id", C.edit_distance(_C("c"), none).alias("edits"), C.edit_distance(_C("c"), nm).alias("with_nm"), F.round(C.identity(_C("c"), nm), 9).alias("identity"))


@query("SELECT read_id, w, CASE WHEN w = 1 THEN '1X' WHEN w = 2 THEN '2X' ELSE '1X' || CAST(w - 2 AS VARCHAR) || 'N1X' END AS cigar, CASE WHEN w = 1 THEN 0 ELSE w - 1 END AS width FROM (SELECT read_id, CAST(mapq % 9 + 1 AS INTEGER) AS w FROM reads)", reads=A.READS)
def f27_placeholders(spark, d):
    w = (_C("mapq") % 9 + 1).cast("int")
    got = A.view(spark, d, A.READS).select("read_id", w.alias("w")).withColumn("cigar", C.placeholder(_C("w")))
    return got.withColumn("width", C.imprecision_width(C.parse(_C("cigar"))))


@query(
    f"""SELECT read_id, CASE WHEN flag & 16 > 0 THEN {_TAIL} ELSE {_HEAD} END AS first_off, {_sum('MIS=X')} - 1 - CASE WHEN flag & 16 > 0 THEN {_HEAD} ELSE {_TAIL} END AS last_off,
CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END AS out_dir, CASE WHEN flag & 16 > 0 THEN start ELSE start + {_sum('MDN=X')} - 1 END AS out_pos, CASE WHEN flag & 16 > 0 THEN '+' ELSE '-' END AS in_dir, CASE WHEN flag & 16 > 0 THEN start + {_sum('MDN=X')} - 1 ELSE start END AS in_pos FROM reads""",
    reads=A.READS,
)
def f30_alignment_ends(spark, d):
    neg = coords.flag(_C("flag"), 16)
    out, into = C.successor_breakend(_C("start"), _C("c"), neg), C.predecessor_breakend(_C("start"), _C("c"), neg)
    return _cigars(spark, d).select("read_id", C.first_aligned_offset(_C("c"), neg).alias("first_off"), C.last_aligned_offset(_C("c"), neg).alias("last_off"), out["dir"].alias("out_dir"), out["pos"].alias("out_pos"), into["dir"].alias("in_dir"), into["pos"].alias("in_pos"))


@query(
    r"""SELECT read_id, regexp_replace(cigar_text, '\d+S', '', 'g') AS unclipped, CAST(start - """ + _HEAD + " AS INTEGER) AS u_start, CAST(start + " + _sum("MDN=X") + " - 1 + " + _TAIL + r""" AS INTEGER) AS u_end,
CASE WHEN regexp_matches(cigar_text, '^\d+M$') THEN CAST(CAST(replace(cigar_text, 'M', '') AS INTEGER) - 7 AS VARCHAR) || 'M' WHEN regexp_matches(cigar_text, '^20M\d+D30M$') THEN '15M' || substr(cigar_text, 4, length(cigar_text) - 6) || '28M'
  WHEN regexp_matches(cigar_text, 'S$') THEN '20M' || regexp_extract(cigar_text, '(\d+I)', 1) || '22M1S'
  WHEN """ + _HEAD + " > 5 THEN CAST(" + _HEAD + " - 5 AS VARCHAR) || 'S38M' ELSE CAST(33 + " + _HEAD + " AS VARCHAR) || 'M' END AS trimmed FROM reads",
    reads=A.READS,
)
def f23_trimmed(spark, d):
    s, e = C.unclipped_bounds(_C("start"), _C("c"))
    return _cigars(spark, d).select("read_id", C.render(C.trim_clips(_C("c"))).alias("unclipped"), s.cast("int").alias("u_start"), e.cast("int").alias("u_end"), C.render(C.trim(_C("c"), F.lit(5), F.lit(2))).alias("trimmed"))


@query(
    r"""SELECT read_id, CASE WHEN regexp_matches(cigar_text, '^\d+S40M$') THEN CAST(""" + _HEAD + r""" + 4 AS VARCHAR) || 'S40M6S' WHEN regexp_matches(cigar_text, 'S$') THEN '4S' || replace(cigar_text, '3S', '9S') ELSE '4S' || cigar_text || '6S' END AS clipped FROM reads""",
    reads=A.READS,
)
def f23_more_clips(spark, d):
    return _cigars(spark, d).select("read_id", C.render(C.with_soft_clips(_C("c"), F.lit(4), F.lit(6))).alias("clipped"))


@query('SELECT read_id, start >= 1 AND "end" <= 4000 AND start <= "end" AS inside FROM reads', reads=A.READS)
def p3_within_contig(spark, d):
    return A.view(spark, d, A.READS).select("read_id", P.within_contig(_C("start"), _C("end"), F.lit(4000)).alias("inside"))


@query(
    """SELECT evidence_id, mapq1 % 40 >= 5 AND mapq2 % 11 >= 5 AND 0.9::DOUBLE + (mapq1 % 10) / 100.0::DOUBLE >= 0.95::DOUBLE AND (mapq2 % 20) / 10.0::DOUBLE >= 0.5::DOUBLE AND NOT exact AS clip,
NOT is_assembly AND (mapq2 % 20) / 10.0::DOUBLE >= 0.5::DOUBLE AND mapq1 >= 20 AND dir1 <> dir2 AND NOT exact AND strand = '+' AND start2 - end1 >= 0 AND fragment_id % 3 <> 0 AS pair FROM ev""",
    ev=A.EV,
)
def p4_p12_evidence_gates(spark, d):
    entropy = (_C("mapq2") % 20) / F.lit(10.0)
    clip = P.usable_clip(_C("mapq1") % 40, _C("mapq2") % 11, F.lit(0.9) + (_C("mapq1") % 10) / F.lit(100.0), entropy, _C("exact"))
    pair = P.usable_pair(_C("is_assembly"), entropy, _C("mapq1"), _C("dir1") == _C("dir2"), _C("exact"), _C("strand") != "+", _C("start2") - _C("end1"), _C("fragment_id") % 3 == 0)
    return A.view(spark, d, A.EV).select("evidence_id", clip.alias("clip"), pair.alias("pair"))


_FILTERS = "list_filter([CASE WHEN score % 3 = 0 THEN 'PON' END, CASE WHEN score % 5 = 0 THEN 'af' END, CASE WHEN score % 7 = 0 THEN 'normalSupport' END], lambda x: x IS NOT NULL)"


def _filtered(spark, d):
    names = [F.when(_C("score") % n == 0, F.lit(x)) for n, x in ((3, "PON"), (5, "af"), (7, "normalSupport"))]
    return A.view(spark, d, A.CALLS).withColumn("filters", F.array_compact(F.array(*names)))


@query(f"SELECT call_id, len({_FILTERS}) = 0 AND score >= 50 AND start1 % 9 >= 2 AS survives, TRUE AS all_survive, len({_FILTERS}) = 0 AS passes FROM calls", calls=A.CALLS)
def p17_p18_survivors(spark, d):
    args = (_C("filters"), _C("score"), _C("start1") % 9)
    return _filtered(spark, d).select("call_id", P.survives_allocation(*args).alias("survives"), P.survives_allocation(*args, write_filtered=True).alias("all_survive"), P.passes(_C("filters")).alias("passes"))


@query("SELECT call_id, dir1 = '+' AND score <= (start1 % 40) * 1.5::DOUBLE AND start2 % 7 >= 3 AND (dir2 = '+' OR score > 60) AS usable FROM calls", calls=A.CALLS)
def p19_assembly_gate(spark, d):
    got = P.usable_assembly(F.when(_C("dir1") == "+", 1).otherwise(0), _C("score"), _C("start1") % 40, _C("start2") % 7, _C("dir2") == "+", F.lit(60))
    return A.view(spark, d, A.CALLS).select("call_id", got.alias("usable"))


@query("SELECT call_id, dir1 = '+' AND (score >= 75 OR (score = 0 AND start1 >= 428)) AS counts FROM calls", calls=A.CALLS)
def p22_normal_gate(spark, d):
    return A.view(spark, d, A.CALLS).select("call_id", P.normal_counts(_C("score"), _C("start1"), _C("dir1") != "+").alias("counts"))


@query(f"SELECT call_id, NOT list_contains({_FILTERS}, 'normalSupport') AS very_hard, score % 5 <> 0 AND score % 7 <> 0 AS soft, len({_FILTERS}) = 0 AND score * 10.0::DOUBLE >= CASE WHEN dir1 = '+' THEN 350.0::DOUBLE ELSE 350.0::DOUBLE * (1000.0::DOUBLE / 350.0::DOUBLE) END AS final FROM calls", calls=A.CALLS)
def p27_gates(spark, d):
    f = _C("filters")
    return _filtered(spark, d).select("call_id", P.passes_very_hard(f).alias("very_hard"), P.passes_soft(f).alias("soft"), P.passes_final(f, _C("score") * 10.0, _C("dir1") == "+").alias("final"))


_REPLACED = "SELECT *, substr(repeat('ACGGTTCA', 130), 1 + CAST(start1 % 8 AS INT), CAST(abs(start1 - start2) AS INT)) AS ref_seq, substr(repeat('ACGGTTCATG', 4), 1, CAST(ins_len AS INT)) AS ins_seq FROM (" + A.SOMATIC + ") x"


@query(
    """, s AS (SELECT *, is_bp AND dir1 <> dir2 AND ref1 = ref2 AND abs(start1 - start2) < 1000 AS short, ((start1 <= start2 AND dir1 = '-') OR (start1 >= start2 AND dir1 = '+')) AS first, greatest(length(ins_seq), 1) AS n FROM calls),
e AS (SELECT *, levenshtein(ins_seq, ref_seq) / n::DOUBLE AS forward, levenshtein(ins_seq, reverse(translate(ref_seq, 'ACGT', 'TGCA'))) / n::DOUBLE AS inverted FROM s)
SELECT id, short AND NOT (short AND first) AND abs(abs(start1 - start2) - length(ins_seq)) < 5 AND NOT (forward > 0.5::DOUBLE AND inverted < 0.2::DOUBLE) AS artefact FROM e""",
    calls=_REPLACED,
)
def p29_replacement_artefact(spark, d):
    return A.view(spark, d, _REPLACED).select("id", P.replacement_artefact(_C, _C("ref_seq"), _C("ins_seq")).alias("artefact"))


_VIRAL = "SELECT CAST(call_id AS STRING) AS call_id, dir1 = '+' AS is_single, CAST(score % 6 AS BIGINT) AS taxid, (start1 % 10) / CAST(10.0 AS DOUBLE) AS host, (start2 % 15) / CAST(10.0 AS DOUBLE) AS rep FROM (" + A.CALLS + ") x"


@query("SELECT call_id || '_' || side AS id, call_id || '_' || CASE WHEN side = 'v' THEN 'h' ELSE 'v' END AS mate_id, taxid FROM calls, (SELECT unnest(['v', 'h']) AS side) WHERE is_single AND taxid IN (2, 3) AND host >= 0.5::DOUBLE AND rep <= 1.0::DOUBLE", calls=_VIRAL)
def p23_virus_integrations(spark, d):
    return programs.virus_integrations(A.view(spark, d, _VIRAL), [2, 3], _C("host"), _C("rep")).select("id", "mate_id", "taxid")


@query(
    """SELECT evidence_id, CASE WHEN kind IN ('SR', 'RP') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS counted, CAST(least(mapq1 * n, mapq2 * n, mapq1 + 2 * mapq2) AS DOUBLE) AS both, CAST(least(mapq1 * n, mapq1 + 2 * mapq2) AS DOUBLE) AS one FROM (SELECT *, CAST(fragment_id % 4 + 1 AS INTEGER) + CAST(assembly_id % 3 AS INTEGER) AS n FROM ev)""",
    ev=A.EV,
)
def e8_other_scores(spark, d):
    n = ((_C("fragment_id") % 4 + 1).cast("int"), (_C("assembly_id") % 3).cast("int"), _C("mapq1"), 2 * _C("mapq2"))
    return A.view(spark, d, A.EV).select("evidence_id", evidence.excluding(evidence.score_count, ["SR", "RP"])().alias("counted"), evidence.assembly_score(*n, _C("mapq1"), _C("mapq2")).alias("both"), evidence.assembly_score(*n, _C("mapq1")).alias("one"))


@query("SELECT read_id FROM reads WHERE flag & 4 = 0 AND regexp_matches(cigar_text, '^\\d+M$') AND mapq % 3 = 0", reads=A.READS)
def e13_whole_reads(spark, d):
    return programs.gap_free_mapped(A.view(spark, d, A.READS).withColumns({"cigar": C.parse(_C("cigar_text")), "nm": (_C("mapq") % 3).cast("int")})).select("read_id")


_MARKED = "SELECT *, CASE WHEN event % 2 = 0 THEN 'ACGTAACCGGTTACGTTACA' ELSE 'ACGTTACCGGTTACGTTACG' END AS seq FROM (" + A.ENDS + ") x"


@query(
    """, p AS (SELECT q.id AS q_id, s.id AS s_id, q.seq AS a, s.seq AS b FROM ends q JOIN ends s ON q.sample = s.sample AND q.ref = s.ref AND q.start - 3001 <= s."end" AND s.start <= q."end" + 3001 AND q.id < s.id AND q.dir = s.dir)
SELECT q_id, s_id, round(levenshtein(a, b) / 20.0::DOUBLE, 9) AS edits FROM p WHERE levenshtein(a, b) / 20.0::DOUBLE <= 0.1::DOUBLE""",
    ends=_MARKED,
)
def j21_equivalent_calls(spark, d):
    return links.equivalent_calls(A.view(spark, d, _MARKED), 3000).select("q_id", "s_id", F.round("edits", 9).alias("edits"))


@query(
    f""", n AS ({_NEAR.format(g=1001)}), p AS (SELECT * FROM n WHERE q_event % 2 = 0 AND s_event % 2 = 1 AND q_dir <> s_dir), a AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY q_id ORDER BY s_qual DESC) AS r FROM p) WHERE r = 1)
SELECT q_id, s_id FROM (SELECT *, rank() OVER (PARTITION BY s_id ORDER BY q_qual DESC) AS r2 FROM a) WHERE r2 = 1""",
    ends=A.ENDS,
)
def j18_breakpoint_insertions(spark, d):
    e = A.view(spark, d, A.ENDS)
    return links.breakpoint_insertions(e.where("event % 2 = 0"), e.where("event % 2 = 1"), 1000)


_MATES = 'SELECT *, CAST(start + event % 900 AS INT) AS mate_start, CAST("end" + event % 900 AS INT) AS mate_end FROM (' + A.ENDS + ") x"


@query(
    """, p AS (SELECT q.id AS q_id, s.id AS s_id, q.qual AS q_qual, s.qual AS s_qual FROM ends q JOIN ends s ON q.sample = s.sample AND q.ref = s.ref AND q.start - 801 <= s."end" AND s.start <= q."end" + 801 AND q.dir <> s.dir AND q.mate_start - 801 <= s.mate_end AND s.mate_start <= q.mate_end + 801),
a AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY q_id ORDER BY s_qual DESC) AS r FROM p) WHERE r = 1) SELECT q_id, s_id FROM (SELECT *, rank() OVER (PARTITION BY s_id ORDER BY q_qual DESC) AS r2 FROM a) WHERE r2 = 1 AND q_id < s_id""",
    ends=_MATES,
)
def j18_inversions(spark, d):
    return links.simple_inversions(A.view(spark, d, _MATES), 800)


_HITS = "SELECT call_id AS contig, score AS hits, CAST(start1 % 13 AS BIGINT) AS taxid FROM (" + A.CALLS + ") x"


@query("SELECT contig, hits, taxid, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY taxid ORDER BY hits DESC, contig) AS rank FROM h) WHERE rank <= 2", h=_HITS)
def a32_best_contigs(spark, d):
    h = A.view(spark, d, _HITS)
    return taxonomy.best_contigs(h.select("contig", "hits"), h.select("contig", "taxid"), 2).select("contig", "hits", "taxid", _C("rank").cast("int").alias("rank"))


@query(
    """, o AS (SELECT ref, start, "end", max("end") OVER (PARTITION BY ref ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM regions), g AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT ref, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end", count(*) AS n FROM g GROUP BY ref, k""",
    regions=A.REGIONS,
)
def a12_count_merged(spark, d):
    return intervals.count_merged(A.view(spark, d, A.REGIONS), ["ref"]).select("ref", "start", "end", "n")


_AF = "SELECT *, CAST(score AS BIGINT) AS vf, CAST(start2 % 50 AS BIGINT) AS ref_reads, CAST(start1 % 30 AS BIGINT) AS ref_pairs FROM (" + A.CALLS + ") x"


@query(
    """, s AS (SELECT *, CASE WHEN ref1 <> ref2 THEN NULL WHEN dir1 = dir2 THEN abs(start2 - start1) WHEN (start1 < start2 AND dir1 = '+') OR (start2 < start1 AND dir1 = '-') THEN abs(start2 - start1) - 1 ELSE abs(start2 - start1) + 1 END AS size FROM calls),
t AS (SELECT *, vf + ref_reads + CASE WHEN coalesce(size < 500, FALSE) THEN 0 ELSE ref_pairs END AS total FROM s) SELECT call_id, round(CASE WHEN total > 0 THEN vf / total::DOUBLE ELSE 0 END, 9) AS af FROM t""",
    calls=_AF,
)
def allele_fraction_program(spark, d):
    return programs.annotate_allele_fraction(A.view(spark, d, _AF), 500).select("call_id", F.round("af", 9).alias("af"))


_NORMALS = 'SELECT ref AS ref1, dir AS dir1, start AS start1, "end" AS end1, CAST(NULL AS INT) AS ref2, CAST(NULL AS STRING) AS dir2, CAST(NULL AS INT) AS start2, CAST(NULL AS INT) AS end2, CAST(qs % 300 AS DOUBLE) AS qual, CAST(qs % 900 AS DOUBLE) AS bq, category = 0 AS imprecise FROM (' + A.BE + ") x"


@query(
    """, k AS (SELECT ref1 AS ref, dir1 AS dir, start1 AS start, end1 AS e, count(*) AS n FROM g WHERE NOT imprecise AND (qual >= 75 OR (qual = 0 AND bq >= 428)) GROUP BY ALL), o AS (SELECT *, max(e) OVER (PARTITION BY ref, dir ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY ref, dir ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS isle FROM o)
SELECT ref, dir, min(start) AS start, max(e) AS "end", CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY ref, dir, isle""",
    g=_NORMALS,
)
def generate_pon_breakends(spark, d):
    """The panel of a program run: normal calls that hold, merged where they overlap or touch."""
    return programs.generate_pon(A.view(spark, d, _NORMALS), 1000)[1].select("ref", "dir", "start", "end", "n")


@query(
    """, p AS (SELECT unnest(range(0, greatest((n - 300) // 1000, 0))) AS id FROM (SELECT CAST(sum(n_chars) AS BIGINT) AS n FROM documents))
SELECT id AS call_id, 0 AS ref1, '+' AS dir1, CAST((id + 1) * 1000 AS INTEGER) AS start1, CAST((id + 1) * 1000 AS INTEGER) AS end1, 0 AS ref2, '-' AS dir2, CAST((id + 1) * 1000 + 301 AS INTEGER) AS start2, CAST((id + 1) * 1000 + 301 AS INTEGER) AS end2 FROM p""".replace(", p AS", "WITH p AS", 1)
)
def simulated_deletions(spark, d):
    """Deletions every 1000 bases of a contig as long as all texts."""
    n = spark.read.parquet(f"{d}/documents.parquet").agg(F.sum("n_chars")).first()[0]
    return programs.simulate_deletions(int(n), 300, 1000, spark)


@query(
    """, h AS (SELECT mapq, count(*) AS n FROM reads GROUP BY 1) SELECT 0 AS line_no, '## METRICS CLASS' || chr(9) || 'Mapq' AS value UNION ALL SELECT 1, 'mapq' || chr(9) || 'n' UNION ALL SELECT 2, CAST(mapq AS VARCHAR) || chr(9) || CAST(n AS VARCHAR) FROM h""",
    reads=A.READS,
)
def k12_metrics_lines(spark, d):
    return sinks.metrics_lines(A.view(spark, d, A.READS).groupBy("mapq").agg(F.count(F.lit(1)).alias("n")), "Mapq")


@query("SELECT read, md5('>asm' || CAST(read AS VARCHAR) || chr(10) || array_to_string(list_transform(range(0, greatest(CAST(ceil(length(seq) / 60.0::DOUBLE) AS INTEGER), 1)), lambda i: substr(seq, i * 60 + 1, 60)), chr(10))) AS record FROM seqs", seqs=A.SEQS)
def k13_assembly_fasta(spark, d):
    s = A.view(spark, d, A.SEQS).select("read", F.concat(F.lit("asm"), F.col("read").cast("string")).alias("name"), "seq")
    got = sinks.assembly_fasta(s.select("name", "seq")).withColumn("read", F.regexp_extract("value", r"^>asm(\d+)", 1).cast("long"))
    return got.select("read", F.md5(F.col("value").cast("binary")).alias("record"))


@query(
    """SELECT '<node id="' || CAST(taxid AS VARCHAR) || '" label="' || rank || '"><attvalues><attvalue for="weight" value="' || CAST(taxid % 10 AS VARCHAR) || '"/></attvalues></node>' AS value FROM tax UNION ALL SELECT '<edge source="' || CAST(parent AS VARCHAR) || '" target="' || CAST(taxid AS VARCHAR) || '"/>' FROM tax WHERE taxid <> parent""",
    tax=A.TAX,
)
def k15_graph_export(spark, d):
    t = A.view(spark, d, A.TAX)
    return sinks.gexf_lines(t.select(_C("taxid").alias("id"), _C("rank").alias("label"), (_C("taxid") % 10).alias("weight")), t.where("taxid <> parent").select(_C("parent").alias("source"), _C("taxid").alias("target")))


_VCF = """SELECT concat('chr', CAST(ref1 AS STRING)) AS chrom, start1 AS pos, concat('c', CAST(call_id AS STRING), 'o') AS id, CASE WHEN score % 5 = 0 THEN 'N' ELSE 'A' END AS ref_base, dir1 AS dir, '' AS inserted, concat('chr', CAST(ref2 AS STRING)) AS mate_chrom, start2 AS mate_pos, dir2 AS mate_dir,
CAST(score AS DOUBLE) AS qual, concat('c', CAST(call_id AS STRING)) AS event, concat('c', CAST(call_id AS STRING), 'h') AS mate_id, start1 AS ci_start, end1 AS ci_end, start2 AS mate_ci_start, end2 AS mate_ci_end, score AS vf, start1 % 7 AS ref_reads, CASE WHEN score % 3 = 0 THEN NULL ELSE score % 11 END AS ref_pairs, score % 4 AS t_vf, score % 6 AS t_ref_reads, CASE WHEN score % 2 = 0 THEN NULL ELSE score % 8 END AS t_ref_pairs FROM (""" + A.CALLS + ") x"


@query(
    """SELECT concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), id, ref_base, CASE WHEN dir = '+' THEN ref_base || CASE WHEN mate_dir = '+' THEN ']' ELSE '[' END || mate_chrom || ':' || CAST(mate_pos AS VARCHAR) || CASE WHEN mate_dir = '+' THEN ']' ELSE '[' END ELSE CASE WHEN mate_dir = '+' THEN ']' ELSE '[' END || mate_chrom || ':' || CAST(mate_pos AS VARCHAR) || CASE WHEN mate_dir = '+' THEN ']' ELSE '[' END || ref_base END,
printf('%.2f', qual), 'PASS', concat_ws(';', 'EVENT=' || event, 'MATEID=' || mate_id, 'SVTYPE=BND', CASE WHEN ci_end > ci_start THEN 'CIPOS=0,' || CAST(ci_end - pos AS VARCHAR) END, 'CIRPOS=0,' || CAST(mate_ci_end - mate_pos AS VARCHAR), 'VF=' || CAST(vf AS VARCHAR), 'REF=' || CAST(ref_reads AS VARCHAR), 'REFPAIR=' || CAST(ref_pairs AS VARCHAR), CASE WHEN ci_end > ci_start THEN 'IMPRECISE' END),
'VF:REF:REFPAIR', CAST(t_vf AS VARCHAR) || ':' || CAST(t_ref_reads AS VARCHAR) || ':' || coalesce(CAST(t_ref_pairs AS VARCHAR), '.')) AS value FROM calls""",
    calls=_VCF,
)
def k1_vcf_with_samples(spark, d):
    return sinks.vcf_lines(A.view(spark, d, _VCF).withColumn("filters", F.array().cast("array<string>")), ("t",))


@query(
    """, a AS (SELECT * FROM ends WHERE event % 3 <> 0), b AS (SELECT * FROM ends WHERE event % 3 <> 1), p AS (SELECT q.id AS q, s.id AS s FROM a q JOIN b s ON q.sample = s.sample AND q.ref = s.ref AND q.start - 501 <= s."end" AND s.start <= q."end" + 501 AND q.dir = s.dir),
x AS (SELECT sample, count(*) FILTER (id IN (SELECT q FROM p)) AS shared, count(*) FILTER (id NOT IN (SELECT q FROM p)) AS first_only, CAST(sum(qual) AS BIGINT) AS first_qual FROM a GROUP BY 1), y AS (SELECT sample, count(*) FILTER (id NOT IN (SELECT s FROM p)) AS second_only, CAST(sum(qual) AS BIGINT) AS second_qual FROM b GROUP BY 1)
SELECT coalesce(x.sample, y.sample) AS sample, coalesce(shared, 0) AS shared, coalesce(first_only, 0) AS first_only, coalesce(first_qual, 0) AS first_qual, coalesce(second_only, 0) AS second_only, coalesce(second_qual, 0) AS second_qual FROM x FULL JOIN y ON x.sample = y.sample""",
    ends=A.ENDS,
)
def a34_cohort_summary(spark, d):
    e = A.view(spark, d, A.ENDS)
    return links.cohort_summary(e.where("event % 3 <> 0"), e.where("event % 3 <> 1"), 500)


@query(
    'SELECT region_id AS id, (SELECT count(*) FROM reads WHERE reads.ref = regions.ref AND abs(reads.start - regions.start) <= 60 AND abs(reads."end" - regions."end") <= 60) AS n_reads FROM regions',
    regions=A.REGIONS,
    reads=A.READS,
)
def j24_validated_deletions(spark, d):
    return links.validated_deletions(A.view(spark, d, A.REGIONS).withColumnRenamed("region_id", "id"), A.view(spark, d, A.READS), 60)


_OWN = "SELECT call_id, CASE WHEN score % 2 = 0 THEN 'chr1:5|+|10M|60' END AS own FROM (" + A.CALLS + ") x"
_HIT = "SELECT CAST(call_id - 1000000 AS BIGINT) AS call_id, ref1 AS ref, start1 AS pos, dir1 AS strand, '30M' AS cigar, CAST(score % 60 AS INT) AS mapq FROM (" + A.BE_CALLS + ") x"


def _inserted(mode: str) -> str:
    kept = {"APPEND": "list_concat(own, fresh)", "REPLACE": "fresh", "ADD_MISSING": "CASE WHEN len(own) > 0 THEN own ELSE fresh END", "SKIP": "own"}[mode]
    return f"SELECT call_id, '{mode}' AS mode, array_to_string({kept}, ',') AS alignments FROM j"


@query(
    """, n AS (SELECT call_id, list(concat(CAST(ref AS VARCHAR), ':', CAST(pos AS VARCHAR), '|', strand, '|', cigar, '|', CAST(mapq AS VARCHAR)) ORDER BY mapq DESC) AS fresh FROM hits GROUP BY 1),
j AS (SELECT o.call_id, CASE WHEN own IS NULL THEN []::VARCHAR[] ELSE [own] END AS own, coalesce(fresh, []::VARCHAR[]) AS fresh FROM own_calls o LEFT JOIN n ON n.call_id = o.call_id) """
    + " UNION ALL ".join(_inserted(m) for m in programs.INSERTED_MODES),
    own_calls=_OWN,
    hits=_HIT,
)
def annotate_inserted_sequences(spark, d):
    """All modes of the program, one after the other."""
    calls = A.view(spark, d, _OWN).select("call_id", F.array_compact(F.array("own")).alias("alignments"))
    hits, out = A.view(spark, d, _HIT), None
    for mode in programs.INSERTED_MODES:
        got = programs.annotate_inserted_sequence(calls, hits, mode).select("call_id", F.lit(mode).alias("mode"), F.array_join("alignments", ",").alias("alignments"))
        out = got if out is None else out.unionByName(got)
    return out


@query(
    """WITH p AS (SELECT unnest(range(0, greatest((n - 300) // 700, 0))) AS id FROM (SELECT CAST(sum(n_chars) AS BIGINT) AS n FROM documents)), k AS (SELECT id, (['DEL', 'DUP', 'INV', 'INS'])[id % 4 + 1] AS kind, CAST((id + 1) * 700 AS INTEGER) AS pos1 FROM p)
SELECT id AS call_id, kind, CASE WHEN kind = 'DUP' THEN '-' ELSE '+' END AS dir1, pos1, CASE WHEN kind IN ('DUP', 'INV') THEN '+' ELSE '-' END AS dir2, CASE WHEN kind = 'INS' THEN pos1 + 1 ELSE pos1 + 301 END AS pos2, CASE WHEN kind = 'INS' THEN 300 ELSE 0 END AS ins_len FROM k"""
)
def simulated_variants(spark, d):
    n = spark.read.parquet(f"{d}/documents.parquet").agg(F.sum("n_chars")).first()[0]
    return programs.simulate_variants(int(n), 300, 700, spark)


@query("SELECT event_type AS route, event_id, user_id FROM events UNION ALL SELECT 'even', event_id, user_id FROM events WHERE user_id % 2 = 0")
def stream_fan_out(spark, d):
    """One pass over a stream into a table per type and one of even users, one file a batch."""
    kinds = [r[0] for r in spark.read.parquet(f"{d}/events.parquet").select("event_type").distinct().collect()]
    routes = {k: _C("event_type") == k for k in kinds} | {"even": _C("user_id") % 2 == 0}
    root = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    rows = E.read_limited(spark, d, spark.read.parquet(f"{d}/events.parquet").schema, 1, "events.parquet")
    E.fan_out(rows, routes, f"{root}/out", f"{root}/state")
    out = None
    for name in routes:
        got = spark.read.parquet(f"{root}/out/{name}").select(F.lit(name).alias("route"), "event_id", "user_id")
        out = got if out is None else out.unionByName(got)
    return out
