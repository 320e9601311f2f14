"""Queries of the writers' lines, and of what is left of the read and CIGAR functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import coords
from ..operators import metrics, reads
from ..sources import sinks
from . import adapters as A
from .registry import query

#: Calls as their low and high records.
_REC = """
SELECT concat('e', CAST(call_id AS STRING)) AS event, concat('e', CAST(call_id AS STRING), 'o') AS id, concat('e', CAST(call_id AS STRING), 'h') AS mate_id, concat('chr', CAST(ref1 AS STRING)) AS chrom, start1 AS pos, start1 AS start, end1 AS "end", dir1 AS dir,
  concat('chr', CAST(ref2 AS STRING)) AS mate_chrom, start2 AS mate_pos, start2 AS mate_start, end2 AS mate_end, dir2 AS mate_dir, CASE WHEN score % 3 = 0 THEN 'N' ELSE 'G' END AS ref_base, CASE WHEN score % 2 = 0 THEN '' ELSE 'ACC' END AS inserted, CAST(score AS DOUBLE) / 4 AS qual, score % 5 = 0 AS low
FROM (""" + A.CALLS + """) x
UNION ALL SELECT concat('e', CAST(call_id AS STRING)), concat('e', CAST(call_id AS STRING), 'h'), concat('e', CAST(call_id AS STRING), 'o'), concat('chr', CAST(ref2 AS STRING)), start2, start2, end2, dir2, concat('chr', CAST(ref1 AS STRING)), start1, start1, end1, dir1,
  CASE WHEN score % 3 = 0 THEN 'N' ELSE 'G' END, CASE WHEN score % 2 = 0 THEN '' ELSE 'ACC' END, CAST(score AS DOUBLE) / 4, score % 5 = 0 FROM (""" + A.CALLS + ") y"


def _records(spark, d):
    return A.view(spark, d, _REC)


@query(
    """SELECT concat_ws(chr(9), chrom, CAST(pos AS VARCHAR), id, ref_base, CASE WHEN dir = '+' THEN ref_base || inserted || b || mate_chrom || ':' || CAST(mate_pos AS VARCHAR) || b ELSE b || mate_chrom || ':' || CAST(mate_pos AS VARCHAR) || b || inserted || ref_base END,
  printf('%.2f', qual), CASE WHEN low THEN 'LOW_QUAL' ELSE 'PASS' END, concat_ws(';', 'EVENT=' || event, 'MATEID=' || mate_id, 'SVTYPE=BND', CASE WHEN "end" > start THEN 'CIPOS=0,' || CAST("end" - pos AS VARCHAR) END, CASE WHEN "end" > start THEN 'IMPRECISE' END)) AS value
FROM (SELECT *, CASE WHEN mate_dir = '+' THEN ']' ELSE '[' END AS b FROM rec)""",
    rec=_REC,
)
def k1_vcf_lines(spark, d):
    r = _records(spark, d).withColumns({"ci_start": F.col("start"), "ci_end": F.col("end"), "filters": F.when(F.col("low"), F.array(F.lit("LOW_QUAL"))).otherwise(F.array().cast("array<string>"))})
    return sinks.vcf_lines(r)


@query("SELECT concat_ws(chr(9), chrom, CAST(start - 1 AS VARCHAR), CAST(\"end\" AS VARCHAR), mate_chrom, CAST(mate_start - 1 AS VARCHAR), CAST(mate_end AS VARCHAR), event, printf('%.2f', qual), dir, mate_dir) AS value FROM rec WHERE id LIKE '%o'", rec=_REC)
def k5_bedpe_lines(spark, d):
    return sinks.bedpe_lines(_records(spark, d))


@query("SELECT event AS read_name, 1 + CASE WHEN id LIKE '%o' THEN 64 ELSE 128 END + CASE WHEN dir = '-' THEN 16 ELSE 0 END + CASE WHEN mate_dir = '-' THEN 32 ELSE 0 END AS flag, chrom AS ref, start AS pos, CAST(greatest(\"end\" - start + 1, 1) AS VARCHAR) || 'M' AS cigar, mate_chrom AS mate_ref, mate_start AS mate_pos FROM rec", rec=_REC)
def k6_read_pairs(spark, d):
    return sinks.read_pair_rows(_records(spark, d))


@query("SELECT concat_ws(chr(9), CAST(ref1 AS VARCHAR), CAST(start1 - 1 AS VARCHAR), CAST(end1 AS VARCHAR), CAST(ref2 AS VARCHAR), CAST(start2 - 1 AS VARCHAR), CAST(end2 AS VARCHAR), evidence_id, CAST(fragment_id AS VARCHAR), dir1, dir2) AS value, TRUE AS is_bp FROM ev", ev=A.EV)
def k7_read_support(spark, d):
    return sinks.read_support(A.view(spark, d, A.EV).withColumn("call_id", F.col("fragment_id").cast("string")))


_FQ = "s AS (SELECT *, repeat('ACGT', 5) AS seq, repeat('IJKL', 5) AS qual FROM reads)"


@query(
    f""", {_FQ}, p AS (SELECT *, CASE WHEN flag & 128 > 0 THEN 2 WHEN flag & 64 > 0 THEN 1 ELSE 0 END AS sg FROM s WHERE flag & 2304 = 0 AND read_name IN (SELECT read_name FROM s WHERE rg = 'A')), n AS (SELECT read_name, count(DISTINCT sg) AS n FROM p WHERE sg > 0 GROUP BY 1)
SELECT p.read_name, CASE WHEN n = 2 THEN sg ELSE 0 END AS file, '@' || p.read_name || chr(10) || CASE WHEN flag & 16 > 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END || chr(10) || '+' || chr(10) || CASE WHEN flag & 16 > 0 THEN reverse(qual) ELSE qual END AS value FROM p JOIN n USING (read_name)""",
    reads=A.READS,
)
def k10_fragments_to_fastq(spark, d):
    r = A.view(spark, d, A.READS).withColumns({"seq": F.repeat(F.lit("ACGT"), F.lit(5)), "qual": F.repeat(F.lit("IJKL"), F.lit(5))})
    return sinks.fragments_to_fastq(r, r.where("rg = 'A'"))


@query(
    f""", {_FQ}, c AS (SELECT *, CAST(coalesce(nullif(regexp_extract(cigar_text, '^(\\d+)S', 1), ''), '0') AS INTEGER) AS a, CAST(coalesce(nullif(regexp_extract(cigar_text, '(\\d+)S$', 1), ''), '0') AS INTEGER) AS b FROM s WHERE flag & 2304 = 0)
SELECT '@' || read_name || sfx || chr(10) || substr(seq, o + 1, n) || chr(10) || '+' || chr(10) || substr(qual, o + 1, n) AS value FROM (
  SELECT read_name, '' AS sfx, seq, qual, 0 AS o, 20 AS n FROM c WHERE flag & 4 > 0 UNION ALL SELECT read_name, '_start', seq, qual, 0, a FROM c WHERE flag & 4 = 0 AND a BETWEEN 3 AND 20 UNION ALL SELECT read_name, '_end', seq, qual, 20 - b, b FROM c WHERE flag & 4 = 0 AND b >= 3)""",
    reads=A.READS,
)
def s20_unmapped_sequences(spark, d):
    r = A.view(spark, d, A.READS).withColumns({"seq": F.repeat(F.lit("ACGT"), F.lit(5)), "qual": F.repeat(F.lit("IJKL"), F.lit(5)), "cigar": C.parse(F.col("cigar_text"))})
    return sinks.unmapped_sequences(r.where((C.start_clip(F.col("cigar")) <= 20) | (F.col("flag").bitwiseAND(F.lit(4)) != 0) | (C.end_clip(F.col("cigar")) >= 3)), 3)


@query(
    """SELECT read_id, CASE CAST(regexp_replace(read_id, '^\\d+-(\\d+)-.*$', '\\1') AS INTEGER) % 4 WHEN 0 THEN CAST(q AS VARCHAR) || 'S40M' WHEN 1 THEN '20M' || CAST(30 AS VARCHAR) || 'S' WHEN 2 THEN '25M' || CAST(q + 25 AS VARCHAR) || 'S' ELSE CAST(50 + q AS VARCHAR) || 'M' END AS head
FROM (SELECT *, CAST(regexp_extract(cigar_text, CASE WHEN regexp_matches(cigar_text, '^\\d+S') THEN '^(\\d+)' WHEN regexp_matches(cigar_text, '[DI]') THEN '(\\d+)[DI]' ELSE '^(\\d+)' END, 1) AS INTEGER) - CASE WHEN regexp_matches(cigar_text, '^\\d+M$') THEN 50 ELSE 0 END AS q FROM reads)""",
    reads=A.READS,
)
def f23_ungapped(spark, d):
    return A.view(spark, d, A.READS).select("read_id", C.render(C.ungapped(C.parse(F.col("cigar_text")), True)).alias("head"))


@query(
    """SELECT read_id, CASE WHEN flag & 16 > 0 THEN start ELSE start + 40 END AS mate_edge, flag & 1 > 0 AND flag & 128 > 0 AS second, CASE WHEN mapq = 255 THEN 20 ELSE mapq END AS mapq_used FROM reads""",
    reads=A.READS,
)
def f49_read_functions(spark, d):
    f = F.col("flag")
    return A.view(spark, d, A.READS).select("read_id", F.when(coords.flag(f, 16), F.col("start")).otherwise(F.col("start") + 40).alias("mate_edge"), (coords.segment_index(f) == 1).alias("second"), coords.effective_mapq(F.col("mapq")).alias("mapq_used"))


@query("SELECT gc, round(CASE WHEN n > 0 THEN (expected / sum(expected) OVER ()) / (n / sum(n) OVER ()) ELSE 0 END, 9) AS multiplier FROM (SELECT mapq AS gc, count(*)::DOUBLE AS n, (mapq + 1)::DOUBLE AS expected FROM reads GROUP BY mapq)", reads=A.READS)
def a11_gc_multiplier(spark, d):
    h = A.view(spark, d, A.READS).groupBy(F.col("mapq").alias("gc")).agg(F.count(F.lit(1)).alias("n")).withColumn("expected", F.col("gc") + 1)
    return metrics.gc_multiplier(h).withColumn("multiplier", F.round("multiplier", 9))


@query("SELECT DISTINCT evidence_id FROM (SELECT evidence_id FROM ev UNION ALL SELECT evidence_id FROM ev)", ev=A.EV)
def u2_dedup_evidence(spark, d):
    ev = A.view(spark, d, A.EV)
    return reads.dedup_evidence(ev.unionByName(ev)).select("evidence_id")


@query("SELECT category, count(*) AS n FROM (SELECT read_id, 0 AS category FROM reads UNION ALL SELECT read_id, 1 FROM reads WHERE rg = 'A') GROUP BY 1", reads=A.READS)
def s5_joint_inputs(spark, d):
    r = A.view(spark, d, A.READS)
    return reads.joint(r, r.where("rg = 'A'")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
