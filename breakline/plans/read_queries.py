"""Queries of reads, homology, repeats, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import coords
from ..functions import predicates as P
from ..operators import evidence, links, reads, taxonomy
from ..operators.kmers import support_nodes
from ..operators.tables import shared_root
from ..sources import sinks
from ..streaming import events as E
from . import adapters as A
from .registry import query


@query('SELECT read_id FROM reads r WHERE EXISTS (SELECT 1 FROM reg g WHERE g.ref = r.ref AND r.start <= g."end" + 20 AND greatest(g.start - 20, 1) <= r."end")', reads=A.READS, reg=A.REGIONS)
def s2_region_scan(spark, d):
    return reads.scan_regions(A.view(spark, d, A.READS).select("read_id", "ref", "start", "end"), A.view(spark, d, A.REGIONS), 20, width=200).select("read_id")


@query("SELECT read_name, CAST(count(*) AS BIGINT) AS alignments, CAST(count(DISTINCT CASE WHEN flag & 129 = 129 THEN 1 ELSE 0 END) AS BIGINT) AS segments FROM reads GROUP BY 1", reads=A.READS)
def s3_fragments(spark, d):
    f = reads.fragments(A.view(spark, d, A.READS).withColumnRenamed("start", "pos"))
    return f.select("read_name", F.size("alignments").cast("long").alias("alignments"), F.size(F.array_distinct(F.col("alignments.segment"))).cast("long").alias("segments"))


@query("SELECT read_id FROM reads WHERE read_name IN (SELECT read_name FROM reads WHERE mapq = 0 AND category = 1)", reads=A.READS)
def s8_lookup(spark, d):
    r = A.view(spark, d, A.READS)
    return reads.lookup(r, r.where("mapq = 0 AND category = 1")).select("read_id")


@query("SELECT read_id FROM reads WHERE read_name NOT IN (SELECT read_name FROM reads WHERE rg = 'A')", reads=A.READS)
def u6_missing(spark, d):
    r = A.view(spark, d, A.READS)
    return reads.missing_from(r, r.where("rg = 'A'"), ["read_name"]).select("read_id")


@query(
    """, p AS (SELECT *, CASE WHEN flag & 129 = 129 THEN 1 ELSE 0 END AS seg FROM reads WHERE flag & 2304 = 0) SELECT a.read_id, b.start AS mate_pos, b.mapq AS mate_mapq FROM p a LEFT JOIN p b ON a.read_name = b.read_name AND b.seg = 1 - a.seg""",
    reads=A.READS,
)
def j8_mates(spark, d):
    r = A.view(spark, d, A.READS).withColumnRenamed("start", "pos").withColumn("cigar", F.col("cigar_text")).withColumn("seq", F.lit(""))
    return reads.with_mates(r).select("read_id", "mate_pos", "mate_mapq")


@query(
    """, b AS (SELECT DISTINCT read_id FROM reads r JOIN reg g ON g.ref = r.ref AND r.start <= g."end" AND g.start <= r."end"), m AS (SELECT DISTINCT read_id FROM reads r JOIN reg g ON g.ref = r.ref AND r.start + 300 <= g."end" AND g.start <= r."end" + 300)
SELECT r.read_id, CAST(r.flag | CASE WHEN b.read_id IS NOT NULL THEN 4 ELSE 0 END | CASE WHEN m.read_id IS NOT NULL THEN 8 ELSE 0 END AS INTEGER) AS flag FROM reads r LEFT JOIN b ON r.read_id = b.read_id LEFT JOIN m ON r.read_id = m.read_id""",
    reads=A.READS, reg=A.REGIONS,
)
def p2_blacklist(spark, d):
    r = A.view(spark, d, A.READS).withColumns({"mate_ref": F.col("ref"), "mate_start": F.col("start") + 300, "mate_end": F.col("end") + 300, "sa": F.lit(None).cast("string")})
    return reads.apply_blacklist(r, A.view(spark, d, A.REGIONS), 200).select("read_id", "flag")


@query(
    """SELECT evidence_id FROM ev e JOIN contigs n ON e.ref1 = n.ref WHERE start1 >= 1 AND end1 <= length AND NOT EXISTS (SELECT 1 FROM reg g WHERE (g.ref = e.ref1 AND e.start1 <= g."end" + 1 AND g.start - 1 <= e.end1) OR (g.ref = e.ref2 AND e.start2 <= g."end" + 1 AND g.start - 1 <= e.end2))""",
    ev=A.EV, reg=A.REGIONS, contigs=A.CONTIGS,
)
def p4_usable_evidence(spark, d):
    return reads.usable_evidence(A.view(spark, d, A.EV), A.view(spark, d, A.REGIONS), A.view(spark, d, A.CONTIGS), 200).select("evidence_id")


@query("SELECT evidence_id, CAST(floor((least(start1, start2) - 1) / 250.0::DOUBLE) AS BIGINT) AS chunk FROM ev WHERE (ref1 = 0 AND ref2 = 1) OR (ref1 = 1 AND ref2 = 0) OR (ref1 = 2 AND ref2 = 2)", ev=A.EV)
def p20_chromosome_pairs(spark, d):
    return reads.owned_by_chunk(reads.chromosome_pairs(A.view(spark, d, A.EV), [("0", "1"), ("2", "2")]), 250).select("evidence_id", "chunk")


@query(
    """, s AS (SELECT read_name, CASE WHEN flag & 129 = 129 THEN 1 ELSE 0 END AS seg, bool_or(regexp_matches(cigar_text, '[SID]')) AS k, bool_or(NOT regexp_matches(cigar_text, '[SID]')) AS f, bool_or(flag & 2 = 0) AS p, bool_or(flag & 3 = 3) AS c FROM reads GROUP BY ALL),
g AS (SELECT read_name, bool_or(p) AS fp, bool_or(c) AS fc FROM s GROUP BY 1), w AS (SELECT s.read_name, s.seg FROM s JOIN g USING (read_name) WHERE (k AND NOT f) OR (fp AND NOT fc))
SELECT read_id FROM reads r JOIN w ON r.read_name = w.read_name AND CASE WHEN r.flag & 129 = 129 THEN 1 ELSE 0 END = w.seg""",
    reads=A.READS,
)
def p11_sv_reads(spark, d):
    r = A.view(spark, d, A.READS).withColumn("cigar", C.parse(F.col("cigar_text")))
    any_op = P.any_of(P.is_clipped(F.col("cigar")), P.has_indel(F.col("cigar")))
    conc = coords.flag(F.col("flag"), 0x1) & coords.flag(F.col("flag"), 0x2)
    return evidence.sv_reads(r, any_op, ~coords.flag(F.col("flag"), 0x2), conc, ~any_op).select("read_id")


_REPEATS = """SELECT CAST(c_custkey % 4 AS INT) AS ref, CAST((c_custkey * 31) % 3000 + 1 AS INT) AS start, CAST((c_custkey * 31) % 3000 + 1 + c_nationkey * 3 AS INT) AS "end", concat('rep', CAST(c_nationkey AS STRING)) AS repeat, c_mktsegment AS class, CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM {customer}"""


@query(
    """, j AS (SELECT b.evidence_id AS call_id, r.repeat, r.class, r.strand, (least(b."end", r."end") - greatest(b.start, r.start) + 1) / (b."end" - b.start + 1)::DOUBLE AS f FROM be b JOIN rep r ON b.ref = r.ref AND b.start <= r."end" AND r.start <= b."end")
SELECT call_id, repeat, class, strand, round(f, 9) AS fraction FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY f DESC, repeat, class, strand) AS r FROM j) WHERE r = 1""",
    be=A.BE, rep=_REPEATS,
)
def j12_best_repeat(spark, d):
    b = A.view(spark, d, A.BE).withColumnRenamed("evidence_id", "call_id").select("call_id", "ref", "start", "end")
    return reads.best_repeat(b, A.view(spark, d, _REPEATS), 100).withColumn("fraction", F.round("fraction", 9))


@query("SELECT call_id, score, CASE WHEN call_id % 3 = 0 THEN call_id * 10 END AS instaxid FROM calls", calls=A.CALLS)
def j13_taxids(spark, d):
    c = A.view(spark, d, A.CALLS).select("call_id", "score")
    return taxonomy.with_classification(c, c.where("call_id % 3 = 0").select("call_id", (F.col("call_id") * 10).alias("taxid")))


@query(
    """, n AS (SELECT call_id, 'chr' || CAST(ref2 AS VARCHAR) || ':' || CAST(start2 AS VARCHAR) AS aln FROM calls WHERE call_id % 2 = 0)
SELECT c.call_id, CASE WHEN c.call_id % 3 = 0 THEN concat_ws(',', 'old', aln) ELSE coalesce(aln, '') END AS append, CASE WHEN c.call_id % 3 = 0 THEN 'old' ELSE coalesce(aln, '') END AS missing FROM calls c LEFT JOIN n USING (call_id)""",
    calls=A.CALLS,
)
def j14_insert_alignments(spark, d):
    c = A.view(spark, d, A.CALLS).withColumn("bealn", F.when(F.col("call_id") % 3 == 0, F.array(F.lit("old"))))
    aln = c.where("call_id % 2 = 0").select("call_id", F.concat(F.lit("chr"), F.col("ref2").cast("string"), F.lit(":"), F.col("start2").cast("string")).alias("aln"))
    a = reads.with_alignments(c, aln).select("call_id", F.array_join("bealn", ",").alias("append"))
    return a.join(reads.with_alignments(c, aln, "ADD_MISSING").select("call_id", F.array_join("bealn", ",").alias("missing")), "call_id")


@query(
    """, p AS (SELECT a.read, a.seq AS x, b.seq AS y FROM seqs a JOIN seqs b ON b.read = a.read + 1)
SELECT read, CAST(coalesce((SELECT max(i) FROM range(0, least(length(x), length(y)) + 1) r(i) WHERE substr(reverse(x), 1, i) = substr(reverse(y), 1, i)), 0) AS INTEGER) AS hom_left, CAST(coalesce((SELECT max(i) FROM range(0, least(length(x), length(y)) + 1) r(i) WHERE substr(x, 1, i) = substr(y, 1, i)), 0) AS INTEGER) AS hom_right FROM p""",
    seqs=A.ITEMS,
)
def f10_exact_homology(spark, d):
    s = A.view(spark, d, A.ITEMS)
    p = s.select("read", F.col("seq").alias("x")).join(s.select((F.col("read") - 1).alias("read"), F.col("seq").alias("y")), "read")
    p = p.withColumns({"lr": F.col("y"), "rr": F.col("y"), "lq": F.col("x"), "rq": F.col("x")})
    return reads.exact_homology(p, "lr", "rr", "lq", "rq").select("read", F.col("hom_left").cast("int").alias("hom_left"), F.col("hom_right").cast("int").alias("hom_right"))


@query("SELECT evidence_id, CASE dir1 WHEN '+' THEN start1 - l ELSE start1 - r END AS start1, CASE dir1 WHEN '+' THEN end1 + r ELSE end1 + l END AS end1, CASE dir2 WHEN '+' THEN start2 - r ELSE start2 - l END AS start2, CASE dir2 WHEN '+' THEN end2 + l ELSE end2 + r END AS end2 FROM (SELECT *, mapq1 % 7 AS l, mapq2 % 5 AS r FROM ev)", ev=A.EV)
def e9_homology_bounds(spark, d):
    ev = A.view(spark, d, A.EV).withColumns({"hom_left": F.col("mapq1") % 7, "hom_right": F.col("mapq2") % 5})
    return reads.widened_by_homology(ev).select("evidence_id", "start1", "end1", "start2", "end2")


_SUP = """SELECT CAST(l_partkey AS BIGINT) AS call_id, CASE WHEN l_partkey % 2 = 0 THEN '+' ELSE '-' END AS dir, CAST(l_suppkey * 7 % 900 + 1 AS INT) AS start, CAST(l_suppkey * 7 % 900 + CAST(l_quantity AS INT) AS INT) AS "end", CAST(l_linenumber AS BIGINT) AS reads, round(l_discount * 100) / 10 AS bias FROM {lineitem}"""


@query(
    """, i AS (SELECT *, CASE WHEN start > coalesce(max("end") OVER (PARTITION BY call_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, -1) THEN 1 ELSE 0 END AS n FROM sup), g AS (SELECT *, sum(n) OVER (PARTITION BY call_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM i),
m AS (SELECT call_id, dir, min(start) AS s, max("end") AS e FROM g GROUP BY call_id, dir, k), x AS (SELECT *, s - lag(e) OVER (PARTITION BY call_id ORDER BY s) - 1 AS gap FROM m),
b AS (SELECT call_id, dir, CAST(min(s) AS BIGINT) AS pos, string_agg(CASE WHEN gap > 0 THEN CAST(gap AS VARCHAR) || 'N' ELSE '' END || CAST(e - s + 1 AS VARCHAR) || 'M', '' ORDER BY s) AS body FROM x GROUP BY 1, 2) SELECT call_id, pos, CASE dir WHEN '+' THEN body || '1X' ELSE '1X' || body END AS cigar FROM b""",
    sup=_SUP,
)
def f28_anchor_cigar(spark, d):
    return reads.anchor_cigar(A.view(spark, d, _SUP))


@query("SELECT call_id, round(sum(bias * reads) / sum(reads), 6) AS sb FROM sup GROUP BY 1", sup=_SUP)
def a22_strand_bias(spark, d):
    return reads.breakpoint_strand_bias(A.view(spark, d, _SUP)).withColumn("sb", F.round("sb", 6))


@query("SELECT fragment_id AS call_id, CAST(coalesce(sum(qs) FILTER (category = 0), 0) AS BIGINT) AS qs FROM ev GROUP BY 1", ev=A.EV)
def a33_sample_sums(spark, d):
    return reads.sample_sums(A.view(spark, d, A.EV).withColumnRenamed("fragment_id", "call_id"), ["qs"], [0])


_LOW = "CASE WHEN ref1 <> ref2 THEN ref1 < ref2 WHEN start1 <> start2 THEN start1 < start2 ELSE end1 < end2 END"
_SZ = "CASE WHEN ref1 <> ref2 THEN NULL WHEN dir1 = dir2 THEN abs(start2 - start1) WHEN (start1 < start2 AND dir1 = '+') OR (start2 < start1 AND dir1 = '-') THEN abs(start2 - start1) - 1 ELSE abs(start2 - start1) + 1 END"


@query(f"SELECT concat_ws(chr(9), ref1, start1 - 1, end1, ref2, start2 - 1, end2, fragment_id, least(mapq1, mapq2), dir1, dir2) AS value FROM ev WHERE kind IN ('SR', 'IC') AND {_LOW} AND (ref1 <> ref2 OR {_SZ} >= 50) AND least(mapq1, mapq2) >= 10", ev=A.EV)
def k8_reads_to_bedpe(spark, d):
    return reads.reads_to_bedpe(A.view(spark, d, A.EV), 50, 10)


@query("SELECT evidence_id || ',' || CAST(ref1 AS VARCHAR) || ',' || dir1 || ',' || CAST(qs AS VARCHAR) AS value FROM ev", ev=A.EV)
def k11_evidence_csv(spark, d):
    return reads.evidence_csv(A.view(spark, d, A.EV), ["evidence_id", "ref1", "dir1", "qs"])


@query("SELECT read_id FROM reads WHERE read_name IN (SELECT read_name FROM reads r JOIN reg g ON g.ref = r.ref AND r.flag & 4 = 0 AND r.start <= g.\"end\" AND g.start <= r.start + 49)", reads=A.READS, reg=A.REGIONS)
def c_overlapping_fragments(spark, d):
    r = A.view(spark, d, A.READS).withColumn("pos", F.col("start")).withColumn("cigar", C.parse(F.lit("50M")))
    return sinks.overlapping_fragments(r, A.view(spark, d, A.REGIONS)).select("read_id")


@query(
    """, d AS (SELECT *, row_number() OVER (PARTITION BY ref1 ORDER BY start1, end1, evidence_id) AS n FROM ev) SELECT evidence_id, CAST(n AS INTEGER) AS place FROM d""",
    ev=A.EV,
)
def t3_evidence_order(spark, d):
    from pyspark.sql import Window

    ordered = reads.evidence_order(A.view(spark, d, A.EV), "start_end")
    return ordered.select("evidence_id", F.row_number().over(Window.partitionBy("ref1").orderBy("start1", "end1", "evidence_id")).alias("place"))


@query(
    """, k AS (SELECT evidence_id, i, substr(seq, i, 12) AS kmer FROM (SELECT read AS evidence_id, seq FROM seqs), LATERAL (SELECT unnest(range(1, greatest(length(seq) - 11, 0) + 1)) AS i)), c AS (SELECT *, count(*) OVER (PARTITION BY evidence_id, kmer) AS n FROM k)
SELECT evidence_id, kmer, CAST(i - 1 + evidence_id AS BIGINT) AS start, CAST(i - 1 + evidence_id + 5 AS BIGINT) AS "end" FROM c WHERE n = 1""",
    seqs=A.ITEMS,
)
def g2_support_nodes(spark, d):
    s = A.view(spark, d, A.ITEMS).select(F.col("read").alias("evidence_id"), "seq", F.col("read").alias("start"), (F.col("read") + 5).alias("end"), F.lit(1).alias("weight"), F.lit(False).alias("anchored"))
    return support_nodes(s, 12).select("evidence_id", "kmer", "start", "end")


@query(
    """SELECT q.id AS q_id, s.id AS s_id FROM ends q JOIN bp s ON q.sample = s.sample AND q.ref = s.ref AND q.start <= s."end" + 1 AND s.start <= q."end" + 1 AND q.dir = s.dir""",
    ends=A.ENDS, bp=A.ENDS,
)
def j23_cohort_overlap(spark, d):
    e = A.view(spark, d, A.ENDS)
    return links.cohort_overlaps(e, e)


def _stream(spark, d: str):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumn("ts", F.timestamp_micros(F.expr(A.utc("ts"))))


def _folder(spark) -> str:
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def _streamed(spark, df):
    out = _folder(spark)
    E.run_to_parquet(df, out + "/out", out + "/state")
    return spark.read.parquet(out + "/out")


@query(
    """SELECT event_type, CAST(epoch(w) AS BIGINT) AS start, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS w FROM events) WHERE w + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2"""
)
def stream_binned_counts(spark, d):
    """A stream of events in bins of six hours; the bins that the watermark has passed."""
    got = E.binned_counts(_stream(spark, d), "ts", "6 hours", "1 hour", "event_type").select("event_type", F.col("window.start").alias("w"), "n")
    return _streamed(spark, got).select("event_type", F.unix_seconds("w").alias("start"), "n")


@query(
    """, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM events), k AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
s AS (SELECT user_id, k, min(ts) AS a, max(ts) AS b, count(*) AS n FROM k GROUP BY 1, 2) SELECT user_id, epoch_us(a) AS start, n FROM s WHERE b + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""".replace(", g AS", "WITH g AS", 1)
)
def stream_merged_runs(spark, d):
    """Runs of a user's events with less than two hours between neighbours."""
    got = E.merged_runs(_stream(spark, d), "ts", "2 hours", "1 hour", "user_id").select("user_id", F.col("session_window.start").alias("w"), "n")
    return _streamed(spark, got).select("user_id", F.unix_micros("w").alias("start"), "n")


@query(
    """WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_id, user_id, k, [sec] AS sent, TRUE AS ok FROM o WHERE k = 1
UNION ALL SELECT o.event_id, o.user_id, o.k, list_filter(r.sent, lambda x: x > o.sec - 21600) || CASE WHEN len(list_filter(r.sent, lambda x: x > o.sec - 21600)) < 3 THEN [o.sec] ELSE [] END, len(list_filter(r.sent, lambda x: x > o.sec - 21600)) < 3 FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT event_id, user_id FROM r WHERE ok"""
)
def stream_throttled(spark, d):
    """At most three events of a user in any six hours, by keyed state."""
    return _streamed(spark, E.throttled(_stream(spark, d), "user_id", "ts", 6 * 3600, 3, "1 hour")).select("event_id", "user_id")
