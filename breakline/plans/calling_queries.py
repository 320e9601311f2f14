"""Queries of calling, allocation and annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords
from ..functions import predicates as P
from ..operators import allocate, annotate, calling
from . import adapters as A
from .registry import query

_KEYS = "ref1, dir1, ref2, dir2"
_MERGED = f"m AS (SELECT {_KEYS}, start1, end1, start2, end2, CAST(sum(qs) AS BIGINT) AS w, CAST(sum(CASE WHEN exact THEN qs ELSE 0 END) AS BIGINT) AS ew FROM ev WHERE ref1 < ref2 OR (ref1 = ref2 AND start1 <= start2) GROUP BY ALL)"
_CLIQUES = f"""{_MERGED}, corner AS (
  SELECT DISTINCT a.ref1, a.dir1, a.ref2, a.dir2, a.start1 AS a, b.start2 AS b FROM m a JOIN m b USING ({_KEYS})
  WHERE a.start1 BETWEEN b.start1 AND b.end1 AND b.start2 BETWEEN a.start2 AND a.end2
), held AS (
  SELECT c.*, min(m.end1) AS e1, min(m.end2) AS e2, CAST(sum(w) AS BIGINT) AS weight, CAST(sum(ew) AS BIGINT) AS exact_weight, max(m.start1) AS ma, max(m.start2) AS mb
  FROM corner c JOIN m USING ({_KEYS}) WHERE c.a BETWEEN m.start1 AND m.end1 AND c.b BETWEEN m.start2 AND m.end2 GROUP BY ALL
), cand AS (SELECT * FROM held WHERE ma = a AND mb = b
), cliques AS (
  SELECT {_KEYS}, a AS start1, e1 AS end1, b AS start2, e2 AS end2, weight, exact_weight FROM cand c WHERE NOT EXISTS (
    SELECT 1 FROM m WHERE m.ref1 = c.ref1 AND m.dir1 = c.dir1 AND m.ref2 = c.ref2 AND m.dir2 = c.dir2 AND m.start1 <= c.e1 AND c.a <= m.end1 AND m.start2 <= c.e2 AND c.b <= m.end2
      AND NOT (c.a BETWEEN m.start1 AND m.end1 AND c.b BETWEEN m.start2 AND m.end2))
)"""
#: The widest box of the adapter plus one.
_BIN = 51


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return A.view(spark, d, A.EV)


def _cliques(spark: SparkSession, d: str) -> DataFrame:
    boxes = calling.merge_boxes(calling.low_side(_ev(spark, d)), F.col("exact"))
    return calling.maximal_cliques(boxes, _BIN)


@query(f", {_MERGED} SELECT * FROM m", ev=A.EV)
def w2_merge_boxes(spark, d):
    return calling.merge_boxes(calling.low_side(_ev(spark, d)), F.col("exact")).withColumnRenamed("exact_w", "ew").select("*")


@query(f", {_CLIQUES} SELECT * FROM cliques", ev=A.EV)
def w1_maximal_cliques(spark, d):
    return _cliques(spark, d)


@query(
    f""", {_CLIQUES}, named AS (SELECT *, concat_ws('_', ref1, dir1, ref2, dir2, start1, start2) AS event, weight / 1048576.0::DOUBLE AS qual FROM cliques)
SELECT event, event || side AS id, event || CASE side WHEN 'o' THEN 'h' ELSE 'o' END AS mate_id, CASE side WHEN 'o' THEN ref1 ELSE ref2 END AS ref, CASE side WHEN 'o' THEN start1 ELSE start2 END AS start,
  CASE side WHEN 'o' THEN end1 ELSE end2 END AS "end", round(qual, 6) AS qual FROM named, (VALUES ('o'), ('h')) s(side)
WHERE qual >= 1 AND NOT (exact_weight = 0 AND ref1 = ref2 AND dir1 <> dir2
  AND CASE WHEN dir1 = '+' THEN start2 - end1 - 1 ELSE start1 - end2 - 1 END <= 500 AND 0 <= CASE WHEN dir1 = '+' THEN end2 - start1 - 1 ELSE end1 - start2 - 1 END)""",
    ev=A.EV,
)
def identify_variants(spark, d):
    """The flagship: evidence to maximal cliques to filtered calls, two linked rows each."""
    c = _cliques(spark, d)
    maybe = coords.could_be_deletion(F.col("ref1"), F.col("dir1"), F.col("start1"), F.col("end1"), F.col("ref2"), F.col("dir2"), F.col("start2"), F.col("end2"), 0, 500)
    kept = c.withColumn("_q", coords.unscale_weight(F.col("weight"))).where(P.passes_hard_filter(F.col("_q"), F.col("exact_weight") == 0, maybe, 1)).drop("_q")
    rows = calling.call_records(kept)
    return rows.select("event", "id", "mate_id", "ref", "start", "end", F.round(coords.unscale_weight(F.col("weight")), 6).alias("qual"))


_CLIQUES1 = """s AS (SELECT ref, dir, start AS s, lead(start) OVER (PARTITION BY ref, dir ORDER BY start) AS nxt FROM (SELECT DISTINCT ref, dir, start FROM be)),
held AS (SELECT s.ref, s.dir, s.s AS start, s.nxt, min(be."end") AS e, CAST(sum(qs) AS BIGINT) AS weight FROM s JOIN be ON s.ref = be.ref AND s.dir = be.dir AND s.s BETWEEN be.start AND be."end" GROUP BY ALL),
c1 AS (SELECT ref, dir, CAST(start AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", weight FROM held WHERE nxt IS NULL OR nxt > e)"""


@query(f", {_CLIQUES1} SELECT * FROM c1", be=A.BE)
def w3_interval_cliques(spark, d):
    return calling.interval_cliques(A.view(spark, d, A.BE), ["ref", "dir"])


@query(f""", {_CLIQUES1} SELECT ref, dir, start, "end", weight FROM (SELECT *, row_number() OVER (PARTITION BY ref, dir ORDER BY weight DESC, start) AS r FROM c1) WHERE r = 1""", be=A.BE)
def w4_best_interval(spark, d):
    return calling.best_interval(A.view(spark, d, A.BE), ["ref", "dir"])


_OVER = "e.ref1 = c.ref1 AND e.dir1 = c.dir1 AND e.ref2 = c.ref2 AND e.dir2 = c.dir2 AND e.start1 <= c.end1 AND c.start1 <= e.end1 AND e.start2 <= c.end2 AND c.start2 <= e.end2"
_WIDE = """wide AS (SELECT call_id, ref1, dir1, ref2, dir2, score, start1 - m AS start1, end1 + m AS end1, start2 - m AS start2, end2 + m AS end2 FROM (
  SELECT *, CASE WHEN ref1 = ref2 AND least < 20 THEN CAST(floor(least / 2.0::DOUBLE) AS INTEGER) ELSE 10 END AS m FROM (
    SELECT *, greatest(abs(start2 - start1) - greatest(end1 - start1, end2 - start2), 0) AS least FROM calls)))"""
_BEST = f"best AS (SELECT evidence_id, call_id, score FROM (SELECT e.evidence_id, c.call_id, c.score, row_number() OVER (PARTITION BY e.evidence_id ORDER BY c.score DESC, c.start1, c.call_id) AS r FROM ev e JOIN wide c ON {_OVER}) WHERE r = 1)"


@query(f"SELECT e.evidence_id, c.call_id FROM ev e JOIN calls c ON {_OVER}", ev=A.EV, calls=A.CALLS)
def j1_box_join(spark, d):
    return allocate.breakpoint_candidates(_ev(spark, d), A.view(spark, d, A.CALLS), _BIN).select("evidence_id", "call_id")


@query("""SELECT b.evidence_id, c.call_id FROM be b JOIN calls c ON b.ref = c.ref1 AND b.dir = c.dir1 AND b.start <= c.end1 AND c.start1 <= b."end" """, be=A.BE, calls=A.CALLS)
def j2_interval_join(spark, d):
    return allocate.breakend_candidates(A.view(spark, d, A.BE), A.view(spark, d, A.CALLS), _BIN).select("evidence_id", "call_id")


@query(f", {_WIDE}, {_BEST} SELECT * FROM best", ev=A.EV, calls=A.CALLS)
def j3_assign_best(spark, d):
    return allocate.assign_unique(_ev(spark, d), A.view(spark, d, A.CALLS), _BIN)


@query(
    f"""SELECT e.evidence_id, c.call_id, 'bp' AS kind FROM ev e JOIN calls c ON {_OVER}
UNION ALL SELECT b.evidence_id, c.call_id, 'be_bp' FROM be b JOIN calls c ON b.ref = c.ref1 AND b.dir = c.dir1 AND b.start <= c.end1 AND c.start1 <= b."end"
UNION ALL SELECT b.evidence_id, c.call_id, 'be' FROM be b JOIN bc c ON b.ref = c.ref1 AND b.dir = c.dir1 AND b.start <= c.end1 AND c.start1 <= b."end" """,
    ev=A.EV, be=A.BE, calls=A.CALLS, bc=A.BE_CALLS,
)
def j4_assign_all(spark, d):
    return allocate.assign_all(_ev(spark, d), A.view(spark, d, A.BE), A.view(spark, d, A.CALLS), A.view(spark, d, A.BE_CALLS), _BIN)


_ASM = "SELECT CAST(o_orderkey AS STRING) AS evidence_id, CAST(o_orderkey AS BIGINT) + 5000000 AS call_id, CAST(o_custkey AS BIGINT) AS score, CAST(1 AS INT) AS start1 FROM {orders} WHERE o_orderstatus = 'P'"


@query(
    """, a AS (SELECT evidence_id, call_id, score, start1, 0 AS priority FROM asm
UNION ALL SELECT b.evidence_id, c.call_id, c.score, c.start1, 1 FROM be b JOIN calls c ON b.ref = c.ref1 AND b.dir = c.dir1 AND b.start <= c.end1 AND c.start1 <= b."end"
UNION ALL SELECT b.evidence_id, c.call_id, c.score, c.start1, 2 FROM be b JOIN bc c ON b.ref = c.ref1 AND b.dir = c.dir1 AND b.start <= c.end1 AND c.start1 <= b."end")
SELECT evidence_id, call_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY priority, score DESC, start1, call_id) AS r FROM a) WHERE r = 1""",
    be=A.BE, calls=A.CALLS, bc=A.BE_CALLS, asm=_ASM,
)
def j5_assign_breakends(spark, d):
    return allocate.assign_breakends(A.view(spark, d, A.BE), A.view(spark, d, _ASM), A.view(spark, d, A.CALLS), A.view(spark, d, A.BE_CALLS), _BIN)


@query("SELECT evidence_id, CASE WHEN (bit_count(fragment_id) % 2 = 1) <> is_assembly THEN 'h' ELSE 'o' END AS side FROM ev", ev=A.EV)
def j6_side_split(spark, d):
    return _ev(spark, d).select("evidence_id", allocate.side_of(F.col("fragment_id"), F.col("is_assembly")).alias("side"))


@query(", sup AS (SELECT assembly_id, evidence_id FROM ev WHERE is_assembly) SELECT ev.evidence_id, min(sup.assembly_id) AS assembly_id FROM ev LEFT JOIN sup USING (evidence_id) GROUP BY 1", ev=A.EV)
def j7_with_assembly(spark, d):
    ev = _ev(spark, d)
    sup = ev.where("is_assembly").groupBy("assembly_id").agg(F.collect_list("evidence_id").alias("evidence_ids"))
    return allocate.with_assembly(ev.drop("assembly_id"), sup).select("evidence_id", "assembly_id")


def _assigned(spark, d):
    ev = _ev(spark, d)
    got = allocate.assign_unique(ev, A.view(spark, d, A.CALLS), _BIN)
    return ev.join(got.select("evidence_id", "call_id"), "evidence_id")


_ASSIGNED = f"{_WIDE}, {_BEST}, assigned AS (SELECT ev.*, best.call_id FROM ev JOIN best USING (evidence_id))"


@query(
    f""", {_ASSIGNED} SELECT call_id, category, {', '.join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS {c}, CAST(coalesce(sum(qs) FILTER (kind = '{k}'), 0) AS BIGINT) AS {c}q" for k, c in (('SR', 'sr'), ('IC', 'ic'), ('RP', 'rp'), ('SC', 'bsc'), ('UM', 'bum')))},
CAST(coalesce(sum(qs) FILTER (kind NOT IN ('SC', 'UM')), 0) AS BIGINT) AS qual, CAST(coalesce(sum(qs) FILTER (kind IN ('SC', 'UM')), 0) AS BIGINT) AS bq, min(CAST(floor((mapq1 + mapq2) / 2.0::DOUBLE) AS INTEGER)) AS min_mapq, max(CAST(floor((mapq1 + mapq2) / 2.0::DOUBLE) AS INTEGER)) AS max_mapq,
CAST(sum(floor((mapq1 + mapq2) / 2.0::DOUBLE)) AS BIGINT) AS sum_mapq, count(*) AS rows, CAST(count(*) FILTER (kind IN ('SR', 'SC') AND strand = '+') AS BIGINT) AS fwd_reads, CASE WHEN count(*) FILTER (kind IN ('SR', 'SC')) > 0 THEN CAST(count(*) FILTER (kind IN ('SR', 'SC')) AS BIGINT) END AS strand_reads FROM assigned GROUP BY ALL""",
    ev=A.EV, calls=A.CALLS,
)
def a15_support(spark, d):
    got = annotate.support(_assigned(spark, d), ["call_id", "category"])
    return got.withColumn("fwd_reads", F.coalesce("fwd_reads", F.lit(0)))


@query(
    f""", {_ASSIGNED}, f AS (SELECT call_id, category, fragment_id, max(CASE WHEN kind IN ('SC', 'UM') THEN 0 ELSE 1 END) AS bp FROM assigned GROUP BY ALL)
SELECT call_id, category, CAST(sum(bp) AS BIGINT) AS vf, CAST(sum(1 - bp) AS BIGINT) AS bvf FROM f GROUP BY ALL""",
    ev=A.EV, calls=A.CALLS,
)
def a20_fragments(spark, d):
    return annotate.fragments(_assigned(spark, d), ["call_id", "category"])


@query(f", {_ASSIGNED} SELECT call_id, string_agg(DISTINCT CAST(fragment_id AS VARCHAR), ',' ORDER BY CAST(fragment_id AS VARCHAR)) AS names FROM assigned GROUP BY 1", ev=A.EV, calls=A.CALLS)
def a25_names(spark, d):
    return annotate.names(_assigned(spark, d))


@query(f", {_ASSIGNED} SELECT call_id, evidence_id, start1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY CASE WHEN exact THEN 0 ELSE 1 END, CASE WHEN is_assembly THEN 0 ELSE 1 END, qs DESC, evidence_id) AS r FROM assigned) WHERE r = 1", ev=A.EV, calls=A.CALLS)
def a24_nominal(spark, d):
    return annotate.nominal(_assigned(spark, d))


@query(
    """, p AS (SELECT assembly_id, category, CAST(sum(qs) AS BIGINT) AS cat_qs, CAST(max(qs) AS BIGINT) AS assembly_qs FROM ev GROUP BY ALL)
SELECT assembly_id, category, cat_qs, round(CASE WHEN sum(cat_qs) OVER (PARTITION BY assembly_id) = 0 THEN 0 ELSE assembly_qs * (cat_qs / (sum(cat_qs) OVER (PARTITION BY assembly_id))::DOUBLE) END, 4) AS share FROM p""",
    ev=A.EV,
)
def a17_assembly_share(spark, d):
    got = annotate.assembly_share(_ev(spark, d).withColumn("assembly_qs", F.col("qs")))
    return got.withColumn("share", F.round("share", 4))


_PARTS = "SELECT CAST(l_suppkey AS BIGINT) AS assembly_id, CAST(l_partkey % 300 AS INT) AS off_start, CAST(l_partkey % 300 + CAST(l_quantity AS INT) AS INT) AS off_end, CAST(round(l_discount * 100) AS BIGINT) AS qs, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS category, CAST(l_orderkey AS BIGINT) AS fragment_id FROM {lineitem}"
_OFFS = """b AS (SELECT DISTINCT assembly_id, off FROM (SELECT assembly_id, off_start AS off FROM parts UNION ALL SELECT assembly_id, off_end + 1 FROM parts)),
r AS (SELECT b.assembly_id, b.off, CAST(coalesce(sum(qs), 0) AS BIGINT) AS q FROM b LEFT JOIN parts p ON b.assembly_id = p.assembly_id AND b.off BETWEEN p.off_start AND p.off_end GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, lead(off) OVER (PARTITION BY assembly_id ORDER BY off) AS n FROM r) WHERE n IS NOT NULL),
lim AS (SELECT assembly_id, first(off ORDER BY q, off) AS least_at, min(q) AS least, first(off ORDER BY q DESC, off) AS most_at, max(q) AS most FROM k GROUP BY 1)"""


@query(f", {_OFFS} SELECT * FROM lim", parts=_PARTS)
def a19_offset_quality(spark, d):
    return annotate.offset_quality(A.view(spark, d, _PARTS))


@query(f", {_OFFS} SELECT p.assembly_id, category, count(*) AS n_rows, count(DISTINCT fragment_id) AS n_fragments, CAST(sum(qs) AS BIGINT) AS qs FROM parts p JOIN lim USING (assembly_id) WHERE least_at BETWEEN off_start AND off_end GROUP BY ALL", parts=_PARTS)
def a18_support_at(spark, d):
    parts = A.view(spark, d, _PARTS)
    return annotate.support_at(parts, annotate.offset_quality(parts).select("assembly_id", F.col("least_at").alias("at")))


@query(
    f""", {_ASSIGNED}, asm AS (SELECT DISTINCT call_id, assembly_id FROM assigned WHERE is_assembly)
SELECT a.call_id, CAST(count(*) FILTER (kind = 'RP') AS BIGINT) AS anrp, CAST(coalesce(sum(qs) FILTER (kind = 'RP'), 0) AS BIGINT) AS anrpq, CAST(count(*) FILTER (kind = 'SR') AS BIGINT) AS ansr, CAST(coalesce(sum(qs) FILTER (kind = 'SR'), 0) AS BIGINT) AS ansrq
FROM assigned a ANTI JOIN asm ON a.call_id = asm.call_id AND a.assembly_id = asm.assembly_id GROUP BY 1""",
    ev=A.EV, calls=A.CALLS,
)
def a21_not_supporting(spark, d):
    got = _assigned(spark, d)
    return annotate.not_supporting(got, got.where("is_assembly").select("call_id", "assembly_id").distinct())


@query(
    f""", {_ASSIGNED}, x AS (SELECT DISTINCT call_id, assembly_id, start1 AS low, start2 AS high FROM assigned WHERE is_assembly)
SELECT call_id, string_agg(CAST(assembly_id AS VARCHAR), ',' ORDER BY assembly_id, low, high) AS beid, string_agg(CAST(low AS VARCHAR), ',' ORDER BY assembly_id, low, high) AS beidl, string_agg(CAST(high AS VARCHAR), ',' ORDER BY assembly_id, low, high) AS beidh FROM x GROUP BY 1""",
    ev=A.EV, calls=A.CALLS,
)
def a26_assembly_lists(spark, d):
    got = _assigned(spark, d).where("is_assembly")
    return annotate.assembly_lists(got.select("call_id", "assembly_id", F.col("start1").alias("low"), F.col("start2").alias("high")))


_COV_CALLS = """SELECT CAST(p_partkey AS BIGINT) AS call_id, CAST(p_partkey % 4 AS INT) AS ref, CAST((p_partkey * 61) % 5000 + 1 AS INT) AS start, CAST((p_partkey * 61) % 5000 + 1 + p_size % 8 AS INT) AS "end" FROM {part}"""
_PAIRS = """SELECT CAST(o_custkey % 4 AS INT) AS ref, CAST(o_custkey % 2 AS INT) AS category, CAST((o_orderkey * 7) % 5000 + 1 AS INT) AS end1, CAST((o_orderkey * 7) % 5000 + 1 + o_custkey % 60 AS INT) AS start2 FROM {orders}"""


@query(
    """, cat AS (SELECT DISTINCT category FROM (SELECT category FROM reads UNION ALL SELECT category FROM pairs)),
pos AS (SELECT call_id, ref, unnest(range(start, "end" + 1)) AS p FROM calls),
dr AS (SELECT ref, category, p, count(*) AS n FROM (SELECT ref, category, unnest(range(start, "end")) AS p FROM reads WHERE start < "end") GROUP BY ALL),
dp AS (SELECT ref, category, p, count(*) AS n FROM (SELECT ref, category, unnest(range(end1, start2)) AS p FROM pairs WHERE end1 < start2) GROUP BY ALL)
SELECT pos.call_id, cat.category, CAST(min(coalesce(dr.n, 0)) AS BIGINT) AS ref_reads, CAST(min(coalesce(dp.n, 0)) AS BIGINT) AS ref_pairs
FROM pos CROSS JOIN cat LEFT JOIN dr ON dr.ref = pos.ref AND dr.category = cat.category AND dr.p = pos.p LEFT JOIN dp ON dp.ref = pos.ref AND dp.category = cat.category AND dp.p = pos.p GROUP BY ALL""",
    reads=A.READS, calls=_COV_CALLS, pairs=_PAIRS,
)
def j11_reference_support(spark, d):
    reads = A.view(spark, d, A.READS).select("ref", "start", "end", "category")
    return annotate.reference_support(A.view(spark, d, _COV_CALLS), reads, A.view(spark, d, _PAIRS))


@query(
    f""", {_ASSIGNED}, v AS (SELECT call_id, count(DISTINCT fragment_id) AS vf FROM assigned GROUP BY 1)
SELECT call_id, round(CASE WHEN vf + r > 0 THEN vf / (vf + r)::DOUBLE ELSE 0 END, 9) AS af FROM (SELECT call_id, vf, score + CASE WHEN ref1 = ref2 AND abs(start1 - start2) < 1000 THEN 0 ELSE ref2 END AS r FROM v JOIN calls USING (call_id))""",
    ev=A.EV, calls=A.CALLS,
)
def a27_allele_fraction(spark, d):
    calls = A.view(spark, d, A.CALLS)
    vf = _assigned(spark, d).groupBy("call_id").agg(F.count_distinct("fragment_id").alias("vf"))
    small = (F.col("ref1") == F.col("ref2")) & (F.abs(F.col("start1") - F.col("start2")) < 1000)
    return vf.join(calls, "call_id").select("call_id", F.round(annotate.allele_fraction(F.col("vf"), F.col("score"), F.col("ref2"), small), 9).alias("af"))
