"""Queries of intervals, coverage and library metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions import coords
from ..operators import intervals as I
from ..operators import metrics as M
from ..operators import pon
from . import adapters as A
from .registry import query


def _reads(spark, d):
    return A.view(spark, d, A.READS).withColumn("cigar", C.parse(F.col("cigar_text")))


@query('SELECT read_id FROM reads r WHERE NOT EXISTS (SELECT 1 FROM reg g WHERE g.ref = r.ref AND r.start <= g."end" AND g.start <= r."end")', reads=A.READS, reg=A.REGIONS)
def j10_exclude(spark, d):
    reads = A.view(spark, d, A.READS).select("read_id", F.col("ref").alias("_ref"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return I.interval_join(reads, A.view(spark, d, A.REGIONS).select("ref", "start", "end"), [("_ref", "ref")], ("_s", "_e"), ("start", "end"), 100, "left_anti").select("read_id")


@query('SELECT read_id FROM reads r WHERE EXISTS (SELECT 1 FROM reg g WHERE g.ref = r.ref AND r.start <= g."end" AND g.start <= r."end")', reads=A.READS, reg=A.REGIONS)
def j16_semi(spark, d):
    reads = A.view(spark, d, A.READS).select("read_id", F.col("ref").alias("_ref"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return I.interval_join(reads, A.view(spark, d, A.REGIONS).select("ref", "start", "end"), [("_ref", "ref")], ("_s", "_e"), ("start", "end"), 100, "left_semi").select("read_id")


_ISL = """i AS (SELECT *, CASE WHEN start > coalesce(max("end") OVER (PARTITION BY ref ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, -1) THEN 1 ELSE 0 END AS n FROM {src}),
g AS (SELECT *, sum(n) OVER (PARTITION BY ref ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM i)"""


@query(", " + _ISL.format(src="reg") + ' SELECT ref, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end" FROM g GROUP BY ref, k', reg=A.REGIONS)
def a12_merge(spark, d):
    return I.merge_intervals(A.view(spark, d, A.REGIONS), ["ref"], 1, 5000)


@query(
    """, p AS (SELECT ref, unnest(range(start, "end" + 1)) AS p FROM reg), x AS (SELECT DISTINCT ref, unnest(range(start, "end" + 1)) AS p FROM reads),
k AS (SELECT DISTINCT p.ref, p.p FROM p ANTI JOIN x ON p.ref = x.ref AND p.p = x.p), g AS (SELECT *, p - row_number() OVER (PARTITION BY ref ORDER BY p) AS g FROM k)
SELECT ref, CAST(min(p) AS BIGINT) AS start, CAST(max(p) AS BIGINT) AS "end" FROM g GROUP BY ref, g""",
    reg=A.REGIONS, reads=A.READS,
)
def a12_subtract(spark, d):
    return I.subtract(A.view(spark, d, A.REGIONS), A.view(spark, d, A.READS), ["ref"], 5000)


@query(
    """, p AS (SELECT ref, unnest(range(start, "end" + 1)) AS p FROM reads), n AS (SELECT ref, p, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 80), g AS (SELECT *, p - row_number() OVER (PARTITION BY ref ORDER BY p) AS g FROM n)
SELECT ref, CAST(min(p) AS BIGINT) AS start, CAST(max(p) AS BIGINT) AS "end" FROM g GROUP BY ref, g""",
    reads=A.READS,
)
def a9_threshold_coverage(spark, d):
    return I.threshold_regions(A.view(spark, d, A.READS), ["ref"], 80, 1000)


@query(', p AS (SELECT ref, unnest(range(start, "end" + 1)) AS p FROM reads) SELECT pt.call_id, pt.ref, pt.start AS pos, CAST(count(p.p) AS BIGINT) AS depth FROM pt LEFT JOIN p ON p.ref = pt.ref AND p.p = pt.start GROUP BY ALL', reads=A.READS, pt="SELECT CAST(p_partkey AS BIGINT) AS call_id, CAST(p_partkey % 4 AS INT) AS ref, CAST((p_partkey * 61) % 5000 + 1 AS INT) AS start FROM {part}")
def a10_depth_at(spark, d):
    pt = A.view(spark, d, "SELECT CAST(p_partkey AS BIGINT) AS call_id, CAST(p_partkey % 4 AS INT) AS ref, CAST((p_partkey * 61) % 5000 + 1 AS INT) AS pos FROM {part}")
    return I.depth_at(pt, A.view(spark, d, A.READS).select("ref", "start", "end"), ["ref"], "pos", "depth", 1000).select("call_id", "ref", "pos", "depth")


@query(
    """, p AS (SELECT ref, unnest(range(start, "end" + 1)) AS p FROM reads), b AS (SELECT ref, CAST((p - 1) // 100 AS BIGINT) AS b, count(*) AS c FROM p GROUP BY ALL)
SELECT ref, b * 100 + 1 AS start, b * 100 + 100 AS "end", CAST(c AS BIGINT) AS covered, round(c / 100.0::DOUBLE, 6) AS mean_depth FROM b""",
    reads=A.READS,
)
def a11_binned_coverage(spark, d):
    return I.binned_coverage(A.view(spark, d, A.READS), ["ref"], 100).withColumn("mean_depth", F.round("mean_depth", 6))


@query(
    """, c AS (SELECT DISTINCT ref, start AS p FROM reg), b AS (SELECT ref, 1 + 500 * k AS s, 500 + 500 * k AS e FROM (SELECT DISTINCT ref FROM reg), range(0, 41) r(k)),
x AS (SELECT b.ref, s, p AS e FROM b JOIN c ON b.ref = c.ref AND p BETWEEN s AND e - 1 UNION SELECT ref, s, e FROM b)
SELECT ref, CAST(coalesce(lag(e) OVER (PARTITION BY ref, s ORDER BY e) + 1, s) AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM x""",
    reg=A.REGIONS,
)
def a11_split_bins(spark, d):
    reg = A.view(spark, d, A.REGIONS)
    k = reg.select("ref").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(40))))
    b = k.select("ref", (F.col("k") * 500 + 1).cast("long").alias("start"), (F.col("k") * 500 + 500).cast("long").alias("end"))
    return I.split_bins(b, reg.select("ref", F.col("start").cast("long").alias("pos")).distinct(), ["ref"])


@query(
    """, e AS (SELECT DISTINCT ref, pt FROM (SELECT ref, start AS pt FROM reg UNION ALL SELECT ref, "end" + 1 FROM reg)), s AS (SELECT * FROM (SELECT ref, pt AS s, lead(pt) OVER (PARTITION BY ref ORDER BY pt) - 1 AS e FROM e) WHERE e IS NOT NULL)
SELECT ref, s AS start, CAST(e AS INTEGER) AS "end", region_id, score FROM (SELECT s.*, g.region_id, g.score, row_number() OVER (PARTITION BY s.ref, s.s ORDER BY g.score DESC, g.region_id) AS r FROM s JOIN reg g ON g.ref = s.ref AND g.start <= s.e AND s.s <= g."end") WHERE r = 1""",
    reg=A.REGIONS,
)
def w10_best_by_position(spark, d):
    return I.best_by_position(A.view(spark, d, A.REGIONS), ["ref"], "score", "region_id")


@query('SELECT ref, CAST(k AS INTEGER) AS chunk, CAST(k * 300 + 1 AS BIGINT) AS start, CAST(least(k * 300 + 300, length) AS BIGINT) AS "end" FROM contigs, range(0, 100) r(k) WHERE k * 300 < length', contigs=A.CONTIGS)
def s6_chunks(spark, d):
    got = I.chunks(A.view(spark, d, A.CONTIGS), 300)
    return got.select("ref", "chunk", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_POS = "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey % 25 AS INT) AS ref, CAST(o_orderkey % 1000 + 1 AS BIGINT) AS pos FROM {orders}"


@query(", o AS (SELECT ref, coalesce(CAST(sum(length + 20) OVER (ORDER BY ref ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) + 10 AS off FROM contigs) SELECT id, ref, pos, pos + off AS linear FROM pos JOIN o USING (ref)", pos=_POS, contigs=A.CONTIGS)
def f42_linear_coordinates(spark, d):
    """There and back again."""
    off = coords.linear_offsets(A.view(spark, d, A.CONTIGS), 10)
    there = coords.to_linear(A.view(spark, d, _POS), off).select("id", "linear")
    return coords.from_linear(there, off).select("id", "ref", "pos", "linear")


@query(
    """SELECT e.event_id FROM (SELECT event_id, ref, pos, count(*) OVER (PARTITION BY ref ORDER BY pos RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) / 3600.0::DOUBLE AS density,
  CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM ev) e
WHERE density < 0.0005 OR u < exp(-(density - 0.0005) / 0.0005)""",
    ev="SELECT event_id, CAST(user_id % 8 AS INT) AS ref, CAST(epoch(ts) AS BIGINT) AS pos FROM {events}",
)
def w7_density_throttle(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", (F.col("user_id") % 8).cast("int").alias("ref"), F.floor(F.expr(A.utc("ts")) / 1_000_000).alias("pos"))
    return I.density_throttle(ev, ["ref"], "pos", F.col("event_id"), 3600, 0.0005, 0.001).select("event_id")


_READLEN = "list_sum(list_transform(regexp_extract_all(cigar_text, '(\\d+)[MIS=X]', 1), lambda x: CAST(x AS INTEGER)))"
_REFLEN = "list_sum(list_transform(regexp_extract_all(cigar_text, '(\\d+)[MDN=X]', 1), lambda x: CAST(x AS INTEGER)))"


@query(
    f"""SELECT CAST(max({_READLEN}) AS INTEGER) AS max_read_length, CAST(max(CASE WHEN flag & 4 = 0 THEN {_REFLEN} END) AS INTEGER) AS max_mapped_length,
min(CASE WHEN flag & 2 > 0 AND flag & 2304 = 0 AND fragment > 0 THEN fragment END) AS min_proper_fragment, max(CASE WHEN flag & 2 > 0 AND flag & 2304 = 0 AND fragment > 0 THEN fragment END) AS max_proper_fragment,
count(*) FILTER (flag & 2304 = 0) AS reads, count(*) FILTER (flag & 2304 = 0 AND flag & 4 = 0) AS mapped_reads, count(*) FILTER (flag & 2304 = 0 AND flag & 65 = 65) AS read_pairs,
count(*) FILTER (flag & 2304 = 0 AND flag & 65 = 65 AND flag & 12 = 0) AS pairs_both_mapped, count(*) FILTER (flag & 2304 = 0 AND flag & 65 = 65 AND flag & 12 IN (4, 8)) AS pairs_one_mapped,
count(*) FILTER (flag & 2304 = 0 AND flag & 65 = 65 AND flag & 12 = 12) AS pairs_zero_mapped, count(*) FILTER (flag & 256 > 0 AND rg <> 'A') AS secondary_not_split FROM reads""",
    reads=A.READS,
)
def a1_library_counters(spark, d):
    return M.library_counters(_reads(spark, d).withColumn("has_sa", F.col("rg") == "A"))


_HIST = """ops AS (SELECT regexp_extract_all(cigar_text, '\\d+[MIDNSH]') AS e FROM reads), el AS (SELECT unnest(e) AS x FROM ops), n AS (
  SELECT right(x, 1) AS op, CAST(left(x, length(x) - 1) AS INTEGER) AS length FROM el WHERE right(x, 1) IN ('M', 'I', 'D', 'N')
  UNION ALL SELECT o, 0 FROM ops, (VALUES ('M'), ('I'), ('D'), ('N')) v(o) WHERE len(list_filter(e, lambda z: right(z, 1) = o)) = 0
  UNION ALL SELECT 'S', CASE WHEN right(e[1], 1) = 'S' THEN CAST(left(e[1], length(e[1]) - 1) AS INTEGER) ELSE 0 END FROM ops UNION ALL SELECT 'S', CASE WHEN right(e[-1], 1) = 'S' THEN CAST(left(e[-1], length(e[-1]) - 1) AS INTEGER) ELSE 0 END FROM ops
  UNION ALL SELECT 'H', 0 FROM ops UNION ALL SELECT 'H', 0 FROM ops
), c AS (SELECT op, length, count(*) AS n FROM n GROUP BY ALL), h AS (SELECT d.op, d.length, coalesce(c.n, 0) AS n FROM (SELECT op, CAST(unnest(range(0, max(length) + 1)) AS INTEGER) AS length FROM c GROUP BY op) d LEFT JOIN c USING (op, length))"""


@query(f", {_HIST} SELECT * FROM h", reads=A.READS)
def a2_cigar_histogram(spark, d):
    return M.cigar_histogram(_reads(spark, d))


@query(f", {_HIST}, r AS (SELECT *, sum(n) OVER (PARTITION BY op ORDER BY length ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r, sum(n) OVER (PARTITION BY op) AS t FROM h) SELECT op, length, n, round(CASE WHEN r > 0 THEN -10 * log10(r / t::DOUBLE) + 0.0 END, 6) + 0.0 AS phred FROM r", reads=A.READS)
def a3_cigar_phred(spark, d):
    return M.tail_phred(M.cigar_histogram(_reads(spark, d))).withColumn("phred", F.round("phred", 6) + 0.0)


@query(
    """SELECT CASE WHEN grouping(rg) = 1 AND grouping(category) = 1 THEN CAST(3 AS BIGINT) WHEN grouping(rg) = 1 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS level, category, rg, max(CASE WHEN flag & 4 = 0 AND mapq <> 255 THEN mapq END) AS max_mapq, min(CASE WHEN flag & 4 = 0 AND mapq <> 255 THEN mapq END) AS min_mapq,
count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (flag & 4 = 0 AND mapq = 255) AS unknown, count(*) FILTER (flag & 4 = 0 AND mapq = 0) AS zero FROM reads GROUP BY ROLLUP (category, rg)""",
    reads=A.READS,
)
def a8_mapq_levels(spark, d):
    return M.mapq_metrics(A.view(spark, d, A.READS), ["category", "rg"])


@query("SELECT mapq, count(*) AS n FROM reads WHERE flag & 4 = 0 GROUP BY 1", reads=A.READS)
def a4_mapq_histogram(spark, d):
    return M.mapq_histogram(A.view(spark, d, A.READS))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(CASE WHEN rg = 'A' THEN ['SA', 'NM'] ELSE ['NM'] END) AS tag FROM reads) GROUP BY 1", reads=A.READS)
def a5_tag_counts(spark, d):
    tags = F.when(F.col("rg") == "A", F.create_map(F.lit("SA"), F.lit(""), F.lit("NM"), F.lit("1"))).otherwise(F.create_map(F.lit("NM"), F.lit("1")))
    return M.tag_counts(A.view(spark, d, A.READS).withColumn("tags", tags))


_FRAG = "h AS (SELECT fragment AS x, count(*) AS n FROM reads WHERE flag & 2 > 0 GROUP BY 1)"


def _frag(spark, d):
    return A.view(spark, d, A.READS).where("flag & 2 > 0").groupBy(F.col("fragment").alias("x")).agg(F.count(F.lit(1)).alias("n"))


@query(f", {_FRAG} SELECT x, n, round(n / (sum(n) OVER ())::DOUBLE, 9) AS pdf, round(sum(n) OVER (ORDER BY x) / (sum(n) OVER ())::DOUBLE, 9) AS cdf, round(sum(n) OVER (ORDER BY x DESC) / (sum(n) OVER ())::DOUBLE, 9) AS tail FROM h", reads=A.READS)
def f53_distribution(spark, d):
    got = M.distribution(_frag(spark, d))
    return got.select("x", "n", *[F.round(c, 9).alias(c) for c in ("pdf", "cdf", "tail")])


@query(f", {_FRAG}, c AS (SELECT x, sum(n) OVER (ORDER BY x) / (sum(n) OVER ())::DOUBLE AS cdf FROM h) SELECT min(x) FILTER (cdf >= 0.0025) AS p0, min(x) FILTER (cdf >= 0.5) AS p1, min(x) FILTER (cdf >= 0.9975) AS p2 FROM c", reads=A.READS)
def p8_percent_bounds(spark, d):
    return M.inverse_cdf(_frag(spark, d), [0.0025, 0.5, 0.9975])


@query(
    f""", {_FRAG}, c AS (SELECT x, n, sum(n) OVER (ORDER BY x) / (sum(n) OVER ())::DOUBLE AS cdf, sum(n) OVER (ORDER BY x DESC) / (sum(n) OVER ())::DOUBLE AS tail, (sum(n) OVER ())::DOUBLE AS t FROM h)
SELECT x, n, round(-10 * log10(least(1, (100000 - t + least(cdf, tail) * t) / 100000)) + 0.0, 6) + 0.0 AS phred FROM c""",
    reads=A.READS,
)
def a6_read_pair_phred(spark, d):
    return M.read_pair_phred(_frag(spark, d), 100_000).select("x", "n", (F.round("phred", 6) + 0.0).alias("phred"))


@query("SELECT category, mapq AS gc, count(*) AS n FROM reads GROUP BY category, mapq UNION ALL SELECT NULL, mapq, count(*) FROM reads GROUP BY mapq", reads=A.READS)
def a7_gc_histogram(spark, d):
    return M.gc_histogram(A.view(spark, d, A.READS).withColumn("gc", F.col("mapq")), ["category"])


@query("SELECT CAST(fragment_id AS BIGINT) AS pair_id, count(*) AS sides, min(qs) AS least, max(qs) AS most FROM ev GROUP BY 1 HAVING count(*) <> 2 OR min(qs) <> max(qs)", ev=A.EV)
def a35_asymmetric_pairs(spark, d):
    return M.asymmetric_pairs(A.view(spark, d, A.EV).withColumn("pair_id", F.col("fragment_id")))


_PON_BE = """SELECT CAST(o_custkey % 9 AS INT) AS ref, CASE WHEN o_orderstatus = 'F' THEN '+' ELSE '-' END AS dir, CAST((o_orderkey * 29) % 60000 + 1 AS INT) AS start, CAST((o_orderkey * 29) % 60000 + 1 + o_custkey % 6 AS INT) AS "end", CAST(1 + o_custkey % 2 AS BIGINT) AS n FROM {orders}"""


@query(
    """, x AS (SELECT ref, dir, start, "end", sum(n) AS n FROM be GROUP BY ALL), i AS (SELECT *, CASE WHEN start > coalesce(max("end") OVER (PARTITION BY ref, dir ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, -1) THEN 1 ELSE 0 END AS f FROM x),
g AS (SELECT *, sum(f) OVER (PARTITION BY ref, dir ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM i) SELECT ref, dir, min(start) AS start, max("end") AS "end", CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY ref, dir, k""",
    be=_PON_BE,
)
def a14_pon_breakends(spark, d):
    return pon.merge_breakends(A.view(spark, d, _PON_BE))


@query(None)
def a13_pon_breakpoints(spark, d):
    """Merged to a fixpoint, which SQL can't say; tested against brute force."""
    ev = A.view(spark, d, A.EV)
    wide = ev.withColumns({"start1": F.col("start1") * 40, "end1": F.col("start1") * 40 + 3, "start2": F.col("start2") * 40, "end2": F.col("start2") * 40 + 3})
    return pon.merge_breakpoints(wide.withColumn("n", F.lit(1).cast("long")), 64)


@query("SELECT ref1, start1, count(*) AS n FROM ev WHERE exact AND (mapq1 >= 30 OR (mapq1 = 0 AND mapq2 >= 20)) GROUP BY ALL", ev=A.EV)
def p22_pon_normals(spark, d):
    ev = A.view(spark, d, A.EV).select("ref1", "start1", F.col("mapq1").alias("qual"), F.col("mapq2").alias("bq"), (~F.col("exact")).alias("imprecise"))
    return pon.normal_calls(ev, ["ref1", "start1"], 30, 20)


_PANEL = """SELECT CAST(c_custkey % 4 AS INT) AS ref1, CASE WHEN c_nationkey % 2 = 0 THEN '+' ELSE '-' END AS dir1, CAST((c_custkey * 37) % 2000 + 1 AS INT) AS start1, CAST((c_custkey * 37) % 2000 + 3 AS INT) AS end1,
CAST(c_nationkey % 4 AS INT) AS ref2, CASE WHEN c_nationkey % 3 = 0 THEN '+' ELSE '-' END AS dir2, CAST((c_custkey * 53) % 2000 + 1 AS INT) AS start2, CAST((c_custkey * 53) % 2000 + 3 AS INT) AS end2, CAST(c_nationkey AS BIGINT) AS n FROM {customer}"""


@query("SELECT DISTINCT call_id FROM calls c JOIN p ON c.ref1 = p.ref1 AND c.dir1 = p.dir1 AND c.ref2 = p.ref2 AND c.dir2 = p.dir2 AND c.start1 <= p.end1 + 4 AND p.start1 - 4 <= c.end1 AND c.start2 <= p.end2 + 4 AND p.start2 - 4 <= c.end2 WHERE p.n >= 2", calls=A.CALLS, p=_PANEL)
def j16_in_panel(spark, d):
    return pon.in_panel(A.view(spark, d, A.CALLS), A.view(spark, d, _PANEL), 64, 4, 2)
