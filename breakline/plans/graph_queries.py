"""Queries of k-mers, links, taxonomy, evidence construction and assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cigar as C
from ..operators import align, assembly, evidence, kmers, links, taxonomy
from . import adapters as A
from .registry import query

_K = 15


@query(f", k AS (SELECT unnest(list_transform(range(1, greatest(length(seq) - {_K - 1}, 0) + 1), lambda i: substr(seq, i, {_K}))) AS kmer FROM seqs) SELECT kmer, count(*) AS n FROM k GROUP BY 1", seqs=A.ITEMS)
def a28_kmer_counts(spark, d):
    return kmers.count_kmers(A.view(spark, d, A.ITEMS), _K)


@query(f", k AS (SELECT DISTINCT read, unnest(list_transform(range(1, greatest(length(seq) - {_K - 1}, 0) + 1), lambda i: substr(seq, i, {_K}))) AS kmer FROM seqs), c AS (SELECT kmer, count(*) AS n FROM k GROUP BY 1) SELECT n AS reads, count(*) AS kmers FROM c GROUP BY 1", seqs=A.SEQS)
def a28_kmer_spectrum(spark, d):
    """How many k-mers occur in how many of all documents."""
    return kmers.count_kmers(A.view(spark, d, A.SEQS), _K, per_read=True).groupBy(F.col("n").alias("reads")).agg(F.count(F.lit(1)).alias("kmers"))


@query(
    f""", s AS (SELECT read AS contig, i, substr(seq, i + 1, {_K}) AS kmer FROM items, LATERAL (SELECT unnest(range(0, greatest(length(seq) - {_K - 1}, 0), 3)) AS i)),
r AS (SELECT DISTINCT contig, kmer FROM (SELECT contig, kmer FROM s UNION ALL SELECT contig, reverse(translate(kmer, 'ACGT', 'TGCA')) FROM s)),
q AS (SELECT kmer, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(length(seq) - {_K - 1}, 0) + 1), lambda i: substr(seq, i, {_K}))) AS kmer FROM seqs) GROUP BY 1)
SELECT contig, CAST(sum(n) AS BIGINT) AS hits FROM q JOIN r USING (kmer) GROUP BY 1""",
    seqs=A.SEQS, items=A.ITEMS,
)
def a29_contig_hits(spark, d):
    return taxonomy.contig_hits(A.view(spark, d, A.SEQS), A.view(spark, d, A.ITEMS).select(F.col("read").alias("contig"), "seq"), _K, 3)


_NODES = """SELECT CAST(l_partkey % 50 AS BIGINT) AS code, CAST((l_orderkey * 7) % 2000 AS INT) AS start, CAST((l_orderkey * 7) % 2000 + CAST(l_quantity AS INT) AS INT) AS "end", CAST(l_linenumber AS BIGINT) AS weight, l_returnflag = 'R' AS is_ref FROM {lineitem}"""


@query(
    """, p AS (SELECT code, unnest(range(start, "end" + 1)) AS p, weight, is_ref FROM nodes), s AS (SELECT code, p, CAST(sum(weight) AS BIGINT) AS weight, bool_or(is_ref) AS is_ref FROM p GROUP BY ALL),
e AS (SELECT DISTINCT code, pt FROM (SELECT code, start AS pt FROM nodes UNION ALL SELECT code, "end" + 1 FROM nodes)), g AS (SELECT s.*, (SELECT max(pt) FROM e WHERE e.code = s.code AND e.pt <= s.p) AS at_edge FROM s)
SELECT code, CAST(at_edge AS INTEGER) AS start, CAST(max(p) AS INTEGER) AS "end", any_value(weight) AS weight, any_value(is_ref) AS is_ref FROM g GROUP BY code, at_edge""",
    nodes=_NODES,
)
def a30_aggregate_nodes(spark, d):
    return kmers.aggregate_nodes(A.view(spark, d, _NODES))


@query(
    f""", k AS (SELECT read, i AS start, substr(seq, i, {_K}) AS kmer FROM seqs, LATERAL (SELECT unnest(range(1, greatest(length(seq) - {_K - 1}, 0) + 1)) AS i))
SELECT DISTINCT a.kmer AS a_kmer, CAST(a.start AS BIGINT) AS a_start, b.kmer AS b_kmer, CAST(b.start AS BIGINT) AS b_start FROM k a JOIN k b ON substr(a.kmer, 2) = substr(b.kmer, 1, {_K - 1}) AND b.start = a.start + 1""",
    seqs=A.ITEMS,
)
def j27_kmer_adjacency(spark, d):
    k = kmers.kmer_rows(A.view(spark, d, A.ITEMS), _K).select("kmer", (F.col("off") + 1).cast("long").alias("start"), (F.col("off") + 1).cast("long").alias("end")).distinct()
    return kmers.adjacency(k, _K).select("a_kmer", "a_start", "b_kmer", "b_start")


_W = """SELECT CAST(read * 100 + o AS BIGINT) AS read, substr(seq, o * 20 + 1, 90) AS seq FROM (SELECT read, seq, unnest(range(0, CAST(floor(greatest(length(seq) - 60, 0) / 20) AS BIGINT) + 1)) AS o FROM items)"""


@query(
    f""", seqs AS ({_W}), o AS (SELECT a.read AS a, b.read AS b, i AS off, CAST(length(a.seq) - i AS INTEGER) AS len, a.seq AS x, b.seq AS y FROM seqs a, LATERAL (SELECT unnest(range(1, greatest(length(a.seq) - {_K - 1}, 1))) AS i), seqs b WHERE a.read <> b.read AND length(b.seq) >= {_K} AND substr(a.seq, i + 1, {_K}) = substr(b.seq, 1, {_K}))
SELECT a, b, CAST(off AS INTEGER) AS off, len FROM o WHERE len >= 30 AND len <= length(y) AND substr(x, off + 1) = substr(y, 1, len)""",
    items=A.ITEMS,
)
def j28_read_overlaps(spark, d):
    return kmers.read_overlaps(_windows(spark, d), _K, 30)


def _windows(spark, d):
    """Overlapping windows of the benchmark's sequences, as reads."""
    n = F.floor(F.greatest(F.length("seq") - 60, F.lit(0)) / 20).cast("int")
    w = A.view(spark, d, A.ITEMS).select("read", "seq", F.explode(F.sequence(F.lit(0), n)).alias("o"))
    return w.select((F.col("read") * 100 + F.col("o")).alias("read"), F.substring(F.col("seq"), F.col("o") * 20 + 1, F.lit(90)).alias("seq"))


@query(
    f""", seqs AS ({_W}), o AS (SELECT DISTINCT a.read AS a, b.read AS b, CAST(i AS INTEGER) AS off FROM seqs a, LATERAL (SELECT unnest(range(1, greatest(length(a.seq) - {_K - 1}, 1))) AS i), seqs b
  WHERE a.read <> b.read AND length(b.seq) >= {_K} AND substr(a.seq, i + 1, {_K}) = substr(b.seq, 1, {_K}) AND length(a.seq) - i >= 30 AND length(a.seq) - i <= length(b.seq) AND substr(a.seq, i + 1) = substr(b.seq, 1, length(a.seq) - i))
SELECT a, b, off FROM o WHERE NOT EXISTS (SELECT 1 FROM o x JOIN o y ON x.b = y.a WHERE x.a = o.a AND y.b = o.b AND x.off + y.off = o.off)""",
    items=A.ITEMS,
)
def g15_transitive_reduction(spark, d):
    return kmers.transitive_reduction(kmers.read_overlaps(_windows(spark, d), _K, 30).select("a", "b", "off"))


_NEAR = """SELECT q.id AS q_id, s.id AS s_id, q.qual AS q_qual, s.qual AS s_qual, q.dir AS q_dir, s.dir AS s_dir, q.event AS q_event, s.event AS s_event, q.start AS q_start, s.start AS s_start, q."end" AS q_end, s."end" AS s_end
FROM ends q JOIN ends s ON q.sample = s.sample AND q.ref = s.ref AND q.start - {g} <= s."end" AND s.start <= q."end" + {g}"""


@query(f", n AS ({_NEAR.format(g=36)}), w AS (SELECT *, (s_end - q_start) * CASE WHEN q_dir = '-' THEN 1 ELSE -1 END AS a, (s_start - q_end) * CASE WHEN q_dir = '-' THEN 1 ELSE -1 END AS b FROM n) SELECT q_id, s_id, CAST(least(a, b) AS INTEGER) AS least_walk, CAST(greatest(a, b) AS INTEGER) AS most_walk FROM w WHERE q_dir || s_dir IN ('-+', '+-')", ends=A.ENDS)
def j17_adjacent(spark, d):
    e = A.view(spark, d, A.ENDS)
    return links.adjacent(e, e, 35, ("-+", "+-")).select("q_id", "s_id", "least_walk", "most_walk")


@query(
    f""", n AS ({_NEAR.format(g=1001)}), a AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY q_id ORDER BY s_qual DESC) AS r FROM n WHERE q_dir <> s_dir) WHERE r = 1), b AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY s_id ORDER BY q_qual DESC) AS r2 FROM a) WHERE r2 = 1)
SELECT x.q_id, x.s_id FROM b x WHERE x.q_id < x.s_id AND EXISTS (SELECT 1 FROM b y WHERE y.q_id = x.s_id AND y.s_id = x.q_id)""",
    ends=A.ENDS,
)
def j18_breakend_insertions(spark, d):
    return links.breakend_insertions(A.view(spark, d, A.ENDS), 1000)


@query(
    f""", n AS ({_NEAR.format(g=1001)}), c AS (SELECT *, count(*) OVER (PARTITION BY q_id) AS a, count(*) OVER (PARTITION BY s_id) AS b FROM n WHERE q_dir <> s_dir AND q_event <> s_event) SELECT q_id, s_id FROM c WHERE a = 1 AND b = 1 AND q_id < s_id""",
    ends=A.ENDS,
)
def j19_unique_neighbours(spark, d):
    return links.linked_neighbours(A.view(spark, d, A.ENDS), 1000)


@query(
    f""", n AS ({_NEAR.format(g=1001)}), c AS (SELECT *, abs(q_start - s_start) AS d, min(abs(q_start - s_start)) OVER (PARTITION BY q_id) AS a, min(abs(q_start - s_start)) OVER (PARTITION BY s_id) AS b FROM n WHERE q_dir <> s_dir AND q_event <> s_event) SELECT q_id, s_id FROM c WHERE d = a AND d = b AND q_id < s_id""",
    ends=A.ENDS,
)
def j19_closest_neighbours(spark, d):
    return links.linked_neighbours(A.view(spark, d, A.ENDS), 1000, "closest")


_ASM_CALLS = "SELECT CAST(l_orderkey AS STRING) AS id, CAST(l_orderkey + 1 AS STRING) AS mate_id, CAST(l_suppkey AS STRING) AS beid, CAST(l_partkey % 600 AS INT) AS beidl FROM {lineitem}"


@query(
    """, e AS (SELECT DISTINCT id, mate_id, concat_ws('/', beid, CAST(beidl AS VARCHAR)) AS link FROM c), g AS (SELECT link, count(*) AS n, min(id) AS a, max(id) AS b, max(id || '|' || mate_id) AS m FROM e GROUP BY 1)
SELECT link, a, b FROM g WHERE n = 2 AND split_part(m, '|', 2) <> a""",
    c=_ASM_CALLS,
)
def j20_assembly_links(spark, d):
    c = A.view(spark, d, _ASM_CALLS).groupBy("id", "mate_id").agg(F.collect_list(F.struct("beid", "beidl")).alias("x"))
    return links.assembly_links(c.select("id", "mate_id", F.col("x.beid").alias("beid"), F.col("x.beidl").alias("beidl")))


@query(f""", n AS ({_NEAR.format(g=3)}) SELECT id, CAST(count(DISTINCT s_id) AS BIGINT) AS n_truth FROM ends LEFT JOIN n ON id = q_id AND s_dir = '+' GROUP BY 1""", ends=A.ENDS)
def j24_truth(spark, d):
    e = A.view(spark, d, A.ENDS)
    return links.truth_annotation(e, e.where("dir = '+'"), 2)


@query("SELECT CAST(c_custkey AS VARCHAR) || e AS id, CASE WHEN e = 'xo' THEN CAST(c_custkey AS VARCHAR) || 'yo,' || CAST(c_custkey AS VARCHAR) || 'zo' ELSE CAST(c_custkey AS VARCHAR) || 'zh,' || CAST(c_custkey AS VARCHAR) || 'yh' END AS path, CAST(400 + c_nationkey AS BIGINT) AS distance FROM customer, (SELECT unnest(['xo', 'xh']) AS e)")
def j22_transitive_paths(spark, d):
    """A call from A to B beside two calls from A to C and from C to B, for each customer; tested by hand-made cases."""
    c = A.view(spark, d, "SELECT CAST(c_custkey AS BIGINT) AS k, CAST(c_nationkey AS INT) AS n FROM {customer}")
    base = F.col("k") * 1_000_000

    def call(name: str, dir1: str, pos1, dir2: str, pos2):
        one = c.select(F.concat(F.col("k").cast("string"), F.lit(name + "o")).alias("id"), F.concat(F.col("k").cast("string"), F.lit(name + "h")).alias("mate_id"), F.lit(0).alias("ref"), F.lit(dir1).alias("dir"), pos1.alias("start"))
        two = c.select(F.concat(F.col("k").cast("string"), F.lit(name + "h")).alias("id"), F.concat(F.col("k").cast("string"), F.lit(name + "o")).alias("mate_id"), F.lit(0).alias("ref"), F.lit(dir2).alias("dir"), pos2.alias("start"))
        return one.unionByName(two)

    direct = call("x", "+", base + 1000, "-", base + 500_000)
    first = call("y", "+", base + 1000 + F.col("n") % 3, "-", base + 200_000)
    second = call("z", "+", base + 200_400 + F.col("n"), "-", base + 500_000)
    rows = direct.unionByName(first).unionByName(second)
    return links.transitive_paths(rows.withColumn("end", F.col("start")), 5, 1000, 3)


_TREE = "up AS (WITH RECURSIVE u(taxid, ancestor, steps) AS (SELECT taxid, taxid, 0 FROM tax UNION ALL SELECT u.taxid, t.parent, steps + 1 FROM u JOIN tax t ON u.ancestor = t.taxid WHERE t.parent <> t.taxid) SELECT * FROM u)"


@query(f", {_TREE} SELECT taxid, ancestor, steps FROM up", tax=A.TAX)
def j25_closure(spark, d):
    return taxonomy.closure(A.view(spark, d, A.TAX))


_DIRECT = "SELECT CAST(1000000 + o_custkey AS BIGINT) AS taxid, CAST(count(*) AS BIGINT) AS reads FROM {orders} GROUP BY o_custkey"


#: Taxa with a sequence: those in credit.
_HAS = "SELECT CAST(1000000 + c_custkey AS BIGINT) AS taxid FROM {customer} WHERE c_acctbal > 0"


@query(f", {_TREE} SELECT ancestor AS taxid, CAST(sum(reads) AS BIGINT) AS tree_reads FROM direct JOIN up USING (taxid) GROUP BY 1", tax=A.TAX, direct=_DIRECT)
def a31_tree_sums(spark, d):
    return taxonomy.tree_sums(A.view(spark, d, _DIRECT), A.view(spark, d, A.TAX))


@query(
    f""", {_TREE}, t AS (SELECT ancestor AS taxid, CAST(sum(reads) AS BIGINT) AS tree_reads FROM direct JOIN up USING (taxid) GROUP BY 1), g AS (SELECT taxid, ancestor AS grp FROM (SELECT up.taxid, ancestor, row_number() OVER (PARTITION BY up.taxid ORDER BY steps, ancestor) AS r FROM up JOIN tax x ON x.taxid = up.ancestor WHERE x.rank = 'genus') WHERE r = 1),
k AS (SELECT t.taxid, coalesce(grp, t.taxid) AS "group", tree_reads, coalesce(reads, 0) AS direct_reads FROM t LEFT JOIN direct USING (taxid) LEFT JOIN g USING (taxid) JOIN has USING (taxid) WHERE tree_reads >= 5)
SELECT * FROM (SELECT taxid, "group", tree_reads, direct_reads FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY direct_reads DESC, tree_reads DESC, taxid) AS r FROM k) WHERE r <= 2 ORDER BY direct_reads DESC, tree_reads DESC, taxid LIMIT 20)""",
    tax=A.TAX, direct=_DIRECT, has=_HAS,
)
def a31_rank_taxa(spark, d):
    tax, direct = A.view(spark, d, A.TAX), A.view(spark, d, _DIRECT)
    has = A.view(spark, d, _HAS).withColumn("has_sequence", F.lit(True))
    rep = taxonomy.tree_sums(direct, tax).join(direct, "taxid", "left").join(has, "taxid", "left").select("taxid", "tree_reads", F.coalesce("reads", F.lit(0)).cast("long").alias("direct_reads"), F.coalesce("has_sequence", F.lit(False)).alias("has_sequence"))
    return taxonomy.rank_taxa(rep, tax, "genus", 5, 2, 20)


_FOUND = "SELECT CAST(l_suppkey AS BIGINT) AS taxid, CAST(l_linenumber AS INT) AS source_order, concat('seq', CAST(l_partkey AS STRING)) AS seq_id FROM {lineitem} WHERE l_returnflag = 'A'"


@query("SELECT taxid, source_order, seq_id FROM (SELECT *, row_number() OVER (PARTITION BY taxid ORDER BY source_order, seq_id) AS r FROM f) WHERE r = 1", f=_FOUND)
def j26_first_source(spark, d):
    return taxonomy.first_source(A.view(spark, d, _FOUND))


_KM = "SELECT CAST(l_orderkey AS BIGINT) AS read, CAST(l_linenumber AS INT) * 100000000 + l_partkey AS pos, CAST(l_suppkey AS BIGINT) AS taxid FROM {lineitem}"


@query(
    """, k AS (SELECT read, row_number() OVER (PARTITION BY read ORDER BY pos, taxid) AS p, taxid FROM km), e AS (SELECT read, min(p) FILTER (taxid % 5 = 0) AS g1, min(p) FILTER (taxid % 5 > 1) AS b1, max(p) FILTER (taxid % 5 = 0) AS g2, max(p) FILTER (taxid % 5 > 1) AS b2, max(taxid) AS t FROM k GROUP BY 1)
SELECT read FROM e WHERE t % 5 = 0 OR (g1 IS NOT NULL AND (b1 IS NULL OR g1 < b1 OR g2 > b2))""",
    km=_KM,
)
def p24_keep_classified(spark, d):
    km = A.view(spark, d, _KM)
    reads = km.groupBy("read").agg(F.array_sort(F.collect_list(F.struct("pos", "taxid"))).alias("x"), F.max("taxid").alias("taxid"))
    reads = reads.select("read", "taxid", F.transform("x", lambda y: F.struct(y["taxid"].alias("taxid"), F.lit(1).alias("count"))).alias("kmers"))
    ids = km.select("taxid").distinct()
    return taxonomy.keep_classified(reads, ids.where("taxid % 5 = 0"), ids.where("taxid % 5 = 1"))


def _reads(spark, d):
    r = A.view(spark, d, A.READS)
    sa = F.when(F.col("rg") == "A", F.concat(F.lit("chr"), ((F.col("ref") + 1) % 4).cast("string"), F.lit(","), (F.col("start") + 500).cast("string"), F.lit(",+,30M1000S,40,0;")))
    mate = F.col("start") + F.col("fragment") - 40
    return r.select(F.col("read_id").alias("read_name"), "flag", F.concat(F.lit("chr"), F.col("ref").cast("string")).alias("ref"), F.col("start").alias("pos"), "mapq", C.parse(F.col("cigar_text")).alias("cigar"), F.lit(None).cast("string").alias("seq"), sa.alias("sa"), F.lit(0).alias("nm"), F.concat(F.lit("chr"), F.col("ref").cast("string")).alias("mate_ref"), mate.alias("mate_pos"), C.parse(F.lit("50M")).alias("mate_cigar"), F.lit(40).alias("mate_mapq"), "category")


@query(
    """, x AS (SELECT read_id, ref, start, mapq, category, CAST(regexp_extract(cigar_text, '(\\d+)[ID]', 1) AS INTEGER) AS n, CASE WHEN contains(cigar_text, 'D') THEN 'D' ELSE 'I' END AS op, CASE WHEN contains(cigar_text, 'D') THEN 20 ELSE 25 END AS pre FROM reads WHERE flag & 4 = 0 AND regexp_matches(cigar_text, '[ID]')),
y AS (SELECT *, start + pre - 1 AS l, start + pre + CASE WHEN op = 'D' THEN n ELSE 0 END AS r FROM x WHERE n >= 10)
SELECT read_id AS fragment_id, 'chr' || CAST(ref AS VARCHAR) AS ref1, dir AS dir1, CAST(CASE dir WHEN '+' THEN l ELSE r END AS INTEGER) AS start1, CASE dir WHEN '+' THEN '-' ELSE '+' END AS dir2, CAST(CASE dir WHEN '+' THEN r ELSE l END AS INTEGER) AS start2, n AS size, op FROM y, (VALUES ('+'), ('-')) v(dir)""",
    reads=A.READS,
)
def e3_indel_evidence(spark, d):
    return evidence.indels(_reads(spark, d), 10).select("fragment_id", "ref1", "dir1", "start1", "dir2", "start2", "size", "op")


@query(
    """, x AS (SELECT *, CAST(coalesce(nullif(regexp_extract(cigar_text, '^(\\d+)S', 1), ''), '0') AS INTEGER) AS a, CAST(coalesce(nullif(regexp_extract(cigar_text, '(\\d+)S$', 1), ''), '0') AS INTEGER) AS b,
  start + list_sum(list_transform(regexp_extract_all(cigar_text, '(\\d+)[MD]', 1), lambda q: CAST(q AS INTEGER))) - 1 AS e FROM reads WHERE flag & 4 = 0 AND rg <> 'A')
SELECT read_id AS fragment_id, '-' AS dir1, start AS start1, a AS size FROM x WHERE a >= 5 UNION ALL SELECT read_id, '+', CAST(e AS INTEGER), b FROM x WHERE b >= 5""",
    reads=A.READS,
)
def e4_soft_clip_evidence(spark, d):
    r = _reads(spark, d)
    return evidence.soft_clips(r.where(F.col("sa").isNull()), 5).select("fragment_id", "dir1", "start1", "size")


@query(None)
def e1_all_evidence(spark, d):
    """All kinds of evidence of all reads; its parts are tested on hand-made reads."""
    conc = F.col("flag").bitwiseAND(F.lit(2)) != 0
    return evidence.all_evidence(_reads(spark, d), 500, conc, 5, 10)


@query(None)
def g16_smith_waterman(spark, d):
    """Each benchmark item's sequence against the next one's; the kernel is tested against a plain table."""
    s = A.view(spark, d, A.ITEMS)
    pairs = s.select("read", F.col("seq").alias("q")).join(s.select((F.col("read") - 1).alias("read"), F.col("seq").alias("r")), "read")
    return align.aligned(pairs, "q", "r").select("read", "score", "at", "aln")


@query(None)
def g12_assemble(spark, d):
    """Contigs of overlapping windows of the benchmark sequences; the kernel is tested on planted breakends."""
    s = A.view(spark, d, A.ITEMS)
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 60, F.lit(0)), F.lit(10))
    w = s.select("read", F.explode(starts).alias("o"), "seq").select(F.concat_ws("_", F.col("read").cast("string"), F.col("o").cast("string")).alias("evidence_id"), (F.col("read") % 4).cast("int").alias("ref"), F.lit("+").alias("dir"), F.substring(F.col("seq"), F.col("o") + 1, F.lit(60)).alias("seq"), (F.col("read") * 100000 + F.col("o")).alias("lo"), F.lit(10).alias("weight"), F.when(F.col("o") == 0, 30).otherwise(0).alias("anchor_bases"))
    got = assembly.assemble(w.withColumn("hi", F.col("lo")), 25, 1_000_000, 1000)
    return assembly.assembly_records(got).select("name", "ref", "pos", "cigar", "kind", "weight", "n_reads")


@query(None)
def g14_consensus(spark, d):
    """The consensus of each benchmark item's overlapping windows; the kernel is tested on planted sequences."""
    w = _windows(spark, d)
    rows = w.select(F.floor(F.col("read") / 100).cast("long").alias("item"), "seq", F.lit(1).alias("weight"))
    return assembly.consensus_by(rows, "item", 21).select("item", F.length("consensus").alias("bases"), "n")


@query(
    f""", k AS (SELECT unnest(list_transform(range(1, greatest(length(seq) - 6, 0) + 1), lambda i: substr(seq, i, 7))) AS kmer FROM seqs), c AS (SELECT kmer, count(*) AS n FROM k GROUP BY 1),
e AS (SELECT kmer, n, i, substr(kmer, 1, i - 1) || '.' || substr(kmer, i + 1) AS blank FROM c, range(1, 8) r(i)), p AS (SELECT a.kmer, b.kmer AS t, b.n FROM e a JOIN e b ON a.blank = b.blank AND a.kmer <> b.kmer WHERE b.n >= a.n * 4)
SELECT kmer, t AS "to", n AS n_to FROM (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY n DESC, t) AS r FROM p) WHERE r = 1""",
    seqs=A.ITEMS,
)
def g10_error_correction(spark, d):
    return kmers.corrections(kmers.count_kmers(A.view(spark, d, A.ITEMS), 7), 4)
