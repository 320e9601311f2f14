"""Views of the driver's tables in the engine's schemas, as SQL that both engines read: integer arithmetic and fixed rules, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_LINE = "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING))"

#: Breakpoint evidence.
EV = f"""
SELECT {_LINE} AS evidence_id, CAST(l_orderkey AS BIGINT) AS fragment_id, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS category,
  CASE CAST(l_linenumber AS INT) % 5 WHEN 0 THEN 'SR' WHEN 1 THEN 'IC' WHEN 2 THEN 'RP' WHEN 3 THEN 'SC' ELSE 'UM' END AS kind,
  CAST(l_suppkey % 4 AS INT) AS ref1, CASE WHEN l_returnflag = 'R' THEN '+' ELSE '-' END AS dir1,
  CAST((l_partkey * 37 + l_linenumber) % 2000 + 1 AS INT) AS start1, CAST((l_partkey * 37 + l_linenumber) % 2000 + 1 + CAST(l_quantity AS INT) AS INT) AS end1,
  CAST(l_orderkey % 4 AS INT) AS ref2, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS dir2,
  CAST((l_orderkey * 13) % 2000 + 1 AS INT) AS start2, CAST((l_orderkey * 13) % 2000 + 1 + CAST(l_quantity AS INT) AS INT) AS end2,
  CAST(round(l_discount * 100) AS BIGINT) * 65536 AS qs, CAST(round(l_discount * 600) AS INT) AS mapq1, CAST(round(l_tax * 700) AS INT) AS mapq2,
  CASE WHEN l_returnflag = 'A' THEN '+' ELSE '-' END AS strand, l_returnflag <> 'N' AS exact, l_linenumber = 1 AS is_assembly, CAST(l_suppkey AS BIGINT) AS assembly_id
FROM {{lineitem}}"""

#: Breakend evidence.
BE = """
SELECT CAST(o_orderkey AS STRING) AS evidence_id, CAST(o_custkey AS BIGINT) AS fragment_id, CAST(o_custkey % 4 AS INT) AS ref, CASE WHEN o_orderstatus = 'F' THEN '+' ELSE '-' END AS dir,
  CAST((o_orderkey * 29) % 3000 + 1 AS INT) AS start, CAST((o_orderkey * 29) % 3000 + 1 + o_custkey % 40 AS INT) AS "end", CAST(floor(o_totalprice) AS BIGINT) AS qs, CAST(o_custkey % 3 AS INT) AS category
FROM {orders}"""

#: Breakpoint calls.
CALLS = """
SELECT CAST(p_partkey AS BIGINT) AS call_id, CAST(p_partkey % 4 AS INT) AS ref1, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS dir1,
  CAST((p_partkey * 37) % 2000 + 1 AS INT) AS start1, CAST((p_partkey * 37) % 2000 + 1 + p_size AS INT) AS end1, CAST(p_size % 4 AS INT) AS ref2, CASE WHEN p_size % 3 = 0 THEN '+' ELSE '-' END AS dir2,
  CAST((p_partkey * 53) % 2000 + 1 AS INT) AS start2, CAST((p_partkey * 53) % 2000 + 1 + p_size AS INT) AS end2, CAST(round(p_retailprice * 10) AS BIGINT) % 100 AS score
FROM {part}"""

#: Single-breakend calls.
BE_CALLS = """
SELECT CAST(c_custkey AS BIGINT) + 1000000 AS call_id, CAST(c_custkey % 4 AS INT) AS ref1, CASE WHEN c_nationkey % 2 = 0 THEN '+' ELSE '-' END AS dir1,
  CAST((c_custkey * 41) % 3000 + 1 AS INT) AS start1, CAST((c_custkey * 41) % 3000 + 1 + c_nationkey AS INT) AS end1, CAST(c_nationkey AS BIGINT) AS score
FROM {customer}"""

#: Aligned spans.
READS = f"""
SELECT {_LINE} AS read_id, CAST(l_orderkey AS STRING) AS read_name, CAST(l_partkey % 4 AS INT) AS ref, CAST((l_partkey * 97 + l_suppkey) % 5000 + 1 AS INT) AS start,
  CAST((l_partkey * 97 + l_suppkey) % 5000 + CAST(l_quantity AS INT) AS INT) AS "end", CAST(round(l_discount * 600) AS INT) AS mapq, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS category,
  CAST(l_linenumber % 2 AS INT) AS segment, l_returnflag AS rg, CAST(CAST(l_quantity AS INT) + l_linenumber * 60 AS INT) AS fragment,
  CAST(1 + CASE WHEN l_linenumber % 2 = 0 THEN 64 ELSE 128 END + CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END + CASE WHEN l_partkey % 17 = 0 THEN 4 ELSE 0 END + CASE WHEN l_partkey % 13 = 0 THEN 8 ELSE 0 END
    + CASE WHEN l_linestatus = 'F' THEN 16 ELSE 32 END + CASE WHEN l_linenumber = 5 THEN 256 ELSE 0 END + CASE WHEN l_linenumber = 6 THEN 2048 ELSE 0 END AS INT) AS flag,
  CASE CAST(l_linenumber % 4 AS INT) WHEN 0 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), 'S', '40M') WHEN 1 THEN concat('20M', CAST(CAST(l_quantity AS INT) AS STRING), 'D30M')
    WHEN 2 THEN concat('25M', CAST(CAST(l_quantity AS INT) AS STRING), 'I22M3S') ELSE concat(CAST(50 + CAST(l_quantity AS INT) AS STRING), 'M') END AS cigar_text
FROM {{lineitem}}"""

#: Excluded regions.
REGIONS = """
SELECT CAST(p_partkey % 4 AS INT) AS ref, CAST((p_partkey * 97) % 20000 + 1 AS INT) AS start, CAST((p_partkey * 97) % 20000 + p_size AS INT) AS "end", CAST(p_partkey AS BIGINT) AS region_id, CAST(round(p_retailprice) AS BIGINT) AS score
FROM {part}"""

CONTIGS = "SELECT CAST(n_nationkey AS INT) AS ref, CAST(1000 + 37 * n_nationkey AS BIGINT) AS length FROM {nation}"

#: A taxonomy of four levels, ids offset by level.
TAX = """
SELECT CAST(1 AS BIGINT) AS taxid, CAST(1 AS BIGINT) AS parent, 'root' AS rank
UNION ALL SELECT CAST(10 + r_regionkey AS BIGINT), CAST(1 AS BIGINT), 'family' FROM {region}
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(10 + n_regionkey AS BIGINT), 'genus' FROM {nation}
UNION ALL SELECT CAST(1000 + s_suppkey AS BIGINT), CAST(100 + s_nationkey AS BIGINT), 'species' FROM {supplier}
UNION ALL SELECT CAST(1000000 + c_custkey AS BIGINT), CAST(100 + c_nationkey AS BIGINT), 'species' FROM {customer}"""

#: Sequences: letters of whole texts, folded onto the four bases.
SEQS = """
SELECT CAST(doc_id AS BIGINT) AS read, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', ''{G})), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACCGGTTAACCGTTAACGTACGTTAC') AS seq FROM {documents}"""
ITEMS = """
SELECT CAST(item_id AS BIGINT) AS read, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', ''{G})), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACCGGTTAACCGTTAACGTACGTTAC') AS seq FROM {benchmark}"""

#: Single breakends with quality, for links.
ENDS = """
SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey % 5 AS INT) AS sample, CAST(o_custkey % 7 AS INT) AS ref, CASE WHEN o_orderstatus = 'F' THEN '+' ELSE '-' END AS dir,
  CAST((o_orderkey * 211) % 400000 + 1 AS INT) AS start, CAST((o_orderkey * 211) % 400000 + 1 + o_custkey % 3 AS INT) AS "end", CAST(floor(o_totalprice) AS BIGINT) AS qual, CAST(o_custkey AS BIGINT) AS event
FROM {orders}"""

#: Calls with two samples' counts, for somatic filters.
SOMATIC = f"""
SELECT {_LINE} AS id, l_linenumber <> 7 AS is_bp, CAST(l_suppkey % 3 AS INT) AS ref1, CAST(l_orderkey % 3 AS INT) AS ref2, CASE WHEN l_returnflag = 'R' THEN '+' ELSE '-' END AS dir1, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS dir2,
  CAST((l_partkey * 37) % 3000 + 1 AS INT) AS start1, CAST((l_orderkey * 13) % 3000 + 1 AS INT) AS start2, CAST(CAST(l_quantity AS INT) % 20 AS INT) AS ins_len, CAST(l_partkey % 60 AS INT) AS homlen, CAST(l_orderkey % 70 AS INT) AS ihomlen,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE round(l_discount * 100) / 10 END AS sb, round(l_tax * 100) / 800 AS t_af, CAST(l_linenumber % 2 AS INT) AS n_rp, CAST(l_partkey % 3 AS INT) AS t_rp, CAST(l_suppkey % 2 AS INT) AS n_sr, CAST(l_orderkey % 4 AS INT) AS t_sr,
  CAST(l_partkey % 2 AS INT) AS n_asrp, CAST(l_suppkey % 5 AS INT) AS t_asrp, CAST(l_partkey % 5 AS INT) AS n_vf, CAST(l_orderkey % 200 AS INT) AS t_vf, CAST(l_suppkey % 6 AS INT) AS n_ref, CAST(l_orderkey % 6 AS INT) AS n_refpair,
  l_linenumber = 2 AS in_pon, l_linenumber = 4 AS no_assembly, CAST(round(l_extendedprice) AS BIGINT) % 2000 AS qual
FROM {{lineitem}}"""



def utc(column: str) -> str:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view in this engine."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace("{G}", "").replace('"end"', "`end`"), **used)


def duck(sql: str) -> str:
    """The same view as a subquery for the oracle."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("{G}", ", 'g'")
