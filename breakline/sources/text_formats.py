"""Readers of the text formats: SAM, VCF, BED, BEDPE, FASTA, FASTQ, classification reports, taxonomy dumps, repeat annotations, metrics.

All are ``spark.read.text`` and column expressions, so files split over tasks and only wanted columns are parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar as C
from ..functions.seq import parse_breakend_allele


def _lines(spark: SparkSession, path, comment: str | None = None) -> DataFrame:
    rows = spark.read.text(path)
    return rows.where(~F.startswith("value", F.lit(comment)) & (F.col("value") != "")) if comment else rows.where(F.col("value") != "")


def _field(parts: Column, k: int, kind: str = "string") -> Column:
    x = F.get(parts, k)
    return F.when(x.isin("", "."), F.lit(None)).otherwise(x).cast(kind) if kind != "string" else x


def read_sam(spark: SparkSession, path, category: int = 0) -> DataFrame:
    """Alignments of SAM text. Positions are 1-based; tags are a map, and SA and NM columns too."""
    t = F.split("value", "\t")
    tags = F.transform(F.slice(t, F.lit(12), F.greatest(F.size(t) - 11, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substring(x, F.lit(6), F.length(x)).alias("v")))
    m = F.map_from_entries(tags)
    mate = F.when(_field(t, 6) == "=", _field(t, 2)).otherwise(_field(t, 6))
    return _lines(spark, path, "@").select(
        _field(t, 0).alias("read_name"), _field(t, 1, "int").alias("flag"), _field(t, 2).alias("ref"), _field(t, 3, "int").alias("pos"), _field(t, 4, "int").alias("mapq"),
        C.parse(_field(t, 5)).alias("cigar"), mate.alias("mate_ref"), _field(t, 7, "int").alias("mate_pos"), _field(t, 8, "int").alias("tlen"), _field(t, 9).alias("seq"), _field(t, 10).alias("qual"),
        m.alias("tags"), F.try_element_at(m, F.lit("SA")).alias("sa"), F.try_element_at(m, F.lit("NM")).cast("int").alias("nm"), F.lit(category).alias("category"))


def read_sam_contigs(spark: SparkSession, path) -> DataFrame:
    """Contigs (ref, name, length) of a SAM header, in the order of the file's @SQ lines by name of file and place in it."""
    rows = spark.read.text(path).where(F.startswith("value", F.lit("@SQ"))).withColumn("_i", F.monotonically_increasing_id())
    got = rows.select("_i", F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))
    listed = got.agg(F.array_sort(F.collect_list(F.struct("_i", "name", "length"))).alias("a"))
    return listed.select(F.posexplode("a").alias("ref", "x")).select("ref", "x.name", "x.length")


def read_vcf(spark: SparkSession, path) -> DataFrame:
    """Records of a VCF: fixed columns, INFO as a map (flags true), genotypes as an array of maps, and the parsed breakend."""
    t = F.split("value", "\t")
    info = F.transform(F.split(_field(t, 7), ";"), lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.coalesce(F.get(F.split(x, "=", 2), 1), F.lit("true")).alias("v")))
    keys = F.split(F.coalesce(_field(t, 8), F.lit("")), ":")
    genotypes = F.transform(F.slice(t, F.lit(10), F.greatest(F.size(t) - 9, F.lit(0))), lambda g: F.map_from_entries(F.filter(F.arrays_zip(keys.alias("k"), F.split(g, ":").alias("v")), lambda x: x["k"].isNotNull())))
    alt = _field(t, 4)
    return _lines(spark, path, "#").select(
        _field(t, 0).alias("chrom"), _field(t, 1, "int").alias("pos"), _field(t, 2).alias("id"), _field(t, 3).alias("ref"), alt.alias("alt"), _field(t, 5, "double").alias("qual"),
        F.when(_field(t, 6).isin("PASS", "."), F.array().cast("array<string>")).otherwise(F.split(_field(t, 6), ";")).alias("filters"),
        F.map_from_entries(F.filter(info, lambda x: x["k"] != ".")).alias("info"), genotypes.alias("genotypes"),
        F.when(alt.rlike(r"[\[\].]"), parse_breakend_allele(alt)).alias("breakend"))


def read_bed(spark: SparkSession, path) -> DataFrame:
    """BED (0-based, half open) to closed 1-based intervals."""
    t = F.split("value", "\t")
    rows = _lines(spark, path, "#").where(~F.startswith("value", F.lit("track")) & ~F.startswith("value", F.lit("browser")))
    return rows.select(_field(t, 0).alias("chrom"), (_field(t, 1, "long") + 1).alias("start"), _field(t, 2, "long").alias("end"), _field(t, 3).alias("name"), _field(t, 4, "double").alias("score"), _field(t, 5).alias("strand"))


def read_bedpe(spark: SparkSession, path) -> DataFrame:
    t = F.split("value", "\t")
    return _lines(spark, path, "#").select(
        _field(t, 0).alias("chrom1"), (_field(t, 1, "long") + 1).alias("start1"), _field(t, 2, "long").alias("end1"), _field(t, 3).alias("chrom2"), (_field(t, 4, "long") + 1).alias("start2"), _field(t, 5, "long").alias("end2"),
        _field(t, 6).alias("name"), _field(t, 7, "double").alias("score"), _field(t, 8).alias("dir1"), _field(t, 9).alias("dir2"))


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """Contigs (name, seq). Files are split at '>', so a contig is one record whatever its lines."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    cut = F.split(body, "\n", 2)
    return rows.where(F.trim("value") != "").select(F.split(cut[0], r"\s")[0].alias("name"), F.regexp_replace(F.coalesce(F.get(cut, 1), F.lit("")), r"\s", "").alias("seq"))


def reference_chunks(contigs: DataFrame, size: int = 100_000) -> DataFrame:
    """Contigs as chunks (name, chunk, start, bases), to be joined by position instead of held whole."""
    n = F.greatest(F.ceil(F.length("seq") / size).cast("int"), F.lit(1))
    each = contigs.select("name", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return each.select("name", "chunk", (F.col("chunk") * size + 1).alias("start"), F.substring(F.col("seq"), F.col("chunk") * size + 1, F.lit(size)).alias("bases"))


def subsequence(spans: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """``spans`` (chrom, start, end) with the reference ``bases`` between, N outside of the contig."""
    own = spans.withColumn("_id", F.xxhash64(*[F.col(c).cast("string") for c in spans.columns])).withColumn("_c", F.explode(F.sequence(F.floor((F.greatest(F.col("start"), F.lit(1)) - 1) / size).cast("int"), F.floor((F.greatest(F.col("end"), F.lit(1)) - 1) / size).cast("int"))))
    c = chunks.select(F.col("name").alias("_n"), F.col("chunk").alias("_k"), F.col("start").alias("_s"), F.col("bases").alias("_b"))
    j = own.join(c, (F.col("chrom") == F.col("_n")) & (F.col("_c") == F.col("_k")), "left")
    lo = F.greatest(F.col("start"), F.col("_s"))
    part = F.substring(F.col("_b"), (lo - F.col("_s") + 1).cast("int"), (F.least(F.col("end"), F.col("_s") + size - 1) - lo + 1).cast("int"))
    got = j.groupBy(*spans.columns, "_id").agg(F.array_sort(F.collect_list(F.struct("_c", part.alias("p")))).alias("x"))
    text = F.array_join(F.transform("x", lambda p: F.coalesce(p["p"], F.lit(""))), "")
    left = F.greatest(F.lit(0), 1 - F.col("start")).cast("int")
    want = (F.col("end") - F.col("start") + 1).cast("int")
    return got.select(*spans.columns, F.rpad(F.concat(F.repeat(F.lit("N"), left), text), want, F.lit("N")).alias("bases"))


def read_fastq(spark: SparkSession, path) -> DataFrame:
    """Reads (name, seq, qual). No line tells by itself where a record begins, so a file is read whole: give many files, of far less than 2 GB each."""
    rows = spark.read.text(path, wholetext=True)
    blocks = F.regexp_extract_all("value", F.lit(r"(?m)^@([^\n]+\n[^\n]*\n\+[^\n]*\n[^\n]*)"), F.lit(1))
    t = F.split("r", "\n")
    return rows.select(F.explode(blocks).alias("r")).select(F.split(t[0], r"\s")[0].alias("name"), t[1].alias("seq"), t[3].alias("qual"))


def read_kraken(spark: SparkSession, path) -> DataFrame:
    """Per-read classifications; a pair's two k-mer lists are one, parted by |:| (dropped)."""
    t = F.split("value", "\t")
    kmers = F.transform(F.filter(F.split(F.trim(_field(t, 4)), " +"), lambda x: x.rlike(r"^[0-9A]+:\d+$")), lambda x: F.struct(F.split(x, ":")[0].alias("taxid"), F.split(x, ":")[1].cast("int").alias("count")))
    return _lines(spark, path).select((_field(t, 0) == "C").alias("classified"), _field(t, 1).alias("read"), F.regexp_extract(_field(t, 2), r"(\d+)\)?$", 1).cast("int").alias("taxid"), _field(t, 3).alias("length"), kmers.alias("kmers"))


def read_kraken_report(spark: SparkSession, path) -> DataFrame:
    t = F.split("value", "\t")
    return _lines(spark, path).select(F.trim(_field(t, 0)).cast("double").alias("pct"), F.trim(_field(t, 1)).cast("long").alias("tree_reads"), F.trim(_field(t, 2)).cast("long").alias("direct_reads"), _field(t, 3).alias("rank"), F.trim(_field(t, 4)).cast("int").alias("taxid"), F.trim(_field(t, 5)).alias("name"), F.floor((F.length(_field(t, 5)) - F.length(F.ltrim(_field(t, 5)))) / 2).cast("int").alias("depth"))


def read_taxonomy(spark: SparkSession, path) -> DataFrame:
    t = F.split("value", r"\t\|\t?")
    return _lines(spark, path).select(F.trim(F.get(t, 0)).cast("int").alias("taxid"), F.trim(F.get(t, 1)).cast("int").alias("parent"), F.trim(F.get(t, 2)).alias("rank"))


def read_seqid_map(spark: SparkSession, path) -> DataFrame:
    t = F.split("value", "\t")
    return _lines(spark, path).select(_field(t, 0).alias("seq_id"), _field(t, 1, "int").alias("taxid"))


def read_repeatmasker(spark: SparkSession, path) -> DataFrame:
    """RepeatMasker .out: white-space columns under three header lines."""
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^\d"))
    return rows.select(F.get(t, 0).cast("double").alias("score"), F.get(t, 4).alias("chrom"), F.get(t, 5).cast("long").alias("start"), F.get(t, 6).cast("long").alias("end"), F.when(F.get(t, 8) == "C", "-").otherwise("+").alias("strand"), F.get(t, 9).alias("repeat"), F.get(t, 10).alias("class"))


def read_repeatmasker_bed(spark: SparkSession, path) -> DataFrame:
    """The 15-column BED made from it."""
    t = F.split("value", "\t")
    return _lines(spark, path, "#").select(_field(t, 0).alias("chrom"), (_field(t, 1, "long") + 1).alias("start"), _field(t, 2, "long").alias("end"), _field(t, 3).alias("repeat"), _field(t, 4, "double").alias("score"), _field(t, 5).alias("strand"), _field(t, 10).alias("class"))


def read_repeatmasker_align(spark: SparkSession, path) -> DataFrame:
    """Headers of RepeatMasker .align blocks: score, divergence, query place, repeat, class. The drawn alignments are skipped."""
    line = F.trim("value")
    t = F.split(line, r"\s+")
    rows = spark.read.text(path).where(line.rlike(r"^\d+ +[\d.]+ +[\d.]+ +[\d.]+ "))
    k = F.when(F.get(t, 8) == "C", 9).otherwise(8)
    named = F.split(F.get(t, k), "#")
    return rows.select(F.get(t, 0).cast("double").alias("score"), F.get(t, 1).cast("double").alias("divergence"), F.get(t, 4).alias("chrom"), F.get(t, 5).cast("long").alias("start"), F.get(t, 6).cast("long").alias("end"), F.when(F.get(t, 8) == "C", "-").otherwise("+").alias("strand"), named[0].alias("repeat"), F.get(named, 1).alias("class"))


def read_metrics(spark: SparkSession, path, columns: list[str]) -> DataFrame:
    """Rows of a metrics file that have as many tab-separated fields as ``columns``; headers and comments are left out."""
    t = F.split("value", "\t", -1)
    rows = _lines(spark, path, "#").where((F.size(t) == len(columns)) & (F.get(t, 0) != columns[0]))
    return rows.select(*[F.get(t, k).alias(c) for k, c in enumerate(columns)])
