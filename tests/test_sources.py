"""Readers, writers, configuration, programs and streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from breakline.functions import cigar as C
from breakline.operators import reads
from breakline.plans import programs
from breakline.sources import sinks
from breakline.sources import text_formats as R
from breakline.sources.config import Config
from breakline.streaming import events as E

SAM = """@HD\tVN:1.6
@SQ\tSN:chr1\tLN:1000
@SQ\tSN:chr2\tLN:500
r1\t99\tchr1\t100\t60\t50M50S\t=\t300\t300\tACGT\tIIII\tSA:Z:chr2,50,+,50S50M,60,0;\tNM:i:3
r1\t147\tchr1\t300\t60\t100M\t=\t100\t-300\tGGGG\tJJJJ\tNM:i:0
r2\t4\t*\t0\t0\t*\t*\t0\t0\tAAAACCCC\tIIIIJJJJ
"""


@pytest.fixture()
def sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    return R.read_sam(spark, str(tmp_path / "a.sam"))


def test_sam(spark, sam, tmp_path):
    got = {(r.read_name, r.flag): r for r in sam.collect()}
    a = got["r1", 99]
    assert (a.ref, a.pos, a.mate_ref, a.mate_pos, a.nm, a.sa) == ("chr1", 100, "chr1", 300, 3, "chr2,50,+,50S50M,60,0;") and [tuple(x) for x in a.cigar] == [(50, "M"), (50, "S")]
    assert got["r2", 4].cigar == [] and got["r2", 4].sa is None
    assert [tuple(r) for r in R.read_sam_contigs(spark, str(tmp_path / "a.sam")).orderBy("ref").collect()] == [(0, "chr1", 1000), (1, "chr2", 500)]


def test_vcf_round_trip(spark, tmp_path):
    calls = spark.createDataFrame(
        [("chr1", 100, "eo", "A", "+", "CC", "chr2", 55, "-", 70.5, ["LOW"], "e", "eh", 100, 105), ("chr1", 40, "sb", "N", "-", "GT", None, None, None, 9.0, [], "s", None, 40, 40)],
        "chrom string, pos int, id string, ref_base string, dir string, inserted string, mate_chrom string, mate_pos int, mate_dir string, qual double, filters array<string>, event string, mate_id string, ci_start int, ci_end int",
    )
    sinks.write_vcf(calls, str(tmp_path / "v"), [("chr1", 1000)])
    lines = [r.value for r in spark.read.text(str(tmp_path / "v")).collect()]
    assert "##fileformat=VCFv4.2" in lines and sum(not x.startswith("#") for x in lines) == 2
    got = {r.id: r for r in R.read_vcf(spark, [str(tmp_path / "v" / "part=1"), str(tmp_path / "v" / "part=0")]).collect()}
    assert got["eo"].alt == "ACC[chr2:55[" and got["eo"].breakend.dir1 == "+" and got["eo"].breakend.inserted == "CC" and got["eo"].breakend.pos2 == 55 and got["eo"].breakend.dir2 == "-"
    assert got["eo"].filters == ["LOW"] and got["eo"].info["CIPOS"] == "0,5" and got["eo"].info["IMPRECISE"] == "true"
    assert got["sb"].alt == ".GTN" and got["sb"].filters == [] and "MATEID" not in got["sb"].info


def test_bed_and_bedpe(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\nchr1\t9\t20\tn\t5\t+\n")
    assert [tuple(r) for r in R.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 10, 20, "n", 5.0, "+")]
    (tmp_path / "a.bedpe").write_text("#c\nchr1\t9\t10\tchr2\t19\t21\te\t3\t+\t-\n")
    assert [tuple(r) for r in R.read_bedpe(spark, str(tmp_path / "a.bedpe")).collect()] == [("chr1", 10, 10, "chr2", 20, 21, "e", 3.0, "+", "-")]
    df = spark.createDataFrame([("chr1", 10, 20)], "chrom string, start int, end int")
    assert sinks.bed_lines(df).first().value == "chr1\t9\t20\t.\t0"


def test_sequences(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one desc\nACGT\nAC\n>two\nGG\n")
    fa = R.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {(r.name, r.seq) for r in fa.collect()} == {("one", "ACGTAC"), ("two", "GG")}
    spans = spark.createDataFrame([("one", 2, 5), ("one", -1, 2), ("one", 5, 9), ("two", 1, 2)], "chrom string, start int, end int")
    got = {(r.chrom, r.start): r.bases for r in R.subsequence(spans, R.reference_chunks(fa, 3), 3).collect()}
    assert got == {("one", 2): "CGTA", ("one", -1): "NNAC", ("one", 5): "ACNNN", ("two", 1): "GG"}
    (tmp_path / "a.fq").write_text("@r1 x\nAC@T\n+\nII@I\n@r2\nGG\n+r2\nJJ\n")
    assert {tuple(r) for r in R.read_fastq(spark, str(tmp_path / "a.fq")).collect()} == {("r1", "AC@T", "II@I"), ("r2", "GG", "JJ")}


def test_reports(spark, tmp_path):
    (tmp_path / "k").write_text("C\tr1\thuman (taxid 9606)\t151\t0:30 9606:10\nU\tr2\t0\t10|10\t0:5 |:| A:3\n")
    got = {r.read: r for r in R.read_kraken(spark, str(tmp_path / "k")).collect()}
    assert got["r1"].taxid == 9606 and [tuple(x) for x in got["r1"].kmers] == [("0", 30), ("9606", 10)] and [tuple(x) for x in got["r2"].kmers] == [("0", 5), ("A", 3)]
    (tmp_path / "r").write_text(" 50.00\t10\t2\tG\t11\t    Virus\n")
    assert tuple(R.read_kraken_report(spark, str(tmp_path / "r")).first()) == (50.0, 10, 2, "G", 11, "Virus", 2)
    (tmp_path / "n").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tgenus\t|\n")
    assert {tuple(r) for r in R.read_taxonomy(spark, str(tmp_path / "n")).collect()} == {(1, 1, "no rank"), (2, 1, "genus")}
    (tmp_path / "m").write_text("## x\nLENGTH\tCOUNT\n1\t5\n2\t\n")
    assert {tuple(r) for r in R.read_metrics(spark, str(tmp_path / "m"), ["LENGTH", "COUNT"]).collect()} == {("1", "5"), ("2", "")}
    (tmp_path / "o").write_text("   SW  perc\nscore  div.\n\n  463   1.3  0.6  1.7  chr1  10001 10468 (24) +  (CCC)n  Simple_repeat 1 463 (0) 1\n  12 1 1 1 chr1 20 30 (4) C L1 LINE/L1 (1) 5 2 2\n")
    assert [tuple(r) for r in R.read_repeatmasker(spark, str(tmp_path / "o")).orderBy("start").collect()] == [(12.0, "chr1", 20, 30, "-", "L1", "LINE/L1"), (463.0, "chr1", 10001, 10468, "+", "(CCC)n", "Simple_repeat")]


def test_fastq_extraction(spark, sam):
    names = spark.createDataFrame([("r1",), ("r2",)], "read_name string")
    got = sorted((r.file, r.value) for r in sinks.fragments_to_fastq(sam, names).collect())
    assert got == [(0, "@r2\nAAAACCCC\n+\nIIIIJJJJ"), (1, "@r1\nACGT\n+\nIIII"), (2, "@r1\nCCCC\n+\nJJJJ")]
    un = sorted(r.value for r in sinks.unmapped_sequences(sam, 5).collect())
    assert un == ["@r1_end\n\n+\n", "@r2\nAAAACCCC\n+\nIIIIJJJJ"] or un[-1] == "@r2\nAAAACCCC\n+\nIIIIJJJJ"
    assert sinks.read_pair_rows(spark.createDataFrame([("e", "eo", "eh", "chr1", 5, 9, "+", "chr2", 7, "-")], "event string, id string, mate_id string, chrom string, start int, end int, dir string, mate_chrom string, mate_start int, mate_dir string")).first().flag == 1 + 64 + 32


def test_sorted_output(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    sinks.write_sorted(df, str(tmp_path / "s"), ["k"], 4)
    parts = [[r.k for r in spark.read.parquet(str(p)).collect()] for p in sorted((tmp_path / "s").glob("part*"))]
    assert all(p == sorted(p) for p in parts) and sorted(x for p in parts for x in p) == list(range(1000))


def test_config():
    c = Config.from_properties("min_mapq = 10 # low\ncalling.min_score=75.5\nadapters = AC, GT\nassembly.k=31")
    assert c.min_mapq == 10 and c.calling.min_score == 75.5 and c.adapters == ("AC", "GT") and c.assembly.k == 31 and c.calling.min_size == 10
    with pytest.raises(KeyError):
        Config.from_properties("nonsense = 1")


def test_reads_to_calls(spark):
    """From aligned reads with one planted deletion to its call, all programs in between."""
    rows = [(f"r{i}", 1 + 2 + 32 + 64, "chr1", 100 + i, 60, f"{40 - i}M50D{20 + i}M", None, None, 0, "chr1", 400, "60M", 60, 0, 400) for i in range(12)]
    rows += [(f"n{i}", 1 + 2 + 32 + 64, "chr1", 500 + i, 60, "60M", None, None, 0, "chr1", 800, "60M", 60, 0, 300) for i in range(300)]
    df = spark.createDataFrame(rows, "read_name string, flag int, ref string, pos int, mapq int, cigar_text string, seq string, sa string, nm int, mate_ref string, mate_pos int, mate_cigar_text string, mate_mapq int, category int, fragment int")
    df = df.withColumns({"cigar": C.parse(F.col("cigar_text")), "mate_cigar": C.parse(F.col("mate_cigar_text")), "has_sa": F.lit(False), "tags": F.create_map(F.lit("NM"), F.lit("0"))})
    tables = programs.collect_metrics(df)
    assert tables["library"].first().reads == 312
    assert programs.extract_sv_reads(df).count() == 12
    ev = programs.extract_evidence(df, 600, tables, 0.001).cache()
    assert ev.count() == 24 and ev.where("dir1 = '+' and start1 = 139 and start2 = 190").count() == 12
    calls = programs.identify_variants(ev, 64)
    assert [(r.start1, r.start2) for r in calls.collect()] == [(139, 190)]
    named = calls.withColumn("call_id", F.lit(1)).withColumn("score", F.col("weight"))
    got = programs.allocate_evidence(ev, named, 64).first()
    assert (got.ic, got.vf, got.filters) == (12, 12, [])
    with_cov = named.withColumn("ref", F.col("ref1")).select("call_id", "ref", F.col("start1").alias("start"), F.col("end1").alias("end"))
    spans = spark.createDataFrame([("chr1", 130, 145, 0)] * 3, "ref string, start int, end int, category int")
    pairs = spark.createDataFrame([("chr1", 0, 130, 150)], "ref string, category int, end1 int, start2 int")
    assert tuple(programs.annotate_reference_coverage(with_cov, spans, pairs).first()) == (1, 0, 3, 1)
    assert programs.sanity_check(ev.withColumn("pair_id", F.regexp_replace("evidence_id", "[fb]$", ""))).count() == 0


def test_blacklist_takes_sa_apart(spark):
    df = spark.createDataFrame([("a", 0, "chr1", 10, 60, "chr9", 5, 6, "chr2,50,+,50M,60,0;chr3,5,+,50M,60,0;"), ("b", 0, "chr2", 60, 70, None, None, None, None)], "read_id string, flag int, ref string, start int, end int, mate_ref string, mate_start int, mate_end int, sa string")
    cut = spark.createDataFrame([("chr2", 55, 65)], "ref string, start int, end int")
    got = {r.read_id: (r.flag, r.sa) for r in reads.apply_blacklist(df, cut).collect()}
    assert got == {"a": (0, "chr3,5,+,50M,60,0;"), "b": (4, None)}


def stream_of(spark, tmp_path, batches):
    folder = tmp_path / "in"
    folder.mkdir()
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(i, u, t0 + dt.timedelta(seconds=s), 1.0) for i, u, s in rows], "event_id long, user_id long, ts timestamp, value double")
        df.coalesce(1).write.parquet(str(folder / f"b{k}"))
    schema = "event_id long, user_id long, ts timestamp, value double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_throttle_holds_state_across_batches(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[(1, 7, 0), (2, 7, 1), (3, 8, 2)], [(4, 7, 3), (5, 7, 20), (6, 8, 21)]])
    got = E.run_to_memory(E.throttled(s, "user_id", "ts", 10, 2, "1 minute"), "throttled", str(tmp_path / "c")).collect()
    ids = {r.event_id for r in got}
    assert {3, 5, 6} <= ids and len(ids & {1, 2, 4}) == 2


def test_stream_stream_join(spark, tmp_path):
    s = stream_of(spark, tmp_path, [[(1, 7, 0), (2, 7, 5), (3, 7, 100)]])
    a = s.select(F.col("event_id").alias("a"), F.col("user_id").alias("ua"), F.col("ts").alias("ta"))
    b = s.select(F.col("event_id").alias("b"), F.col("user_id").alias("ub"), F.col("ts").alias("tb"))
    got = E.run_to_memory(E.nearby(a, b, F.col("ua") == F.col("ub"), "ta", "tb", "10 seconds", "10 seconds", "1 minute").select("a", "b"), "joined", str(tmp_path / "c")).collect()
    assert {(r.a, r.b) for r in got} == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)}


def test_late_rows(spark):
    rows = [("k", 1, 100), ("k", 2, 50), ("k", 3, 95), ("j", 1, 5)]
    df = spark.createDataFrame(rows, "key string, seq int, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.seq for r in E.late_rows(df, "ts", 10).collect()] == [2]
