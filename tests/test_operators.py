"""Operators against brute force on small random inputs, and hand-made cases of the rules."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from breakline.functions import cigar as C
from breakline.functions import coords, seq
from breakline.operators import align, annotate, assembly, calling, evidence, intervals, kmers, links, metrics, pon, taxonomy


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


# --- cliques


def brute_boxes(boxes):
    """Maximal cliques by subsets of what holds each corner."""
    out = set()
    for a, b in itertools.product({x[0] for x in boxes}, {x[2] for x in boxes}):
        held = frozenset(i for i, x in enumerate(boxes) if x[0] <= a <= x[1] and x[2] <= b <= x[3])
        if held:
            out.add(held)
    return {s for s in out if not any(s < t for t in out)}


@pytest.mark.parametrize("seed", range(6))
def test_maximal_cliques(spark, seed):
    rng = random.Random(seed)
    boxes = set()
    while len(boxes) < 14:
        x, y = rng.randint(1, 40), rng.randint(1, 40)
        boxes.add((x, x + rng.randint(0, 15), y, y + rng.randint(0, 15)))
    boxes = sorted(boxes)
    want = sorted((max(boxes[i][0] for i in s), min(boxes[i][1] for i in s), max(boxes[i][2] for i in s), min(boxes[i][3] for i in s), sum(1 << i for i in s)) for s in brute_boxes(boxes))
    df = spark.createDataFrame([(0, "+", 1, "-", *b, 1 << i, 0) for i, b in enumerate(boxes)], "ref1 int, dir1 string, ref2 int, dir2 string, start1 int, end1 int, start2 int, end2 int, w long, exact_w long")
    got = calling.maximal_cliques(df, 7)
    assert rows(got, "start1", "end1", "start2", "end2", "weight") == sorted(want, key=repr)


def test_cliques_hand_made(spark):
    df = spark.createDataFrame([(0, "+", 1, 5, 1), (0, "+", 3, 8, 2), (0, "+", 6, 9, 4)], "ref int, dir string, start int, end int, qs long")
    assert rows(calling.interval_cliques(df, ["ref", "dir"]), "start", "end", "weight") == [(3, 5, 3), (6, 8, 6)]
    two = spark.createDataFrame([(0, "+", 1, "-", 1, 3, 7, 9, 5, True)] * 2, "ref1 int, dir1 string, ref2 int, dir2 string, start1 int, end1 int, start2 int, end2 int, qs long, exact boolean")
    assert rows(calling.maximal_cliques(calling.merge_boxes(two, F.col("exact")), 4), "weight", "exact_weight") == [(10, 10)]


@pytest.mark.parametrize("chunk", [3, 10, 1000])
def test_interval_cliques(spark, chunk):
    rng = random.Random(chunk)
    spans = [(s, s + rng.randint(0, 12)) for s in (rng.randint(1, 90) for _ in range(60))]
    df = spark.createDataFrame([(0, "+", s, e, 1 << (i % 20)) for i, (s, e) in enumerate(spans)], "ref int, dir string, start int, end int, qs long")
    held = {p: frozenset(i for i, (s, e) in enumerate(spans) if s <= p <= e) for p in range(1, 110)}
    tops = {s for s in held.values() if s and not any(s < t for t in held.values())}
    want = sorted((max(spans[i][0] for i in s), min(spans[i][1] for i in s), sum(1 << (i % 20) for i in s)) for s in tops)
    assert rows(calling.interval_cliques(df, ["ref", "dir"], chunk=chunk), "start", "end", "weight") == sorted(want, key=repr)


def test_call_records(spark):
    df = spark.createDataFrame([(0, "+", 1, "-", 5, 6, 9, 10, 7)], "ref1 int, dir1 string, ref2 int, dir2 string, start1 int, end1 int, start2 int, end2 int, weight long")
    got = {r["id"]: r for r in calling.call_records(df).collect()}
    assert len(got) == 2 and all(got[r["mate_id"]]["mate_start"] == r["start"] for r in got.values())


# --- intervals


@pytest.mark.parametrize("chunk", [7, 50, 10_000])
def test_sweeps(spark, chunk):
    rng = random.Random(chunk)
    spans = [(rng.randint(0, 1), s, s + rng.randint(0, 20)) for s in (rng.randint(1, 200) for _ in range(80))]
    df = spark.createDataFrame(spans, "ref int, start int, end int")
    depth = {(r, p): sum(r == a and s <= p <= e for a, s, e in spans) for r in (0, 1) for p in range(1, 230)}

    def runs(ok):
        out = []
        for r in (0, 1):
            for _, g in itertools.groupby(((p, ok(depth[r, p])) for p in range(1, 230)), key=lambda x: x[1]):
                g = list(g)
                if g[0][1]:
                    out.append((r, g[0][0], g[-1][0]))
        return sorted(out, key=repr)

    assert rows(intervals.merge_intervals(df, ["ref"], 1, chunk)) == runs(lambda n: n > 0)
    assert rows(intervals.threshold_regions(df, ["ref"], 5, chunk)) == runs(lambda n: n >= 5)
    pts = spark.createDataFrame([(r, p) for r in (0, 1) for p in range(1, 230)], "ref int, pos int")
    assert {(r["ref"], r["pos"]): r["depth"] or 0 for r in intervals.depth_at(pts, df, ["ref"], chunk=chunk).collect()} == depth
    cut = spark.createDataFrame([(0, 50, 90), (1, 10, 12)], "ref int, start int, end int")
    left = {(r, p) for r, s, e in rows(intervals.subtract(df, cut, ["ref"], chunk)) for p in range(s, e + 1)}
    assert left == {(r, p) for (r, p), n in depth.items() if n and not any(r == a and s <= p <= e for a, s, e in [(0, 50, 90), (1, 10, 12)])}


@pytest.mark.parametrize("width", [3, 17, 1000])
def test_interval_join(spark, width):
    rng = random.Random(width)
    a = [(i, rng.randint(0, 1), s, s + rng.randint(0, 30)) for i, s in enumerate(rng.randint(1, 150) for _ in range(40))]
    b = [(i, rng.randint(0, 1), s, s + rng.randint(0, 30)) for i, s in enumerate(rng.randint(1, 150) for _ in range(40))]
    x, y = spark.createDataFrame(a, "a int, ra int, sa int, ea int"), spark.createDataFrame(b, "b int, rb int, sb int, eb int")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3])
    assert rows(intervals.interval_join(x, y, [("ra", "rb")], ("sa", "ea"), ("sb", "eb"), width), "a", "b") == sorted(want, key=repr)
    hit = {p for p, _ in want}
    assert {r["a"] for r in intervals.interval_join(x, y, [("ra", "rb")], ("sa", "ea"), ("sb", "eb"), width, "left_semi").collect()} == hit
    assert {r["a"] for r in intervals.interval_join(x, y, [("ra", "rb")], ("sa", "ea"), ("sb", "eb"), width, "left_anti").collect()} == {p[0] for p in a} - hit


def test_reference_support(spark):
    calls = spark.createDataFrame([(1, 0, 15, 15), (2, 0, 20, 20), (3, 0, 25, 25), (4, 0, 18, 21)], "call_id long, ref int, start int, end int")
    reads = spark.createDataFrame([(0, 10, 20, 0)], "ref int, start int, end int, category int")
    pairs = spark.createDataFrame([(0, 0, 20, 30)], "ref int, category int, end1 int, start2 int")
    got = {r["call_id"]: (r["ref_reads"], r["ref_pairs"]) for r in annotate.reference_support(calls, reads, pairs).collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (0, 1), 4: (0, 0)}


# --- panel of normals


@pytest.mark.parametrize("seed", range(3))
def test_merge_breakpoints(spark, seed):
    rng = random.Random(seed)
    boxes = [(x, x + rng.randint(0, 3), y, y + rng.randint(0, 3)) for x, y in ((rng.randint(1, 40), rng.randint(100, 140)) for _ in range(50))]
    cur = [(b, 1) for b in boxes]
    while True:  # merge any two that meet, until none do
        for (i, (p, n)), (j, (q, m)) in itertools.combinations(enumerate(cur), 2):
            if p[0] - 1 <= q[1] and q[0] <= p[1] + 1 and p[2] - 1 <= q[3] and q[2] <= p[3] + 1:
                new = (min(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), max(p[3], q[3])), n + m
                cur = [c for k, c in enumerate(cur) if k not in (i, j)] + [new]
                break
        else:
            break
    df = spark.createDataFrame([(0, "+", 0, "-", *b, 1) for b in boxes], "ref1 int, dir1 string, ref2 int, dir2 string, start1 int, end1 int, start2 int, end2 int, n long")
    assert rows(pon.merge_breakpoints(df, 8), "start1", "end1", "start2", "end2", "n") == sorted(((*b, n) for b, n in cur), key=repr)


def test_merge_breakends(spark):
    df = spark.createDataFrame([(0, "+", 1, 5, 1), (0, "+", 6, 9, 1), (0, "-", 6, 9, 1), (0, "+", 11, 12, 3)], "ref int, dir string, start int, end int, n long")
    assert rows(pon.merge_breakends(df), "dir", "start", "end", "n") == [("+", 1, 9, 2), ("+", 11, 12, 3), ("-", 6, 9, 1)]


# --- functions


def value(spark, col, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(col.alias("v")).first()["v"]


def test_small_functions(spark):
    assert value(spark, seq.entropy(F.lit("ACGT"))) == pytest.approx(2) and value(spark, seq.entropy(F.lit("AAAA"))) == 0
    assert value(spark, coords.pr_to_phred(F.lit(0.0))) == 0
    assert value(spark, coords.event_size(F.lit(1), F.lit("+"), F.lit(10), F.lit(1), F.lit("-"), F.lit(21))) == 10
    assert value(spark, coords.event_size(F.lit(1), F.lit("+"), F.lit(10), F.lit(2), F.lit("-"), F.lit(21))) is None
    assert value(spark, coords.call_margin(F.lit(True), F.lit(12))) == 6 and value(spark, coords.call_margin(F.lit(False), F.lit(12))) == 10
    assert value(spark, seq.common_prefix(F.lit("ACGTT"), F.lit("ACGAA"))) == 3
    assert value(spark, seq.matching_bases(F.lit("AACGT"), F.lit("ACGA"), F.lit(1))) == 3
    assert value(spark, seq.adapter_clip(F.lit("ATCGGAAGAGCC"), F.lit("TTTAG"))) is True
    for alt in ("ACC]chr2:5]", "A[chr2:5[", "[chr2:5[CCA", "]chr2:5]A", "ACGT.", ".ACGT"):
        p = value(spark, seq.parse_breakend_allele(F.lit(alt)))
        base = F.lit("T" if alt == ".ACGT" else "A")
        back = seq.breakend_allele(base, F.lit(p["dir1"]), F.lit(p["inserted"]), F.lit(p["chrom2"]), F.lit(p["pos2"]), F.lit(p["dir2"])) if p["chrom2"] else seq.breakend_allele(base, F.lit(p["dir1"]), F.lit(p["inserted"]))
        assert value(spark, back) == alt


def test_cigar(spark):
    c = C.parse(F.lit("5H10S20M3I4D20M7S"))
    assert [value(spark, f) for f in (C.read_length(c), C.read_length(c, True), C.reference_length(c), C.start_clip(c), C.end_clip(c), C.start_clip(c, False))] == [60, 65, 44, 15, 7, 10]
    assert value(spark, C.render(C.clean(C.parse(F.lit("3M0I4M2D"))))) == "7M2D"
    runs = value(spark, C.indel_runs(C.parse(F.lit("10M2I3D5M4I"))))
    assert [(r["read_off"], r["ref_off"], r["size"], r["longest_op"]) for r in runs] == [(10, 10, 5, "D")]
    a, b = C.split_after(C.parse(F.lit("10M2I10M")), F.lit(11))
    assert value(spark, C.render(a)) == "10M1I11S" and value(spark, C.render(b)) == "11S1I10M"
    assert [value(spark, C.imprecision_width(C.parse(F.lit(t)))) for t in ("1X5S", "1X8N1X20S", "30M")] == [0, 9, 0]


def test_more_cigar(spark):
    def show(col):
        return value(spark, C.render(col))

    c = C.parse(F.lit("3S10M2D5M2I4M"))
    assert show(C.trim(c, F.lit(5), F.lit(5))) == "8M2D5M1I" and show(C.trim(c, F.lit(13), F.lit(0))) == "5M2I4M"
    assert show(C.trim_clips(C.parse(F.lit("2H3S4M5S")))) == "4M" and show(C.with_soft_clips(C.parse(F.lit("2H3S4M")), F.lit(1), F.lit(2))) == "2H4S4M2S"
    assert [value(spark, C.offset_of(c, F.lit(k))) for k in (0, 3, 12, 13, 18, 23)] == [0, 0, 9, 12, 17, 20]
    assert show(C.ungapped(c, True)) == "3S10M11S" and show(C.ungapped(c, False)) == "20S4M"
    assert value(spark, C.common_bases(C.parse(F.lit("5M5S")), C.parse(F.lit("3S7M")))) == 2
    assert value(spark, C.recomputed_nm(C.parse(F.lit("2S3M1D2M")), F.lit("NNACGTT"), F.lit("ACAGTA"))) == 3
    assert show(C.unclip_matches(C.parse(F.lit("3S4M3S")), F.lit("ACGTTTTGAC"), F.lit("TTCG"), F.lit("GATT"))) == "1S8M1S"
    a, b = C.hard_clips_to_n(C.parse(F.lit("2H3M1S4H")), F.lit("ACGT"))
    assert show(a) == "2S3M5S" and value(spark, b) == "NNACGTNNNN"


def test_tail_phred(spark):
    df = spark.createDataFrame([("S", 0, 4), ("S", 1, 0), ("S", 2, 1)], "op string, length int, n long")
    assert [round(r["phred"], 2) for r in metrics.tail_phred(df).orderBy("length").collect()] == [0.0, 6.99, 6.99]


# --- evidence


READS = "read_name string, flag int, ref string, pos int, mapq int, cigar_text string, seq string, sa string, nm int, mate_ref string, mate_pos int, mate_cigar_text string, mate_mapq int, category int"


def reads_of(spark, *values):
    df = spark.createDataFrame(list(values), READS)
    return df.withColumn("cigar", C.parse(F.col("cigar_text"))).withColumn("mate_cigar", C.parse(F.col("mate_cigar_text")))


def test_split_read(spark):
    df = reads_of(spark, ("r", 0, "chr1", 100, 60, "50M50S", "A" * 100, "chr2,500,+,50S50M,40,0;", 0, None, None, None, None, 0))
    got = evidence.split_reads(df).collect()
    assert [(r["ref1"], r["dir1"], r["start1"], r["ref2"], r["dir2"], r["start2"], r["mapq2"]) for r in got] == [("chr1", "+", 149, "chr2", "-", 500, 40)]
    assert evidence.soft_clips(df, 5).count() == 0
    wide = reads_of(spark, ("r", 0, "chr1", 100, 60, "55M45S", "A" * 100, "chr2,500,+,50S50M,40,0;", 0, None, None, None, None, 0))
    r = evidence.split_reads(wide).first()
    assert (r["start1"], r["end1"], r["start2"], r["end2"]) == (149, 154, 500, 505)


def test_indel_and_clip(spark):
    df = reads_of(spark, ("r", 16, "chr1", 100, 60, "5S20M10D20M", "A" * 45, None, 0, None, None, None, None, 0))
    got = sorted((r["dir1"], r["start1"], r["start2"], r["size"]) for r in evidence.indels(df, 5).collect())
    assert got == [("+", 119, 130, 10), ("-", 130, 119, 10)]
    assert [(r["dir1"], r["start1"], r["size"]) for r in evidence.soft_clips(df, 5).collect()] == [("-", 100, 5)]


def test_read_pair(spark):
    df = reads_of(spark, ("r", 1 + 32 + 64, "chr1", 100, 60, "100M", None, None, 0, "chr2", 900, "100M", 50, 0), ("u", 1 + 8 + 64, "chr1", 100, 60, "100M", None, None, 0, None, None, None, None, 0))
    got = {r["kind"]: r for r in evidence.read_pairs(df, 300, F.lit(False)).collect()}
    assert (got["RP"]["dir1"], got["RP"]["start1"], got["RP"]["end1"]) == ("+", 199, 299)
    assert (got["RP"]["dir2"], got["RP"]["start2"], got["RP"]["end2"]) == ("-", 800, 900)
    assert (got["UM"]["start1"], got["UM"]["end1"]) == (199, 398)


def test_scores(spark):
    ev = spark.createDataFrame([("a", "SR", 5, "S", 30, 40, "w_7"), ("b", "UM", None, None, 20, None, "x"), ("c", "RP", 200, None, 60, 60, "x")], "evidence_id string, kind string, size int, op string, mapq1 int, mapq2 int, fragment_id string")
    clip = spark.createDataFrame([("S", 0, 0.0), ("S", 5, 35.0)], "op string, length int, phred double")
    pair = spark.createDataFrame([(200, 12.5), (300, 50.0)], "x int, phred double")
    fast = {r["evidence_id"]: r["score"] for r in evidence.scored(ev, clip, pair, 0.001).collect()}
    assert fast == {"a": 30, "b": pytest.approx(20), "c": 12.5}
    for model in evidence.MODELS:
        assert evidence.scored(ev, clip, pair, 0.001, 0.9, model).where(F.col("score").isNull()).count() == 0
    named = evidence.scored(ev, clip, pair, 0.001, model=evidence.score_by_name(r"w_(\d+)")).collect()
    assert {r["evidence_id"]: r["score"] for r in named} == {"a": 7, "b": 1, "c": 1}


def test_fragment_tags_and_changes(spark):
    df = reads_of(spark, ("r", 1 + 64, "chr1", 100, 60, "50M50S", "AC", None, 0, None, None, None, None, 0), ("r", 1 + 64 + 2048, "chr2", 500, 40, "50S50M", "AC", None, 0, None, None, None, None, 0), ("r", 1 + 128 + 16, "chr1", 300, 30, "100M", "GG", None, 2, None, None, None, None, 0)).withColumn("qual", F.lit("II"))
    got = {(r["flag"]): r for r in evidence.fragment_tags(df).collect()}
    assert got[65]["sa"] == "chr2,500,+,50S50M,40,0;" and got[65]["mq"] == 30 and got[65]["r2"] == "GG" and got[65]["tc"] == 2
    assert got[145]["mc"] == "50M50S" and got[145]["sa"] == ""
    diff = evidence.changes(df, df.withColumn("mapq", F.lit(1)), ["read_name", "flag"], ["mapq", "pos"])
    assert {r["field"]: r["n"] for r in diff.collect()} == {"mapq": 3, "pos": 0}


def test_realignment_round_trip(spark):
    df = reads_of(spark, ("r", 0, "chr1", 100, 60, "50M5S", "A" * 50 + "CCGTT", None, 0, None, None, None, None, 0))
    clips = evidence.clips_to_realign(df, 3).collect()
    assert [c["seq"] for c in clips] == ["CCGTT"]
    aligned = spark.createDataFrame([(clips[0]["name"], "chr9", 7, "+", "50S5M", 33)], "name string, ref string, pos int, strand string, cigar string, mapq int")
    assert evidence.attach_realigned(df, aligned).first()["sa"] == "chr9,7,+,50S5M,33,0;"


# --- alignment and assembly


def plain_score(q, r):
    n, m = len(q), len(r)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    best = 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            x = h[i - 1][j - 1] + (align.MATCH if q[i - 1] == r[j - 1] else align.MISMATCH)
            x = max([0, x] + [h[i - k][j] - align.OPEN - (k - 1) * align.EXTEND for k in range(1, i + 1)] + [h[i][j - k] - align.OPEN - (k - 1) * align.EXTEND for k in range(1, j + 1)])
            h[i][j], best = x, max(best, x)
    return best


@pytest.mark.parametrize("seed", range(20))
def test_smith_waterman(seed):
    rng = random.Random(seed)
    r = "".join(rng.choice("ACGT") for _ in range(40))
    q = r[5:17] + r[19:33] if seed % 2 else "".join(rng.choice("ACGT") for _ in range(25))
    score, at, cig = align.local_alignment(q, r)
    assert score == plain_score(q, r)
    i, j, again, n, last = 0, at, 0, "", ""
    for c in cig:  # the CIGAR is worth the score
        if c.isdigit():
            n += c
            continue
        k, n = int(n), ""
        if c == "M":
            again += sum(align.MATCH if q[i + x] == r[j + x] else align.MISMATCH for x in range(k))
            i, j = i + k, j + k
        elif c == "S":
            i += k
        else:
            again -= align.OPEN + (k - 1) * align.EXTEND
            i, j = (i + k, j) if c == "I" else (i, j + k)
        last = c
    assert again == score and i == len(q) and last


def test_assembly_of_planted_breakend(spark):
    rng = random.Random(3)
    left, right = ("".join(rng.choice("ACGT") for _ in range(120)) for _ in range(2))
    whole = left + right
    reads = [(f"e{i}", 0, "+", whole[s : s + 60], 1000 + s, 1000 + s, 10, max(0, 120 - s)) for i, s in enumerate(range(65, 118, 4))]
    df = spark.createDataFrame(reads, "evidence_id string, ref int, dir string, seq string, lo int, hi int, weight int, anchor_bases int")
    got = assembly.assemble(df, 25, 1_000_000, 500).collect()
    assert len(got) == 1 and got[0]["seq"] == whole[65 : 113 + 4 + 60] and got[0]["n_reads"] == len(reads) and got[0]["start"] == 1065
    rec = assembly.assembly_records(assembly.assemble(df, 25, 1_000_000, 500)).first()
    assert rec["kind"] == "breakend" and rec["cigar"] == f"55M{len(got[0]['seq']) - 55}S"


def test_misassembly_is_cut():
    a, b = [("ACG", 1), ("CGT", 2), ("GTA", 3), ("TAC", 4), ("ACG", 5), ("CGG", 6)], {}
    b["r"] = [("ACG", 1, 1, 1, False, "r"), ("CGT", 2, 2, 1, False, "r"), ("GTA", 3, 3, 1, False, "r")]
    b["q"] = [("TAC", 4, 4, 1, False, "q"), ("ACG", 5, 5, 1, False, "q"), ("CGG", 6, 6, 1, False, "q")]
    assert assembly.supported_part(a, b, True) == a[:3] and assembly.supported_part(a, b, False) == a[3:]
    assert assembly.supported_part(a[:4], b, True) == a[:4]
    b["z"] = [("GTA", 3, 3, 1, False, "z"), ("TAC", 4, 4, 1, False, "z")]
    assert assembly.supported_part(a, b, True) == a


def test_consensus(spark):
    rng = random.Random(9)
    s = "".join(rng.choice("ACGT") for _ in range(120))
    bad = s[:60] + ("A" if s[60] != "A" else "C") + s[61:]
    tip = s[:100] + ("A" if s[100] != "A" else "C")
    rows = [(1, s[i : i + 70], 3) for i in range(0, 51, 5)] + [(1, bad[20:110], 1), (1, tip[50:], 1), (2, "NNNN", 1)]
    got = {r["g"]: r["consensus"] for r in assembly.consensus_by(spark.createDataFrame(rows, "g long, seq string, weight int"), "g", 21).collect()}
    assert got == {1: s, 2: ""}


def test_error_correction(spark):
    rng = random.Random(5)
    s = "".join(rng.choice("ACGT") for _ in range(60))
    bad = s[:30] + ("A" if s[30] != "A" else "C") + s[31:]
    df = spark.createDataFrame([(f"r{i}", s) for i in range(12)] + [("bad", bad)], "evidence_id string, seq string")
    fixes = kmers.corrections(kmers.count_kmers(df, 15), 10)
    fixed = {r["evidence_id"]: r["seq"] for r in assembly.corrected(df, fixes, 15).collect()}
    assert fixed["bad"] == s and fixed["r0"] == s


def test_path_nodes(spark):
    s = "ACGTTGCAAC"
    df = spark.createDataFrame([(s[i : i + 4], i, 2) for i in range(7)], "kmer string, pos int, weight int")
    got = assembly.path_nodes(df, 4).collect()
    assert [(r["seq"], r["length"], r["weight"]) for r in got] == [(s, 7, 14)]


# --- links and taxonomy


def test_transitive_path(spark):
    calls = [("xo", "xh", "+", 1000), ("xh", "xo", "-", 9000), ("yo", "yh", "+", 1002), ("yh", "yo", "-", 5000), ("zo", "zh", "+", 5400), ("zh", "zo", "-", 9001)]
    df = spark.createDataFrame([(i, m, 0, d, p, p) for i, m, d, p in calls], "id string, mate_id string, ref int, dir string, start int, end int")
    got = {(r["id"], r["path"]): r["distance"] for r in links.transitive_paths(df, 5, 1000).collect()}
    assert got == {("xo", "yo,zo"): 400, ("xh", "zh,yh"): 400}


def test_unique_links(spark):
    df = spark.createDataFrame([(1, 0, 0, "+", 100, 100, 5, 1), (2, 0, 0, "-", 110, 110, 5, 2), (3, 0, 0, "-", 500, 500, 5, 3), (4, 0, 0, "+", 505, 505, 5, 4), (5, 0, 0, "+", 510, 510, 5, 5)], "id long, sample int, ref int, dir string, start int, end int, qual long, event long")
    assert rows(links.linked_neighbours(df, 35)) == [(1, 2)]
    assert rows(links.linked_neighbours(df, 35, "closest")) == [(1, 2), (3, 4)]


def test_taxonomy(spark):
    nodes = spark.createDataFrame([(1, 1, "root"), (2, 1, "genus"), (3, 2, "species"), (4, 2, "species"), (5, 1, "species")], "taxid long, parent long, rank string")
    assert {r["taxid"] for r in taxonomy.descendants(nodes, [2]).collect()} == {2, 3, 4}
    assert {r["taxid"]: r["tree_reads"] for r in taxonomy.tree_sums(spark.createDataFrame([(3, 5), (4, 2)], "taxid long, reads long"), nodes).collect()} == {1: 7, 2: 7, 3: 5, 4: 2}


def test_long_chains_deep_trees_and_dense_chunks(spark):
    """Nothing stops at a number of rounds, and nothing is thinned out unasked."""
    import random

    from breakline.operators import assembly, taxonomy

    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(10_024))
    nodes = spark.createDataFrame([(seq[i : i + 25], i, 1) for i in range(10_000)], "kmer string, pos long, weight long")
    (row,) = assembly.path_nodes(nodes, 25).collect()
    assert (row.start, row.length, row.seq, row.weight) == (0, 10_000, seq, 10_000)
    tree = spark.range(1, 301).selectExpr("id AS taxid", "greatest(id - 1, 1) AS parent")
    got = taxonomy.closure(tree)
    assert got.count() == 300 * 301 // 2 and got.selectExpr("max(steps)").first()[0] == 299
    dense = spark.range(300_000).selectExpr("CAST(id AS STRING) AS evidence_id", "0 AS ref", "'+' AS dir", "5000 AS lo", "5010 AS hi")
    assert assembly.chunked(dense, 10_000_000, 1000).count() == 300_000
    assert 0 < assembly.chunked(dense, 10_000_000, 1000, 1000).count() < 2000


def test_allocated_calls_know_their_assemblies(spark):
    from breakline.plans import adapters as A
    from breakline.plans import programs

    ev, calls = (A.view(spark, "/root/testdata/sf0.001", x) for x in (A.EV, A.CALLS))
    got = programs.allocate_evidence(ev, calls, 64).collect()
    assert any(r.assemblies for r in got) and all(("NO_ASSEMBLY" in r.filters) == (r.assemblies == 0) for r in got)
    kept = programs.allocate_evidence(ev, calls, 64, write_filtered=False).collect()
    assert all(not r.filters for r in kept) and len(kept) <= sum(not r.filters for r in got)
