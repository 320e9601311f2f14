"""CIGAR algebra with higher-order functions.

A parsed CIGAR is array<struct<len:int, op:string>>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

READ_OPS = ("M", "I", "S", "=", "X")
REF_OPS = ("M", "D", "N", "=", "X")
MAPPED_OPS = ("M", "=", "X")
INDEL_OPS = ("I", "D", "N")
TYPE = "array<struct<len:int,op:string>>"


def parse(text: Column) -> Column:
    """'10M2I' to an array; '*' and null to an empty one."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHPX=])"), F.lit(1))
    got = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"(\d+)", 1).cast("int").alias("len"), F.regexp_extract(p, r"(\D)$", 1).alias("op")))
    return F.coalesce(got, F.array().cast(TYPE))


def render(cigar: Column) -> Column:
    text = F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")
    return F.when(F.size(cigar) == 0, F.lit("*")).otherwise(text)


def length_of(cigar: Column, ops) -> Column:
    return F.aggregate(cigar, F.lit(0), lambda a, x: a + F.when(x["op"].isin(*ops), x["len"]).otherwise(0))


def read_length(cigar: Column, hard: bool = False) -> Column:
    return length_of(cigar, (*READ_OPS, "H") if hard else READ_OPS)


def reference_length(cigar: Column) -> Column:
    return length_of(cigar, REF_OPS)


def mapped_bases(cigar: Column) -> Column:
    return length_of(cigar, MAPPED_OPS)


def _leading(cigar: Column, ops) -> Column:
    """Summed length of the run of ``ops`` at the start."""
    state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    return F.aggregate(cigar, state, lambda a, x: F.struct((a["n"] + F.when(a["on"] & x["op"].isin(*ops), x["len"]).otherwise(0)).alias("n"), (a["on"] & x["op"].isin("S", "H")).alias("on")), lambda a: a["n"])


def start_clip(cigar: Column, hard: bool = True) -> Column:
    return _leading(cigar, ("S", "H") if hard else ("S",))


def end_clip(cigar: Column, hard: bool = True) -> Column:
    return _leading(F.reverse(cigar), ("S", "H") if hard else ("S",))


def unclipped_bounds(start: Column, cigar: Column) -> tuple[Column, Column]:
    return start - start_clip(cigar), start + reference_length(cigar) - 1 + end_clip(cigar)


def count_indels(cigar: Column) -> Column:
    """Runs of indel operators."""
    return F.size(indel_runs(cigar))


def has_large_indel(cigar: Column, least: int) -> Column:
    return F.exists(cigar, lambda x: x["op"].isin(*INDEL_OPS) & (x["len"] >= least))


def clean(cigar: Column) -> Column:
    """Operators of no length gone, equal neighbours merged."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1))["op"], F.lit("")) == x["op"])
        merged = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct((F.coalesce(F.try_element_at(acc, F.lit(-1))["len"], F.lit(0)) + x["len"]).alias("len"), x["op"].alias("op"))))
        del last
        return F.when(same, merged).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.filter(cigar, lambda x: x["len"] > 0), F.array().cast(TYPE), step)


def imprecision_width(cigar: Column) -> Column:
    """Width of an XNX placeholder that stands for an interval; 0 if the CIGAR isn't one."""
    ops = F.array_join(F.transform(F.filter(cigar, lambda x: ~x["op"].isin("S", "H")), lambda x: x["op"]), "")
    width = length_of(cigar, ("X", "N"))
    return F.when(ops.isin("X", "XNX", "XX"), F.when(ops == "X", F.aggregate(cigar, F.lit(0), lambda a, x: a + F.when(x["op"] == "X", x["len"]).otherwise(0)) - 1).otherwise(width - 1)).otherwise(F.lit(0))


def placeholder(width: Column) -> Column:
    """The CIGAR text of a breakend that is ``width`` positions wide: 1X, 2X, or 1X(n)N1X."""
    return F.when(width == 1, F.lit("1X")).when(width == 2, F.lit("2X")).otherwise(F.concat(F.lit("1X"), (width - 2).cast("string"), F.lit("N1X")))


def with_offsets(cigar: Column) -> Column:
    """Each element with the read and reference bases before it."""
    state = F.array().cast("array<struct<len:int,op:string,read_off:int,ref_off:int,i:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        read = F.coalesce(last["read_off"] + F.when(last["op"].isin(*READ_OPS), last["len"]).otherwise(0), F.lit(0))
        ref = F.coalesce(last["ref_off"] + F.when(last["op"].isin(*REF_OPS), last["len"]).otherwise(0), F.lit(0))
        return F.concat(acc, F.array(F.struct(x["len"].alias("len"), x["op"].alias("op"), read.alias("read_off"), ref.alias("ref_off"), F.size(acc).alias("i"))))

    return F.aggregate(cigar, state, step)


def indel_runs(cigar: Column) -> Column:
    """Runs of neighbouring indel operators inside the read: array of (read_off, ref_off, read_len, ref_len, size, longest_op, longest)."""
    kind = "array<struct<read_off:int,ref_off:int,read_len:int,ref_len:int,size:int,longest_op:string,longest:int,last:int>>"

    def step(acc: Column, x: Column) -> Column:
        run = F.try_element_at(acc, F.lit(-1))
        is_indel = x["op"].isin(*INDEL_OPS)
        read = F.when(x["op"] == "I", x["len"]).otherwise(0)
        ref = F.when(x["op"] != "I", x["len"]).otherwise(0)
        goes_on = F.coalesce(run["last"] == x["i"] - 1, F.lit(False))
        longer = x["len"] > run["longest"]
        grown = F.struct(run["read_off"].alias("read_off"), run["ref_off"].alias("ref_off"), (run["read_len"] + read).alias("read_len"), (run["ref_len"] + ref).alias("ref_len"), (run["size"] + x["len"]).alias("size"), F.when(longer, x["op"]).otherwise(run["longest_op"]).alias("longest_op"), F.greatest(run["longest"], x["len"]).alias("longest"), x["i"].alias("last"))
        fresh = F.struct(x["read_off"].alias("read_off"), x["ref_off"].alias("ref_off"), read.alias("read_len"), ref.alias("ref_len"), x["len"].alias("size"), x["op"].alias("longest_op"), x["len"].alias("longest"), x["i"].alias("last"))
        return F.when(~is_indel, acc).when(goes_on, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    runs = F.aggregate(with_offsets(cigar), F.array().cast(kind), step)
    # a run at either end of the read is no event
    return F.filter(runs, lambda r: (r["last"] < F.size(cigar) - 1) & (r["read_off"] > 0))


def edit_distance(cigar: Column, nm: Column) -> Column:
    """Mismatches and indel bases as NM tells, or indel bases and X alone where it doesn't."""
    return F.coalesce(nm, length_of(cigar, ("I", "D", "X")))


def identity(cigar: Column, nm: Column) -> Column:
    """Share of aligned bases that equal the reference."""
    m = mapped_bases(cigar)
    mismatch = nm - length_of(cigar, ("I", "D"))
    return F.when(m > 0, 1.0 - F.greatest(mismatch, F.lit(0)) / m).otherwise(F.lit(0.0))


def split_after(cigar: Column, bases: Column) -> tuple[Column, Column]:
    """The CIGARs of the first ``bases`` read bases and of the rest, the other part soft-clipped."""
    total = read_length(cigar)
    at = with_offsets(cigar)

    def part(first: bool) -> Column:
        def cut(x: Column) -> Column:
            eats = x["op"].isin(*READ_OPS)
            lo, hi = x["read_off"], x["read_off"] + F.when(eats, x["len"]).otherwise(0)
            inside = F.when(eats, F.least(hi, bases) - lo if first else hi - F.greatest(lo, bases)).otherwise(F.when((lo < bases) if first else (lo >= bases), x["len"]).otherwise(0))
            return F.struct(F.greatest(inside, F.lit(0)).alias("len"), x["op"].alias("op"))

        body = F.transform(at, cut)
        clip = F.struct((total - bases if first else bases).alias("len"), F.lit("S").alias("op"))
        return clean(F.concat(body, F.array(clip)) if first else F.concat(F.array(clip), body))

    return part(True), part(False)


def parse_sa(text: Column) -> Column:
    """An SA tag to array<struct(rname, pos, strand, cigar, mapq, nm)>."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: p != "")

    def one(p: Column) -> Column:
        f = F.split(p, ",")
        return F.struct(f[0].alias("rname"), f[1].cast("int").alias("pos"), f[2].alias("strand"), f[3].alias("cigar"), f[4].cast("int").alias("mapq"), f[5].cast("int").alias("nm"))

    return F.transform(parts, one)


def first_aligned_offset(cigar: Column, negative: Column) -> Column:
    """Read bases before the aligned part, in the direction in which the read was sequenced."""
    return F.when(negative, end_clip(cigar)).otherwise(start_clip(cigar))


def last_aligned_offset(cigar: Column, negative: Column) -> Column:
    return read_length(cigar, hard=True) - 1 - F.when(negative, start_clip(cigar)).otherwise(end_clip(cigar))


def successor_breakend(start: Column, cigar: Column, negative: Column) -> Column:
    """Where the read leaves this alignment: struct (dir, pos)."""
    end = start + reference_length(cigar) - 1
    return F.struct(F.when(negative, F.lit("-")).otherwise(F.lit("+")).alias("dir"), F.when(negative, start).otherwise(end).alias("pos"))


def predecessor_breakend(start: Column, cigar: Column, negative: Column) -> Column:
    """Where the read enters this alignment: struct (dir, pos)."""
    end = start + reference_length(cigar) - 1
    return F.struct(F.when(negative, F.lit("+")).otherwise(F.lit("-")).alias("dir"), F.when(negative, end).otherwise(start).alias("pos"))


def trim(cigar: Column, head: Column, tail: Column) -> Column:
    """Without ``head`` read bases at the start and ``tail`` at the end; what has no read bases at an end goes, too."""
    n = read_length(cigar)

    def cut(x: Column) -> Column:
        eats = x["op"].isin(*READ_OPS)
        left = F.greatest(F.least(x["read_off"] + x["len"], n - tail) - F.greatest(x["read_off"], head), F.lit(0))
        inside = (x["read_off"] > head) & (x["read_off"] < n - tail)
        return F.struct(F.when(eats, left).when(inside, x["len"]).otherwise(0).alias("len"), x["op"].alias("op"))

    return clean(F.transform(with_offsets(cigar), cut))


def trim_clips(cigar: Column) -> Column:
    return F.filter(cigar, lambda x: ~x["op"].isin("S", "H"))


def with_soft_clips(cigar: Column, head: Column, tail: Column) -> Column:
    """Soft clips of so many more bases at either end; hard clips stay outermost."""
    def clip(n: Column) -> Column:
        return F.array(F.struct(n.cast("int").alias("len"), F.lit("S").alias("op")))

    def hard(c: Column) -> Column:
        return F.filter(F.slice(c, F.lit(1), F.least(F.size(c), F.lit(1))), lambda x: x["op"] == "H")

    inner = F.filter(cigar, lambda x: x["op"] != "H")
    return clean(F.concat(hard(cigar), clip(head), inner, clip(tail), hard(F.reverse(cigar))))


def offset_of(cigar: Column, read_off: Column) -> Column:
    """Reference offset of a read base from the first aligned one: the next aligned base's for bases that aren't aligned; null after the last."""
    later = F.filter(with_offsets(cigar), lambda x: x["op"].isin(*MAPPED_OPS) & (x["read_off"] + x["len"] > read_off))
    x = F.get(later, 0)
    return x["ref_off"] + F.greatest(read_off - x["read_off"], F.lit(0))


def ungapped(cigar: Column, from_start: bool) -> Column:
    """The aligned part up to the first gap (or from the last one), the rest clipped."""
    c = cigar if from_start else F.reverse(cigar)
    state = F.struct(F.array().cast(TYPE).alias("out"), F.lit(False).alias("gap"))

    def step(acc: Column, x: Column) -> Column:
        gap = acc["gap"] | x["op"].isin("D", "I", "N", "P")
        kept = F.struct(F.when(gap & ~x["op"].isin(*READ_OPS), 0).otherwise(x["len"]).alias("len"), F.when(gap & (x["op"] != "H"), F.lit("S")).otherwise(x["op"]).alias("op"))
        return F.struct(F.concat(acc["out"], F.array(kept)).alias("out"), gap.alias("gap"))

    got = F.aggregate(c, state, step, lambda a: a["out"])
    return clean(got if from_start else F.reverse(got))


def common_bases(a: Column, b: Column) -> Column:
    """Read bases that both CIGARs align."""
    def spans(c: Column) -> Column:
        return F.transform(F.filter(with_offsets(c), lambda x: x["op"].isin(*MAPPED_OPS)), lambda x: F.struct(x["read_off"].alias("s"), (x["read_off"] + x["len"]).alias("e")))

    y = spans(b)
    return F.aggregate(spans(a), F.lit(0), lambda n, p: n + F.aggregate(y, F.lit(0), lambda m, q: m + F.greatest(F.least(p["e"], q["e"]) - F.greatest(p["s"], q["s"]), F.lit(0))))


def aligned_pairs(cigar: Column) -> Column:
    """Aligned stretches: array of (read_off, ref_off, len)."""
    return F.transform(F.filter(with_offsets(cigar), lambda x: x["op"].isin(*MAPPED_OPS)), lambda x: F.struct(x["read_off"].alias("read_off"), x["ref_off"].alias("ref_off"), x["len"].alias("len")))


def recomputed_nm(cigar: Column, bases: Column, ref_bases: Column) -> Column:
    """Edit distance of a read to the reference bases that it spans: mismatches of aligned bases, and indel bases."""
    def mismatches(x: Column) -> Column:
        p, q = F.substring(bases, x["read_off"] + 1, x["len"]), F.substring(ref_bases, x["ref_off"] + 1, x["len"])
        return F.size(F.filter(F.arrays_zip(F.split(p, "").alias("a"), F.split(q, "").alias("b")), lambda z: F.upper(z["a"]) != F.upper(z["b"])))

    return F.aggregate(aligned_pairs(cigar), F.lit(0), lambda n, x: n + mismatches(x)) + length_of(cigar, ("I", "D"))


def unclip_matches(cigar: Column, bases: Column, ref_before: Column, ref_after: Column) -> Column:
    """Soft-clipped bases next to the aligned part that equal the reference beside it become aligned (ref_before ends where the alignment starts)."""
    from .seq import common_prefix, common_suffix

    n, head, tail = F.length(bases), start_clip(cigar, False), end_clip(cigar, False)
    a = F.least(common_suffix(F.substring(bases, F.lit(1), head), ref_before), head)
    b = F.least(common_prefix(F.substring(bases, n - tail + 1, tail), ref_after), tail)
    inner = F.filter(cigar, lambda x: x["op"] != "S")

    def part(k: Column, op: str) -> Column:
        return F.array(F.struct(k.cast("int").alias("len"), F.lit(op).alias("op")))

    return clean(F.concat(part(head - a, "S"), part(a, "M"), inner, part(b, "M"), part(tail - b, "S")))


def hard_clips_to_n(cigar: Column, bases: Column) -> tuple[Column, Column]:
    """Hard clips as soft clips, their bases as N: (cigar, bases)."""
    hard = F.filter(cigar, lambda x: x["op"] == "H")
    head = F.when(F.get(cigar, 0)["op"] == "H", F.get(cigar, 0)["len"]).otherwise(0)
    tail = F.when((F.size(hard) > F.when(head > 0, 1).otherwise(0)), F.element_at(hard, -1)["len"]).otherwise(0)
    soft = F.transform(cigar, lambda x: F.struct(x["len"].alias("len"), F.when(x["op"] == "H", F.lit("S")).otherwise(x["op"]).alias("op")))
    return clean(soft), F.concat(F.repeat(F.lit("N"), head), bases, F.repeat(F.lit("N"), tail))
