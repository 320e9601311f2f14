"""Sequences as strings: column expressions over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Adapter prefixes that are looked for.
ADAPTERS = ("AGATCGGAAGAG", "ATGGAATTCTCG", "CTGTCTCTTATA")


def count_of(s: Column, base: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(base), F.lit("")))


def entropy(s: Column) -> Column:
    """Base-2 entropy of A, C, G and T, case ignored, other characters left out; 0 for none."""
    up = F.upper(s)
    n = [count_of(up, b).cast("double") for b in "ACGT"]
    total = n[0] + n[1] + n[2] + n[3]
    parts = [F.when(x > 0, -(x / total) * F.log2(x / total)).otherwise(F.lit(0.0)) for x in n]
    return F.when(total > 0, parts[0] + parts[1] + parts[2] + parts[3]).otherwise(F.lit(0.0))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTacgt", "TGCAtgca"))


def is_ambiguous(s: Column) -> Column:
    return s.rlike("[^ACGTacgt]")


def kmers(s: Column, k: int) -> Column:
    """All k-mers of a sequence in order."""
    last = F.length(s) - k + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_code(s: Column) -> Column:
    """A k-mer of up to 31 bases as a number, two bits a base in the order T, C, A, G; null if it has another letter."""
    digits = F.translate(F.upper(s), "TCAG", "0123")
    return F.when(~is_ambiguous(s), F.conv(digits, 4, 10).cast("long"))


def code_kmer(code: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, F.lit("0")), "0123", "TCAG")


def contains_adapter(s: Column, adapters=ADAPTERS) -> Column:
    """Whether an adapter or its reverse complement occurs."""
    pairs = str.maketrans("ACGT", "TGCA")
    both = [x for a in adapters for x in (a, a.translate(pairs)[::-1])]
    found = F.lit(False)
    for a in both:
        found = found | F.contains(s, F.lit(a))
    return found


def adapter_clip(clip: Column, anchor: Column, adapters=ADAPTERS, homology: int = 6, shortest: int = 4) -> Column:
    """Whether a clip is an adapter, allowing that its first 0 to ``homology`` bases were aligned with the anchor's end."""
    found = F.lit(False)
    for a in adapters:
        for h in range(homology + 1):
            rest = F.lit(a[h:])
            n = F.least(F.length(clip), F.length(rest))
            found = found | ((n >= shortest) & (F.substring(clip, F.lit(1), n) == F.substring(rest, F.lit(1), n)) & F.endswith(anchor, F.lit(a[:h])))
    return found


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: the number of prefixes that agree, which is monotone in the length."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(same)


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def matching_bases(a: Column, b: Column, offset: Column) -> Column:
    """Equal bases of ``a`` and ``b`` when ``b`` starts ``offset`` (0 or more) bases into ``a``."""
    n = F.least(F.length(a) - offset, F.length(b))
    at = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: (i < n) & (F.substring(a, i + offset + 1, F.lit(1)) == F.substring(b, i + 1, F.lit(1))))
    return F.size(at)


def poly_run(s: Column, n: int = 16) -> Column:
    """Whether n C or n G stand in a row."""
    return F.contains(s, F.lit("C" * n)) | F.contains(s, F.lit("G" * n))


def gc_percent(s: Column) -> Column:
    """GC share of the unambiguous bases in percent, rounded down; 50 if there are none."""
    up = F.upper(s)
    gc = count_of(up, "G") + count_of(up, "C")
    total = gc + count_of(up, "A") + count_of(up, "T")
    return F.when(total > 0, F.floor(100 * gc / total)).otherwise(F.lit(50)).cast("int")


def anchor_with_n(sequence: Column, wanted: int, at_start: bool) -> Column:
    """A reference sequence cut short by its contig's end, filled with N."""
    return F.lpad(sequence, wanted, F.lit("N")) if at_start else F.rpad(sequence, wanted, F.lit("N"))


def breakend_allele(ref_base: Column, dir1: Column, inserted: Column, chrom2: Column | None = None, pos2: Column | None = None, dir2: Column | None = None) -> Column:
    """ALT of a breakend: the four bracket forms of a breakpoint, or a dot for a single breakend."""
    base = F.when(is_ambiguous(ref_base), F.lit("N")).otherwise(ref_base)
    if chrom2 is None:
        return F.when(dir1 == "+", F.concat(base, inserted, F.lit("."))).otherwise(F.concat(F.lit("."), inserted, base))
    bracket = F.when(dir2 == "+", F.lit("]")).otherwise(F.lit("["))
    place = F.concat(bracket, chrom2, F.lit(":"), pos2.cast("string"), bracket)
    return F.when(dir1 == "+", F.concat(base, inserted, place)).otherwise(F.concat(place, inserted, base))


def parse_breakend_allele(alt: Column) -> Column:
    """Struct (dir1, inserted, chrom2, pos2, dir2) of an ALT; the second breakend is null for a single breakend."""
    bracket = F.regexp_extract(alt, r"([\[\]])", 1)
    single = bracket == ""
    before = F.regexp_extract(alt, r"^([A-Za-z]*)[\[\].]", 1)
    after = F.regexp_extract(alt, r"[\[\].]([A-Za-z]*)$", 1)
    fwd = before != ""
    inserted = F.when(fwd, F.substring(before, F.lit(2), F.length(before))).otherwise(F.substring(after, F.lit(1), F.length(after) - 1))
    return F.struct(
        F.when(fwd, F.lit("+")).otherwise(F.lit("-")).alias("dir1"),
        inserted.alias("inserted"),
        F.when(~single, F.regexp_extract(alt, r"[\[\]](.+):\d+[\[\]]", 1)).alias("chrom2"),
        F.when(~single, F.regexp_extract(alt, r":(\d+)[\[\]]", 1).cast("int")).alias("pos2"),
        F.when(single, F.lit(None).cast("string")).when(bracket == "]", F.lit("+")).otherwise(F.lit("-")).alias("dir2"),
    )


def evidence_id(*parts: Column) -> Column:
    """A deterministic name from the parts of a read's alignment."""
    return F.concat_ws("#", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def hashed_id(name: Column) -> Column:
    return F.substring(F.sha2(name.cast("binary"), 256), 1, 32)
