"""Breakend assembly on a positional de Bruijn graph.

Support nodes, their aggregation and error correction are tables (``kmers``). What is sequential, finding and removing the best
path, runs per chunk of the genome and direction with numpy, on evidence that ``chunked`` pads so that each contig is found
whole in the chunk where it starts. All evidence takes part. A group grows with the depth of its chunk: a caller who wants a bound on it takes a smaller
``chunk``, which loses nothing, or gives ``most``, which thins a chunk out by a hash of the evidence.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

K = 25
ANCHOR_LENGTH = 300
LEAST_READS = 3
CHUNK = 10_000_000

CONTIG_SCHEMA = "ref int, dir string, chunk long, contig_id int, start int, end int, weight long, n_reads int, anchor_start int, anchor_end int, seq string, evidence string"


class Graph:
    """Nodes (k-mer at an interval of positions) with summed weight, from reads whose first base lies in an interval."""

    def __init__(self, k: int):
        self.k = k
        self.support: dict[str, list[tuple[int, int, int, bool, str]]] = {}

    def add(self, ident: str, seq: str, lo: int, hi: int, weight: int, anchored: list[bool]) -> bool:
        """Adds a read's k-mers; False if none is off the reference, as such evidence tells nothing."""
        rows, seen = [], defaultdict(int)
        for i in range(len(seq) - self.k + 1):
            seen[seq[i : i + self.k]] += 1
        for i in range(len(seq) - self.k + 1):
            kmer = seq[i : i + self.k]
            if set(kmer) <= set("ACGT") and (lo == hi or seen[kmer] == 1):
                rows.append((kmer, lo + i, hi + i, weight, anchored[i], ident))
        if not rows or all(r[4] for r in rows):
            return False
        self.support[ident] = [r[:5] + (ident,) for r in rows]
        return True

    def nodes(self) -> dict[tuple[str, int], tuple[int, int, bool, set[str]]]:
        """(k-mer, start) to (end, weight, is_ref, evidence): each k-mer's intervals cut where its support changes."""
        by: dict[str, list] = defaultdict(list)
        for rows in self.support.values():
            for kmer, s, e, w, ref, ident in rows:
                by[kmer].append((s, e, w, ref, ident))
        out = {}
        for kmer, rows in by.items():
            cuts = sorted({x for s, e, *_ in rows for x in (s, e + 1)})
            for a, b in zip(cuts, cuts[1:], strict=False):
                here = [r for r in rows if r[0] <= a and r[1] >= b - 1]
                if here:
                    out[kmer, a] = (b - 1, sum(r[2] for r in here), any(r[3] for r in here), {r[4] for r in here})
        return out


def best_path(nodes: dict, k: int, anchor_bonus: int = 1) -> list[tuple[str, int]] | None:
    """The heaviest path of nodes that follow each other by one base and one position; reference nodes stand only at either end.

    Nodes are taken in order of their start, so every predecessor is settled first. Ties go to the path that begins earlier, then to the smaller k-mer.
    """
    order = sorted(nodes, key=lambda x: (x[1], x[0]))
    score: dict[tuple[str, int], tuple[int, int]] = {}
    back: dict[tuple[str, int], tuple[str, int] | None] = {}
    before: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for kmer, s in order:
        before[kmer[1:]].append((kmer, s))
    best, best_key = None, None
    for key in order:
        kmer, s = key
        e, w, ref, _ = nodes[key]
        found = None
        for p in before.get(kmer[:-1], ()):
            pe, _, pref, _ = nodes[p]
            # the predecessor's interval moved on by one must meet this one
            if p not in score or p[1] + 1 > e or pe + 1 < s:
                continue
            # two reference nodes don't follow each other in a path, and one that ends a path isn't passed
            if pref and (ref or back[p] is not None):
                continue
            total = score[p][0] + (anchor_bonus if ref else w)
            if found is None or (total, -score[p][1], p) > found[:3]:
                found = (total, -score[p][1], p)
        own = (anchor_bonus if ref else w, s)
        if found is not None and (ref or found[0] > own[0]):
            score[key], back[key] = (found[0], -found[1]), found[2]
        else:
            score[key], back[key] = own, None
        if ref and back[key] is None:
            continue  # the reference alone is no contig
        rank = (score[key][0], -score[key][1], kmer)
        if best is None or rank > best:
            best, best_key = rank, key
    if best_key is None:
        return None
    path = [best_key]
    while back[path[-1]] is not None:
        path.append(back[path[-1]])
    return path[::-1]


def extend_anchor(nodes: dict, k: int, at: tuple[str, int], forwards: bool, most: int) -> list[tuple[str, int]]:
    """Reference nodes that go on from a path's end, the heaviest first, for at most ``most`` bases."""
    out: list[tuple[str, int]] = []
    while len(out) < most:
        kmer, s = at
        step = 1 if forwards else -1
        near = [(kmer[1:] + b if forwards else b + kmer[:-1], s + step) for b in "ACGT"]
        found = [x for x in near if x in nodes and nodes[x][2]]
        if not found:
            break
        at = max(found, key=lambda x: (nodes[x][1], x[0]))
        out.append(at)
    return out


def supported_part(path: list[tuple[str, int]], support: dict, from_start: bool) -> list[tuple[str, int]]:
    """A path that holds a k-mer twice can join reads that no read joins. It is cut at the first step (from its start or its end)
    that no read makes; other paths stay whole."""
    kmers = [p[0] for p in path]
    if len(set(kmers)) == len(kmers):
        return path
    steps = set()
    for rows in support.values():
        for a, b in zip(rows, rows[1:], strict=False):
            if b[1] == a[1] + 1:
                steps.add((a[0], b[0]))
    made = [(a, b) in steps for a, b in zip(kmers, kmers[1:], strict=False)]
    if all(made):
        return path
    if from_start:
        return path[: made.index(False) + 1]
    return path[len(path) - made[::-1].index(False) - 1 :]


def related(rows: list[tuple], k: int) -> list[list[tuple]]:
    """Reads (id, seq, lo, hi, ...) in groups that share no k-mer at one place; contigs never cross groups."""
    top = list(range(len(rows)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    places: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
    for n, (_, seq, lo, hi, *_rest) in enumerate(rows):
        for i in range(len(seq) - k + 1):
            places[seq[i : i + k]].append((lo + i, hi + i, n))
    for spans in places.values():
        spans.sort()
        end, last = spans[0][1], spans[0][2]
        for lo, hi, n in spans[1:]:
            if lo <= end:
                top[find(n)] = find(last)
            end, last = (hi, n) if lo > end or hi > end else (end, last)
    groups: dict[int, list[tuple]] = defaultdict(list)
    for n, row in enumerate(rows):
        groups[find(n)].append(row)
    return list(groups.values())


def contigs_of(rows: list[tuple[str, str, int, int, int, list[bool]]], k: int, least_reads: int, anchor_length: int = ANCHOR_LENGTH) -> list[dict]:
    """Contigs of all reads, in order of their start: each group of related reads by itself, so that a chunk's work is the sum of its groups'."""
    found = [c for group in related(rows, k) for c in contigs_of_group(group, k, least_reads, anchor_length)]
    return sorted(found, key=lambda c: (c["start"], c["seq"]))


def contigs_of_group(rows: list[tuple[str, str, int, int, int, list[bool]]], k: int, least_reads: int, anchor_length: int = ANCHOR_LENGTH) -> list[dict]:
    """Contigs of reads (id, seq, lo, hi, weight, anchored per k-mer): the best path with its anchors made longer, its support removed, again until nothing is left."""
    graph = Graph(k)
    for ident, seq, lo, hi, weight, anchored in rows:
        graph.add(ident, seq, lo, hi, weight, anchored)
    out: list[dict] = []
    while graph.support:
        nodes = graph.nodes()
        path = best_path(nodes, k)
        if not path:
            break
        path = supported_part(path, graph.support, not nodes[path[-1]][2])
        used = set().union(*(nodes[p][3] for p in path if not nodes[p][2])) or set().union(*(nodes[p][3] for p in path))
        weight = sum(nodes[p][1] for p in path if not nodes[p][2])
        before = extend_anchor(nodes, k, path[0], False, anchor_length - k)[::-1] if nodes[path[0]][2] else []
        after = extend_anchor(nodes, k, path[-1], True, anchor_length - k) if nodes[path[-1]][2] else []
        left = len(before) + k if nodes[path[0]][2] else 0
        right = len(after) + k if nodes[path[-1]][2] else 0
        path = before + path + after
        seq = path[0][0] + "".join(p[0][-1] for p in path[1:])
        if len(used) >= least_reads:
            out.append({"start": path[0][1], "end": path[-1][1] + k - 1, "weight": weight, "n_reads": len(used), "anchor_start": left, "anchor_end": right, "seq": seq, "evidence": ",".join(sorted(used))})
        for ident in used:
            graph.support.pop(ident, None)
    return out


def chunked(ev: DataFrame, chunk: int, pad: int, most: int | None = None) -> DataFrame:
    """Evidence in every chunk that its place, padded, touches; all of it, unless ``most`` is given: then a chunk of more rows is thinned out by a hash of the id."""
    spread = ev.withColumn("chunk", F.explode(F.sequence(F.floor((F.col("lo") - pad) / chunk).cast("long"), F.floor((F.col("hi") + pad) / chunk).cast("long"))))
    if most is None:
        return spread
    n = spread.groupBy("ref", "dir", "chunk").agg(F.count(F.lit(1)).alias("_n"))
    unit = F.conv(F.substring(F.md5(F.col("evidence_id").cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    return spread.join(n, ["ref", "dir", "chunk"]).where(unit * F.col("_n") < most).drop("_n")


def assemble(ev: DataFrame, k: int = K, chunk: int = CHUNK, pad: int = 1000, least_reads: int = LEAST_READS, most: int | None = None) -> DataFrame:
    """Contigs of evidence (evidence_id, ref, dir, seq, lo, hi, weight, anchor_bases: bases at the anchored end, at the sequence's start for '+').

    A contig belongs to the chunk in which it starts.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ref, direction, number = key
        rows = []
        for r in pdf.sort_values("evidence_id").itertuples():
            n = max(len(r.seq) - k + 1, 0)
            inside = max(min(int(r.anchor_bases) - k + 1, n), 0)
            anchored = [i < inside for i in range(n)] if direction == "+" else [i >= n - inside for i in range(n)]
            rows.append((r.evidence_id, r.seq.upper(), int(r.lo), int(r.hi), int(r.weight), anchored))
        found = [c for c in contigs_of(rows, k, least_reads) if c["start"] // chunk == number]
        out = pd.DataFrame(found, columns=["start", "end", "weight", "n_reads", "anchor_start", "anchor_end", "seq", "evidence"])
        out.insert(0, "contig_id", range(len(out)))
        out.insert(0, "chunk", number)
        out.insert(0, "dir", direction)
        out.insert(0, "ref", ref)
        return out

    return chunked(ev, chunk, pad, most).groupBy("ref", "dir", "chunk").applyInPandas(run, CONTIG_SCHEMA)


def corrected(ev: DataFrame, fixes: DataFrame, k: int) -> DataFrame:
    """Evidence with low-count k-mers replaced (fixes: kmer, to): at most one base per k-mer, the first k-mer of a read that changes it wins.

    Bases to change are found by joining k-mers, and are put in by position with a fold over the read's own changes.
    """
    from .kmers import kmer_rows

    rows = kmer_rows(ev, k, ("evidence_id",)).join(fixes, "kmer")
    differs = F.filter(F.sequence(F.lit(1), F.lit(k)), lambda i: F.substring(F.col("kmer"), i, F.lit(1)) != F.substring(F.col("to"), i, F.lit(1)))
    at = rows.withColumn("_i", F.get(differs, 0)).select("evidence_id", "off", (F.col("off") + F.col("_i") - 1).alias("pos"), F.substring(F.col("to"), F.col("_i"), F.lit(1)).alias("base"))
    one = at.groupBy("evidence_id", "pos").agg(F.min_by("base", "off").alias("base"))
    per = one.groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("_fix"))
    fixed = F.aggregate("_fix", F.col("seq"), lambda s, x: F.concat(F.substring(s, F.lit(1), x["pos"]), x["base"], F.substring(s, x["pos"] + 2, F.length(s))))
    return ev.join(per, "evidence_id", "left").withColumn("seq", F.when(F.col("_fix").isNotNull(), fixed).otherwise(F.col("seq"))).drop("_fix")


def assembly_records(contigs: DataFrame) -> DataFrame:
    """Contigs as synthetic reads: name, ref, pos, cigar, seq, kind (breakpoint, breakend, unanchored)."""
    n = F.length("seq")
    left, right = F.least("anchor_start", n), F.least("anchor_end", n)
    both = (left > 0) & (right > 0)
    kind = F.when(both, "breakpoint").when((left > 0) | (right > 0), "breakend").otherwise("unanchored")
    inner = F.greatest(n - left - right, F.lit(0))
    m, i, t = F.concat(left.cast("string"), F.lit("M")), F.concat(inner.cast("string"), F.lit("I")), F.concat(right.cast("string"), F.lit("M"))
    cigar = (
        F.when(both, F.concat(m, F.when(inner > 0, i).otherwise(""), t))
        .when(left > 0, F.concat(m, (n - left).cast("string"), F.lit("S")))
        .when(right > 0, F.concat((n - right).cast("string"), F.lit("S"), t))
        .otherwise(F.concat(F.lit("1X"), n.cast("string"), F.lit("S")))
    )
    name = F.concat_ws("_", F.lit("asm"), F.col("ref").cast("string"), F.col("chunk").cast("string"), F.when(F.col("dir") == "+", "f").otherwise("b"), F.col("contig_id").cast("string"))
    return contigs.select(name.alias("name"), "ref", F.col("start").alias("pos"), cigar.alias("cigar"), "seq", kind.alias("kind"), "weight", "n_reads", F.split("evidence", ",").alias("evidence_ids"))


def simplify_paths(nodes: DataFrame) -> DataFrame:
    """Nodes (code, start, end, weight, is_ref) with neighbours of one k-mer, equal weight and touching intervals merged."""
    w = Window.partitionBy("code", "weight", "is_ref").orderBy("start")
    marked = nodes.withColumn("_new", F.when(F.col("start") == F.lag("end").over(w) + 1, 0).otherwise(1))
    marked = marked.withColumn("_g", F.sum("_new").over(w))
    return marked.groupBy("code", "weight", "is_ref", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def path_nodes(nodes: DataFrame, k: int) -> DataFrame:
    """Unbranched chains of point nodes (kmer, pos, weight) as one node each: (head, start, length, seq, weight).

    Pointer jumping: each round doubles how far a node sees along its chain, until no node sees further; rounds are written.
    """
    a = nodes.select(F.concat_ws("@", "kmer", F.col("pos").cast("string")).alias("id"), F.substring("kmer", 2, k - 1).alias("mid"), (F.col("pos") + 1).alias("next"))
    b = nodes.select(F.concat_ws("@", "kmer", F.col("pos").cast("string")).alias("to"), F.substring("kmer", 1, k - 1).alias("mid"), F.col("pos").alias("next"))
    e = a.join(b, ["mid", "next"]).select("id", "to")
    one_out = e.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to")).where(F.col("n") == 1).select("id", "to")
    one_in = e.groupBy("to").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 1).select("to")
    link = one_out.join(one_in, "to", "left_semi").select(F.col("to").alias("id"), F.col("id").alias("up"))
    all_ids = nodes.select(F.concat_ws("@", "kmer", F.col("pos").cast("string")).alias("id"), "kmer", "pos", "weight")
    head = all_ids.select("id").join(link, "id", "left").select("id", F.coalesce("up", "id").alias("head"))
    head = written(head, "heads")
    while True:
        far = head.select(F.col("id").alias("head"), F.col("head").alias("further"))
        nxt = written(head.join(far, "head").select("id", F.col("further").alias("head")), "heads")
        if nxt.join(head, ["id", "head"], "left_anti").isEmpty():
            break
        head = nxt
    rows = all_ids.join(head, "id").groupBy("head").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("length"), F.sum("weight").cast("long").alias("weight"), F.array_sort(F.collect_list(F.struct("pos", "kmer"))).alias("c"))
    return rows.select("head", "start", "length", F.concat(F.col("c")[0]["kmer"], F.array_join(F.transform(F.slice("c", F.lit(2), F.greatest(F.size("c") - 1, F.lit(1))), lambda x: F.substring(x["kmer"], k, 1)), "")).alias("seq"), "weight")


def usable(contigs: DataFrame, breakend_length: Column, fragment: int, read_length: int) -> DataFrame:
    """Contigs that may be called: not longer than a fragment allows, enough reads, anchored or longer than a read."""
    anchored = (F.col("anchor_start") > 0) | (F.col("anchor_end") > 0)
    return contigs.where((breakend_length <= 1.5 * fragment) & (F.col("n_reads") >= LEAST_READS) & (anchored | (breakend_length > read_length)))


def consensus(sequences: list[tuple[str, int]], k: int, most_different: float = 0.1) -> str:
    """The heaviest sequence through the k-mers of weighted sequences, whatever their positions.

    Unbranched chains are one node. Tips and bubbles whose sequence differs from a heavier neighbour in no more than ``most_different`` of
    its bases are given to that neighbour. Then the heaviest path is taken greedily from the heaviest node in both directions,
    never through a node twice.
    """
    weight: dict[str, int] = defaultdict(int)
    for seq, w in sequences:
        for i in range(len(seq) - k + 1):
            if set(seq[i : i + k]) <= set("ACGT"):
                weight[seq[i : i + k]] += w
    if not weight:
        return ""

    def after(x: str) -> list[str]:
        return [x[1:] + b for b in "ACGT" if x[1:] + b in weight]

    def before(x: str) -> list[str]:
        return [b + x[:-1] for b in "ACGT" if b + x[:-1] in weight]

    def chain(x: str) -> list[str]:
        out = [x]
        while len(n := after(out[-1])) == 1 and len(before(n[0])) == 1 and n[0] != x:
            out.append(n[0])
        return out

    # each fork's branches that run to a dead end or to the same merge: the lighter of two that are alike goes
    changed = True
    while changed:
        changed = False
        for x in sorted(weight):
            if x not in weight or len(after(x)) < 2:
                continue
            arms = sorted((chain(n) for n in after(x)), key=lambda c: (-sum(weight[y] for y in c), c))
            for arm in arms[1:]:
                best, n = arms[0], min(len(arms[0]), len(arm))
                ends, top_ends = after(arm[-1]), after(best[-1])
                tip, bubble = not ends and len(arm) <= len(best), len(arm) == len(best) and ends and ends == top_ends
                different = sum(a[-1] != b[-1] for a, b in zip(arm, best, strict=False)) / n
                if (tip or bubble) and different <= max(most_different, 1 / n):
                    for a, b in zip(arm, best, strict=False):
                        weight[b] += weight[a]
                    for a in arm:
                        weight.pop(a, None)
                    changed = True
    start = max(sorted(weight), key=lambda x: weight[x])
    path, seen = [start], {start}
    for step, end in ((after, -1), (before, 0)):
        while found := [n for n in step(path[end]) if n not in seen]:
            n = max(found, key=lambda y: (weight[y], y))
            seen.add(n)
            path.insert(len(path) if end else 0, n)
    return path[0] + "".join(x[-1] for x in path[1:])


def consensus_by(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, seq, consensus length) per group of rows (key, seq, weight): equal sequences are summed first, so a group is as large as its variety."""
    summed = df.groupBy(key, "seq").agg(F.sum("weight").cast("long").alias("weight"))

    def run(value: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seq = consensus(sorted(zip(pdf["seq"], pdf["weight"], strict=True)), k)
        return pd.DataFrame({key: [value[0]], "consensus": [seq], "n": [len(pdf)]})

    kind = dict(df.dtypes)[key]
    return summed.groupBy(key).applyInPandas(run, f"{key} {kind}, consensus string, n long")
