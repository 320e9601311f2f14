"""Near-duplicate detection with SimHash and a segment-popcount embedding.

The 64 bits of a fingerprint are cut into 32 segments of two bits; their popcounts are a vector. The Manhattan distance of two
such vectors is at most the Hamming distance of the fingerprints, so pairs further apart than ``BITS`` can be left out. Links
allow 3 differing bits; of the vector's two halves at least one then differs by 1 at most. The grid has a cell for each half
vector: a fingerprint stands in the cells of its two halves, and where a half's sum is even also in the cells at distance 1
(two half vectors at distance 1 have sums of different parity, so one side is enough). Fingerprints that meet in a cell are
compared: first the Manhattan distance over the whole vector, then the exact Hamming distance.

Equal fingerprints are one node, so copies meet nobody. In a cell, links are given as a forest, never as all pairs. A cell's distinct
fingerprints are held by one task, 8 bytes each, and compared in blocks of ``_CHUNK`` rows; a cell holds 2^-16 of all distinct fingerprints at
the densest (half vectors of ones), if they are spread evenly. Components follow by stars (``components``).

Defined results: null text is empty text; a text without words has fingerprint zero, linked like any other; one or two words
are one shingle. Repeated rows repeat. A null id takes part in links but is never a component's id unless it has no other (then null).
Other columns are kept by ``near_dedup``, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Apart, materialise, text_batches
from .components import components

SHINGLE = 3
SEED = 42
#: Fingerprints link at this many differing bits or fewer. The two halves of the grid need it to be 3 or fewer.
BITS = 3
_CHUNK = 2048
_PAIRS = 0x5555555555555555


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), SEED)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in spans), ">u8", len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), fp as a signed number."""

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    text_batches(docs)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The popcounts of all 32 two-bit segments, two bits for each, as one number."""
    return fp - ((fp >> np.uint64(1)) & np.uint64(_PAIRS))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed popcount vectors: digits 0, 1, 2 differ in the low bit at distance 1, in the high bit alone at 2."""
    d = a ^ b
    low, high = d & np.uint64(_PAIRS), (d >> np.uint64(1)) & np.uint64(_PAIRS)
    return np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(high & ~low).astype(np.int64)


def _cells(batches):
    """Each fingerprint with its cells; ``own`` where it stands itself."""
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        vector = popcounts(fp)
        cells, who, own = [], [], []
        for half in (0, 1):
            v = (vector >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            tag = np.uint64(half << 32)
            cells.append(tag | v)
            who.append(fp)
            own.append(np.ones(len(fp), bool))
            part = (fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
            even = np.bitwise_count(part) % 2 == 0
            v, f = v[even], fp[even]
            for k in range(16):
                one = np.uint64(1 << (2 * k))
                digit = (v >> np.uint64(2 * k)) & np.uint64(3)
                for may, moved in ((digit < 2, v + one), (digit > 0, v - one)):
                    cells.append(tag | moved[may])
                    who.append(f[may])
                    own.append(np.zeros(int(may.sum()), bool))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.concatenate(who).view(np.int64)), pa.array(np.concatenate(own))], names=["cell", "fp", "own"])


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs link: the Manhattan bound first, then the exact distance."""
    near = np.flatnonzero(manhattan(popcounts(a), popcounts(b)) <= BITS)
    return near[np.bitwise_count(a[near] ^ b[near]) <= BITS]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes as the given ones, one per node at most."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _cell_links(fp: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large cell, compared chunk by chunk."""
    mine = np.unique(fp[own])
    every = np.unique(fp)
    a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for i in range(0, len(mine), _CHUNK):
        for j in range(0, len(every), _CHUNK):
            x, y = mine[i : i + _CHUNK], every[j : j + _CHUNK]
            p, q = np.nonzero(manhattan(popcounts(x)[:, None], popcounts(y)[None, :]) <= BITS)  # the bound, then exactly
            near = np.bitwise_count(x[p] ^ y[q]) <= BITS
            p, q = p[near], q[near]
            differ = x[p] != y[q]
            if differ.any():
                a, b = _forest(np.concatenate((a, x[p[differ]])), np.concatenate((b, y[q[differ]])))
    return a, b


def _pairs(batches):
    """Links among the fingerprints of each cell; rows come in order of the cell."""

    def links(cell, fp, own):
        found_a, found_b = [], []
        start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        size = np.diff(np.append(start, len(cell)))
        for s in np.flatnonzero(size > 64):
            a, b = _cell_links(fp[start[s] : start[s] + size[s]], own[start[s] : start[s] + size[s]])
            found_a.append(a)
            found_b.append(b)
        small = np.repeat((size > 1) & (size <= 64), size)
        at, shift = np.flatnonzero(small), 1
        while len(at := at[at + shift < len(cell)]):
            at = at[cell[at] == cell[at + shift]]
            one = at[own[at] | own[at + shift]]
            near = one[_linked(fp[one], fp[one + shift])]
            found_a.append(fp[near])
            found_b.append(fp[near + shift])
            shift += 1
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (found_a, found_b))
        a, b = _forest(a, b) if len(a) else (a, b)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        own = batch.column(2).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
        if cut:
            yield links(*(np.concatenate(x) for x in zip(*rest, (cell[:cut], fp[:cut], own[:cut]), strict=True)))
            rest = []
        rest.append((cell[cut:], fp[cut:], own[cut:]))
    if rest:
        yield links(*(np.concatenate(x) for x in zip(*rest, strict=True)))


def links(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that connect all that differ by ``BITS`` bits or fewer."""
    cells = nodes.select("fp").mapInArrow(_cells, "cell long, fp long, own boolean")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_pairs, "a long, b long")


def by_component(prints: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) from documents (doc_id, fp), distinct nodes (fp, least) and their links (a, b)."""
    roots = components(links).select(F.col("node").alias("fp"), "root")
    named = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "named")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    # only components of several fingerprints need the second join
    joint = ids.where(F.col("n") > 1).select("root", "component_id")
    by_print = named.join(joint, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``."""
    prints = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    return by_component(prints, nodes, links(nodes))


def simhash_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    got = grouped(docs.select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=grouped) -> DataFrame:
    """``docs`` with one document of each component of ``groups``: the one with the smallest id; of rows equal in id, one.

    A row without an id stands behind all that have one, in the order of its text's hash.
    """
    apart = Apart(docs)
    stand_in = F.lit(1 << 62) + F.pmod(F.xxhash64(apart.col(text_col)), F.lit(1 << 61))
    own = apart.df.withColumn("sid", F.coalesce(apart.col(id_col).cast("long"), stand_in))
    got = groups(own.select("sid", apart.col(text_col).alias("text")), "sid", "text")
    keep = materialise(got.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "kept")
    # always by shuffle, whatever the size: the texts move once and the ids that stay are hashed partition by partition
    kept = own.join(keep.select(F.col("doc_id").alias("sid")).hint("shuffle_hash"), "sid", "left_semi")
    if not keep.where(F.col("n") > 1).isEmpty():
        kept = kept.dropDuplicates(["sid"])
    return apart.back(kept)
