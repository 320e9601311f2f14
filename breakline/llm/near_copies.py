"""Near copies by the exact Jaccard similarity of word shingles.

Two texts are near copies if their sets of ``SHINGLE``-word shingles agree by ``SIMILAR`` (a fraction) or more. All such pairs are
found by prefix filtering: the shingles have one order that holds everywhere, and of two sets of similarity 4/5 the first
n - ceil(4n/5) + 1 shingles of each have one in common. Any order is right; shingles that are frequent in a sample of the
documents come last, so that few texts meet in them. Texts that meet are compared by their whole sets.

SimHash comes first (``simhash``): sets whose texts' fingerprints differ by 3 bits or fewer are compared, and what they link needs no further
comparison. It can't tell all pairs of that similarity, so prefix filtering adds those it misses.

Equal sets are one node. In a cell of up to ``_SMALL`` nodes all pairs that their sizes allow are compared. In a larger one, first
each node with the least and with its neighbours in size; then, once components are known, all pairs that are still in
different ones and whose parity bitmaps allow it: a bitmap's bits are the parities of a set's shingles by hash, so two bitmaps differ
in no more bits than their sets in shingles, and no similar pair is left out. A large group of near copies thus costs some pairs a member; nothing is left out.

Defined results: null text is empty text; texts without words are equal; up to ``SHINGLE`` words are one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_or_not, text_batches
from .components import components
from .simhash import by_component, fingerprint
from .simhash import links as print_links

SHINGLE = 5
SEED = 42
#: Numerator and denominator of the similarity from which texts are near copies.
SIMILAR = (4, 5)
#: One document of so many is asked for frequent shingles; those in ``_OFTEN`` of them come last, the most frequent ``_MOST`` at most.
_SAMPLE, _OFTEN, _MOST = 8, 4, 1_000_000
_SMALL, _NEXT = 64, 4
#: Bits of a parity bitmap.
_BITS = 1024
#: Bytes of texts and sets that a task keeps while it compares pairs.
_HELD = 32 << 20


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    words = text.lower().split() if text else []
    h = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([h(b" ".join(words), SEED)] if words else [], np.uint64)
    w = np.fromiter((h(x, SEED) for x in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    got = np.zeros(n, np.uint64)
    for k in range(SHINGLE):  # a polynomial of mixed word hashes, mixed after each step
        got = (got ^ w[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        got ^= got >> np.uint64(29)
    return np.unique(got)


def node(s: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def parities(s: np.ndarray) -> bytes:
    """How many of the shingles fall on each bit, modulo 2."""
    return np.packbits(np.bincount((s >> np.uint64(32)).astype(np.int64) % _BITS, minlength=_BITS).astype(np.uint8) & 1).tobytes()


def first(s: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which two similar sets have one in common; ``often`` is sorted, ``rank`` its order from rare to frequent."""
    n, (up, down) = len(s), SIMILAR
    if not n:
        return s
    late = np.zeros(n, np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
        late = np.where(often[at] == s, rank[at] + 1, 0)
    return s[np.lexsort((s, late))[: n + (-n * up // down) + 1]]


def _sets(batches):
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            yield i.as_py(), shingles(t.as_py())


def _table(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def _signed(s: np.ndarray) -> np.ndarray:
    return s.view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def _frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        for batch in batches:
            got = [s for _, s in _sets([batch]) if len(s)]
            if got:
                yield _table(["node", "g"], np.repeat([node(s) for s in got], [len(s) for s in got]), _signed(np.concatenate(got)))

    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(_SAMPLE)) == 0).dropDuplicates(["text"])
    said = sample.mapInArrow(run, "node long, g long").groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= _OFTEN)
    got = said.orderBy(F.desc("n"), "g").limit(_MOST).toArrow()
    g, n = (got.column(k).to_numpy() for k in ("g", "n"))
    g = g.view(np.uint64)
    order = np.lexsort((g, n))
    rank = np.empty(len(g), np.int64)
    rank[order] = np.arange(len(g))
    at = np.argsort(g)
    return g[at], rank[at]


def _by_cell(batches, of_cells):
    """``of_cells`` of whole cells; rows come in order of their first column."""
    rest: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell may go on
        if cut:
            yield from of_cells(*(np.concatenate(x) for x in zip(*rest, [c[:cut] for c in cols], strict=True)))
            rest = []
        rest.append([c[cut:] for c in cols])
    if rest:
        yield from of_cells(*(np.concatenate(x) for x in zip(*rest, strict=True)))


def _sized(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.minimum(n, m) * SIMILAR[1] >= np.maximum(n, m) * SIMILAR[0]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
    return got[0], got[1]


def _meetings(batches):
    """Cells (g, node, n) to pairs (a, b), and with their g the rows (a = node, b = n) of cells too large for all pairs."""

    def run(cell, who, n):
        start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        size = np.diff(np.append(start, len(cell)))
        large = np.repeat(size > _SMALL, size)
        least = np.repeat(np.arange(len(cell))[start], size)
        x, y = [np.flatnonzero(large)], [least[large]]
        at, shift = np.arange(len(cell)), 1
        while len(at := at[at + shift < len(cell)]):
            at = at[cell[at] == cell[at + shift]]
            if shift > _NEXT:
                at = at[~large[at]]
            x.append(at)
            y.append(at + shift)
            shift += 1
        x, y = np.concatenate(x), np.concatenate(y)
        ok = (who[x] != who[y]) & _sized(n[x], n[y])
        a, b = _distinct(who[x[ok]], who[y[ok]])
        none = pa.nulls(len(a), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(a), pa.array(b)], names=["g", "a", "b"])
        yield _table(["g", "a", "b"], cell[large], who[large], n[large])

    return _by_cell(batches, run)


def _across(batches):
    """Large cells (g, node, n, root, bits) to the pairs of different components that can be similar."""
    up, down = SIMILAR

    def run(cell, who, n, root, bits):
        for s, e in zip(start := np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))), [*start[1:], len(cell)], strict=True):
            if (root[s:e] == root[s]).all():
                continue
            odd = np.frombuffer(b"".join(bits[s:e]), np.uint64).reshape(e - s, -1)
            for i in range(s, e):  # rows are in order of n
                far = i + 1 + int(np.searchsorted(n[i + 1 : e], n[i] * down // up, "right"))
                at = i + 1 + np.flatnonzero(root[i + 1 : far] != root[i])
                differ = np.bitwise_count(odd[at - s] ^ odd[i - s]).sum(axis=1, dtype=np.int64)
                other = who[at[differ * (up + down) <= (n[at] + n[i]) * (down - up)]]
                if len(other):
                    yield _table(["a", "b"], np.minimum(other, who[i]), np.maximum(other, who[i]))

    return _by_cell(batches, run)


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar by their whole sets. Texts are what moves, as they are smaller than their sets."""

    def run(batches):
        known: dict[bytes, np.ndarray] = {}  # a text is in several pairs
        held = 0

        def of(text: bytes) -> np.ndarray:
            nonlocal held
            if text not in known:
                if held > _HELD:
                    known.clear()
                    held = 0
                known[text] = shingles(text)
                held += len(text) + known[text].nbytes
            return known[text]

        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()), strict=True):
                x, y = of(x.as_py()), of(y.as_py())
                same = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(same * SIMILAR[1] >= (len(x) + len(y) - same) * SIMILAR[0])
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def named(batches):  # rows equal in id can differ in text: those of the node alone
        for batch in batches:
            fits = [node(shingles(t.as_py())) == f.as_py() for t, f in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1)], names=["fp", "text"]).filter(pa.array(fits, pa.bool_()))

    n = pairs.count()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    ids = materialise(nodes.join(wanted, "fp", "left_semi").select(F.col("least").alias("doc_id"), "fp"), "wanted")
    own = materialise(texts.join(small_or_not(ids, ids.count()), "doc_id").mapInArrow(named, "fp long, text string"), "texts")
    left = own.withColumnsRenamed({"fp": "a", "text": "ta"}).join(small_or_not(pairs, n), "a")
    return left.join(own.withColumnsRenamed({"fp": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _by_print(sims: DataFrame) -> DataFrame:
    """Nodes with fingerprints (fp, sim) to the pairs (a, b) that SimHash gives: each with one of its fingerprint, and one of each of two linked ones."""
    one = materialise(sims.groupBy("sim").agg(F.min("fp").alias("rep")), "fingerprints")
    same = sims.join(one, "sim").where(F.col("fp") != F.col("rep")).select("fp", "rep")
    linked = print_links(one.select(F.col("sim").alias("fp")))
    far = linked.join(one.select(F.col("sim").alias("a"), F.col("rep").alias("fp")), "a").join(one.select(F.col("sim").alias("b"), "rep"), "b").select("fp", "rep")
    return same.unionByName(far).select(F.least("fp", "rep").alias("a"), F.greatest("fp", "rep").alias("b")).distinct()


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that the links don't connect yet."""
    roots = components(links)
    got = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("_x")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("_y")), "b", "left")
    return got.where(F.coalesce("_x", "a") != F.coalesce("_y", "b")).select("a", "b")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``, which has no null ids; fp names the text's set of shingles."""
    text_batches(docs)
    texts = _texts(docs, id_col, text_col)
    often, rank = _frequent(texts)
    sent = docs.sparkSession.sparkContext.broadcast((often, rank))

    def run(batches):
        for batch in batches:
            ids, names, sizes, firsts, bits = [], [], [], [], []
            sims = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows)
            for i, s in _sets([batch]):
                ids.append(i)
                bits.append(parities(s))
                names.append(node(s))
                sizes.append(len(s))
                firsts.append(_signed(first(s, *sent.value)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(_signed(sims)), pa.array(bits, pa.binary())], names=["doc_id", "fp", "n", "first", "sim", "bits"])

    # one row per document with its first shingles, a fifth of all
    said = materialise(texts.mapInArrow(run, "doc_id long, fp long, n long, first array<long>, sim long, bits binary"), "shingles")
    prints = said.select("doc_id", "fp")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    least = nodes.select(F.col("least").alias("doc_id"), "fp").hint("shuffle_hash")
    one = said.join(least, ["doc_id", "fp"], "left_semi")
    marks = materialise(said.select("doc_id", "fp", "sim", "bits").join(least, ["doc_id", "fp"], "left_semi").groupBy("fp").agg(F.min("sim").alias("sim"), F.first("bits").alias("bits")), "marks")
    links = materialise(_verified(materialise(_by_print(marks.select("fp", "sim")), "pairs-print"), texts, nodes), "similar-print")
    cells = one.select(F.explode("first").alias("g"), "fp", "n")
    met = materialise(cells.repartition("g").sortWithinPartitions("g", "n", "fp").mapInArrow(_meetings, "g long, a long, b long"), "met")
    pairs = _apart(met.where(F.col("g").isNull()).select("a", "b").distinct(), links)
    links = links.unionByName(materialise(_verified(materialise(pairs, "pairs"), texts, nodes), "similar"))
    large = met.where(F.col("g").isNotNull()).select("g", F.col("a").alias("fp"), F.col("b").alias("n"))
    if not large.isEmpty():
        roots = components(links).select(F.col("node").alias("fp"), "root")
        rooted = large.join(roots, "fp", "left").join(marks.select("fp", "bits"), "fp").select("g", "fp", "n", F.coalesce("root", "fp").alias("root"), "bits")
        more = rooted.repartition("g").sortWithinPartitions("g", "n", "fp").mapInArrow(_across, "a long, b long").distinct()
        more = materialise(more, "pairs-across")
        if not more.isEmpty():
            links = links.unionByName(_verified(more, texts, nodes))
    return by_component(prints, nodes, links)
