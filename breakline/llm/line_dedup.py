"""Line deduplication with a sharded minimal perfect hash.

A first pass over the texts sends, for each block of them, the 128-bit hashes of its distinct line keys with the smallest and the
largest id that holds each to the shard that the hash selects. A shard builds a minimal perfect hash over the distinct line hashes
that several documents hold; the function indexes compact arrays of fingerprints, counts (one, or several) and owners, and is written
as one row of bytes. A second pass lets the documents probe these arrays with all their lines: most lines are in no shard's arrays
and miss, by the hash's bits or by the fingerprint of 64 bits. Lines are never joined; a line in a third of all documents is one
entry per block.

The arrays go to every task if they are measured to be at most ``INDEX_BYTES`` together; then texts aren't shuffled at all. Beyond that documents are dealt
into blocks, each block's distinct line hashes travel to the shards and probe the arrays there, and the block is told of the hits. Both
ways give the same rows.

Blocks hold about ``BLOCK_BYTES`` of text and shards index about ``SHARD_BYTES`` of it, whatever the input.

Defined results: a line's key is the line without white space (space, tab to carriage return) at both ends and with A-Z
lower-cased. Null or empty text is one empty line, kept. Keys of at least ``min_chars`` code points in at least two
documents stay in the smallest id only (there all of their lines stay). Rows with the same id are one document. Rows with null id
lose what a row with an id holds; lines that only rows with null id hold stay. Other columns are kept, whatever their names (added columns
get one more underscore where the caller has such a name); an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_BYTES, Apart, block_count, block_of, materialise, text_batches, text_bytes
from .perfect_hash import MinimalPerfectHash, mix64

MIN_CHARS = 10
#: Bytes of text whose lines one shard indexes, about.
SHARD_BYTES = 8 << 20
#: Bytes of all arrays up to which every task holds them.
INDEX_BYTES = 32 << 20
_SPACE = b" \t\n\r\x0b\x0c"
_NO_ID = np.iinfo(np.int64).max
ENTRIES = "shard int, block int, hi long, lo long, least long, most long"
INDEX = "shard int, hash binary, fingerprint binary, count binary, owner binary"


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line its key, or None if the key is too short to count."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(_SPACE).lower()
        n = len(key)
        out.append(key if n >= 4 * min_chars or n >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars else None)
    return out


def _digests(keys) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class _Entries:
    """Distinct keys of a block with the smallest and the largest id that holds each."""

    def __init__(self, min_chars: int, shards: int):
        self.min_chars, self.shards = min_chars, shards
        self.least: dict[bytes, int] = {}
        self.most: dict[bytes, int] = {}

    def add(self, doc: int | None, text: bytes | None) -> None:
        if not text:
            return
        doc = _NO_ID if doc is None else doc
        least, most = self.least, self.most
        for k in {k for k in line_keys(text, self.min_chars) if k is not None}:
            if k not in least:
                least[k] = most[k] = doc
            elif doc < least[k]:
                least[k] = doc
            elif doc > most[k]:
                most[k] = doc

    def rows(self, block: int) -> pa.RecordBatch:
        hi, lo = _digests(self.least)
        n = len(hi)
        cols = [(hi % np.uint64(self.shards)).astype(np.int32), np.full(n, block, np.int32), hi.view(np.int64), lo.view(np.int64), np.fromiter(self.least.values(), np.int64, n), np.fromiter(self.most.values(), np.int64, n)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["shard", "block", "hi", "lo", "least", "most"])


def _scan_entries(min_chars: int, shards: int):
    """Entries of a scan's rows, block by block as they come."""

    def run(batches):
        said, size = _Entries(min_chars, shards), 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                said.add(doc, text.as_py())
            size += texts.nbytes
            if size >= BLOCK_BYTES:
                yield said.rows(0)
                said, size = _Entries(min_chars, shards), 0
        if said.least:
            yield said.rows(0)

    return run


def _block_entries(min_chars: int, shards: int, names: list[str]):
    """Entries of a block of documents."""

    def run(block: pa.Table) -> pa.Table:
        said = _Entries(min_chars, shards)
        for doc, text in zip(block.column(names[0]).to_pylist(), block.column(names[1]).cast(pa.binary()), strict=True):
            said.add(doc, text.as_py())
        return pa.Table.from_batches([said.rows(block.column("block")[0].as_py())])

    return run


def print_of(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix64(lo ^ mix64(hi + np.uint64(0x632BE59BD9B4E019)))


class LineIndex:
    """The arrays of a shard behind its minimal perfect hash: the lines that several documents hold."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, least: np.ndarray, most: np.ndarray):
        order = np.lexsort((lo, hi))
        h, low = hi[order], lo[order]
        at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (low[1:] != low[:-1])))) if len(h) else np.zeros(0, np.int64)
        first = np.minimum.reduceat(least[order], at) if len(at) else least
        several = first < np.maximum.reduceat(most[order], at) if len(at) else np.zeros(0, bool)
        h, low, first = h[at[several]], low[at[several]], first[several]
        self.hash = MinimalPerfectHash(h, low)
        slot = self.hash.index(h, low)
        self.fingerprint, self.owner = np.zeros(len(h), np.uint64), np.zeros(len(h), np.int64)
        self.count = np.full(len(h), 2, np.uint8)
        self.fingerprint[slot], self.owner[slot] = print_of(h, low), first

    def row(self, shard: int) -> dict:
        return {"shard": shard, "hash": self.hash.to_bytes(), "fingerprint": self.fingerprint.tobytes(), "count": self.count.tobytes(), "owner": self.owner.tobytes()}

    @classmethod
    def of(cls, row: dict) -> LineIndex:
        out = cls.__new__(cls)
        out.hash = MinimalPerfectHash.from_bytes(row["hash"])
        out.fingerprint, out.count, out.owner = np.frombuffer(row["fingerprint"], np.uint64), np.frombuffer(row["count"], np.uint8), np.frombuffer(row["owner"], np.int64)
        return out

    def probe(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (2: several documents) and owner of each line hash; 0 and no owner of one that isn't in the arrays."""
        at = self.hash.index(hi, lo)
        hit = at >= 0
        hit[hit] = self.fingerprint[at[hit]] == print_of(hi[hit], lo[hit])
        count, owner = np.zeros(len(hi), np.uint8), np.full(len(hi), _NO_ID)
        count[hit], owner[hit] = self.count[at[hit]], self.owner[at[hit]]
        return count, owner


def _index(entries: pa.Table) -> pa.Table:
    """Index a shard's lines; a shard without lines in several documents gives no row."""
    hi, lo = (entries.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
    made = LineIndex(hi, lo, entries.column("least").to_numpy(), entries.column("most").to_numpy())
    rows = [made.row(entries.column("shard")[0].as_py())] if made.hash.n else []
    kinds = [("shard", pa.int32()), *((c, pa.binary()) for c in ("hash", "fingerprint", "count", "owner"))]
    return pa.Table.from_pylist(rows, pa.schema(kinds))


def _answer(probes: pa.Table, index: pa.Table) -> pa.Table:
    """A shard's arrays, probed by the lines of all blocks: the hits that can cost a block a line."""
    hi, lo = (probes.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
    count, owner = LineIndex.of(index.to_pylist()[0]).probe(hi, lo) if len(index) and len(probes) else (np.zeros(len(hi), np.uint8), np.full(len(hi), _NO_ID))
    told = (count > 1) & (probes.column("most").to_numpy() != owner)  # a block that holds only the owner drops nothing
    return pa.table({"block": pa.array(probes.column("block").to_numpy()[told], pa.int32()), "hi": pa.array(hi[told].view(np.int64)), "lo": pa.array(lo[told].view(np.int64)), "owner": pa.array(owner[told], pa.int64())})


def _kept(min_chars: int, names: list[str], docs: pa.Table | pa.RecordBatch, owners) -> list[pa.Array]:
    """Texts without the lines whose owner is another document, lines, and dropped lines. ``owners`` are of the given distinct keys, in order."""
    texts = docs.column(names[1]).cast(pa.binary()).to_pylist()
    keys = [line_keys(t, min_chars) if t else [] for t in texts]
    distinct = list({k for ks in keys for k in ks if k is not None})
    owner = {k: o for k, o in zip(distinct, owners(distinct), strict=True) if o != _NO_ID}
    kept, total, dropped = [], [], []
    for doc, text, ks in zip(docs.column(names[0]).to_pylist(), texts, keys, strict=True):
        doc = _NO_ID if doc is None else doc
        gone = [owner.get(k, doc) != doc for k in ks] if owner else []
        total.append(max(len(ks), 1))
        dropped.append(sum(gone))
        kept.append(b"\n".join(line for line, g in zip(text.split(b"\n"), gone, strict=True) if not g) if any(gone) else text)
    return [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]


def _probe_held(min_chars: int, names: list[str], held, shards: int):
    """Documents probe the arrays, which every task holds."""

    def run(batches):
        index = {row["shard"]: LineIndex.of(row) for row in held.value}

        def owners(keys: list[bytes]) -> list[int]:
            hi, lo = _digests(keys)
            out, shard = np.full(len(hi), _NO_ID), (hi % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            cut = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if (own := index.get(int(shard[order[a]]))) is not None:
                    out[order[a:b]] = own.probe(hi[order[a:b]], lo[order[a:b]])[1]
            return out.tolist()

        for batch in batches:
            text, *added = _kept(min_chars, names, batch, owners)
            cols = [text if n == names[1] else batch.column(i) for i, n in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays([*cols, *added], names=[*batch.schema.names, "_n_lines", "_n_dropped"])

    return run


def _probe_told(min_chars: int, names: list[str], columns: list[str]):
    """A block drops its lines by what the shards told."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        pair = np.stack([told.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")], axis=1).astype(">u8").tobytes() if len(told) else b""
        owner = dict(zip((pair[i : i + 16] for i in range(0, len(pair), 16)), told.column("owner").to_pylist() if len(told) else (), strict=True))
        text, n, dropped = _kept(min_chars, names, docs, lambda keys: [owner.get(xxhash.xxh3_128_digest(k), _NO_ID) for k in keys])
        return pa.table({c: text if c == names[1] else docs.column(c) for c in columns} | {"_n_lines": n, "_n_dropped": dropped})

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` with repeated lines gone from the text, and ``_n_lines``, ``_n_dropped``. A null text stays null."""
    text_batches(docs)
    apart = Apart(docs)
    names = [apart.name(id_col), apart.name(text_col)]
    own = apart.df.withColumns({names[0]: F.col(names[0]).cast("long"), names[1]: F.col(names[1]).cast("string")})
    schema = T.StructType([*own.schema.fields, T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType())])
    n_bytes = text_bytes(own, names[1])
    shards = block_count(n_bytes, SHARD_BYTES)
    entries = own.select(*names).mapInArrow(_scan_entries(min_chars, shards), ENTRIES)
    index = materialise(entries.drop("block").groupBy("shard").applyInArrow(_index, INDEX), "line-index")
    size = index.agg(F.sum(sum(F.octet_length(c) for c in ("hash", "fingerprint", "count", "owner")) + F.lit(256))).first()[0] or 0
    if size <= index_bytes:
        held = docs.sparkSession.sparkContext.broadcast([r.asDict() for r in index.collect()])  # its size is measured
        return apart.back(own.mapInArrow(_probe_held(min_chars, names, held, shards), schema), "_n_lines", "_n_dropped")
    # both uses take the same columns, so that the texts are shuffled once
    dealt = own.withColumn("block", block_of(F.col(names[0]), F.col(names[1]), block_count(n_bytes)))
    probes = dealt.groupBy("block").applyInArrow(_block_entries(min_chars, shards, names), ENTRIES)
    told = probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_answer, "block int, hi long, lo long, owner long")
    return apart.back(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_probe_told(min_chars, names, apart.own), schema), "_n_lines", "_n_dropped")


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256."""
    got = dedup_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_chars=min_chars)
    return got.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), s AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), f AS (
  SELECT k.doc_id, k.i, k.line, s.owner IS NOT NULL AND s.owner <> k.doc_id AS gone FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
