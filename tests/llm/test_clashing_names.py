"""Extra columns of any name stay as they are, whatever an operator adds to the rows on its way."""

from __future__ import annotations

import pytest

import corpus_pipeline as cp
from breakline.llm import decontaminate, extendible_shards, line_dedup, pii_surrogates, simhash, source_mix

#: Names that operators use or used for columns of their own, in this and another case, and some that no operator uses.
NAMES = "_leak_key _sid _size _source _mix _h _depth _shard _key _block _n_lines _n_dropped _kinds _n_entities key sid size h b slot lo hi depth prefix shard_bytes n_docs nth part at part_no block c0 C1 KEY _Shard point times threshold target pos w fp n source_size kind bound a.b".split()
CALLS = {
    "mix": lambda df: source_mix.mix(df),
    "mix_decisions": lambda df: source_mix.mix_decisions(df),
    "dedup_lines": lambda df: line_dedup.dedup_lines(df),
    "dedup_lines by blocks": lambda df: line_dedup.dedup_lines(df, index_bytes=0),
    "assign_shards": lambda df: extendible_shards.assign_shards(df, 60),
    "replace_pii": lambda df: pii_surrogates.replace_pii(df),
    "near_dedup": lambda df: simhash.near_dedup(df),
    "decontaminate": lambda df: decontaminate.decontaminate(df, df.sparkSession.createDataFrame([(1, "an item that is in none of the texts")], "item_id long, text string")),
    "stage_near_dedup": lambda df: cp.stage_near_dedup(df.sparkSession, df, ""),
    "stage_shards": lambda df: cp.stage_shards(df.sparkSession, df, ""),
}
TEXTS = ["so it is said by all of them here\nand so on", "so it is said by all of them here\nquite another line", "x", None, "mail a.b@c.example.com now and then and so forth", "mail a.b@c.example.com now and then and so forth", "one line alone stands here today"]


@pytest.mark.parametrize("call", sorted(CALLS))
def test_extra_columns_stay(spark, call):
    rows = [(i, t, "en", f"s{i % 2}", *[f"{n}{i}" for n in NAMES]) for i, t in enumerate(TEXTS)]
    names = ["doc_id", "text", "lang", "source", *NAMES]
    seen = set()
    keep = [k for k, n in enumerate(names) if not (n.lower() in seen or seen.add(n.lower()))]  # two tables, as names that differ in case alone can't both be told apart by a caller
    other = [k for k in range(len(names)) if k < 4 or k not in keep]
    for at in (keep, other):
        schema = ", ".join(f"`{names[k]}` {'long' if k == 0 else 'string'}" for k in at)
        df = spark.createDataFrame([tuple(r[k] for k in at) for r in rows], schema)
        got = CALLS[call](df)
        assert got.columns[: len(at)] == [names[k] for k in at] and len({c.lower() for c in got.columns}) == len(got.columns)
        out = got.collect()
        assert out
        for r in out:
            assert all(r[j] == f"{names[k]}{r[0]}" for j, k in enumerate(at) if k > 3)


def test_both_ways_of_line_dedup_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = (sorted(map(str, line_dedup.dedup_lines(docs, index_bytes=n).collect())) for n in (line_dedup.INDEX_BYTES, 0))
    assert a == b


def test_a_line_that_is_not_indexed_misses():
    import numpy as np

    rng = np.random.default_rng(4)
    hi, lo = (rng.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(2))
    least = np.arange(3000)
    most = least + (np.arange(3000) % 3 == 0)  # every third line is in two documents
    index = line_dedup.LineIndex(hi, lo, least, most)
    again = line_dedup.LineIndex.of(index.row(0))
    for i in (index, again):
        count, owner = i.probe(hi, lo)
        assert i.hash.n == 1000 and (count > 0).tolist() == (np.arange(3000) % 3 == 0).tolist() and (owner[::3] == least[::3]).all()
        far = i.probe(*(rng.integers(0, 2**63, 100_000).astype(np.uint64) for _ in range(2)))
        assert not far[0].any()
