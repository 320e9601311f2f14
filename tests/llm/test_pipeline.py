"""The pipeline's stages against a brute-force version of each on its own input."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline as cp
from breakline.llm.common import materialise

from .test_llm_operators import brute_targets
from .test_near_copies import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, before = docs.columns, docs.collect()
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for name, stage in cp.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        after = docs.collect()
        if name != "shards":
            assert docs.columns == cols
        if name == "language_id":
            assert {r.doc_id for r in before if r.text and any(c.isalpha() for c in r.text)} == {r.doc_id for r in after}
        elif name == "near_dedup":
            assert sorted(r.doc_id for r in after) == brute([(r.doc_id, r.text) for r in before])
        elif name == "decontaminate":
            w = lambda t: re.findall(r"\w+", t.lower())
            grams = lambda x: {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
            item = [grams(w(t)) for t in items.values()]
            bad = {r.doc_id for r in before if any(len(g & grams(w(r.text))) >= 0.8 * len(g) for g in item if g)}
            assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad
        elif name == "source_mix":
            sums = Counter()
            for r in before:
                sums[r.source] += size(r.text)
            target, n = brute_targets(sums), Counter(r.doc_id for r in after)
            for r in before:
                rate = target[r.source] / sums[r.source]
                assert int(rate) <= n[r.doc_id] <= min(int(rate) + 1, 2)
        else:
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
            sums = Counter()
            for r in after:
                sums[r.shard] += len(r.text.encode())
            assert all(sums[r.shard] == r.shard_bytes <= 16 << 20 for r in after)
        before = after


def test_run_is_the_last_stage(spark):
    assert cp.run(spark, SF).count() > 0 and 4 <= len(cp.STAGES) <= 5


def test_empty_and_null_documents(spark):
    """Each stage takes an empty table, and rows that are null in every column."""
    kind = spark.read.parquet(f"{SF}/documents.parquet").schema
    nothing = spark.createDataFrame([], kind)
    odd = spark.createDataFrame([(None,) * 5, (None,) * 5, (5, "", None, None, 0), (6, "und so weiter und so fort", None, None, None), (7, "und so weiter und so fort", "de", "a", None)], kind)
    for name, stage in cp.STAGES:
        assert materialise(stage(spark, nothing, SF), name).count() == 0
        out = materialise(stage(spark, odd, SF), name)
        want = {"language_id": {6, 7}, "near_dedup": {5, 6}, "decontaminate": {None, 5, 6, 7}, "shards": {None, 5, 6, 7}}.get(name)
        assert want is None or {r.doc_id for r in out.collect()} == want, name
