"""Near copies against brute force: the Jaccard similarity of the sets of five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline as cp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            a, b = sets[i], sets[j]
            if i < j and (a == b or len(a & b) * 5 >= len(a | b) * 4) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return sorted(set(root.values()))


def test_near_dedup_stage(spark):
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for n in (5, 6, 30, 60, 200, 900):
        for _ in range(6):
            base = prose(n)
            texts.append(base)
            for edits in (0, 1, 2, n // 60, n // 45, n // 30):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(n)] = "edited" + str(rng.randrange(99))
                texts.append(copy)
    group = prose(80)  # a cell of more than 64 texts, in which not all pairs are similar
    for k in range(150):
        copy = list(group)
        for _ in range(1 + k % 5):
            copy[rng.randrange(80)] = f"x{k}"
        texts.append(copy)
    texts += [[], ["one"], ["one"], ["one", "two"]]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(len(texts), None)]
    df = spark.createDataFrame([(*r, "en", "a", 1) for r in rows], SCHEMA)
    got = cp.stage_near_dedup(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == brute(rows)


def test_edited_copies_of_the_table_go(spark):
    """Documents 145 and 177 are alike to 6 and 1 by 0.83, at 7 and 11 bits of the fingerprints."""
    got = {r.doc_id for r in cp.stage_near_dedup(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "").collect()}
    assert {1, 6} <= got and not {145, 177} & got
