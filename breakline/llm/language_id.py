"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (1 to 3 letters, words padded by a mark) in order of
frequency. A document's own list is compared with each profile: for each of its n-grams the distance is the difference
of ranks, or the profile's length where the profile lacks it ("out of place"). The nearest language wins; ties go to the
smaller name by code point.

Learning takes at most ``docs_per_lang`` documents (in expectation, by a hash of the id) of each language, a documented
bound on labelled rows; prediction covers every document and its whole text.

Defined results: null text or a text without a letter is ``und`` with score 0; so is everything if nothing can be learned
from. Rows with null language or null text are not learned from. Repeated rows give repeated rows; other columns than
id, text and language are ignored; an empty table gives an empty table. Profiles are held by every task: ``PROFILE`` n-grams a language.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_batches

#: Length of a profile.
PROFILE = 300
#: Bound on the labelled documents that each language's profile is learned from.
DOCS_PER_LANG = 2000
#: A document whose score is below this is rejected by the pipeline's stage, besides those without a language.
MIN_SCORE = 0.05

UND = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_letters long"
_BITS = 21
_FOLD: list[np.ndarray] = []


def _fold() -> list[np.ndarray]:
    """For each code point its lower case if it is a letter or a mark, else 0; and whether it is a mark."""
    if not _FOLD:
        t, mark = np.zeros(sys.maxunicode + 1, np.uint32), np.zeros(sys.maxunicode + 1, bool)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            mark[i] = unicodedata.category(c)[0] == "M"
            if c.isalpha() or mark[i]:
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _FOLD.extend((t, mark))
    return _FOLD


def grams(text: str) -> tuple[np.ndarray, int]:
    """All 1-, 2- and 3-grams of a text as numbers, and how many letters it has, without marks. 1 marks a word's edge."""
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), sys.maxunicode)
    fold, mark = _fold()
    c = fold[codes]
    letters = int(np.count_nonzero(c)) - int(np.count_nonzero(mark[codes]))
    if not letters:
        return np.empty(0, np.uint64), 0
    c = np.concatenate(([0], c, [0])).astype(np.uint64)
    gap = c == 0
    c = c[~(gap & np.concatenate(([False], gap[:-1])))]  # one mark between words
    c[c == 0] = 1
    two = (c[:-1] << np.uint64(_BITS)) | c[1:]
    three = ((two[:-1] << np.uint64(_BITS)) | c[2:])[c[1:-1] != 1]  # within a word
    return np.concatenate((c[c != 1], two, three)), letters


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


def top(keys: np.ndarray, n: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent keys, most frequent first, ties to the smaller key."""
    if len(keys) > k:
        least = np.partition(n, len(n) - k)[len(n) - k]
        keep = n >= least
        keys, n = keys[keep], n[keep]
    return keys[np.lexsort((keys, -n))][:k]


class Profiles:
    """All languages' n-grams in order; each has the languages whose profile holds it, with its rank there."""

    def __init__(self, ranked: dict[str, list[int]], length: int = PROFILE):
        self.langs, self.length = sorted(ranked), length
        gram = np.array([g for lang in self.langs for g in ranked[lang]], np.uint64)
        lang = np.repeat(np.arange(len(self.langs)), [len(ranked[x]) for x in self.langs])
        rank = np.array([i for x in self.langs for i in range(len(ranked[x]))], np.int64)
        order = np.lexsort((lang, gram))
        self.lang, self.rank = lang[order], rank[order]
        self.keys, self.start = np.unique(gram[order], return_index=True)
        self.many = np.diff(np.append(self.start, len(gram)))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's n-grams, most frequent first, to each language."""
        far = np.full(len(self.langs), self.length * len(own), np.int64)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        place = np.flatnonzero(self.keys[at] == own) if len(self.keys) else np.zeros(0, np.int64)
        at = at[place]
        n = self.many[at]
        entry = np.repeat(self.start[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        apart = np.minimum(np.abs(self.rank[entry] - np.repeat(place, n)), self.length)
        return far - np.bincount(self.lang[entry], weights=self.length - apart, minlength=len(far)).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float, int]:
        keys, letters = grams(text) if text else (np.empty(0, np.uint64), 0)
        if not letters or not self.langs:
            return UND, 0.0, letters
        own = top(*counted(keys), self.length)
        d = self.distances(own)
        j = int(np.argmin(d))
        return self.langs[j], float(1 - d[j] / (self.length * len(own))), letters


def learn(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, length: int = PROFILE) -> Profiles:
    """Profiles from rows (id, text, lang), none of them null in text and lang."""
    text_batches(labelled)
    sizes = labelled.groupBy("lang").agg((F.lit(float(docs_per_lang)) / F.count(F.lit(1))).alias("share"))
    point = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.join(F.broadcast(sizes), "lang").where(point < F.col("share")).select("lang", "text")  # a row per language

    def count(batches):
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, _ = grams(text)
                if len(keys):
                    by.setdefault(lang, []).append(keys)
            for lang, parts in by.items():
                keys, n = counted(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    total = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= length)
    ranked: dict[str, list[int]] = {}
    for r in sorted(first.collect(), key=lambda r: (r["lang"], r["rank"])):  # languages x length rows
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, length)


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """Predict the language of every document from its text, having learned from the rows that aren't ``held_out``."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    profiles = learn(rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("id", "text", "lang"), docs_per_lang)

    def run(batches):
        for batch in batches:
            said = [profiles.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64()), pa.array([s[2] for s in said], pa.int64())], names=["doc_id", "held_out", "lang_pred", "score", "n_letters"])

    return rows.select("id", "held_out", "text").mapInArrow(run, SCHEMA)


def keep_known(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without those that have no language or whose nearest profile is further than ``min_score`` allows; one pass, no shuffle."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    profiles = learn(rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("id", "text", "lang"))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            said = [profiles.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UND and score >= min_score for lang, score, _ in said], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
