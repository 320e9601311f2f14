"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words. Tokens are summed per source; the sources by code point, null last, weigh 5, 2, 1, 5, 2, 1, ...; together
they get ``share`` of all words. A target stops at ``most`` times its source's size and what is over goes to the others by
weight until none is above, which is the level L that solves  sum of min(most * size, L * weight) = total. Then
rate = target / size, and a document is taken floor(rate) times plus once more with probability rate - floor(rate), decided
by a hash of seed and id, so that reruns agree.

Independent draws of few or very unequal documents miss the target by chance, so the draws are conditioned on their sum: the hash is cut
into ``BINS`` equal steps, words are summed per source and step, and the steps are taken whole as long as their words fit into what the fraction asks
for. In the step that no longer fits, a document is drawn with the probability of that step's missing words (Bernoulli, by the rest of its
hash). The expected words are therefore those that the fraction asks for, as with plain draws, and only one step's documents are left to chance;
each document is still decided alone, by its hash and one threshold of its source, which nears the fraction as documents grow in number.

Each source's size comes from partial sums, so a source that holds a third of all rows costs one row per task. The table of
sources is broadcast only if it is counted to be small; otherwise it is joined by shuffle, where adaptive execution splits
a hot source.

Defined results: null text has size 0; a null source is a source; a source without words has target 0 and takes nothing; a null id
hashes as empty text; repeated rows get the same decision; other columns are kept as they are, whatever their names (where the caller has a ``_mix``,
the added one has one more underscore); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Apart

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words.
SHARE = 1.5
#: A source's target is at most this many times its size.
MOST = 2
SEED = "mix-1"
#: Steps of the hash at which a source's threshold can lie.
BINS = 1024
#: Bits of the hash that the decision uses.
_BITS = 52
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text: the places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from seed and id, the same in every engine that has md5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long") / F.lit(float(1 << _BITS))


def hash_bin(point: Column) -> Column:
    """The step of a ``unit_hash``."""
    return F.floor(point * F.lit(float(BINS))).cast("int")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, bin, size) per document to (source, source_size, target, times, threshold) per source.

    Documents are summed per source and bin before anything else; the windows run over ``BINS`` rows per source, or over one.
    """
    steps = sizes.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    per = steps.groupBy("source").agg(F.sum("words").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # the sources that reach their cap are first by cap / weight. The level is tried after each of them; it is the first,
    # and so the largest, that the next source's cap allows
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    after = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(share)
    per = per.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every))
    per = per.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    per = per.withColumn("times", F.floor(rate).cast("int")).withColumn("need", F.col("target") - F.col("times") * F.col("source_size"))
    # the first step whose words no longer fit, with the words below it; none if all fit, and then the threshold is 1
    w = Window.partitionBy("source").orderBy("bin")
    below = steps.select(F.col("source").alias("s"), "bin", "words", (F.sum("words").over(w) - F.col("words")).alias("sum")).where("words > 0")
    over = per.join(below, F.col("source").eqNullSafe(F.col("s")) & (F.col("sum") + F.col("words") > F.col("need")))
    first = over.groupBy("source").agg(F.min(F.struct("bin", "words", "sum")).alias("f")).withColumnRenamed("source", "s")
    got = per.join(first, F.col("source").eqNullSafe(F.col("s")), "left")
    part = F.least(F.greatest((F.col("need") - F.col("f.sum")) / F.col("f.words"), F.lit(0.0)), F.lit(1.0))
    return got.select("source", "source_size", "target", "times", F.coalesce((F.col("f.bin") + part) / F.lit(float(BINS)), F.lit(1.0)).alias("threshold"))


def mix_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """``docs`` with struct ``_mix`` (size, source_size, target, copies)."""
    own = Apart(docs)
    return own.back(_decided(own, id_col, text_col, source_col, weights, share, most, seed), "_mix")


def _decided(own: Apart, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    source, size, point = own.col(source_col), size_of(own.col(text_col)), unit_hash(own.col(id_col), seed)
    sizes = own.df.select(source.alias("source"), hash_bin(point).alias("bin"), size.alias("size"))
    per = source_targets(sizes, weights, share, most)
    n_sources = own.df.agg(F.count_distinct(F.coalesce(F.concat(F.lit("s"), source), F.lit("")))).first()[0]
    if n_sources <= BROADCAST_ROWS:
        per = F.broadcast(per)
    copies = F.col("times") + F.when(point < F.col("threshold"), 1).otherwise(0)
    joined = own.df.withColumn("size", size).join(per, source.eqNullSafe(F.col("source")), "left")
    return joined.withColumn("_mix", F.struct("size", "source_size", "target", copies.cast("int").alias("copies")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    own = Apart(docs)
    taken = _decided(own, **options).where(F.col("_mix.copies") > 0)
    return own.back(taken.select(*own.own, F.explode(F.sequence(F.lit(1), F.col("_mix.copies")))))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    slim = docs.select(F.col("doc_id"), F.col("text"), F.col("source"))
    return mix_decisions(slim, **options).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_mix.size").alias("size"), F.col("_mix.source_size").cast("long").alias("source_size"), F.col("_mix.target").cast("double").alias("target"), (F.col("_mix.copies") * F.col("_mix.size")).cast("long").alias("taken"))


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS point FROM documents
), binned AS (
  SELECT *, CAST(floor(point * 1024.0::DOUBLE) AS INTEGER) AS bin FROM sized
), steps AS (
  SELECT source, bin, CAST(sum(size) AS BIGINT) AS words FROM binned GROUP BY source, bin
), per AS (
  SELECT source, CAST(sum(words) AS BIGINT) AS source_size FROM steps GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM per
), tried AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_level FROM weighed
), levels AS (
  SELECT max(CASE WHEN at_level <= cap / weight THEN at_level END) AS level FROM tried
), targets AS (
  SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM weighed, levels
), rated AS (
  SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END) AS INTEGER) AS times FROM targets
), below AS (
  SELECT source, bin, words, sum(words) OVER (PARTITION BY source ORDER BY bin) - words AS before FROM steps
), crossing AS (
  SELECT r.source, b.bin, b.words, b.before, row_number() OVER (PARTITION BY r.source ORDER BY b.bin) AS k
  FROM rated r JOIN below b ON r.source IS NOT DISTINCT FROM b.source WHERE b.words > 0 AND b.before + b.words > r.target - r.times * r.source_size
), chosen AS (
  SELECT r.source, r.source_size, r.target, r.times,
         coalesce((c.bin + least(greatest((r.target - r.times * r.source_size - c.before) / c.words::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)) / 1024.0::DOUBLE, 1.0::DOUBLE) AS threshold
  FROM rated r LEFT JOIN crossing c ON r.source IS NOT DISTINCT FROM c.source AND c.k = 1
)
SELECT s.doc_id, s.size, c.source_size, c.target, CAST((c.times + CASE WHEN s.point < c.threshold THEN 1 ELSE 0 END) * s.size AS BIGINT) AS taken
FROM sized s JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source
"""
