"""Sharding by extendible hashing.

Each document hashes to a row of bits. A bucket is a prefix of bits. Starting from one bucket, only buckets whose bytes exceed
the limit split on one more bit, until every shard fits or holds a single document. The directory is a table of hash
ranges; a document finds its shard by the slot that the first bits of its hash select and the range within that slot.

Bytes are summed per prefix before anything is shuffled, so no bucket's documents are ever gathered. The splitting goes
down ``_STEP`` bits at a time and looks only at what is still too large.

Rows with the same id and text have the same bits and no further bit parts them. Where such rows exceed the limit together, their
bucket is cut by their number. They are numbered within the parts that the scan reads, after the counts of the parts before, so that no
task holds them all.

Defined results: null text has 0 bytes; a null id hashes as empty text; a single document over the limit is alone in its shard
(``oversize`` true); an empty table gives an empty table; other columns are kept, whatever their names (where the caller has a
``_shard``, the added one has one more underscore).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Apart, materialise, small_or_not

#: Bytes of text that a shard may hold.
SHARD_BYTES = 16 << 20
#: Bits of the hash; the deepest directory.
BITS = 60
_STEP = 12


def hash_bits(id_col, text_col):
    """60 bits from id and text, the same in every engine that has md5."""
    key = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text_col, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def leaves(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (h, n_bytes) to the buckets that end up as shards: depth, prefix, shard_bytes, n_docs."""
    sums = (F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    done, top, work = None, 0, rows
    while True:
        bottom = min(top + _STEP, BITS)
        low = materialise(work.groupBy(F.shiftright("h", BITS - bottom).alias("p")).agg(*sums), f"bits-{bottom}")
        # every prefix on the way down, from the sums at the bottom; an ancestor above the limit has split
        level = low.select("b", "n", F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("depth"), "p").withColumn("prefix", F.expr(f"shiftright(p, {bottom} - depth)"))
        level = level.groupBy("depth", "prefix").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        fits = (F.col("b") <= limit) | (F.col("n") == 1) | (F.col("depth") == BITS)
        own = low.select("p", F.explode(F.sequence(F.lit(top), F.lit(bottom))).alias("depth")).withColumn("prefix", F.expr(f"shiftright(p, {bottom} - depth)"))
        leaf = own.join(level.where(fits), ["depth", "prefix"]).groupBy("p").agg(F.min(F.struct("depth", "prefix", "b", "n")).alias("leaf"))
        found = leaf.select("leaf.depth", "leaf.prefix", F.col("leaf.b").alias("shard_bytes"), F.col("leaf.n").alias("n_docs")).distinct()
        done = found if done is None else done.unionByName(found)
        over = low.where((F.col("b") > limit) & (F.col("n") > 1)).select("p")
        if bottom == BITS or over.isEmpty():
            return materialise(done, "directory")
        n_over = over.count()
        work = work.join(small_or_not(over, n_over), F.shiftright("h", BITS - bottom) == F.col("p"), "left_semi")
        top = bottom + 1


def assign_shards(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with struct ``_shard``: id (its bits, then ``.k`` for the cuts of equal rows), depth, shard_bytes, n_bytes, oversize."""
    own = Apart(docs)
    keyed = own.df.withColumns({"h": hash_bits(own.col(id_col), own.col(text_col)), "b": F.coalesce(F.octet_length(own.col(text_col)), F.lit(0)).cast("long")})
    rows = materialise(keyed.select("h", F.col("b").alias("n_bytes")), "sizes")
    directory = leaves(rows, limit)
    n, deepest = directory.agg(F.count(F.lit(1)), F.max("depth")).first()
    slot_bits = min(max((n or 1) - 1, 1).bit_length(), deepest or 0)
    spread = directory.select("depth", "prefix", "shard_bytes", "n_docs", F.expr(f"shiftleft(prefix, {BITS} - depth)").alias("lo"), F.expr(f"shiftleft(prefix + 1, {BITS} - depth) - 1").alias("hi"))
    # a bucket above the slots' depth is in several slots, one below it shares its slot
    spread = spread.withColumn("slot", F.explode(F.sequence(F.expr(f"shiftright(lo, {BITS - slot_bits})"), F.expr(f"shiftright(hi, {BITS - slot_bits})"))))
    n_slots = spread.count()
    found = keyed.join(small_or_not(spread, n_slots), (F.expr(f"shiftright(h, {BITS - slot_bits})") == F.col("slot")) & F.col("h").between(F.col("lo"), F.col("hi")), "left")
    name = F.concat(F.lit("b"), F.when(F.col("depth") > 0, F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0"))).otherwise(F.lit("")))
    packed = lambda name, inside: F.struct(name.alias("id"), F.col("depth").cast("int").alias("depth"), inside.cast("long").alias("shard_bytes"), F.col("b").alias("n_bytes"), (F.col("b") > limit).alias("oversize"))
    whole = found.withColumn("_shard", packed(name, F.col("shard_bytes")))
    if directory.where((F.col("depth") == BITS) & (F.col("shard_bytes") > limit) & (F.col("n_docs") > 1)).isEmpty():
        return own.back(whole, "_shard")
    # rows that no bit parts: as many to a cut as fit; each row of such a bucket has the same bytes
    is_equal = F.coalesce((F.col("depth") == BITS) & (F.col("shard_bytes") > limit) & (F.col("n_docs") > 1), F.lit(False))
    each = F.greatest(F.floor(F.lit(limit) / F.greatest(F.col("b"), F.lit(1))), F.lit(1))
    cuts = numbered(found.where(is_equal)).withColumn("part", F.floor(F.col("nth") / each))
    inside = F.least(each, F.col("n_docs") - F.col("part") * each) * F.col("b")
    cuts = cuts.withColumn("_shard", packed(F.concat(name, F.lit("."), F.col("part").cast("string")), inside))
    return own.back(whole.where(~is_equal).select(*own.own, "_shard").unionByName(cuts.select(*own.own, "_shard")), "_shard")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``nth``, from 0 within each ``h``, however many rows one has: numbers within a written part, after the counts of the parts before."""
    rows = materialise(rows.withColumns({"part_no": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "equal-rows")
    per = rows.groupBy("h", "part_no").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("h").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1))
    start = per.select("h", "part_no", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("h", "part_no").orderBy("at")) - 1
    return rows.withColumn("inside", inside).join(start, ["h", "part_no"]).withColumn("nth", F.col("inside") + F.col("start"))


def shard_report(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Per document: doc_id, shard, shard_depth, n_bytes, shard_bytes, oversize."""
    got = assign_shards(docs.select("doc_id", "text"), limit)
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_shard.id").alias("shard"), F.col("_shard.depth").alias("shard_depth"), F.col("_shard.n_bytes").alias("n_bytes"), F.col("_shard.shard_bytes").alias("shard_bytes"), F.col("_shard.oversize").alias("oversize"))


ORACLE_SQL = f"""
WITH k AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h,
         CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents
), d AS (
  SELECT doc_id, h, n_bytes, CAST(depth AS INTEGER) AS depth, h >> CAST({BITS} - depth AS BIGINT) AS prefix FROM k, range(0, {BITS} + 1) AS r(depth)
), node AS (
  SELECT depth, prefix, CAST(sum(n_bytes) AS BIGINT) AS b, count(*) AS n FROM d GROUP BY 1, 2
), fit AS (
  SELECT d.doc_id, d.h, d.n_bytes, d.depth, d.prefix, node.b FROM d JOIN node USING (depth, prefix) WHERE node.b <= {SHARD_BYTES} OR node.n = 1 OR depth = {BITS}
), first AS (
  SELECT doc_id, h, min(depth) AS depth FROM fit GROUP BY 1, 2
)
SELECT fit.doc_id, 'b' || CASE WHEN fit.depth > 0 THEN lpad(bin(fit.prefix), fit.depth, '0') ELSE '' END AS shard, fit.depth AS shard_depth, fit.n_bytes, fit.b AS shard_bytes,
       fit.n_bytes > {SHARD_BYTES} AS oversize
FROM fit JOIN first ON fit.h = first.h AND fit.doc_id IS NOT DISTINCT FROM first.doc_id AND fit.depth = first.depth
"""
