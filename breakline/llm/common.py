"""What the operators of this subpackage share: where intermediate tables go, and how texts are dealt into blocks.

Nothing here runs at import time and nothing outside ``llm`` imports it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Raw text bytes that one block holds, about. A block is what one Python call sees at once.
BLOCK_BYTES = 8 << 20
#: Small inputs are still dealt into this many blocks, so that all executors have work.
LEAST_BLOCKS = 64
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20
#: Rows that a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000

_OWN_FOLDER: list[str] = []


class Apart:
    """A caller's table under names of our own (c0, c1, ...), so that no column of it can clash with one that an operator adds.

    ``back`` gives the caller's names again, whatever they are: with other cases, dots or underscores.
    """

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.df = docs.toDF(*self.own)

    @property
    def own(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.names))]

    def name(self, column: str) -> str:
        """Our name of the caller's ``column``: of the one spelt so, else of the only one that differs in case."""
        at = [i for i, n in enumerate(self.names) if n == column] or [i for i, n in enumerate(self.names) if n.lower() == column.lower()]
        if len(at) != 1:
            raise ValueError(f"{len(at)} columns are named {column!r}: {self.names}")
        return f"c{at[0]}"

    def col(self, column: str) -> Column:
        return F.col(self.name(column))

    def free(self, *wanted: str) -> list[str]:
        """The wanted names for added columns, with more underscores in front where the caller has such a column."""
        taken, out = {n.lower() for n in self.names}, []
        for n in wanted:
            while n.lower() in taken:
                n = f"_{n}"
            taken.add(n.lower())
            out.append(n)
        return out

    def back(self, df: DataFrame, *added: str) -> DataFrame:
        """The caller's columns under their names, then the ``added`` ones."""
        return df.select(*self.own, *added).toDF(*self.names, *self.free(*added))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; one of our own only where it is unset and all runs on one machine."""
    if told := spark.conf.get("spark.checkpoint.dir", None):
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="breakline-"))
    return _OWN_FOLDER[0]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/breakline-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(df: DataFrame) -> None:
    """Texts go to Python in Arrow batches of a few MB: JVM, Arrow and Python each hold a batch of every task at once.

    A setting of the session, as batches are cut when the plan runs; a smaller one that is set already stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    told = (conf.get(name) or "").rstrip("b")
    if not told.isdigit() or int(told) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def block_count(n_bytes: int, block_bytes: int = BLOCK_BYTES) -> int:
    return max(LEAST_BLOCKS, -(-n_bytes // block_bytes))


def block_of(id_col: Column, text_col: Column, blocks: int) -> Column:
    """The block of a document: by its id, or by its text where the id is null, so that null ids don't gather in one block."""
    return F.pmod(F.xxhash64(F.coalesce(id_col.cast("string"), F.xxhash64(text_col).cast("string"))), F.lit(blocks)).cast("int")


def small_or_not(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if the counted ``rows`` allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def crc_mod(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, mod ``mod``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))
