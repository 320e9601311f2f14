"""Streaming forms of the order-bound operators: bounded lateness is a watermark, the active set is keyed state.

Each takes a streaming or a static DataFrame; all state is bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binned_counts(events: DataFrame, ts: str, width: str, lateness: str, *keys: str) -> DataFrame:
    """Fixed bins: rows and summed value per bin; later rows than ``lateness`` are dropped."""
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding_counts(events: DataFrame, ts: str, width: str, slide: str, lateness: str, *keys: str) -> DataFrame:
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, width, slide), *keys).agg(F.count(F.lit(1)).alias("n"))


def merged_runs(events: DataFrame, ts: str, gap: str, lateness: str, *keys: str) -> DataFrame:
    """Runs whose neighbours are no more than ``gap`` apart, the streaming form of coalesced intervals."""
    return events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), *keys).agg(F.count(F.lit(1)).alias("n"))


def nearby(left: DataFrame, right: DataFrame, on: Column, left_ts: str, right_ts: str, before: str, after: str, lateness: str) -> DataFrame:
    """Stream-stream interval join: right rows from ``before`` ahead of a left row to ``after`` behind it."""
    a, b = left.withWatermark(left_ts, lateness), right.withWatermark(right_ts, lateness)
    return a.join(b, on & F.expr(f"{right_ts} >= {left_ts} - interval {before}") & F.expr(f"{right_ts} <= {left_ts} + interval {after}"))


def late_rows(events: DataFrame, ts: str, lateness_s: int) -> DataFrame:
    """Static check of a recorded stream: rows later than ``lateness_s`` behind the latest before them in arrival order (``seq``), within each key."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("_m", F.max(ts).over(w)).where(F.col("_m").isNotNull() & (F.unix_timestamp(ts) < F.unix_timestamp("_m") - lateness_s)).drop("_m")


def throttled(events: DataFrame, key: str, ts: str, window_s: int, most: int, lateness: str) -> DataFrame:
    """Rows of each key while no more than ``most`` were let through in the trailing window: keyed state holds the last ``most`` times.

    The state is dropped when the watermark passes the window.
    """

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sent = list(state.get[0]) if state.exists else []
        for pdf in batches:
            keep = []
            for t in pdf[ts].sort_values().items():
                at = t[1].value // 1_000_000_000
                sent = [x for x in sent if x > at - window_s]
                if len(sent) < most:
                    sent.append(at)
                    keep.append(t[0])
            if keep:
                yield pdf.loc[keep]
        state.update((sent,))
        if sent:
            state.setTimeoutTimestamp(max(int((max(sent) + window_s) * 1000), state.getCurrentWatermarkMs() + 1))

    return events.withWatermark(ts, lateness).groupBy(key).applyInPandasWithState(run, events.schema, "sent array<long>", "append", "EventTimeTimeout")


def run_to_memory(df: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end and return what it wrote to the memory sink: for tests."""
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def run_to_parquet(df: DataFrame, path: str, folder: str) -> None:
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", folder).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)


def read_limited(spark, path: str, schema, files: int, pattern: str = "*.parquet") -> DataFrame:
    """A stream of Parquet files that takes no more than ``files`` of them in a batch, however many wait."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(path)


def fan_out(events: DataFrame, routes: dict[str, Column], path: str, folder: str) -> None:
    """Run a bounded stream into several tables at once: each batch is read once, kept, and written to each route that its rows match.

    A batch overwrites its own part of a table, so that a batch which is run again after a failure adds nothing twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, wanted in routes.items():
                kept.where(wanted).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            kept.unpersist()

    events.writeStream.foreachBatch(write).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination(300)
