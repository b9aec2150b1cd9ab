"""The change feed: micro-batches of paths into an incremental step, stateful diffs, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.tables import fresh_path

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def watch(spark: SparkSession, folder: str, schema: str, step: Callable[[DataFrame, int], None], checkpoint: str | None = None, files_per_batch: int = 500, once: bool = True, every: str = "2 seconds") -> StreamingQuery:
    """Runs ``step`` on each micro-batch of change rows, one for each path.

    A batch takes at most ``files_per_batch`` files; what is over waits for the next one instead of being dropped.
    """
    changes = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        step(df.dropDuplicates(["path"]), number)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or fresh_path(spark, "watch"))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def stateful_diff(listing: DataFrame) -> DataFrame:
    """T4: (path, status) A, M or D of a stream of (path, hash); a null hash says that the file is gone.

    Of every path the hash with the greatest ``seq`` seen so far is state, so rows that come late or in another order
    change nothing; a file that is gone keeps its ``seq``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        old, known = state.get if state.exists else (None, None)
        new, latest = old, known
        for pdf in frames:
            row = pdf.loc[pdf["seq"].idxmax()]
            if latest is None or row["seq"] > latest:
                new, latest = row["hash"], int(row["seq"])
        new = None if new is None or new != new else new
        if latest != known:
            state.update((new, latest))
        status = None if old == new else "A" if old is None else "D" if new is None else "M"
        yield pd.DataFrame({"path": [key[0]] if status else [], "status": [status] if status else []})

    return listing.groupBy("path").applyInPandasWithState(step, "path string, status string", "hash string, seq bigint", "update", "NoTimeout")


def windowed_counts(spark: SparkSession, path: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total) of an event stream, read until its input is used up.

    A watermark bounds the state. Each micro-batch appends the windows it changed; a window's last row counts.
    """
    folder, name = path.rsplit("/", 1)
    events = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).parquet(folder)
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = fresh_path(spark, "windows")

    def keep(df: DataFrame, number: int) -> None:
        df.select(F.col("w.start").alias("window_start"), "event_type", "n", "total").withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    query = counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("window_start timestamp, event_type string, n bigint, total double, batch int").parquet(out)
    return rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r")).select("window_start", "event_type", "r.n", "r.total")
