"""Structured Streaming forms: files as they arrive, late rows, windows, sessions and running state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: Ty.StructType | str, files_per_trigger: int = 100, format: str = "parquet") -> DataFrame:
    """Files of path as they arrive, a bounded number for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(format).load(path)


def timed(stream: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """stream with ts as an instant and a watermark on it; rows later than that may be dropped by stateful steps."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def window_counts(stream: DataFrame, key: str, ts: str = "ts", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, key, n): rows in each window of event time."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def sessions(stream: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """(key, session_start, session_end, n): runs of rows of a key with no gap as long as `gap`."""
    s = stream.groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def without_repeats(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First arrivals only, as far back as the watermark reaches."""
    return stream.dropDuplicatesWithinWatermark(keys)


def running_state(stream: DataFrame, key: str, state: str, ts: str = "ts") -> DataFrame:
    """(key, state, since): the latest state of each key; for update or complete mode."""
    latest = F.max(F.struct(F.col(ts), F.col(state))).alias("l")
    return stream.groupBy(key).agg(latest).select(key, F.col(f"l.{state}").alias(state), F.col(f"l.{ts}").alias("since"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, write it to path as Parquet, and stop; a later run goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).format("parquet").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def per_batch(stream: DataFrame, checkpoint: str, use, errors) -> StreamingQuery:
    """use(batch, batch_id) for every micro-batch; one that fails goes to errors(batch_id, error), and the stream goes on."""

    def step(batch: DataFrame, batch_id: int) -> None:
        try:
            use(batch, batch_id)
        except Exception as error:  # noqa: BLE001 - a bad batch must not end the stream
            errors(batch_id, error)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
