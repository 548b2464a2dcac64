"""Windows over a stream with late rows: closed windows are written once, state behind the watermark is dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
#: How times stand in the files.
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def tumbling(events: DataFrame, every: str = "1 day", late: str = "1 hour", by: tuple[str, ...] = ("event_type",), ts: str = "ts") -> DataFrame:
    """start, end, by..., n, total for each window, for streams and tables alike. On a stream a window is final when the
    watermark, the latest time of the batches before less ``late``, passes its end; it is written then, its state goes,
    and rows of it in later batches are dropped."""
    got = events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", by: tuple[str, ...] = ("user_id",), ts: str = "ts") -> DataFrame:
    """start, end, by..., n, total for each session: rows of by that follow each other within less than ``gap``; end is
    the last row's time plus gap. A session is final when the watermark passes its end."""
    got = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def closed_windows(spark: SparkSession, source: str, out: str, checkpoint: str, windows: Callable[[DataFrame], DataFrame] = tumbling, schema: T.StructType = EVENT, files_a_batch: int = 1) -> None:
    """Reads all new JSON files below source, in the order of their times, and appends the windows that have become final
    to the Parquet table out. Windows that are still open stay in the state below checkpoint until a later run.

    A file sink with a checkpoint writes each window once, whatever is run again.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("timestampFormat", TIME).json(source)
    windows(rows).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
