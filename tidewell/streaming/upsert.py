"""Incremental loading as a stream: files of JSON points, merged by key into a table as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources.ingest import newest, sane, upsert
from tidewell.sources.versions import Parts, month_part

POINT = T.StructType([T.StructField("period_date", T.DateType()), T.StructField("item_id", T.StringType()), T.StructField("bank_type_code", T.StringType()), T.StructField("currency", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("downloaded_at", T.TimestampType())])
KEYS = ["period_date", "item_id", "bank_type_code", "currency"]


def _parts(spark: SparkSession, target: str) -> Parts:
    return Parts(spark, target, month_part())


def merge_files(spark: SparkSession, source: str, target: str, checkpoint: str, keep: int | None = None) -> None:
    """Reads all new files below source and merges them into target; running again without new files changes nothing.

    A batch reads and writes the months that it has points of, and only those, and publishes them at once with its number,
    so a batch that is run again after a lost driver finds itself done. keep: versions that stay for readers; None: all.
    """

    def merge(batch: DataFrame, number: int) -> None:
        query, parts = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), _parts(spark, target)
        done = parts.manifest()["mark"]
        if done and done[0] == query and number <= done[1]:
            return
        new = newest(sane(batch), KEYS, "downloaded_at").persist()
        try:
            months = parts.names(new)
            if months:
                parts.replace(upsert(parts.read(months), new, KEYS, "downloaded_at"), months, mark=[query, number])
        finally:
            new.unpersist()
        if keep is not None:
            parts.drop_unread(keep)

    lines = spark.readStream.schema("value string").text(source)
    points = lines.select(F.from_json("value", POINT).alias("p")).select("p.*").where("period_date is not null")
    points.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str, months: list[str] | None = None) -> DataFrame:
    """The newest version of all months, or of the named ones; other months' files aren't read."""
    return _parts(spark, target).read(months, schema=POINT)
