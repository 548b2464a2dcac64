"""Session helpers shared by the corpus operators: scratch tables, bounded broadcasts, Arrow limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.sources.shared import scratch_path, shared_dir

#: Rows and bytes that one Arrow batch carries to Python; long texts make a batch of few rows.
ARROW_ROWS, ARROW_BYTES = 4096, 1 << 20
#: Buckets whose totals running_start adds up in one window.
SPAN = 1024


def arrow_limits(spark: SparkSession) -> None:
    """Bound the memory of an Arrow batch by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df doesn't have, whatever the case: names, with underscores behind."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name in taken:
            name += "_"
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that written() and token_files() left below the shared folder: for when no frame that reads
    them is in use any more, in this session or another of the same folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/tidewell")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most most_rows rows; reads no more than it has to."""
    return df.limit(most_rows + 1).count() <= most_rows


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint only for a table whose row count was checked; otherwise a shuffled join that AQE can split."""
    return F.broadcast(df) if small(df, most_rows) else df


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    arrow_limits(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Most bits of a filter, as a power of two: 64 MB in each worker that has it.
MOST_BITS = 29


def sized_bitmap(df: DataFrame, key: str, least: int) -> bytes:
    """as_bitmap with 64 bits for each row of df, a written table, so that one in 64 others passes; 2**least bits at least
    and 2**MOST_BITS at most. Above eight million keys it begins to fill up, and the exact step behind it gets more rows."""
    return as_bitmap(df, key, min(MOST_BITS, max(least, (64 * df.count()).bit_length())))


def as_bitmap(df: DataFrame, key: str, bits: int) -> bytes:
    """A filter of 2**bits bits in which bit (key mod 2**bits) is set for every key of df, a column of longs.

    Its size is fixed by ``bits`` whatever the number of keys: more keys only let more others through, so it may
    stand before an exact join, never in its place. Words of 64 bits are OR-ed on the executors.
    """
    import numpy as np

    place = F.expr(f"{key} & {(1 << bits) - 1}L")
    words = df.select(F.shiftrightunsigned(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast({key} & 63L as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out.tobytes()


def in_bitmap(bitmap, keys):
    """Which of the uint64 keys have their bit set; bitmap: the numpy uint64 view of as_bitmap's bytes."""
    import numpy as np

    at = keys & np.uint64(bitmap.size * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def running_start(df: DataFrame, size: str, out: str, bucket: str, order: list[str], within: list[str] = ()) -> DataFrame:
    """Adds out: the sum of size over all rows before, for each value of within, by (bucket, order).

    Sums run within a bucket, over the totals of ``SPAN`` buckets that follow each other, and over the totals of those, so
    that no task holds all rows, or all buckets, of a value of within. bucket: a number; null values of within and bucket
    are values like others.
    """
    within = list(within)

    def before(totals: DataFrame, by: list[str], last: str, name: str) -> DataFrame:
        w = W.partitionBy(*by).orderBy(last).rowsBetween(W.unboundedPreceding, -1)
        return totals.withColumn(name, F.coalesce(F.sum("_all").over(w), F.lit(0)))

    def joined(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
        named = right.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), value)
        return left.join(named, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]).drop(*(f"_k{i}" for i in range(len(keys))))

    cells = df.groupBy(*within, bucket).agg(F.sum(size).alias("_all")).withColumn("_span", F.floor(F.col(bucket) / SPAN))
    spans = before(cells.groupBy(*within, "_span").agg(F.sum("_all").alias("_all")), within, "_span", "_far")
    cells = joined(before(cells, [*within, "_span"], bucket, "_near"), spans, [*within, "_span"], "_far").withColumn("_base", F.col("_far") + F.col("_near"))
    local = W.partitionBy(*within, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    counted = df.withColumn("_local", F.coalesce(F.sum(size).over(local), F.lit(0)))
    return joined(counted, cells, [*within, bucket], "_base").withColumn(out, F.col("_base") + F.col("_local")).drop("_local", "_base")
