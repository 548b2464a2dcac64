"""Bringing series of different dates together: as-of, calendar fill, spreads, month-end lookups, first-of-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof(left: DataFrame, right: DataFrame, on: str, value: str, by: list[str] = (), out: str = "asof", skip_null: bool = False) -> DataFrame:
    """Every left row with the value of the last right row at or before its date; a null value counts unless skipped.

    One union and no range join. Rows are cut by month: each month's last quote is carried over a table of months, so a
    window only spans a month of a series, and a long series isn't one task. Right rows come before left ones of the same
    date.
    """
    by = list(by)
    tagged = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    quotes = right.select(*by, on, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    counts = (F.col("_side") == 0) & F.col("_v").isNotNull() if skip_null else F.col("_side") == 0
    both = tagged.unionByName(quotes, allowMissingColumns=True)
    both = both.withColumns({"_mark": F.when(counts, F.struct(F.col("_v").alias("v"))), "_month": F.trunc(F.col(on).cast("date"), "month")})
    months = both.groupBy(*by, "_month").agg(F.max_by("_mark", F.when(counts, F.col(on))).alias("_last"))
    before = W.partitionBy(*by).orderBy("_month").rowsBetween(W.unboundedPreceding, -1)
    months = months.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_month"])), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    w = W.partitionBy(*by, "_month").orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("_m", F.last("_mark", ignorenulls=True).over(w)).where("_side = 1")
    both = both.join(months, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_month"])], "left")
    return both.withColumn(out, F.coalesce("_m", "_carried")["v"]).drop("_side", "_v", "_m", "_mark", "_month", "_carried", *(f"_k{i}" for i in range(len(by) + 1)))


def fill_daily(df: DataFrame, start: str, end: str, by: list[str], date: str = "date", value: str = "value") -> DataFrame:
    """A row for every day from start to end with the last value at or before it inside that range; days before the first
    value are left out, the first of repeated dates holds, nulls are skipped."""
    inside = df.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    first = keep_first(inside.withColumn("_o", F.monotonically_increasing_id()), [*by, date], ["_o"]).where(F.col(value).isNotNull()).select(*by, date, value)
    days = first.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(date))
    w = W.partitionBy(*by).orderBy(date).rowsBetween(W.unboundedPreceding, 0)
    return days.join(first, [*by, date], "left").withColumn(value, F.last(value, ignorenulls=True).over(w)).where(F.col(value).isNotNull())


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def spread(a: DataFrame, b: DataFrame, on: list[str], value: str = "value", out: str = "spread") -> DataFrame:
    """a - b where both have a row."""
    return a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on).select(*on, (F.col("_a") - F.col("_b")).alias(out))


def spread_of(df: DataFrame, name: str, a: str, b: str, on: list[str], value: str = "value", out: str = "spread") -> DataFrame:
    """As spread, for two named series of one long table: one scan and one aggregation. A series with repeated rows for a
    key counts with its largest value."""
    of = lambda n: F.max(F.when(F.col(name) == n, F.col(value)))
    wide = df.where(F.col(name).isin(a, b)).groupBy(*on).agg(of(a).alias("_a"), of(b).alias("_b"))
    return wide.where("_a is not null and _b is not null").select(*on, (F.col("_a") - F.col("_b")).alias(out))


def month_end(df: DataFrame, date: str = "date", value: str = "value", out: str = "rate") -> DataFrame:
    """The last value of each month that isn't null."""
    return df.where(F.col(value).isNotNull()).groupBy(F.trunc(F.col(date).cast("date"), "month").alias("period")).agg(F.max_by(value, date).alias(out))


def stitched(parts: list[DataFrame], date: str = "date", keys: list[str] = ()) -> DataFrame:
    """Parts put together by name, of repeated dates the row of the first part, in date order."""
    whole = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        whole = p if whole is None else whole.unionByName(p, allowMissingColumns=True)
    return keep_first(whole, [*keys, date], ["_part"]).drop("_part").orderBy(date)


def labelled(series: dict[str, DataFrame]) -> DataFrame:
    """Named series as one long table with a label column, for one plan instead of one per series."""
    out = None
    for label, df in series.items():
        df = df.withColumn("label", F.lit(label))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
