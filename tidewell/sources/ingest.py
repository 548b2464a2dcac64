"""Idempotent loading: last write wins by key, range checks, what is missing, request plans, retried fetches."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.expr import in_range

# Entity codes of the weekly source and the codes that they mean.
WEEKLY_CODES = {"10001": "10001", "10002": "10002", "10003": "10007", "10004": "10006", "10005": "10009", "10006": "10010", "10007": "10008", "10008": "10004", "10009": "10005", "10010": "10003"}


def newest(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row per key, the latest by ``at``: an aggregation with partial results, so a hot key is cheap."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("r"))
    return got.select(*(c if c in keys else F.col(f"r.{c}").alias(c) for c in df.columns))


def upsert(target: DataFrame | None, batch: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The target after the batch; applying a batch twice is as once."""
    return newest(batch if target is None else target.unionByName(batch), keys, at)


def sane(df: DataFrame, value: str = "value", limit: float = 1e10) -> DataFrame:
    return df.where(in_range(value, limit))


def recoded(df: DataFrame, code: str = "bank_type_code") -> DataFrame:
    """Weekly codes as monthly ones; unknown codes stay."""
    m = F.create_map(*(F.lit(x) for kv in WEEKLY_CODES.items() for x in kv))
    return df.withColumn(code, F.coalesce(F.try_element_at(m, F.col(code)), code))


def missing_months(have: DataFrame, first: str, last: str, period: str = "period") -> DataFrame:
    """Months from first to last that ``have`` lacks."""
    spark = have.sparkSession
    all_months = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 1 month"))).alias(period))
    return all_months.join(have.select(period).distinct(), period, "left_anti")


def violations(df: DataFrame, value: str = "value", limit: float = 1e10) -> DataFrame:
    """rows, dropped: how many rows sane() sees and leaves out; beside the load, in one aggregation."""
    return df.agg(F.count("*").alias("rows"), F.count_if(~in_range(value, limit)).alias("dropped"))


def anchors(last: str, oldest: str, step_weeks: int = 13) -> Column:
    """Dates to request windows at, going back from the last one, as an array."""
    return F.sequence(F.col(last), F.col(oldest), F.expr(f"interval -{7 * step_weeks} day"))


def weekly_anchors(last: date, oldest: date, step_weeks: int = 13) -> list[date]:
    """Dates to request windows at, going back from the last one."""
    out = []
    while last >= oldest:
        out.append(last)
        last -= timedelta(weeks=step_weeks)
    return out


def windows(start: date, end: date, most_days: int = 3 * 365) -> list[tuple[date, date]]:
    """A range in parts of at most most_days."""
    out = []
    while start <= end:
        stop = min(end, start + timedelta(days=most_days - 1))
        out.append((start, stop))
        start = stop + timedelta(days=1)
    return out


def fetched(get: Callable[[], bytes], tries: int = 5, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A JSON answer, tried again after passing faults (OSError) with doubled waits."""
    for i in range(tries):
        try:
            return json.loads(get())
        except OSError:
            if i == tries - 1:
                raise
            sleep(wait * 2**i)
    raise ValueError("tries must be positive")


def append_log(df: DataFrame, path: str) -> None:
    """Adds rows to a log: a table that is only ever appended to, a file a call."""
    df.coalesce(1).write.mode("append").parquet(path)


def compacted(df: DataFrame, path: str, by: list[str], rows_per_file: int = 5_000_000) -> None:
    """Rewrites a table in files of bounded size, dealt by its keys."""
    df.repartition(*by).sortWithinPartitions(*by).write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)
