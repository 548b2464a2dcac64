"""Update runs: fetched answers merged into stored fact tables, month by month."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources import requests, writers
from tidewell.sources.ingest import compacted, newest, sane, upsert, weekly_anchors
from tidewell.sources.readers import weekly_points
from tidewell.sources.versions import Parts, month_part, year_month_part

WEEKLY_KEYS = ["period_date", "item_id", "bank_type_code", "currency"]


def parts_of(spark: SparkSession, folder: str, table: str) -> Parts:
    """A fact table below folder: its parts are months."""
    return Parts(spark, f"{folder.rstrip('/')}/{table}", month_part() if table == "weekly_series" else year_month_part())


def stored(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """A table's newest version, None if it has none."""
    return parts_of(spark, folder, table).read()


def merge_monthly(answers: DataFrame, folder: str, at: datetime) -> dict[str, list[str]]:
    """Merges fetched monthly answers into the fact tables below folder: table -> months written, for tables that have
    answers. Only those months are read and written; loading the same answers again changes nothing.

    Write the answers first: they are read once for their months and once for each table that has some.
    """
    spark, good = answers.sparkSession, answers.where(F.col("error").isNull())
    asked = good.select("table_number", "year", "month").distinct().collect()  # a row for each month and table number
    number_of = {n: table for table, numbers in writers.TABLES.items() for n in numbers}
    months: dict[str, set[str]] = {}
    for r in asked:
        months.setdefault(number_of.get(r["table_number"], "other_data"), set()).add(f"{r['year']:04d}-{r['month']:02d}")
    written = {}
    for table, batch in writers.routed(good).items():
        if table in months:
            parts = parts_of(spark, folder, table)
            old = parts.read(months[table])
            written[table] = parts.replace(writers.merged(old, batch.withColumn("downloaded_at", F.lit(at)), table, "downloaded_at"), months[table])
    return written


def weekly_rows(answers: DataFrame) -> DataFrame:
    """Weekly answers as points of the weekly table, those in range."""
    return sane(weekly_points(answers.where(F.col("error").isNull()).select("item_id", "category", "bank_type_code", "currency", "response_json")))


def merge_weekly(answers: DataFrame, folder: str, at: datetime) -> list[str]:
    """Merges weekly answers into weekly_series; the months written. Other months are neither read nor written."""
    parts = parts_of(answers.sparkSession, folder, "weekly_series")
    batch = parts.held(newest(weekly_rows(answers).withColumn("downloaded_at", F.lit(at)), WEEKLY_KEYS, "downloaded_at"))
    months = parts.names(batch)
    return parts.replace(upsert(parts.read(months), batch, WEEKLY_KEYS, "downloaded_at"), months) if months else []


def weekly_update(have: DataFrame | None, today: date, url: str, items: list[tuple[str, str]], tasks: int, get=requests.opened, spark: SparkSession | None = None, first: str = "2020-01-01") -> DataFrame:
    """Raw answers for the windows of 13 weeks from the latest stored week (period_date), or from first, to today."""
    last = have.agg(F.max("period_date").alias("d")).first()["d"] if have is not None else None
    anchors = weekly_anchors(today, last or date.fromisoformat(first))
    session = have.sparkSession if have is not None else spark
    plan = requests.weekly_plan(session.createDataFrame([(a,) for a in anchors], "anchor date"), items, url)
    return requests.fetched_plan(plan, tasks, get)


def snapshot(spark: SparkSession, folder: str, out: str, tables: list[str]) -> None:
    """The newest versions, in files of bounded size, dealt by year and month or by week."""
    for table in tables:
        df = stored(spark, folder, table)
        if df is not None:
            compacted(df, f"{out.rstrip('/')}/{table}", ["period_date"] if "period_date" in df.columns else ["year", "month"])
