"""Files to typed frames: bulletin CSVs, cached series, source JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.expr import first_truthy, ratio_category

# Month names of the bulletins' long dates.
MONTHS = ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık")


def long_date(c: Column) -> Column:
    """'16 Ocak 2026' -> date; other texts are null."""
    part = F.split(F.trim(c), " +")
    number = F.try_element_at(F.create_map(*(F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1))), F.get(part, F.lit(1)))
    return F.try_to_date(F.concat_ws("-", F.get(part, F.lit(2)), F.lpad(number.cast("string"), 2, "0"), F.lpad(F.get(part, F.lit(0)), 2, "0")), "yyyy-MM-dd")


def bulletin_csv(spark: SparkSession, path: str) -> DataFrame:
    """Weekly bulletin files of all header versions: a missing date_str column is null; a BOM is dropped."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    kinds = {"row_id": "int", "item_name": "string", "tp_value": "double", "yp_value": "double", "total_value": "double", "date_str": "string", "period_id": "int"}
    cols = [(F.col(f"`{names[n]}`") if n in names else F.lit(None)).try_cast(k).alias(n) for n, k in kinds.items()]
    return raw.select(*cols).withColumn("period_date", long_date(F.col("date_str")))


def series_json(spark: SparkSession, path: str) -> DataFrame:
    """Cached series: arrays of {date, value}; values may be null, files may be empty."""
    return spark.read.schema("date string, value double").option("multiLine", True).json(path).select(F.try_to_date("date", "yyyy-MM-dd").alias("date"), "value").where("date is not null")


def series_response(raw: DataFrame, code: str, body: str = "body") -> DataFrame:
    """Raw responses {"items": [{"Tarih": ..., CODE: ...}]}: the value is the code's column, else the first that isn't
    about time."""
    item = F.explode(F.from_json(F.get_json_object(body, "$.items"), "array<map<string,string>>")).alias("m")
    own = F.try_element_at("m", F.lit(code.replace(".", "_")))
    other = F.get(F.map_values(F.map_filter("m", lambda k, v: ~k.isin("Tarih", "UNIXTIME", "YEARWEEK"))), F.lit(0))
    value = F.when(F.map_contains_key("m", code.replace(".", "_")), own).otherwise(other)
    return raw.select(item).select(F.try_to_date(F.col("m")["Tarih"], "dd-MM-yyyy").alias("date"), value.try_cast("double").alias("value")).where("date is not null")


def json_number(body: str, field: str, kind: str = "bigint") -> Column:
    """A field of a JSON text as a number; null where it is none."""
    return F.get_json_object(body, f"$.{field}").try_cast(kind)


MONTHLY = "struct<colModels:array<struct<name:string>>,colNames:array<string>,data:struct<rows:array<struct<cell:array<string>>>>>"


def monthly_rows(raw: DataFrame, body: str = "response_json", least_cells: int = 4) -> DataFrame:
    """Monthly responses to one row per table row: the raw row's other columns, cells (name -> text), item_order (place
    from 0). Rows of fewer than least_cells cells are left out and don't count."""
    j = F.from_json(F.get_json_object(body, "$.Json"), MONTHLY).alias("j")
    rest = [c for c in raw.columns if c != body]
    rows = F.filter("j.data.rows", lambda r: F.size(r["cell"]) >= least_cells)
    rows = raw.select(*rest, j).select(*rest, F.col("j.colModels.name").alias("names"), F.posexplode(rows).alias("item_order", "row"))
    cells = F.map_from_entries(F.filter(F.arrays_zip(F.col("names").alias("k"), F.col("row.cell").alias("v")), lambda x: x["k"].isNotNull()))
    return rows.select(*rest, "item_order", cells.alias("cells"))


def number(cells: Column, *names: str) -> Column:
    """The first of the named cells that is a number other than 0, else the last one."""
    return first_truthy(*(F.try_element_at(cells, F.lit(n)).try_cast("double") for n in names))


def unpivoted(rows: DataFrame, meta: list[str], cells: str = "cells") -> DataFrame:
    """Every other cell as a row: column_name, value_numeric, value_text; nulls and empty texts are left out."""
    keep = [c for c in rows.columns if c != cells]
    long = rows.select(*keep, F.explode(cells).alias("column_name", "value_text")).where(~F.col("column_name").isin(meta) & F.col("value_text").isNotNull() & (F.col("value_text") != ""))
    return long.withColumn("value_numeric", F.col("value_text").try_cast("double"))


def ratio_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ratio_category", ratio_category("item_name"))


WEEKLY = "struct<Baslik:string,XEkseni:array<string>,YEkseni:array<double>>"


def weekly_points(raw: DataFrame, body: str = "response_json") -> DataFrame:
    """Weekly responses to points: item_name (the title before ' (TRY)'), period_date, value. Dates that can't be read
    are left out."""
    j = F.from_json(body, WEEKLY)
    rest = [c for c in raw.columns if c != body]
    got = raw.select(*rest, j.alias("j")).select(*rest, F.trim(F.substring_index("j.Baslik", " (TRY)", 1)).alias("item_name"), F.explode(F.arrays_zip(F.col("j.XEkseni").alias("x"), F.col("j.YEkseni").alias("y"))).alias("p"))
    return got.select(*rest, "item_name", F.try_to_date("p.x", "d.MM.yyyy").alias("period_date"), F.col("p.y").alias("value")).where("period_date is not null")
