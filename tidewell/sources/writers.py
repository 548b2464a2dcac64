"""Monthly responses to the fact tables: typed projections by table number, merged by key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions.expr import first_truthy
from tidewell.sources.ingest import newest, upsert
from tidewell.sources.readers import monthly_rows, ratio_rows, unpivoted

# Response columns of each typed column (the first that is there and not 0 counts), and table numbers.
AMOUNTS = {"amount_tl": ("Tp",), "amount_fx": ("Yp",), "amount_total": ("Toplam",)}
LOANS = {
    "short_term_tl": ("KisaTp",),
    "short_term_fx": ("KisaYp",),
    "short_term_total": ("KisaToplam",),
    "medium_long_tl": ("OrtaUzunTp",),
    "medium_long_fx": ("OrtaUzunYp",),
    "medium_long_total": ("OrtaUzunToplam",),
    "total_tl": ("ToplamTp", "Tp", "NakdiKrediTp"),
    "total_fx": ("ToplamYp", "Yp", "NakdiKrediYp"),
    "total_amount": ("Toplam", "NakdiKrediToplam", "ToplamNakdi"),
    "npl_amount": ("Takipteki", "TakipKrediToplam"),
    "non_cash_amount": ("GayriNakdi", "GayriNakdiKrediToplam"),
    "customer_count": ("NetMusteri",),
}
DEPOSITS = {
    "bracket_10k": ("OnBin",),
    "bracket_50k": ("ElliBin",),
    "bracket_250k": ("IkiyuzelliBin",),
    "bracket_1m": ("Milyon",),
    "bracket_over_1m": ("Milyonarti",),
    "demand": ("Vadesiz",),
    "maturity_1m": ("BirAyaKadar",),
    "maturity_1_3m": ("BirAyUcAy",),
    "maturity_3_6m": ("UcAyAltiAy",),
    "maturity_6_12m": ("AltiAyBirYil",),
    "maturity_over_12m": ("BirYil",),
    "total_amount": ("Toplam",),
}
RATIO = {"ratio_value": ("Rasyo",)}
META = ["BankaAdi", "BasitSira", "Ad", "BasitFont"]
TABLES = {"balance_sheet": (1,), "income_statement": (2,), "loans": (3, 4, 5, 6, 7), "deposits": (9, 10), "financial_ratios": (15, 17)}

PERIOD = ["year", "month", "currency", "bank_type_code"]
KEYS = {
    "balance_sheet": [*PERIOD, "item_order"],
    "income_statement": [*PERIOD, "item_order"],
    "loans": ["table_number", *PERIOD, "item_order"],
    "deposits": ["table_number", *PERIOD, "item_order"],
    "financial_ratios": ["table_number", "year", "month", "bank_type_code", "item_order"],
}


def _cell(*names: str) -> Column:
    """The first of the named cells that is a number other than 0, else the last one."""
    return first_truthy(*(F.try_element_at("cells", F.lit(n)).try_cast("double") for n in names))


def named_rows(raw: DataFrame, body: str = "response_json") -> DataFrame:
    """Table rows with item_order (the response's, where it has one, else the place from 1), item_name, is_subtotal."""
    has = lambda n: F.coalesce(F.map_contains_key("cells", n), F.lit(False))
    text = lambda n: F.try_element_at("cells", F.lit(n))
    return monthly_rows(raw, body).withColumns({
        "item_order": F.when(has("BasitSira"), text("BasitSira").try_cast("int")).otherwise(F.col("item_order") + 1),
        "item_name": F.when(has("Ad"), text("Ad")).otherwise(F.lit("")),
        "is_subtotal": F.coalesce(text("BasitFont") == "bold", F.lit(False)),
    })


def _typed(rows: DataFrame, table: str, columns: Mapping[str, tuple[str, ...]]) -> DataFrame:
    keys = KEYS[table]
    flag = [] if table == "financial_ratios" else ["is_subtotal"]
    return rows.select(*keys, "item_name", *flag, *(_cell(*names).alias(c) for c, names in columns.items()))


def balance(rows: DataFrame) -> DataFrame:
    return _typed(rows, "balance_sheet", AMOUNTS)


def income(rows: DataFrame) -> DataFrame:
    return _typed(rows, "income_statement", AMOUNTS)


def loans(rows: DataFrame) -> DataFrame:
    return _typed(rows, "loans", LOANS)


def deposits(rows: DataFrame) -> DataFrame:
    return _typed(rows, "deposits", DEPOSITS)


def ratios(rows: DataFrame) -> DataFrame:
    return ratio_rows(_typed(rows, "financial_ratios", RATIO))


def other(rows: DataFrame) -> DataFrame:
    """Every other table: one row per cell that isn't empty."""
    return unpivoted(rows.select("table_number", *PERIOD, "item_order", "item_name", "is_subtotal", "cells"), META)


WRITERS = {"balance_sheet": balance, "income_statement": income, "loans": loans, "deposits": deposits, "financial_ratios": ratios}


def routed(raw: DataFrame, body: str = "response_json") -> dict[str, DataFrame]:
    """Raw responses (table_number, year, month, currency, bank_type_code, body) to the fact tables by table number; what
    no typed table takes goes to other_data. Each is a plan over its own table numbers: keep raw partitioned by them."""
    number = F.col("table_number")
    out = {name: WRITERS[name](named_rows(raw.where(number.isin(*numbers)), body)) for name, numbers in TABLES.items()}
    taken = [n for numbers in TABLES.values() for n in numbers]
    return out | {"other_data": other(named_rows(raw.where(~number.isin(*taken)), body))}


def merged(target: DataFrame | None, batch: DataFrame, table: str, at: str) -> DataFrame:
    """The fact table after a batch, the newest row of each key by ``at``. other_data has no key: there all rows of the
    newest answer of each table, month, currency and entity stay, so a task that is run again doesn't double them."""
    if table == "other_data":
        both = batch.withColumn("_later", F.lit(1))
        both = both if target is None else target.withColumn("_later", F.lit(0)).unionByName(both)
        own = F.struct(at, "_later")
        return both.withColumn("_newest", F.max(own).over(W.partitionBy("table_number", *PERIOD))).where(own == F.col("_newest")).drop("_later", "_newest")
    return upsert(target, newest(batch, KEYS[table], at), KEYS[table], at)
