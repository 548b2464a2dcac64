"""Operators on series in standard shape: one row per (entity..., period). Lags count rows, not dates, unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions.expr import col, ratio


def _over(by: list[str], order: str):
    return W.partitionBy(*by).orderBy(order)


def growth(df: DataFrame, periods: int, by: list[str], order: str = "period", value: str = "value", out: str = "growth", calendar_months: bool = False) -> DataFrame:
    """Percent change to the row ``periods`` before, rows without one dropped; a base of 0 gives no row either.

    calendar_months: compare with the row dated so many months before, whatever rows lie between.
    """
    if calendar_months:
        base = df.select(*(F.col(c).alias(f"_{c}") for c in by), F.add_months(order, periods).alias("_o"), F.col(value).alias("_base"))
        df = df.join(base, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col(order) == F.col("_o")], "left").drop("_o", *(f"_{c}" for c in by))
    else:
        df = df.withColumn("_base", F.lag(value, periods).over(_over(by, order)))
    return df.withColumn(out, ratio(F.col(value) - F.col("_base"), "_base", 100)).drop("_base").where(F.col(out).isNotNull())


def change_filled(df: DataFrame, by: list[str], order: str = "period", value: str = "value", out: str = "growth", periods: int = 1) -> DataFrame:
    """Percent change after filling nulls with the last value before them."""
    w = _over(by, order)
    filled = df.withColumn("_f", F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    was = F.lag("_f", periods).over(w)
    return filled.withColumn(out, ratio(F.col("_f") - was, was, 100)).drop("_f").where(F.col(out).isNotNull())


def annualised(df: DataFrame, by: list[str], order: str = "period", value: str = "value", out: str = "growth", per_year: int = 12) -> DataFrame:
    """((1 + change)^per_year - 1) * 100 of the filled change."""
    got = change_filled(df, by, order, value, "_c")
    return got.withColumn(out, (F.pow(1 + F.col("_c") / 100, F.lit(per_year)) - 1) * 100).drop("_c")


def growth_annualised(df: DataFrame, rows: int, by: list[str], order: str = "period_date", value: str = "value", out: str = "growth", per_year: int | None = 52) -> DataFrame:
    """(value / value ``rows`` before)^(per_year / rows) - 1 in percent; null unless both are positive, and then dropped.
    per_year None: not annualised."""
    was = F.lag(value, rows).over(_over(by, order))
    g = ratio(value, was)
    g = F.pow(g, F.lit(per_year / rows)) if per_year else g
    return df.withColumn(out, F.when((was > 0) & (F.col(value) > 0), (g - 1) * 100)).where(F.col(out).isNotNull())


def same_month_change(df: DataFrame, by: list[str], out: str = "growth") -> DataFrame:
    """Percent change to the row of the same month before, by year."""
    was = F.lag("value", 1).over(W.partitionBy(*by, "month").orderBy("year"))
    return df.withColumn(out, ratio(F.col("value") - was, was, 100)).where(F.col(out).isNotNull())


def annualised_ytd(df: DataFrame, out: str = "value") -> DataFrame:
    """A cumulative value times 12 / month."""
    return df.withColumn(out, F.col("value") * F.lit(12.0) / F.col("month"))


def trailing_year(df: DataFrame, by: list[str], value: str = "value", out: str = "ttm") -> DataFrame:
    """From a cumulative value: this one plus last year's December less last year's same month; in December itself.

    Keyed by calendar; rows without both are dropped. Both are looked up by windows over the year before, so the facts
    behind df are read once.
    """
    year_before = W.partitionBy(*by).orderBy("year").rangeBetween(-1, -1)
    same = W.partitionBy(*by, "month").orderBy("year").rangeBetween(-1, -1)
    december = F.max(F.when(F.col("month") == 12, F.col(value).cast("double"))).over(year_before)
    before = december - F.max(F.col(value).cast("double")).over(same)
    return df.withColumn(out, F.when(F.col("month") == 12, F.col(value).cast("double")).otherwise(F.col(value) + before)).where(F.col(out).isNotNull())


def rolling_mean(df: DataFrame, rows: int, least: int, by: list[str], order: str = "period", value: str = "value", out: str = "mean") -> DataFrame:
    """Mean of the last ``rows`` rows, null with fewer than ``least`` values."""
    w = _over(by, order).rowsBetween(1 - rows, 0)
    return df.withColumn(out, F.when(F.count(value).over(w) >= least, ratio(F.sum(value).over(w), F.count(value).over(w))))


def rate_adjusted_growth(df: DataFrame, periods: int, by: list[str], local: str, foreign: str, rate: str, order: str = "period", compound: bool = False) -> DataFrame:
    """Growth with the foreign part held at the earlier exchange rate: growth_nominal, growth_adjusted, rate_effect.

    compound: annualised to 12 / periods.
    """
    w = _over(by, order)
    l0, f0, r0 = (F.lag(c, periods).over(w) for c in (local, foreign, rate))
    now, was = col(local) + col(foreign), l0 + f0
    fixed = col(local) + ratio(col(foreign), col(rate)) * r0
    g = lambda x: ratio(x - was, was)
    year = (lambda x: F.pow(1 + x, F.lit(12 / periods)) - 1) if compound else (lambda x: x)
    out = df.withColumns({"growth_nominal": year(g(now)) * 100, "growth_adjusted": year(g(fixed)) * 100})
    return out.withColumn("rate_effect", F.col("growth_nominal") - F.col("growth_adjusted")).where(F.col("growth_adjusted").isNotNull())


def first_last_growth(df: DataFrame, rows: int, order: str, value: str, per_year: int = 52) -> DataFrame:
    """One row over the latest ``rows`` + 1 rows: simple and compound annualised growth in percent, rounded to 2; null
    with fewer rows."""
    top = df.orderBy(F.desc(order)).limit(rows + 1)
    a = top.agg(F.count("*").alias("n"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.min(order).alias("start"), F.max(order).alias("end"))
    g = F.when(F.col("n") > rows, ratio("last", "first") - 1)
    return a.select("start", "end", "first", "last", F.bround(g * 100 * per_year / rows, 2).alias("simple"), F.bround((F.pow(1 + g, F.lit(per_year / rows)) - 1) * 100, 2).alias("compound"))


def resampled(df: DataFrame, unit: str, by: list[str], columns: dict[str, str], date: str = "date", value: str = "value") -> DataFrame:
    """avg, min, max, first or last value of every week, month, quarter or year as columns, in one aggregation."""
    kinds = {"avg": lambda: F.avg(value), "min": lambda: F.min(value), "max": lambda: F.max(value), "first": lambda: F.min_by(value, date), "last": lambda: F.max_by(value, date)}
    return df.groupBy(*by, F.trunc(F.col(date).cast("date"), unit).alias("period")).agg(*(kinds[how]().alias(name) for name, how in columns.items()))


def resample(df: DataFrame, unit: str, by: list[str], how: str, date: str = "date", value: str = "value") -> DataFrame:
    return resampled(df, unit, by, {"value": how}, date, value)


def since_first(df: DataFrame, by: list[str], order: str = "period", value: str = "value") -> DataFrame:
    """Percent change from the first to the last row."""
    got = df.groupBy(*by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    return got.withColumn("change", ratio(F.col("last") - F.col("first"), "first", 100))


def peaks(df: DataFrame, by: list[str], order: str = "period", value: str = "value") -> DataFrame:
    """Largest and least value with their dates, the earliest of equal ones."""
    pick: Column = F.struct(F.col(value), F.col(order))
    hi = F.min(F.struct((-F.col(value)).alias("v"), F.col(order).alias("o")))
    lo = F.min(pick)
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg((-hi["v"]).alias("peak"), hi["o"].alias("peak_at"), lo[value].alias("low"), lo[order].alias("low_at"))
