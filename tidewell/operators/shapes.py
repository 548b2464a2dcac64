"""Summaries and report shapes: latest snapshots, KPIs, shares, comparisons, captions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions.expr import amount_text, half_even, pace, percent_text, ratio


def latest(df: DataFrame, order: str = "period", by: list[str] | None = None) -> DataFrame:
    """The rows of the latest period of all: entities that stopped before aren't in it.

    by: columns that tell entities apart, of which each has one row a period. Then one pass does: each entity's latest
    row by a combining aggregation, and the latest of those few. Without it every row of the period is wanted, and a
    second aggregation finds the period.
    """
    if by is None:
        last = df.agg(F.max(order).alias("_last"))
        return df.join(F.broadcast(last), F.col(order) == F.col("_last")).drop("_last")
    rest = [c for c in df.columns if c not in by]
    own = df.where(F.col(order).isNotNull()).groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("r"))
    own = own.select(*(c if c in by else F.col(f"r.{c}").alias(c) for c in df.columns))
    # One row for each entity.
    return own.withColumn("_last", F.max(order).over(W.partitionBy(F.lit(0)))).where(F.col(order) == F.col("_last")).drop("_last")


def kpi(df: DataFrame, by: list[str], order: str = "period", value: str = "value") -> DataFrame:
    """Each entity's last row with the row before: previous, change, and percent of the previous value's size."""
    w = W.partitionBy(*by).orderBy(order)
    got = df.withColumns({"previous": F.lag(value, 1).over(w), "_next": F.lead(order, 1).over(w)}).where("_next is null").drop("_next")
    return got.withColumns({"change": F.col(value) - F.col("previous"), "change_percent": ratio(F.col(value) - F.col("previous"), F.abs("previous"), 100)})


def summary(df: DataFrame, by: list[str], order: str = "period", value: str = "value") -> DataFrame:
    """Least, largest and mean value, the last one, its date and change; the change is 0 from a previous value of 0."""
    k = kpi(df, by, order, value).select(*by, F.col(order).alias("last_period"), F.col(value).alias("last_value"), "previous")
    a = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("largest"), ratio(F.sum(F.col(value).cast("decimal(28,2)")), F.count(value)).alias("mean"))
    change = F.when(F.col("previous") == 0, F.lit(0.0)).otherwise(ratio(F.col("last_value") - F.col("previous"), "previous", 100))
    return a.join(k, by).withColumn("change_percent", change).drop("previous")


def share_of(df: DataFrame, whole: str, entity: str = "entity", order: str = "period", value: str = "value", out: str = "share") -> DataFrame:
    """Each entity's percent of the row named ``whole`` of the same period, rounded half to even; one shuffle, no join."""
    total = F.max(F.when(F.col(entity) == whole, F.col(value))).over(W.partitionBy(order))
    return df.withColumn(out, half_even(ratio(value, total, 100))).where((F.col(entity) != whole) & F.col(out).isNotNull())


def comparison(df: DataFrame, metrics: list[str], entity: str = "entity", name: str = "metric_id", value: str = "value") -> DataFrame:
    """One row per entity, one column per metric; a metric given twice for an entity fails the query."""
    one = lambda m: F.when(F.count(F.when(F.col(name) == m, 1)) <= 1, F.max(F.when(F.col(name) == m, F.col(value)))).otherwise(F.raise_error(F.lit(f"{m}: more than one value")).cast("double"))
    return df.groupBy(entity).agg(*(one(m).alias(m) for m in metrics))


def pivot_sum(df: DataFrame, index: list[str], name: str, names: list[str], value: str = "value") -> DataFrame:
    """Sums by name as columns; a present name with nulls only is 0, an absent one null."""
    cell = lambda n: F.when(F.count(F.when(F.col(name) == n, 1)) > 0, F.coalesce(F.sum(F.when(F.col(name) == n, F.col(value))), F.lit(0)))
    return df.groupBy(*index).agg(*(cell(n).alias(n) for n in names))


def leader_laggard(df: DataFrame, by: list[str], entity: str = "entity", value: str = "value") -> DataFrame:
    top = F.min(F.struct((-F.col(value)).alias("v"), F.col(entity).alias("e")))
    low = F.min(F.struct(F.col(value).alias("v"), F.col(entity).alias("e")))
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(top["e"].alias("leader"), (-top["v"]).alias("leader_value"), low["e"].alias("laggard"), low["v"].alias("laggard_value"))


def sum_of_all(df: DataFrame, names: list[int], keys: list[str], name: str = "item_order", value: str = "value") -> DataFrame:
    """The sum over the named items for keys that have all of them, in one pass."""
    some = df.where(F.col(name).isin(names)).groupBy(*keys).agg(F.sum(value).alias(value), F.count_distinct(name).alias("_n"))
    return some.where(F.col("_n") == len(set(names))).drop("_n")


def growth_caption(df: DataFrame, by: list[str], order: str = "period", value: str = "growth") -> DataFrame:
    """A sentence on the last growth against the one before; no row for entities with fewer than two."""
    k = kpi(df, by, order, value).where(F.col("previous").isNotNull())
    return k.select(*by, F.concat(F.lit("Growth "), pace(value, "previous"), F.lit(" to "), percent_text(value), F.lit(" from "), percent_text("previous")).alias("caption"))


def level_caption(df: DataFrame, by: list[str], order: str = "period", value: str = "value") -> DataFrame:
    k = kpi(df, by, order, value).where(F.col("previous").isNotNull())
    return k.select(*by, F.concat(amount_text(F.col(value) / 1e6), F.lit(" in "), F.date_format(order, "yyyy-MM")).alias("caption"))


def charted(df: DataFrame, x: str = "period", y: str = "value", series: str | None = None) -> DataFrame:
    """x, y and series, the names that chart code takes."""
    return df.select(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(series) if series else F.lit(None).cast("string")).alias("series"))
