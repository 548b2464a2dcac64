"""A kept store: report frames computed once, and again only where a revision of the facts reaches.

The frames lie in parts of a metric and year, so a getter reads its metric's folders and no facts. A revision names the
months whose facts changed. Levels, ratios and shares of those months are computed from the facts of those months alone.
What looks back - growth rates, rolling means, trailing years - is computed again from the kept levels, and only the
years that a changed month reaches are written.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidewell.operators import timeseries
from tidewell.plans.compiler import STANDARD
from tidewell.plans.extended import Frames, Store
from tidewell.sources.versions import Parts

SCHEMA = T.StructType([T.StructField("metric_id", T.StringType()), T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()), T.StructField("period", T.DateType()), T.StructField("bank_type_code", T.StringType()), T.StructField("bank_type", T.StringType()), T.StructField("value", T.DoubleType())])


@dataclass(frozen=True)
class Derived:
    """A frame made of another frame's rows. kind: growth over ``rows`` rows, mean of the last ``rows`` rows (``least``
    values at least), or trailing (a trailing year from a cumulative value)."""

    id: str
    base: str
    kind: str
    rows: int = 12
    least: int = 1

    def of(self, base: DataFrame) -> DataFrame:
        by = ["bank_type_code"]
        if self.kind == "growth":
            got = timeseries.growth(base, self.rows, by, out="_v")
        elif self.kind == "mean":
            got = timeseries.rolling_mean(base, self.rows, self.least, by, out="_v").where("_v is not null")
        elif self.kind == "trailing":
            got = timeseries.trailing_year(base, by, out="_v")
        else:
            raise ValueError(f"unknown kind {self.kind!r}")
        return got.withColumns({"value": F.col("_v"), "metric_id": F.lit(self.id)}).select(*SCHEMA.names)

    def reached(self, before: DataFrame, after: DataFrame, months: Iterable[tuple[int, int]]) -> DataFrame:
        """year: those in which a row may change, from the base's rows before and after a revision of months. Lags count
        rows, so what a month reaches depends on which rows an entity has."""
        own = before.select("bank_type_code", "period").unionByName(after.select("bank_type_code", "period")).distinct()
        changed = F.array(*(F.make_date(F.lit(y), F.lit(m), F.lit(1)) for y, m in months))
        if self.kind == "trailing":
            # Its own month, the same month a year on, and after a December all months of the next year.
            hit = F.exists(changed, lambda c: (F.col("period") == c) | (F.col("period") == F.add_months(c, 12)) | ((F.month(c) == 12) & (F.year("period") == F.year(c) + 1)))
            return own.where(hit).select(F.year("period").alias("year")).distinct()
        out = None
        for side in (before, after):
            w = W.partitionBy("bank_type_code").orderBy("period")
            far = F.lag("period", self.rows if self.kind == "growth" else self.rows - 1).over(w)
            rows = side.select("bank_type_code", "period", F.coalesce(far, F.make_date(F.lit(1), F.lit(1), F.lit(1))).alias("_far"))
            # Between the furthest row that it looks at and itself lies a changed month, whether or not that has a row now.
            hit = rows.where(F.exists(changed, lambda c: (c <= F.col("period")) & (c >= F.col("_far"))))
            years = hit.select(F.year("period").alias("year"))
            out = years if out is None else out.unionByName(years)
        return out.distinct()


GROWTH = tuple(Derived(id, base, "growth", rows) for id, (base, rows) in Store.GROWTH.items())


class KeptStore(Frames):
    """The frames of a Store, and further derived ones, kept below root."""

    def __init__(self, spark: SparkSession, root: str, derived: Iterable[Derived] = ()):
        self.spark, self.derived = spark, (*GROWTH, *derived)
        self.parts = Parts(spark, root, lambda: F.concat_ws("@", "metric_id", "year"))

    def long(self, ids: Iterable[str] | None = None) -> DataFrame:
        wanted = None if ids is None else set(ids)
        return self.parts.read(lambda p: wanted is None or p.split("@")[0] in wanted, schema=SCHEMA)

    def build(self, store: Store, mark: object = None) -> list[str]:
        """Computes all frames from the facts; the parts written. Parts of frames that have no rows any more go. mark: kept
        with the version, such as the versions of the facts."""
        rows = levels = self.parts.held(self._levels(store, None))  # the facts are read for this alone
        for d in self.derived:
            rows = rows.unionByName(d.of(levels.where(F.col("metric_id") == d.base)))
        rows = self.parts.held(rows)
        return self.parts.replace(rows, {*self.parts.manifest()["parts"], *self.parts.names(rows)}, mark)

    def revise(self, store: Store, months: Iterable[tuple[int, int]], mark: object = None) -> list[str]:
        """Takes over a revision of the facts of the named (year, month)s, which store's tables already have; the parts
        written. Other months' facts are not read."""
        months = sorted(set(months))
        if not months:
            return []
        changed = (F.col("year") * 12 + F.col("month")).isin([y * 12 + m for y, m in months])
        levels = [i for i in store.ids() if i not in {d.id for d in self.derived}]
        years = {y for y, _ in months}
        in_months = lambda df: df.where(F.col("year").isin(*years) & changed)
        fresh = Store({n: in_months(t) if "year" in t.columns else t for n, t in store.tables.items()}, None, store.or_precedence)
        fresh.entities = store.entities
        new = self.parts.held(self._levels(fresh, levels))
        level_part = lambda p: p.split("@")[0] in levels and int(p.split("@")[1]) in years
        old = self.parts.read(level_part, schema=SCHEMA)
        rows = old.where(~changed).unionByName(new)
        names = {p for p in self.parts.manifest()["parts"] if level_part(p)} | self.parts.names(new)
        for d in self.derived:
            before = self.long([d.base])
            after = self.parts.held(before.where(~changed).unionByName(new.where(F.col("metric_id") == d.base)))
            reached = [r["year"] for r in d.reached(before, after, months).collect()]  # a number for each year
            if reached:
                rows = rows.unionByName(d.of(after).where(F.col("year").isin(*reached)))
                names |= {f"{d.id}@{y}" for y in reached}
        return self.parts.replace(self.parts.held(rows), names, mark)

    def _levels(self, store: Store, ids: list[str] | None) -> DataFrame:
        own = {d.id for d in self.derived}
        ids = [i for i in store.ids() if i not in own] if ids is None else ids
        return store.long(ids).select("metric_id", *(F.col(c).cast(SCHEMA[c].dataType) for c in STANDARD if c != "metric_id")).select(*SCHEMA.names)
