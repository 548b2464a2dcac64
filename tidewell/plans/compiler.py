"""Catalogue definitions to plans. All metrics of one table come from one scan and one aggregation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.expr import ascii_like, month_start, ratio
from tidewell.operators import timeseries
from tidewell.plans import catalog
from tidewell.plans.catalog import Metric, Where

KEYS = ["year", "month", "bank_type_code"]
STANDARD = ["year", "month", "period", "bank_type_code", "bank_type", "value"]


def predicate(w: Where, entities: Column | None = None, or_precedence: bool = False) -> Column:
    """The filter of a definition, and of the entities. or_precedence: the entity filter binds to the last name pattern
    only, as in text pasted without parentheses."""
    rest = F.lit(True) if entities is None else entities
    for u in w.unlike:
        rest = rest & ~ascii_like("item_name", u)
    for c, v in w.equal:
        rest = rest & (F.col(c) == v)
    likes = [ascii_like("item_name", p) for p in w.like] or [F.lit(True)]
    if or_precedence:
        out = likes[-1] & rest
        for x in likes[:-1]:
            out = x | out
        return out
    some = likes[0]
    for x in likes[1:]:
        some = some | x
    return some & rest


def measure(m: Metric, currency: str) -> Column:
    cols = [F.col(c) for c in m.of(currency)]
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


class Engine:
    """Metrics, ratios and growth rates over the fact tables balance_sheet, income_statement, loans, deposits, ...

    Results are plans in standard shape: year, month, period, bank_type_code, bank_type, value.
    """

    def __init__(self, tables: Mapping[str, DataFrame], entities: Iterable[str] | None = catalog.PRIMARY, or_precedence: bool = False):
        self.tables, self.or_precedence = tables, or_precedence
        self.entities = None if entities is None else F.col("bank_type_code").isin(*entities)

    def shaped(self, df: DataFrame) -> DataFrame:
        names = F.create_map(*(F.lit(x) for kv in catalog.ENTITIES.items() for x in kv))
        rest = [c for c in df.columns if c not in (*KEYS, "value")]
        return df.select("year", "month", month_start("year", "month").alias("period"), "bank_type_code", F.coalesce(F.try_element_at(names, F.col("bank_type_code")), "bank_type_code").alias("bank_type"), "value", *rest)

    def columns(self, wanted: list[tuple[str, Metric, str]]) -> DataFrame:
        """One column per (name, metric, currency), all of one table, in one scan and one aggregation; a column is null
        where no row fits."""
        table = {m.table for _, m, _ in wanted}
        if len(table) != 1:
            raise ValueError("metrics of one table only")
        tests = [(n, predicate(m.where, self.entities, self.or_precedence), measure(m, c), getattr(F, m.aggregation)) for n, m, c in wanted]
        some = tests[0][1]
        for _, p, _, _ in tests[1:]:
            some = some | p
        return self.tables[table.pop()].where(some).groupBy(*KEYS).agg(*(e for n, p, v, whole in tests for e in (whole(F.when(p, v)).alias(n), F.count(F.when(p, 1)).alias(f"_{n}"))))

    def metric(self, id: str, currency: str = "TOTAL") -> DataFrame:
        m = catalog.METRICS.get(id)
        if m is None:
            raise ValueError(f"unknown metric {id!r}")
        df = self.columns([("value", m, currency)]).drop("_value")
        return self.shaped(df.withColumns({"metric_id": F.lit(id), "metric_name": F.lit(m.name), "currency": F.lit(currency), "unit": F.lit(m.unit)}))

    def item(self, pattern: str, table: str = "balance_sheet", currency: str = "TOTAL", **equal) -> DataFrame:
        """Any item by name pattern, in standard shape."""
        m = Metric("item", pattern, "assets", table, Where((pattern,), equal=tuple(equal.items())), {"TL": ("amount_tl",), "FX": ("amount_fx",), "TOTAL": ("amount_total",)})
        if currency not in m.columns:
            raise KeyError(currency)
        return self.shaped(self.columns([("value", m, currency)]).drop("_value"))

    def resolved(self, id: str) -> Metric:
        """As ratios and growth rates take it."""
        return catalog.GETTERS.get(id) or catalog.METRICS[id]

    def ratio(self, id: str) -> DataFrame:
        if id not in catalog.RATIOS:
            raise ValueError(f"unknown ratio {id!r}")
        r = catalog.RATIOS[id]
        (a, ca), (b, cb) = catalog.operand(r.numerator), catalog.operand(r.denominator)
        ma, mb = self.resolved(a), self.resolved(b)
        if ma.table == mb.table:
            both = self.columns([("a", ma, ca), ("b", mb, cb)]).where("_a > 0 and _b > 0")
        else:
            both = self.columns([("a", ma, ca)]).join(self.columns([("b", mb, cb)]), KEYS)
        return self.shaped(both.select(*KEYS, ratio("a", "b", r.scale).alias("value")).withColumns({"metric_id": F.lit(id), "metric_name": F.lit(r.name)}))

    def growth(self, id: str) -> DataFrame:
        if id not in catalog.GROWTH:
            raise ValueError(f"unknown growth rate {id!r}")
        g = catalog.GROWTH[id]
        level = self.shaped(self.columns([("value", self.resolved(g.metric), "TOTAL")]).drop("_value"))
        got = timeseries.growth(level, g.periods, ["bank_type_code"], out="value_").drop("value").withColumnRenamed("value_", "value")
        return got.withColumns({"metric_id": F.lit(id), "metric_name": F.lit(g.name)}).na.drop()

    def any(self, id: str) -> DataFrame:
        return self.ratio(id) if id in catalog.RATIOS else self.growth(id) if id in catalog.GROWTH else self.metric(id)

    def cells(self, wanted: Mapping[str, Metric], currency: str, name: str) -> DataFrame:
        """KEYS, name, value: the columns of columns() as rows, one for each that has rows."""
        wide = self.columns([(i, m, currency) for i, m in wanted.items()])
        cells = F.explode(F.array(*(F.struct(F.lit(i).alias(name), F.col(f"`{i}`").cast("double").alias("value"), F.col(f"`_{i}`").alias("n")) for i in wanted))).alias("c")
        return wide.select(*KEYS, cells).where("c.n > 0").select(*KEYS, f"c.{name}", "c.value")

    def every_metric(self, currency: str = "TOTAL") -> DataFrame:
        """All base metrics as one long table (metric_id, ...), one scan per fact table."""
        out = None
        for table in dict.fromkeys(m.table for m in catalog.METRICS.values()):
            if table in self.tables:
                long = self.shaped(self.cells({m.id: m for m in catalog.METRICS.values() if m.table == table}, currency, "metric_id"))
                out = long if out is None else out.unionByName(long)
        return out

    def everything(self) -> DataFrame:
        """All metrics, ratios and growth rates that can be computed as one long table, one scan per fact table."""
        from tidewell.plans.bulk import bulk

        return bulk(self)[0]

    @staticmethod
    def ordered(df: DataFrame) -> DataFrame:
        """In the order that reports list rows in; frames have none otherwise."""
        return df.orderBy("year", "month", "bank_type_code")

    def periods(self, table: str = "balance_sheet") -> DataFrame:
        return self.tables[table].select("year", "month").distinct().withColumn("period", month_start("year", "month"))

    def latest_period(self, table: str = "balance_sheet") -> DataFrame:
        return self.periods(table).orderBy(F.desc("period")).limit(1)
