"""Many definitions at once: each fact table is scanned once, and everything else is derived from what that gives.

Definitions are resolved against the tables' schemas first. One that can't be computed becomes a row of a fault frame and
doesn't stop the others. What is left is planned as a whole: all columns that metrics and operands need of a table are one
wide aggregation, the wide tables meet on the standard keys, ratios are expressions over that row, and growth rates of
all periods come from one window over the long result.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidewell.functions.expr import ratio
from tidewell.plans import catalog
from tidewell.plans.catalog import CURRENCIES, Growth, Metric, Ratio
from tidewell.plans.compiler import KEYS, STANDARD, Engine

AGGREGATIONS = ("sum", "avg", "min", "max", "count")


@dataclass(frozen=True)
class Definitions:
    """A catalogue: the built-in one unless others are given. Ratios may have ratios as operands, growth rates too.

    getters: what ratios and growth rates take for an id in place of the metric.
    """

    metrics: Mapping[str, Metric] = field(default_factory=lambda: catalog.METRICS)
    ratios: Mapping[str, Ratio] = field(default_factory=lambda: catalog.RATIOS)
    growth: Mapping[str, Growth] = field(default_factory=lambda: catalog.GROWTH)
    getters: Mapping[str, Metric] = field(default_factory=lambda: catalog.GETTERS)

    def ids(self) -> list[str]:
        return list(dict.fromkeys([*self.metrics, *self.ratios, *self.growth]))

    def faults(self, tables: Mapping[str, DataFrame], currency: str = "TOTAL") -> dict[str, str]:
        """id -> why it can't be computed, for those that can't."""
        schemas = {name: {f.name: f.dataType for f in df.schema} for name, df in tables.items()}
        known: dict[tuple[str, str, bool], str | None] = {}

        def metric(m: Metric, cur: str) -> str | None:
            if m.table not in schemas:
                return f"no table {m.table}"
            try:
                columns = m.of(cur)
            except ValueError as error:
                return str(error)
            have = schemas[m.table]
            needs = [*KEYS, *columns, *(c for c, _ in m.where.equal), *(["item_name"] if m.where.like or m.where.unlike else [])]
            for c in needs:
                if c not in have:
                    return f"no column {c} in {m.table}"
            for c in columns:
                if not isinstance(have[c], T.NumericType):
                    return f"column {c} of {m.table} is no number"
            return None if m.aggregation in AGGREGATIONS else f"unknown aggregation {m.aggregation}"

        def operand(id: str, cur: str, path: tuple[str, ...]) -> str | None:
            if cur not in CURRENCIES:
                return f"unknown currency {cur}"
            if id in path:
                return "loop: " + " -> ".join([*path[path.index(id) :], id])
            key = (id, cur, True)
            if key not in known:
                m = self.getters.get(id) or self.metrics.get(id)
                known[key] = metric(m, cur) if m is not None else whole(id, path) if id in self.ratios else f"unknown operand {id}"
            return known[key]

        def whole(id: str, path: tuple[str, ...] = ()) -> str | None:
            if id in self.ratios:
                r = self.ratios[id]
                for text in (r.numerator, r.denominator):
                    name, cur = catalog.operand(text)
                    if why := operand(name, cur, (*path, id)):
                        return why if why.startswith("loop") else f"operand {text}: {why}"
                return None
            if id in self.growth:
                g = self.growth[id]
                if g.periods < 1:
                    return f"periods must be positive, not {g.periods}"
                why = operand(g.metric, "TOTAL", (id,))
                return why and (why if why.startswith("loop") else f"base {g.metric}: {why}")
            return metric(self.metrics[id], currency)

        found = {}
        for id in self.ids():
            known.clear()  # a fault found from within a loop isn't that of its parts alone
            if why := whole(id):
                found[id] = why
        return found


def bulk(engine: Engine, definitions: Definitions | None = None, ids: Iterable[str] | None = None, currency: str = "TOTAL") -> tuple[DataFrame, DataFrame]:
    """(results, faults): results in standard shape with metric_id for all definitions, or those named; faults
    (metric_id, fault) for those that can't be computed, unknown ids among them.

    Values are doubles. A metric has a row where it has facts; a ratio where both operands have; a growth rate where the
    row so many rows before is there and isn't 0. A table with none of the wanted columns isn't scanned.
    """
    d = definitions or Definitions()
    wanted = list(dict.fromkeys(d.ids() if ids is None else ids))
    faults = d.faults(engine.tables, currency)
    faults |= {i: "unknown id" for i in wanted if i not in set(d.ids())}
    good = [i for i in wanted if i not in faults]

    needed: dict[str, dict[str, tuple[Metric, str]]] = {}  # table -> column -> what it sums
    names: dict[tuple[str, str, bool], str] = {}

    def column(id: str, cur: str, as_operand: bool) -> str:
        m = d.getters.get(id) or d.metrics[id] if as_operand else d.metrics[id]
        as_operand = as_operand and id in d.getters  # else it is the metric itself, summed once for both
        key = (id, cur, as_operand)
        if key not in names:
            names[key] = f"c{len(names)}"
            needed.setdefault(m.table, {})[names[key]] = (m, cur)
        return names[key]

    def value(id: str, cur: str = "TOTAL", as_operand: bool = True) -> tuple[Column, Column]:
        """The value on a wide row, and whether the row has it."""
        if not (as_operand and id in d.getters) and id not in d.metrics and id in d.ratios:
            r = d.ratios[id]
            (a, has_a), (b, has_b) = (value(*catalog.operand(x)) for x in (r.numerator, r.denominator))
            return ratio(a, b, r.scale), has_a & has_b
        c = column(id, cur, as_operand)
        return F.col(c).cast("double"), F.coalesce(F.col(f"_{c}"), F.lit(0)) > 0

    cells = []
    for i in good:
        kind = "metric" if i in d.metrics else "ratio" if i in d.ratios else "growth"
        v, there = value(d.growth[i].metric) if kind == "growth" else value(i, currency, False) if kind == "metric" else value(i)
        cells.append(F.struct(F.lit(i).alias("metric_id"), v.alias("value"), there.alias("there"), F.lit(d.growth[i].periods if kind == "growth" else 0).alias("lag")))
    spark = next(iter(engine.tables.values())).sparkSession
    told = spark.createDataFrame([(i, faults[i]) for i in wanted if i in faults], "metric_id string, fault string")
    if not cells:
        return spark.createDataFrame([], "year int, month int, period date, bank_type_code string, bank_type string, value double, metric_id string"), told

    wide = None
    for columns in needed.values():
        own = engine.columns([(n, m, c) for n, (m, c) in columns.items()])
        wide = own if wide is None else wide.join(own, KEYS, "full_outer")
    long = wide.select(*KEYS, F.explode(F.array(*cells)).alias("c")).where("c.there").select(*KEYS, "c.metric_id", "c.value", "c.lag")
    lags = sorted({d.growth[i].periods for i in good if i in d.growth and i not in d.metrics and i not in d.ratios})
    if lags:
        w = W.partitionBy("metric_id", "bank_type_code").orderBy("year", "month")
        was = F.coalesce(*(F.when(F.col("lag") == n, F.lag("value", n).over(w)) for n in lags))
        long = long.withColumn("_was", was)
        grown = ratio(F.col("value") - F.col("_was"), "_was", 100)
        long = long.withColumn("value", F.when(F.col("lag") == 0, F.col("value")).otherwise(grown)).where("lag = 0 or value is not null")
    return engine.shaped(long.select(*KEYS, "value", "metric_id")).select(*STANDARD, "metric_id"), told
