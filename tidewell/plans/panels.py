"""Report panels as frames: trends, daily steps, stacks and spreads of named series, and the sentences about them.

Series come as one long frame (key, date, value); a panel is one plan over it, whatever the number of its series.
"""

from __future__ import annotations

from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions.expr import basis_points_text, fixed_text
from tidewell.operators import align, shapes
from tidewell.plans import catalog
from tidewell.sources import registry


def _named(points: DataFrame, series: list[dict], spec: Mapping, scale: Mapping[str, float] | None) -> DataFrame:
    """key, label, date, value of the wanted series in the panel's range, in the panel's unit. Keys are of the registry."""
    known = {s["key"]: registry.get(s["key"]) for s in series}
    labels = {s["key"]: s.get("label") or known[s["key"]].label for s in series}
    units = {k: s.unit_scale for k, s in known.items() if s.unit_scale} if scale is None else dict(scale)
    pick = lambda names: F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col("key"))
    rows = points.where(F.col("key").isin(*labels))
    for bound, test in (("start", lambda d, x: d >= x), ("end", lambda d, x: d <= x)):
        if spec.get(bound):
            rows = rows.where(test(F.col("date"), F.lit(spec[bound]).cast("date")))
    value = F.col("value") / F.coalesce(pick(units), F.lit(1.0)) if units else F.col("value")
    return rows.select("key", pick(labels).alias("label"), "date", value.alias("value"))


def trend(points: DataFrame, spec: Mapping, scale: Mapping[str, float] | None = None) -> DataFrame:
    """key, label, date, value, is_last."""
    return _marked(_named(points, spec["series"], spec, scale))


def _marked(rows: DataFrame) -> DataFrame:
    after = F.lead("date").over(W.partitionBy("key").orderBy("date"))
    return rows.withColumn("is_last", after.isNull())


def daily_step(points: DataFrame, spec: Mapping, scale: Mapping[str, float] | None = None) -> DataFrame:
    """As trend, with a row for every day from start to end, both needed; a day without a value has the last one."""
    rows = _named(points, spec["series"], spec, scale)
    return _marked(align.fill_daily(rows, spec["start"], spec["end"], ["key", "label"]))


def stacked(points: DataFrame, spec: Mapping, scale: Mapping[str, float] | None = None) -> DataFrame:
    """key, label, date, value, and total: of all series of the date."""
    rows = _named(points, spec["series"], spec, scale)
    return rows.withColumn("total", F.sum("value").over(W.partitionBy("date")))


def spread(points: DataFrame, spec: Mapping, scale: Mapping[str, float] | None = None) -> DataFrame:
    """label, date, value: one series less another where both have a value; all lines in one aggregation by date."""
    keys = list(dict.fromkeys(k for s in spec["lines"] for k in (s["minuend"], s["subtrahend"])))
    rows = _named(points, [{"key": k} for k in keys], spec, scale)
    wide = rows.groupBy("date").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys))
    cells = F.array(*(F.struct(F.lit(s["label"]).alias("label"), (F.col(s["minuend"]) - F.col(s["subtrahend"])).alias("value")) for s in spec["lines"]))
    return wide.select("date", F.explode(cells).alias("c")).select("c.label", "date", "c.value").where("value is not null")


KINDS = {"evds_trend": trend, "evds_daily_step": daily_step, "evds_stacked_bar": stacked, "derived_spread": spread}


def panel(points: DataFrame, spec: Mapping, scale: Mapping[str, float] | None = None) -> DataFrame:
    """The frame of a panel spec. scale: units by key instead of the registry's."""
    if spec.get("kind") not in KINDS:
        raise ValueError(f"unknown panel kind {spec.get('kind')!r}; known: {', '.join(KINDS)}")
    return KINDS[spec["kind"]](points, spec, scale)


def latest_values(points: DataFrame, key: str = "key", order: str = "date") -> DataFrame:
    """key, value: the last value of each series."""
    return points.where(F.col("value").isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max_by("value", order).alias("value"))


def _formatted(v: Column, spec: str) -> Column:
    """A number by a format such as '.1f', '+.2f' or ',.0f', ties to even by the double's exact value."""
    plain = spec.lstrip("+")
    digits = int(plain.rstrip("f").rsplit(".", 1)[-1]) if "." in plain else 6
    text = fixed_text(v, digits, grouped=plain.startswith(","))
    return F.when(v >= 0, F.concat(F.lit("+"), text)).otherwise(text) if spec.startswith("+") else text


def caption(template: str, values: DataFrame, keys: list[str]) -> DataFrame:
    """One row, caption: the template with the values of (key, value) put in; as it is if a key has no value."""
    wide = values.agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(f"v{i}") for i, k in enumerate(keys)))
    parts, missing = [], F.lit(False)
    for text, name, spec, _ in Formatter().parse(template):
        parts.append(F.lit(text))
        if name is not None:
            v = F.col(f"v{keys.index(name)}") if name in keys else F.lit(None).cast("double")
            parts.append(_formatted(v, spec or ".6f"))
            missing = missing | v.isNull()
    return wide.select(F.when(missing, F.lit(template)).otherwise(F.concat(*parts)).alias("caption"))


def comparison_caption(df: DataFrame, name: str = "bank_type", period: str = "period", value: str = "value") -> DataFrame:
    """caption: who leads and who trails in the latest period, in percent; of equal ones the first by name."""
    ends = shapes.leader_laggard(shapes.latest(df, period, by=[name]), [], name, value)
    return ends.select(F.concat("leader", F.lit(" leads at "), fixed_text("leader_value", 1), F.lit("%, "), "laggard", F.lit(" at "), fixed_text("laggard_value", 1), F.lit("%.")).alias("caption"))


def turn(df: DataFrame, code: str = catalog.SECTOR, band: float = 0.5) -> DataFrame:
    """period, value, delta, direction of an entity's last row: accelerating, easing or steady, by more than ``band``
    points; no row with fewer than two."""
    k = shapes.kpi(df.where(F.col("bank_type_code") == code).select("bank_type_code", "period", "value"), ["bank_type_code"]).where(F.col("previous").isNotNull())
    d = F.col("change")
    return k.select("period", "value", d.alias("delta"), F.when(d > band, "accelerating").when(d < -band, "easing").otherwise("steady").alias("direction"))


def narrative(df: DataFrame, subject: str, digits: int = 1, code: str = catalog.SECTOR) -> DataFrame:
    """sentence: where a published ratio stands and how it moved in basis points since the row before."""
    k = shapes.kpi(df.where(F.col("bank_type_code") == code).select("bank_type_code", "period", "value"), ["bank_type_code"])
    return k.select(F.concat(F.lit(f"{subject} at "), fixed_text("value", digits), F.lit("% in "), F.date_format("period", "yyyy-MM"), F.lit(" ("), basis_points_text(F.coalesce("change", F.lit(0.0))), F.lit(" MoM).")).alias("sentence"))


def narrative_of_two(df: DataFrame, other: DataFrame, subject: str, second: str, digits: int = 1, second_digits: int = 1, code: str = catalog.SECTOR) -> DataFrame:
    """sentence: as narrative, and where a second ratio stands, if it has a value that isn't 0."""
    one = narrative(df, subject, digits, code)
    own = other.where((F.col("bank_type_code") == code) & F.col("value").isNotNull())
    last = own.agg(F.max_by("value", "period").alias("_v"))  # one row
    more = F.when(F.col("_v") != 0, F.concat(F.lit(f" {second} "), fixed_text("_v", second_digits), F.lit("%."))).otherwise(F.lit(""))
    return one.crossJoin(F.broadcast(last)).select(F.concat("sentence", F.coalesce(more, F.lit(""))).alias("sentence"))


def balance_caption(df: DataFrame, providing: str = "providing net funding", absorbing: str = "net sterilization", date: str = "date", value: str = "value") -> DataFrame:
    """caption: a signed series' last value with its sign and what that means, and its largest and least value."""
    rows = df.where(F.col(value).isNotNull())
    a = rows.agg(F.max_by(value, date).alias("now"), F.max(date).alias("at"), F.max(value).alias("most"), F.min(value).alias("least")).where("at is not null")
    signed = lambda c: F.concat(F.when(F.col(c) >= 0, F.lit("+")).otherwise(F.lit("")), fixed_text(c, 0, grouped=True))
    what = F.when(F.col("now") > 0, providing).when(F.col("now") < 0, absorbing).otherwise("balanced")
    return a.select(F.concat(F.lit("Latest "), signed("now"), F.lit(" ("), F.date_format("at", "yyyy-MM-dd"), F.lit("), "), what, F.lit(". Peak "), signed("most"), F.lit("; trough "), signed("least"), F.lit(".")).alias("caption"))


def four_week_caption(df: DataFrame, subject: str, date: str = "period_date", value: str = "value") -> DataFrame:
    """caption: a weekly series' last value and its change against four rows before; no row with fewer than five."""
    w = W.orderBy(F.desc(date))
    top = df.orderBy(F.desc(date)).limit(5).select(date, value, F.row_number().over(w).alias("n"))
    ends = top.agg(F.count("*").alias("rows"), F.max(F.when(F.col("n") == 1, F.col(value))).alias("now"), F.max(F.when(F.col("n") == 5, F.col(value))).alias("was"), F.max(date).alias("at")).where("rows = 5")
    return ends.select(F.concat(F.lit(f"{subject} at "), fixed_text("now", 1), F.lit("% in the week of "), F.date_format("at", "yyyy-MM-dd"), F.lit(" ("), basis_points_text(F.col("now") - F.col("was")), F.lit(" over four weeks).")).alias("caption"))


def nice_step(c: Column) -> Column:
    """1, 2, 2.5, 5 or 10 times a power of ten, near the number; 1 unless it is positive."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(c)))
    part = c / power
    # The bounds between the steps.
    step = F.when(part < 1.5, 1.0).when(part < 2.25, 2.0).when(part < 3.5, 2.5).when(part < 7.5, 5.0).otherwise(10.0)
    return F.when(c > 0, step * power).otherwise(1.0)
