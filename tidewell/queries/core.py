"""Registered queries of the indicator engine on the test tables, each with SQL that gives the same rows.

Orders stand for monthly facts: the customer's segment is the entity, the order status the currency (F local, O foreign)
or the non-performing part (P); a SECTOR row sums the entities. Line items give weekly, events daily series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions import expr as E
from tidewell.operators import align, shapes
from tidewell.operators import timeseries as ts
from tidewell.plans.catalog import CURRENCIES, Metric, Where
from tidewell.plans.compiler import measure, predicate
from tidewell.plans.extended import preset
from tidewell.sources import ingest, readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_CTES = {
    "m": """f AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, c_mktsegment AS seg, o_orderstatus AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT period, seg, sum(v) AS total, sum(CASE WHEN s = 'F' THEN v END) AS tl, sum(CASE WHEN s = 'O' THEN v END) AS fx, sum(CASE WHEN s = 'P' THEN v END) AS npl FROM f GROUP BY ALL),
u AS (SELECT period, seg AS entity, total, tl, fx, npl FROM g UNION ALL SELECT period, 'SECTOR', sum(total), sum(tl), sum(fx), sum(npl) FROM g GROUP BY period),
m AS (SELECT CAST(year(period) AS INTEGER) AS year, CAST(month(period) AS INTEGER) AS month, period, entity, CAST(total AS DOUBLE) AS value, CAST(tl AS DOUBLE) AS tl, CAST(fx AS DOUBLE) AS fx, CAST(npl AS DOUBLE) AS npl FROM u)""",
    "w": """w AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS period_date, l_returnflag AS item, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)""",
    "d": """d AS (SELECT CAST(ts AS DATE) AS date, event_type AS label, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value) AS value FROM events GROUP BY ALL)""",
    "ytd": """ytd AS (SELECT year, month, period, entity, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY entity, year ORDER BY period) AS DOUBLE) AS value FROM m)""",
}


def query(name: str, sql: str, *needs: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        SQL[name] = ("WITH " + ",\n".join(_CTES[n] for n in needs) + "\n" if needs else "") + sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """year, month, period, entity, value (all), tl, fx, npl: one scan, one aggregation; SECTOR from its result."""
    v = F.col("o_totalprice").cast("decimal(18,2)")
    part = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, v))
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    g = orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy(E.month_of("o_orderdate").alias("period"), F.col("c_mktsegment").alias("entity"))
    g = g.agg(F.sum(v).alias("value"), part("F").alias("tl"), part("O").alias("fx"), part("P").alias("npl"))
    names = ["value", "tl", "fx", "npl"]
    cell = F.explode(F.array(F.col("entity"), F.lit("SECTOR"))).alias("entity")
    both = g.select("period", cell, *names).groupBy("period", "entity").agg(*(F.sum(c).alias(c) for c in names))
    return both.select(F.year("period").alias("year"), F.month("period").alias("month"), "period", "entity", *(F.col(c).cast("double").alias(c) for c in names))


def weekly(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(E.friday_of("l_shipdate").alias("period_date"), F.col("l_returnflag").alias("item")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("value"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    mean = E.ratio(F.sum(F.col("value").cast("decimal(18,4)")), F.count("value"))
    return table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("label")).agg(mean.alias("value"))


def ytd(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("entity", "year").orderBy("period")
    return monthly(spark, sf).select("year", "month", "period", "entity", F.sum(F.col("value").cast("decimal(18,2)")).over(w).cast("double").alias("value"))


BY, STD = ["entity"], ["year", "month", "period", "entity", "value"]


@query("metric_level", "SELECT year, month, period, entity, value FROM m", "m")
def _(spark, sf):
    return monthly(spark, sf).select(*STD)


@query("metric_level_currency", "SELECT period, entity, currency, value FROM (SELECT period, entity, tl AS TL, fx AS FX, value AS TOTAL FROM m) UNPIVOT (value FOR currency IN (TL, FX, TOTAL))", "m")
def _(spark, sf):
    by = Metric("level", "Level", "assets", "m", Where(), {"TL": ("tl",), "FX": ("fx",), "TOTAL": ("value",)})
    m = monthly(spark, sf).select("period", "entity", *(measure(by, c).alias(c) for c in CURRENCIES))
    return m.unpivot(["period", "entity"], list(CURRENCIES), "currency", "value").where("value is not null")


@query("metric_multi_col_sum", "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, l_returnflag AS entity, CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) + nullif(CAST(l_tax AS DECIMAL(18,2)), 0)) AS DOUBLE) AS value FROM lineitem GROUP BY ALL")
def _(spark, sf):
    v = F.col("l_quantity").cast("decimal(18,2)") + F.nullif(F.col("l_tax").cast("decimal(18,2)"), F.lit(0))
    return table(spark, sf, "lineitem").groupBy(E.month_of("l_shipdate").alias("period"), F.col("l_returnflag").alias("entity")).agg(F.sum(v).cast("double").alias("value"))


@query("available_periods", "SELECT DISTINCT year, month FROM m", "m")
def _(spark, sf):
    return table(spark, sf, "orders").select(E.month_of("o_orderdate").alias("p")).distinct().select(F.year("p").alias("year"), F.month("p").alias("month"))


@query("latest_period", "SELECT CAST(year(max(o_orderdate)) AS INTEGER) AS year, CAST(month(max(o_orderdate)) AS INTEGER) AS month FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").agg(F.max("o_orderdate").alias("d")).select(F.year("d").alias("year"), F.month("d").alias("month"))


@query("ratio_basic", "SELECT period, entity, npl / nullif(value, 0) * 100 AS value FROM m", "m")
def _(spark, sf):
    return monthly(spark, sf).select("period", "entity", E.ratio("npl", "value", 100).alias("value"))


@query("ratio_currency_operand", "SELECT period, entity, fx / nullif(value, 0) * 100 AS value FROM m", "m")
def _(spark, sf):
    return monthly(spark, sf).select("period", "entity", E.ratio("fx", "value", 100).alias("value"))


@query("ratio_guarded", "SELECT period, entity, CASE WHEN tl > 0 THEN npl / tl * 100 END AS value FROM m", "m")
def _(spark, sf):
    return monthly(spark, sf).select("period", "entity", E.guarded_ratio("npl", "tl", 100).alias("value"))


@query("fx_share_rounded", "SELECT period, entity, round_even(fx / value * 100, 2) AS value FROM m WHERE fx IS NOT NULL", "m")
def _(spark, sf):
    return monthly(spark, sf).select("period", "entity", E.half_even(E.ratio("fx", "value", 100)).alias("value")).where("value is not null")


@query("market_share", "SELECT a.period, a.entity, round_even(a.value / b.value * 100, 2) AS share FROM m a JOIN m b ON a.period = b.period AND b.entity = 'SECTOR' WHERE a.entity <> 'SECTOR'", "m")
def _(spark, sf):
    return shapes.share_of(monthly(spark, sf).select("period", "entity", "value"), "SECTOR").select("period", "entity", "share")


_LAG = "SELECT period, entity, (value - p) / p * 100 AS growth FROM (SELECT *, lag(value, {n}) OVER (PARTITION BY entity ORDER BY period) AS p FROM m) WHERE p IS NOT NULL AND p <> 0"


@query("growth_yoy", _LAG.format(n=12), "m")
def _(spark, sf):
    return ts.growth(monthly(spark, sf), 12, BY).select("period", "entity", "growth")


@query("growth_mom", _LAG.format(n=1), "m")
def _(spark, sf):
    return ts.growth(monthly(spark, sf), 1, BY).select("period", "entity", "growth")


@query("growth_yoy_calendar", "SELECT a.period, a.entity, (a.value - b.value) / b.value * 100 AS growth FROM m a JOIN m b ON a.entity = b.entity AND a.period = b.period + INTERVAL 12 MONTH", "m")
def _(spark, sf):
    return ts.growth(monthly(spark, sf), 12, BY, calendar_months=True).select("period", "entity", "growth")


_FILL = "h AS (SELECT period, entity, last_value(v IGNORE NULLS) OVER (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING) AS f FROM (SELECT *, npl AS v FROM m)), c AS (SELECT *, lag(f) OVER (PARTITION BY entity ORDER BY period) AS p FROM h)"


def _partly(spark, sf):
    """A part that months may lack: null there."""
    return monthly(spark, sf).withColumn("value", F.col("npl"))


@query("mom_ffill", "SELECT * FROM (WITH " + _FILL + " SELECT period, entity, (f - p) / p * 100 AS growth FROM c WHERE p IS NOT NULL)", "m")
def _(spark, sf):
    return ts.change_filled(_partly(spark, sf), BY).select("period", "entity", "growth")


@query("mom_annualized", "SELECT * FROM (WITH " + _FILL + " SELECT period, entity, round((pow(1 + (f - p) / p * 100 / 100, 12) - 1) * 100, 4) AS growth FROM c WHERE p IS NOT NULL)", "m")
def _(spark, sf):
    return ts.annualised(_partly(spark, sf), BY).select("period", "entity", F.round("growth", 4).alias("growth"))


@query("fees_yoy_same_month", "SELECT period, entity, (value - p) / p * 100 AS growth FROM (SELECT *, lag(value) OVER (PARTITION BY entity, month ORDER BY year) AS p FROM m) WHERE p IS NOT NULL", "m")
def _(spark, sf):
    return ts.same_month_change(monthly(spark, sf), BY).select("period", "entity", "growth")


_WG = "SELECT period_date, item, round((pow(value / p, 52.0 / {n}) - 1) * 100, 4) AS growth FROM (SELECT *, lag(value, {n}) OVER (PARTITION BY item ORDER BY period_date) AS p FROM w) WHERE p > 0 AND value > 0"


def _weekly_growth(n: int) -> None:
    @query(f"growth_weekly_{n}w", _WG.format(n=n) if n < 52 else "SELECT period_date, item, round((value / p - 1) * 100, 4) AS growth FROM (SELECT *, lag(value, 52) OVER (PARTITION BY item ORDER BY period_date) AS p FROM w) WHERE p > 0 AND value > 0", "w")
    def _(spark, sf):
        return ts.growth_annualised(weekly(spark, sf), n, ["item"], per_year=52 if n < 52 else None).select("period_date", "item", F.round("growth", 4).alias("growth"))


for _n in (4, 13, 52):
    _weekly_growth(_n)


@query("weekly_13w_scalar", "SELECT * FROM (WITH t AS (SELECT period_date, sum(value) AS value FROM w GROUP BY 1 ORDER BY 1 DESC LIMIT 14), a AS (SELECT count(*) AS n, arg_min(value, period_date) AS f, arg_max(value, period_date) AS l FROM t) SELECT round_even((l / f - 1) * 100 * 52 / 13, 2) AS simple, round_even((pow(l / f, 52.0 / 13) - 1) * 100, 2) AS compound FROM a)", "w")
def _(spark, sf):
    total = weekly(spark, sf).groupBy("period_date").agg(F.sum("value").alias("value"))
    return ts.first_last_growth(total, 13, "period_date", "value").select("simple", "compound")


@query("annualize_ytd", "SELECT period, entity, value * 12.0 / month AS value FROM ytd", "m", "ytd")
def _(spark, sf):
    return ts.annualised_ytd(ytd(spark, sf)).select("period", "entity", "value")


@query("ttm_from_ytd", "SELECT a.period, a.entity, CASE WHEN a.month = 12 THEN a.value ELSE a.value + (d.value - p.value) END AS ttm FROM ytd a LEFT JOIN ytd d ON d.entity = a.entity AND d.year = a.year - 1 AND d.month = 12 LEFT JOIN ytd p ON p.entity = a.entity AND p.year = a.year - 1 AND p.month = a.month WHERE a.month = 12 OR (d.value IS NOT NULL AND p.value IS NOT NULL)", "m", "ytd")
def _(spark, sf):
    return ts.trailing_year(ytd(spark, sf), BY).select("period", "entity", "ttm")


_ROLL = "SELECT period, entity, CASE WHEN count(value) OVER w >= {least} THEN CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(value) OVER w END AS mean FROM m WINDOW w AS (PARTITION BY entity ORDER BY period ROWS {before} PRECEDING)"


def _dec(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value").cast("decimal(18,2)"))


@query("rolling_13_min6", _ROLL.format(least=6, before=12), "m")
def _(spark, sf):
    return ts.rolling_mean(_dec(monthly(spark, sf)), 13, 6, BY).select("period", "entity", "mean")


@query("cpi_12m_avg", "SELECT * FROM (WITH y AS (SELECT date, label, value, CAST(round((value / lag(value, 3) OVER (PARTITION BY label ORDER BY date) - 1) * 100, 4) AS DECIMAL(18,4)) AS g FROM d) SELECT date, label, CASE WHEN count(g) OVER w >= 12 THEN CAST(sum(g) OVER w AS DOUBLE) / count(g) OVER w END AS mean FROM y WHERE g IS NOT NULL WINDOW w AS (PARTITION BY label ORDER BY date ROWS 11 PRECEDING))", "d")
def _(spark, sf):
    w = W.partitionBy("label").orderBy("date")
    g = daily(spark, sf).withColumn("value", F.round((E.ratio("value", F.lag("value", 3).over(w)) - 1) * 100, 4).cast("decimal(18,4)")).where("value is not null")
    return ts.rolling_mean(g, 12, 12, ["label"], order="date").select("date", "label", "mean")


@query("roe_components", """SELECT * FROM (WITH b AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, o_orderpriority AS bucket, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY ALL),
y AS (SELECT year, month, make_date(year, month, 1) AS period, bucket, CAST(sum(v) OVER (PARTITION BY bucket, year ORDER BY month) AS DOUBLE) AS v FROM b),
t AS (SELECT a.period, a.bucket, CASE WHEN a.month = 12 THEN a.v ELSE a.v + (d.v - p.v) END AS ttm FROM y a LEFT JOIN y d ON d.bucket = a.bucket AND d.year = a.year - 1 AND d.month = 12 LEFT JOIN y p ON p.bucket = a.bucket AND p.year = a.year - 1 AND p.month = a.month),
e AS (SELECT period, CASE WHEN count(value) OVER w >= 6 THEN CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(value) OVER w END AS mean FROM m WHERE entity = 'SECTOR' WINDOW w AS (ORDER BY period ROWS 12 PRECEDING)),
k AS (SELECT DISTINCT period FROM t WHERE ttm IS NOT NULL ORDER BY period DESC LIMIT 3)
SELECT t.period, t.bucket, round(ttm / mean * 100, 4) AS share FROM t JOIN k USING (period) LEFT JOIN e USING (period) WHERE ttm IS NOT NULL)""", "m")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_orderpriority").alias("bucket")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    y = o.select("year", "month", E.month_start("year", "month").alias("period"), "bucket", F.sum("v").over(W.partitionBy("bucket", "year").orderBy("month")).cast("double").alias("value"))
    t = ts.trailing_year(y, ["bucket"])
    equity = ts.rolling_mean(_dec(monthly(spark, sf).where("entity = 'SECTOR'")), 13, 6, BY).select("period", "mean")
    last = t.select("period").distinct().orderBy(F.desc("period")).limit(3)
    return t.join(F.broadcast(last), "period").join(equity, "period", "left").select("period", "bucket", F.round(E.ratio("ttm", "mean", 100), 4).alias("share"))


@query("asof_rate", "SELECT * FROM (WITH l AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), r AS (SELECT period_date, value FROM w WHERE item = 'R') SELECT l.date, r.value AS rate FROM l ASOF LEFT JOIN r ON l.date >= r.period_date)", "w")
def _(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    right = weekly(spark, sf).where("item = 'R'").select(F.col("period_date").alias("date"), "value")
    return align.asof(left, right, "date", "value", out="rate").select("date", "rate")


@query("calendar_ffill", "SELECT * FROM (WITH s AS (SELECT item, period_date, value FROM w WHERE period_date BETWEEN DATE '1995-03-01' AND DATE '1996-02-28'), k AS (SELECT item, CAST(unnest(range(DATE '1995-03-01', DATE '1996-02-29', INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT item FROM s)) SELECT k.item, k.date, s.value FROM k ASOF JOIN s ON s.item = k.item AND k.date >= s.period_date)", "w")
def _(spark, sf):
    return align.fill_daily(weekly(spark, sf).withColumnRenamed("period_date", "date"), "1995-03-01", "1996-02-28", ["item"]).select("item", "date", "value")


@query("spread", "SELECT a.date, a.value - b.value AS spread FROM d a JOIN d b ON a.date = b.date WHERE a.label = 'purchase' AND b.label = 'click'", "d")
def _(spark, sf):
    return align.spread_of(daily(spark, sf), "label", "purchase", "click", ["date"])


@query("lookup_month_end_rate", "SELECT * FROM (WITH q AS (SELECT CAST(l_shipdate AS DATE) AS date, min(l_discount) AS value FROM lineitem WHERE l_discount > 0 GROUP BY 1), r AS (SELECT CAST(date_trunc('month', date) AS DATE) AS period, arg_max(value, date) AS rate FROM q GROUP BY 1) SELECT m.period, m.entity, m.value, r.rate FROM m LEFT JOIN r USING (period))", "m")
def _(spark, sf):
    q = table(spark, sf, "lineitem").where("l_discount > 0").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.min("l_discount").alias("value"))
    return monthly(spark, sf).select("period", "entity", "value").join(align.month_end(q), "period", "left")


@query("fx_adjusted_growth", "SELECT * FROM (WITH r AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) + 1 AS rate FROM lineitem GROUP BY 1), x AS (SELECT period, entity, tl, fx, rate, lag(tl, 12) OVER w AS l0, lag(fx, 12) OVER w AS f0, lag(rate, 12) OVER w AS r0 FROM m JOIN r USING (period) WINDOW w AS (PARTITION BY entity ORDER BY period)) SELECT period, entity, round(((tl + fx) - (l0 + f0)) / (l0 + f0) * 100, 4) AS growth_nominal, round((tl + fx / rate * r0 - (l0 + f0)) / (l0 + f0) * 100, 4) AS growth_adjusted FROM x WHERE tl + fx + l0 + f0 + rate + r0 IS NOT NULL)", "m")
def _(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(E.month_of("l_shipdate").alias("period")).agg((E.ratio(F.sum(F.col("l_discount").cast("decimal(18,2)")), F.count("*")) + 1).alias("rate"))
    got = ts.rate_adjusted_growth(monthly(spark, sf).join(r, "period"), 12, BY, "tl", "fx", "rate")
    return got.select("period", "entity", F.round("growth_nominal", 4).alias("growth_nominal"), F.round("growth_adjusted", 4).alias("growth_adjusted"))


@query("net_reserves", "SELECT * FROM (WITH a AS (SELECT date, value FROM d WHERE label = 'purchase'), l AS (SELECT date, value FROM d WHERE label = 'view'), r AS (SELECT date, value FROM d WHERE label = 'click'), j AS (SELECT a.date, a.value - l.value AS net FROM a JOIN l USING (date)) SELECT j.date, round(net / r.value, 6) AS net FROM j ASOF JOIN r ON j.date >= r.date)", "d")
def _(spark, sf):
    d = daily(spark, sf)
    net = align.spread_of(d, "label", "purchase", "view", ["date"], out="net")
    return align.asof(net, d.where("label = 'click'").select("date", "value"), "date", "value", out="rate").where("rate is not null").select("date", F.round(E.ratio("net", "rate"), 6).alias("net"))


@query("latest_snapshot", "SELECT year, month, period, entity, value FROM m WHERE period = (SELECT max(period) FROM m)", "m")
def _(spark, sf):
    return shapes.latest(monthly(spark, sf).select(*STD), by=BY)


_KPI = "SELECT entity, period, value, previous, value - previous AS change, (value - previous) / nullif(abs(previous), 0) * 100 AS change_percent FROM (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY period) AS previous, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS n FROM m) WHERE n = 1"


@query("kpi_summary", _KPI, "m")
def _(spark, sf):
    return shapes.kpi(monthly(spark, sf).select("entity", "period", "value"), BY)


@query("metric_summary", f"SELECT * FROM (WITH k AS ({_KPI}) SELECT a.entity, a.n, a.least, a.largest, a.mean, k.period AS last_period, k.value AS last_value, CASE WHEN previous = 0 THEN 0.0 ELSE (k.value - previous) / previous * 100 END AS change_percent FROM (SELECT entity, count(value) AS n, min(value) AS least, max(value) AS largest, CAST(sum(CAST(value AS DECIMAL(28,2))) AS DOUBLE) / count(value) AS mean FROM m GROUP BY 1) a JOIN k USING (entity))", "m")
def _(spark, sf):
    return shapes.summary(monthly(spark, sf).select("entity", "period", "value"), BY)


@query("comparison_pivot", "SELECT entity, value AS total_loans, npl AS npl_amount, fx AS fx_loans FROM m WHERE period = (SELECT max(period) FROM m)", "m")
def _(spark, sf):
    last = shapes.latest(monthly(spark, sf), by=BY).select("entity", F.col("value").alias("total_loans"), F.col("npl").alias("npl_amount"), F.col("fx").alias("fx_loans"))
    names = ["total_loans", "npl_amount", "fx_loans"]
    return shapes.comparison(last.unpivot(["entity"], names, "metric_id", "value"), names)


@query("pivot_sum_ratio", "SELECT period_date, CASE WHEN count(CASE WHEN item = 'R' THEN 1 END) > 0 THEN coalesce(sum(CASE WHEN item = 'R' THEN value END), 0) END AS R, CASE WHEN count(CASE WHEN item = 'N' THEN 1 END) > 0 THEN coalesce(sum(CASE WHEN item = 'N' THEN value END), 0) END AS N, round(sum(CASE WHEN item = 'R' THEN value END) / sum(CASE WHEN item = 'N' THEN value END) * 100, 4) AS share FROM w GROUP BY 1", "w")
def _(spark, sf):
    return shapes.pivot_sum(weekly(spark, sf), ["period_date"], "item", ["R", "N"]).withColumn("share", F.round(E.ratio("R", "N", 100), 4))


@query("leader_laggard", "SELECT period, min(CASE WHEN value = hi THEN entity END) AS leader, max(value) AS leader_value, min(CASE WHEN value = lo THEN entity END) AS laggard, min(value) AS laggard_value FROM (SELECT *, max(value) OVER (PARTITION BY period) AS hi, min(value) OVER (PARTITION BY period) AS lo FROM m WHERE entity <> 'SECTOR') GROUP BY 1", "m")
def _(spark, sf):
    return shapes.leader_laggard(monthly(spark, sf).where("entity <> 'SECTOR'"), ["period"])


@query("top_n_latest", "SELECT period_date, item, value FROM w ORDER BY period_date DESC, item LIMIT 22", "w")
def _(spark, sf):
    return weekly(spark, sf).orderBy(F.desc("period_date"), "item").limit(22)


@query("long_union", "SELECT label, period, value FROM (SELECT 'loans' AS label, period, value FROM m WHERE entity = 'SECTOR' UNION ALL SELECT 'npl', period, npl FROM m WHERE entity = 'SECTOR')", "m")
def _(spark, sf):
    m = monthly(spark, sf).where("entity = 'SECTOR'")
    return align.labelled({"loans": m.select("period", "value"), "npl": m.select("period", F.col("npl").alias("value"))}).select("label", "period", "value")


@query("sum_of_parts", "SELECT period, CAST(sum(value) AS DOUBLE) AS value FROM (SELECT period, entity, CAST(value AS DECIMAL(18,2)) AS value FROM m WHERE entity IN ('BUILDING', 'MACHINERY')) GROUP BY period HAVING count(DISTINCT entity) = 2", "m")
def _(spark, sf):
    return shapes.sum_of_all(_dec(monthly(spark, sf)), ["BUILDING", "MACHINERY"], ["period"], name="entity").withColumn("value", F.col("value").cast("double"))


@query("change_since_first", "SELECT entity, first, last, (last - first) / first * 100 AS change FROM (SELECT entity, arg_min(value, period) AS first, arg_max(value, period) AS last FROM m GROUP BY 1)", "m")
def _(spark, sf):
    return ts.since_first(monthly(spark, sf), BY)


@query("peak_with_date", "SELECT entity, max(value) AS peak, min(CASE WHEN value = hi THEN period END) AS peak_at, min(value) AS low, min(CASE WHEN value = lo THEN period END) AS low_at FROM (SELECT *, max(value) OVER (PARTITION BY entity) AS hi, min(value) OVER (PARTITION BY entity) AS lo FROM m) GROUP BY 1", "m")
def _(spark, sf):
    return ts.peaks(monthly(spark, sf), BY)


@query("resample_monthly", "SELECT label, CAST(date_trunc('week', date) AS DATE) AS period, max(value) AS largest, min(value) AS least, arg_max(value, date) AS last, arg_min(value, date) AS first, round(avg(value), 6) AS mean FROM d GROUP BY ALL", "d")
def _(spark, sf):
    got = ts.resampled(daily(spark, sf), "week", ["label"], {"largest": "max", "least": "min", "last": "last", "first": "first", "mean": "avg"})
    return got.withColumn("mean", F.round("mean", 6))


_CAPTION = """WITH g AS (SELECT period, entity, (value - p) / p * 100 AS growth FROM (SELECT *, lag(value, 12) OVER (PARTITION BY entity ORDER BY period) AS p FROM m) WHERE p <> 0), k AS (SELECT entity, growth, lag(growth) OVER (PARTITION BY entity ORDER BY period) AS b, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS n FROM g)"""


@query("caption_growth", f"SELECT * FROM ({_CAPTION} SELECT entity, 'Growth ' || CASE WHEN growth - b > 0.1 THEN 'accelerated' WHEN growth - b < -0.1 THEN 'eased' ELSE 'held' END || ' to ' || format('{{:.1f}}', growth) || '% from ' || format('{{:.1f}}', b) || '%' AS caption FROM k WHERE n = 1 AND b IS NOT NULL)", "m")
def _(spark, sf):
    return shapes.growth_caption(ts.growth(monthly(spark, sf), 12, BY), BY)


@query("caption_level", "SELECT entity, CASE WHEN abs(value / 1e6) >= 1e6 THEN format('{:.2f}T TL', value / 1e6 / 1e6) WHEN abs(value / 1e6) >= 1e3 THEN format('{:.1f}B TL', value / 1e6 / 1e3) ELSE format('{:.0f}M TL', value / 1e6) END || ' in ' || strftime(period, '%Y-%m') AS caption FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY period DESC) AS n, count(*) OVER (PARTITION BY entity) AS c FROM m) WHERE n = 1 AND c > 1", "m")
def _(spark, sf):
    return shapes.level_caption(monthly(spark, sf), BY)


@query("ascii_like_filter", "SELECT p_partkey, p_type FROM part WHERE lower(p_type) LIKE '%steel%'")
def _(spark, sf):
    return table(spark, sf, "part").where(E.ascii_like("p_type", "%steel%")).select("p_partkey", "p_type")


@query("not_like_filter", "SELECT p_partkey, p_type FROM part WHERE lower(p_type) LIKE '%brass%' AND lower(p_type) NOT LIKE 'small%'")
def _(spark, sf):
    return table(spark, sf, "part").withColumn("item_name", F.col("p_type")).where(predicate(Where(("%BRASS%",), ("SMALL%",)))).select("p_partkey", "p_type")


@query("or_precedence_compat", "SELECT p_partkey, p_type, p_size FROM part WHERE lower(p_type) LIKE '%tin%' OR (lower(p_type) LIKE '%steel%' AND p_size < 10)")
def _(spark, sf):
    p = table(spark, sf, "part").withColumn("item_name", F.col("p_type"))
    return p.where(predicate(Where(("%TIN%", "%STEEL%")), F.col("p_size") < 10, or_precedence=True)).select("p_partkey", "p_type", "p_size")


@query("ratio_category_case", "SELECT p_partkey, CASE WHEN lower(p_name) LIKE '%takip%' OR lower(p_name) LIKE '%npl%' THEN 'asset_quality' WHEN lower(p_name) LIKE '%karlılık%' OR lower(p_name) LIKE '%roa%' OR lower(p_name) LIKE '%roe%' THEN 'profitability' WHEN lower(p_name) LIKE '%likidite%' OR lower(p_name) LIKE '%liquid%' THEN 'liquidity' WHEN lower(p_name) LIKE '%sermaye%' OR lower(p_name) LIKE '%capital%' OR lower(p_name) LIKE '%car%' THEN 'capital' ELSE 'other' END AS ratio_category FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", E.ratio_category("p_name").alias("ratio_category"))


@query("json_extract", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", readers.json_number("props", "k").alias("k"))


@query("date_parse_format", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m') AS ym, strftime(o_orderdate, '%d.%m.%Y') AS dmy FROM orders")
def _(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    text = F.concat_ws(".", F.day("d").cast("string"), F.date_format("d", "MM.yyyy"))
    return d.select(F.try_to_date(text, "d.MM.yyyy").alias("d"), F.date_format("d", "yyyy-MM").alias("ym"), F.date_format("d", "dd.MM.yyyy").alias("dmy"))


@query("snap_saturday", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - CAST((isodow(o_orderdate) + 1) % 7 AS INTEGER) AS saturday FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct().withColumn("saturday", E.last_saturday("d"))


@query("number_format", "SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN format('{:.2f}T TL', o_totalprice / 1e6) WHEN o_totalprice >= 1e3 THEN format('{:.1f}B TL', o_totalprice / 1e3) ELSE format('{:.0f}M TL', o_totalprice) END AS amount FROM orders")
def _(spark, sf):
    # Doubles are rounded by their exact binary value, true ties to even, on both sides.
    return table(spark, sf, "orders").select("o_orderkey", E.amount_text("o_totalprice").alias("amount"))


@query("number_format_all", "SELECT o_orderkey, CASE WHEN abs(o_totalprice) >= 1e6 THEN format('{:.2f}T TL', o_totalprice / 1e6) WHEN abs(o_totalprice) >= 1e3 THEN format('{:.1f}B TL', o_totalprice / 1e3) ELSE format('{:,.0f}M TL', o_totalprice) END AS amount FROM orders")
def _(spark, sf):
    # Every order. Doubles are rounded by their exact binary value, true ties to even, on both sides.
    return table(spark, sf, "orders").select("o_orderkey", E.amount_text("o_totalprice").alias("amount"))


@query("upsert_latest", "SELECT user_id, event_type, day, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM (SELECT *, CAST(ts AS DATE) AS day FROM events) GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"), "value", "event_id")
    first, second = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    keys = ["user_id", "event_type", "day"]
    return ingest.upsert(ingest.upsert(ingest.upsert(None, first, keys, "event_id"), second, keys, "event_id"), second, keys, "event_id")


@query("eav_unpivot", "SELECT p_partkey, column_name, value_text, TRY_CAST(value_text AS DOUBLE) AS value_numeric FROM (SELECT p_partkey, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part) UNPIVOT (value_text FOR column_name IN (p_brand, p_type, p_size)) WHERE value_text <> ''")
def _(spark, sf):
    cells = F.create_map(*(x for c in ("p_name", "p_brand", "p_type", "p_size") for x in (F.lit(c), F.col(c).cast("string"))))
    return readers.unpivoted(table(spark, sf, "part").select("p_partkey", cells.alias("cells")), ["p_name"])


@query("sanity_filter", "SELECT event_id, value FROM events WHERE value IS NULL OR abs(value) < 50")
def _(spark, sf):
    return ingest.sane(table(spark, sf, "events").select("event_id", "value"), limit=50)


@query("coalesce_truthy", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0), nullif(l_tax, 0), l_quantity) AS value FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", E.first_truthy("l_discount", "l_tax", "l_quantity").alias("value"))


@query("incremental_missing_periods", "SELECT CAST(unnest(range(DATE '1994-06-01', DATE '1996-01-01', INTERVAL 1 MONTH)) AS DATE) AS period EXCEPT SELECT period FROM m", "m")
def _(spark, sf):
    return ingest.missing_months(table(spark, sf, "orders").select(E.month_of("o_orderdate").alias("period")), "1994-06-01", "1995-12-01")


@query("month_sequence", "SELECT CAST(unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS DATE) AS period FROM (SELECT CAST(date_trunc('month', min(o_orderdate)) AS DATE) AS a, CAST(date_trunc('month', max(o_orderdate)) AS DATE) AS b FROM orders)")
def _(spark, sf):
    ends = table(spark, sf, "orders").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return ends.select(F.explode(F.sequence(E.month_of("a"), E.month_of("b"), F.expr("interval 1 month"))).alias("period"))


@query("weekly_anchors", "SELECT CAST(unnest(generate_series(CAST(b AS TIMESTAMP), CAST(a AS TIMESTAMP), INTERVAL (-91) DAY)) AS DATE) AS anchor FROM (SELECT min(period_date) AS a, max(period_date) AS b FROM w)", "w")
def _(spark, sf):
    ends = table(spark, sf, "lineitem").agg(E.friday_of(F.min("l_shipdate")).alias("a"), E.friday_of(F.max("l_shipdate")).alias("b"))
    return ends.select(F.explode(ingest.anchors("b", "a")).alias("anchor"))


@query("code_remap", "SELECT s_suppkey, CASE code WHEN '10003' THEN '10007' WHEN '10004' THEN '10006' WHEN '10005' THEN '10009' WHEN '10006' THEN '10010' WHEN '10007' THEN '10008' WHEN '10008' THEN '10004' WHEN '10009' THEN '10005' WHEN '10010' THEN '10003' ELSE code END AS bank_type_code FROM (SELECT s_suppkey, CAST(10000 + s_suppkey % 12 AS VARCHAR) AS code FROM supplier)")
def _(spark, sf):
    return ingest.recoded(table(spark, sf, "supplier").select("s_suppkey", (F.lit(10000) + F.col("s_suppkey") % 12).cast("string").alias("bank_type_code")))


@query("filter_from_preset", "SELECT period, entity, value FROM m WHERE period >= (SELECT max(period) FROM m) - INTERVAL 12 MONTH", "m")
def _(spark, sf):
    return preset(monthly(spark, sf).select("period", "entity", "value"), "1Y")


@query("dedupe_keep_first", "SELECT label, date, value FROM (SELECT *, row_number() OVER (PARTITION BY label, date ORDER BY part) AS n FROM (SELECT 1 AS part, label, date, value FROM d WHERE date <= DATE '2024-01-20' UNION ALL SELECT 2, label, date, value * 2 FROM d WHERE date >= DATE '2024-01-10')) WHERE n = 1", "d")
def _(spark, sf):
    d = daily(spark, sf)
    return align.stitched([d.where("date <= '2024-01-20'"), d.where("date >= '2024-01-10'").withColumn("value", F.col("value") * 2)], keys=["label"]).select("label", "date", "value")


# Report derivations: several series at once, in one pass where they share a table.


@query("npl_ratio_by_product", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderpriority AS product, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) / CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) * 100 AS npl_ratio FROM orders GROUP BY ALL")
def _(spark, sf):
    v = F.col("o_totalprice").cast("decimal(18,2)")
    g = table(spark, sf, "orders").groupBy(E.month_of("o_orderdate").alias("period"), F.col("o_orderpriority").alias("product"))
    return g.agg(F.sum(F.when(F.col("o_orderstatus") == "P", v)).alias("a"), F.sum(v).alias("b")).select("period", "product", E.guarded_ratio("a", "b", 100).alias("npl_ratio"))


@query("ratio_of_differences", "SELECT period_date, round((R - N) / nullif(A - N, 0) * 100, 4) + 0.0 AS share FROM (SELECT period_date, sum(CASE WHEN item = 'R' THEN value END) AS R, sum(CASE WHEN item = 'N' THEN value END) AS N, sum(CASE WHEN item = 'A' THEN value END) AS A FROM w GROUP BY 1)", "w")
def _(spark, sf):
    p = shapes.pivot_sum(weekly(spark, sf), ["period_date"], "item", ["R", "N", "A"])
    return p.select("period_date", (F.round(E.ratio(F.col("R") - F.col("N"), F.col("A") - F.col("N"), 100), 4) + F.lit(0.0)).alias("share"))


@query("corridor_width", "SELECT max(CASE WHEN label = 'purchase' THEN value END) - max(CASE WHEN label = 'click' THEN value END) AS width FROM d WHERE date = (SELECT max(date) FROM d WHERE label IN ('purchase', 'click'))", "d")
def _(spark, sf):
    ends = shapes.latest(daily(spark, sf).where("label in ('purchase', 'click')"), "date", by=["label"])
    return ends.agg((F.max(F.when(F.col("label") == "purchase", F.col("value"))) - F.max(F.when(F.col("label") == "click", F.col("value")))).alias("width"))


@query("stack_total_latest", "SELECT date, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM d WHERE value IS NOT NULL GROUP BY date QUALIFY date = max(date) OVER ()", "d")
def _(spark, sf):
    total = daily(spark, sf).where("value is not null").groupBy("date").agg(F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))
    return shapes.latest(total, "date", by=[])


@query("share_with_peak", "SELECT entity, max(v) AS peak, min(CASE WHEN v = hi THEN period END) AS peak_at FROM (SELECT *, max(v) OVER (PARTITION BY entity) AS hi FROM (SELECT entity, period, fx / value * 100 AS v FROM m WHERE fx IS NOT NULL)) GROUP BY 1", "m")
def _(spark, sf):
    share = monthly(spark, sf).select("entity", "period", E.ratio("fx", "value", 100).alias("value"))
    return ts.peaks(share, BY).select("entity", "peak", "peak_at")


@query("yield_minus_cost", "SELECT period, entity, npl * 12.0 / month / nullif(value, 0) * 100 - tl * 12.0 / month / nullif(value, 0) * 100 AS spread FROM m", "m")
def _(spark, sf):
    year = lambda c: E.ratio(F.col(c) * F.lit(12.0) / F.col("month"), "value", 100)
    return monthly(spark, sf).select("period", "entity", (year("npl") - year("tl")).alias("spread"))


@query("threshold_flags", "SELECT period, entity, npl / nullif(value, 0) * 100 AS value, npl / nullif(value, 0) * 100 < 12 AS below_floor FROM m", "m")
def _(spark, sf):
    return monthly(spark, sf).select("period", "entity", E.ratio("npl", "value", 100).alias("value")).withColumn("below_floor", F.col("value") < 12)


@query("change_vs_four_rows_ago", "SELECT item, period_date, value, value - p AS change FROM (SELECT *, lag(value, 4) OVER (PARTITION BY item ORDER BY period_date) AS p, row_number() OVER (PARTITION BY item ORDER BY period_date DESC) AS n FROM w) WHERE n = 1 AND p IS NOT NULL", "w")
def _(spark, sf):
    o = W.partitionBy("item").orderBy("period_date")
    got = weekly(spark, sf).withColumns({"p": F.lag("value", 4).over(o), "n": F.row_number().over(W.partitionBy("item").orderBy(F.desc("period_date")))})
    return got.where("n = 1 and p is not null").select("item", "period_date", "value", (F.col("value") - F.col("p")).alias("change"))
