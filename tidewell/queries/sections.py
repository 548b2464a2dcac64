"""Registered queries of the report sections: signed stretches, margin parts, narratives, captions, units, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions import expr as E
from tidewell.operators import shapes
from tidewell.operators.runs import signed_runs
from tidewell.plans import catalog, panels
from tidewell.plans import extended as X
from tidewell.queries.core import _CTES, daily, monthly, query, table, weekly
from tidewell.queries.sheets import _ALL, _BS, _ORDER, _PRIMARY, LINE_CODES, _order_cells, _orders, _pick, _ratio_sql, _raw, _shown, _standard, engine
from tidewell.sources import writers
from tidewell.sources.shared import scratch_path
from tidewell.streaming import windows

# Signed stretches.

_CTES["wd"] = "wd AS (SELECT item, period_date, value - p AS value FROM (SELECT *, lag(value) OVER (PARTITION BY item ORDER BY period_date) AS p FROM w) WHERE p IS NOT NULL)"


def _weekly_change(spark, sf) -> DataFrame:
    was = F.lag("value").over(W.partitionBy("item").orderBy("period_date"))
    return weekly(spark, sf).withColumn("value", F.col("value") - was).where("value is not null")


_RUNS = "SELECT * FROM (WITH r AS (SELECT *, CAST(sign(value) AS INTEGER) AS s, row_number() OVER (PARTITION BY item ORDER BY period_date) - row_number() OVER (PARTITION BY item, sign(value) ORDER BY period_date) AS g, max(period_date) OVER (PARTITION BY item) AS last FROM wd) SELECT item, s AS sign, min(period_date) AS start, max(period_date) AS \"end\", count(*) AS n, arg_max(value, (abs(value), -epoch_us(period_date::TIMESTAMP))) AS peak, arg_max(period_date, (abs(value), -epoch_us(period_date::TIMESTAMP))) AS peak_at, max(period_date) = any_value(last) AS open FROM r GROUP BY item, s, g)"


@query("signed_runs", _RUNS, "w", "wd")
def _(spark, sf):
    return signed_runs(_weekly_change(spark, sf), ["item"], "period_date", cut="year")


_SIGNED = "CASE WHEN {0} >= 0 THEN '+' ELSE '' END || format('{{:,}}', CAST({0} AS BIGINT))"
_MEANS = "CASE WHEN now > 0 THEN 'providing net funding' WHEN now < 0 THEN 'net sterilization' ELSE 'balanced' END"


@query("net_funding_caption", f"SELECT 'Latest ' || {_SIGNED.format('now')} || ' (' || strftime(d, '%Y-%m-%d') || '), ' || {_MEANS} || '. Peak ' || {_SIGNED.format('hi')} || '; trough ' || {_SIGNED.format('lo')} || '.' AS caption FROM (SELECT arg_max(value, period_date) AS now, max(period_date) AS d, max(value) AS hi, min(value) AS lo FROM wd WHERE item = 'R')", "w", "wd")
def _(spark, sf):
    return panels.balance_caption(_weekly_change(spark, sf).where("item = 'R'"), date="period_date")


# The interest margin: income lines from line items, the published yield from orders.

_CTES |= {
    "inc_lines": "inc AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, unnest(['10001', CASE l_linenumber " + " ".join(f"WHEN {i + 1} THEN '{c}'" for i, c in enumerate(LINE_CODES)) + " END]) AS bank_type_code, CAST(ceil(l_quantity / 2) AS INTEGER) AS item_order, CASE WHEN ceil(l_quantity / 2) BETWEEN 16 AND 22 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_total FROM lineitem)",
    "yields": "yields AS (SELECT year, month, bank_type_code, CAST(sum(v) AS DOUBLE) / count(*) / 10000 AS y FROM o GROUP BY ALL)",
}


def _margin_engine(spark, sf) -> X.Store:
    li = table(spark, sf, "lineitem")
    order = F.ceil(F.col("l_quantity") / 2).cast("int")
    amount = F.when(order.between(16, 22), -1).otherwise(1) * F.col("l_extendedprice").cast("decimal(18,2)")
    codes = F.explode(F.array(F.lit("10001"), F.element_at(F.array(*map(F.lit, LINE_CODES)), F.col("l_linenumber")))).alias("bank_type_code")
    income = li.select(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), codes, order.alias("item_order"), F.lit("line").alias("item_name"), amount.alias("amount_total"))
    rates = _orders(spark, sf).groupBy("year", "month", "bank_type_code").agg((E.ratio(F.sum("v"), F.count("*")) / 10000).alias("ratio_value"))
    rates = rates.withColumns({"table_number": F.lit(15), "item_name": F.lit(X.EARNING_YIELD.rstrip("%") + " (%)")})
    return X.Store({"income_statement": income, "financial_ratios": rates})


def _margin_sql() -> str:
    parts = {label: " + ".join(f"coalesce(v{o}, 0)" for o in orders) for label, orders in X.NIM.items()}
    there = {label: " + ".join(f"n{o}" for o in orders) for label, orders in X.NIM.items()}
    parts["Other income"] = f"v15 - ({' + '.join(parts[x] for x in ('Loans', 'Securities', 'Banks/MM'))})"
    parts["Margin"] = f"v15 + ({parts['Deposits']} + {parts['Debt issued']})"
    lines = [15, *(o for orders in X.NIM.values() for o in orders)]
    wide = "SELECT year, month, bank_type_code, " + ", ".join(f"CAST(sum(CASE WHEN item_order = {o} THEN amount_total END) AS DOUBLE) AS v{o}, count(CASE WHEN item_order = {o} THEN 1 END) AS n{o}" for o in lines) + f" FROM inc WHERE {_PRIMARY} GROUP BY ALL"
    cells = " UNION ALL ".join(f"SELECT '{label}' AS label, year, month, bank_type_code, ({amount}) * 12.0 / month / assets * 100 AS value FROM x WHERE {there.get(label, '1')} > 0" for label, amount in parts.items())
    return f"SELECT label, period, bank_type_code, bank_type, round(value, 6) AS value FROM (WITH x AS (SELECT *, v15 * 12.0 / month / y * 100 AS assets FROM ({wide}) JOIN yields USING (year, month, bank_type_code) WHERE n15 > 0 AND v15 > 0) {_standard(cells, 'label, ')})"


@query("margin_components", _margin_sql(), "names", "o", "inc_lines", "yields")
def _(spark, sf):
    return _shown(_margin_engine(spark, sf).margin_components(), "label").withColumn("value", F.round("value", 6))


@query("real_policy_rate", "SELECT a.date, round(((1 + a.value / 100) / (1 + b.value / 100) - 1) * 100, 6) AS value FROM d a JOIN d b ON a.date = b.date WHERE a.label = 'purchase' AND b.label = 'click' AND a.value IS NOT NULL AND b.value IS NOT NULL", "d")
def _(spark, sf):
    d = daily(spark, sf)
    return engine(spark, sf).real_rate(d.where("label = 'purchase'"), d.where("label = 'click'")).select("date", F.round("value", 6).alias("value"))


_CTES["roe_rows"] = f"rr AS (SELECT year, month, bank_type_code, CAST(sum(v) AS DOUBLE) / count(*) / 10000 AS ratio_value FROM o WHERE {_PRIMARY} GROUP BY ALL)"


@query("return_and_inflation", "SELECT period, bank_type AS series, round(ratio_value * 12.0 / month, 6) AS value FROM (SELECT *, make_date(year, month, 1) AS period FROM rr) JOIN names USING (bank_type_code) UNION ALL SELECT period, 'CPI 12m avg', round(mean, 6) FROM (SELECT period, avg(g) OVER w AS mean, count(g) OVER w AS n FROM (SELECT period, (value / lag(value, 12) OVER (ORDER BY period) - 1) * 100 AS g FROM m WHERE entity = 'SECTOR') WHERE g IS NOT NULL WINDOW w AS (ORDER BY period ROWS 11 PRECEDING)) WHERE n = 12", "names", "o", "roe_rows", "m")
def _(spark, sf):
    rows = _orders(spark, sf).groupBy("year", "month", "bank_type_code").agg((E.ratio(F.sum("v"), F.count("*")) / 10000).alias("ratio_value"))
    rows = rows.withColumns({"table_number": F.lit(15), "item_name": F.lit(X.PUBLISHED["roe_ytd"].rstrip("%") + " (%)")})
    got = X.Store({"financial_ratios": rows}).return_and_inflation(monthly(spark, sf).where("entity = 'SECTOR'").select("period", "value"))
    return got.select("period", "series", F.round("value", 6).alias("value"))


# Narratives of two facts.


def _two_sql(first: str, second: str, subject: str, name: str, digits: int, more: int) -> str:
    one = f"k AS (SELECT *, lag(value) OVER (ORDER BY period) AS p, row_number() OVER (ORDER BY period DESC) AS n FROM ({_ratio_sql(first)}) WHERE bank_type_code = '10001')"
    two = f"s AS (SELECT arg_max(value, period) AS v FROM ({_ratio_sql(second)}) WHERE bank_type_code = '10001' AND value IS NOT NULL)"
    bps = "CAST(round_even(coalesce(value - p, 0) * 100, 0) AS BIGINT)"
    return f"SELECT * FROM (WITH {one}, {two} SELECT '{subject} at ' || format('{{:.{digits}f}}', value) || '% in ' || strftime(period, '%Y-%m') || ' (' || CASE WHEN {bps} > 0 THEN '+' ELSE '' END || {bps} || 'bps MoM).' || CASE WHEN v <> 0 THEN ' {name} ' || format('{{:.{more}f}}', v) || '%.' ELSE '' END AS sentence FROM k, s WHERE n = 1)"


@query("narrative_deposits", _two_sql("loan_to_deposit_ratio", "demand_deposit_share", "Loan-to-deposit ratio", "Demand-deposit share at", 1, 1), *_ALL)
def _(spark, sf):
    e = engine(spark, sf)
    return panels.narrative_of_two(e.ratio("loan_to_deposit_ratio"), e.ratio("demand_deposit_share"), "Loan-to-deposit ratio", "Demand-deposit share at")


@query("narrative_asset_quality", _two_sql("npl_ratio", "equity_ratio", "NPL ratio", "Coverage at", 2, 0), *_ALL)
def _(spark, sf):
    e = engine(spark, sf)
    return panels.narrative_of_two(e.ratio("npl_ratio"), e.ratio("equity_ratio"), "NPL ratio", "Coverage at", 2, 0)


# Items that had no query.

_BULLETIN = dict(enumerate([*X.WEEKLY_13W.values(), "Diğer"], 1))
_CTES["bulletin"] = "bulletin AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS period_date, CASE l_linenumber " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in _BULLETIN.items()) + " END AS item_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_value FROM lineitem GROUP BY ALL)"
_CTES["growth_names"] = "growth_names(metric_id, name) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in X.WEEKLY_13W.items()) + ")"


@query("weekly_growth_13w", "SELECT * FROM (WITH t AS (SELECT * FROM bulletin ORDER BY period_date DESC, item_name LIMIT 308), a AS (SELECT metric_id, min(period_date) AS start_date, max(period_date) AS end_date, arg_min(total_value, (period_date, item_name)) AS start_value, arg_max(total_value, (period_date, item_name)) AS end_value, count(*) AS weeks FROM t JOIN growth_names ON contains(item_name, name) GROUP BY 1) SELECT metric_id, start_date, end_date, start_value, end_value, weeks, round_even((end_value / start_value - 1) * 100, 2) AS growth_13w_simple, round_even((pow(end_value / start_value, 4.0) - 1) * 100, 2) AS growth_13w_annualized FROM a WHERE weeks >= 14)", "bulletin", "growth_names")
def _(spark, sf):
    names = F.element_at(F.create_map(*(x for i, n in _BULLETIN.items() for x in (F.lit(i), F.lit(n)))), F.col("l_linenumber")).alias("item_name")
    rows = table(spark, sf, "lineitem").groupBy(E.friday_of("l_shipdate").alias("period_date"), names).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total_value"))
    return X.Store({"weekly_bulletin": rows.withColumn("category", F.lit("krediler"))}).weekly_growth_13w()


_CET1 = X.CET1[1].rstrip("%")


@query("cet1", _standard(f"SELECT year, month, bank_type_code, CAST(v AS DOUBLE) / 1000 AS value FROM o WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P' AND {_PRIMARY}"), "names", "o")
def _(spark, sf):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    rows = _orders(spark, sf).select("year", "month", "bank_type_code", F.when(F.col("o_orderstatus") == "P", 13).otherwise(12).alias("table_number"), F.when(urgent, f"{_CET1} (%)").otherwise("Diğer").alias("item_name"), (F.col("v").cast("double") / 1000).alias("value_numeric"))
    return _shown(X.Store({"other_data": rows}).cet1())


@query("writer_income_statement", f"SELECT {_ORDER}, o_orderstatus = 'F' AS is_subtotal, o_totalprice AS amount_tl, CAST(o_custkey AS DOUBLE) AS amount_fx, CAST(NULL AS DOUBLE) AS amount_total FROM orders")
def _(spark, sf):
    raw = _raw(spark, sf, "orders", F.col("o_orderdate"), _order_cells(Tp=F.col("o_totalprice"), Yp=F.col("o_custkey")), 2)
    return writers.routed(raw)["income_statement"]


_FUND = "SELECT CASE label WHEN 'purchase' THEN 'cbrt_net_funding' ELSE 'cbrt_steril_total' END AS key, CASE label WHEN 'purchase' THEN 'CBRT Net Funding' ELSE 'Total Sterilization' END AS label, date, value / 1000 AS value, row_number() OVER (PARTITION BY label ORDER BY date DESC) = 1 AS is_last FROM d WHERE label IN ('purchase', 'click')"


@query("panel_registry_units", _FUND, "d")
def _(spark, sf):
    keys = {"purchase": "cbrt_net_funding", "click": "cbrt_steril_total"}
    points = daily(spark, sf).where(F.col("label").isin(*keys)).select(_pick(F.col("label"), keys).alias("key"), "date", "value")
    return panels.panel(points, {"kind": "evds_trend", "series": [{"key": k} for k in keys.values()]})


@query("metric_aggregates", f"SELECT year, month, bank_type_code, round(avg(CAST(amount_total AS DOUBLE)), 4) AS mean, min(CAST(amount_total AS DOUBLE)) AS least, max(CAST(amount_total AS DOUBLE)) AS most, count(amount_total) AS n FROM (SELECT * FROM bs WHERE item_name ILIKE '%Mevduat%' AND {_PRIMARY}) GROUP BY ALL", *_BS)
def _(spark, sf):
    kinds = {"mean": "avg", "least": "min", "most": "max", "n": "count"}
    wanted = [(name, catalog.Metric(name, name, "assets", "balance_sheet", catalog.Where(("%Mevduat%",)), {"TOTAL": ("amount_total",)}, aggregation=how), "TOTAL") for name, how in kinds.items()]
    got = engine(spark, sf).columns(wanted)
    return got.select("year", "month", "bank_type_code", F.round(F.col("mean").cast("double"), 4).alias("mean"), *(F.col(c).cast("double").alias(c) for c in ("least", "most")), "n")


@query("chart_shape", "SELECT period AS x, value AS y, entity AS series FROM m", "m")
def _(spark, sf):
    return shapes.charted(monthly(spark, sf), series="entity")


# Streams with late rows.


def _replayed(spark, sf, how, batches: int = 4) -> DataFrame:
    """The closed windows of the events as a stream: files in the order of time, from the third on with rows of the first days
    again, which come too late."""
    base = scratch_path(spark, "windows")
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (span["b"] - span["a"]) / batches
    for i in range(batches):
        own = e.where((F.col("ts") >= F.lit(span["a"] + i * step)) & ((F.col("ts") < F.lit(span["a"] + (i + 1) * step)) | F.lit(i == batches - 1)))
        late = e.where(F.col("ts") < F.lit(span["a"] + step / 4)).withColumn("value", F.col("value") + 1e6) if i > 1 else own.limit(0)
        # One file a batch, written after the one before, which is the order that the stream takes them in.
        own.unionByName(late).coalesce(1).write.option("timestampFormat", windows.TIME).json(f"{base}/in/{i}")
    windows.closed_windows(spark, f"{base}/in/*", f"{base}/out", f"{base}/log", how)
    return spark.read.schema(how(e).schema).parquet(f"{base}/out")


@query("stream_windows_replay", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def _(spark, sf):
    got = _replayed(spark, sf, windows.tumbling)
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_sessions_replay", """SELECT * FROM (WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))""")
def _(spark, sf):
    got = _replayed(spark, sf, lambda e: windows.sessions(e, "6 hours"))
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 4).alias("total"))
