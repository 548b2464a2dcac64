"""Registered queries of the catalogue engine, the named items, the store, the writers and the stream.

The test tables stand for the fact tables: an order is a balance-sheet, deposit, income or ratio row, its priority and
status name the item, its customer's segment the entity; a line item is a loan row whose quantity names the item, or a
weekly point. Every row counts for its entity and for the sector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import expr as E
from tidewell.plans import catalog, panels
from tidewell.plans import extended as X
from tidewell.plans.bulk import Definitions, bulk
from tidewell.plans.compiler import Engine
from tidewell.plans.kept import KeptStore
from tidewell.queries.core import _CTES, query, table
from tidewell.sources import ingest, readers, writers
from tidewell.sources.shared import scratch_path
from tidewell.streaming import upsert as stream
from tidewell.streaming import windows

# Item names of the stand-ins by priority and status, by priority alone, and by quantity.
SHEET = {
    ("1-URGENT", "F"): "TOPLAM AKTİFLER",
    ("1-URGENT", "O"): "Nakit Değerler",
    ("1-URGENT", "P"): "Merkez Bankasından Alacaklar",
    ("2-HIGH", "F"): "Menkul Değerler",
    ("2-HIGH", "O"): "Krediler*",
    ("2-HIGH", "P"): "Takipteki Alacaklar",
    ("3-MEDIUM", "F"): "Mevduat (Toplanan Fonlar)",
    ("3-MEDIUM", "O"): "Mevduat Faizi Reeskontu",
    ("3-MEDIUM", "P"): "Toplam ÖZKAYNAKLAR",
    ("4-NOT SPECIFIED", "F"): "Ödenmiş Sermaye",
    ("4-NOT SPECIFIED", "O"): "Yedek Akçeler",
    ("4-NOT SPECIFIED", "P"): "Dönem Karı",
    ("5-LOW", "F"): "TOPLAM YABANCI KAYNAKLAR",
    ("5-LOW", "O"): "Bankalara Borçlar",
    ("5-LOW", "P"): "Türev İşlemler - Gayrinakdi",
}
DEPOSIT = {"1-URGENT": (10, "TOPLAM MEVDUAT"), "2-HIGH": (10, X.DOMESTIC["FX"].where.equal[1][1]), "3-MEDIUM": (10, X.DOMESTIC["TL"].where.equal[1][1]), "4-NOT SPECIFIED": (9, "TOPLAM"), "5-LOW": (9, "Tasarruf")}
LINES = {"1-URGENT": 24, "2-HIGH": 34, "3-MEDIUM": 50, "4-NOT SPECIFIED": 46, "5-LOW": 27}
LOAN = [(3, "TOPLAM"), (3, "Toplam Krediler"), (4, "Tüketici Kredileri (2+3+4)"), (4, "Tüketici Kredileri - Konut"), (4, "Tüketici Kredileri - Taşıt"), (4, "Tüketici Kredileri - İhtiyaç"), (4, "Bireysel Kredi Kartları (10+11)*"), (4, "Kurumsal Kredi Kartları (28+29)"), (4, "Taksitli Ticari Krediler (20+21+22)"), (4, "Takipteki Konut Kredileri"), (4, "Takipteki Taşıt Kredileri"), (4, "Takipteki İhtiyaç Kredileri"), (4, "Takipteki Bireysel Kredi Kartları"), (6, "Toplam KOBİ Kredileri"), (6, "Mikro İşletmelere Krediler"), (6, "Küçük İşletmelere Krediler"), (6, "Orta Büyüklükteki İşletmelere Krediler"), (5, "TOPLAM"), (3, "Tarım"), (3, "tarım toplamı"), (7, "Diğer"), (7, "Enerji"), (4, "Tüketici Kredileri - Konut Döviz"), (6, "KOBİ Nakdi"), (5, "İnşaat")]
SEGMENT = {"AUTOMOBILE": "10003", "BUILDING": "10004", "FURNITURE": "10005", "HOUSEHOLD": "10006", "MACHINERY": "10007"}
LINE_CODES = ["10003", "10004", "10005", "10006", "10007", "10002", "10008"]


def _case(c: str, names: dict[str, object], quote: str = "'") -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {quote}{v}{quote}" for k, v in names.items()) + " END"


_SHEET_SQL = _case("o_orderpriority || '/' || o_orderstatus", {"/".join(k): v for k, v in SHEET.items()})
_LOAN_SQL = "CASE CAST(ceil(l_quantity / 2) AS INTEGER) " + " ".join(f"WHEN {i + 1} THEN {{}}" for i in range(25)) + " END"
_CTES |= {
    "names": "names(bank_type_code, bank_type) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in catalog.ENTITIES.items()) + ")",
    "o": f"""o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, unnest(['10001', {_case('c_mktsegment', SEGMENT)}]) AS bank_type_code, o_orderkey, o_orderpriority, o_orderstatus,
  CAST(o_totalprice AS DECIMAL(18,2)) AS v, CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS fx FROM orders JOIN customer ON o_custkey = c_custkey)""",
    "bs": f"bs AS (SELECT year, month, bank_type_code, {_SHEET_SQL} AS item_name, v AS amount_tl, fx AS amount_fx, v + coalesce(fx, 0) AS amount_total FROM o)",
    "dp": "dp AS (SELECT year, month, bank_type_code, " + _case("o_orderpriority", {k: v[0] for k, v in DEPOSIT.items()}, "") + " AS table_number, " + _case("o_orderpriority", {k: v[1] for k, v in DEPOSIT.items()}) + " AS item_name, v AS demand, v + 1 AS maturity_1m, v + 2 AS maturity_1_3m, v + 3 AS maturity_3_6m, v + 4 AS maturity_6_12m, CASE WHEN o_orderstatus <> 'P' THEN v + 5 END AS maturity_over_12m, v AS total_amount FROM o)",
    "inc": "inc AS (SELECT year, month, bank_type_code, " + _case("o_orderpriority", LINES, "") + " + CASE WHEN o_orderstatus = 'P' THEN CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 1 WHEN '5-LOW' THEN 4 ELSE 0 END ELSE 0 END AS item_order, v AS amount_total FROM o)",
    "ln": f"""ln AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, unnest(['10001', CASE l_linenumber {' '.join(f"WHEN {i + 1} THEN '{c}'" for i, c in enumerate(LINE_CODES))} END]) AS bank_type_code,
  {_LOAN_SQL.format(*(t for t, _ in LOAN))} AS table_number, {_LOAN_SQL.format(*(f"'{n}'" for _, n in LOAN))} AS item_name, CASE WHEN l_returnflag = 'A' THEN 'USD' ELSE 'TL' END AS currency,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS short_term_tl, CAST(l_quantity AS DECIMAL(18,2)) AS short_term_fx, CAST(l_tax * 100 AS DECIMAL(18,2)) AS medium_long_tl, CAST(l_discount * 100 AS DECIMAL(18,2)) AS medium_long_fx FROM lineitem)""",
    "lo": """lo AS (SELECT *, short_term_tl + short_term_fx AS short_term_total, medium_long_tl + medium_long_fx AS medium_long_total, short_term_tl + medium_long_tl AS total_tl, short_term_fx + medium_long_fx AS total_fx,
  short_term_tl + short_term_fx + medium_long_tl + medium_long_fx AS total_amount, nullif(medium_long_fx, 0) AS npl_amount, short_term_fx AS customer_count FROM ln)""",
    "fr": "fr AS (SELECT year, month, bank_type_code, CASE WHEN o_orderstatus = 'P' THEN 17 ELSE 15 END AS table_number, " + _case("o_orderpriority", dict(zip(LINES, [p.rstrip("%") + " *" for p in list(X.PUBLISHED.values())[:5]]))) + " AS item_name, CAST(v AS DOUBLE) / 1000 AS ratio_value FROM o)",
    "ws": "ws AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) + 4 AS period_date, l_returnflag AS item_id, '10001' AS bank_type_code, CASE l_linestatus WHEN 'F' THEN 'TOTAL' ELSE 'TL' END AS currency, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS value FROM lineitem GROUP BY ALL)",
}
_BS, _DP, _LO = ("names", "o", "bs"), ("names", "o", "dp"), ("names", "ln", "lo")


def _pick(key: Column, names: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), key)


def _orders(spark, sf) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    both = o.join(c, o.o_custkey == c.c_custkey)
    v, fx = F.col("o_totalprice").cast("decimal(18,2)").alias("v"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("decimal(18,2)")).alias("fx")
    codes = F.explode(F.array(F.lit("10001"), _pick(F.col("c_mktsegment"), SEGMENT))).alias("bank_type_code")
    return both.select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), codes, "o_orderkey", "o_orderpriority", "o_orderstatus", v, fx)


def _loans(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    dec = lambda c: c.cast("decimal(18,2)")
    item = F.element_at(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(n).alias("n")) for t, n in LOAN)), F.ceil(F.col("l_quantity") / 2).cast("int"))
    codes = F.explode(F.array(F.lit("10001"), F.element_at(F.array(*map(F.lit, LINE_CODES)), F.col("l_linenumber")))).alias("bank_type_code")
    a, b, c, d = dec(F.col("l_extendedprice")), dec(F.col("l_quantity")), dec(F.col("l_tax") * 100), dec(F.col("l_discount") * 100)
    return li.select(
        F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), codes, item["t"].alias("table_number"), item["n"].alias("item_name"), F.when(F.col("l_returnflag") == "A", "USD").otherwise("TL").alias("currency"),
        a.alias("short_term_tl"), b.alias("short_term_fx"), (a + b).alias("short_term_total"), c.alias("medium_long_tl"), d.alias("medium_long_fx"), (c + d).alias("medium_long_total"),
        (a + c).alias("total_tl"), (b + d).alias("total_fx"), (a + b + c + d).alias("total_amount"), F.nullif(d, F.lit(0)).alias("npl_amount"), b.alias("customer_count"),
    )


def tables(spark, sf) -> dict[str, DataFrame]:
    """The fact tables."""
    o = _orders(spark, sf)
    by = F.concat_ws("/", "o_orderpriority", "o_orderstatus")
    keys = ["year", "month", "bank_type_code"]
    p, is_p, v = F.col("o_orderpriority"), F.col("o_orderstatus") == "P", F.col("v")
    extra = F.when(is_p & (p == "4-NOT SPECIFIED"), 1).when(is_p & (p == "5-LOW"), 4).otherwise(0)
    published = dict(zip(LINES, [x.rstrip("%") + " *" for x in list(X.PUBLISHED.values())[:5]]))
    weekly = table(spark, sf, "lineitem").groupBy(E.friday_of("l_shipdate").alias("period_date"), F.col("l_returnflag").alias("item_id"), F.when(F.col("l_linestatus") == "F", "TOTAL").otherwise("TL").alias("currency"))
    return {
        "balance_sheet": o.select(*keys, _pick(by, {"/".join(k): n for k, n in SHEET.items()}).alias("item_name"), v.alias("amount_tl"), F.col("fx").alias("amount_fx"), (v + F.coalesce("fx", F.lit(0))).alias("amount_total")),
        "deposits": o.select(*keys, _pick(p, {k: t for k, (t, _) in DEPOSIT.items()}).alias("table_number"), _pick(p, {k: n for k, (_, n) in DEPOSIT.items()}).alias("item_name"), v.alias("demand"), *((v + i + 1).alias(c) for i, c in enumerate(["maturity_1m", "maturity_1_3m", "maturity_3_6m", "maturity_6_12m"])), F.when(~is_p, v + 5).alias("maturity_over_12m"), v.alias("total_amount")),
        "loans": _loans(spark, sf),
        "income_statement": o.select(*keys, (_pick(p, LINES) + extra).alias("item_order"), F.lit("line").alias("item_name"), v.alias("amount_total")),
        "financial_ratios": o.select(*keys, F.when(is_p, 17).otherwise(15).alias("table_number"), _pick(p, published).alias("item_name"), (v.cast("double") / 1000).alias("ratio_value")),
        "weekly_series": weekly.agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("value")).withColumn("bank_type_code", F.lit("10001")),
    }


def engine(spark, sf) -> X.Store:
    return X.Store(tables(spark, sf))


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "period", "bank_type_code", "bank_type", F.col("value").cast("double").alias("value"))


# The catalogue: each metric's table, condition and columns in SQL, by currency.
_PRIMARY = "bank_type_code IN ('10001', '10003', '10004', '10005', '10006', '10007')"
_AMOUNT = {"TL": "amount_tl", "FX": "amount_fx", "TOTAL": "amount_total"}
_T3 = "item_name ILIKE '%TOPLAM%' AND table_number = 3"
_METRIC = {
    "total_assets": ("bs", "item_name ILIKE '%TOPLAM AKT%'", _AMOUNT),
    "cash_and_central_bank": ("bs", "(item_name ILIKE '%nakit%' OR item_name ILIKE '%Merkez Bankası%Alacak%')", _AMOUNT),
    "securities_portfolio": ("bs", "(item_name ILIKE '%Menkul%Değ%' OR item_name ILIKE '%Menk%Kıymet%')", _AMOUNT),
    "total_loans": ("lo", _T3, {"TL": "total_tl", "FX": "total_fx", "TOTAL": "total_amount"}),
    "loans_short_term": ("lo", _T3, {"TL": "short_term_tl", "FX": "short_term_fx", "TOTAL": "short_term_total"}),
    "loans_medium_long_term": ("lo", _T3, {"TL": "medium_long_tl", "FX": "medium_long_fx", "TOTAL": "medium_long_total"}),
    "npl_amount": ("lo", _T3, {"TOTAL": "npl_amount"}),
    "customer_count": ("lo", _T3, {"TOTAL": "customer_count"}),
    "total_deposits": ("bs", "item_name ILIKE '%Mevduat%' AND item_name NOT ILIKE '%Faiz%'", _AMOUNT),
    "demand_deposits": ("dp", "item_name ILIKE '%TOPLAM%'", {"TOTAL": "demand"}),
    "time_deposits": ("dp", "item_name ILIKE '%TOPLAM%'", {"TOTAL": "maturity_1m + maturity_1_3m + maturity_3_6m + maturity_6_12m + maturity_over_12m"}),
    "total_equity": ("bs", "item_name ILIKE '%TOPLAM ÖZKAYN%'", {"TOTAL": "amount_total"}),
    "paid_in_capital": ("bs", "item_name ILIKE '%Ödenmiş Sermaye%'", {"TOTAL": "amount_total"}),
    "retained_earnings": ("bs", "(item_name ILIKE '%Yedek%' OR item_name ILIKE '%Kar%')", {"TOTAL": "amount_total"}),
    "total_liabilities": ("bs", "item_name ILIKE '%TOPLAM YABANCI KAYN%'", {"TOTAL": "amount_total"}),
    "borrowings_from_banks": ("bs", "item_name ILIKE '%Bankalara Borç%'", _AMOUNT),
    "non_cash_loans": ("bs", "item_name ILIKE '%Gayrinakdi%'", {"TOTAL": "amount_total"}),
    "derivative_instruments": ("bs", "item_name ILIKE '%Türev%'", {"TOTAL": "amount_total"}),
}
#: What ratios and growth rates take instead.
_GETTER = {
    "total_loans": ("bs", "item_name ILIKE 'Krediler%'", _AMOUNT),
    "npl_amount": ("bs", "item_name ILIKE '%Takipteki Alacak%'", _AMOUNT),
    "total_deposits": ("bs", "item_name ILIKE '%Mevduat%Fon%' AND item_name NOT ILIKE '%Faiz%'", _AMOUNT),
}


def _level(metric: str, currency: str = "TOTAL", getter: bool = False) -> str:
    """year, month, bank_type_code, value of a metric, as SQL."""
    source, where, columns = _GETTER.get(metric, _METRIC[metric]) if getter else _METRIC[metric]
    return f"SELECT year, month, bank_type_code, sum({columns.get(currency) or columns['TOTAL']}) AS value FROM {source} WHERE {where} AND {_PRIMARY} GROUP BY ALL"


def _standard(inner: str, more: str = "", value: str = "CAST(value AS DOUBLE)") -> str:
    return f"SELECT {more}make_date(year, month, 1) AS period, bank_type_code, bank_type, {value} AS value FROM ({inner}) JOIN names USING (bank_type_code)"


_ALL = ("names", "o", "bs", "dp", "ln", "lo")


def _ratio_sql(id: str) -> str:
    (a, ca), (b, cb) = (catalog.operand(x) for x in (catalog.RATIOS[id].numerator, catalog.RATIOS[id].denominator))
    inner = f"SELECT a.year, a.month, a.bank_type_code, CAST(a.value AS DOUBLE) / nullif(CAST(b.value AS DOUBLE), 0) * 100 AS value FROM ({_level(a, ca, True)}) a JOIN ({_level(b, cb, True)}) b ON a.year = b.year AND a.month = b.month AND a.bank_type_code = b.bank_type_code"
    return _standard(inner)


def _growth_sql(id: str) -> str:
    g = catalog.GROWTH[id]
    lag = f"SELECT *, CAST(value AS DOUBLE) AS v, CAST(lag(value, {g.periods}) OVER (PARTITION BY bank_type_code ORDER BY year, month) AS DOUBLE) AS p FROM ({_level(g.metric, 'TOTAL', True)})"
    return f"SELECT * FROM ({_standard(f'SELECT year, month, bank_type_code, value AS raw, v - p AS d, p FROM ({lag}) WHERE p <> 0', value='d / p * 100')}) WHERE value IS NOT NULL"


def _catalog() -> None:
    for currency in catalog.CURRENCIES:
        levels = " UNION ALL ".join(f"SELECT '{m}' AS metric_id, * FROM ({_level(m, currency)})" for m in _METRIC)

        @query(f"engine_metrics_{currency.lower()}", _standard(levels, "metric_id, "), *_ALL)
        def _(spark, sf, currency=currency):
            return _shown(engine(spark, sf).every_metric(currency), "metric_id")

    for id in catalog.RATIOS:

        @query(f"engine_{id}", _ratio_sql(id), *_ALL)
        def _(spark, sf, id=id):
            return _shown(engine(spark, sf).ratio(id))

    for id in catalog.GROWTH:

        @query(f"engine_{id}", _growth_sql(id), *_ALL)
        def _(spark, sf, id=id):
            df = engine(spark, sf).growth(id)
            return _shown(df)


_catalog()


@query("engine_single_metric", _standard(_level("total_assets", "FX"), "'total_assets' AS metric_id, 'Total Assets' AS metric_name, 'FX' AS currency, 'million_tl' AS unit, "), *_BS)
def _(spark, sf):
    return _shown(engine(spark, sf).metric("total_assets", "FX"), "metric_id", "metric_name", "currency", "unit")


_EVERY = " UNION ALL ".join([f"SELECT metric_id, period, bank_type_code, bank_type, value FROM ({_standard(' UNION ALL '.join(f'SELECT {chr(39)}{m}{chr(39)} AS metric_id, * FROM ({_level(m)})' for m in _METRIC), 'metric_id, ')})"] + [f"SELECT '{i}', period, bank_type_code, bank_type, value FROM ({_ratio_sql(i)})" for i in catalog.RATIOS] + [f"SELECT '{i}', period, bank_type_code, bank_type, value FROM ({_growth_sql(i)})" for i in catalog.GROWTH])


@query("all_metrics_long", f"SELECT * FROM ({_EVERY})", *_ALL)
def _(spark, sf):
    return _shown(engine(spark, sf).everything(), "metric_id")


# Named items.


def _labelled(source: str, column: str, conditions: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{label}' AS label, year, month, bank_type_code, sum({column}) AS value FROM {source} WHERE {where} AND {_PRIMARY} GROUP BY ALL" for label, where in conditions.items())


_SME = {"SME": "table_number = 6 AND item_name ILIKE 'Toplam KOBİ Kredileri%'", "Micro": "table_number = 6 AND item_name LIKE 'Mikro İşletmelere%'", "Small": "table_number = 6 AND item_name LIKE 'Küçük İşletmelere%'", "Medium": "table_number = 6 AND item_name LIKE 'Orta Büyüklükteki İşletmelere%'"}


@query("segments_sme", _standard(_labelled("lo", "total_amount", _SME), "label, "), *_LO)
def _(spark, sf):
    return _shown(engine(spark, sf).segments({**X.SME_TOTAL, **X.SME}), "label")


_MIX = {"Housing": "Tüketici Kredileri - Konut", "Auto": "Tüketici Kredileri - Taşıt", "General Purpose": "Tüketici Kredileri - İhtiyaç", "Retail Cards": "Bireysel Kredi Kartları (10+11)%"}


@query("segments_consumer", _standard(_labelled("lo", "total_amount", {k: f"table_number = 4 AND item_name LIKE '{v}'" for k, v in _MIX.items()}), "label, "), *_LO)
def _(spark, sf):
    return _shown(engine(spark, sf).segments(X.CONSUMER), "label")


_NPL = {"Housing": "Takipteki Konut Kredileri", "Auto": "Takipteki Taşıt Kredileri", "GPL": "Takipteki İhtiyaç Kredileri", "Retail Cards": "Takipteki Bireysel Kredi Kartları"}


@query("segments_consumer_npl", _standard(_labelled("lo", "total_amount", {k: f"table_number = 4 AND item_name = '{v}'" for k, v in _NPL.items()}), "label, "), *_LO)
def _(spark, sf):
    return _shown(engine(spark, sf).segments(X.CONSUMER_NPL), "label")


_PARTS = " UNION ALL ".join(f"SELECT '{k}' AS label, year, month, bank_type_code, CAST(sum(CASE WHEN item_name = '{v}' THEN total_amount END) AS DOUBLE) / CAST(sum(CASE WHEN item_name LIKE '{_MIX['General Purpose' if k == 'GPL' else k]}' THEN total_amount END) AS DOUBLE) * 100 AS value FROM lo WHERE table_number = 4 AND currency = 'TL' AND {_PRIMARY} GROUP BY year, month, bank_type_code" for k, v in _NPL.items())


@query("npl_ratio_table4", f"SELECT * FROM ({_standard(_PARTS, 'label, ')}) WHERE value IS NOT NULL", *_LO)
def _(spark, sf):
    return _shown(engine(spark, sf).consumer_npl_ratios(), "label")


_WIDE = "SELECT period_date AS period, sum(CASE WHEN item_id = 'A' THEN value END) AS a, sum(CASE WHEN item_id = 'N' THEN value END) AS n, sum(CASE WHEN item_id = 'R' THEN value END) AS r FROM ws WHERE bank_type_code = '10001' AND currency = 'TOTAL' GROUP BY 1"


@query("npl_ratio_weekly", f"SELECT period, a / n * 100 AS value FROM ({_WIDE}) WHERE n > 0 AND a IS NOT NULL", "ws")
def _(spark, sf):
    return engine(spark, sf).weekly_ratio("A", "N")


@query("npl_ratio_weekly_less", f"SELECT period, (a - r) / (n - r) * 100 AS value FROM ({_WIDE}) WHERE n - r > 0 AND a - r IS NOT NULL", "ws")
def _(spark, sf):
    return engine(spark, sf).weekly_ratio("A", "N", less=("R", "R"))


_LINES = "SELECT year, month, bank_type_code, " + ", ".join(f"sum(CASE WHEN item_order = {i} THEN amount_total END) AS v{i}" for i in (24, 27, 31, 34, 46, 47, 50)) + f" FROM inc WHERE {_PRIMARY} GROUP BY ALL"
_INC = ("names", "o", "inc")


@query("income_items_sum", _standard(f"SELECT year, month, bank_type_code, v24 + v34 AS value FROM ({_LINES}) WHERE v24 IS NOT NULL AND v34 IS NOT NULL"), *_INC)
def _(spark, sf):
    return _shown(engine(spark, sf).income_sum([24, 34]))


@query("income_items", _standard(f"SELECT year, month, bank_type_code, item_order, sum(amount_total) AS value FROM inc WHERE item_order IN (24, 46, 47) AND {_PRIMARY} GROUP BY ALL", "item_order, "), *_INC)
def _(spark, sf):
    return _shown(engine(spark, sf).income_items([24, 46, 47]), "item_order")


@query("revenue_shares", _standard(f"SELECT 'interest' AS label, year, month, bank_type_code, CAST(v24 AS DOUBLE) / CAST(v24 + v34 + v50 AS DOUBLE) * 100 AS value FROM ({_LINES}) WHERE v24 + v34 + v50 <> 0 UNION ALL SELECT 'trading', year, month, bank_type_code, CAST(v46 + v47 AS DOUBLE) / CAST(v24 + v34 + v50 AS DOUBLE) * 100 FROM ({_LINES}) WHERE v24 + v34 + v50 <> 0 AND v46 + v47 IS NOT NULL", "label, "), *_INC)
def _(spark, sf):
    return _shown(engine(spark, sf).revenue_shares(), "label")


@query("fees_growth", _standard(f"SELECT * FROM (SELECT year, month, bank_type_code, (CAST(v AS DOUBLE) - CAST(lag(v) OVER w AS DOUBLE)) / CAST(lag(v) OVER w AS DOUBLE) * 100 AS value FROM (SELECT *, v27 + v31 AS v FROM ({_LINES})) WHERE v IS NOT NULL WINDOW w AS (PARTITION BY bank_type_code, month ORDER BY year)) WHERE value IS NOT NULL"), *_INC)
def _(spark, sf):
    return _shown(engine(spark, sf).fees_growth())


@query("published_ratios", _standard(f"SELECT *, CASE item_name {' '.join(f'WHEN {chr(39)}{p.rstrip(chr(37))} *{chr(39)} THEN {chr(39)}{k}{chr(39)}' for k, p in X.PUBLISHED.items())} END AS label, ratio_value AS value FROM fr WHERE table_number = 15 AND {_PRIMARY}", "label, item_name, "), "names", "o", "fr")
def _(spark, sf):
    return _shown(engine(spark, sf).published(), "label", "item_name")


_BUCKETS = {"Demand": "demand", "≤ 1m": "maturity_1m", "1–3m": "maturity_1_3m", "3–6m": "maturity_3_6m", "6–12m": "maturity_6_12m", "> 12m": "maturity_over_12m"}


@query("deposit_maturity_mix", _standard(" UNION ALL ".join(f"SELECT '{k}' AS label, year, month, bank_type_code, sum({c}) AS value FROM dp WHERE table_number = 10 AND item_name = 'TOPLAM MEVDUAT' AND {_PRIMARY} GROUP BY ALL" for k, c in _BUCKETS.items()), "label, "), *_DP)
def _(spark, sf):
    return _shown(engine(spark, sf).maturity_mix(), "label")


@query("domestic_deposits", _standard(_labelled("dp", "total_amount", {k: f"table_number = 10 AND item_name = '{m.where.equal[1][1]}'" for k, m in X.DOMESTIC.items()}), "label, "), *_DP)
def _(spark, sf):
    return _shown(engine(spark, sf).segments(X.DOMESTIC), "label")


@query("balance_item_of_entity", _standard("SELECT year, month, bank_type_code, sum(amount_fx) AS value FROM bs WHERE item_name ILIKE '%mevduat%' AND bank_type_code IN ('10001') GROUP BY ALL"), *_BS)
def _(spark, sf):
    return _shown(engine(spark, sf).with_entities("10001").item("%Mevduat%", currency="FX"))


@query("entity_or_precedence", _standard("SELECT year, month, bank_type_code, sum(amount_total) AS value FROM bs WHERE item_name ILIKE '%nakit%' OR (item_name ILIKE '%Merkez Bankası%Alacak%' AND bank_type_code IN ('10001', '10003')) GROUP BY ALL"), *_BS)
def _(spark, sf):
    return _shown(Engine(tables(spark, sf), ["10001", "10003"], or_precedence=True).metric("cash_and_central_bank"))


# The store.


_FRAMES = {f"{m}{s}": (m, c) for m in ("total_assets", "total_loans", "total_deposits") for s, c in (("", "TOTAL"), ("_tl", "TL"), ("_fx", "FX"))} | {m: (m, "TOTAL") for m in ("npl_amount", "total_equity", "total_liabilities")}
_TABLE4 = {"consumer_loans": "Tüketici Kredileri (2+3+4)%", "consumer_housing": "Tüketici Kredileri - Konut", "consumer_auto": "Tüketici Kredileri - Taşıt", "consumer_gpl": "Tüketici Kredileri - İhtiyaç", "retail_credit_cards": "Bireysel Kredi Kartları (10+11)%", "corporate_credit_cards": "Kurumsal Kredi Kartları (28+29)%", "commercial_installment": "Taksitli Ticari Krediler (20+21+22)%"}
_STORE = f"""SELECT * FROM (WITH lv AS ({" UNION ALL ".join(f"SELECT '{f}' AS metric_id, year, month, bank_type_code, CAST(value AS DOUBLE) AS value FROM ({_level(m, c, True)})" for f, (m, c) in _FRAMES.items())}),
rt AS ({" UNION ALL ".join(f"SELECT '{r}' AS metric_id, a.year, a.month, a.bank_type_code, {v} AS value FROM lv a JOIN lv b USING (year, month, bank_type_code) WHERE a.metric_id = '{a}' AND b.metric_id = '{b}'" for r, a, b, v in [("npl_ratio", "npl_amount", "total_loans", "a.value / b.value * 100"), ("ldr", "total_loans", "total_deposits", "a.value / b.value * 100"), ("equity_ratio", "total_equity", "total_assets", "a.value / b.value * 100"), ("fx_loan_share", "total_loans_fx", "total_loans", "round_even(a.value / b.value * 100, 2)"), ("fx_deposit_share", "total_deposits_fx", "total_deposits", "round_even(a.value / b.value * 100, 2)")])}),
ms AS (SELECT 'market_share' AS metric_id, a.year, a.month, a.bank_type_code, round_even(a.value / b.value * 100, 2) AS value FROM lv a JOIN lv b USING (year, month) WHERE a.metric_id = 'total_assets' AND b.metric_id = 'total_assets' AND b.bank_type_code = '10001'),
gr AS (SELECT g AS metric_id, year, month, bank_type_code, (value - p) / p * 100 AS value FROM (SELECT *, CASE metric_id WHEN 'total_loans' THEN 'loan_growth_yoy' WHEN 'total_assets' THEN 'asset_growth_yoy' ELSE 'deposit_growth_yoy' END AS g, lag(value, 12) OVER (PARTITION BY metric_id, bank_type_code ORDER BY year, month) AS p FROM lv WHERE metric_id IN ('total_loans', 'total_assets', 'total_deposits')) WHERE p <> 0),
t4 AS ({" UNION ALL ".join(f"SELECT '{k}' AS metric_id, year, month, bank_type_code, CAST(sum(total_amount) AS DOUBLE) AS value FROM lo WHERE table_number = 4 AND item_name LIKE '{v}' AND {_PRIMARY} GROUP BY ALL" for k, v in _TABLE4.items())})
SELECT metric_id, make_date(year, month, 1) AS period, bank_type_code, bank_type, value FROM (SELECT * FROM lv UNION ALL SELECT * FROM rt UNION ALL SELECT * FROM ms UNION ALL SELECT * FROM gr UNION ALL SELECT * FROM t4) JOIN names USING (bank_type_code))"""


@query("store_frames", _STORE, *_ALL)
def _(spark, sf):
    return _shown(engine(spark, sf).long(), "metric_id")


_KEPT: dict[tuple[str, str], KeptStore] = {}


def kept(spark, sf) -> KeptStore:
    """The frames of the given tables, computed once for a session and then read from where they are kept."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _KEPT:
        store = KeptStore(spark, scratch_path(spark, "kept"))
        store.build(engine(spark, sf))
        _KEPT[key] = store
    return _KEPT[key]


@query("kept_frames", _STORE, *_ALL)
def _(spark, sf):
    return _shown(kept(spark, sf).long(), "metric_id")


_REVISED = ("1995", "3"), ("1997", "12")
_CTES["bs_revised"] = "bs AS (SELECT year, month, bank_type_code, item_name, amount_tl * f AS amount_tl, amount_fx * f AS amount_fx, amount_total * f AS amount_total FROM (SELECT *, CASE WHEN " + " OR ".join(f"year = {y} AND month = {m}" for y, m in _REVISED) + " THEN 2 ELSE 1 END AS f FROM bs0) WHERE NOT (year = 1996 AND month = 7))"
_CTES["bs0"] = _CTES["bs"].replace("bs AS (", "bs0 AS (", 1)


@query("kept_frames_revised", _STORE, "names", "o", "bs0", "bs_revised", "dp", "ln", "lo")
def _(spark, sf):
    """The kept frames after a revision of two months and the loss of a third: only what these reach is computed again."""
    store = KeptStore(spark, scratch_path(spark, "kept-revised"))
    before = engine(spark, sf)
    store.build(before)
    bs = before.tables["balance_sheet"].where("not (year = 1996 and month = 7)")
    times = F.when(F.expr(" or ".join(f"year = {y} and month = {m}" for y, m in _REVISED)), 2).otherwise(1)
    bs = bs.withColumns({c: F.col(c) * times for c in ("amount_tl", "amount_fx", "amount_total")})
    store.revise(X.Store(before.tables | {"balance_sheet": bs}), [*((int(y), int(m)) for y, m in _REVISED), (1996, 7)])
    return _shown(store.long(), "metric_id")


_WITH_FAULTS = Definitions(
    metrics=catalog.METRICS | {"bad_column": catalog.Metric("bad_column", "", "assets", "balance_sheet", catalog.Where(("%",)), {"TOTAL": ("amount_eur",)})},
    ratios=catalog.RATIOS | {"bad_operand": catalog.Ratio("bad_operand", "", "assets", "bad_column", "total_assets"), "bad_loop": catalog.Ratio("bad_loop", "", "assets", "bad_loop", "total_assets")},
)


@query("bulk_despite_faults", f"SELECT * FROM ({_EVERY})", *_ALL)
def _(spark, sf):
    return _shown(bulk(engine(spark, sf), _WITH_FAULTS)[0], "metric_id")


@query("store_latest", f"SELECT * FROM (WITH s AS ({_STORE}) SELECT metric_id, period, bank_type_code, bank_type, value FROM s WHERE metric_id = 'ldr' AND period = (SELECT max(period) FROM s WHERE metric_id = 'ldr'))", *_ALL)
def _(spark, sf):
    return _shown(kept(spark, sf).latest("ldr"), "metric_id")


@query("store_period_range", "SELECT min(make_date(year, month, 1)) AS first_period, max(make_date(year, month, 1)) AS last_period FROM bs WHERE item_name ILIKE '%TOPLAM AKT%'", *_BS)
def _(spark, sf):
    return kept(spark, sf).period_range()


@query("store_kpis", f"SELECT * FROM (WITH s AS ({_STORE}), k AS (SELECT metric_id, period, value / CASE WHEN metric_id LIKE 'total%' THEN 1e6 ELSE 1 END AS value FROM s WHERE bank_type_code = '10001' AND metric_id IN ('total_assets', 'total_loans', 'total_deposits', 'total_equity', 'npl_ratio', 'ldr', 'equity_ratio', 'loan_growth_yoy')), l AS (SELECT *, lag(value) OVER w AS p, row_number() OVER (PARTITION BY metric_id ORDER BY period DESC) AS n FROM k WINDOW w AS (PARTITION BY metric_id ORDER BY period)) SELECT metric_id, period, round(value, 6) AS value, round(value - p, 6) AS change, round((value - p) / nullif(abs(p), 0) * 100, 6) AS change_percent FROM l WHERE n = 1)", *_ALL)
def _(spark, sf):
    return kept(spark, sf).kpis().select("metric_id", "period", *(F.round(c, 6).alias(c) for c in ("value", "change", "change_percent")))


@query("store_comparison", f"SELECT * FROM (WITH s AS ({_STORE}), l AS (SELECT *, max(period) OVER (PARTITION BY metric_id) AS m FROM s WHERE metric_id IN ('total_assets', 'total_loans', 'npl_ratio', 'ldr', 'equity_ratio')) SELECT bank_type, " + ", ".join(f"max(CASE WHEN metric_id = '{m}' THEN value END) AS {m}" for m in ("total_assets", "total_loans", "npl_ratio", "ldr", "equity_ratio")) + " FROM l WHERE period = m GROUP BY 1)", *_ALL)
def _(spark, sf):
    return kept(spark, sf).bank_comparison()


# Writers: responses made of the test tables, parsed back into typed rows.


#: Rows of a response, as a server pages them.
PAGE_ROWS = 500


def _response(df: DataFrame, keys: list[str], cells: dict[str, Column], table_number: Column, by: str) -> DataFrame:
    """Responses of about PAGE_ROWS rows for each of keys, a row per row of df, cells in the order given. Rows are dealt
    to pages by the hash of a key of theirs, so that a month of any size is many bounded texts."""
    model = F.array(*(F.struct(F.lit(c).alias("name")) for c in cells))
    row = F.struct(F.array(*(v.cast("string") for v in cells.values())).alias("cell"))
    body = F.to_json(F.struct(F.struct(F.first(model).alias("colModels"), F.first(F.array(*map(F.lit, cells))).alias("colNames"), F.struct(F.collect_list(row).alias("rows")).alias("data")).alias("Json")))
    df = df.withColumn("table_number", table_number)
    pages = df.groupBy("table_number", *keys).agg(F.ceil(F.count("*") / PAGE_ROWS).alias("_pages"))
    df = df.join(pages, ["table_number", *keys]).withColumn("_page", F.pmod(F.xxhash64(by), F.col("_pages")))
    return df.groupBy("table_number", *keys, "_page").agg(body.alias("response_json")).drop("_page")


def _raw(spark, sf, name: str, month: Column, cells: dict[str, Column], table_number: int) -> DataFrame:
    df = table(spark, sf, name).withColumns({"year": F.year(month), "month": F.month(month), "currency": F.lit("TL"), "bank_type_code": F.lit("10001")})
    head = {"BankaAdi": F.lit("Sector"), "BasitSira": cells.pop("BasitSira"), "Ad": cells.pop("Ad"), "BasitFont": cells.pop("BasitFont")}
    return _response(df, ["year", "month", "currency", "bank_type_code"], head | cells, F.lit(table_number), "o_orderkey" if name == "orders" else "l_orderkey")


def _order_cells(**cells: Column) -> dict[str, Column]:
    return {"BasitSira": F.col("o_orderkey"), "Ad": F.col("o_orderpriority"), "BasitFont": F.when(F.col("o_orderstatus") == "F", "bold").otherwise("")} | cells


_ORDER = "CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, 'TL' AS currency, '10001' AS bank_type_code, CAST(o_orderkey AS INTEGER) AS item_order, o_orderpriority AS item_name"


@query("writer_balance_sheet", f"SELECT {_ORDER}, o_orderstatus = 'F' AS is_subtotal, o_totalprice AS amount_tl, CAST(NULL AS DOUBLE) AS amount_fx, CAST(o_custkey AS DOUBLE) AS amount_total FROM orders")
def _(spark, sf):
    raw = _raw(spark, sf, "orders", F.col("o_orderdate"), _order_cells(Tp=F.col("o_totalprice"), Toplam=F.col("o_custkey")), 1)
    return writers.routed(raw)["balance_sheet"]


@query("writer_financial_ratios", f"SELECT 15 AS table_number, {_ORDER.replace(chr(39) + 'TL' + chr(39) + ' AS currency, ', '')}, o_totalprice AS ratio_value, 'other' AS ratio_category FROM orders")
def _(spark, sf):
    return writers.routed(_raw(spark, sf, "orders", F.col("o_orderdate"), _order_cells(Rasyo=F.col("o_totalprice")), 15))["financial_ratios"]


_LINE = "CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month, 'TL' AS currency, '10001' AS bank_type_code, CAST(l_orderkey AS INTEGER) AS item_order, l_returnflag AS item_name, l_linestatus = 'F' AS is_subtotal"


def _line_cells(**cells: Column) -> dict[str, Column]:
    return {"BasitSira": F.col("l_orderkey"), "Ad": F.col("l_returnflag"), "BasitFont": F.when(F.col("l_linestatus") == "F", "bold").otherwise("")} | cells


@query("writer_loans", f"SELECT 4 AS table_number, {_LINE}, l_extendedprice AS short_term_tl, CAST(NULL AS DOUBLE) AS short_term_fx, CAST(NULL AS DOUBLE) AS short_term_total, CAST(NULL AS DOUBLE) AS medium_long_tl, CAST(NULL AS DOUBLE) AS medium_long_fx, CAST(NULL AS DOUBLE) AS medium_long_total, coalesce(nullif(l_discount, 0), nullif(l_tax, 0), NULL) AS total_tl, CAST(NULL AS DOUBLE) AS total_fx, coalesce(nullif(l_tax, 0), l_quantity) AS total_amount, l_discount AS npl_amount, CAST(NULL AS DOUBLE) AS non_cash_amount, CAST(l_linenumber AS DOUBLE) AS customer_count FROM lineitem")
def _(spark, sf):
    cells = _line_cells(KisaTp=F.col("l_extendedprice"), ToplamTp=F.col("l_discount"), Tp=F.col("l_tax"), Toplam=F.col("l_tax"), NakdiKrediToplam=F.lit(None), ToplamNakdi=F.col("l_quantity"), Takipteki=F.lit(0), TakipKrediToplam=F.col("l_discount"), NetMusteri=F.col("l_linenumber"))
    return writers.routed(_raw(spark, sf, "lineitem", F.col("l_shipdate"), cells, 4))["loans"]


@query("writer_deposits", f"SELECT 10 AS table_number, {_LINE}, CAST(NULL AS DOUBLE) AS bracket_10k, CAST(NULL AS DOUBLE) AS bracket_50k, CAST(NULL AS DOUBLE) AS bracket_250k, CAST(NULL AS DOUBLE) AS bracket_1m, l_tax AS bracket_over_1m, l_quantity AS demand, CAST(NULL AS DOUBLE) AS maturity_1m, CAST(NULL AS DOUBLE) AS maturity_1_3m, CAST(NULL AS DOUBLE) AS maturity_3_6m, CAST(NULL AS DOUBLE) AS maturity_6_12m, l_discount AS maturity_over_12m, l_extendedprice AS total_amount FROM lineitem")
def _(spark, sf):
    cells = _line_cells(Milyonarti=F.col("l_tax"), Vadesiz=F.col("l_quantity"), BirYil=F.col("l_discount"), Toplam=F.col("l_extendedprice"))
    return writers.routed(_raw(spark, sf, "lineitem", F.col("l_shipdate"), cells, 10))["deposits"]


@query("writer_other_data", f"SELECT 12 AS table_number, {_ORDER}, o_orderstatus = 'F' AS is_subtotal, column_name, value_text, TRY_CAST(value_text AS DOUBLE) AS value_numeric FROM (SELECT *, o_orderstatus AS s, CAST(o_custkey AS VARCHAR) AS k FROM orders) UNPIVOT (value_text FOR column_name IN (s AS Durum, k AS Deger))")
def _(spark, sf):
    return writers.routed(_raw(spark, sf, "orders", F.col("o_orderdate"), _order_cells(Durum=F.col("o_orderstatus"), Deger=F.col("o_custkey"), Bos=F.lit("")), 12))["other_data"]


@query("weekly_response_points", "SELECT l_returnflag AS item_id, CAST(l_shipdate AS DATE) AS period_date, 'Toplam ' || l_returnflag AS item_name, l_quantity AS value FROM lineitem")
def _(spark, sf):
    day = F.concat(F.day("l_shipdate").cast("string"), F.date_format("l_shipdate", ".MM.yyyy"))
    body = F.to_json(F.struct(F.concat(F.lit("Toplam "), "l_returnflag", F.lit(" (TRY) [x]")).alias("Baslik"), F.collect_list(day).alias("XEkseni"), F.collect_list("l_quantity").alias("YEkseni")))
    # A response has a week's days; a week of many rows is dealt to several.
    week, page = F.trunc(F.col("l_shipdate").cast("date"), "week").alias("w"), F.pmod(F.xxhash64("l_orderkey"), F.lit(16)).alias("p")
    raw = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("item_id"), "l_returnflag", week, page).agg(body.alias("response_json")).drop("l_returnflag", "w", "p")
    return readers.weekly_points(raw).select("item_id", "period_date", "item_name", "value")


# The stream.


@query("stream_upsert_replay", "SELECT period_date, item_id, bank_type_code, currency, arg_max(value, event_id) AS value FROM (SELECT CAST(ts AS DATE) AS period_date, event_type AS item_id, '10001' AS bank_type_code, 'TL' AS currency, value, event_id FROM events WHERE value IS NULL OR abs(value) < 1e10) GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events")
    points = e.select(F.to_json(F.struct(F.col("ts").cast("date").alias("period_date"), F.col("event_type").alias("item_id"), F.lit("10001").alias("bank_type_code"), F.lit("TL").alias("currency"), "value", F.timestamp_seconds("event_id").alias("downloaded_at"))).alias("value"))
    base = scratch_path(spark, "replay")
    points.write.text(f"{base}/in")
    for _ in range(2):  # the second run finds nothing new
        stream.merge_files(spark, f"{base}/in", f"{base}/out", f"{base}/log")
    return stream.current(spark, f"{base}/out").select(*stream.KEYS, "value")


# Panels and ranges.


def _points(spark, sf) -> DataFrame:
    """key, date, value: the three daily series as registry keys."""
    keys = {"purchase": "policy_rate", "click": "on_lending", "view": "usd_try"}
    from tidewell.queries.core import daily

    return daily(spark, sf).where(F.col("label").isin(*keys)).select(_pick(F.col("label"), keys).alias("key"), "date", "value")


_PTS = "pts AS (SELECT CASE label WHEN 'purchase' THEN 'policy_rate' WHEN 'click' THEN 'on_lending' ELSE 'usd_try' END AS key, date, value FROM d WHERE label IN ('purchase', 'click', 'view'))"


@query("panel_trend", f"SELECT * FROM (WITH {_PTS} SELECT key, CASE key WHEN 'policy_rate' THEN 'A' ELSE 'B' END AS label, date, value, row_number() OVER (PARTITION BY key ORDER BY date DESC) = 1 AS is_last FROM pts WHERE key IN ('policy_rate', 'on_lending') AND date >= DATE '2024-01-05')", "d")
def _(spark, sf):
    spec = {"kind": "evds_trend", "start": "2024-01-05", "series": [{"key": "policy_rate", "label": "A"}, {"key": "on_lending", "label": "B"}]}
    return panels.panel(_points(spark, sf), spec, scale={}).select("key", "label", "date", "value", "is_last")


@query("panel_spread", f"SELECT * FROM (WITH {_PTS} SELECT 'width' AS label, a.date, a.value - b.value AS value FROM pts a JOIN pts b ON a.date = b.date AND a.key = 'policy_rate' AND b.key = 'on_lending')", "d")
def _(spark, sf):
    spec = {"kind": "derived_spread", "lines": [{"label": "width", "minuend": "policy_rate", "subtrahend": "on_lending"}]}
    return panels.panel(_points(spark, sf), spec, scale={}).select("label", "date", "value")


@query("panel_stacked_total", f"SELECT * FROM (WITH {_PTS} SELECT date, sum(value) AS total FROM pts WHERE key IN ('policy_rate', 'on_lending') GROUP BY date)", "d")
def _(spark, sf):
    spec = {"kind": "evds_stacked_bar", "series": [{"key": "policy_rate"}, {"key": "on_lending"}]}
    return panels.panel(_points(spark, sf), spec, scale={}).select("date", "total").distinct()


@query("panel_daily_step", f"SELECT * FROM (WITH {_PTS}, k AS (SELECT DISTINCT key FROM pts), c AS (SELECT key, CAST(unnest(range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY)) AS DATE) AS date FROM k), s AS (SELECT * FROM pts WHERE date >= DATE '2024-01-01') SELECT c.key, c.date, s.value FROM c ASOF JOIN s ON s.key = c.key AND c.date >= s.date WHERE c.key IN ('policy_rate', 'on_lending'))", "d")
def _(spark, sf):
    spec = {"kind": "evds_daily_step", "start": "2024-01-01", "end": "2024-01-31", "series": [{"key": "policy_rate"}, {"key": "on_lending"}]}
    return panels.panel(_points(spark, sf), spec, scale={}).select("key", "date", "value")


def _presets() -> None:
    starts = {"6M": "m - INTERVAL 6 MONTH", "YTD": "date_trunc('year', m)", "3Y": "m - INTERVAL 36 MONTH", "5Y": "m - INTERVAL 60 MONTH", "MAX": "DATE '1900-01-01'"}
    for name, start in starts.items():

        @query(f"preset_{name.lower()}", f"SELECT p.period, p.bank_type_code, p.value FROM (SELECT make_date(year, month, 1) AS period, bank_type_code, CAST(value AS DOUBLE) AS value FROM ({_level('total_assets')})) p, (SELECT max(make_date(year, month, 1)) AS m FROM ({_level('total_assets')})) WHERE p.period >= {start}", *_BS)
        def _(spark, sf, name=name):
            return X.preset(_shown(engine(spark, sf).metric("total_assets")), name).select("period", "bank_type_code", "value")


_presets()


@query("filter_from_month", _standard(f"SELECT * FROM ({_level('total_assets')}) WHERE make_date(year, month, 1) >= DATE '1998-05-01'"), *_BS)
def _(spark, sf):
    return X.filter_from(_shown(engine(spark, sf).metric("total_assets")), "1998-05")


@query("caption_comparison", f"SELECT * FROM (WITH v AS ({_ratio_sql('npl_ratio')}), l AS (SELECT * FROM v WHERE period = (SELECT max(period) FROM v)), h AS (SELECT bank_type, value FROM l ORDER BY value DESC, bank_type LIMIT 1), w AS (SELECT bank_type, value FROM l ORDER BY value, bank_type LIMIT 1) SELECT h.bank_type || ' leads at ' || format('{{:.1f}}', h.value) || '%, ' || w.bank_type || ' at ' || format('{{:.1f}}', w.value) || '%.' AS caption FROM h, w)", *_ALL)
def _(spark, sf):
    return panels.comparison_caption(engine(spark, sf).ratio("npl_ratio"))


@query("caption_template", f"SELECT * FROM (WITH {_PTS}, l AS (SELECT key, arg_max(value, date) AS v FROM pts GROUP BY 1) SELECT 'Latest ' || format('{{:.1f}}', (SELECT v FROM l WHERE key = 'policy_rate')) || '% against ' || format('{{:.2f}}', (SELECT v FROM l WHERE key = 'on_lending')) AS caption)", "d")
def _(spark, sf):
    return panels.caption("Latest {policy_rate:.1f}% against {on_lending:.2f}", panels.latest_values(_points(spark, sf)), ["policy_rate", "on_lending"])


@query("narrative_credit", f"SELECT * FROM (WITH g AS ({_growth_sql('loan_growth_yoy')}), k AS (SELECT *, lag(value) OVER (ORDER BY period) AS p, row_number() OVER (ORDER BY period DESC) AS n FROM g WHERE bank_type_code = '10001') SELECT period, CASE WHEN value - p > 0.5 THEN 'accelerating' WHEN value - p < -0.5 THEN 'easing' ELSE 'steady' END AS direction, round(value, 6) AS value, round(value - p, 6) AS delta FROM k WHERE n = 1)", *_ALL)
def _(spark, sf):
    got = panels.turn(engine(spark, sf).growth("loan_growth_yoy"))
    return got.select("period", "direction", F.round("value", 6).alias("value"), F.round("delta", 6).alias("delta"))


# Derivations of the report sections.

_CTES["rate"] = "rate AS (SELECT CAST(date_trunc('month', date) AS DATE) AS period, arg_max(value, date) AS rate FROM (SELECT CAST(l_shipdate AS DATE) AS date, min(l_discount) AS value FROM lineitem WHERE l_discount > 0 GROUP BY 1) GROUP BY 1)"
_CREDIT = "SELECT make_date(year, month, 1) AS period, bank_type_code, CAST(sum(amount_tl) AS DOUBLE) AS t, CAST(sum(amount_fx) AS DOUBLE) / rate AS f, CAST(sum(amount_total) AS DOUBLE) AS a, rate AS r FROM bs LEFT JOIN rate ON rate.period = make_date(year, month, 1) WHERE item_name ILIKE '%krediler%' AND {who} GROUP BY year, month, bank_type_code, rate"


def _credit_sql(periods: int, who: str = _PRIMARY) -> str:
    lag = ", ".join(f"lag({c}, {periods}) OVER w AS {c}0" for c in "tfar")
    year = (lambda x: x) if periods == 12 else (lambda x: f"(pow(1 + {x} / 100, 12.0 / {periods}) - 1) * 100")
    kinds = {"tl_growth": "(t - t0) / t0 * 100", "fx_growth_usd": "(f - f0) / f0 * 100", "total_growth_nominal": "(a - a0) / a0 * 100", "total_growth_fx_adj": "((t - t0) + (f - f0) * r0) / a0 * 100"}
    return f"SELECT * FROM (SELECT period, bank_type_code, " + ", ".join(f"{year(x)} AS {n}" for n, x in kinds.items()) + f" FROM (SELECT *, {lag} FROM ({_CREDIT.format(who=who)}) WINDOW w AS (PARTITION BY bank_type_code ORDER BY period))) WHERE tl_growth + fx_growth_usd + total_growth_nominal + total_growth_fx_adj IS NOT NULL"


def _rate(spark, sf) -> DataFrame:
    from tidewell.operators import align

    q = table(spark, sf, "lineitem").where("l_discount > 0").groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.min("l_discount").alias("value"))
    return align.month_end(q)


_RATES = ["tl_growth", "fx_growth_usd", "total_growth_nominal", "total_growth_fx_adj"]


def _credit_growth() -> None:
    for periods in (12, 3):

        @query(f"credit_growth_{periods}m", "SELECT period, bank_type_code, " + ", ".join(f"round({n}, 4) AS {n}" for n in _RATES) + f" FROM ({_credit_sql(periods)})", *_BS, "rate")
        def _(spark, sf, periods=periods):
            return engine(spark, sf).credit_growth(_rate(spark, sf), periods).select("period", "bank_type_code", *(F.round(n, 4).alias(n) for n in _RATES))


_credit_growth()


@query("credit_growth_summary", " UNION ALL ".join(f"(SELECT '{kind}' AS kind, period, " + ", ".join(f"round_even({n}, 1) AS {n}" for n in _RATES) + f" FROM ({_credit_sql(n, chr(98) + 'ank_type_code = ' + chr(39) + '10001' + chr(39))}) ORDER BY period DESC LIMIT 1)" for kind, n in (("yoy", 12), ("3m_annualized", 3))), *_BS, "rate")
def _(spark, sf):
    return engine(spark, sf).credit_growth_summary(_rate(spark, sf)).select("kind", "period", *_RATES)


_GROWN = _labelled("lo", "total_amount", {k: f"table_number = 4 AND item_name LIKE '{v}'" for k, v in _MIX.items()})


@query("segment_growth", f"SELECT label, period, bank_type_code, bank_type, (value - p) / p * 100 AS value FROM (SELECT *, lag(value, 12) OVER (PARTITION BY label, bank_type_code ORDER BY period) AS p FROM ({_standard(_GROWN, 'label, ')})) WHERE p <> 0", *_LO)
def _(spark, sf):
    return _shown(engine(spark, sf).segment_growth(X.CONSUMER), "label")


@query("public_vs_private", _growth_sql("asset_growth_yoy").replace(_PRIMARY, "bank_type_code IN ('10003', '10004')"), *_ALL)
def _(spark, sf):
    return _shown(engine(spark, sf).with_entities("10003", "10004").growth("asset_growth_yoy"))


@query("weekly_nowcast", "SELECT item_id, currency, period_date, round((pow(value / p, 52.0 / 4) - 1) * 100, 4) AS value FROM (SELECT *, lag(value, 4) OVER (PARTITION BY item_id, bank_type_code, currency ORDER BY period_date) AS p FROM ws WHERE item_id IN ('A', 'R')) WHERE p > 0 AND value > 0", "ws")
def _(spark, sf):
    return engine(spark, sf).nowcast(4, ["A", "R"], ["10001"], ["TOTAL", "TL"]).select("item_id", "currency", "period_date", F.round("value", 4).alias("value"))


@query("roe_by_income_lines", f"""SELECT * FROM (WITH b AS (SELECT 'NII' AS bucket, year, month, CAST(v24 AS DOUBLE) AS v FROM ({_LINES}) WHERE bank_type_code = '10001' AND v24 IS NOT NULL UNION ALL SELECT 'Fees', year, month, CAST(v27 + v31 AS DOUBLE) FROM ({_LINES}) WHERE bank_type_code = '10001' AND v27 + v31 IS NOT NULL UNION ALL SELECT 'Trading', year, month, CAST(v46 AS DOUBLE) FROM ({_LINES}) WHERE bank_type_code = '10001' AND v46 IS NOT NULL),
t AS (SELECT a.bucket, a.year, a.month, CASE WHEN a.month = 12 THEN a.v ELSE a.v + (d.v - p.v) END AS ttm FROM b a LEFT JOIN b d ON d.bucket = a.bucket AND d.year = a.year - 1 AND d.month = 12 LEFT JOIN b p ON p.bucket = a.bucket AND p.year = a.year - 1 AND p.month = a.month),
e AS (SELECT year, month, CASE WHEN count(value) OVER w >= 6 THEN CAST(sum(value) OVER w AS DOUBLE) / count(value) OVER w END AS mean FROM (SELECT year, month, sum(amount_total) AS value FROM bs WHERE item_name ILIKE '%TOPLAM ÖZKAYN%' AND bank_type_code = '10001' GROUP BY ALL) WINDOW w AS (ORDER BY year, month ROWS 12 PRECEDING)),
s AS (SELECT bucket, make_date(year, month, 1) AS period, ttm / mean * 100 AS value FROM t JOIN e USING (year, month) WHERE ttm IS NOT NULL AND mean > 0),
l AS (SELECT * FROM s WHERE period IN (SELECT DISTINCT period FROM s ORDER BY period DESC LIMIT 3))
SELECT bucket, period, round(value, 4) AS value FROM l UNION ALL SELECT 'ROE', period, round(sum(value), 4) FROM l GROUP BY period)""", "names", "o", "bs", "inc")
def _(spark, sf):
    return engine(spark, sf).roe_components("10001").withColumn("value", F.round("value", 4))


@query("published_annualised", _standard("SELECT *, ratio_value * 12.0 / month AS value FROM fr WHERE table_number = 15 AND item_name LIKE 'Toplam Nakdi Krediler / Toplam Mevduat%' AND bank_type_code IN ('10001', '10003', '10004')"), "names", "o", "fr")
def _(spark, sf):
    from tidewell.operators import timeseries

    return _shown(timeseries.annualised_ytd(engine(spark, sf).with_entities("10001", "10003", "10004").published({"ldr": X.PUBLISHED["ldr"]})))


@query("literal_filter", "SELECT p_partkey, contains(p_name, 'red') AS hit FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", E.has_text("p_name", "red").alias("hit"))


@query("load_violations", "SELECT count(*) AS rows, count(CASE WHEN abs(value) >= 50 THEN 1 END) AS dropped FROM events")
def _(spark, sf):
    return ingest.violations(table(spark, sf, "events"), limit=50)


@query("window_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    got = windows.tumbling(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
