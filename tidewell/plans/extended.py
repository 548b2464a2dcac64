"""Named items beyond the catalogue: segments, mixes, published ratios, income lines, ratios of items.

What belongs together is one scan and one aggregation. Long results have a label column before the standard shape.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions.expr import ascii_like, guarded_ratio, half_even, has_text, ratio
from tidewell.operators import shapes, timeseries
from tidewell.plans import catalog
from tidewell.plans.catalog import Metric, Where
from tidewell.plans.compiler import KEYS, Engine

_SUM = {"TOTAL": ("total_amount",)}


def _items(table: str, number: int, names: dict[str, str], exact: bool = False) -> dict[str, Metric]:
    how = (lambda n: Where(equal=(("table_number", number), ("item_name", n)))) if exact else (lambda n: Where((n,), equal=(("table_number", number),)))
    return {label: Metric(label, label, "credit", table, how(name), _SUM) for label, name in names.items()}


# Labels, tables, item names and patterns of the segments.
SME_TOTAL = _items("loans", 6, {"SME": "Toplam KOBİ Kredileri%"})
SME = _items("loans", 6, {"Micro": "Mikro İşletmelere%", "Small": "Küçük İşletmelere%", "Medium": "Orta Büyüklükteki İşletmelere%"})
CONSUMER = _items("loans", 4, {"Housing": "Tüketici Kredileri - Konut", "Auto": "Tüketici Kredileri - Taşıt", "General Purpose": "Tüketici Kredileri - İhtiyaç", "Retail Cards": "Bireysel Kredi Kartları (10+11)%"})
CONSUMER_NPL = _items("loans", 4, {"Housing": "Takipteki Konut Kredileri", "Auto": "Takipteki Taşıt Kredileri", "GPL": "Takipteki İhtiyaç Kredileri", "Retail Cards": "Takipteki Bireysel Kredi Kartları"}, exact=True)
NPL_BASES = {label: m if "%" in m.where.like[0] else _items("loans", 4, {label: m.where.like[0]}, exact=True)[label] for label, m in CONSUMER.items()}
TABLE_4 = _items("loans", 4, {
    "consumer_loans": "Tüketici Kredileri (2+3+4)%",
    "consumer_housing": "Tüketici Kredileri - Konut",
    "consumer_auto": "Tüketici Kredileri - Taşıt",
    "consumer_gpl": "Tüketici Kredileri - İhtiyaç",
    "retail_credit_cards": "Bireysel Kredi Kartları (10+11)%",
    "corporate_credit_cards": "Kurumsal Kredi Kartları (28+29)%",
    "commercial_installment": "Taksitli Ticari Krediler (20+21+22)%",
})
DOMESTIC = _items("deposits", 10, {"FX": "Döviz Tevdiat Hesabı / Katılım Fonları - Yurt İçi Yerleşik", "TL": "TP Mevduat / Katılım Fonları - Yurt İçi Yerleşik"}, exact=True)
MATURITIES = {"Demand": "demand", "≤ 1m": "maturity_1m", "1–3m": "maturity_1_3m", "3–6m": "maturity_3_6m", "6–12m": "maturity_6_12m", "> 12m": "maturity_over_12m"}
PUBLISHED = {
    "npl": "Takipteki Alacaklar (Brüt) / Toplam Nakdi Krediler%",
    "ldr": "Toplam Nakdi Krediler / Toplam Mevduat (Kalkınma ve Yatırım Bankaları Hariç)%",
    "coverage": "Takipteki Alacaklar Karşılığı / Brüt Takipteki Alacaklar%",
    "car": "Yasal Özkaynak / Risk Ağırlıklı Kalemler Toplamı%",
    "roa_ytd": "Dönem Net Kârı (Zararı) / Ortalama Toplam Aktifler%",
    "roe_ytd": "Dönem Net Kârı (Zararı) / Ortalama Özkaynaklar%",
    "nim_ytd": "Net Faiz Geliri (Gideri) / Ortalama Toplam Aktifler%",
    "demand_share": "Vadesiz Mevduat / Toplam Mevduat%",
}
CET1 = (12, "Çekirdek Sermaye Yeterliliği Rasyosu%")
# Income lines: net interest, the two that make up revenue with it, trading and exchange, fees.
INTEREST, REVENUE, TRADING, FEES = 24, (24, 34, 50), (46, 47), (27, 31)
# Parts of the return on equity and their income lines.
ROE = {"NII": (24,), "Fees": (27, 31), "Trading": (46,), "Other NII": (30, 32, 33, 47, 48, 49), "OPEX": (35, 42, 43, 44), "Provisions": (25, 36, 38, 39, 40), "Other/tax": (52,)}
# Parts of the interest margin and their income lines; the line of all interest income; the name of the
# published yield on earning assets.
NIM = {"Loans": (1, 6), "Securities": (9, 10, 11), "Banks/MM": (7, 8, 12, 13, 14), "Deposits": (16,), "Debt issued": (17, 18, 19, 20, 21, 22)}
INTEREST_INCOME, EARNING_YIELD = 15, "Toplam Faiz Gelirleri / Faiz Getirili Aktifler Ortalaması%"
CREDIT, EQUITY = "%Krediler%", "%TOPLAM ÖZKAYN%"
# Weekly items by the names that tell them.
WEEKLY_13W = {
    "total_loans": "Toplam Krediler (2+10)",
    "consumer_total": "Tüketici Kredileri ve Bireysel Kredi Kartları (3+7)",
    "consumer_loans": "Tüketici Kredileri (4+5+6)",
    "retail_credit_cards": "Bireysel Kredi Kartları (8+9)",
    "corporate_loans": "Ticari ve Diğer Krediler",
    "sme_loans": "KOBİ Kredileri (Bilgi)",
}


class Extended(Engine):
    """The engine with the named items. Entities: those of the engine; with_entities gives it others."""

    def with_entities(self, *codes: str) -> Extended:
        return Extended(self.tables, codes or None, self.or_precedence)

    def segments(self, wanted: dict[str, Metric], currency: str = "TOTAL") -> DataFrame:
        """label and standard shape for every item that has rows; one scan."""
        return self.shaped(self.cells(wanted, currency, "label")).select("label", "year", "month", "period", "bank_type_code", "bank_type", "value")

    def maturity_mix(self) -> DataFrame:
        """Deposits by maturity, one scan; a bucket without a value is a row with null."""
        where = Where(equal=(("table_number", 10), ("item_name", "TOPLAM MEVDUAT")))
        return self.segments({label: Metric(label, label, "deposits", "deposits", where, {"TOTAL": (column,)}) for label, column in MATURITIES.items()})

    def published(self, patterns: dict[str, str] | None = None, table_number: int = 15) -> DataFrame:
        """Published ratios, one row per published row: label, standard shape, item_name. One scan for all names."""
        t = self._rows("financial_ratios").where(F.col("table_number") == table_number)
        return self._named(t, patterns or PUBLISHED, F.col("ratio_value"))

    def other_items(self, table_number: int, patterns: dict[str, str]) -> DataFrame:
        """Items of the long table, as published()."""
        return self._named(self._rows("other_data").where(F.col("table_number") == table_number), patterns, F.col("value_numeric"))

    def cet1(self) -> DataFrame:
        return self.other_items(CET1[0], {"cet1": CET1[1]})

    def _rows(self, table: str) -> DataFrame:
        t = self.tables[table]
        return t if self.entities is None else t.where(self.entities)

    def _named(self, t: DataFrame, patterns: dict[str, str], value) -> DataFrame:
        some = None
        for p in patterns.values():
            some = ascii_like("item_name", p) if some is None else some | ascii_like("item_name", p)
        labels = F.explode(F.filter(F.array(*(F.when(ascii_like("item_name", p), F.lit(n)) for n, p in patterns.items())), lambda x: x.isNotNull()))
        return self.shaped(t.where(some).select(*KEYS, value.cast("double").alias("value"), labels.alias("label"), "item_name"))

    def income_items(self, orders: Iterable[int]) -> DataFrame:
        """Cumulative income lines: item_order, standard shape; one scan. item_name: the least of the lines summed."""
        t = self._rows("income_statement").where(F.col("item_order").isin(*orders))
        return self.shaped(t.groupBy(*KEYS, "item_order").agg(F.sum("amount_total").alias("value"), F.min("item_name").alias("item_name")))

    def income_sum(self, orders: Iterable[int]) -> DataFrame:
        """The sum of the lines where all of them are there, in one pass; null if one is null."""
        wide = self._lines(orders)
        total = None
        for o in orders:
            total = F.col(f"v{o}") if total is None else total + F.col(f"v{o}")
        return self.shaped(wide.where(self._all(orders)).select(*KEYS, total.alias("value")))

    def _lines(self, orders: Iterable[int]) -> DataFrame:
        one = lambda o: F.col("item_order") == o
        aggs = [x for o in orders for x in (F.sum(F.when(one(o), F.col("amount_total"))).alias(f"v{o}"), F.count(F.when(one(o), 1)).alias(f"n{o}"))]
        return self._rows("income_statement").where(F.col("item_order").isin(*orders)).groupBy(*KEYS).agg(*aggs)

    @staticmethod
    def _all(orders: Iterable[int]):
        out = F.lit(True)
        for o in orders:
            out = out & (F.col(f"n{o}") > 0)
        return out

    def revenue_shares(self) -> DataFrame:
        """label (interest, trading), standard shape: percent of revenue. One scan; months without a line of revenue, or
        of the numerator, have no row, nor has a revenue of 0."""
        wide = self._lines([*REVENUE, *TRADING])
        plus = lambda orders: sum((F.col(f"v{o}") for o in orders[1:]), F.col(f"v{orders[0]}"))
        cells = [F.struct(F.lit(label).alias("label"), F.when(self._all(lines), ratio(plus(lines), plus(REVENUE), 100)).alias("value")) for label, lines in (("interest", (INTEREST,)), ("trading", TRADING))]
        long = wide.where(self._all(REVENUE)).select(*KEYS, F.explode(F.array(*cells)).alias("c")).select(*KEYS, "c.label", "c.value")
        return self.shaped(long.where("value is not null"))

    def fees_growth(self) -> DataFrame:
        """Cumulative fee income against the same month of the year before that has a row."""
        return timeseries.same_month_change(self.income_sum(FEES), ["bank_type_code"], out="growth").drop("value").withColumnRenamed("growth", "value")

    def item_ratio(self, pairs: dict[str, tuple[Where, Where]], currency: str = "TL") -> DataFrame:
        """label, standard shape: percent of one loan item of another, for months and entities with both and a positive
        denominator. Names with % match as patterns. All pairs: one scan."""
        only = (("currency", currency),)
        sides = {f"{label}/{k}": Metric(label, label, "credit", "loans", Where(w.like, w.unlike, (*w.equal, *only)), _SUM) for label, pair in pairs.items() for k, w in enumerate(pair)}
        wide = self.columns([(name, m, "TOTAL") for name, m in sides.items()])
        cell = lambda p: F.struct(F.lit(p).alias("label"), F.when((F.col(f"`_{p}/0`") > 0) & (F.col(f"`_{p}/1`") > 0), guarded_ratio(F.col(f"`{p}/0`"), F.col(f"`{p}/1`"), 100)).alias("value"))
        long = wide.select(*KEYS, F.explode(F.array(*(cell(p) for p in pairs))).alias("c")).select(*KEYS, "c.label", "c.value")
        return self.shaped(long.where("value is not null"))

    def consumer_npl_ratios(self, currency: str = "TL") -> DataFrame:
        """Non-performing part of each consumer product: names with % are patterns, others match as they are."""
        of = {"GPL": "General Purpose"}
        return self.item_ratio({label: (m.where, NPL_BASES[of.get(label, label)].where) for label, m in CONSUMER_NPL.items()}, currency)

    def weekly_ratio(self, numerator: str, denominator: str, code: str = catalog.SECTOR, currency: str = "TOTAL", less: tuple[str, str] | None = None) -> DataFrame:
        """period, value: percent of one weekly item of another; less: two items taken off them first (A - B) / (C - D).
        Weeks with a null, a missing item or a denominator that isn't positive have no row. One scan, no join."""
        items = [numerator, denominator, *(less or ())]
        of = lambda i: F.sum(F.when(F.col("item_id") == i, F.col("value")))
        t = self.tables["weekly_series"].where(F.col("item_id").isin(*items) & (F.col("bank_type_code") == code) & (F.col("currency") == currency))
        wide = t.groupBy(F.col("period_date").alias("period")).agg(*(of(i).alias(f"v{k}") for k, i in enumerate(items)))
        top, low = (F.col(f"v{k}") - F.col(f"v{k + 2}") if less else F.col(f"v{k}") for k in (0, 1))
        return wide.select("period", guarded_ratio(top, low, 100).alias("value")).where("value is not null")

    def weekly_growth_13w(self, items: dict[str, str] | None = None, weeks: int = 14, items_per_week: int = 22) -> DataFrame:
        """metric_id, start_date, end_date, start_value, end_value, growth_13w_simple, growth_13w_annualized, weeks: over
        the latest weeks * items_per_week rows of loans; a name counts where it is part of an item's name, and needs 14
        rows. One sort of the latest rows, one aggregation for all names."""
        t = self.tables["weekly_bulletin"].where("category = 'krediler'").orderBy(F.desc("period_date"), "item_name").limit(weeks * items_per_week)
        labels = F.filter(F.array(*(F.when(has_text("item_name", n), F.lit(m)) for m, n in (items or WEEKLY_13W).items())), lambda x: x.isNotNull())
        at = F.struct("period_date", "item_name")
        got = t.select("period_date", "item_name", "total_value", F.explode(labels).alias("metric_id")).groupBy("metric_id")
        got = got.agg(F.min("period_date").alias("start_date"), F.max("period_date").alias("end_date"), F.min_by("total_value", at).alias("start_value"), F.max_by("total_value", at).alias("end_value"), F.count("*").alias("weeks"))
        times = ratio("end_value", "start_value")
        return got.where(F.col("weeks") >= 14).withColumns({"growth_13w_simple": half_even((times - 1) * 100), "growth_13w_annualized": half_even((F.pow(times, F.lit(52 / 13)) - 1) * 100)})

    def credit_parts(self, rate: DataFrame) -> DataFrame:
        """Standard keys with loans_tl, loans_fx, loans_total, rate and loans_fx_usd; rate (period, rate): months without
        one have null. One scan."""
        amounts = {"TL": ("amount_tl",), "FX": ("amount_fx",), "TOTAL": ("amount_total",)}
        credit = Metric("credit", "Credit", "credit", "balance_sheet", Where((CREDIT,)), amounts)
        names = {"loans_tl": "TL", "loans_fx": "FX", "loans_total": "TOTAL"}
        wide = self.columns([(n, credit, c) for n, c in names.items()])
        wide = self.shaped(wide.select(*KEYS, *(F.col(n).cast("double").alias(n) for n in names), F.col("loans_total").cast("double").alias("value"))).drop("value")
        return wide.join(rate.select("period", "rate"), "period", "left").withColumn("loans_fx_usd", ratio("loans_fx", "rate"))

    def credit_growth(self, rate: DataFrame, periods: int = 12, annualise: bool = True) -> DataFrame:
        """tl_growth, fx_growth_usd, total_growth_nominal and total_growth_fx_adj, the last with the foreign part at the
        earlier month's rate, in percent; annualised unless over 12 months. Rows lacking one of them are left out."""
        w = W.partitionBy("bank_type_code").orderBy("period")
        was = lambda c: F.lag(c, periods).over(w)
        df = self.credit_parts(rate).withColumns({f"_{c}": was(c) for c in ("loans_tl", "loans_fx_usd", "loans_total", "rate")})
        grown = lambda c: ratio(F.col(c) - F.col(f"_{c}"), f"_{c}", 100)
        fixed = (F.col("loans_tl") - F.col("_loans_tl")) + (F.col("loans_fx_usd") - F.col("_loans_fx_usd")) * F.col("_rate")
        rates = {"tl_growth": grown("loans_tl"), "fx_growth_usd": grown("loans_fx_usd"), "total_growth_nominal": grown("loans_total"), "total_growth_fx_adj": ratio(fixed, "_loans_total", 100)}
        if annualise and periods != 12:
            rates = {n: (F.pow(1 + c / 100, F.lit(12 / periods)) - 1) * 100 for n, c in rates.items()}
        out = df.withColumns(rates).drop("_loans_tl", "_loans_fx_usd", "_loans_total", "_rate")
        return out.na.drop(subset=["loans_tl", "loans_fx", "loans_total", "loans_fx_usd", *rates])

    def credit_growth_summary(self, rate: DataFrame, code: str = catalog.SECTOR) -> DataFrame:
        """kind (yoy, 3m_annualized), period and the four rates of the last row, rounded to a digit, half to even."""
        names = ["total_growth_nominal", "total_growth_fx_adj", "tl_growth", "fx_growth_usd"]
        one = self.with_entities(code)
        last = lambda df, kind: df.orderBy(F.desc("period")).limit(1).select(F.lit(kind).alias("kind"), "period", *(half_even(n, 1).alias(n) for n in names))
        return last(one.credit_growth(rate, 12), "yoy").unionByName(last(one.credit_growth(rate, 3), "3m_annualized"))

    def segment_growth(self, wanted: dict[str, Metric], periods: int = 12) -> DataFrame:
        """label and standard shape: percent growth of each segment over so many rows; one scan."""
        got = timeseries.growth(self.segments(wanted), periods, ["label", "bank_type_code"], out="g")
        return got.drop("value").withColumnRenamed("g", "value")

    def nowcast(self, rows: int, items: Iterable[str], codes: Iterable[str], currencies: Iterable[str] = ("TOTAL",)) -> DataFrame:
        """item_id, bank_type_code, currency, period_date, value: annualised growth of weekly series over ``rows`` weeks;
        one scan for all of them."""
        t = self.tables["weekly_series"].where(F.col("item_id").isin(*items) & F.col("bank_type_code").isin(*codes) & F.col("currency").isin(*currencies))
        keys = ["item_id", "bank_type_code", "currency"]
        return timeseries.growth_annualised(t.select(*keys, "period_date", "value"), rows, keys, out="g").select(*keys, "period_date", F.col("g").alias("value"))

    def roe_components(self, code: str = "10002", last: int = 3) -> DataFrame:
        """bucket, period, value: each part of the return on equity over twelve months in percent of the mean equity of 13
        months (6 at least), for the last periods of any part; bucket ROE: the sum of the parts that are there."""
        one = self.with_entities(code)
        lines = [o for orders in ROE.values() for o in orders]
        plus = lambda orders: sum((F.col(f"v{o}") for o in orders[1:]), F.col(f"v{orders[0]}"))
        cells = F.array(*(F.struct(F.lit(b).alias("bucket"), F.when(self._all(orders), plus(orders)).cast("double").alias("value")) for b, orders in ROE.items()))
        flows = one._lines(lines).select(*KEYS, F.explode(cells).alias("c")).select(*KEYS, "c.bucket", "c.value").where("value is not null")
        flows = timeseries.trailing_year(flows, ["bucket"])
        equity = timeseries.rolling_mean(one.item(EQUITY), 13, 6, ["bank_type_code"]).select("year", "month", "mean")
        parts = flows.join(equity, ["year", "month"], "left").select("bucket", F.make_date("year", "month", F.lit(1)).alias("period"), guarded_ratio("ttm", "mean", 100).alias("value")).where("value is not null")
        # Parts times months, however long the facts are: one window numbers the months.
        ranked = parts.withColumn("_r", F.dense_rank().over(W.partitionBy(F.lit(0)).orderBy(F.desc("period")))).where(F.col("_r") <= last).drop("_r")
        both = ranked.select(F.explode(F.array("bucket", F.lit("ROE"))).alias("bucket"), "period", "value")
        return both.groupBy("bucket", "period").agg(F.sum("value").alias("value"))

    def margin_components(self) -> DataFrame:
        """label and standard shape: each part of the interest margin in percent of average earning assets.

        The average isn't published; the published yield, interest income over it, gives it back: income of the year so
        far times 12 / month over the yield. "Other income" is what the named parts leave of interest income, so that
        Loans, Securities, Banks/MM and Other income add up to the published yield; "Margin" is the sum of all parts that
        are there. Months without interest income, a positive yield, or with a yield given twice have no row. One scan of
        the income lines and one of the ratios.
        """
        lines = [INTEREST_INCOME, *(o for orders in NIM.values() for o in orders)]
        rates = self._rows("financial_ratios").where((F.col("table_number") == 15) & ascii_like("item_name", EARNING_YIELD))
        rates = rates.groupBy(*KEYS).agg(F.max("ratio_value").cast("double").alias("_yield"), F.count("*").alias("_times")).where("_times = 1 and _yield > 0")
        wide = self._lines(lines).where(F.col(f"n{INTEREST_INCOME}") > 0).join(rates, KEYS)
        year = lambda c: c.cast("double") * F.lit(12.0) / F.col("month")
        wide = wide.withColumn("_assets", guarded_ratio(year(F.col(f"v{INTEREST_INCOME}")), "_yield", 100)).where("_assets > 0")
        total = lambda orders: sum((F.coalesce(F.col(f"v{o}").cast("double"), F.lit(0.0)) for o in orders), F.lit(0.0))
        some = lambda orders: sum((F.coalesce(F.col(f"n{o}"), F.lit(0)) for o in orders), F.lit(0)) > 0
        share = lambda amount: ratio(year(amount), "_assets", 100)
        income = [o for label in ("Loans", "Securities", "Banks/MM") for o in NIM[label]]
        costs = [o for label in ("Deposits", "Debt issued") for o in NIM[label]]
        cells = [F.struct(F.lit(label).alias("label"), F.when(some(orders), share(total(orders))).alias("value")) for label, orders in NIM.items()]
        cells.append(F.struct(F.lit("Other income").alias("label"), share(F.col(f"v{INTEREST_INCOME}").cast("double") - total(income)).alias("value")))
        cells.append(F.struct(F.lit("Margin").alias("label"), share(F.col(f"v{INTEREST_INCOME}").cast("double") + total(costs)).alias("value")))
        long = wide.select(*KEYS, F.explode(F.array(*cells)).alias("c")).select(*KEYS, "c.label", "c.value").where("value is not null")
        return self.shaped(long)

    def real_rate(self, expected_rate: DataFrame, expected_inflation: DataFrame) -> DataFrame:
        """date, value: (1 + expected policy rate) / (1 + expected inflation) - 1 in percent, for the dates of both
        (date, value in percent)."""
        both = expected_rate.select("date", F.col("value").alias("_r")).join(expected_inflation.select("date", F.col("value").alias("_p")), "date")
        return both.select("date", ((F.lit(1.0) + F.col("_r") / 100) / (F.lit(1.0) + F.col("_p") / 100) - 1).alias("_x")).select("date", (F.col("_x") * 100).alias("value")).where("value is not null")

    def return_and_inflation(self, prices: DataFrame) -> DataFrame:
        """period, series, value: the published return on equity, annualised, of each entity (series: its name), and the
        mean of the last 12 yearly price changes (series: CPI 12m avg) from a monthly index (period, value)."""
        roe = timeseries.annualised_ytd(self.published({"roe": PUBLISHED["roe_ytd"]})).select("period", F.col("bank_type").alias("series"), "value")
        w = W.partitionBy(F.lit(0)).orderBy("period")  # a row for each month of one index
        yearly = prices.withColumn("value", (ratio("value", F.lag("value", 12).over(w)) - 1) * 100).where("value is not null").withColumn("series", F.lit("CPI 12m avg"))
        mean = timeseries.rolling_mean(yearly, 12, 12, ["series"]).where("mean is not null").select("period", "series", F.col("mean").alias("value"))
        return roe.unionByName(mean)


def filter_from(df: DataFrame, start: str, period: str = "period") -> DataFrame:
    """Rows from a month ('2024-01') or a day on; reaches the scan as a filter."""
    return df.where(F.col(period) >= F.lit(f"{start}-01" if len(start) == 7 else start).cast("date"))


#: Ranges back from the last date: months, or 0 for the year so far.
PRESETS = {"1M": 1, "3M": 3, "6M": 6, "YTD": 0, "1Y": 12, "3Y": 36, "5Y": 60}


def preset(df: DataFrame, name: str, period: str = "period") -> DataFrame:
    """Rows from the range's first date, seen from the latest date of df, on; MAX: all.

    One pass: df is a monthly or weekly result, of periods times entities, whose latest date one window finds.
    """
    if name == "MAX":
        return df
    last = F.max(period).over(W.partitionBy(F.lit(0)))
    start = F.trunc("_last", "year") if name == "YTD" else F.add_months("_last", -PRESETS[name])
    return df.withColumn("_last", last).where(F.col(period) >= start).drop("_last")


class Frames:
    """Getters over report frames, wherever they come from: long() gives them as one table."""

    KPIS = {"total_assets": 1e6, "total_loans": 1e6, "total_deposits": 1e6, "total_equity": 1e6, "npl_ratio": 1.0, "ldr": 1.0, "equity_ratio": 1.0, "loan_growth_yoy": 1.0}
    COMPARED = ["total_assets", "total_loans", "npl_ratio", "ldr", "equity_ratio"]

    def long(self, ids: Iterable[str] | None = None) -> DataFrame:
        """metric_id and standard shape of the named frames, or of all."""
        raise NotImplementedError

    def get(self, id: str) -> DataFrame:
        """One frame; an unknown id is an empty one."""
        return self.long([id])

    def latest(self, id: str, code: str | None = None) -> DataFrame:
        """The rows of the frame's latest period of all entities, or one entity's of that period."""
        out = shapes.latest(self.get(id), by=["bank_type_code"])
        return out if code is None else out.where(F.col("bank_type_code") == code)

    comparison_of = latest

    def latest_value(self, id: str, code: str = catalog.SECTOR) -> float | None:
        row = self.latest(id, code).select("value").first()
        return None if row is None else row["value"]

    def time_series(self, id: str, code: str | None = None) -> DataFrame:
        df = self.get(id)
        return (df if code is None else df.where(F.col("bank_type_code") == code)).orderBy("period", "bank_type_code")

    def period_range(self) -> DataFrame:
        return self.get("total_assets").agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"))

    def kpis(self, code: str = catalog.SECTOR) -> DataFrame:
        """metric_id, period, value, change, change_percent of an entity's last two rows of each headline frame."""
        scale = F.create_map(*(F.lit(x) for kv in self.KPIS.items() for x in kv))
        rows = self.long(self.KPIS).where(F.col("bank_type_code") == code)
        w = W.partitionBy("metric_id").orderBy("period")
        rows = rows.withColumn("value", F.col("value") / F.element_at(scale, F.col("metric_id")))
        got = rows.withColumns({"previous": F.lag("value").over(w), "_next": F.lead("period").over(w)}).where("_next is null")
        change = F.col("value") - F.col("previous")
        return got.select("metric_id", "period", "value", change.alias("change"), ratio(change, F.abs("previous"), 100).alias("change_percent"))

    def bank_comparison(self) -> DataFrame:
        """bank_type and a column for each compared frame: each frame's latest period."""
        rows = self.long(self.COMPARED)
        last = F.max("period").over(W.partitionBy("metric_id"))
        rows = rows.withColumn("_last", last).where(F.col("period") == F.col("_last"))
        return rows.groupBy("bank_type").agg(*(F.max(F.when(F.col("metric_id") == m, F.col("value"))).alias(m) for m in self.COMPARED))


class Store(Frames, Extended):
    """The 28 report frames as a plan over the facts: metric_id and standard shape. Each fact table is scanned once, and
    not at all if none of the wanted frames needs it."""

    #: Frame -> balance-sheet line and currency.
    LEVELS = {
        **{f"{m}{suffix}": (m, c) for m in ("total_assets", "total_loans", "total_deposits") for suffix, c in (("", "TOTAL"), ("_tl", "TL"), ("_fx", "FX"))},
        **{m: (m, "TOTAL") for m in ("npl_amount", "total_equity", "total_liabilities")},
    }
    RATIOS = {"npl_ratio": ("npl_amount", "total_loans"), "ldr": ("total_loans", "total_deposits"), "equity_ratio": ("total_equity", "total_assets")}
    SHARES = {"fx_loan_share": ("total_loans_fx", "total_loans"), "fx_deposit_share": ("total_deposits_fx", "total_deposits")}
    GROWTH = {"loan_growth_yoy": ("total_loans", 12), "asset_growth_yoy": ("total_assets", 12), "deposit_growth_yoy": ("total_deposits", 12)}

    def ids(self) -> list[str]:
        return [*self.LEVELS, *TABLE_4, *self.RATIOS, *self.GROWTH, *self.SHARES, "market_share"]

    def long(self, ids: Iterable[str] | None = None) -> DataFrame:
        """The named frames, or all. Shares are rounded to 2 digits, half to even; the market share needs the sector's row."""
        wanted = self.ids() if ids is None else [i for i in self.ids() if i in set(ids)]
        parts = [p for p in (self._levels([i for i in wanted if i not in TABLE_4]), self._table_4([i for i in wanted if i in TABLE_4])) if p is not None]
        if not parts:
            return self.long(["total_assets"]).limit(0)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _table_4(self, ids: list[str]) -> DataFrame | None:
        # Before the first loans are loaded their frames have no rows.
        return self.shaped(self.cells({i: TABLE_4[i] for i in ids}, "TOTAL", "metric_id")) if ids and "loans" in self.tables else None

    def _levels(self, ids: list[str]) -> DataFrame | None:
        """Frames of the balance sheet: one wide aggregation, and growth rates by a window over its cells."""
        both = self.RATIOS | self.SHARES
        lines = list(dict.fromkeys(x for i in ids for x in ([i] if i in self.LEVELS else both[i] if i in both else [self.GROWTH[i][0]] if i in self.GROWTH else ["total_assets"])))
        if not lines:
            return None
        wide = self.columns([(f, self.resolved(self.LEVELS[f][0]), self.LEVELS[f][1]) for f in lines])
        if "market_share" in ids:
            sector = F.when((F.col("bank_type_code") == catalog.SECTOR) & (F.col("_total_assets") > 0), F.col("total_assets"))
            wide = wide.withColumn("_sector", F.max(sector).over(W.partitionBy("year", "month")))
        there = lambda *fs: [F.col(f"_{f}") > 0 for f in fs]

        def cell(i: str) -> Column:
            lag = 0
            if i in self.LEVELS:
                v, has = F.col(i), there(i)
            elif i in both:
                v, has = ratio(*both[i], 100), there(*both[i])
                v = half_even(v) if i in self.SHARES else v
            elif i in self.GROWTH:
                (base, lag) = self.GROWTH[i]
                v, has = F.col(base), there(base)
            else:
                v, has = half_even(ratio("total_assets", "_sector", 100)), [*there("total_assets"), F.col("_sector").isNotNull()]
            return F.struct(F.lit(i).alias("metric_id"), v.cast("double").alias("value"), F.lit(lag).alias("lag"), F.array_min(F.array(*has)).alias("there"))

        long = wide.select(*KEYS, F.explode(F.array(*map(cell, ids))).alias("c")).where("c.there").select(*KEYS, "c.metric_id", "c.value", "c.lag")
        lags = sorted({n for i, (_, n) in self.GROWTH.items() if i in ids})
        if lags:
            w = W.partitionBy("metric_id", "bank_type_code").orderBy("year", "month")
            was = F.coalesce(*(F.when(F.col("lag") == n, F.lag("value", n).over(w)) for n in lags))
            grown = ratio(F.col("value") - F.col("_was"), "_was", 100)
            long = long.withColumn("_was", was).withColumn("value", F.when(F.col("lag") == 0, F.col("value")).otherwise(grown)).where("lag = 0 or value is not null")
        return self.shaped(long.select(*KEYS, "value", "metric_id"))
